"""WARC archives from pages, and the normaliser of monolithic gzip.

Archives are first written as one gzip stream a file. The normaliser inflates each file once, as a stream, writes
every record as a gzip member of its own, and beside the archive an index of offset, length and record id, through
which any record can be read alone. Tasks write under names of their own and report them in rows that Spark
commits, so that a task that runs again leaves nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.llm.common import fresh_path, written

CHUNK = 1 << 20
#: Records of one reading task.
READ_RECORDS = 1_000
# Fixed values of the format.
VERSION, EPOCH = "WARC/1.1", "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of ``refers_to``: the same HTTP head without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>",
        f"WARC-Date: {EPOCH}", f"WARC-Target-URI: {_line(url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def head(data: bytes) -> tuple[dict[str, str], int]:
    """The headers of a record (names in lower case), and where its block begins."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def inflated(source: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, as a stream."""
    stream = zlib.decompressobj(31)
    for data in source:
        more = True
        while more:
            out = stream.decompress(data, CHUNK)
            if out:
                yield out
            data = stream.unconsumed_tail
            if stream.eof:
                data, stream = stream.unused_data, zlib.decompressobj(31)
            more = data or len(out) == CHUNK  # a full chunk: more may wait inside


def records(source: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream of bytes; it holds no more than one record and one chunk."""
    kept = bytearray()
    need = None
    for data in source:
        kept += data
        while True:
            if need is None:
                at = kept.find(b"\r\n\r\n")
                if at < 0:
                    break
                headers, begin = head(bytes(kept[: at + 4]))
                need = begin + int(headers["content-length"]) + 4
            if len(kept) < need:
                break
            yield bytes(kept[:need])
            del kept[:need]
            need = None
    if kept:
        raise ValueError("the archive ends inside a record")


def _read_chunks(path: str, offset: int = 0, length: int | None = None) -> Iterator[bytes]:
    system, name = _open(path)
    with system.open_input_file(name) as f:
        f.seek(offset)
        left = f.size() - offset if length is None else length
        while left > 0 and (data := f.read(min(CHUNK, left))):
            left -= len(data)
            yield data


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Monolithic archives of all pages in ``folder``: rows (path, records).

    Of pages with equal payloads of ``least`` bytes or more that with the largest id is the response, the others
    are revisits. A null payload is an empty one.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    copied = own.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    joined = own.join(written(copied, "copied"), "sha", "left").withColumn("refers", F.when(F.col("first") > F.coalesce("id", F.lit(-(2**63))), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, out = f"{folder}/{uuid.uuid4().hex}.mono.warc.gz", 0, None
        packer = zlib.compressobj(3, zlib.DEFLATED, 31)
        for batch in batches:
            if out is None and batch.num_rows:
                system, name = _open(path)
                system.create_dir(name.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(name, compression=None)
            for i, url, data, sha, refers in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "sha", "refers")), strict=True):
                out.write(packer.compress(record(i, url, data, base64.b32encode(bytes.fromhex(sha)).decode(), refers)))
                n += 1
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return written(joined.select("id", "url", "payload", "sha", "refers").mapInArrow(run, "path string, records long"), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Each archive of ``archives`` (path) with a gzip member a record and its index: rows (path, index, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("path").to_pylist():
                base, at, n = f"{folder}/{uuid.uuid4().hex}", 0, 0
                system, name = _open(base)
                system.create_dir(name.rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{name}.warc.gz", compression=None) as out, system.open_output_stream(f"{name}.idx", compression=None) as index:
                    for data in records(inflated(_read_chunks(source))):
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = packer.compress(data) + packer.flush()
                        out.write(member)
                        index.write(f"{at} {len(member)} {head(data)[0]['warc-record-id']}\n".encode())
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{base}.warc.gz"]), pa.array([f"{base}.idx"]), pa.array([n], pa.int64())], names=["path", "index", "records"])

    tasks = max(1, archives.count())  # one archive a task
    return written(archives.select("path").repartition(tasks).mapInArrow(run, "path string, index string, records long"), "normalised")


def read_records(normalised: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) through the indexes.

    payload is null for revisits, whose size and digest stand in their heads. A response whose payload doesn't have
    its digest stops the job.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                rows, begin, end, n, tail = [], 0, 0, 0, b""
                for data in _read_chunks(index):
                    *lines, tail = (tail + data).split(b"\n")
                    for line in lines:
                        end, n = sum(map(int, line.split(b" ", 2)[:2])), n + 1
                        if n == READ_RECORDS:
                            rows.append((path, begin, end - begin))
                            begin, n = end, 0
                if n:
                    rows.append((path, begin, end - begin))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["path", "begin", "size"])

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def parse(data: bytes) -> tuple:
        headers, begin = head(data)
        block = data[begin:-4]
        http, body = head(block)
        payload, digest = block[body:], headers["warc-payload-digest"].removeprefix("sha1:")
        page = lambda name: int(v) if (v := headers.get(name, "").strip("<>").removeprefix(ID_PREFIX)) else None
        if headers["warc-type"] == "revisit":
            return page("warc-record-id"), headers["warc-target-uri"], "revisit", int(http["content-length"]), digest, page("warc-refers-to"), None
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} doesn't have its digest")
        return page("warc-record-id"), headers["warc-target-uri"], "response", len(payload), digest, None, payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, size in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "size")), strict=True):
                rows, held = [], 0
                for data in records(inflated(_read_chunks(path, begin, size))):
                    rows.append(parse(data))
                    held += len(data)
                    if held > 16 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    dealt = written(normalised.select("path", "index").mapInArrow(ranges, "path string, begin long, size long"), "ranges")
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return dealt.repartition(max(1, dealt.count())).mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Pages written as archives, normalised, and read back: the rows of :func:`read_records`, one a page.

    A null or empty payload is 0 bytes; rows that repeat in id and payload are all responses; a null id is
    the smallest; a null url is an empty one; an empty table has no rows; other columns are not read.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    return read_records(normalise(write_archives(pages, folder, id_col, url_col, payload_col, least), folder))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, 5 * g::INTEGER + 1, 5))::BIGINT >> s) & 31)::INTEGER, 1)), 'string_agg', '')),
    'string_agg', '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM h
"""
