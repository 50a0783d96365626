"""Token counts of whole texts; huge texts by overlapping chunks that are joined again at stable boundaries.

A huge text is cut into chunks that overlap. Each chunk is encoded with offsets. A place in the overlap
where both encodings start a pre-token is a boundary of the whole text's encoding too: the pre-tokenizer
goes from left to right and keeps no state over a boundary, so from a common start both see the same
pre-tokens, and merges stay inside them. A boundary counts only if what follows it was seen far enough
by the left chunk, that is, if it isn't in the chunk's last pre-token. Where an overlap has no common
boundary (one pre-token is longer than it) the overlap is widened, up to the rest of the text.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from prepkit.llm.bpe import encoder
from prepkit.llm.common import arrow_map, texts_of


def _starts(library, chunk: str, at: int) -> tuple[list[int], list[int], int]:
    """Places where a pre-token starts (in the whole text), the token each starts with, and the tokens in all."""
    e = library.encode(chunk, add_special_tokens=False)
    places, tokens, last = [], [], None
    for k, (word, (begin, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
        if word != last:
            places.append(at + begin)
            tokens.append(k)
            last = word
    return places, tokens, len(e.ids)


def count_spliced(library, text: str, chunk: int, overlap: int) -> int:
    """Tokens of the text, from chunks of ``chunk`` characters that overlap by ``overlap`` or more.

    The text must not hold special tokens' strings: a chunk could cut one in two.
    """
    total, begin = 0, 0  # begin is a boundary of the whole text's encoding
    while True:
        end, wide = begin + chunk, overlap
        places, tokens, n = _starts(library, text[begin:end], begin)
        if end >= len(text):
            return total + n
        while True:
            right = max(begin + 1, end - wide)
            if right <= begin + 1 and wide > chunk:  # no boundary in the whole chunk: a larger chunk
                end, wide = min(len(text), begin + 2 * (end - begin)), overlap
                places, tokens, n = _starts(library, text[begin:end], begin)
                if end >= len(text):
                    return total + n
                continue
            theirs = set(_starts(library, text[right : end + wide], right)[0][1:])
            # not before the right chunk's second pre-token; not in the left chunk's last two
            common = [p for p in places[bisect_left(places, right) : -2] if p in theirs]
            if common:
                total += tokens[places.index(common[-1])]
                begin = common[-1]
                break
            wide *= 2


def token_counts(
    df: DataFrame, path: str, text_col: str = "text", limit: int = 1024,
    chunk: int = 32_768, overlap: int = 1_024, huge: int = 49_152,
) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of ``text_col``, which it replaces.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted each; other columns stay.
    Texts of more than ``huge`` characters are counted by chunks, others whole. Columns of df named like
    a result are replaced by it.
    """
    results = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]
    others = [f for f in df.schema.fields if f.name not in {text_col, *(r.name for r in results)}]
    schema = StructType([*others, *results])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, texts = encoder(path), texts_of(batch, text_col)
        long = [len(t) > huge and not any(s in t for s in enc.special) for t in texts]
        counts = [len(b) // 4 for b in enc.ids(["" if big else t for t, big in zip(texts, long, strict=True)])]
        for i, big in enumerate(long):
            if big:
                counts[i] = count_spliced(enc.library, texts[i], chunk, overlap)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(f.name) for f in others), batch.column("n_bytes"), pa.array(counts, pa.int64()),
             pa.array([n > limit for n in counts], pa.bool_())], names=[f.name for f in schema.fields])

    sized = df.select(*(F.col(f"`{f.name}`") for f in others), F.col(f"`{text_col}`"),
                      F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("n_bytes"))
    return arrow_map(sized, work, schema)
