"""Repeat suppression: an event is kept when the last KEPT event of its signature is a window or more ago."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from prepkit.functions.sizing import bucket_count, lookup_side
from prepkit.operators.ordering import RANGE, as_number, with_range


def _chain(ts: np.ndarray, start: int, window: int) -> list[int]:
    """Positions kept from ``start`` on; ts ascending."""
    kept, i = [], start
    while i < len(ts):
        kept.append(i)
        i = int(np.searchsorted(ts, ts[i] + window, side="left"))
    return kept


def _entry_table(ts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """What a time piece does to the state: (entry time up to which, last kept time on leaving).

    Entering with "nothing may be kept before time e" keeps the first event at or after e and goes
    on from there. Neighbouring entries that leave with the same time are one step.
    """
    nxt = np.searchsorted(ts, ts + window, side="left")
    leave = np.empty(len(ts), dtype="int64")
    for i in range(len(ts) - 1, -1, -1):
        leave[i] = ts[i] if nxt[i] >= len(ts) else leave[nxt[i]]
    reach = int(np.searchsorted(ts, ts[0] + window, side="left")) + 1  # later entries start a window on
    last = np.flatnonzero(np.append(leave[1:reach] != leave[: reach - 1][: len(leave[1:reach])], True))
    steps = [(int(ts[min(i, len(ts) - 1)]), int(leave[min(i, len(ts) - 1)])) for i in last]
    return steps


HOT_ROWS = 1_000_000


def suppress_repeats(df: DataFrame, signature: Sequence[str], ts: str, window_seconds: int = 300,
                     parts: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Batch form: keeps (signature, ts) rows; of equal timestamps one row is kept, events without a time go.

    Ordinary signatures are sorted inside their partition and folded batch by batch with one value of
    state, so no group is ever held. In a large table the signatures with more than ``hot_rows`` rows
    are taken out and folded range by range over many tasks instead.
    """
    keys, window = list(signature), window_seconds * 1_000_000
    base = df.select(*keys, F.col(ts), as_number(df, ts).cast("bigint").alias("_t")).filter("_t IS NOT NULL")
    n = bucket_count(df) if parts is None else parts
    if n == 1:
        return _fold_sorted(base, keys, ts, window)
    hot = base.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select(*keys)
    hot = lookup_side(hot)  # at most rows / hot_rows signatures
    cold = _fold_sorted(base.join(hot, keys, "left_anti"), keys, ts, window)
    return cold.unionByName(_fold_ranges(base.join(hot, keys, "left_semi"), keys, ts, window, n))


def _fold_sorted(base: DataFrame, keys: list[str], ts: str, window: int) -> DataFrame:
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, free = None, 0
        for pdf in batches:
            keep = []
            for key, t in zip(pdf["_k"].tolist(), pdf["_t"].tolist(), strict=True):  # a comparison a row: most signatures have few
                kept = t >= free or key != last_key
                keep.append(kept)
                if kept:
                    last_key, free = key, t + window
            yield pdf.loc[np.array(keep, bool), [*keys, ts]]

    fields = ", ".join(f"`{k}` {t}" for k, t in base.select(*keys, ts).dtypes)
    ordered = (base.withColumn("_k", F.to_json(F.struct(*keys))).repartition(*keys).sortWithinPartitions("_k", "_t"))
    return ordered.mapInPandas(fold, fields)


def _fold_ranges(base: DataFrame, keys: list[str], ts: str, window: int, parts: int) -> DataFrame:
    """Each time range says how it maps the entry state to the exit state, the short list of ranges is
    folded per signature, and every range then walks its own chain from the state it is entered with.
    Times are deduplicated first, inside map tasks.
    """
    times = base.groupBy(*keys, "_t").agg(F.min(ts).alias(ts))
    ranged, _ = with_range(times, ts, parts)
    fields = ", ".join(f"`{k}` {t}" for k, t in times.select(*keys).dtypes)
    names = [*keys, RANGE]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t")
        t = pdf["_t"].to_numpy()
        start = int(np.searchsorted(t, pdf["_entry"].iloc[0], side="left"))
        return pdf.iloc[_chain(t, start, window)][[*keys, "_t"]]

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_entry_table(np.sort(pdf["_t"].to_numpy()), window), columns=["upto", "leave"])
        for k in names:
            out[k] = pdf[k].iloc[0]
        return out[[*names, "upto", "leave"]]

    def chain_ranges(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, entry = [], -(1 << 62)
        for r, piece in pdf.sort_values([RANGE, "upto"]).groupby(RANGE, sort=True):
            rows.append((r, entry))
            ahead = piece[piece["upto"] >= entry]
            if len(ahead):
                entry = int(ahead["leave"].iloc[0]) + window
        out = pd.DataFrame(rows, columns=[RANGE, "_entry"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, RANGE, "_entry"]]

    tables = ranged.groupBy(*names).applyInPandas(summarise, f"{fields}, {RANGE} int, upto bigint, leave bigint")
    entries = tables.groupBy(*keys).applyInPandas(chain_ranges, f"{fields}, {RANGE} int, _entry bigint")
    kept = (ranged.join(entries, names).select(*keys, RANGE, "_t", "_entry").groupBy(*names)
            .applyInPandas(walk, f"{fields}, _t bigint"))
    return kept.join(times, [*keys, "_t"]).select(*keys, ts)


#: Times of a signature keep their microseconds as text.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class _Suppressor(StatefulProcessor):
    """Per group of signatures the time of the last alert sent of each, until the watermark has passed its window.

    Signatures whose windows are over leave with the next alert of their group, or with the timer of its last window.
    """

    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "sig string, t bigint")

    def _end(self, last: int) -> int:
        return -(-(last + self.micros) // 1000)  # timers are in milliseconds

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat([b[["sig", "t"]] for b in rows]).sort_values("t")
        last = dict(self.last.get())
        timer = self._end(max(last.values())) if last else None
        keep = []
        for sig, t in zip(events["sig"].tolist(), events["t"].tolist(), strict=True):
            kept = sig not in last or t >= last[sig] + self.micros
            keep.append(kept)
            if kept:
                last[sig] = t
        if any(keep):
            live = [(sig, t) for sig, t in last.items() if self._end(t) > timerValues.getCurrentWatermarkInMs()]
            if timer is not None:
                self.handle.deleteTimer(timer)
            if live:
                self.last.put(live)
                self.handle.registerTimer(self._end(max(t for _, t in live)))
            else:
                self.last.clear()
            yield events[np.array(keep)]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def suppress_stream(stream: DataFrame, signature: Sequence[str], ts: str, window_seconds: int = 300, late: str | None = "10 minutes",
                    groups: int | None = None) -> DataFrame:
    """Live form: the state is the time of the last alert sent per signature, and ends with its window.

    An event may come ``late`` behind the newest one seen (None: the stream has a watermark on ``ts``); beyond
    that it is dropped, for the state that would judge it may be gone. Within it, an event older than the end of
    its signature's window is a repeat. Once the watermark has passed a window's end, a timer clears the
    signature: whatever is still let in is newer. State so covers the signatures of window + late, however many
    the stream has had. Needs the RocksDB state store, which ``configure`` sets.

    A call of the operator costs some milliseconds. ``groups`` (fixed for a checkpoint) lets signatures share so many states
    by their hash, so that a batch costs a call a group, whatever its signatures; None keeps a state a signature. The alerts
    are the same. A group holds its own events of one batch.
    """
    keys = [F.col(k) for k in signature]
    timed = stream.select(F.to_json(F.struct(*keys), _EXACT).alias("sig"), (F.col(ts).cast("timestamp") if late else F.col(ts)).alias("at"))
    timed = timed.withWatermark("at", late) if late else timed
    base = timed.withColumn("t", F.unix_micros("at")).filter("t IS NOT NULL")  # names that a tuple can have, and one key that is never null
    base = base.withColumn("part", F.col("sig") if groups is None else F.pmod(F.xxhash64("sig"), F.lit(groups)))
    sent = base.groupBy("part").transformWithStateInPandas(
        _Suppressor(window_seconds * 1_000_000), "sig string, t bigint", "append", "eventTime")
    schema = stream.select(*signature).schema
    return sent.select(F.from_json("sig", schema, _EXACT).alias("k"), F.timestamp_micros("t").alias(ts)).select("k.*", ts)
