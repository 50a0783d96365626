"""Hash orders: the same row gets the same place on any partitioning and in any engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits = 52 bits, which a double holds exactly.
_DIGITS = 13
_SPAN = float(16**_DIGITS)


def row_digest(cols: Sequence[str | Column], seed: int | str | None = None) -> Column:
    """md5 over the text of the columns; NULL has its own mark so ('a', NULL) != (NULL, 'a')."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\\N")) for c in cols]
    tail = [] if seed is None else [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *parts, *tail))


def digest_unit(digest: Column) -> Column:
    """The first 52 bits of an md5 text as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("bigint") / F.lit(_SPAN)


def hash_unit(cols: Sequence[str | Column], seed: int | str | None = None) -> Column:
    return digest_unit(row_digest(cols, seed))
