"""Text rules as column expressions: spaces, missing marks, number text and date text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that mean "missing".
MISSING_TOKENS = ("", "na", "n/a", "none", "null", "nan", "-", "--")

# Space characters other than the ASCII ones.
UNICODE_SPACES = r"[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"

# Java's \s is ASCII only; (?U) makes it Unicode. A run is anything but one ordinary space; a letter is looked at once.
SPACE_RUN = r"(?U)\s(?:(?<! )\s*|\s+)"

# Date layouts tried in order: (shape of the text, pattern). The shape test is cheap and keeps the
# parser from being called on text it would reject.
_ISO_DAY = r"\d{4}-\d{1,2}-\d{1,2}"
_CLOCK = r"\d{1,2}:\d{2}:\d{2}"
ISO_LAYOUTS = (
    (rf"^{_ISO_DAY}$", "yyyy-M-d"),
    (rf"^{_ISO_DAY} {_CLOCK}$", "yyyy-M-d H:mm:ss"),
    (rf"^{_ISO_DAY} {_CLOCK}\.\d{{1,6}}$", "yyyy-M-d H:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (rf"^{_ISO_DAY} \d{{1,2}}:\d{{2}}$", "yyyy-M-d H:mm"),
    (rf"^{_ISO_DAY}T{_CLOCK}$", "yyyy-M-d'T'H:mm:ss"),
    (rf"^{_ISO_DAY}T{_CLOCK}\.\d{{1,6}}$", "yyyy-M-d'T'H:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (rf"^{_ISO_DAY}T{_CLOCK}(Z|[+-]\d{{2}}:\d{{2}})$", "yyyy-M-d'T'H:mm:ssXXX"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}$", "yyyy"),
    (r"^\d{4}-\d{2}$", "yyyy-MM"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
)
MONTH_FIRST = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}} {_CLOCK}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "M.d.yyyy"),
)
DAY_FIRST = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}} {_CLOCK}$", "d/M/yyyy H:mm:ss"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
)


_LONGEST_DATE = 40
_DATE_START = r"^(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{4}$|\d{8}$|\d{4}-\d{2}$|\d{1,2} [A-Za-z]{3} \d{4}$|[A-Za-z]{3} \d{1,2}, \d{4}$)"

# Number text holds nothing but these, a sign at its start or that of its exponent alone; other text fails at its first foreign
# letter. Text that a cast refuses costs an exception a row, so dates must fail here.
_NUMBER_SHAPE = r"^\(?[ '\u00A0]*+[-+]?[\d., '\u00A0]*+(?:[eE][ '\u00A0]*+[-+]?[\d., '\u00A0]*+)?\)?$|^(?i)[-+]?inf(inity)?$"


def layouts(dayfirst: bool = False) -> tuple[tuple[str, str], ...]:
    return ISO_LAYOUTS + (DAY_FIRST if dayfirst else MONTH_FIRST)


def layout_index(c: Column, tried: Sequence[tuple[str, str]]) -> Column:
    """Which layout the text has the shape of (shapes exclude each other), or NULL.

    Long text and text that does not start like a date is turned away before any shape is tried.
    """
    spot = F.lit(None).cast("int")
    for i in reversed(range(len(tried))):
        spot = F.when(c.rlike(tried[i][0]), F.lit(i)).otherwise(spot)
    return F.when((F.length(c) <= _LONGEST_DATE) & c.rlike(_DATE_START), spot)


def parse_by_index(c: Column, index: Column, tried: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("timestamp")
    for i in reversed(range(len(tried))):
        out = F.when(index == i, F.try_to_timestamp(c, F.lit(tried[i][1]))).otherwise(out)
    return out


def parse_layout(c: Column, layout: tuple[str, str]) -> Column:
    """Timestamp without zone, or NULL; one layout only."""
    shape, pattern = layout
    return F.when((F.length(c) <= _LONGEST_DATE) & c.rlike(shape),
                  F.try_to_timestamp(c, F.lit(pattern))).cast("timestamp_ntz")


def normalize_missing(c: Column, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """Exact, case-sensitive marks become NULL."""
    return F.when(~c.isin(*tokens), c)


def normalize_spaces(c: Column, strip_unicode: bool = True, normalize_whitespace: bool = True) -> Column:
    """Unify odd spaces, shrink runs of white space to one, trim."""
    if normalize_whitespace:
        # a lone ordinary space matches nothing, so ordinary text is scanned but not rebuilt
        return F.trim(F.regexp_replace(c, SPACE_RUN, " "))
    if strip_unicode:
        c = F.regexp_replace(c, UNICODE_SPACES, " ")
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def drop_tokens(c: Column, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """Missing marks in any case become NULL."""
    longest = max((len(t) for t in tokens), default=0)
    return F.when((F.length(c) > longest) | ~F.lower(c).isin(*[t.lower() for t in tokens]), c)


def number_text(c: Column, thousands: bool = True) -> Column:
    """'(1,234.5)' -> -1234.5, '1 234,56' -> 1234.56. With ``thousands`` a dot before exactly three
    digits is a separator, so '0.125' becomes 125."""
    bracketed = c.startswith("(") & c.endswith(")") & (F.length(c) > 1)
    c = F.when(bracketed, F.concat(F.lit("-"), F.substring(c, F.lit(2), F.length(c) - 2))).otherwise(c)
    c = F.translate(c, ", '\u00A0", ".")  # comma to dot, spaces and apostrophes dropped
    if not thousands:
        return c
    return F.when(c.contains("."), F.regexp_replace(c, r"(?<=\d)\.(?=\d{3}(\D|$))", "")).otherwise(c)


def parse_number(c: Column, thousands: bool = True) -> Column:
    """Double, or NULL where the text is not a number; NaN text is missing."""
    return F.when(c.rlike(_NUMBER_SHAPE), number_text(c, thousands).try_cast("double"))
