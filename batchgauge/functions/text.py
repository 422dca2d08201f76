"""Cell parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of a number and of a point in time.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NUMBER_WORD = r"(?i)^[+-]?(inf|infinity|nan)$"
DIGIT_SEPARATOR = r"(?<=[0-9])_(?=[0-9])"
TIME_POINT = (
    r"^([0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?"
    r"|[0-9]{4}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})$"
)
BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    """Remove blanks of any kind from both ends (``trim`` alone removes only spaces)."""
    return F.btrim(text, F.lit(BLANKS))


def parse_number(text: Column) -> Column:
    """DOUBLE of a stripped cell, NULL when it is no number. ``nan`` is NULL as well."""
    plain = F.regexp_replace(text, DIGIT_SEPARATOR, "")
    word = F.lower(F.regexp_replace(text, r"^\+", ""))
    return F.when(plain.rlike(NUMBER), plain.try_cast("double")).when(
        text.rlike(NUMBER_WORD) & ~word.endswith("nan"), word.try_cast("double")
    )


def is_number(text: Column) -> Column:
    """True for every cell that reads as a number, ``nan`` included."""
    return F.regexp_replace(text, DIGIT_SEPARATOR, "").rlike(NUMBER) | text.rlike(NUMBER_WORD)


# Further spellings that the lenient reading takes. Parts: year, month, day, hour, minute,
# second, fraction; numbers may lack their leading zero except in the spelling without separators.
_CLOCK = r"(?:[ T]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(\.[0-9]{1,6})?)?)?$"
YEAR_FIRST = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})" + _CLOCK
MONTH_FIRST = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})" + _CLOCK
COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:[ T]?([0-9]{2})([0-9]{2})(?:([0-9]{2})(\.[0-9]{1,6})?)?)?$"


def _from_parts(text: Column, pattern: str, year: int = 1, month: int = 2, day: int = 3) -> Column:
    def part(group: int, width: int = 2) -> Column:
        return F.lpad(F.regexp_extract(text, pattern, group), width, "0")

    date = F.concat_ws("-", part(year, 4), part(month), part(day))
    clock = F.concat(F.concat_ws(":", part(4), part(5), part(6)), F.regexp_extract(text, pattern, 7))
    return F.when(text.rlike(pattern), F.concat_ws(" ", date, clock).try_cast("timestamp_ntz"))


def parse_time(text: Column, lenient: bool = False) -> Column:
    """TIMESTAMP_NTZ of a stripped cell in one of the six accepted formats, else NULL.

    ``lenient`` takes further spellings: without seconds or leading zeros, slashes or dots between the parts
    of the date, the month first between slashes, no separators at all. Every row is read on its own.
    """
    dashed = F.regexp_replace(text, "/", "-")
    strict = F.when(text.rlike(TIME_POINT), dashed.try_cast("timestamp_ntz"))
    if not lenient:
        return strict
    return F.coalesce(
        strict, _from_parts(text, YEAR_FIRST), _from_parts(text, MONTH_FIRST, 3, 1, 2), _from_parts(text, COMPACT))
