"""Text codecs of the ten data types, as Column expressions.

NULL is written as the word NULL. CHAR(n) is padded with blanks on the right, VARCHAR(n) is
trimmed, and text that is too long raises. Floating-point NaN means NULL. A TIME carries its UTC
offset and compares by the instant, so it is a struct of millis and offset with a sort key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = {"smallint": "smallint", "int": "int", "bigint": "bigint", "float": "float", "double": "double"}
#: Fixed format and ranges of a TIME; minutes and seconds of the offset may be left out.
TIME_PATTERN = r"^(\d{1,2}):(\d{2}):(\d{2})(?: \(UTC ([+-])(\d{1,2})(?::(\d{2}))?(?::(\d{2}))?\))?$"
LEAST_OFFSET, MOST_OFFSET = -43_200_000, 432_000_000


def _checked(value: Column, length: int, kind: str) -> Column:
    too_long = F.raise_error(F.concat(F.lit(f"too long for {kind}({length}): "), value))
    return F.when(F.length(value) > length, too_long.cast("string")).otherwise(value)


def _millis(text: Column, first: int) -> Column:
    h, m, s = (F.coalesce(F.regexp_extract(text, TIME_PATTERN, first + i).try_cast("int"), F.lit(0)) for i in range(3))
    return (h * 3600 + m * 60 + s) * 1000


def _at_most(text: Column, group: int, most: int) -> Column:
    return F.regexp_extract(text, TIME_PATTERN, group).try_cast("int") <= most


def parse_time(text: Column) -> Column:
    """`h:mm:ss` with an optional ` (UTC +h:mm:ss)`; malformed text, and what is out of range, raises."""
    sign = F.when(F.regexp_extract(text, TIME_PATTERN, 4) == "-", -1).otherwise(1)
    offset = F.coalesce(_millis(text, 5) * sign, F.lit(0))
    in_range = _at_most(text, 1, 23) & _at_most(text, 2, 59) & _at_most(text, 3, 59) & offset.between(LEAST_OFFSET, MOST_OFFSET)
    parsed = F.struct(_millis(text, 1).alias("millis"), offset.alias("offset"))
    bad = F.raise_error(F.concat(F.lit("not a TIME: "), text))
    # raise_error is typed void; the CASE takes the struct's type.
    return F.when(text.isNull(), None).when(text.rlike(TIME_PATTERN) & in_range, parsed).otherwise(bad)


def time_sort_key(time: Column) -> Column:
    """Instant of a TIME within a day, normalised by its offset: what comparisons use."""
    return time["millis"] - time["offset"]


def _hms(millis: Column) -> Column:
    s = F.floor(F.abs(millis) / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def parse(text: Column, kind: str) -> Column:
    """Text to a typed value; `kind` is e.g. `int`, `char(10)`, `date`, `time`."""
    kind = kind.strip().lower()
    text = F.when(F.trim(text) == "NULL", None).otherwise(text)
    if kind in NUMERIC:
        value = F.trim(text).cast(NUMERIC[kind])
        return F.nullif(value, F.lit(float("nan")).cast(kind)) if kind in ("float", "double") else value
    if m := re.fullmatch(r"(char|varchar)\((\d+)\)", kind):
        n = int(m[2])
        if m[1] == "char":
            return F.rpad(_checked(text, n, "CHAR"), n, " ")
        return _checked(F.trim(text), n, "VARCHAR")
    if kind == "date":
        return F.trim(text).cast("date")
    if kind == "timestamp":
        return F.trim(text).cast("timestamp_ntz")
    if kind == "time":
        return parse_time(F.trim(text))
    raise ValueError(f"unknown type {kind!r}")


def render(value: Column, kind: str) -> Column:
    """Typed value to text, the inverse of `parse`."""
    kind = kind.strip().lower()
    if kind == "time":
        sign = F.when(value["offset"] < 0, "-").otherwise("+")
        text = F.concat(_hms(value["millis"]), F.lit(" (UTC "), sign, _hms(value["offset"]), F.lit(")"))
        return F.when(value.isNotNull(), text)
    if kind == "timestamp":
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSS")
    return value.cast("string")


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
