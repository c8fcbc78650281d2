"""Free-text time intervals as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: seconds that a clip may last.
LONGEST = 900
#: Fixed value: hours, minutes and seconds with their units.
_UNITS = r"^([0-9]+h)?\s*([0-9]+m)?\s*([0-9]+s)?"


def _int(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.regexp_replace(text, r"\s", "").try_cast("bigint"))


def _sum(*parts: tuple[Column, int]) -> Column:
    """Parts times factors; null if one is null or the result is no bigint."""
    out = None
    for part, factor in parts:
        x = F.try_multiply(part, F.lit(factor).cast("bigint"))
        out = x if out is None else F.try_add(out, x)
    return out


def seconds(text: Column) -> Column:
    """``90``, ``1h2m3s`` with any part left out, ``m:s`` or ``h:m:s`` as seconds; null for anything else.

    What follows units is ignored, parts of colon forms have no range, only ASCII digits count.
    """
    t = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    unit = [F.regexp_extract(t, _UNITS, i) for i in (1, 2, 3)]
    value = [F.when(u == "", F.lit(0).cast("bigint")).otherwise(_int(F.regexp_replace(u, "[hms]$", ""))) for u in unit]
    part = F.split(t, ":", -1)
    at = lambda i: _int(F.get(part, F.lit(i)))
    return (
        F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint"))
        .when((unit[0] != "") | (unit[1] != "") | (unit[2] != ""), _sum((value[0], 3600), (value[1], 60), (value[2], 1)))
        .when(F.size(part) == 2, _sum((at(0), 60), (at(1), 1)))
        .when(F.size(part) == 3, _sum((at(0), 3600), (at(1), 60), (at(2), 1)))
    )


def bounds(text: Column) -> tuple[Column, Column]:
    """Start and end: what stands before and after the first hyphen."""
    sides = F.split(text, "-", 2)
    return seconds(F.get(sides, F.lit(0))), seconds(F.get(sides, F.lit(1)))


def status(start: Column, end: Column) -> Column:
    """``bad_interval``, ``not_after`` (start is not before end) or ``ok``."""
    return F.when(start.isNull() | end.isNull(), "bad_interval").when(start >= end, "not_after").otherwise("ok")


def parsed(df: DataFrame, text: str = "interval_text") -> DataFrame:
    """``df`` with start_sec and end_sec. They come from a generator, so that filters on them don't repeat the parsing."""
    start, end = bounds(F.col(text))
    return df.select("*", F.inline(F.array(F.struct(start.alias("start_sec"), end.alias("end_sec")))))
