"""Significant digits, percents and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signif(x: Column, digits: int) -> Column:
    """x to that many significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def plain(x: Column, places: int = 6) -> Column:
    """A number as text without trailing zeros."""
    text = F.when(x.isNotNull(), F.format_string(f"%.{places}f", x.cast("double")))
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def percent(x: Column) -> Column:
    """A share as percent: two significant digits below one percent, else three; null stays."""
    hundred = x * 100
    return F.concat(plain(F.when(F.abs(hundred) < 1, signif(hundred, 2)).otherwise(signif(hundred, 3))), F.lit("%"))


def interval(values: Column, as_percent: bool = False) -> Column:
    """Three values as "middle [low, high]", sorted first."""
    v = F.array_sort(values)
    show = percent if as_percent else (lambda x: plain(signif(x, 3)))
    return F.concat(show(F.get(v, 1)), F.lit(" ["), show(F.get(v, 0)), F.lit(", "), show(F.get(v, 2)), F.lit("]"))


def today() -> Column:
    return F.current_date()


def now() -> Column:
    return F.current_timestamp()


def path_safe(time: Column) -> Column:
    """A timestamp as text that paths can hold."""
    return F.date_format(time, "yyyy-MM-dd'T'HH.mm.ss")
