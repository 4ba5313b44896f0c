"""The year filter's grammar: driver strings for search services and a predicate on Year."""

from __future__ import annotations

import re
import warnings
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_year(query: str) -> tuple[str, int, int | None]:
    """("range", a, b), (">", y, None) and so on, or ("=", y, None)."""
    text = re.sub(r"\s+|^\(|\)$", "", query)
    if m := re.fullmatch(r"(\d{4})-(\d{4})", text):
        a, b = int(m[1]), int(m[2])
        if a > b:
            warnings.warn(f"the year range {text} is reversed", stacklevel=3)
        return "range", a, b
    if m := re.fullmatch(r"(<=|>=|<|>)(\d{4})", text):
        return m[1], int(m[2]), None
    if m := re.fullmatch(r"\d{4}", text):
        return "=", int(m[0]), None
    raise ValueError(f"not a year filter: {query}")


def year_limits(query: str, least: int, most: str) -> tuple[str, str]:
    """First and last year as text, with a service's own open ends."""
    kind, a, b = parse_year(query)
    return {"range": (str(a), str(b)), ">": (str(a + 1), most), ">=": (str(a), most), "<": (str(least), str(a - 1)), "<=": (str(least), str(a)), "=": (str(a), str(a))}[kind]


def clean_year_filter(query: str | None, service: str, present_in: str | None = None) -> str:
    """A service's filter text; empty without one, or with a warning where the query has its own."""
    if not query:
        return ""
    own = {"pubmed": r"\[(PDAT|DP)\]", "wos": r"\bPY ?=", "ieee": r"ranges=", "ieee_api": r"start_year"}[service]
    if present_in and re.search(own, present_in, re.I):
        warnings.warn("the query has a year filter already; the other one is left out", stacklevel=2)
        return ""
    if service == "pubmed":
        now = datetime.now(UTC).year
        a, b = year_limits(query, 1000, str(now))
        return f"{a}[PDAT]:{b}[PDAT]"
    if service == "wos":
        a, b = year_limits(query, 1985, str(datetime.now(UTC).year))
        return f"PY = {a}-{b}"
    if service == "ieee":
        a, b = year_limits(query, 1800, str(datetime.now(UTC).year))
        return f"{a}_{b}"
    return "_".join("x" if v == "x" else v for v in (("x", year_limits(query, 0, "x")[1]) if parse_year(query)[0] in ("<", "<=") else year_limits(query, 0, "x")))


def year_predicate(query: str, year: Column) -> Column:
    """The filter as a condition on a year column; it is pushed down like any other."""
    kind, a, b = parse_year(query)
    return {"range": lambda: year.between(a, b), ">": lambda: year > a, ">=": lambda: year >= a, "<": lambda: year < a, "<=": lambda: year <= a, "=": lambda: year == F.lit(a)}[kind]()
