"""Scalar expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Distinct lower-case words of a text, cut at spaces, tabs and line breaks."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[ \t\n]+"), lambda x: x != ""))


def term_overlap(query: Column, text: Column) -> Column:
    """Share of the query's terms that the text has."""
    q = terms(query)
    return F.size(F.array_intersect(q, terms(text))) / F.greatest(F.size(q), F.lit(1))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
