"""Ratios, points and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(x: Column | str, y: Column | str, digits: int = 2, factor: int = 1) -> Column:
    """factor * x / y of integers that are not negative, rounded half up to digits; NULL where y is 0.

    Whole-number arithmetic, so ties round alike everywhere.
    """
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    scale = 10**digits
    top, below = (x * (2 * factor * scale) + y).cast("long"), F.nullif(y * 2, F.lit(0)).cast("long")
    return ((top - top % below) / below).cast("double") / scale


def sql_ratio(x: str, y: str, digits: int = 2, factor: int = 1) -> str:
    scale = 10**digits
    return f"CASE WHEN ({y}) <> 0 THEN ((({x}) * {2 * factor * scale} + ({y})) // (2 * ({y})))::DOUBLE / {scale} END"


def points_difficulty(correct: Column, time_ms: Column, difficulty: Column) -> Column:
    """Base by difficulty plus up to 50 for speed within 30 seconds; 0 if wrong."""
    base = F.when(difficulty == "easy", 50).when(difficulty == "hard", 150).otherwise(100)
    left = F.greatest(F.lit(0), F.lit(30000) - time_ms)
    return F.when(correct, base + F.floor(left * 50 / 30000)).otherwise(0).cast("long")


def points_time(correct: Column, time_ms: Column) -> Column:
    """100 less two for each second, 10 at least; 0 if wrong."""
    return F.when(correct, F.greatest(F.lit(10), F.lit(100) - F.floor(time_ms * 2 / 1000))).otherwise(0).cast("long")


def answer_matches(given: Column, wanted: Column) -> Column:
    return F.lower(F.trim(given)) == F.lower(F.trim(wanted))


def evidence_score(answer: Column, cells: Column) -> Column:
    """95 if the answer occurs in a result cell, else 75."""
    return F.when(F.exists(cells, lambda c: F.lower(c).contains(F.lower(answer))), 95).otherwise(75)


def question_valid(correct: Column, alternatives: Column) -> Column:
    """Three alternatives, and all four answers different."""
    return (F.size(alternatives) == 3) & (F.size(F.array_distinct(F.concat(F.array(correct), alternatives))) == 4)


def in_domain(value: Column, allowed: list[str], otherwise: str) -> Column:
    return F.when(value.isin(allowed), value).otherwise(otherwise)
