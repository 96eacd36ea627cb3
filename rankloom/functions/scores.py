"""Grades, click-through rates and small scoring expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from rankloom import lookups as L


def ladder(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """First label whose lower bound the value reaches."""
    out = F.when(value >= steps[0][0], steps[0][1])
    for bound, label in steps[1:]:
        out = out.when(value >= bound, label)
    return out.otherwise(last)


def letter_grade(score: Column) -> Column:
    return ladder(score, [(85, "A"), (70, "B"), (55, "C"), (40, "D")], "F")


def site_grade(score: Column) -> Column:
    return ladder(score, [(90, "A+"), (80, "A"), (70, "B")], "Needs Fix")


def form_grade(score: Column) -> Column:
    return ladder(score, [(90, "A"), (75, "B"), (55, "C"), (35, "D")], "F")


def difficulty_label(score: Column) -> Column:
    return F.when(score <= 25, "Low").when(score <= 50, "Medium").when(score <= 75, "High").otherwise("Very High")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Rounded percentage; an empty whole counts as one."""
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), digits)


def _ctr_map(index: int) -> Column:
    return F.create_map(*[F.lit(x) for row in L.CTR_CURVE for x in (row[0], row[index])])


def ctr_tier(position: Column) -> Column:
    """Tier of a position; ``below`` off the curve."""
    return F.coalesce(F.try_element_at(_ctr_map(2), position), F.lit("below"))


def expected_ctr(position: Column, intent: Column) -> Column:
    """Expected click-through rate of a position for an intent."""
    base = F.coalesce(F.try_element_at(_ctr_map(1), position) / 100.0, F.lit(L.CTR_BEYOND))
    factors = F.create_map(*[F.lit(x) for pair in L.INTENT_FACTOR.items() for x in pair])
    return F.round(base * F.coalesce(F.try_element_at(factors, intent), F.lit(1.0)), 4)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, also where nested functions refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(labels: Column) -> Column:
    """Drop the nulls of an array of conditional labels."""
    return F.filter(labels, lambda x: x.isNotNull())


def labels(*conditional: Column) -> Column:
    """Array of the labels whose condition holds."""
    return present(F.array(*conditional))
