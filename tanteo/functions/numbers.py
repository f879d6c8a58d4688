"""Numeric columns: tolerant parsing, exact rounding, handball points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points of a win, a draw and a defeat.
WIN_POINTS, DRAW_POINTS, LOSS_POINTS = 3, 2, 1


def to_id(value: Column) -> Column:
    """Numeric id, null when the value is not a whole number; ``101.0`` is one, as text or as a double."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    return F.coalesce(text.try_cast("bigint"), F.when((F.abs(number) < 2.0**53) & (number % 1 == 0), number.cast("bigint")))


def to_number(value: Column, fallback: float = 0.0) -> Column:
    """Finite number or the fallback."""
    number = value.cast("string").try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(finite, number).otherwise(F.lit(fallback))


def to_int(value: Column) -> Column:
    return to_id(value).try_cast("int")


def ratio_1dp(numerator: Column, denominator: Column) -> Column:
    """Ratio of whole numbers with one decimal, rounded half up exactly; null over zero."""
    a, b = numerator.cast("bigint"), denominator.cast("bigint")
    doubled = F.when(b != 0, b * 2)
    above = a * 20 + b
    return ((above - F.pmod(above, doubled)) / doubled).cast("bigint") / F.lit(10.0)


def result_points(own: Column, opponent: Column) -> Column:
    return (
        F.when(own > opponent, WIN_POINTS).when(own == opponent, DRAW_POINTS).when(own < opponent, LOSS_POINTS)
    )


def result_letter(own: Column, opponent: Column) -> Column:
    return F.when(own > opponent, "W").when(own < opponent, "L").when(own == opponent, "D")


def goal_quotient(goals_for: Column, goals_against: Column) -> Column:
    """Goals for per goal against; infinite when nothing was conceded, zero when nothing happened."""
    unconceded = F.when(goals_for > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return F.when(goals_against == 0, unconceded).otherwise(goals_for / goals_against)
