"""Rounding with Python's rules, ratios and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import col, let

_HALF_SCALE = float(2**40)


def python_round(c: Column | str, digits: int) -> Column:
    """``round(x, digits)`` as Python does it, for digits <= 4.

    Python rounds the exact binary value, ties to even; Spark rounds the printed
    decimal. Sign and whole part are set aside, and the fraction is taken apart into an
    integer count of 2**-80 steps, which decimal arithmetic rounds. What a smaller fraction
    has beyond that lies far from any tie. From 2**52 on, doubles are whole numbers.
    """
    if not 0 <= digits <= 4:
        raise ValueError("digits must be between 0 and 4")
    step = F.lit(str(2**40)).cast("decimal(13,0)")
    unit = F.lit(str(2**80)).cast("decimal(25,0)")
    scale = F.lit(str(10**digits)).cast("decimal(5,0)")
    back = F.lit(f"{10**-digits:.{digits}f}").cast(f"decimal({digits + 1},{digits})")

    def steps(fraction: Column) -> Column:
        """Count of 2**-80 steps times 10**digits."""
        high = F.floor(fraction * _HALF_SCALE)
        low = F.floor((fraction * _HALF_SCALE - high.cast("double")) * _HALF_SCALE)
        both = high.cast("decimal(13,0)") * step + low.cast("decimal(13,0)")
        return (both.cast("decimal(25,0)") * scale).cast("decimal(30,0)")

    def rounded(scaled: Column, whole: Column) -> Column:
        def up(rest: Column) -> Column:
            part = F.floor((scaled - rest).cast("decimal(38,0)") / unit).cast("bigint")
            twice = (rest * F.lit("2").cast("decimal(1,0)")).cast("decimal(27,0)")
            odd = (part + whole if digits == 0 else part) % 2
            return part + F.when(twice > unit, 1).when(twice < unit, 0).otherwise(odd)

        part = let((scaled % unit).cast("decimal(25,0)"), up)
        total = (whole.cast("decimal(16,0)") * scale).cast("decimal(21,0)") + part.cast("decimal(6,0)")
        return (total.cast("decimal(22,0)") * back).cast("double")

    def signed(x: Column) -> Column:
        size = F.abs(x)

        def exact(whole: Column) -> Column:
            return let(steps(size - whole.cast("double")), lambda scaled: rounded(scaled, whole))

        value = let(F.floor(F.when(size < float(2**52), size)), exact)
        return F.when(size < float(2**52), F.when(x < 0, -value).otherwise(value)).otherwise(x)

    return let(col(c).cast("double"), signed)


def fixed2(c: Column | str) -> Column:
    """Two-decimal text, as Python's ``f"{x:.2f}"``."""
    return F.format_string("%.2f", python_round(c, 2))


def ratio(num: Column, den: Column) -> Column:
    """Double quotient; 0.0 for a zero denominator."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def percent(num: Column, den: Column) -> Column:
    """Percentage with two decimals; 0.0 when the total is 0."""
    return python_round(ratio(num, den) * 100.0, 2)


def prevalence(pos: Column, neg: Column) -> Column:
    """Whole percent of positives, ties to even; NULL without rows."""
    total = pos + neg
    return F.when(total > 0, F.bround(100.0 * pos / total)).cast("int")


def pair_softmax(negative: Column | str, positive: Column | str) -> Column:
    """P(positive) from two logits."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(col(negative) - col(positive)))
