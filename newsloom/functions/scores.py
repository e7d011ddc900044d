"""Arithmetic of scores and trends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


WHOLE = 2.0**52  # from here on a double has no fraction that could lie on either side of a half
SPLIT = 2.0**27 + 1  # cuts a double into two halves whose products are exact


def rounded(x: Column, digits: int) -> Column:
    """x to that many decimals (0 to 22) by the exact value of the double, halves to the even neighbour.

    Spark's round works on the shortest decimal text, so 2.675, which is a little less than its text says, goes up
    there and down here. The product with the power of ten is taken as a double and its exact error; the product
    decides unless it is a half, and then the error's sign does. From 2^52 units on, Spark's round is taken, as for
    NaN and infinities; null stays null.
    """
    scale = 10.0**digits
    product = x * F.lit(scale)
    high, low = _halves(x)
    scale_high = scale * SPLIT - (scale * SPLIT - scale)
    scale_low = scale - scale_high
    error = ((high * F.lit(scale_high) - product) + high * F.lit(scale_low) + low * F.lit(scale_high)) + low * F.lit(scale_low)
    near = F.rint(product)
    rest = product - near  # exact, at most a half
    step = F.when((rest == 0.5) & (error > 0), 1.0).when((rest == -0.5) & (error < 0), -1.0).otherwise(0.0)
    return F.when(F.abs(product) < WHOLE, (near + step) / F.lit(scale)).otherwise(F.round(x, digits))


def rounded_product(x: Column, digits: int) -> Column:
    """x to that many decimals as SQL rounds doubles: the product with the power of ten, as a double, halves away from zero."""
    product = x * F.lit(10.0**digits)
    near = F.rint(product)
    step = F.when(product - near == 0.5, 1.0).when(product - near == -0.5, -1.0).otherwise(0.0)  # exact; rint takes halves to even
    away = near + F.when(F.signum(product) == step, step).otherwise(0.0)
    return F.when(F.abs(product) < WHOLE, away / F.lit(10.0**digits)).otherwise(x)


def _halves(x: Column) -> tuple[Column, Column]:
    big = x * F.lit(SPLIT)
    high = big - (big - x)
    return high, x - high


def missed(weights: Column) -> Column:
    """Product of 1 - w: what a noisy-or leaves."""
    return F.aggregate(weights, F.lit(1.0), lambda a, w: a * (F.lit(1.0) - w))


def trend_label(recent: Column, older: Column) -> Column:
    """Fixed labels by the ratio of two rates."""
    ratio = recent / F.nullif(older, F.lit(0.0))
    return (
        F.when((older == 0) & (recent > 0), "新規")
        .when(older == 0, "—")
        .when(ratio >= 1.3, "↑ 増加")
        .when(ratio <= 0.77, "↓ 減少")
        .otherwise("→ 横ばい")
    )


def keyword_weight(observed: Column, top: Column, is_english: Column) -> Column:
    """0.4 to 1 by the logarithm of the observed weight; what wasn't observed has 0.7 or 0.4."""
    seen = rounded(F.lit(0.4) + F.lit(0.6) * F.log1p(observed) / F.log1p(top), 3)
    return F.when(observed > 0, seen).when(is_english, 0.7).otherwise(0.4)


def bar(x: Column, width: int) -> Column:
    n = F.round(x * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))
