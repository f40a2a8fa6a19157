"""Rounding and order-independent sums, all inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_to(value: Column, digits: int) -> Column:
    """Half-even rounding on the scaled double.

    ``round`` on a double goes through BigDecimal for every row; ``rint`` is one
    machine instruction and treats exact ties the way the published figures do.
    """
    scale = float(10 ** digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def scaled(value: Column, digits: int) -> Column:
    """Money or ratio as a whole number of 10^-digits units."""
    return F.rint(value * F.lit(float(10 ** digits))).cast("bigint")


def exact_sum(value: Column, digits: int = 4) -> Column:
    """Sum that does not depend on row order, so retries give the same bits."""
    return F.sum(scaled(value, digits)) / F.lit(float(10 ** digits))


def safe_divide(numerator: Column, denominator: Column, otherwise: float | None = None) -> Column:
    fallback = F.lit(otherwise).cast("double")
    return F.when(denominator != 0, numerator / denominator).otherwise(fallback)


def draw(key: Column, salt: int) -> Column:
    """Reproducible pseudo-uniform number in [0, 1) for a key."""
    k = key.cast("bigint") % F.lit(100003)
    mixed = (k * k * F.lit(salt) + k * F.lit(7919) + F.lit(salt)) % F.lit(100003)
    return (mixed % F.lit(1000)) / F.lit(1000.0)
