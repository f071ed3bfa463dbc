"""Vectors as arrays, in native expressions with sums in order, in doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    """Components as doubles; what is not finite counts as 0."""
    def one(x: Column) -> Column:
        d = x.cast("double")
        return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), 0.0).otherwise(d)

    return F.transform(v, one)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def unit(v: Column) -> Column:
    """Length one; zero vectors stay. The length is held beside the vector, else it would be made anew for every component."""
    def scaled(p: Column) -> Column:
        return F.transform(p["v"], lambda x: F.when(p["n"] > 0, x / p["n"]).otherwise(x))

    held = F.transform(F.array(doubles(v)), lambda d: F.named_struct(F.lit("v"), d, F.lit("n"), norm(d)))
    return F.element_at(F.transform(held, scaled), 1)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))))


def unit_l2(a: Column, b: Column) -> Column:
    """Distance of unit vectors by their dot product."""
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - F.lit(2.0) * dot(a, b)))


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])
