"""Column functions for splines, design blocks, softmax and diagnostics."""

from __future__ import annotations

from math import comb, factorial

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 2.2250738585072014e-308


def number(column: str) -> Column:
    """A column as a double; unreadable text and NaN are null."""
    value = F.col(f"`{column}`").try_cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def not_finite(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) == float("inf"))


def power(x: Column, n: int) -> Column:
    out = x
    for _ in range(n - 1):
        out = out * x
    return out


def spline_basis(x: Column, lo: float, hi: float, n_knots: int, degree: int) -> list[Column]:
    """The B-spline basis over uniform knots on [lo, hi] without its last function; x is clamped to the range.

    The cardinal B-spline in truncated powers, so each function is a flat expression of x.
    """
    h = (hi - lo) / (n_knots - 1)
    at = (F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))) - float(lo)) / h
    out = []
    for j in range(n_knots + degree - 2):
        total = None
        for k in range(degree + 2):
            term = F.lit((-1.0) ** k * comb(degree + 1, k) / factorial(degree)) * power(F.greatest(at + float(degree - j - k), F.lit(0.0)), degree)
            total = term if total is None else total + term
        out.append(total)
    return out


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def dot(values: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def ranking(values: Column) -> Column:
    """Indices by falling value; equal values by rising index."""
    return F.transform(F.array_sort(F.transform(values, lambda v, i: F.struct((-v).alias("n"), i.alias("i")))), lambda s: s["i"])


def entropy(probabilities: Column) -> Column:
    terms = F.transform(probabilities, lambda p: -p * F.ln(F.greatest(p, F.lit(TINY))))
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def tensor(a: list[Column], b: list[Column], scale: float = 1.0) -> list[Column]:
    """Row-wise products of two blocks, the second index fastest."""
    return [x * y * F.lit(float(scale)) for x in a for y in b]
