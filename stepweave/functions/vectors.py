"""Integer vectors: correlation distance and mean, with the truncating integer division that clustering is defined by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(x: Column) -> Column:
    return x


def wrap32(x: Column) -> Column:
    """x as a wrapping 32-bit integer."""
    return (x + F.lit(2147483648)).bitwiseAND(F.lit(4294967295)) - F.lit(2147483648)


ARITH = {"int64": _plain, "int32": wrap32}


def _div(a: Column, b: Column) -> Column:
    """Integer quotient, truncated toward zero."""
    return F.call_function("div", a, b)


def total(vec: Column, term) -> Column:
    return F.aggregate(vec, F.lit(0).cast("long"), lambda s, x: s + term(x.cast("long")))


def _distance(sxy: Column, a: tuple[Column, Column], b: tuple[Column, Column], n: Column, w) -> Column:
    """From the sum of products and each vector's sum and variation."""
    num = w(sxy - _div(w(a[0] * b[0]), n))
    den = F.sqrt(w(a[1] * b[1]).cast("double"))
    return F.when(den == 0, F.lit(0.0)).otherwise(1 - num.cast("double") / den)


def moments(a: Column, arith: str = "int64") -> tuple[Column, Column]:
    """Sum and variation (the sum of squares less the square of the sum by the length) of an array of integers."""
    w = ARITH[arith]
    s = w(total(a, _plain))
    return s, w(w(total(a, lambda x: w(x * x))) - _div(w(s * s), F.size(a).cast("long")))


def pearson(a: Column, b: Column, arith: str = "int64") -> Column:
    """1 - correlation of two arrays of integers, 0 where either doesn't vary.

    Sums and quotients are integers; arith="int32" wraps them as 32-bit
    arithmetic does.
    """
    return pearson_given(a, b, moments(a, arith), moments(b, arith), arith)


def pearson_given(a: Column, b: Column, ma: tuple[Column, Column], mb: tuple[Column, Column], arith: str = "int64") -> Column:
    """pearson of two arrays whose moments are known."""
    w = ARITH[arith]
    sxy = w(F.aggregate(F.zip_with(a, b, lambda x, y: w(x.cast("long") * y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x))
    return _distance(sxy, ma, mb, F.size(a).cast("long"), w)


def pearson_of(x: list[Column], y: list[Column], a: tuple[Column, Column], b: tuple[Column, Column], arith: str = "int64") -> Column:
    """pearson of two vectors given as columns of longs, and their moments."""
    w = ARITH[arith]
    sxy = w(reduce(lambda s, t: s + t, [w(p * q) for p, q in zip(x, y, strict=True)]))
    return _distance(sxy, a, b, F.lit(len(x)).cast("long"), w)


def rounded(d: Column, digits: int) -> Column:
    """d rounded to so many decimals, halves away from zero, as SQL rounds a double: by a product and a quotient, which takes no decimal text as F.round does."""
    x = d * F.lit(10.0**digits)
    near = F.rint(x)  # halves go to the even
    away = F.when(x - near == 0.5, near + 1).when((near - x == 0.5) & (x < 0), near - 1).otherwise(near)
    return away / F.lit(10.0**digits)


def mean(a: Column, b: Column) -> Column:
    """Element-wise (a + b) / 2, truncated toward zero."""
    return F.zip_with(a, b, lambda x, y: _div(x.cast("long") + y.cast("long"), F.lit(2).cast("long")).cast("int"))
