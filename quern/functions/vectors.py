"""Vectors as Column expressions. Dense: array<double>. Sparse: struct<size, idx array<int>, val array<double>>.

Every operation takes either layout; an operation on two sparse vectors, or a sparse and a dense one, is dense.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def dense_zeros(n: int) -> Column:
    return F.array_repeat(F.lit(ZERO), n)


def dense_ones(n: int) -> Column:
    return F.array_repeat(F.lit(1.0), n)


def sparse(size: Column, idx: Column, val: Column) -> Column:
    return F.struct(size.alias("size"), idx.alias("idx"), val.alias("val"))


def to_dense(s: Column) -> Column:
    """Of a sparse vector: its values in their places."""
    m = F.map_from_arrays(s["idx"], s["val"])
    return F.transform(F.sequence(F.lit(0), s["size"] - 1), lambda i: F.coalesce(F.try_element_at(m, i.cast("int")), F.lit(ZERO)))


def to_sparse(v: Column) -> Column:
    at = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.get(v, i) != 0)
    return sparse(F.size(v), at, F.transform(at, lambda i: F.get(v, i)))


def length(v: Column) -> Column:
    return F.size(v)


def active_size(v: Column) -> Column:
    """How many elements are not zero."""
    return F.size(F.filter(v, lambda x: x != 0))


def get(v: Column, i) -> Column:
    return F.get(v, F.lit(i))


def put(v: Column, i: int, x) -> Column:
    return F.transform(v, lambda y, k: F.when(k == i, F.lit(x)).otherwise(y))


def cut(v: Column, start: int, end: int) -> Column:
    """Elements start (included) to end (not)."""
    return F.slice(v, start + 1, end - start)


def concat(*vs: Column) -> Column:
    return F.concat(*vs)


def add_scalar(v: Column, c) -> Column:
    return F.transform(v, lambda x: x + F.lit(c))


def sub_scalar(v: Column, c) -> Column:
    return F.transform(v, lambda x: x - F.lit(c))


def scale(v: Column, c) -> Column:
    return F.transform(v, lambda x: x * F.lit(c))


def div(v: Column, c) -> Column:
    return F.transform(v, lambda x: x / F.lit(c))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def axpy(a, x: Column, y: Column) -> Column:
    """y + a * x."""
    return F.zip_with(y, x, lambda p, q: p + F.lit(a) * q)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(ZERO), lambda s, t: s + t)


def entries(v: Column) -> Column:
    """A generator of (i, x)."""
    return F.posexplode(v).alias("i", "x")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_sum_exp(v: Column) -> Column:
    summed = lambda u, most: most + F.ln(F.aggregate(u, F.lit(ZERO), lambda s, x: s + F.exp(x - most)))
    return let(v, lambda u: let(F.array_max(u), lambda most: summed(u, most)))


def softmax(v: Column, eps: float = 1e-7) -> Column:
    """Clamped to [eps, 1 - eps]."""
    clamped = lambda u, lse: F.transform(u, lambda x: F.least(F.greatest(F.exp(x - lse), F.lit(eps)), F.lit(1 - eps)))
    return let(v, lambda u: let(log_sum_exp(u), lambda lse: clamped(u, lse)))


def argmax(v: Column) -> Column:
    """The place of the largest element, the first of equals."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 8, carried back."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + F.lit(0.9189385332046727) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    back = F.ln(x)
    for k in range(1, 8):
        back = back + F.ln(x + k)
    return series - back
