"""Vector expressions over array columns: JVM-side, in double precision."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from halyard.config import TINY


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products over the shorter length; zip_with alone would pad with null."""
    a, b = doubles(a), doubles(b)
    n = F.least(F.size(a), F.size(b))
    return total(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y))


def dot_same(a: Column | str, b: Column | str) -> Column:
    """dot() of vectors that are known to have one length."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row; named plainly, it would be computed for each element of a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def l2_normalize(v: Column | str) -> Column:
    """v at length one; a vector shorter than TINY stays as it is."""
    return once(doubles(v), lambda d: once(norm(d), lambda n: F.when(n < TINY, d).otherwise(F.transform(d, lambda x: x / n))))


def cosine(a: Column | str, b: Column | str, epsilon: float = TINY) -> Column:
    """Dot product over both lengths, each with epsilon added."""
    return dot(a, b) / ((norm(a) + epsilon) * (norm(b) + epsilon))


def cosine_or_zero(a: Column | str, b: Column | str) -> Column:
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def is_valid(v: Column | str) -> Column:
    """Not empty, all finite, and not all tiny; null is invalid."""
    d = doubles(v)
    infinite = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(d) > 0) & ~F.exists(d, infinite) & ~F.forall(d, lambda x: F.abs(x) < TINY), F.lit(False))


def max_abs(v: Column | str) -> Column:
    return F.array_max(F.transform(doubles(v), F.abs))


def quantize_scale(v: Column | str) -> Column:
    """Symmetric int8: the largest magnitude is 127; a zero vector has scale 1."""
    m = max_abs(v)
    return F.when(m == 0, 1.0).otherwise(m / 127)


def quantize(v: Column | str, scale: Column) -> Column:
    return once(scale, lambda s: F.transform(doubles(v), lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.bround(x / s).cast("int"))).cast("tinyint")))


def dequantize(q: Column | str, scale: Column) -> Column:
    return once(scale, lambda s: F.transform(F.col(q) if isinstance(q, str) else q, lambda x: x.cast("double") * s))


def mean_vector(vectors: list[Column]) -> Column:
    """Element-wise average of vectors of one length."""
    out = vectors[0]
    for v in vectors[1:]:
        out = F.zip_with(out, v, lambda x, y: x + y)
    return F.transform(out, lambda x: x / len(vectors))


def flat(nested: Column | str) -> Column:
    """One level of nesting taken away; null arrays and elements are skipped."""
    c = F.col(nested) if isinstance(nested, str) else nested
    return F.filter(F.flatten(F.filter(c, lambda x: x.isNotNull())), lambda x: x.isNotNull())


def split_rows(v: Column | str, n: Column | int) -> Column:
    """A flat batch output cut into n equal rows."""
    c, n = (F.col(v) if isinstance(v, str) else v), (F.lit(n) if isinstance(n, int) else n)
    size = F.floor(F.size(c) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.slice(c, i * size + 1, size))


def adjacent_pairs(v: Column | str) -> Column:
    """Neighbouring elements as (l, r), each pair once, in order of first occurrence."""
    c = F.col(v) if isinstance(v, str) else v
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda x, y: F.struct(x.alias("l"), y.alias("r"))))


def to_half(v: Column | str) -> Column:
    """A vector as little-endian 16-bit floats."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda e: None if e is None else np.asarray(e, "<f2").tobytes())

    return run(v)


def from_half(b: Column | str) -> Column:
    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda e: None if e is None else np.frombuffer(e, "<f2").astype("<f4"))

    return run(b)
