"""Vectors as array<double> columns, sparse ones as maps from index to value."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

from larkspur.functions.text import _c


def dense(x: Column | str) -> Column:
    return _c(x).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null if either is zero or null."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(a: Column | str, b: Column | str) -> Column:
    """(cosine + 1) / 2; 0 where there is no cosine."""
    return F.coalesce(F.nanvl((cosine(a, b) + 1) / 2, F.lit(0.0)), F.lit(0.0))


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def scale(a: Column | str, k: float | Column) -> Column:
    return F.transform(_c(a), lambda x: x * k)


def sparse_add(a: Column | str, b: Column | str) -> Column:
    """Every index of either side, no tail is lost."""
    return F.map_zip_with(_c(a), _c(b), lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def sparse_cosine(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    both = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x * y, F.lit(0.0))))
    size = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))
    return F.try_divide(F.aggregate(both, F.lit(0.0), lambda s, v: s + v), size(a) * size(b))


def common_dimensions(a: Column | str, b: Column | str) -> Column:
    """Sum over common indexes of the lesser value."""
    return F.aggregate(F.map_values(F.map_zip_with(_c(a), _c(b), lambda _, x, y: F.when(x.isNull() | y.isNull(), 0.0).otherwise(F.least(x, y)))), F.lit(0.0), lambda s, v: s + v)


def hashed_index(token: Column | str, size: int = 1 << 20, base: int = 300) -> Column:
    return F.pmod(F.hash(_c(token)), F.lit(size)) + base


def hashed_counts(tokens: Column | str, size: int = 2048) -> Column:
    """Hashed term frequencies of a token array, as a sparse map: hashed in the JVM, counted by Arrow batches."""

    @pandas_udf("map<int,double>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrays in batches:
            yield pd.Series([None if a is None else {int(i): float(n) for i, n in zip(*np.unique(np.asarray(a, np.int64), return_counts=True), strict=True)} for a in arrays], dtype=object)

    return counted(F.transform(_c(tokens), lambda t: F.pmod(F.hash(t), F.lit(size))))


def closest(vector: Column | str, centres: Column | str) -> Column:
    """Index of the centre with the greatest cosine, the first of equals."""
    scored = F.transform(_c(centres), lambda c, i: F.struct(F.coalesce(cosine(vector, c), F.lit(-2.0)).alias("s"), (-i).alias("i")))
    return -F.array_max(scored)["i"]


def margin_score(raw: Column | str, positive_index: int = 1) -> Column:
    """A two-class margin as a score from 0 to 1: the positive part's share of both if none is negative, the negative part's if both are, else by arc tangent."""
    yes, no = F.get(_c(raw), F.lit(positive_index)), F.get(_c(raw), F.lit(1 - positive_index))
    return F.when((yes >= 0) & (no >= 0), F.coalesce(F.try_divide(yes, yes + no), F.lit(0.5))).when((yes < 0) & (no < 0), no / (yes + no)).otherwise(0.5 + F.atan(yes - no) / math.pi)


def sparse_max(a: Column | str, b: Column | str) -> Column:
    """Every index of either side with the greater value."""
    return F.map_zip_with(_c(a), _c(b), lambda _, x, y: F.greatest(x, y))


def sparse_scale(a: Column | str, k: float | Column) -> Column:
    return F.transform_values(_c(a), lambda _, x: x * k)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def sparse_norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(F.map_values(_c(a)), lambda v: v * v)))


def sparse_normal(a: Column | str) -> Column:
    """Scaled to length one; as it is if it is zero."""
    return sparse_scale(a, F.coalesce(F.try_divide(F.lit(1.0), sparse_norm(a)), F.lit(1.0)))


def sparse_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - sparse_cosine(a, b)


def _common(a: Column | str, b: Column | str, of) -> Column:
    """A map over the indexes that both sides have."""
    both = F.map_zip_with(_c(a), _c(b), lambda _, x, y: F.when(x.isNotNull() & y.isNotNull(), of(x, y)))
    return F.map_filter(both, lambda _, v: v.isNotNull())


def relative_semantic(a: Column | str, reference: Column | str) -> Column:
    """Of the indexes of both: (0.5 + 0.5 * value / greatest) * ln(greatest of reference / reference), zeros left out."""
    top = F.array_max(F.transform(F.map_values(_c(a)), F.abs))
    ref = F.array_max(F.transform(F.map_values(_c(reference)), F.abs))
    return _common(F.map_filter(_c(a), lambda _, v: v != 0), reference, lambda x, y: (0.5 + 0.5 * x / top) * F.log(ref / F.abs(y)))


def semantic_diff(a: Column | str, frequency: Column | str) -> Column:
    """Of the indexes of both: the value and its relative difference from frequency in parts of itself."""
    return _common(a, frequency, lambda x, y: x + F.abs(x) * (x - y) / (F.abs(x) + F.abs(y)))


def keep_dimensions(a: Column | str, other: Column | str) -> Column:
    """The indexes that other has too."""
    return _common(a, other, lambda x, y: x)


def relative_similarity(a: Column | str, b: Column | str, reference: Column | str) -> Column:
    """Cosine over the indexes of reference, each weighed by ln(1 + |reference|) in parts of the greatest."""
    top = F.array_max(F.transform(F.map_values(_c(reference)), lambda v: F.log(1 + F.abs(v))))
    weights = F.transform_values(_c(reference), lambda _, v: F.log(1 + F.abs(v)) / top)
    return sparse_cosine(_common(a, weights, lambda x, w: x * w), _common(b, weights, lambda x, w: x * w))


def platt_score(raw: Column | str, a: float, b: float, positive_index: int = 1) -> Column:
    """1 / (1 + exp(a * margin + b)) if a is not about zero, else margin_score()."""
    if abs(a) <= 1e-20:
        return margin_score(raw, positive_index)
    return 1 / (1 + F.exp(a * F.get(_c(raw), F.lit(positive_index)) + b))


def colour(x: Column | str, low: Column, high: Column) -> Column:
    """Where x stands between low and high on a logarithmic scale, 0 to 1."""
    return F.log(1 + _c(x) - low) / F.log(1 + high - low)


def bounding_box(points: Column | str) -> Column:
    """Of an array of structs x, y."""
    p = _c(points)
    x, y = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return F.struct(F.array_min(x).alias("min_x"), F.array_min(y).alias("min_y"), F.array_max(x).alias("max_x"), F.array_max(y).alias("max_y"))


def in_polygon(x: Column | str, y: Column | str, ring: Column | str) -> Column:
    """Even-odd rule over an array of structs x, y; points on an edge count as inside."""
    x, y, ring = _c(x), _c(y), _c(ring)
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)))

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straight = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return straight & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    count = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False))))
    return F.exists(edges, on) | (count % 2 == 1)
