"""Scores of rows, sets and vectors."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from spindrift.functions import vector as _vector
from spindrift.functions._base import col, items, lit


def existence(value, score: float = 1.0) -> Column:
    return F.when(col(value).isNotNull(), F.lit(score)).otherwise(F.lit(0.0))


def pareto(minimum: float, eighty: float, maximum: float, x) -> Column:
    """0 below the minimum; 80 % of the maximum at ``eighty``, rising to it."""
    c = col(x).cast("double")
    return F.when(c < minimum, F.lit(0.0)).otherwise(maximum * (1 - F.exp(c * (F.ln(F.lit(0.2)) / eighty))))


def cosine(a, b) -> Column:
    return _vector.similarity_cosine(a, b)


def euclidean(a, b) -> Column:
    return _vector.distance_euclidean(a, b)


def manhattan(a, b) -> Column:
    return _vector.distance_manhattan(a, b)


def jaccard(a, b) -> Column:
    n = F.size(F.array_union(items(a), items(b)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(items(a), items(b))) / n)


def overlap(a, b) -> Column:
    n = F.least(F.size(F.array_distinct(items(a))), F.size(F.array_distinct(items(b))))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(items(a), items(b))) / n)


def dice(a, b) -> Column:
    n = F.size(F.array_distinct(items(a))) + F.size(F.array_distinct(items(b)))
    return F.when(n == 0, F.lit(0.0)).otherwise(2 * F.size(F.array_intersect(items(a), items(b))) / n)


def pearson(a, b) -> Column:
    x, y = items(a), items(b)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e.cast("double")) / F.size(v)
    p, q = F.transform(x, lambda e: e - mean(x)), F.transform(y, lambda e: e - mean(y))
    return F.coalesce(F.try_divide(_vector.dot(p, q), _vector.norm(p) * _vector.norm(q)), F.lit(0.0))


def tf(term: str, text) -> Column:
    words = F.filter(F.split(F.lower(col(text)), r"\s+"), lambda w: w != "")
    return F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: w == term.lower())), F.size(words)), F.lit(0.0))


def idf(n_docs, n_with_term) -> Column:
    return F.coalesce(F.ln(F.try_divide(col(n_docs), col(n_with_term))), F.lit(0.0))


def tfidf(term: str, text, n_docs, n_with_term) -> Column:
    return tf(term, text) * idf(n_docs, n_with_term)


def bm25(frequency, length, mean_length, k1: float = 1.2, b: float = 0.75) -> Column:
    f = col(frequency)
    return f * (k1 + 1) / (f + k1 * (1 - b + b * col(length) / col(mean_length)))


def page_rank(incoming, damping: float = 0.85) -> Column:
    return (1 - damping) + damping * F.aggregate(items(incoming), F.lit(0.0), lambda s, x: s + x)


def normalize(xs) -> Column:
    """A list's values from 0 to 1."""
    a = items(xs)
    low, high = F.array_min(a), F.array_max(a)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)))


def softmax(xs) -> Column:
    a = items(xs)
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def rank(score, *keys) -> Column:
    """Place within ``keys``, the greatest score first."""
    return F.row_number().over(Window.partitionBy(*map(col, keys)).orderBy(col(score).desc()))


def percentile(x, xs) -> Column:
    """Share of a list that lies below a value, in per cent."""
    a = items(xs)
    return F.coalesce(F.try_divide(F.size(F.filter(a, lambda v: v < col(x))), F.size(a)) * 100, F.lit(0.0))


def z_score(x, mean, stdev) -> Column:
    return F.coalesce(F.try_divide(col(x) - lit(mean), lit(stdev)), F.lit(0.0))


def min_max(x, low, high, new_low=0.0, new_high=1.0) -> Column:
    return F.coalesce(F.try_divide(col(x) - lit(low), lit(high) - lit(low)), F.lit(0.0)) * (lit(new_high) - lit(new_low)) + lit(new_low)


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))
