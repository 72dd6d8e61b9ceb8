"""Lists.  Places count from 0, as in the query language; all are built-in
higher-order functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import items, lit, total


def sum_(xs) -> Column:
    return total(items(xs))


def sum_longs(xs) -> Column:
    return F.aggregate(items(xs), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0)))


def avg(xs) -> Column:
    """Mean of the numbers; null for an empty list."""
    a = items(xs)
    return F.try_divide(total(a), F.size(F.filter(a, lambda x: x.isNotNull())))


def min_(xs) -> Column:
    return F.array_min(items(xs))


def max_(xs) -> Column:
    return F.array_max(items(xs))


def sort(xs) -> Column:
    return F.array_sort(items(xs))


def sort_maps(xs, key: str) -> Column:
    """Maps or structs in order of one entry."""
    return F.array_sort(items(xs), lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0))


def sort_nodes(xs, key: str) -> Column:
    return sort_maps(xs, key)


def reverse(xs) -> Column:
    return F.reverse(items(xs))


def contains(xs, value) -> Column:
    return F.array_contains(items(xs), lit(value))


def contains_sorted(xs, value) -> Column:
    return contains(xs, value)


def contains_all(xs, values) -> Column:
    return F.size(F.array_except(items(values), items(xs))) == 0


def contains_any(xs, values) -> Column:
    return F.arrays_overlap(items(xs), items(values))


def contains_duplicates(xs) -> Column:
    a = items(xs)
    return F.size(a) > F.size(F.array_distinct(a))


def union(xs, *more) -> Column:
    out = F.array_distinct(items(xs))
    for m in more:
        out = F.array_union(out, items(m))
    return out


def union_all(*lists) -> Column:
    return F.concat(*map(items, lists))


def intersection(xs, *more) -> Column:
    out = F.array_distinct(items(xs))
    for m in more:
        out = F.array_intersect(out, items(m))
    return out


def subtract(xs, ys) -> Column:
    return F.array_except(items(xs), items(ys))


def different(xs, ys) -> Column:
    return subtract(xs, ys)


def disjunction(xs, ys) -> Column:
    a, b = items(xs), items(ys)
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def flatten(xs, depth: int = 1) -> Column:
    """``depth`` levels of nesting removed."""
    out = items(xs)
    for _ in range(depth):
        out = F.flatten(out)
    return out


def to_set(xs) -> Column:
    return F.array_distinct(items(xs))


def index_of(xs, value) -> Column:
    """First place of a value; -1 if absent."""
    return F.array_position(items(xs), lit(value)).cast("long") - 1


def split(xs, size: int) -> Column:
    """Chunks of ``size``; the last may be shorter."""
    a = items(xs)
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i, F.lit(size)))


def partition(xs, predicate) -> Column:
    """The items that satisfy a predicate, and the rest."""
    a = items(xs)
    return F.array(F.filter(a, predicate), F.filter(a, lambda x: ~predicate(x)))


def pairs(xs) -> Column:
    """Each item with the one after it."""
    a = items(xs)
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.transform(F.slice(F.sequence(F.lit(1), n + 1), F.lit(1), n), lambda i: F.slice(a, i, F.lit(2)))


def pairs_min(xs) -> Column:
    """Pairs that don't overlap; an odd last item is left out."""
    return F.filter(split(xs, 2), lambda p: F.size(p) == 2)


def zip_(*lists) -> Column:
    """Items at the same places, as arrays as long as the longest list."""
    arrays = list(map(items, lists))
    longest = F.greatest(*map(F.size, arrays)) if len(arrays) > 1 else F.size(arrays[0])
    places = F.slice(F.sequence(F.lit(0), longest), F.lit(1), longest)
    return F.transform(places, lambda i: F.array(*(F.get(a, i) for a in arrays)))


def occurrences(xs, value) -> Column:
    v = lit(value)
    return F.size(F.filter(items(xs), lambda x: x == v)).cast("long")


def frequencies(xs) -> Column:
    """Map of item to count."""
    a = items(xs)
    return F.map_from_entries(F.transform(F.array_distinct(a), lambda v: F.struct(v, F.size(F.filter(a, lambda x: x.eqNullSafe(v))).cast("long"))))


def frequencies_as_map(xs) -> Column:
    a = items(xs)
    return F.transform(F.array_distinct(a), lambda v: F.struct(v.alias("item"), F.size(F.filter(a, lambda x: x.eqNullSafe(v))).cast("long").alias("count")))


def duplicates(xs) -> Column:
    a = items(xs)
    return F.filter(F.array_distinct(a), lambda v: F.size(F.filter(a, lambda x: x.eqNullSafe(v))) > 1)


def duplicates_with_count(xs) -> Column:
    return F.filter(frequencies_as_map(xs), lambda s: s["count"] > 1)


def drop_duplicate_neighbors(xs) -> Column:
    a = items(xs)
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))


def fill(item, count) -> Column:
    return F.array_repeat(lit(item), lit(count).cast("int"))


def insert(xs, index: int, value) -> Column:
    return F.array_insert(items(xs), index + 1, lit(value))


def insert_all(xs, index: int, values) -> Column:
    a = items(xs)
    return F.concat(F.slice(a, 1, index) if index else F.slice(a, 1, 0), items(values), F.slice(a, F.lit(index + 1), F.greatest(F.size(a) - index, F.lit(0))))


def remove(xs, index: int) -> Column:
    return F.filter(items(xs), lambda x, i: i != index)


def remove_all(xs, value) -> Column:
    return F.array_remove(items(xs), lit(value))


def set_(xs, index: int, value) -> Column:
    v = lit(value)
    return F.transform(items(xs), lambda x, i: F.when(i == index, v).otherwise(x))


def slice_(xs, start: int, end: int) -> Column:
    return F.slice(items(xs), start + 1, max(0, end - start))


def shuffle(xs) -> Column:
    return F.shuffle(items(xs))


def random_item(xs) -> Column:
    return F.try_element_at(F.shuffle(items(xs)), F.lit(1))


def random_items(xs, count: int) -> Column:
    return F.slice(F.shuffle(items(xs)), 1, count)


def is_empty(xs) -> Column:
    return F.size(items(xs)) == 0


def is_not_empty(xs) -> Column:
    return F.size(items(xs)) > 0
