"""Merging properties into nodes and maps into maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import node as _node
from spindrift.functions._base import col, merged


def properties(n, more) -> Column:
    return _node.set_properties(n, more)


def labels(n, more) -> Column:
    return _node.add_labels(n, more)


def deep_merge(a, b) -> Column:
    """Maps of maps: inner maps of one key are merged, ``b``'s values first."""
    return F.map_zip_with(col(a), col(b), lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(merged(x, y)))


def conditional(n, condition: Column, more) -> Column:
    return F.when(condition, properties(n, more)).otherwise(col(n))


def strategy(n, more, name: str = "overwrite") -> Column:
    """``overwrite`` takes new values, ``keep`` only those of new keys."""
    if name == "keep":
        return col(n).withField("properties", merged(col(more), _node.properties(n)))
    if name in ("overwrite", "merge"):  # values are texts: nothing to merge inside one
        return properties(n, more)
    raise ValueError(f"no merge strategy named {name}")


def conflict(n, more, resolver: Callable[[Column, Column], Column]) -> Column:
    """Where both have a key, the value is ``resolver(old, new)``."""
    old, new = _node.properties(n), col(more)
    one = lambda k, x, y: F.when(~F.map_contains_key(new, k), x).when(~F.map_contains_key(old, k), y).otherwise(resolver(x, y))
    return col(n).withField("properties", F.map_zip_with(old, new, one))


def preview(n, more) -> Column:
    """The node before and after."""
    return F.struct(col(n).alias("before"), properties(n, more).alias("after"))
