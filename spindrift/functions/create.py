"""Made-up values and virtual graph elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col, items, lit


def uuid() -> Column:
    return F.uuid()


def v_node(id_, labels, **properties) -> Column:
    """A node that is in no graph."""
    return F.struct(col(id_).alias("id"), items(labels).alias("labels"), *(lit(v).alias(k) for k, v in properties.items()))


def v_relationship(src, type_: str, dst, **properties) -> Column:
    return F.struct(col(src).alias("src"), F.lit(type_).alias("type"), col(dst).alias("dst"), *(lit(v).alias(k) for k, v in properties.items()))
