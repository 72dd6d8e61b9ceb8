"""XML texts, over the built-in XPath functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions._base import col, lit


def parse(s, schema: str) -> Column:
    return F.from_xml(col(s), schema)


def to_string(struct) -> Column:
    return F.to_xml(col(struct))


def query(s, path: str) -> Column:
    return F.xpath(col(s), F.lit(path))


def get_text(s, path: str) -> Column:
    return F.xpath_string(col(s), F.lit(path))


def get_attribute(s, path: str, name: str) -> Column:
    return F.xpath_string(col(s), F.lit(f"{path}/@{name}"))


def get_number(s, path: str) -> Column:
    return F.xpath_double(col(s), F.lit(path))


def exists(s, path: str) -> Column:
    return F.xpath_boolean(col(s), F.lit(path))


def count(s, path: str) -> Column:
    return F.xpath_int(col(s), F.lit(f"count({path})"))


def children(s, path: str) -> Column:
    return F.xpath(col(s), F.lit(f"{path}/*/text()"))


def escape(s) -> Column:
    out = col(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, lit(a), lit(b))
    return out


def unescape(s) -> Column:
    out = col(s)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, lit(a), lit(b))
    return out


def strip_tags(s) -> Column:
    return F.regexp_replace(col(s), r"<[^>]*>", "")


def minify(s) -> Column:
    return F.regexp_replace(F.trim(col(s)), r">\s+<", "><")


def to_json(s, schema: str) -> Column:
    return F.to_json(F.from_xml(col(s), schema))
