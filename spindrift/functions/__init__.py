"""Column functions by category.

Every public function of a category module takes and returns columns (or plain
values that become literals) and is found by name: ``call("coll.sum", col)``.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

CATEGORIES = (
    "agg", "bitwise", "coll", "convert", "create", "date", "diff", "hashing", "json", "label", "map", "math", "merge", "meta", "node", "number", "path", "point", "rel", "scalar",
    "scoring", "search", "spatial", "stats", "temporal", "text", "util", "vector", "xml",
)


def _camel(name: str) -> str:
    head, *rest = name.rstrip("_").split("_")
    return head + "".join(x.title() for x in rest)


def registry() -> dict[str, Callable]:
    """``category.camelName`` of every function."""
    found = {}
    for category in CATEGORIES:
        module = importlib.import_module(f"{__name__}.{category}")
        for name, f in vars(module).items():
            if callable(f) and not name.startswith("_") and getattr(f, "__module__", None) == module.__name__:
                found[f"{category}.{_camel(name)}"] = f
    return found


def call(name: str, *args, **kwargs):
    """Apply a function by its name, letter case ignored."""
    wanted = re.sub(r"[^a-z0-9.]", "", name.lower())
    for known, f in registry().items():
        if known.lower() == wanted:
            return f(*args, **kwargs)
    raise KeyError(f"no function {name}")
