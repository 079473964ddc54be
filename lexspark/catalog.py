"""All queries of the engine's own operators, gathered from the modules of lexspark.plans."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspark import plans

FLAGSHIP = "word_count_once_per_doc"


def _modules():
    for found in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        yield importlib.import_module(f"{plans.__name__}.{found.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query; two plans of one name are an error."""
    found: dict = {}
    for module in _modules():
        for name, query in getattr(module, "QUERIES", {}).items():
            if name in found:
                raise ValueError(f"two queries are named {name}")
            found[name] = query
    return found


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    found: dict = {}
    for module in _modules():
        found |= getattr(module, "ORACLES", {})
    return found
