"""All named queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.plans import evaluation, files, nested, reference, training
from pairloom.sources.files import Registry

MODULES = (nested, reference, files, training, evaluation)
FLAGSHIP = "pairs_balanced_stats"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_queries = Registry()
    for m in MODULES:
        for name, f in m.QUERIES.items():
            all_queries.register(name, f)
    return dict(all_queries.items())


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
