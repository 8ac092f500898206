"""Queries by name, each with its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.sources.files import Registry

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Registered queries; a name may be given once."""

    def __init__(self):
        self._registry = Registry()
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, lists: tuple[str, ...] = ()) -> Callable[[Query], Query]:
        """A decorator that registers a function under its name, with the SQL that gives the same rows.

        Columns named in ``lists`` are written as texts, their elements between bars, so that rows can be compared.
        """

        def keep(f: Query) -> Query:
            def flat(spark: SparkSession, folder: str) -> DataFrame:
                rows = f(spark, folder)
                return rows.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|") for c in lists})

            self._registry.register(f.__name__, flat if lists else f)
            if sql is not None:
                texts = ", ".join(f"array_to_string(list_transform({c}, lambda x: x::varchar), '|') as {c}" for c in lists)
                self.sql[f.__name__] = f"select * replace ({texts}) from ({sql})" if lists else sql
            return f

        return keep

    @property
    def queries(self) -> dict[str, Query]:
        return dict(self._registry.items())
