"""Collects the queries and SQL texts of the query modules."""

from __future__ import annotations

import functools
import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

# Fixed value: tables of sorted keys take 0.4 to 5 bytes a row in their files and about 150 in a
# broadcast, so that the planner's size of a table is its files' size times this.
UNPACKED = 32
SIZE_FACTOR = "spark.sql.sources.fileCompressionFactor"

# Whether a join wants rows dealt by all of its columns, even where some of them do already.
ALL_COLUMNS = "spark.sql.requireAllClusterKeysForCoPartition"
_GIVEN: dict[str, str] = {}


def sized(fn: Query, together: bool = False) -> Query:
    """The query in a session that takes Parquet files for as large as their rows are.

    Otherwise joins broadcast every table whose files are small, and all rows of it go through the
    driver.  A factor that the session was given stays.  Queries that are to keep the rows of a
    tree ``together`` over several joins accept rows dealt by some of a join's columns.
    """

    @functools.wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        if float(spark.conf.get(SIZE_FACTOR)) == 1.0:
            spark.conf.set(SIZE_FACTOR, str(UNPACKED))
        given = _GIVEN.setdefault(spark.sparkContext.applicationId, spark.conf.get(ALL_COLUMNS))
        spark.conf.set(ALL_COLUMNS, "false" if together else given)
        return fn(spark, sf)

    return run


class Shelf:
    """Holds the queries of one module: ``@shelf.add(name, sql)``; ``together`` as in :func:`sized`."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, *, together: bool = False) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            self.queries[name] = sized(fn, together)
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return keep


def _shelves() -> list[Shelf]:
    import arborframe.plans as plans

    names = sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("ask_"))
    return [importlib.import_module(f"arborframe.plans.{n}").shelf for n in names]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for shelf in _shelves():
        out.update(shelf.queries)
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for shelf in _shelves():
        out.update(shelf.oracles)
    return out
