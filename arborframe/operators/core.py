"""Lineage cuts, ordered accumulation that survives hot groups, and small shared joins."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables, as named by ``spark.checkpoint.dir``.

    Where the session names none, it is a folder below the warehouse, the storage that the
    session itself was given.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/arborframe/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write the frame to the scratch folder and read it back, which cuts its lineage.

    The files outlive a lost executor, and their known size lets the planner choose
    broadcast or shuffle joins from facts instead of guesses.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later read needs."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target.getFileSystem(conf).delete(target, True)


class Scratch:
    """Written tables of one operator, removed together when no later read needs them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            removed(self.spark, path)
        self.paths.clear()


class Rounds:
    """Cuts lineage once per round and removes the tables of rounds before the last one.

    Rounds go on until the caller sees nothing change; ``limit`` is for loops that may not end.
    """

    def __init__(self, spark: SparkSession, label: str, limit: int | None = None):
        self.spark = spark
        self.label = label
        self.limit = limit
        self.pending = 0
        self.seal: tuple = ()
        self._last: dict[str, str] = {}
        self._round = 0

    def next(self) -> int:
        self._round += 1
        if self.limit is not None and self._round > self.limit:
            raise RuntimeError(f"{self.label}: no convergence after {self.limit} rounds")
        return self._round

    def cut(
        self, df: DataFrame, name: str = "state", watch: Column | None = None,
        mark: bool = False,
    ) -> DataFrame:
        """Write this round's table.

        ``watch`` counts rows while they are written (read it from ``pending``); ``mark`` also
        takes an order-free fingerprint of all rows (``seal``) to notice an unchanged table.
        """
        path = scratch_path(self.spark, f"{self.label}-{name}-{self._round}")
        if watch is None and not mark:
            df.write.parquet(path)
        else:
            seen = Observation(f"watch-{uuid.uuid4().hex}")
            hits = F.count(F.when(watch if watch is not None else F.lit(True), F.lit(1)))
            seal = F.bit_xor(F.xxhash64(*df.columns)) if mark else F.count(F.lit(1))
            df.observe(seen, hits.alias("hits"), seal.alias("seal")).write.parquet(path)
            got = seen.get
            self.pending, self.seal = got["hits"], (got["hits"], got["seal"])
        stale = self._last.get(name)
        self._last[name] = path
        if stale is not None:
            self._remove(stale)
        return self.spark.read.schema(df.schema).parquet(path)

    def _remove(self, path: str) -> None:
        removed(self.spark, path)


def accumulate(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    *,
    slice_by: Column,
    number: str | None = None,
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Row number and running sums per group without one task per group.

    ``slice_by`` never decreases along ``order``.  Each (group, slice) is ordered on its own;
    the slices' totals, a small pre-aggregated table, give every slice its offset.  A group
    holding a third of all rows is thus spread over as many tasks as it has slices.
    Key columns must not be NULL.
    """
    sums = sums or {}
    keys = list(keys)
    cut = df.withColumn("_slice", slice_by)
    for name, value in sums.items():
        cut = cut.withColumn(f"_v_{name}", value)
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    rows = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = (
        Window.partitionBy(*keys)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = cut.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums],
    )
    offsets = totals.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o_n"),
        *[
            F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}")
            for name in sums
        ],
    )
    out = cut
    if number:
        out = out.withColumn(number, F.row_number().over(inner).cast("bigint"))
    for name in sums:
        out = out.withColumn(name, F.sum(f"_v_{name}").over(rows))
    out = out.join(offsets, [*keys, "_slice"])
    if number:
        out = out.withColumn(number, F.col(number) + F.col("_o_n"))
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.col(f"_o_{name}"))
    drop = ["_slice", "_o_n"] + [f"_o_{n}" for n in sums] + [f"_v_{n}" for n in sums]
    return out.drop(*drop)


def id_slice(column: str | Column, width: int = 1 << 18) -> Column:
    """Slice of a unique integer order column: at most ``width`` rows of a group each.

    It is meant for numbers that lie close together.  Of ids spread over all integers every row is
    a slice of its own, and the totals of a group's slices are as long as the group.
    """
    col = F.col(column) if isinstance(column, str) else column
    return F.floor(col / F.lit(width))


def unit_slice(column: Column, pieces: int = 256) -> Column:
    """Slice of an order column that lies in [0, 1], such as a hashed draw."""
    return F.floor(column * F.lit(pieces))


def with_range(df: DataFrame, order: Sequence[str], *, into: str = "_range") -> DataFrame:
    """Rows with the number of their piece of a range partitioning, for any kind of order column.

    The rows are written, so that the numbers stay what they are when a task is run again.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order])
    return written(ranged.withColumn(into, F.spark_partition_id()), "ranged")


def numbered(
    df: DataFrame, keys: Sequence[str], order: str, into: str, *, start: int = 0
) -> DataFrame:
    """Positions inside each group along a unique integer column, counted from ``start``."""
    out = accumulate(df, keys, [order], slice_by=id_slice(order), number=into)
    return out.withColumn(into, F.col(into) + F.lit(start - 1))


def on(left: str, right: str, names: Sequence[str]) -> Column:
    """Equality of the named columns between two aliased frames."""
    cond = F.lit(True)
    for n in names:
        cond = cond & (F.col(f"{left}.{n}") == F.col(f"{right}.{n}"))
    return cond


def regroup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of a group in one partition; only for groups whose size is known to fit."""
    return df.repartition(*[F.col(k) for k in keys])


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of a group in one partition, the groups over all cores however small they are.

    For writes of one file a group, where the files and not the bytes are the work.  A repartition
    without a number is put together again by size, often into a single task.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *[F.col(k) for k in keys])


def weighted_pick(
    requests: DataFrame,
    options: DataFrame,
    keys: Sequence[str],
    *,
    draw: Column,
    weight: str,
    order: str,
    payload: Sequence[str],
) -> DataFrame:
    """One option per request with odds by weight, drawn from the cumulative weights.

    Requests meet only the options whose weight interval shares a bucket with their draw, so
    a key with many requests and many options never expands to all pairs.  ``order`` is a
    unique integer column of the options.  Requests without any option are dropped.
    """
    keys = list(keys)
    usable = options.filter(F.col(weight) > 0).select(
        *keys, F.col(order).alias("_ord"), F.col(weight).alias("_w"), *payload
    )
    ladder = accumulate(
        usable, keys, ["_ord"], slice_by=id_slice("_ord"), number="_rn",
        sums={"_cum": F.col("_w")},
    )
    totals = usable.groupBy(*keys).agg(
        F.sum("_w").alias("_total"), F.count(F.lit(1)).alias("_nopt")
    )
    tops = written(
        ladder.join(totals, keys).withColumn(
            "_hi",
            F.when(F.col("_rn") == F.col("_nopt"), F.lit(1.0)).otherwise(
                F.col("_cum") / F.col("_total")
            ),
        ),
        "pick-options",
    )
    # each interval starts exactly where the one before it ends, so no draw is lost or doubled
    below = tops.select(*keys, (F.col("_rn") + 1).alias("_rn"), F.col("_hi").alias("_lo"))
    spans = (
        tops.join(below, [*keys, "_rn"], "left")
        .withColumn("_lo", F.coalesce("_lo", F.lit(0.0)))
        .withColumn(
            "_bucket",
            F.explode(
                F.sequence(
                    F.least(F.floor(F.col("_lo") * F.col("_nopt")), F.col("_nopt") - 1),
                    F.least(F.floor(F.col("_hi") * F.col("_nopt")), F.col("_nopt") - 1),
                )
            ),
        )
        .select(*keys, "_bucket", "_lo", "_hi", *payload)
    )
    asked = (
        requests.withColumn("_u", draw)
        .join(totals.select(*keys, "_nopt"), keys)
        .withColumn(
            "_bucket",
            F.least(F.floor(F.col("_u") * F.col("_nopt")), F.col("_nopt") - 1),
        )
    )
    hit = (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))
    return (
        asked.join(spans, [*keys, "_bucket"])
        .filter(hit)
        .drop("_u", "_nopt", "_bucket", "_lo", "_hi")
    )
