"""Keyed tables on disk: CSV with JSON columns, JSON records, probabilities, voxel volumes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType, LongType, StringType, StructField, StructType,
)

from arborframe.operators.voxels import IJK, Grid


def write_csv(df: DataFrame, path: str, *, json_columns: Sequence[str] = ()) -> None:
    """CSV with a header; nested columns become JSON text."""
    out = df.withColumns({c: F.to_json(c) for c in json_columns})
    out.write.option("header", "true").option("escape", '"').csv(path)


def read_csv(
    spark: SparkSession, path: str, schema: str | StructType, *, json_columns: dict[str, str] | None = None
) -> DataFrame:
    """CSV written by :func:`write_csv`; ``json_columns`` maps nested columns to their type."""
    df = spark.read.option("header", "true").option("escape", '"').schema(schema).csv(path)
    return df.withColumns({c: F.from_json(c, t) for c, t in (json_columns or {}).items()})


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object per row, NULL fields kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def read_records(spark: SparkSession, path: str, schema: str | StructType, *, array: bool = False) -> DataFrame:
    """JSON records, one object per line, or one array of objects per file with ``array``."""
    return spark.read.option("multiLine", str(array).lower()).schema(schema).json(path)


# --- probabilities ------------------------------------------------------------------------------

# Column names of the three tables, which files of others have as well.
POPULATION_SCHEMA = StructType([
    StructField("population_id", StringType()), StructField("brain_region_id", StringType()),
    StructField("probability", DoubleType()),
])
PROJECTION_SCHEMA = StructType([
    StructField("source_population_id", StringType()), StructField("source_brain_region_id", StringType()),
    StructField("target_population_id", StringType()), StructField("target_brain_region_id", StringType()),
    StructField("probability", DoubleType()),
])
TUFT_NUMBER_SCHEMA = StructType([
    StructField("target_population_id", StringType()), StructField("mean_tuft_number", DoubleType()),
    StructField("std_tuft_number", DoubleType()),
])


def bad_tuft_numbers(numbers: DataFrame) -> DataFrame:
    """Populations whose mean number of tufts is not positive; must be empty."""
    return numbers.filter(F.col("mean_tuft_number") <= 0)


PROBABILITIES = {
    "populations": ("population_probabilities.csv", POPULATION_SCHEMA),
    "projections": ("projection_probabilities.csv", PROJECTION_SCHEMA),
    "tuft_numbers": ("population_tuft_number.json", TUFT_NUMBER_SCHEMA),
}


def write_probabilities(folder: str, **tables: DataFrame) -> None:
    """The given ones of ``populations``, ``projections`` and ``tuft_numbers`` as files of a folder."""
    for name, table in tables.items():
        file, schema = PROBABILITIES[name]
        path, chosen = f"{folder.rstrip('/')}/{file}", table.select(*schema.names)
        if file.endswith(".csv"):
            write_csv(chosen, path)
        else:
            write_records(chosen, path)


def load_probabilities(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The probability tables of a folder, ids as text and probabilities as numbers, and the tuft
    numbers that are not positive.  A table whose file is missing has no rows."""
    read = {}
    for name, (file, schema) in PROBABILITIES.items():
        path = f"{folder.rstrip('/')}/{file}"
        if not exists(spark, path):
            read[name] = spark.createDataFrame([], schema)
        elif file.endswith(".csv"):
            read[name] = read_csv(spark, path, schema)
        else:
            read[name] = read_records(spark, path, schema)
    return read, bad_tuft_numbers(read["tuft_numbers"])


# --- keyed tables -------------------------------------------------------------------------------


def read_keyed(
    spark: SparkSession, path: str, *, required: Sequence[str] = (), section_column: str | None = None
) -> DataFrame:
    """Parquet table with a check of its columns; unknown section ids become -1."""
    df = spark.read.parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    if section_column and section_column in df.columns:
        df = df.withColumn(section_column, F.coalesce(F.col(section_column).cast(LongType()), F.lit(-1)))
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in double columns becomes NULL."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}) if doubles else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def reuse(spark: SparkSession, path: str, make: Callable[[], DataFrame], *, overwrite: bool = False) -> DataFrame:
    """The table at a path if it was completely written before, else made, written and read.

    A write that was cut short leaves no success marker and is made again.
    """
    if overwrite or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append(df: DataFrame, path: str, *, keys: Sequence[str] = ()) -> None:
    """Add rows to a table; with ``keys`` only those whose key is not there yet."""
    out = df
    if keys and exists(df.sparkSession, path):
        old = df.sparkSession.read.parquet(path).select(*keys).distinct()
        out = df.join(old, list(keys), "left_anti")
    out.write.mode("append").parquet(path)


# --- voxel volumes ------------------------------------------------------------------------------


def save_volume(voxels: DataFrame, grid: Grid, path: str) -> None:
    """Voxel table and its one-row grid description below a folder, in bands of ``i``."""
    voxels.repartitionByRange("i").sortWithinPartitions(*IJK).write.parquet(f"{path}/voxels")
    spark = voxels.sparkSession
    row = [tuple(float(v) for v in (*grid.dim, *grid.offset)) + tuple(int(n) for n in grid.shape)]
    names = [f"{p}_{a}" for p in ("dim", "off") for a in "xyz"]
    schema = ", ".join([f"{n} double" for n in names] + [f"n_{a} int" for a in "xyz"])
    spark.createDataFrame(row, schema).write.parquet(f"{path}/grid")


def load_volume(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """Voxel table and grid written by :func:`save_volume`."""
    g = spark.read.parquet(f"{path}/grid").first()
    grid = Grid(tuple(g[f"dim_{a}"] for a in "xyz"), tuple(g[f"off_{a}"] for a in "xyz"), tuple(g[f"n_{a}"] for a in "xyz"))
    return spark.read.parquet(f"{path}/voxels"), grid
