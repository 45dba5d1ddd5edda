"""Functions of rows and groups whose failures stay local, and the probability files."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborframe.operators import batches
from arborframe.sources import tables


def test_one_bad_row_costs_few_calls():
    calls = []

    def root(frame):
        calls.append(len(frame))
        if (frame["v"] < 0).any():
            raise ValueError("negative")
        return frame.assign(root=frame["v"] ** 0.5)

    frame = pd.DataFrame({"v": [float(i) for i in range(100_000)]})
    frame.loc[70_001, "v"] = -1.0
    out = batches.halved(frame, root, ["root"])
    assert len(calls) <= 2 * 17 + 1 and len(out) == 100_000
    assert out["error"].notna().sum() == 1 and out["error"].iloc[70_001] == "ValueError: negative"
    assert out["root"].isna().sum() == 1 and out["root"].iloc[9] == 3


def test_rows(spark):
    def level(frame):
        if (frame["n"] % 10 == 3).any():
            raise KeyError("three")
        return frame.assign(level=frame["n"] * 2)

    got = batches.apply_rows(spark.range(100).withColumnRenamed("id", "n"), level, {"level": "long"})
    good, bad = batches.split_failures(got)
    assert {r["n"] for r in bad.collect()} == set(range(3, 100, 10))
    assert {r["n"]: r["level"] for r in good.collect()} == {n: 2 * n for n in range(100) if n % 10 != 3}


def test_groups(spark):
    rows = spark.range(60).select((F.col("id") % 7).alias("g"), F.col("id").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None, 5), (None, 6)], "g long, v long"))

    def spread(frame):
        if (frame["g"] == 4).any():
            raise RuntimeError("four")
        of = frame[frame["g"] != 5].groupby("g", dropna=False)["v"]
        once = pd.DataFrame({"low": of.min(), "high": of.max()}).reset_index()
        return pd.concat([once, once])

    for size in ("10000", "4"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = batches.apply_groups(rows, ["g"], spread, {"low": "long", "high": "long"})
        by = {}
        for r in got.collect():
            by.setdefault(r["g"], []).append(tuple(r)[1:])
        assert by.pop(4) == [(None, None, "RuntimeError: four")] and 5 not in by
        assert by.pop(None) == [(5, 6, None)] * 2
        assert by == {g: [(g, 56 + g if g < 4 else 49 + g, None)] * 2 for g in (0, 1, 2, 3, 6)}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    marked = rows.join(got.select("g", "error").distinct(), "g")
    assert [tuple(r) for r in batches.failed_groups(marked, ["g"]).collect()] == [(4, "RuntimeError: four")]
    assert {r["g"] for r in batches.drop_failed_groups(marked, ["g"]).collect()} == {0, 1, 2, 3, 6}


def test_one_bad_group_costs_few_calls():
    calls = []

    def total(frame):
        calls.append(len(frame))
        if (frame["v"] < 0).any():
            raise ValueError("negative")
        return frame.groupby("g", as_index=False)["v"].sum().rename(columns={"v": "total"})

    frame = pd.DataFrame({"g": [i // 4 for i in range(40_000)], "v": 1.0})
    frame.loc[17_002, "v"] = -1.0
    out = pd.concat(batches.halved_groups(frame, ["g"], total, ["total"]))
    assert len(calls) <= 2 * 14 + 1 and len(out) == 10_000
    assert out[out["error"].notna()]["g"].tolist() == [17_002 // 4]


def test_probability_files(spark, tmp_path):
    pops = spark.createDataFrame([("p,1", "7", 0.25), ('q"', "8", 1.0)], tables.POPULATION_SCHEMA)
    numbers = spark.createDataFrame([("a", 1.5, 0.5), ("b", 0.0, 0.0), ("c", -1.0, None)], tables.TUFT_NUMBER_SCHEMA)
    tables.write_probabilities(str(tmp_path), populations=pops, tuft_numbers=numbers)
    read, bad = tables.load_probabilities(spark, str(tmp_path))
    assert sorted(map(tuple, read["populations"].collect())) == sorted(map(tuple, pops.collect()))
    assert read["projections"].count() == 0 and read["projections"].schema == tables.PROJECTION_SCHEMA
    assert sorted(r[0] for r in bad.collect()) == ["b", "c"] and read["tuft_numbers"].count() == 3
    with pytest.raises(KeyError):
        tables.write_probabilities(str(tmp_path), others=pops)
