"""Connected components of edge tables, whose hubs may hold a third of all edges.

Groups that fit into a task are joined there.  For the others every task first replaces its edges
by a spanning forest of them.  Then rounds of three steps: leaves that hang on a smaller node leave the table for good; every node hands its larger
neighbours, then its smaller ones, to its smallest neighbour (the two star contractions of Kiveris
et al. 2014).  A hub's rows are dealt over several salts, against which its one row is repeated.
It ends when no edge is left; the leaves that have left then follow each other to the label.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborframe.operators import whole_graphs as W
from arborframe.operators.contraction import doubled
from arborframe.operators.core import Rounds, written


class Forest:
    """Smallest known node of every node, joined by edges."""

    def __init__(self) -> None:
        self.up: dict = {}

    def top(self, v):
        up, way = self.up, []
        while (above := up.setdefault(v, v)) != v:
            way.append(v)
            v = above
        for w in way:
            up[w] = v
        return v

    def join(self, a, b) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple]:
        return [(v, self.top(v)) for v in list(self.up) if self.up[v] != v]


def spanning(edges: DataFrame, *, most: int = 500_000) -> DataFrame:
    """Edges ``keys, u, v`` (u > v) that join the same nodes, at most one a node and task; a task
    that knows ``most`` nodes sends its forest on and begins another one."""
    names = edges.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, Forest] = {}
        known = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, u, v in zip(zip(*columns[:-2]) if columns[:-2] else [()] * batch.num_rows, *columns[-2:]):
                forest = groups.get(key) or groups.setdefault(key, Forest())
                known += (u not in forest.up) + (v not in forest.up)
                forest.join(u, v)
            if known > most:
                yield sent(groups, batch.schema)
                groups, known = {}, 0
        if groups:
            yield sent(groups, batch.schema)

    def sent(groups: dict[tuple, Forest], schema: pa.Schema) -> pa.RecordBatch:
        rows = [(*key, u, v) for key, forest in groups.items() for u, v in forest.edges()]
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], names=names)

    return edges.mapInArrow(run, edges.schema)


def _met(rows: DataFrame, lowest: DataFrame, keys: list[str], crowd: int) -> DataFrame:
    """Rows ``keys, u, v`` with the ``_m`` of their u from ``lowest`` (``keys, u, n, _m``); rows of
    a node with more than ``crowd`` of them go to several salts."""
    salts = F.ceil(F.col("n") / F.lit(crowd)).cast("int")
    hubs = lowest.filter(F.col("n") > crowd).select(*keys, "u", salts.alias("_salts"))
    if hubs.isEmpty():
        return rows.join(lowest.select(*keys, "u", "_m"), [*keys, "u"])
    # the hubs are at most the rows over ``crowd``; the planner sees the size of their table
    hubs = written(hubs, "hubs")
    salted = rows.join(hubs, [*keys, "u"], "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("v"), F.col("_salts"))).cast("int")
    ).drop("_salts")
    spread = lowest.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return salted.join(spread.select(*keys, "u", "_salt", "_m"), [*keys, "u", "_salt"]).drop("_salt")


def components(
    edges: DataFrame, keys: Sequence[str], *, a: str = "a", b: str = "b", crowd: int = 100_000,
    most: int = W.MOST_EDGES,
) -> DataFrame:
    """Connected components of undirected edges: (keys, id, component), smallest id as label.

    Edges with a NULL end, and those from a node to itself, join nothing.  Ids are of any type
    that has an order.  Groups of at most ``most`` edges between whole numbers are joined inside
    tasks; for all others rounds go on until no edge is left.
    """
    keys = list(keys)
    whole = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    flat = whole.select(*keys, F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    if not (keys and W.whole_numbers(flat, ["u", "v"])):
        return _in_rounds(flat, keys, crowd)
    flat = written(flat, "component-edges")
    large = W.too_large(flat, keys, F.lit(False), most)
    if large is None:
        return W.joined(flat, keys)
    here, there = W.split(flat, large, keys)
    return W.joined(here, keys).unionByName(_in_rounds(there, keys, crowd))


def _in_rounds(flat: DataFrame, keys: list[str], crowd: int) -> DataFrame:
    """:func:`components` of edges (keys, u, v), u > v, for groups of any size."""
    rounds = Rounds(flat.sparkSession, "components")
    state = rounds.cut(spanning(flat).distinct(), watch=F.lit(True))
    leaves: list[DataFrame] = []
    while rounds.pending:
        rounds.next()
        both = state.unionByName(state.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = written(
            both.groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("_m")), "lowest"
        )
        leaf = written(lowest.filter("n = 1 and _m < u").select(*keys, "u", F.col("_m").alias("v")), "leaves")
        leaves.append(leaf)
        inner = rounds.cut(
            state.join(leaf.select(*keys, "u"), [*keys, "u"], "left_anti").select(*state.columns),
            "inner", watch=F.lit(True),
        )
        if not rounds.pending:
            break
        # larger neighbours move to the smallest one
        both = inner.unionByName(inner.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(*keys, "u").agg(
            F.count(F.lit(1)).alias("n"), F.least(F.min("v"), F.col("u")).alias("_m")
        )
        large = rounds.cut(
            _met(both, written(lowest, "lowest"), keys, crowd).filter("v > u")
            .select(*keys, F.col("v").alias("u"), F.col("_m").alias("v")).distinct(),
            "large",
        )
        # smaller neighbours, and the node itself, move to the smallest one
        low = written(
            large.groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("_m")), "lowest"
        )
        small = (
            _met(large, low, keys, crowd)
            .filter("v <> _m").select(*keys, F.col("v").alias("u"), F.col("_m").alias("v"))
            .unionByName(low.select(*keys, "u", F.col("_m").alias("v")))
            .filter("u <> v").distinct()
        )
        state = rounds.cut(small, watch=F.lit(True))
    if not leaves:
        return state.select(*keys, F.col("u").alias("id"), F.col("v").alias("component"))
    left = leaves[0]
    for more in leaves[1:]:
        left = left.unionByName(more)
    left = written(left, "left")
    ends = left.select(*keys, F.col("v").alias("u")).distinct().join(left.select(*keys, "u"), [*keys, "u"], "left_anti")
    ways = left.select(*keys, F.col("u").alias("_node"), F.col("v").alias("_hop")).unionByName(
        ends.select(*keys, F.col("u").alias("_node"), F.lit(None).cast(left.schema["u"].dataType).alias("_hop"))
    )
    return doubled(ways, keys, [], {}).select(
        *keys, F.col("_node").alias("id"), F.col("_summit").alias("component")
    )
