"""Interval labels of trees, and what they make cheap: ancestor tests and common ancestors.

In walking order (a node before those below it, children by number) the nodes below a node are the
ones that follow it, so a subtree is an interval: ``a`` is above ``v`` where
``a.first <= v.first <= a.last``.  The lowest common ancestor of two nodes is the parent of the
shallowest node between them.  That minimum is read in pieces of the walk, each with a sparse table
of its own, and from a sparse table over the pieces' minima in between.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborframe.operators.contraction import WIDTH, blocks, climb, codes, ways_up
from arborframe.operators.core import accumulate, id_slice, written


def labels(
    nodes: DataFrame, keys: Sequence[str], *, node: str, parent: Column, width: int = WIDTH
) -> DataFrame:
    """Rows ``keys, node, parent, first, last, depth``: positions of a node and of the last node
    below it in walking order, from 0, and the links above it.

    The labels are lengths of ways: a child comes one after its parent and behind the subtrees of
    the children before it; roots follow each other in the same way.  ``parent`` is NULL at a root.
    """
    keys = list(keys)
    own = written(nodes.select(*keys, F.col(node).cast("bigint").alias(node), parent.cast("bigint").alias("parent")), "tree")
    found = climb(
        own, keys, node=node, parent=F.col("parent"), width=width,
        up={"depth": F.lit(1)}, below={"size": ("sum", F.lit(1).cast("bigint"))},
    ).select(*keys, node, "depth", "size")
    sized = own.join(found, [*keys, node]).withColumn("_root", F.col("parent").isNull())
    beside = accumulate(
        sized.withColumn("_above", F.coalesce("parent", F.lit(0))), [*keys, "_root", "_above"], [node],
        slice_by=id_slice(node), sums={"_through": F.col("size")},
    )
    step = F.col("_through") - F.col("size") + F.when(F.col("_root"), F.lit(0)).otherwise(F.lit(1))
    placed = written(beside.withColumn("_step", step.cast("bigint")), "siblings")
    first = climb(placed, keys, node=node, parent=F.col("parent"), up={"first": F.col("_step")}, width=width)
    return written(
        placed.join(first.select(*keys, node, "first"), [*keys, node]).select(
            *keys, node, "parent", "first", (F.col("first") + F.col("size") - 1).alias("last"),
            (F.col("depth") - 1).cast("bigint").alias("depth"),
        ),
        "intervals",
    )


def is_above(upper: str, lower: str) -> Column:
    """Whether the node labelled in frame ``upper`` is above, or is, the one in ``lower``."""
    return F.col(f"{lower}.first").between(F.col(f"{upper}.first"), F.col(f"{upper}.last"))


class Ranges:
    """Minima of ranges of an array by two overlapping powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [np.arange(len(values))]
        self.values, width = values, 1
        while 2 * width <= len(values):
            a, b = self.rows[-1][:-width], self.rows[-1][width:]
            self.rows.append(np.where(values[a] <= values[b], a, b))
            width *= 2

    def lowest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Position of the minimum of each ``values[lo : hi + 1]``."""
        level = np.log2(hi - lo + 1).astype(np.int64)
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            a, b = self.rows[k][lo[at]], self.rows[k][hi[at] - (1 << k) + 1]
            out[at] = np.where(self.values[a] <= self.values[b], a, b)
        return out


def _in_piece(labelled: DataFrame, asked: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``pair, depth, parent`` of the shallowest node from ``lo`` to ``hi``, which lie in one
    piece of the walk; rows ``keys, pair, piece, lo, hi``."""
    named = [F.col(k) for k in keys] or [F.lit(0)]
    tree = [F.xxhash64(*named).alias("_tree"), F.xxhash64(F.lit("tree"), *named).alias("_tree2")]
    where = F.xxhash64("piece", *named).alias("_piece")
    none = F.lit(None).cast("bigint")
    walk = labelled.withColumn("piece", F.floor(F.col("first") / width)).select(
        *tree, where, "piece", F.lit(0).alias("role"), "first", "depth", "parent", none.alias("pair"), none.alias("hi")
    )
    ranges = asked.select(
        *tree, where, "piece", F.lit(1).alias("role"), F.col("lo").alias("first"), none.alias("depth"),
        none.alias("parent"), "pair", "hi",
    )
    walk = walk.join(ranges.select("_piece").distinct(), "_piece", "left_semi").select(*ranges.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_piece"):
            table = block.combine_chunks()
            number = lambda c: table.column(c).fill_null(0).to_numpy()
            group = codes(number("_tree"), number("_tree2"), number("piece"))
            asked = number("role") == 1
            # the nodes of a piece follow each other without a gap
            own = np.flatnonzero(~asked)
            own = own[np.lexsort([number("first")[own], group[own]])]
            at = np.searchsorted(group[own], group[asked], "left")
            base = number("first")[own][np.minimum(at, max(len(own) - 1, 0))] if len(own) else at
            low = Ranges(number("depth")[own]).lowest(
                at + number("first")[asked] - base, at + number("hi")[asked] - base
            )
            parent = table.column("parent").combine_chunks().take(pa.array(own[low]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(number("pair")[asked]), pa.array(number("depth")[own][low]), parent],
                names=["pair", "depth", "parent"],
            )

    dealt = walk.unionByName(ranges).repartition("_piece").sortWithinPartitions("_piece")
    return dealt.mapInArrow(run, "pair long, depth long, parent long")


def _between(labelled: DataFrame, asked: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``pair, depth, parent`` of the shallowest node of the pieces from ``from`` to ``to``."""
    low = F.min(F.struct("depth", "parent")).alias("low")
    level = written(
        labelled.groupBy(*keys, F.floor(F.col("first") / width).alias("piece")).agg(low), "piece-minima"
    )
    k = F.floor(F.log2(F.col("to") - F.col("from") + 1)).cast("int")
    asked = written(asked.withColumn("level", k), "piece-ranges")
    out, height = None, 0
    most = asked.agg(F.max("level")).first()[0]
    while most is not None and height <= most:
        reach = 1 << height
        here = asked.filter(F.col("level") == height)
        ends = here.select(*keys, "pair", F.explode(F.array("from", F.col("to") - (reach - 1))).alias("piece"))
        part = ends.join(level, [*keys, "piece"]).select("pair", "low.depth", "low.parent")
        out = part if out is None else out.unionByName(part)
        beyond = level.select(*keys, (F.col("piece") - reach).alias("piece"), F.col("low").alias("far"))
        level = written(
            level.join(beyond, [*keys, "piece"]).select(*keys, "piece", F.least("low", "far").alias("low")), "piece-minima"
        )
        height += 1
    return out


def lowest_common(
    labelled: DataFrame, pairs: DataFrame, keys: Sequence[str], *, node: str, width: int = WIDTH
) -> DataFrame:
    """The rows of ``pairs`` (``keys, a, b`` and more) with ``ancestor``, the lowest common
    ancestor of nodes ``a`` and ``b`` of a tree of :func:`labels`; NULL in different trees of a
    group.  Pairs with a node that has no label are dropped."""
    keys = list(keys)
    place = labelled.select(*keys, node, "first", "last")
    ends = pairs.withColumn("_pair", F.monotonically_increasing_id())
    for name in ("a", "b"):
        ends = ends.join(
            place.withColumnsRenamed({node: name, "first": f"_{name}1", "last": f"_{name}2"}), [*keys, name]
        )
    ends = written(ends, "pairs")
    a_first = F.col("_a1") <= F.col("_b1")
    upper = F.when(a_first, F.col("a")).otherwise(F.col("b"))
    inside = F.greatest("_a1", "_b1") <= F.when(a_first, F.col("_a2")).otherwise(F.col("_b2"))
    apart = ends.filter(~inside).select(
        *keys, F.col("_pair").alias("pair"), (F.least("_a1", "_b1") + 1).alias("lo"), F.greatest("_a1", "_b1").alias("hi")
    ).withColumn("from", F.floor(F.col("lo") / width)).withColumn("to", F.floor(F.col("hi") / width))
    ranges = written(apart, "ranges")
    one = ranges.filter(F.col("from") == F.col("to"))
    more = ranges.filter(F.col("from") < F.col("to"))
    # a piece that a range goes beyond is full
    asked = (
        one.select(*keys, "pair", F.col("from").alias("piece"), "lo", "hi")
        .unionByName(more.select(*keys, "pair", F.col("from").alias("piece"), "lo", ((F.col("from") + 1) * width - 1).alias("hi")))
        .unionByName(more.select(*keys, "pair", F.col("to").alias("piece"), (F.col("to") * width).alias("lo"), "hi"))
    )
    minima = _in_piece(labelled, asked, keys, width)
    middle = _between(
        labelled, more.filter(F.col("to") - F.col("from") > 1).select(
            *keys, "pair", (F.col("from") + 1).alias("from"), (F.col("to") - 1).alias("to")
        ), keys, width,
    )
    if middle is not None:
        minima = minima.unionByName(middle)
    lowest = minima.groupBy("pair").agg(F.min(F.struct("depth", "parent")).alias("low"))
    met = ends.join(lowest.withColumnRenamed("pair", "_pair"), "_pair", "left")
    return met.withColumn("ancestor", F.when(inside, upper).otherwise(F.col("low.parent"))).select(
        *pairs.columns, "ancestor"
    )


def common_ancestors(
    labelled: DataFrame, members: DataFrame, keys: Sequence[str], sets: Sequence[str], *, node: str
) -> DataFrame:
    """Rows ``keys, sets, ancestor``: the lowest common ancestor of all members of a set, that of
    its first and last ones in walking order."""
    keys, sets = list(keys), list(sets)
    at = members.select(*keys, *sets, node).join(labelled.select(*keys, node, "first"), [*keys, node])
    ends = at.groupBy(*keys, *sets).agg(F.min_by(node, "first").alias("a"), F.max_by(node, "first").alias("b"))
    return lowest_common(labelled, ends, keys, node=node).select(*keys, *sets, "ancestor")


def paths_below(
    labelled: DataFrame, members: DataFrame, keys: Sequence[str], sets: Sequence[str], *, node: str
) -> DataFrame:
    """Rows ``keys, sets, node``: the nodes on the ways from the common ancestor of a set to its
    members, each once.

    In walking order a member adds the nodes from itself up to where it leaves the member before
    it; the first one adds its way from the common ancestor on.  No other rows are made.  Sets
    whose members lie in different trees of a group have no rows.
    """
    keys, sets = list(keys), list(sets)
    at = members.select(*keys, *sets, node).distinct().join(
        labelled.select(*keys, node, "first", "depth"), [*keys, node]
    )
    top = common_ancestors(labelled, members, keys, sets, node=node).join(
        labelled.select(*keys, F.col(node).alias("ancestor"), F.col("depth").alias("_top")), [*keys, "ancestor"]
    )
    top = written(top, "tops-of-sets")
    at = at.join(top.select(*keys, *sets), [*keys, *sets], "left_semi")
    turn = accumulate(at, [*keys, *sets], ["first"], slice_by=id_slice("first"), number="_turn")
    turn = written(turn, "members")
    before = turn.select(*keys, *sets, (F.col("_turn") + 1).alias("_turn"), F.col(node).alias("b"))
    beside = lowest_common(
        labelled, turn.join(before, [*keys, *sets, "_turn"]).withColumnRenamed(node, "a"), keys, node=node
    )
    leaving = beside.join(
        labelled.select(*keys, F.col(node).alias("ancestor"), F.col("depth").alias("_left")), [*keys, "ancestor"]
    ).select(*keys, *sets, F.col("a").alias(node), (F.col("depth") - F.col("_left")).alias("_far"))
    opening = turn.filter("_turn = 1").join(top, [*keys, *sets]).select(
        *keys, *sets, node, (F.col("depth") - F.col("_top") + 1).alias("_far")
    )
    asked = written(leaving.unionByName(opening), "ways-asked")
    ways = ways_up(
        labelled, keys, node=node, parent=F.col("parent"), of=asked, most="_far"
    ).withColumnRenamed("ancestor", "_on")
    return asked.join(ways, [*keys, node]).filter("steps < _far").select(*keys, *sets, F.col("_on").alias(node))
