"""Ways, trees and tours of whole graphs inside tasks, the graphs of a block at a time.

Most graphs, such as the candidates of one axon, are small.  Their rows move once, by graph; what
goes on in rounds, a job each, for a graph that does not fit into a task goes on in rounds over
arrays here.  Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DoubleType, IntegralType, LongType, StructField, StructType,
)

from arborframe.operators.contraction import blocks, codes
from arborframe.operators.core import written

#: Most edges of a graph that is kept whole in a task
MOST_EDGES = 1 << 18

GROUP = ("_group", "_group2")
FAR = np.iinfo(np.int64).max


def too_large(edges: DataFrame, keys: Sequence[str], odd: Column, most: int) -> DataFrame | None:
    """Keys of graphs with more than ``most`` edges or an ``odd`` one, if there are any."""
    sizes = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(odd).alias("_odd"))
    large = written(sizes.filter((F.col("_n") > most) | F.col("_odd")).select(*keys), "large-graphs")
    return None if large.isEmpty() else large


def split(df: DataFrame, large: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the graphs that stay in tasks, and of the others."""
    return df.join(large, list(keys), "left_anti"), df.join(large, list(keys), "left_semi")


def whole_numbers(df: DataFrame, names: Sequence[str]) -> bool:
    return all(isinstance(df.schema[n].dataType, IntegralType) for n in names)


def in_blocks(rows: DataFrame, keys: Sequence[str], schema: StructType, solve: Callable[[pa.Table], list]) -> DataFrame:
    """``solve`` over blocks of whole graphs: it returns the columns after the keys, and before
    them the rows whose keys they have."""
    named = [F.col(k) for k in keys] or [F.lit(0)]
    # numbered after the exchange, so that the two numbers do not move
    dealt = rows.repartition(*named).withColumns(
        {GROUP[0]: F.xxhash64(*named), GROUP[1]: F.xxhash64(F.lit("group"), *named)}
    ).sortWithinPartitions(*GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, GROUP[0]):
            at, *made = solve(block.combine_chunks())
            if len(at):
                columns = [block.column(k).take(pa.array(at)) for k in keys] + made
                yield from pa.Table.from_arrays(columns, names=schema.names).to_batches()

    return dealt.mapInArrow(run, schema)


def _fields(df: DataFrame, names: Sequence[str]) -> list[StructField]:
    return [StructField(n, df.schema[n].dataType) for n in names]


def numbers(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name)
    return column.fill_null(0).to_numpy() if column.null_count else column.to_numpy()


def numbered_nodes(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of every (graph, id), ascending by id inside a graph, and the id of every number."""
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    new = np.append(True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])) if len(order) else np.zeros(0, bool)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, i[new]


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the rows ``a`` and ``b`` were joined; a label is a row that is its own."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := label[label], label):
            label = further


def joined(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Components of edges (keys, u, v): (keys, id, component), the smallest id as label."""
    keys = list(keys)
    kind = edges.schema["u"].dataType
    schema = StructType(_fields(edges, keys) + [StructField(c, kind) for c in ("id", "component")])

    def solve(block: pa.Table) -> list:
        group = codes(*(numbers(block, c) for c in GROUP))
        place, ids = numbered_nodes(np.append(group, group), np.append(numbers(block, "u"), numbers(block, "v")))
        u, v = np.split(place, 2)
        label = merged(np.arange(len(ids)), u, v)
        home = np.empty(len(ids), np.int64)
        home[place] = np.tile(np.arange(len(group)), 2)
        number = block.schema.field("u").type
        return [home, pa.array(ids, number), pa.array(ids[label], number)]

    return in_blocks(edges.dropna(subset=keys), keys, schema, solve)


def cheapest(
    u: np.ndarray, v: np.ndarray, weight: np.ndarray, sources: np.ndarray, n: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost, number of edges and node before it of every node; ``FAR`` edges where none leads.

    Only nodes whose way changed in the last round pass it on.  Of equal costs the fewer edges
    count, then the smaller node before.
    """
    order = np.argsort(u, kind="stable")
    v, weight = v[order], weight[order]
    degree = np.bincount(u, minlength=n)
    start = np.cumsum(degree) - degree
    cost, hops, before = np.full(n, np.inf), np.full(n, FAR), np.full(n, -1)
    fresh = np.unique(sources)
    cost[fresh], hops[fresh] = 0.0, 0
    while len(fresh):
        out = degree[fresh]
        arc = np.repeat(start[fresh] - np.cumsum(out) + out, out) + np.arange(out.sum())
        to, by = v[arc], np.repeat(fresh, out)
        c, h = cost[by] + weight[arc], hops[by] + 1
        have = cost[to]
        better = (c < have) | ((c == have) & ((h < hops[to]) | ((h == hops[to]) & (by < before[to]))))
        to, by, c, h = to[better], by[better], c[better], h[better]
        first = np.lexsort((by, h, c, to))
        first = first[np.append(True, to[first][1:] != to[first][:-1])] if len(first) else first
        fresh = to[first]
        cost[fresh], hops[fresh], before[fresh] = c[first], h[first], by[first]
    return cost, hops, before


def ways(edges: DataFrame, sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cheapest ways from the sources: (keys, id, cost, previous), previous -1 at a source."""
    keys = list(keys)
    none = F.lit(None).cast("bigint")
    rows = edges.dropna(subset=keys).select(
        *keys, F.col("from").cast("bigint").alias("_u"), F.col("to").cast("bigint").alias("_v"),
        F.col("weight").cast("double").alias("_w"),
    ).unionByName(sources.select(
        *keys, F.col("id").cast("bigint").alias("_u"), none.alias("_v"), F.lit(None).cast("double").alias("_w")
    ))
    schema = StructType(
        _fields(edges, keys) + [StructField("id", LongType()), StructField("cost", DoubleType()), StructField("previous", LongType())]
    )

    def solve(block: pa.Table) -> list:
        group = codes(*(numbers(block, c) for c in GROUP))
        edge = block.column("_v").is_valid().to_numpy()
        e, s = np.flatnonzero(edge), np.flatnonzero(~edge)
        row = np.concatenate([e, e, s])
        place, ids = numbered_nodes(group[row], np.concatenate([numbers(block, "_u")[e], numbers(block, "_v")[e], numbers(block, "_u")[s]]))
        u, v, source = np.split(place, [len(e), 2 * len(e)])
        weight = numbers(block, "_w")[e]
        cost, hops, before = cheapest(np.append(u, v), np.append(v, u), np.append(weight, weight), source, len(ids))
        home = np.empty(len(ids), np.int64)
        home[place] = row
        met = np.flatnonzero(hops < FAR)
        previous = np.where(before >= 0, ids[before], -1)
        return [home[met], pa.array(ids[met]), pa.array(cost[met]), pa.array(previous[met])]

    return in_blocks(rows, keys, schema, solve)


def trees(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows ``keys, id``, a node on a cheapest way from a source to a terminal, and of the edge it is
    reached by all columns, ``parent``, ``child`` and terminal id and flag of both ends.

    These are NULL where no edge leads to the node.
    """
    keys = list(keys)
    own = [c for c in edges.columns if c not in keys]
    node = {"_id": "bigint", "_source": "boolean", "_terminal": "boolean", "_tid": nodes.schema["terminal_id"].dataType}
    kinds = edges.schema
    rows = edges.dropna(subset=keys).select(*keys, *own, *[F.lit(None).cast(t).alias(c) for c, t in node.items()]).unionByName(
        nodes.dropna(subset=keys).select(
            *keys, *[F.lit(None).cast(kinds[c].dataType).alias(c) for c in own], F.col("id").cast("bigint").alias("_id"),
            (F.col("provider") == "source").alias("_source"), F.col("is_terminal").alias("_terminal"),
            F.col("terminal_id").alias("_tid"),
        )
    )
    ends = [f"{side}_{c}" for side in ("source", "target") for c in ("terminal_id", "is_terminal")]
    schema = StructType(
        _fields(edges, keys) + [StructField("id", LongType())] + _fields(edges, own)
        + [StructField(c, LongType()) for c in ("parent", "child")]
        + [StructField(c, node["_tid"] if c.endswith("id") else BooleanType()) for c in ends]
    )

    def solve(block: pa.Table) -> list:
        group = codes(*(numbers(block, c) for c in GROUP))
        is_node = block.column("_id").is_valid().to_numpy()
        e, d = np.flatnonzero(~is_node), np.flatnonzero(is_node)
        row = np.concatenate([e, e, d])
        place, ids = numbered_nodes(group[row], np.concatenate([numbers(block, "from")[e], numbers(block, "to")[e], numbers(block, "_id")[d]]))
        u, v, known = np.split(place, [len(e), 2 * len(e)])
        n = len(ids)
        weight = numbers(block, "weight")[e]
        flag = lambda c: block.column(c).fill_null(False).to_numpy()[d]
        _, hops, before = cheapest(
            np.append(u, v), np.append(v, u), np.append(weight, weight), known[flag("_source")], n
        )
        listed, used = np.full(n, -1), np.zeros(n, bool)
        listed[known] = d
        marked = (hops < FAR) & (listed >= 0)
        up = known[flag("_terminal")]
        up = np.unique(up[marked[up]])
        while len(up):
            used[up] = True
            up = np.unique(before[up])
            up = up[up >= 0]
            up = up[marked[up] & ~used[up]]
        met = np.flatnonzero(used)
        # parallel edges: the cheapest one carries the way
        pair = np.minimum(u, v) * n + np.maximum(u, v)
        order = np.lexsort((u, weight, pair))
        pair = pair[order]
        top = before[met]
        joined = np.minimum(met, top) * n + np.maximum(met, top)
        at = np.searchsorted(pair, joined)
        linked = (top >= 0) & (np.where(top >= 0, listed[top], -1) >= 0) & (np.where(top >= 0, ids[top], -1) >= 0)
        at = np.where(linked, order[np.minimum(at, max(len(order) - 1, 0))] if len(order) else 0, 0)
        bare = ~linked
        edge = pa.array(e[at] if len(e) else at, mask=bare)
        columns = [block.column(c).take(edge) for c in own]
        columns += [pa.array(ids[top], mask=bare), pa.array(ids[met], mask=bare)]
        for end in (u, v):
            spot = pa.array(listed[end[at]] if len(e) else at, mask=bare)
            columns += [block.column(c).take(spot) for c in ("_tid", "_terminal")]
        return [listed[met], pa.array(ids[met]), *columns]

    return in_blocks(rows, keys, schema, solve)


def toured(
    group: np.ndarray, first: np.ndarray, second: np.ndarray, root: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Whether each edge is walked down from ``first`` to ``second``, and its place among the
    downward steps of its tree, from 1.

    Each edge is walked down and up again; after u -> v comes v -> w, w being the neighbour after u
    around v, or the first one.
    """
    n = len(first)
    place, ids = numbered_nodes(np.append(group, group), np.append(first, second))
    a, b = place, np.roll(place, n)
    order = np.lexsort((b, a))
    at = np.empty(2 * n, np.int64)
    at[order] = np.arange(2 * n)
    degree = np.bincount(a, minlength=len(ids))
    start = np.cumsum(degree) - degree
    back = at[np.roll(np.arange(2 * n), n)]  # where v -> u stands
    last = back == start[b] + degree[b] - 1
    following = order[np.where(last, start[b], np.minimum(back + 1, 2 * n - 1))]
    # the tour ends where it would return to the first step out of the root
    goes_on = ~(last & (ids[b] == np.append(root, root)))
    hop, steps = np.where(goes_on, following, -1), goes_on.astype(np.int64)
    moving, reach = np.flatnonzero(goes_on), 1
    while len(moving):
        if reach > 4 * n:
            raise ValueError("the edges of a group are not one tree around its root")
        above = hop[moving]
        steps[moving] += steps[above]
        hop[moving] = hop[above]
        moving, reach = moving[hop[moving] >= 0], 2 * reach
    down = steps[:n] > steps[n:]
    rank = np.lexsort((-np.maximum(steps[:n], steps[n:]), group))
    g = group[rank]
    opens = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if n else np.zeros(0, np.int64)
    position = np.empty(n, np.int64)
    position[rank] = np.arange(n) - np.repeat(opens, np.diff(np.append(opens, n))) + 1
    return down, position


def oriented(edges: DataFrame, keys: Sequence[str], root: Column) -> DataFrame:
    """Edges of trees as seen from the root: (keys, from, to, parent, child, reversed_edge, position)."""
    keys = list(keys)
    rows = edges.dropna(subset=keys).select(*keys, "from", "to", root.alias("_root"))
    schema = StructType(
        _fields(edges, [*keys, "from", "to"]) + [StructField(c, LongType()) for c in ("parent", "child")]
        + [StructField("reversed_edge", BooleanType()), StructField("position", LongType())]
    )

    def solve(block: pa.Table) -> list:
        group = codes(*(numbers(block, c) for c in GROUP))
        first, second = (numbers(block, c).astype(np.int64) for c in ("from", "to"))
        down, position = toured(group, first, second, numbers(block, "_root"))
        made = [np.where(down, first, second), np.where(down, second, first), ~down, position]
        return [np.arange(len(first)), block.column("from"), block.column("to"), *(pa.array(m) for m in made)]

    return in_blocks(rows, keys, schema, solve)
