"""Sums along ways to the root, folds over subtrees and orders of branching, by contraction.

A forest is cut into pieces of bounded size: the nodes of one tree in one slice of the node
numbers.  Inside a piece every node is folded at once, chains and leaves alike; what is left of a
piece are its tops, the nodes whose parent lies in another piece.  The tops form a much smaller
forest that is folded in turn, and its totals are handed back to the pieces that hang on them.
A forest of trees that fit into a slice takes one exchange and no round at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructField, StructType

from arborframe.operators.core import Rounds, written

#: Node numbers in a slice, which bounds the nodes of a piece
WIDTH = 1 << 16
AT_LEAST = 1 << 16
JOINED = {"sum": np.add, "max": np.maximum, "min": np.minimum}
HOW = {"sum": F.sum, "max": F.max, "min": F.min}
BOTH: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least,
}


def is_root(parent: str = "parent_id") -> Column:
    return F.col(parent).isNull() | (F.col(parent) == -1)


def can_contract(nodes: DataFrame, node: str) -> bool:
    """Whether the nodes are named by whole numbers, which can be cut into slices."""
    return isinstance(nodes.schema[node].dataType, IntegralType)


# --- inside a piece -----------------------------------------------------------------------


class Piece:
    """Nodes of a block of pieces as arrays; ``parent`` is -1 where it is not in the piece."""

    def __init__(self, group: np.ndarray, node: np.ndarray, hop: np.ndarray, linked: np.ndarray):
        self.names, self.spread = np.unique(node), np.int64(len(np.unique(node)) + 1)
        self.own = self._coded(group, node)
        self.order = np.argsort(self.own, kind="stable")
        self.parent = np.where(linked, self.at(group, hop), -1)

    def _coded(self, group: np.ndarray, node: np.ndarray) -> np.ndarray:
        """One number for each tree, piece and node; the last one of a piece for unknown nodes."""
        place = np.minimum(np.searchsorted(self.names, node), max(len(self.names) - 1, 0))
        known = self.names[place] == node if len(self.names) else np.zeros(len(node), bool)
        return group * self.spread + np.where(known, place, self.spread - 1)

    def at(self, group: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Positions of the named nodes, -1 where the piece has none of the name."""
        if not len(self.own):
            return np.full(len(node), -1)
        wanted = self._coded(group, node)
        place = np.minimum(np.searchsorted(self.own[self.order], wanted), len(self.own) - 1)
        found = self.order[place]
        return np.where(self.own[found] == wanted, found, -1)

    def hops(self, live: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Nodes and the nodes 1, 2, 4, ... links above them, as long as there are any."""
        hop = self.parent.copy()
        if live is not None:  # nodes whose parents are live as well
            hop[~live] = -1
        while True:
            moving = np.flatnonzero(hop >= 0)
            if not len(moving):
                return
            above = hop[moving]
            yield moving, above
            hop[moving] = hop[above]

    def tops(self) -> np.ndarray:
        top = np.arange(len(self.parent))
        for moving, above in self.hops():
            top[moving] = above
            # the links above lead on from there
        return self._settled(top)

    def _settled(self, top: np.ndarray) -> np.ndarray:
        while True:
            further = top[top]
            if (further == top).all():
                return top
            top = further

    def up(self, values: np.ndarray) -> np.ndarray:
        """Values summed over a node and all nodes above it in its piece."""
        total = values.copy()
        for moving, above in self.hops():
            total[moving] += total[above]
        return total

    def below(self, values: np.ndarray, how: str, live: np.ndarray | None = None) -> np.ndarray:
        """Values folded over a node and all nodes below it in its piece."""
        total = values.copy()
        for moving, above in self.hops(live):
            JOINED[how].at(total, above, total[moving])
        return total

    def orders(self) -> np.ndarray:
        """Strahler orders: one more than the highest below where two children reach it."""
        order = np.ones(len(self.parent), np.int64)
        live = np.ones(len(self.parent), bool)
        while True:
            up = self.parent[live]
            kids = np.bincount(up[up >= 0], minlength=len(order))
            reached = self.below(((kids >= 2) & live).astype(np.int8), "max", live) > 0
            live &= reached
            if not live.any():
                return order
            order[live] += 1


def codes(*columns: np.ndarray) -> np.ndarray:
    """One number for each different row of the columns."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        _, own = np.unique(c, return_inverse=True)
        _, out = np.unique(out * (own.max() + 1 if len(own) else 1) + own, return_inverse=True)
    return out


def blocks(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """Whole pieces, several at a time; the batches come in the order of their pieces."""
    waiting, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(name).to_numpy()
        ends = np.flatnonzero(key[1:] != key[:-1]) + 1
        opens = not waiting or waiting[-1].column(name)[-1].as_py() != key[0]
        if opens and rows >= AT_LEAST:
            yield pa.Table.from_batches(waiting)
            waiting, rows = [], 0
        if len(ends) and rows + ends[-1] >= AT_LEAST:
            yield pa.Table.from_batches([*waiting, batch.slice(0, ends[-1])])
            batch, waiting, rows = batch.slice(ends[-1]), [], 0
        waiting.append(batch)
        rows += batch.num_rows
    if waiting:
        yield pa.Table.from_batches(waiting)


def _in_pieces(base: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Rows with the names of their tree and piece."""
    named = [F.col(k) for k in keys] or [F.lit(0)]
    return base.withColumns({
        "_tree": F.xxhash64(*named), "_tree2": F.xxhash64(F.lit("tree"), *named),
        "_piece": F.xxhash64(F.floor(F.col("_node") / F.lit(width)), *named),
    })


def _solved(
    base: DataFrame, keys: Sequence[str], up: Sequence[str], below: dict[str, str],
    reach: dict[str, str], orders: str | None,
) -> DataFrame:
    """Every node with its top and its values within the piece, from :func:`_in_pieces`."""
    kinds = {f.name: f for f in base.schema.fields}
    long = kinds["_node"].dataType
    fields = [kinds[k] for k in keys] + [StructField(c, long) for c in ("_node", "_hop", "_summit")]
    fields += [kinds[c] for c in [*up, *below, *reach]]
    if orders:
        fields.append(StructField(orders, long))
    schema = StructType([StructField(f.name, f.dataType) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_piece"):
            yield from solve(block.combine_chunks()).to_batches()

    def solve(block: pa.Table) -> pa.Table:
        number = lambda c: block.column(c).to_numpy()
        hop = block.column("_hop")
        linked = hop.is_valid().to_numpy()
        node, above = number("_node"), hop.fill_null(0).to_numpy()
        group = codes(number("_tree"), number("_tree2"), number("_piece"))
        piece = Piece(group, node, above, linked)
        made = {"_summit": node[piece.tops()]}
        for name in up:
            made[name] = piece.up(number(name))
        for name, how in below.items():
            made[name] = piece.below(number(name), how)
        for name, of in reach.items():
            made[name] = np.maximum(piece.below(made[of], "max") - made[of], 0)
        if orders:
            made[orders] = piece.orders()
        columns = []
        for field in schema.fields:
            kept = field.name not in made
            values = block.column(field.name) if kept else made[field.name]
            given = field.name in block.column_names
            kind = block.schema.field(field.name).type if given else pa.int64()
            columns.append(values if kept else pa.array(values, kind))
        return pa.Table.from_arrays(columns, names=schema.names)

    wanted = [*keys, "_node", "_hop", *up, *below, *reach, "_tree", "_tree2", "_piece"]
    ordered = base.select(*wanted).repartition("_piece").sortWithinPartitions("_piece")
    return ordered.mapInArrow(run, schema)


# --- ways through pieces -------------------------------------------------------------------


def ways_up(
    nodes: DataFrame, keys: Sequence[str], *, node: str, parent: Column, of: DataFrame | None = None,
    most: str | None = None, width: int = WIDTH, block: int = 1 << 18,
) -> DataFrame:
    """Rows ``keys, node, ancestor, steps``: the way from every node to its root, itself first.

    ``of`` restricts it to its distinct ``keys, node``; with ``most``, one of its columns, a way
    ends after so many nodes (the largest number, where a node has several).  A way goes through
    a piece in one task and only from piece to piece in rounds; no rows but those of the result
    are written.  A node that is not in the table has no way.
    """
    keys = list(keys)
    own = _in_pieces(
        nodes.select(*keys, F.col(node).cast("bigint").alias("_node"), parent.cast("bigint").alias("_hop")),
        keys, width,
    )
    own = own.select(
        *keys, "_node", "_hop", F.lit(0).alias("_role"), *[F.lit(None).cast("bigint").alias(c) for c in _WALK],
        "_tree", "_tree2", "_piece",
    )
    at = F.col(node).cast("bigint")
    far = F.max(F.col(most).cast("bigint")) if most else F.max(F.lit(None).cast("bigint"))
    walkers = (of if of is not None else nodes).groupBy(*keys, at.alias("_node")).agg(far.alias("_left")).select(
        *keys, "_node", F.col("_node").alias("_start"), F.lit(0).cast("bigint").alias("_steps"), "_left"
    )
    fields = [StructField(f.name, f.dataType) for f in own.select(*keys).schema.fields]
    fields += [StructField(c, own.schema["_node"].dataType) for c in ("_start", "ancestor", "_steps", "_next", "_left")]
    schema = StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "_piece"):
            yield from walk(table.combine_chunks())

    def walk(table: pa.Table) -> Iterator[pa.RecordBatch]:
        number = lambda c: table.column(c).fill_null(0).to_numpy()
        group = codes(number("_tree"), number("_tree2"), number("_piece"))
        walking = number("_role") == 1
        tree = np.flatnonzero(~walking)
        hop, linked = number("_hop")[tree], table.column("_hop").is_valid().to_numpy()[tree]
        piece = Piece(group[tree], number("_node")[tree], hop, linked)
        row = np.flatnonzero(walking)
        here = piece.at(group[row], number("_node")[row])
        row, here = row[here >= 0], here[here >= 0]
        names = number("_node")[tree]
        start, steps = number("_start")[row], number("_steps")[row]
        left = np.where(table.column("_left").is_valid().to_numpy()[row], number("_left")[row], np.iinfo(np.int64).max)
        made, held = [], 0
        while len(row):
            going = left > 0
            row, here, start, steps, left = (c[going] for c in (row, here, start, steps, left))
            made.append((row, start, names[here], steps, np.full(len(row), -1), left))
            held += len(row)
            above = piece.parent[here]
            # where the parent lies in another piece, the walk goes on there
            out = (above < 0) & linked[here] & (left > 1)
            made.append((row[out], start[out], np.full(out.sum(), -1), steps[out] + 1, hop[here[out]], left[out] - 1))
            stay = above >= 0
            row, here, start, steps, left = row[stay], above[stay], start[stay], steps[stay] + 1, left[stay] - 1
            if held > block:
                yield rows(table, made)
                made, held = [], 0
        if made:
            yield rows(table, made)

    def rows(table: pa.Table, made: list[tuple]) -> pa.RecordBatch:
        row, start, ancestor, steps, onward, left = (np.concatenate(c) for c in zip(*made))
        more = ancestor_missing(made)
        columns = [table.column(k).take(pa.array(row)).combine_chunks() for k in keys]
        endless = left >= np.iinfo(np.int64).max // 2
        columns += [
            pa.array(start), pa.array(ancestor, mask=more), pa.array(steps), pa.array(onward, mask=~more),
            pa.array(left, mask=endless),
        ]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def ancestor_missing(made: list[tuple]) -> np.ndarray:
        """Rows that go on in another piece: every second part of what was made."""
        return np.concatenate([np.full(len(m[0]), k % 2 == 1) for k, m in enumerate(made)])

    found = None
    while True:
        sent = _in_pieces(walkers, keys, width).select(
            *keys, "_node", F.lit(None).cast("bigint").alias("_hop"), F.lit(1).alias("_role"), *_WALK,
            "_tree", "_tree2", "_piece",
        )
        met = own if found is None else own.join(sent.select("_piece").distinct(), "_piece", "left_semi").select(*own.columns)
        dealt = met.unionByName(sent).repartition("_piece").sortWithinPartitions("_piece")
        walked = written(dealt.mapInArrow(run, schema), "ways")
        part = walked.filter(F.col("_next").isNull())
        found = part if found is None else found.unionByName(part)
        walkers = walked.filter(F.col("_next").isNotNull()).select(
            *keys, F.col("_next").alias("_node"), "_start", "_steps", "_left"
        )
        if walkers.isEmpty():
            return found.select(*keys, F.col("_start").alias(node), "ancestor", F.col("_steps").alias("steps"))


_WALK = ("_start", "_steps", "_left")


# --- the forest of tops -------------------------------------------------------------------


def doubled(
    forest: DataFrame, keys: Sequence[str], up: Sequence[str], below: dict[str, str]
) -> DataFrame:
    """The same sums and folds over rows ``keys, _node, _hop, values`` by doubling the hops, with
    the root of every node as ``_summit``; for forests that slices do not make smaller."""
    keys = list(keys)
    rounds = Rounds(forest.sparkSession, "doubled")
    state = rounds.cut(
        forest.select(*keys, "_node", "_hop", F.coalesce("_hop", "_node").alias("_summit"), *up, *below),
        watch=F.col("_hop").isNotNull(),
    )
    while rounds.pending:
        rounds.next()
        far = state.select(
            *keys, F.col("_node").alias("_hop"), F.col("_hop").alias("_far"), F.col("_summit").alias("_beyond"),
            *[F.col(n).alias(f"_f_{n}") for n in up],
        )
        moving = F.col("_hop").isNotNull()
        # nodes that have arrived are not joined again
        grown = state.filter(moving).join(far, [*keys, "_hop"]).select(
            *keys, "_node", F.col("_far").alias("_hop"), F.coalesce("_beyond", "_summit").alias("_summit"),
            *[(F.col(n) + F.col(f"_f_{n}")).alias(n) for n in up], *below,
        ).unionByName(state.filter(~moving))
        if below:
            lower = state.filter(moving).groupBy(*keys, F.col("_hop").alias("_node")).agg(
                *[HOW[how](n).alias(f"_b_{n}") for n, how in below.items()]
            )
            grown = grown.join(lower, [*keys, "_node"], "left").select(
                *keys, "_node", "_hop", "_summit", *up,
                *[BOTH[how](F.col(n), F.col(f"_b_{n}")).alias(n) for n, how in below.items()],
            )
        state = rounds.cut(grown, watch=F.col("_hop").isNotNull())
    return state


def climb(
    nodes: DataFrame, keys: Sequence[str], *, node: str, parent: Column,
    up: dict[str, Column] | None = None, below: dict[str, tuple[str, Column]] | None = None,
    reach: dict[str, str] | None = None, orders: str | None = None, width: int = WIDTH,
) -> DataFrame:
    """Rows ``keys, node, _summit`` with all sums and folds of a forest; ``_summit`` is the root.

    ``parent`` is NULL at a root, ``up``, ``below`` and ``reach`` are as in
    :func:`arborframe.operators.trees.fold`, ``orders`` names a column for Strahler orders, which
    is NULL in trees of more than one piece.  Nodes are whole numbers, each once in its tree; a
    parent that is not in the table counts as a node above a root.  Values are not NULL.
    """
    up, below, reach = up or {}, below or {}, reach or {}
    keys, kinds = list(keys), {n: how for n, (how, _) in below.items()}
    whole_numbers = can_contract(nodes, node)
    kind = "bigint" if whole_numbers else nodes.schema[node].dataType
    base = nodes.select(
        *keys, F.col(node).cast(kind).alias("_node"), parent.cast(kind).alias("_hop"),
        *[v.alias(n) for n, v in up.items()], *[v.alias(n) for n, (_, v) in below.items()],
        *[F.lit(0.0).alias(n) for n in reach],
    )
    named = [*keys, F.col("_node").alias(node), "_summit", *up, *below, *reach, *([orders] if orders else [])]
    if not whole_numbers:
        if orders:
            raise ValueError("orders need nodes named by whole numbers")
        whole = doubled(base, keys, list(up), kinds).withColumns({n: F.lit(0.0) for n in reach})
        return _reached(whole, nodes, keys, node, parent, reach, width).select(*named)
    base = _in_pieces(base, keys, width)
    local = written(_solved(base, keys, list(up), kinds, reach, orders), "pieces")
    at_top = F.col("_node") == F.col("_summit")
    cut = local.filter(at_top & F.col("_hop").isNotNull())
    if cut.isEmpty():
        return local.select(*named)
    # every top hangs on a node of another piece, and so on the top of that one
    hold = local.select(
        *keys, F.col("_node").alias("_hop"), F.col("_summit").alias("_at"), *[F.col(n).alias(f"_u_{n}") for n in up]
    )
    hung = written(local.filter(at_top).drop("_summit", *reach).join(hold, [*keys, "_hop"], "left"), "tops")
    zero = {n: F.lit(0).cast(local.schema[n].dataType) for n in up}
    totals = doubled(
        hung.select(
            *keys, "_node", F.col("_at").alias("_hop"),
            *[F.coalesce(f"_u_{n}", zero[n]).alias(n) for n in up], *below,
        ),
        keys, list(up), kinds,
    )
    above = totals.select(
        *keys, F.col("_node").alias("_summit"), F.col("_summit").alias("_root"), *[F.col(n).alias(f"_a_{n}") for n in up]
    )
    whole = local.join(above, [*keys, "_summit"], "left").select(
        *keys, "_node", F.coalesce("_root", "_summit").alias("_summit"),
        *[(F.col(n) + F.coalesce(f"_a_{n}", zero[n])).alias(n) for n in up], *below,
        *([F.col(orders)] if orders else []),
    )
    if below:
        # what hangs on a node counts as its own, and its piece is folded again
        hanging = hung.filter(F.col("_at").isNotNull()).select(*keys, "_node", F.col("_hop").alias("_on"))
        added = _in_pieces(
            hanging.join(totals.select(*keys, "_node", *below), [*keys, "_node"])
            .groupBy(*keys, F.col("_on").alias("_node"))
            .agg(*[HOW[how](n).alias(f"_b_{n}") for n, how in kinds.items()]),
            keys, width,
        )
        added = written(added, "hanging")
        again = base.join(added.select("_piece").distinct(), "_piece", "left_semi").drop(*up, *reach)
        again = again.join(added.select(*keys, "_node", *[f"_b_{n}" for n in below]), [*keys, "_node"], "left")
        again = again.select(
            *keys, "_node", "_hop", "_tree", "_tree2", "_piece",
            *[BOTH[how](F.col(n), F.col(f"_b_{n}")).alias(n) for n, how in kinds.items()],
        )
        fresh = _solved(again, keys, [], kinds, {}, None).select(
            *keys, "_node", *[F.col(n).alias(f"_n_{n}") for n in below]
        )
        whole = whole.join(fresh, [*keys, "_node"], "left").withColumns(
            {n: F.coalesce(f"_n_{n}", n) for n in below}
        )
    if orders:
        split = hung.filter(F.col("_at").isNotNull()).select(*keys, F.lit(True).alias("_split")).distinct()
        if keys:
            whole = whole.join(split, keys, "left")
        else:
            whole = whole.withColumn("_split", F.lit(None if split.isEmpty() else True))
        whole = whole.withColumn(orders, F.when(F.col("_split").isNull(), F.col(orders))).drop("_split")
    whole = written(whole.withColumns({n: F.lit(0.0) for n in reach}), "climbed")
    return _reached(whole, nodes, keys, node, parent, reach, width).select(*named)


def _reached(
    whole: DataFrame, nodes: DataFrame, keys: list[str], node: str, parent: Column,
    reach: dict[str, str], width: int,
) -> DataFrame:
    """The largest sum below a node less its own, for the names in ``reach``."""
    if not reach:
        return whole
    sums = whole.select(*keys, F.col("_node").alias(node), *[F.col(of).alias(f"_s_{n}") for n, of in reach.items()])
    far = climb(
        nodes.select(*keys, node, parent.alias("_up_to")).join(sums, [*keys, node]), keys,
        node=node, parent=F.col("_up_to"), width=width,
        below={n: ("max", F.col(f"_s_{n}")) for n in reach},
    ).select(*keys, F.col(node).alias("_node"), *[F.col(n).alias(f"_s_{n}") for n in reach])
    return whole.join(far, [*keys, "_node"]).withColumns(
        {n: F.greatest(F.col(f"_s_{n}") - F.col(of), F.lit(0.0)) for n, of in reach.items()}
    )
