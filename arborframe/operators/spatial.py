"""Distance joins: pairs within a radius, nearest points, components, thinning.

All of them turn distance into equality of grid cells and keep dense places from growing
quadratically: cells that are too full are salted, split further, or stood for by one member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arborframe.functions import geometry as geo
from arborframe.operators import whole_graphs as W
from arborframe.operators.components import components
from arborframe.operators.contraction import codes
from arborframe.operators.core import Rounds, written

CELL = ("_cx", "_cy", "_cz")


def _cells(side: float | Column, names: Sequence[str] = CELL) -> list[Column]:
    step = F.lit(float(side)) if isinstance(side, (int, float)) else side
    return [F.floor(F.col(a) / step).alias(n) for a, n in zip(geo.AXES, names)]


def _offsets(reach: int, *, forward_only: bool) -> list[tuple[int, int, int]]:
    span = range(-reach, reach + 1)
    every = [(a, b, c) for a in span for b in span for c in span]
    return [o for o in every if o > (0, 0, 0)] if forward_only else every


def _shifted(df: DataFrame, offsets: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Copies of the rows, one per offset, with their cell moved by it.

    The planner takes an explode for as small as its input, so the copies are never broadcast.
    """
    listed = F.array(
        *[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, ("a", "b", "c"))]) for o in offsets]
    )
    out = df.withColumn("_o", F.explode(listed))
    for name, part in zip(CELL, ("a", "b", "c")):
        out = out.withColumn(name, F.col(name) + F.col(f"_o.{part}"))
    return out.drop("_o").hint("merge")


def pairs_within(
    points: DataFrame, keys: Sequence[str], radius: float, *, node: str = "id", crowd: int = 4096
) -> DataFrame:
    """Pairs of points of a group at most ``radius`` apart: (keys, a, b, distance), a < b.

    A cell as wide as the radius meets itself and 13 of its neighbours.  Rows of a cell with
    more than ``crowd`` points are spread over several salts, against which the other side is
    repeated, so no task receives a whole crowded cell.
    """
    keys = list(keys)
    base = points.select(*keys, F.col(node).alias("_id"), *geo.AXES, *_cells(radius))
    salts = base.groupBy(*keys, *CELL).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(crowd)).cast("int").alias("_salts")
    )
    left = base.join(salts, [*keys, *CELL]).withColumn(
        "_salt", F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int")
    ).drop("_salts")
    ahead = [(0, 0, 0), *_offsets(1, forward_only=True)]
    back = [tuple(-v for v in o) for o in ahead]
    right = base.withColumn("_own", F.struct(*CELL))
    right = _shifted(right, back).join(salts, [*keys, *CELL]).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    )
    right = right.select(
        *keys, *CELL, "_salt", F.col("_id").alias("_rid"),
        (F.col("_own") == F.struct(*CELL)).alias("_same"),
        *[F.col(a).alias(f"_r{a}") for a in geo.AXES],
    )
    dist = geo.distance(list(geo.AXES), ["_rx", "_ry", "_rz"])
    return (
        left.join(right.hint("merge"), [*keys, *CELL, "_salt"])
        .filter((~F.col("_same")) | (F.col("_id") < F.col("_rid")))
        .withColumn("distance", dist)
        .filter(F.col("distance") <= radius)
        .select(
            *keys, F.least("_id", "_rid").alias("a"), F.greatest("_id", "_rid").alias("b"),
            "distance",
        )
    )


def label_all(
    nodes: DataFrame, found: DataFrame, keys: Sequence[str], *, node: str = "id"
) -> DataFrame:
    """Every node with its component; a node without edges is its own."""
    lab = found.select(*keys, F.col("id").alias(node), "component")
    return nodes.join(lab, [*keys, node], "left").withColumn(
        "component", F.coalesce("component", node)
    )


def _box(prefix: str = "") -> list[Column]:
    return [F.min(a).alias(f"{prefix}{a}0") for a in geo.AXES] + [
        F.max(a).alias(f"{prefix}{a}1") for a in geo.AXES
    ]


def _box_gap(p: str, q: str) -> tuple[Column, Column]:
    """Squared smallest and largest distance between two boxes of columns."""
    near, far = [], []
    for a in geo.AXES:
        lo = F.greatest(
            F.col(f"{p}{a}0") - F.col(f"{q}{a}1"), F.col(f"{q}{a}0") - F.col(f"{p}{a}1"), F.lit(0.0)
        )
        hi = F.greatest(
            F.col(f"{p}{a}1") - F.col(f"{q}{a}0"), F.col(f"{q}{a}1") - F.col(f"{p}{a}0")
        )
        near.append(lo)
        far.append(hi)
    return geo.dot(near, near), geo.dot(far, far)


#: Most points of a group that are linked inside a task, and pairs that are held there at a time
CLOSE_SMALL, CLOSE_PAIRS = 8192, 1 << 20


def close_components(
    points: DataFrame, keys: Sequence[str], radius: float, *, node: str = "id",
    crowd: int = 1 << 14, carry: Sequence[str] = (), small: int = CLOSE_SMALL,
) -> DataFrame:
    """Components of the graph that links points at most ``radius`` apart, without its edges.

    Returns (keys, node, component) for every point, the smallest id as label, with the columns
    ``carry`` of the points.  Groups of at most ``small`` points are linked inside tasks, larger
    ones over cells.  ``points`` is read twice, and the ids of a group are unique.
    """
    keys, carry = list(keys), list(carry)
    if not (keys and W.whole_numbers(points, [node])):
        return _close_over_cells(points, keys, radius, node=node, crowd=crowd, carry=carry)
    # the difference is no number where the place is none, or without end
    odd = F.col(node).isNull()
    for a in geo.AXES:
        odd = odd | F.coalesce(F.isnan((F.col(a) - F.col(a)).cast("double")), F.lit(True))
    large = W.too_large(points, keys, odd, small)
    if large is None:
        return _close_in_tasks(points, keys, radius, node=node, carry=carry)
    here, there = W.split(points, large, keys)
    wide = _close_over_cells(there, keys, radius, node=node, crowd=crowd, carry=carry)
    return _close_in_tasks(here, keys, radius, node=node, carry=carry).unionByName(wide)


def linked(group: np.ndarray, spots: np.ndarray, limit: float) -> np.ndarray:
    """First row of the component of every row; rows of a group follow each other."""
    n = len(group)
    label, at = np.arange(n), np.arange(n)
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, n)
    end = np.repeat(ends, np.diff(np.append(0, ends)))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    held, step = 0, 1
    while True:
        at = at[at + step < end[at]]
        if len(at):
            x, y, z = (spots[at] - spots[at + step]).T
            near = at[x * x + y * y + z * z <= limit]
            pairs.append((near, near + step))
            held += len(near)
        if pairs and (held > CLOSE_PAIRS or not len(at)):
            a, b = (np.concatenate(c) for c in zip(*pairs))
            label, pairs, held = W.merged(label, a, b), [], 0
        if not len(at):
            return label
        step += 1


def _close_in_tasks(
    points: DataFrame, keys: Sequence[str], radius: float, *, node: str, carry: Sequence[str]
) -> DataFrame:
    """:func:`close_components` for groups that fit into a task: one exchange, all pairs of a group."""
    spots = [F.col(a).cast("double").alias(f"_{a}") for a in geo.AXES]
    rows = points.dropna(subset=list(keys)).select(*keys, node, *carry, *spots)
    kinds = [points.schema[c] for c in (*keys, node)]
    schema = StructType(kinds).add("component", points.schema[node].dataType)
    for c in carry:
        schema.add(points.schema[c])
    limit = float(radius) * float(radius)

    def solve(block: pa.Table) -> list:
        group, ids = codes(*(W.numbers(block, c) for c in W.GROUP)), W.numbers(block, node)
        order = np.lexsort((ids, group))
        spots = np.stack([W.numbers(block, f"_{a}") for a in geo.AXES], 1)
        first = order[linked(group[order], spots[order], limit)]
        return [order, *(block.column(node).take(pa.array(at)) for at in (order, first)),
                *(block.column(c).take(pa.array(order)) for c in carry)]

    return W.in_blocks(rows, keys, schema, solve)


def _close_over_cells(
    points: DataFrame, keys: Sequence[str], radius: float, *, node: str, crowd: int, carry: Sequence[str] = ()
) -> DataFrame:
    """:func:`close_components` for groups of any size.

    Points that share a cell of diagonal ``radius`` are linked anyway, so one vertex stands for
    each cell.  Two cells are compared by their tight boxes; only what the boxes leave open goes
    on, split into halves while the two sides have more than ``crowd`` pairs, and compared point
    by point below that.
    """
    keys = list(keys)
    if carry:
        own = points.select(*keys, node, *carry)
        return _close_over_cells(points, keys, radius, node=node, crowd=crowd).join(own, [*keys, node])
    spark = points.sparkSession
    limit = float(radius) * float(radius)
    side = float(radius) / math.sqrt(3.0) * (1.0 - 1e-9)
    base = written(
        points.select(*keys, F.col(node).alias("_id"), *geo.AXES, *_cells(side)), "close-points"
    )
    grouped = base.groupBy(*keys, *CELL).agg(
        F.min("_id").alias("_cell"), F.count(F.lit(1)).alias("_n"), *_box()
    )
    cells = written(grouped, "close-cells")
    p = cells.select(*keys, *CELL, *[F.col(c).alias(f"_p{c}") for c in cells.columns if c not in (*keys, *CELL)])
    q = cells.select(*keys, *CELL, *[F.col(c).alias(f"_q{c}") for c in cells.columns if c not in (*keys, *CELL)])
    near, far = _box_gap("_p", "_q")
    cand = written(
        _shifted(p, _offsets(2, forward_only=True)).join(q, [*keys, *CELL])
        .withColumn("_near", near).withColumn("_far", far)
        .filter(F.col("_near") <= limit)
        .select(
            *keys, F.col("_p_cell").alias("a"), F.col("_q_cell").alias("b"),
            (F.col("_p_n") * F.col("_q_n")).alias("_pairs"), (F.col("_far") <= limit).alias("_sure"),
        ),
        "close-pairs",
    )
    sure = cand.filter("_sure").select(*keys, "a", "b")
    open_pairs = cand.filter(~F.col("_sure"))
    member = base.join(cells.select(*keys, *CELL, "_cell"), [*keys, *CELL]).select(
        *keys, "_cell", "_id", *geo.AXES
    )
    # crowded cells: descend into halves of the cell until boxes decide or few pairs are left
    todo = open_pairs.filter(F.col("_pairs") > crowd).select(*keys, "a", "b")
    small = open_pairs.filter(F.col("_pairs") <= crowd).select(*keys, "a", "b")
    links = [sure, _touching(member, small, keys, limit)]
    if todo.limit(1).count():
        links.append(_descend(spark, member, todo, keys, limit, side, crowd))
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    found = components(edges, keys)
    joined = member.join(
        found.select(*keys, F.col("id").alias("_cell"), "component"), [*keys, "_cell"], "left"
    )
    return joined.select(
        *keys, F.col("_id").alias(node), F.coalesce("component", "_cell").alias("component")
    )


def _touching(member: DataFrame, pairs: DataFrame, keys: Sequence[str], limit: float) -> DataFrame:
    """Pairs of cells with at least one pair of points close enough (few points per cell)."""
    one = member.select(*keys, F.col("_cell").alias("a"), *[F.col(a).alias(f"_p{a}") for a in geo.AXES])
    two = member.select(*keys, F.col("_cell").alias("b"), *[F.col(a).alias(f"_q{a}") for a in geo.AXES])
    v = geo.vector(["_px", "_py", "_pz"], ["_qx", "_qy", "_qz"])
    return (
        pairs.join(one, [*keys, "a"]).join(two, [*keys, "b"])
        .filter(geo.dot(v, v) <= limit)
        .groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("_hits"))
        .select(*keys, "a", "b")
    )


def _descend(spark, member, todo, keys, limit, side, crowd) -> DataFrame:
    """Dual descent for pairs of crowded cells; returns the pairs that touch."""
    rounds = Rounds(spark, "close-descent")
    sub = ("_sx", "_sy", "_sz")
    hits, fine = [], []
    level = 1
    wanted = todo.select(*keys, F.col("a").alias("_cell")).unionByName(
        todo.select(*keys, F.col("b").alias("_cell"))
    ).distinct()
    inside = written(member.join(wanted, [*keys, "_cell"], "left_semi"), "close-crowded")
    zero = [F.lit(None).cast("bigint").alias(f"{t}{s}") for t in ("_p", "_q") for s in sub]
    state = todo.select(*keys, "a", "b", *zero)
    while True:
        rounds.next()
        step = side / (2**level)
        boxes = written(
            inside.select(*keys, "_cell", *geo.AXES, *_cells(step, sub))
            .groupBy(*keys, "_cell", *sub).agg(F.count(F.lit(1)).alias("n"), *_box()),
            "close-boxes",
        )

        def part(tag: str, name: str, boxes: DataFrame = boxes) -> DataFrame:
            return boxes.select(
                *keys, F.col("_cell").alias(name),
                *[F.col(s).alias(f"{tag}{s}") for s in sub],
                *[F.floor(F.col(s) / 2).alias(f"{tag}{s}_up") for s in sub],
                *[F.col(c).alias(f"{tag}{c}") for c in ("n", "x0", "y0", "z0", "x1", "y1", "z1")],
            )

        grown = state
        for tag, name in (("_p", "a"), ("_q", "b")):
            if level == 1:
                grown = grown.drop(*[f"{tag}{s}" for s in sub])
                grown = grown.join(part(tag, name), [*keys, name])
            else:
                grown = grown.withColumnsRenamed({f"{tag}{s}": f"{tag}{s}_up" for s in sub})
                grown = grown.join(
                    part(tag, name), [*keys, name, *[f"{tag}{s}_up" for s in sub]]
                )
        near, far = _box_gap("_p", "_q")
        judged = written(
            grown.withColumn("_near", near).withColumn("_far", far)
            .filter(F.col("_near") <= limit)
            .select(
                *keys, "a", "b", *[f"{t}{s}" for t in ("_p", "_q") for s in sub],
                (F.col("_far") <= limit).alias("_sure"),
                (F.col("_pn") * F.col("_qn")).alias("_pairs"),
            ),
            "close-judged",
        )
        done = judged.filter("_sure").select(*keys, "a", "b").distinct()
        hits.append(done)
        left = judged.filter(~F.col("_sure")).join(done, [*keys, "a", "b"], "left_anti")
        few = left.filter(F.col("_pairs") <= crowd)
        if few.limit(1).count():
            tagged = inside.select("*", *_cells(step, sub))
            one = tagged.select(
                *keys, F.col("_cell").alias("a"), *[F.col(s).alias(f"_p{s}") for s in sub],
                *[F.col(a).alias(f"_p{a}") for a in geo.AXES])
            two = tagged.select(
                *keys, F.col("_cell").alias("b"), *[F.col(s).alias(f"_q{s}") for s in sub],
                *[F.col(a).alias(f"_q{a}") for a in geo.AXES])
            v = geo.vector(["_px", "_py", "_pz"], ["_qx", "_qy", "_qz"])
            close = (
                few.join(one, [*keys, "a", *[f"_p{s}" for s in sub]])
                .join(two, [*keys, "b", *[f"_q{s}" for s in sub]])
                .filter(geo.dot(v, v) <= limit)
                .groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("_hits"))
                .select(*keys, "a", "b")
            )
            close = written(close, "close-fine")
            fine.append(close)
            left = left.join(close, [*keys, "a", "b"], "left_anti")
        state = rounds.cut(
            left.filter(F.col("_pairs") > crowd).drop("_sure", "_pairs"), watch=F.lit(True)
        )
        if rounds.pending == 0:
            break
        level += 1
    out = hits[0]
    for more in [*hits[1:], *fine]:
        out = out.unionByName(more)
    return out.distinct()


# --- nearest ------------------------------------------------------------------------------

class Octree:
    """Cells of halving size over a point table, refined only where many points meet.

    Points with equal coordinates are one place, which keeps the smallest ``most`` of their ids:
    no search for ``most`` neighbours, the point itself included, can use more.

    ``pyramid`` has (keys, level, cell, parent cell, n, tight box, is_leaf); ``leaves`` has the
    places with their ids and the leaf that holds them.  Both are written tables.
    """

    # Levels made in one pass; cells that are still crowded after them are measured anew.
    PASS = (20, 10)

    def __init__(
        self, points: DataFrame, keys: Sequence[str], *, node: str = "id", leaf: int = 32,
        most: int = 1,
    ):
        self.keys = list(keys)
        self.most = most
        keys = self.keys
        if most == 1:
            one = points.groupBy(*keys, *geo.AXES).agg(F.array(F.min(node)).alias("_pids"))
        else:
            place = Window.partitionBy(*keys, *geo.AXES).orderBy(node)
            one = (
                points.withColumn("_nth", F.row_number().over(place))
                .filter(F.col("_nth") <= most)
                .groupBy(*keys, *geo.AXES)
                .agg(F.sort_array(F.collect_list(node)).alias("_pids"))
            )
        layers, leaves, base = [], [], 0
        pending = one.withColumn("_root", F.lit(0).cast("bigint"))
        roots = None
        while True:
            top = self.PASS[0 if roots is None else 1]
            cells, places, crowded = self._layer(pending, roots, base, top, leaf)
            layers.append(cells)
            leaves.append(places)
            if crowded.isEmpty():
                break
            # a cell of the last level becomes the root of a tree over its own, smaller box
            roots = written(
                crowded.withColumn("_next", F.monotonically_increasing_id()), "octree-roots"
            )
            at = [F.col("_root") * F.lit(2**top) + F.col(CELL[0]), *[F.col(c) for c in CELL[1:]]]
            pending = (
                self._coded.select(*keys, "_pids", *geo.AXES, *[c.alias(n) for c, n in zip(at, CELL)])
                .join(roots.select(*keys, *CELL, F.col("_next").alias("_root")), [*keys, *CELL])
                .drop(*CELL)
            )
            base += top + 1
        self.pyramid, self.leaves = layers[0], leaves[0]
        for cells, places in zip(layers[1:], leaves[1:]):
            self.pyramid = self.pyramid.unionByName(cells)
            self.leaves = self.leaves.unionByName(places)
        self.depth = self.pyramid.agg(F.max("level")).first()[0] or 0

    def _layer(
        self, points: DataFrame, roots: DataFrame | None, base: int, top: int, leaf: int
    ) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``top`` levels below each root: their cells, the places of leaves, and crowded ends."""
        keys = self.keys
        span = points.groupBy(*keys, "_root").agg(*_box("_e"))
        wide = F.greatest(*[F.col(f"_e{a}1") - F.col(f"_e{a}0") for a in geo.AXES])
        wide = F.when(wide > 0, wide).otherwise(F.lit(1.0))
        code = [
            F.least(
                F.floor((F.col(a) - F.col(f"_e{a}0")) / wide * F.lit(float(2**top))),
                F.lit(2**top - 1),
            ).alias(c)
            for a, c in zip(geo.AXES, CELL)
        ]
        if keys or roots is not None:
            placed = points.join(span, [*keys, "_root"])
        else:
            placed = points.withColumns(
                {f"_e{a}{n}": span.select(f"_e{a}{n}").scalar() for a in geo.AXES for n in "01"}
            )
        coded = written(
            placed.select(*keys, "_root", "_pids", *geo.AXES, *code), "octree-points"
        )
        self._coded = coded

        def at(level: Column) -> list[Column]:
            shift = F.pow(F.lit(2.0), F.lit(top) - level).cast("bigint")
            # cells of different roots differ in the first number
            first = F.col("_root") * F.pow(F.lit(2.0), level).cast("bigint")
            return [
                (F.floor(F.col(c) / shift) + (first if c == CELL[0] else F.lit(0))).alias(c)
                for c in CELL
            ]

        spread = coded.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(top))))
        counted = spread.select(*keys, "_root", "_l", *at(F.col("_l")), *geo.AXES).groupBy(
            *keys, "_root", "_l", *CELL
        ).agg(F.count(F.lit(1)).alias("n"), *_box())
        counted = written(counted, "octree-counts")
        above = counted.filter(F.col("n") > leaf).select(
            *keys, (F.col("_l") + 1).alias("_l"), *[F.col(c).alias(f"{c}_up") for c in CELL]
        )
        ups = [F.floor(F.col(c) / 2).alias(f"{c}_up") for c in CELL]
        cells = counted.select("*", *ups)
        first = cells.filter("_l = 0")
        if roots is not None:
            first = first.drop(*[f"{c}_up" for c in CELL]).join(
                roots.select(*keys, F.col("_next").alias("_root"), *[F.col(c).alias(f"{c}_up") for c in CELL]),
                [*keys, "_root"],
            ).select(*cells.columns)
        kept = first.unionByName(
            cells.filter("_l > 0").join(above, [*keys, "_l", *[f"{c}_up" for c in CELL]], "left_semi")
            .select(*cells.columns)
        )
        pyramid = written(
            kept.withColumn("is_leaf", F.col("n") <= leaf)
            .withColumn("level", F.col("_l") + F.lit(base)), "octree"
        )
        depth = pyramid.agg(F.max("_l")).first()[0] or 0
        ends = pyramid.filter("is_leaf").select(*keys, "_l", *CELL)
        deep = coded.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(depth))))
        places = written(
            deep.select(*keys, "_pids", *[F.col(a).alias(f"_p{a}") for a in geo.AXES], "_l",
                        *at(F.col("_l")))
            .join(ends, [*keys, "_l", *CELL], "left_semi")
            .withColumn("level", F.col("_l") + F.lit(base)).drop("_l"),
            "octree-leaves",
        )
        crowded = pyramid.filter((F.col("_l") == top) & ~F.col("is_leaf")).select(*keys, *CELL)
        return pyramid.drop("_l", "_root"), places, crowded


def nearest(
    queries: DataFrame, tree: Octree, *, node: str = "id", k: int = 1, skip_self: bool = False,
    coords: Sequence[str] = geo.AXES,
) -> DataFrame:
    """The ``k`` nearest points of the tree per query: (keys, node, near_id, distance, rank).

    A query first walks down to one small cell, whose points bound the distance it has to look;
    then it collects the leaves within that bound, which are a handful wherever it lies, and
    compares their points.  Ties go to the smaller id.  A group with fewer points than wanted
    gives all it has.
    """
    keys = tree.keys
    need = k + (1 if skip_self else 0)
    if need > tree.most:
        raise ValueError(f"the tree keeps {tree.most} ids of a place, the search needs {need}")
    q = queries.select(*keys, F.col(node).alias("_qid"), *[F.col(c).alias(f"_q{a}0") for c, a in zip(coords, geo.AXES)])
    for a in geo.AXES:
        q = q.withColumn(f"_q{a}1", F.col(f"_q{a}0"))
    boxed = tree.pyramid.select(
        *keys, "level", *CELL, *[f"{c}_up" for c in CELL], "n", "is_leaf",
        *[F.col(f"{a}{s}").alias(f"_b{a}{s}") for a in geo.AXES for s in "01"],
    )
    near, far = _box_gap("_q", "_b")
    carry = [*keys, "_qid", *[f"_q{a}{s}" for a in geo.AXES for s in "01"]]
    gap = geo.vector(["_qx0", "_qy0", "_qz0"], ["_px", "_py", "_pz"])
    gap2 = geo.dot(gap, gap)

    def below(open_cells: DataFrame, level: int) -> DataFrame:
        """Open cells (with their queries) replaced by their children."""
        children = boxed.filter(F.col("level") == level)
        if not keys and level <= 4:
            children = F.broadcast(children)  # at most 8**4 rows
        up = open_cells.drop("level", "n", "is_leaf").withColumnsRenamed({c: f"{c}_up" for c in CELL})
        return up.join(children, [*keys, *[f"{c}_up" for c in CELL]])

    top = boxed.filter("level = 0").drop(*[f"{c}_up" for c in CELL]).withColumn("_one", F.lit(1))
    if not keys:
        top = F.broadcast(top)  # one row
    start = q.withColumn("_one", F.lit(1)).join(top, [*keys, "_one"]).withColumn("_far", far)
    cell = ["level", *CELL, "n", "is_leaf"]
    one = start.select(*carry, *cell, "_far")
    for level in range(1, tree.depth + 1):
        lower = below(one.filter(~F.col("is_leaf")).drop("_far"), level).filter(F.col("n") >= need)
        both = one.unionByName(lower.withColumn("_far", far).select(*one.columns))
        # one row per query: the deepest cell with enough points, of these the one that bounds best
        one = both.groupBy(*carry).agg(
            F.max_by(F.struct(*cell, "_far"), F.struct("level", -F.col("_far"))).alias("_c")
        ).select(*carry, "_c.*")
        if level % 4 == 0:
            one = written(one, "nearest-walk")
    # the points of a leaf give the bound, and so does the box of a cell around smaller leaves
    small = one.filter("is_leaf")
    inside = small.join(tree.leaves, [*keys, "level", *CELL]).groupBy(*carry)
    listed = F.sort_array(F.collect_list(gap2))
    best = F.min(gap2) if need == 1 else F.get(listed, F.lit(need - 1))
    bounds = inside.agg(best.alias("_bound"))
    other = one.filter(~F.col("is_leaf"))
    # fewer points than wanted in the whole tree: everything is near enough
    loose = F.when(F.col("n") >= need, F.col("_far")).otherwise(F.lit(float("inf")))
    bounds = bounds.unionByName(other.select(*carry, loose.alias("_bound")))
    # compared as distances, since unequal squares can have equal roots and then the id decides
    bound = F.coalesce(F.sqrt("_bound"), F.lit(float("inf")))
    bounds = written(bounds.withColumn("_bound", bound), "nearest-bounds")
    state = bounds.withColumn("_one", F.lit(1)).join(top, [*keys, "_one"]).select(*carry, "_bound", *cell)
    for level in range(1, tree.depth + 1):
        lower = below(state.filter(~F.col("is_leaf")), level).filter(F.sqrt(near) <= F.col("_bound"))
        state = state.filter("is_leaf").unionByName(lower.select(*state.columns))
        if level % 4 == 0:
            state = written(state, "nearest-cells")
    met = state.join(tree.leaves, [*keys, "level", *CELL])
    met = met.withColumn("distance", F.sqrt(gap2)).filter(F.col("distance") <= F.col("_bound"))
    met = met.withColumn("_pid", F.explode("_pids"))
    if skip_self:
        met = met.filter(F.col("_pid") != F.col("_qid"))
    row = F.struct("distance", "_pid", "_px", "_py", "_pz")
    if k == 1:
        found = met.groupBy(*keys, "_qid").agg(F.min(row).alias("_r")).withColumn("rank", F.lit(1))
    else:
        order = Window.partitionBy(*keys, "_qid").orderBy("distance", "_pid")
        found = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
            *keys, "_qid", "rank", row.alias("_r")
        )
    return found.select(
        *keys, F.col("_qid").alias(node), F.col("_r._pid").alias("near_id"),
        F.col("_r.distance").alias("distance"), "rank",
        *[F.col(f"_r._p{a}").alias(f"near_{a}") for a in geo.AXES],
    )


def nearest_distance(queries: DataFrame, targets: DataFrame, *, node: str = "id") -> DataFrame:
    """Distance from every query point to the nearest target: (node, distance)."""
    tree = Octree(targets, [], node=node)
    return nearest(queries, tree, node=node).select(node, "distance")


# --- thinning -----------------------------------------------------------------------------


#: Most points of a group that are thinned inside a task
THIN_SMALL = 8192


def thin(
    points: DataFrame, keys: Sequence[str], radius: float, *, node: str = "id",
    priority: Sequence[Column], small: int = THIN_SMALL,
) -> DataFrame:
    """Points that remain when each drops all later ones within ``radius`` of it.

    The order is ``priority`` (smallest first), then the id; ids are unique inside a group.  Groups
    of at most ``small`` points are walked in that order inside tasks, larger ones go through
    rounds over cells.  Both ways give the same rows.  ``points`` is read twice.
    """
    keys = list(keys)
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = written(sizes.filter(F.col("_n") > small).select(*keys), "large-groups")
    if large.isEmpty():
        return _thin_in_tasks(points, keys, radius, node=node, priority=priority)
    here = _thin_in_tasks(points.join(large, keys, "left_anti"), keys, radius, node=node, priority=priority)
    there = _thin_in_rounds(
        written(points.join(large, keys, "left_semi"), "large-points"), keys, radius, node=node, priority=priority
    )
    return here.select(*points.columns).unionByName(there.select(*points.columns))


def _thin_in_tasks(
    points: DataFrame, keys: Sequence[str], radius: float, *, node: str, priority: Sequence[Column]
) -> DataFrame:
    """:func:`thin` for groups that fit into a task: one exchange, no rounds."""
    limit = float(radius)
    group = ["_group", "_group2"]
    order = [f"_p{n}" for n in range(len(priority))]
    keyed = points.select(
        "*", F.xxhash64(*keys).alias("_group"), F.xxhash64(F.lit("group"), *keys).alias("_group2"),
        *[c.alias(n) for c, n in zip(priority, order)],
    )
    dealt = keyed.repartition(*group).sortWithinPartitions(*group, *order, node).drop(*order)
    names = points.columns

    def survivors(rows: pa.Table) -> pa.Table:
        spots = np.stack([rows.column(a).to_numpy() for a in geo.AXES], 1).astype(float)
        left = np.arange(len(spots))
        kept = []
        while len(left):
            kept.append(left[0])
            x, y, z = (spots[left[1:]] - spots[left[0]]).T
            # written so that a distance that is no number drops nothing
            left = left[1:][~(np.sqrt(x * x + y * y + z * z) <= limit)]
        return rows.take(pa.array(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, group):
            yield from survivors(rows.select(names)).to_batches()

    return dealt.mapInArrow(run, points.schema)


def whole_groups(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal ``by`` (whole numbers, rows ordered by them) as one table."""
    held: list[pa.RecordBatch] = []
    place = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(c).to_numpy() for c in by], 1)
        cuts = (np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            if place is not None and (at[lo] != place).any():
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            place = at[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _thin_in_rounds(
    points: DataFrame, keys: Sequence[str], radius: float, *, node: str, priority: Sequence[Column]
) -> DataFrame:
    """:func:`thin` for groups of any size.

    In each round the first point of a cell survives if no point ahead of it is left within the
    radius, and everything near a survivor goes.  Only one point per cell is tried and a cell
    holds at most one survivor, so a point meets at most 125 of either.  Hash the priority to
    keep the number of rounds logarithmic.
    """
    keys = list(keys)
    side = float(radius) / math.sqrt(3.0) * (1.0 - 1e-9)
    limit = float(radius)
    rounds = Rounds(points.sparkSession, "thin")
    order = F.struct(*[c.alias(f"_p{n}") for n, c in enumerate(priority)], F.col(node).alias("_id"))
    left = rounds.cut(points.select(*keys, F.col(node).alias("_id"), *geo.AXES, *_cells(side), order.alias("_order")), "left", watch=F.lit(True))
    kept: list[DataFrame] = []
    around = [o for o in _offsets(2, forward_only=False) if o != (0, 0, 0)]
    while rounds.pending:
        rounds.next()
        best = left.groupBy(*keys, *CELL).agg(F.min("_order").alias("_first")).join(
            left, [*keys, *CELL]
        ).filter(F.col("_order") == F.col("_first")).select(
            *keys, *CELL, "_first", F.col("_id").alias("_wid"),
            *[F.col(a).alias(f"_w{a}") for a in geo.AXES],
        )
        near = geo.distance(list(geo.AXES), ["_wx", "_wy", "_wz"]) <= limit
        blocked = (
            _shifted(best, around).join(left, [*keys, *CELL])
            .filter((F.col("_order") < F.col("_first")) & near)
            .select(*keys, "_wid").distinct()
        )
        winners = written(
            best.drop("_first").join(blocked, [*keys, "_wid"], "left_anti"), "thin-winners"
        )
        kept.append(winners.select(*keys, F.col("_wid").alias(node)))
        shade = _shifted(winners, [(0, 0, 0), *around])
        gone = left.join(shade, [*keys, *CELL]).filter(near).select(*keys, "_id").distinct()
        left = rounds.cut(left.join(gone, [*keys, "_id"], "left_anti").select(*left.columns), "left", watch=F.lit(True))
    if not kept:
        return points
    survivors = kept[0]
    for more in kept[1:]:
        survivors = survivors.unionByName(more)
    return points.join(survivors, [*keys, node], "left_semi")
