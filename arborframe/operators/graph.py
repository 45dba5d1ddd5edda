"""Candidate graphs between a source and its targets: points, edges, weights, connecting tree.

Points carry the key columns of their axon, ``id``, ``x, y, z`` and what made them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborframe.functions import geometry as geo
from arborframe.functions.draws import uniform
from arborframe.operators import whole_graphs as W
from arborframe.operators.core import Rounds, accumulate, id_slice, numbered, written
from arborframe.operators.neighbours import SMALL, edges_in_tasks, nearest_distance, neighbours
from arborframe.operators.spatial import thin
from arborframe.operators.trees import bounding_box, fold, run_heads
from arborframe.operators.voxels import IJK, Grid, indices, lookup

# Names of the point providers, in the order in which they are added; limits of
# the sine in the direction penalty; widening of the reference box; fewest nodes of a graph.
PROVIDERS = ("source", "target", "intermediate", "random", "attractors", "bbox")
SINE_LIMITS = (1e-3, 1.0 - 1e-3)
BOX_MARGIN = 0.1
MIN_NODES = 5

# Most nodes of a graph whose edges meet them in one task.
MOST_NODES = 1 << 19

FROM, TO = geo.triple("", "_from"), geo.triple("", "_to")


# --- points ---------------------------------------------------------------------------------


def intermediate_points(
    targets: DataFrame, keys: Sequence[str], *, min_distance: float, most: int, node: str = "id"
) -> DataFrame:
    """Evenly spaced points between the source and each target.

    ``targets``: (keys, node, x, y, z, source_x, source_y, source_z).  Their number is the
    distance in whole ``min_distance`` steps, at most ``most``; always ``most`` if the distance
    is not positive.  Returns (keys, node, step, x, y, z), step from 1.
    """
    src = geo.triple("source_")
    length = geo.distance(src, list(geo.AXES))
    count = F.lit(most) if min_distance <= 0 else F.least(
        F.floor(length / F.lit(float(min_distance))), F.lit(most)
    )
    out = targets.withColumn("_n", count.cast("int")).filter((F.col("_n") > 0) & (length > 0))
    out = out.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    share = F.col("step") / (F.col("_n") + 1)
    return out.select(
        *keys, node, "step",
        *[(F.col(s) + (F.col(a) - F.col(s)) * share).alias(a) for s, a in zip(src, geo.AXES)],
    )


def box_corners(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The eight corners of each group's box: (keys, corner, x, y, z); equal ones once."""
    box = bounding_box(points, keys)
    listed = F.array(
        *[
            F.struct(
                F.lit(n).alias("corner"),
                *[F.col(f"{a}_{'max' if n >> p & 1 else 'min'}").alias(a) for p, a in enumerate(geo.AXES)],
            )
            for n in range(8)
        ]
    )
    corners = box.select(*keys, F.explode(listed).alias("_c")).select(*keys, "_c.*")
    return corners.groupBy(*keys, *geo.AXES).agg(F.min("corner").alias("corner"))


def drop_duplicates_keep_first(points: DataFrame, keys: Sequence[str], *, order: str) -> DataFrame:
    """Points of a group with equal coordinates once: the first along ``order``."""
    rest = [c for c in points.columns if c not in (*keys, *geo.AXES)]
    return points.groupBy(*keys, *geo.AXES).agg(
        F.min_by(F.struct(*rest), order).alias("_r")
    ).select(*keys, *geo.AXES, "_r.*")


def random_points(
    points: DataFrame, keys: Sequence[str], *, min_distance: float, candidates: int,
    buffer: float = 0.0,
) -> DataFrame:
    """Random points in the widened box of a group, at a distance from each other and the rest.

    ``candidates`` positions are drawn per group from the group's key; those too close to an
    existing point go, and of the others each drops the later ones around it.
    Returns (keys, draw, x, y, z).
    """
    keys = list(keys)
    box = bounding_box(points, keys, absolute_buffer=buffer)
    drawn = box.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(candidates - 1).cast("bigint"))))
    for a in geo.AXES:
        u = uniform(*keys, "draw", F.lit(f"random_{a}"))
        drawn = drawn.withColumn(a, F.col(f"{a}_min") + u * (F.col(f"{a}_max") - F.col(f"{a}_min")))
    drawn = written(drawn.select(*keys, "draw", *geo.AXES), "random-candidates")
    places = points.select(*keys, *geo.AXES).distinct().withColumn("_pt", F.xxhash64(*geo.AXES))
    gap = neighbours(drawn, places, keys, node="draw", target="_pt").filter(F.col("distance") > min_distance)
    free = written(drawn.join(gap.select(*keys, "draw"), [*keys, "draw"], "left_semi"), "random-free")
    return thin(free, keys, min_distance, node="draw", priority=[F.col("draw")])


def attractor_points(preferred: DataFrame, *, min_distance: float, node: str = "id") -> DataFrame:
    """Preferred points (node, x, y, z) thinned to a distance, in hashed order.

    At least one point always remains, since the first in the order is never dropped.
    """
    one = preferred.withColumn("_all", F.lit(1))
    kept = thin(one, ["_all"], min_distance, node=node, priority=[uniform(node, F.lit("attractor"))])
    return kept.drop("_all")


def barycentre_point(preferred: DataFrame, *, node: str = "id") -> DataFrame:
    """The preferred point nearest to the mean of all of them."""
    mean = preferred.agg(*[F.avg(a).alias(a) for a in geo.AXES])
    centre = {f"_m{a}": mean.select(a).scalar() for a in geo.AXES}
    gap = geo.distance(["_mx", "_my", "_mz"], list(geo.AXES))
    best = preferred.withColumns(centre).agg(
        F.min_by(F.struct(node, *geo.AXES), F.struct(gap, node)).alias("_p")
    )
    return best.select("_p.*")


def inside_box(points: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points inside the box (x_min .. z_max) of their group, borders included."""
    inside = F.lit(True)
    for a in geo.AXES:
        inside = inside & F.col(a).between(F.col(f"{a}_min"), F.col(f"{a}_max"))
    return points.join(boxes, list(keys)).filter(inside).select(*points.columns)


def inside_reference(points: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points inside the box of the reference points, widened by a tenth on every side."""
    return inside_box(points, bounding_box(reference, keys, relative_buffer=BOX_MARGIN), keys)


def thin_close(points: DataFrame, keys: Sequence[str], precision: float, *, node: str = "id") -> DataFrame:
    """Drop points closer than the precision to one that comes first; terminals come first."""
    order = [F.when(F.col("is_terminal"), F.lit(0)).otherwise(F.lit(1)), uniform(*keys, node, F.lit("thin"))]
    return thin(points, keys, precision, node=node, priority=order)


def node_table(parts: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Nodes of a graph with dense ids from 0, in the order of the providers.

    ``parts``: provider -> (keys, order, x, y, z[, terminal_id]); source and targets are
    terminals, the others have terminal id -1.  ``order`` is a unique integer per part.
    """
    keys = list(keys)
    rows = None
    for rank, provider in enumerate(PROVIDERS):
        if provider not in parts:
            continue
        part = parts[provider]
        terminal = provider in ("source", "target")
        tid = F.col("terminal_id") if provider == "target" else F.lit(-1)
        one = part.select(
            *keys, F.lit(rank).alias("_rank"), F.col("order").cast("bigint").alias("_order"),
            *geo.AXES, F.lit(provider).alias("provider"), F.lit(terminal).alias("is_terminal"),
            tid.cast("bigint").alias("terminal_id"),
        )
        rows = one if rows is None else rows.unionByName(one)
    out = accumulate(
        rows, keys, ["_rank", "_order"], slice_by=F.struct("_rank", id_slice("_order")), number="id"
    )
    return out.withColumn("id", F.col("id") - 1).drop("_rank", "_order")


def fill_small_graphs(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups of at most five nodes get points between their source and their other nodes.

    Every node other than the source brings as many points as the group lacks to five.
    """
    keys = list(keys)
    counts = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    source = nodes.filter("provider = 'source'").select(
        *keys, *[F.col(a).alias(f"source_{a}") for a in geo.AXES]
    )
    lack = counts.filter(F.col("_n") < MIN_NODES).join(source, keys)
    src = geo.triple("source_")
    added = (
        nodes.join(lack, keys).filter(geo.distance(src, list(geo.AXES)) > 0)
        .withColumn("_lack", F.lit(MIN_NODES) - F.col("_n"))
        .withColumn("_step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_lack"))))
    )
    share = F.col("_step") / (F.col("_lack") + 1)
    new = added.select(
        *keys, (F.col("_n") + F.col("id") * MIN_NODES + F.col("_step")).alias("_order"),
        *[(F.col(s) + (F.col(a) - F.col(s)) * share).alias(a) for s, a in zip(src, geo.AXES)],
        F.lit("intermediate").alias("provider"), F.lit(False).alias("is_terminal"),
        F.lit(-1).cast("bigint").alias("terminal_id"),
    )
    both = nodes.withColumnRenamed("id", "_order").unionByName(new)
    return numbered(both, keys, "_order", "id").drop("_order")


# --- edges and weights --------------------------------------------------------------------------


def nearest_edges(nodes: DataFrame, keys: Sequence[str], *, k: int, small: int = SMALL) -> DataFrame:
    """Undirected edges from every node to its ``k`` nearest ones, each pair once.

    (keys, from, to, x_from .. z_to, length) with from < to.  Groups of at most ``small`` nodes are
    joined inside tasks, larger ones by the octree.
    """
    keys = list(keys)
    sizes = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = written(sizes.filter(F.col("_n") > small).select(*keys), "large-graphs")

    def measured(here: DataFrame) -> DataFrame:
        return edges_in_tasks(here, keys, k=k).withColumn("length", geo.distance(FROM, TO))

    if large.isEmpty():
        return measured(nodes)
    wide = nodes.join(large, keys, "left_semi")
    near = neighbours(wide, wide, keys, k=k, skip_self=True, small=small)
    pairs = near.select(
        *keys, F.least("id", "near_id").alias("from"), F.greatest("id", "near_id").alias("to")
    ).distinct()
    return measured(nodes.join(large, keys, "left_anti")).unionByName(with_ends(pairs, wide, keys))


def with_ends(pairs: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges with the coordinates of both ends and their length."""
    keys = list(keys)

    def side(name: str) -> DataFrame:
        return nodes.select(*keys, F.col("id").alias(name), *[F.col(a).alias(f"{a}_{name}") for a in geo.AXES])

    return (
        pairs.join(side("from"), [*keys, "from"]).join(side("to"), [*keys, "to"])
        .withColumn("length", geo.distance(FROM, TO))
    )


def direction_penalty(source: Sequence[Column], *, exponent: float, amplitude: float) -> Column:
    """Larger for edges across the direction from the source to their middle."""
    middle = [(F.col(f) + F.col(t)) * F.lit(0.5) for f, t in zip(FROM, TO)]
    out = [m - s for m, s in zip(middle, source)]
    theta = F.coalesce(geo.angle(out, geo.vector(FROM, TO)), F.lit(0.0))
    sine = F.greatest(F.lit(SINE_LIMITS[0]), F.least(F.lit(SINE_LIMITS[1]), F.sin(theta)))
    return F.lit(1.0) + F.lit(float(amplitude)) * F.pow(sine, F.lit(float(exponent)))


def whole_graphs(
    edges: DataFrame, nodes: DataFrame, keys: Sequence[str], joined: Callable[[DataFrame, DataFrame], DataFrame],
    *, most: int = MOST_NODES,
) -> DataFrame:
    """``joined(edges, nodes)`` with the edges of a graph beside its nodes, so that all joins on the
    keys and an end of the edge share one exchange of the edges.

    Joins keep to that exchange in a session whose ``spark.sql.requireAllClusterKeysForCoPartition``
    is false.  Graphs of more than ``most`` nodes are dealt by the columns of each join instead.
    """
    keys = list(keys)
    sizes = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = written(sizes.filter(F.col("_n") > most).select(*keys), "hot-graphs")
    if hot.isEmpty():
        return joined(edges.repartition(*keys), nodes.repartition(*keys))
    hot = F.broadcast(hot)  # one row for half a million nodes and more
    rest = joined(edges.join(hot, keys, "left_anti").repartition(*keys), nodes.join(hot, keys, "left_anti").repartition(*keys))
    return rest.unionByName(joined(edges.join(hot, keys, "left_semi"), nodes.join(hot, keys, "left_semi")))


def with_depths(edges: DataFrame, depths: DataFrame, grid: Grid) -> DataFrame:
    """Edges with the depth of both ends, 0 where unknown: ``depth_from``, ``depth_to``.

    Only voxels that an edge starts or ends in are joined; where they are few they are broadcast.
    """
    met = None
    for coords in (FROM, TO):
        cells = edges.select(*indices(coords, grid, list(IJK))).distinct()
        met = cells if met is None else met.unionByName(cells).distinct()
    depths = written(depths.join(met, list(IJK), "left_semi"), "edge-depths")
    out = lookup(edges, depths, grid, ["depth"], coords=FROM).withColumnRenamed("depth", "depth_from")
    out = lookup(out, depths, grid, ["depth"], coords=TO).withColumnRenamed("depth", "depth_to")
    for c in ("depth_from", "depth_to"):
        out = out.withColumn(c, F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)))
    return out


def depth_penalty(*, sigma: float, amplitude: float) -> Column:
    """Larger for edges that change depth, relative to their length."""
    change = F.try_divide(F.abs(F.col("depth_from") - F.col("depth_to")), F.col("length"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(change, F.lit(1.0))))
    return F.lit(1.0) + F.lit(float(amplitude)) * (F.lit(1.0) - F.exp(-share / F.lit(float(sigma))))


def preferred_factor(
    edges: DataFrame, nodes: DataFrame, attractors: DataFrame, keys: Sequence[str], *,
    sigma: float, amplitude: float,
) -> DataFrame:
    """Adds ``preferred``: larger the farther both ends are from the nearest attractor.

    The distance is looked up once per node, not per edge.
    """
    keys = list(keys)
    flat = nodes.select(*keys, "id", *geo.AXES).withColumn("_q", F.struct(*keys, "id"))
    gap = nearest_distance(
        flat.select(F.col("_q").alias("id"), *geo.AXES),
        attractors.select("id", *geo.AXES),
    ).select(*[F.col(f"id.{k}").alias(k) for k in keys], F.col("id.id").alias("id"), "distance")
    gap = written(gap, "attractor-distance")
    mean = F.lit(0.5) * (F.col("_d1") + F.col("_d2"))

    def joined(edges: DataFrame, gap: DataFrame) -> DataFrame:
        one = gap.select(*keys, F.col("id").alias("from"), F.col("distance").alias("_d1"))
        two = gap.select(*keys, F.col("id").alias("to"), F.col("distance").alias("_d2"))
        return edges.join(one, [*keys, "from"]).join(two, [*keys, "to"])

    return whole_graphs(edges, gap, keys, joined).withColumn(
        "preferred",
        F.lit(1.0) + F.lit(float(amplitude)) * (F.lit(1.0) - F.exp(-mean / F.lit(float(sigma)))),
    ).drop("_d1", "_d2")


def weighted(edges: DataFrame, factors: Sequence[Column]) -> DataFrame:
    """Adds ``weight``: length times all factors."""
    product = F.col("length")
    for f in factors:
        product = product * f
    return edges.withColumn("weight", product)


def terminal_penalty(edges: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Make edges between two terminals costly, unless both only touch terminals.

    The penalty is the group's largest plus its mean weight.  Whether a node only touches
    terminals is read from the edges that start at it; a node no edge starts at counts as such.
    """
    keys = list(keys)
    only = F.coalesce("_from_all", F.lit(True)) & F.coalesce("_to_all", F.lit(True))
    hit = F.col("_ft") & F.col("_tt") & ~only

    def joined(edges: DataFrame, term: DataFrame) -> DataFrame:
        flagged = edges.join(term.withColumnsRenamed({"id": "from", "is_terminal": "_ft"}), [*keys, "from"], "left")
        flagged = flagged.join(term.withColumnsRenamed({"id": "to", "is_terminal": "_tt"}), [*keys, "to"], "left")
        flagged = flagged.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_ft", "_tt")})
        sizes = edges.groupBy(*keys).agg((F.max("weight") + F.avg("weight")).alias("_penalty"))
        touch = flagged.groupBy(*keys, "from").agg(
            F.bool_and("_ft").alias("_from_all"), F.bool_and("_tt").alias("_to_all")
        )
        by_from = touch.select(*keys, "from", "_from_all")
        by_to = touch.select(*keys, F.col("from").alias("to"), "_to_all")
        return flagged.join(by_from, [*keys, "from"], "left").join(by_to, [*keys, "to"], "left").join(sizes, keys)

    out = whole_graphs(edges, nodes.select(*keys, "id", "is_terminal"), keys, joined)
    return out.withColumn(
        "weight", F.col("weight") + F.when(hit, F.col("_penalty")).otherwise(F.lit(0.0))
    ).select(*edges.columns)


# --- connecting tree ----------------------------------------------------------------------------


def _no_arc() -> Column:
    """Edges that array sums cannot follow as joins do."""
    return F.col("from").isNull() | F.col("to").isNull() | F.col("weight").isNull() | F.isnan(F.col("weight").cast("double"))


def shortest_paths(
    edges: DataFrame, sources: DataFrame, keys: Sequence[str], *, most: int = W.MOST_EDGES
) -> DataFrame:
    """Cheapest way from the source to every node it reaches: (keys, id, cost, previous).

    Only nodes whose way changed in the last round pass it on.  Of equally cheap ways the one
    with fewer edges counts, then the one through the smaller node.  Graphs of at most ``most``
    edges are walked inside tasks, larger ones in rounds.  ``edges`` is read twice.
    """
    keys = list(keys)
    if not (keys and W.whole_numbers(edges, ["from", "to"]) and W.whole_numbers(sources, ["id"])):
        return _paths_in_rounds(edges, sources, keys)
    large = W.too_large(edges, keys, _no_arc(), most)
    if large is None:
        return W.ways(edges, sources, keys)
    (here, there), (start, far) = W.split(edges, large, keys), W.split(sources, large, keys)
    return W.ways(here, start, keys).unionByName(_paths_in_rounds(there, far, keys))


def _paths_in_rounds(edges: DataFrame, sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`shortest_paths` for graphs of any size."""
    keys = list(keys)
    arcs = edges.select(*keys, F.col("from").alias("u"), F.col("to").alias("v"), "weight")
    arcs = written(
        arcs.unionByName(arcs.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"), "weight")),
        "arcs",
    )
    rounds = Rounds(edges.sparkSession, "relax")
    state = rounds.cut(
        sources.select(
            *keys, "id", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"),
            F.lit(-1).cast("bigint").alias("previous"), F.lit(True).alias("_fresh"),
        )
    )
    while True:
        rounds.next()
        offers = (
            state.filter("_fresh").withColumnRenamed("id", "u").join(arcs, [*keys, "u"])
            .select(
                *keys, F.col("v").alias("id"), (F.col("cost") + F.col("weight")).alias("cost"),
                (F.col("hops") + 1).alias("hops"), F.col("u").alias("previous"),
            )
        )
        best = (
            state.select(*keys, "id", "cost", "hops", "previous", F.lit(False).alias("_fresh"))
            .unionByName(offers.withColumn("_fresh", F.lit(True)))
            .groupBy(*keys, "id")
            .agg(F.min(F.struct("cost", "hops", "previous", "_fresh")).alias("_b"))
            .select(*keys, "id", "_b.*")
        )
        state = rounds.cut(best, watch=F.col("_fresh"))
        if rounds.pending == 0:
            break
    return state.drop("_fresh", "hops")


def connecting_tree(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str], *, most: int = W.MOST_EDGES
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that join the source to every terminal along cheapest ways.

    ``nodes``: (keys, id, is_terminal, terminal_id, provider); returns both tables restricted to
    the solution, the edges with terminal id and flag of both ends and with ``parent`` and
    ``child`` as seen from the source.  Graphs of at most ``most`` edges are solved inside tasks,
    larger ones in rounds.  ``edges`` is read twice.
    """
    keys = list(keys)
    if not (keys and W.whole_numbers(edges, ["from", "to"]) and W.whole_numbers(nodes, ["id"])):
        return _tree_in_rounds(nodes, edges, keys)
    large = W.too_large(edges, keys, _no_arc(), most)
    if large is None:
        return _tree_in_tasks(nodes, edges, keys)
    (some, rest), (here, there) = W.split(nodes, large, keys), W.split(edges, large, keys)
    met, solution = _tree_in_tasks(some, here, keys)
    more, wide = _tree_in_rounds(rest, there, keys)
    return met.unionByName(more), solution.unionByName(wide)


def _tree_in_tasks(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """:func:`connecting_tree` for graphs that fit into a task: one exchange, no rounds."""
    found = W.trees(nodes, edges, keys)
    return nodes.join(found.select(*keys, "id"), [*keys, "id"], "left_semi"), found.filter("parent is not null").drop("id")


def _tree_in_rounds(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """:func:`connecting_tree` for graphs of any size."""
    keys = list(keys)
    nodes = written(nodes, "graph-nodes")
    edges = written(edges, "graph-edges")
    sources = nodes.filter("provider = 'source'").select(*keys, "id")
    ways = written(_paths_in_rounds(edges, sources, keys), "ways")
    marked = ways.join(nodes.select(*keys, "id", "is_terminal"), [*keys, "id"])
    used = fold(
        marked, keys, node="id", parent="previous",
        below={"_used": ("max", F.col("is_terminal").cast("int"))},
    ).filter("_used = 1").select(*keys, "id")
    chosen = ways.join(used, [*keys, "id"], "left_semi")
    links = chosen.filter("previous >= 0").select(
        *keys, F.col("previous").alias("parent"), F.col("id").alias("child"),
        F.least("previous", "id").alias("from"), F.greatest("previous", "id").alias("to"),
    )
    kept = edges.withColumn("_a", F.least("from", "to")).withColumn("_b", F.greatest("from", "to"))
    links = links.withColumnsRenamed({"from": "_a", "to": "_b"})
    # parallel edges: the cheapest one carries the way
    cheapest = kept.groupBy(*keys, "_a", "_b").agg(
        F.min_by(F.struct(*[c for c in edges.columns if c not in keys]), F.struct("weight", "from")).alias("_e")
    )
    solution = cheapest.join(links, [*keys, "_a", "_b"]).select(*keys, "_e.*", "parent", "child")
    ends = nodes.select(*keys, "id", "terminal_id", "is_terminal")
    for name, side in (("from", "source"), ("to", "target")):
        solution = solution.join(
            ends.withColumnsRenamed({"id": name, "terminal_id": f"{side}_terminal_id", "is_terminal": f"{side}_is_terminal"}),
            [*keys, name],
        )
    return nodes.join(used, [*keys, "id"], "left_semi"), solution


def orient_tree(
    edges: DataFrame, keys: Sequence[str], *, root: int | Column = 0, most: int = W.MOST_EDGES
) -> DataFrame:
    """Orient the edges of a tree away from its root, in walking order.

    ``edges``: (keys, from, to), one connected tree per group.  Every edge is walked down and up
    again on a tour around the tree; pointer doubling along the tour tells which of the two came
    first.  Returns (keys, from, to, parent, child, reversed_edge, position) with positions
    counting the downward steps from 1.  Trees of at most ``most`` edges are toured inside tasks,
    larger ones in rounds.  ``edges`` is read twice; a ``root`` that is a column is one of the keys.
    """
    keys = list(keys)
    start = F.lit(root).cast("bigint") if isinstance(root, int) else root
    if not (keys and W.whole_numbers(edges, ["from", "to"])):
        return _tour_in_rounds(edges, keys, start)
    large = W.too_large(edges, keys, F.col("from").isNull() | F.col("to").isNull() | start.isNull(), most)
    if large is None:
        return W.oriented(edges, keys, start)
    here, there = W.split(edges, large, keys)
    return W.oriented(here, keys, start).unionByName(_tour_in_rounds(there, keys, start))


def _tour_in_rounds(edges: DataFrame, keys: Sequence[str], start: Column) -> DataFrame:
    """:func:`orient_tree` for trees of any size."""
    keys = list(keys)
    base = edges.select(*keys, F.col("from").cast("bigint").alias("u"), F.col("to").cast("bigint").alias("v"))
    arcs = written(
        base.unionByName(base.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))), "tour-arcs"
    )
    around = written(
        accumulate(arcs, [*keys, "u"], ["v"], slice_by=id_slice("v"), number="_nr"), "tour-order"
    )
    degree = arcs.groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("_deg"))
    # after u -> v comes v -> w, w being the neighbour after u around v, or the first one
    back = around.select(*keys, F.col("u").alias("v"), F.col("v").alias("u"), "_nr")
    nxt = around.select(*keys, F.col("u").alias("v"), F.col("v").alias("_w"), F.col("_nr").alias("_turn"))
    toured = (
        back.join(degree.withColumnRenamed("u", "v"), [*keys, "v"])
        .withColumn("_last", F.col("_nr") == F.col("_deg"))
        .withColumn("_turn", F.when(F.col("_last"), F.lit(1)).otherwise(F.col("_nr") + 1))
        .join(nxt, [*keys, "v", "_turn"])
        .select(
            *keys, F.struct("u", "v").alias("_arc"),
            F.struct(F.col("v").alias("u"), F.col("_w").alias("v")).alias("_next"),
            # the tour ends where it would return to the first step out of the root
            (~((F.col("v") == start) & F.col("_last"))).alias("_goes_on"),
        )
    )
    ranks = written(
        run_heads(toured, keys, node="_arc", parent="_next", linked="_goes_on"), "tour-ranks"
    ).select(*keys, F.col("_arc.u").alias("u"), F.col("_arc.v").alias("v"), "steps")
    there = ranks.select(*keys, F.col("u").alias("parent"), F.col("v").alias("child"), F.col("steps").alias("_down"))
    again = ranks.select(*keys, F.col("v").alias("parent"), F.col("u").alias("child"), F.col("steps").alias("_up"))
    down = there.join(again, [*keys, "parent", "child"]).filter(F.col("_down") > F.col("_up"))
    ordered = accumulate(
        down.withColumn("_neg", -F.col("_down")), keys, ["_neg"], slice_by=id_slice("_neg"), number="position"
    ).drop("_neg", "_down", "_up")
    fwd = edges.select(*keys, "from", "to")
    straight = fwd.join(
        ordered.withColumnsRenamed({"parent": "from", "child": "to"}), [*keys, "from", "to"]
    ).withColumn("reversed_edge", F.lit(False))
    turned = fwd.join(
        ordered.withColumnsRenamed({"parent": "to", "child": "from"}), [*keys, "from", "to"]
    ).withColumn("reversed_edge", F.lit(True))
    both = straight.unionByName(turned)
    return both.select(
        *keys, "from", "to",
        F.when(F.col("reversed_edge"), F.col("to")).otherwise(F.col("from")).alias("parent"),
        F.when(F.col("reversed_edge"), F.col("from")).otherwise(F.col("to")).alias("child"),
        "reversed_edge", "position",
    )


def grow_trunk(
    edges: DataFrame, keys: Sequence[str], *, grafting: DataFrame | None = None, root: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Sections of the trunk that follows the edges of a connecting tree.

    ``edges``: (keys, from, to, x_from .. z_to, target_is_terminal); ``grafting``: (keys, x, y, z)
    of the section end the trunk is attached to.  Without grafting a root section 0 is made: the
    single edge at the root, or, if the trunk forks there, a section to the mean of the root and
    its neighbours, from which the others start.  With grafting section 0 stands for the section
    attached to and root edges start at its end.  Returns sections (keys, section_id,
    parent_section_id, x_from .. z_to) and the edges with ``section_id`` and ``reversed_edge``.
    """
    keys = list(keys)
    at_root = F.col("parent") == root
    edges = edges.drop("parent", "child", "section_id", "reversed_edge")
    walk = written(orient_tree(edges, keys, root=root).join(edges, [*keys, "from", "to"]), "trunk-walk")
    flip = F.col("reversed_edge")
    for f, t in zip(FROM, TO):
        walk = walk.withColumn(f"_a{f[0]}", F.when(flip, F.col(t)).otherwise(F.col(f)))
        walk = walk.withColumn(f"_b{f[0]}", F.when(flip, F.col(f)).otherwise(F.col(t)))
    tops = walk.filter(at_root).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.first(f"_a{a}").alias(f"_r{a}") for a in geo.AXES],
        *[F.sum(f"_b{a}").alias(f"_t{a}") for a in geo.AXES],
    )
    mean = {a: (F.col(f"_r{a}") + F.col(f"_t{a}")) / (F.col("_n") + 1) for a in geo.AXES}
    if grafting is None:
        hub = tops.select(
            *keys, "_n",
            *[F.col(f"_r{a}").alias(f"_r{a}") for a in geo.AXES],
            *[F.when(F.col("_n") > 1, mean[a]).otherwise(F.col(f"_t{a}")).alias(f"_h{a}") for a in geo.AXES],
        )
        root_is_edge = F.col("_n") == 1
    else:
        hub = tops.join(grafting, keys).select(
            *keys, "_n",
            *[F.col(a).alias(f"_r{a}") for a in geo.AXES], *[F.col(a).alias(f"_h{a}") for a in geo.AXES],
        )
        root_is_edge = F.lit(False)
    placed = walk.join(hub, keys).withColumn("_is_root", at_root & root_is_edge)
    number = F.when(F.col("_is_root"), F.lit(0)).otherwise(
        F.col("position") - F.when(root_is_edge, F.lit(1)).otherwise(F.lit(0))
    ).cast("bigint")
    placed = written(placed.withColumn("section_id", number), "trunk-sections")
    above = placed.select(*keys, F.col("child").alias("parent"), F.col("section_id").alias("_above"))
    grown = placed.filter(~F.col("_is_root")).join(above, [*keys, "parent"], "left").select(
        *keys, "section_id", F.coalesce("_above", F.lit(0)).cast("bigint").alias("parent_section_id"),
        *[F.when(at_root, F.col(f"_h{a}")).otherwise(F.col(f"_a{a}")).alias(f"{a}_from") for a in geo.AXES],
        *[F.col(f"_b{a}").alias(f"{a}_to") for a in geo.AXES],
    )
    first = hub.select(
        *keys, F.lit(0).cast("bigint").alias("section_id"), F.lit(-1).cast("bigint").alias("parent_section_id"),
        *[F.col(f"_r{a}").alias(f"{a}_from") for a in geo.AXES],
        *[F.col(f"_h{a}").alias(f"{a}_to") for a in geo.AXES],
    )
    tagged = placed.select(*edges.columns, "section_id", "reversed_edge")
    return first.unionByName(grown), tagged
