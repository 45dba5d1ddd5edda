"""Terminal clustering: spheres, spheres with a path limit, region components, properties."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborframe.functions import geometry as geo
from arborframe.operators.core import accumulate, id_slice, written
from arborframe.operators.graph import whole_graphs
from arborframe.operators.spatial import close_components, components, pairs_within
from arborframe.operators.trees import ancestors, common_path

# Fewest points an axon needs, fewest points or clusters a graph keeps.
MIN_AXON_POINTS = 5
MIN_GRAPH_POINTS = 4

# Most pairs of a tree whose paths are made in one task.
MOST_PAIRS = 1 << 17
METHODS = ("sphere", "sphere_parents", "brain_regions", "basic")


@dataclass(frozen=True)
class ClusterConfig:
    """Method and parameters of one clustering; missing values get the method's defaults."""

    method: str
    sphere_radius: float = 100.0
    min_size: int = 10
    max_path_distance: float | None = None
    wm_unnesting: bool = True

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown clustering method {self.method!r}, expected one of {METHODS}")
        if self.sphere_radius <= 0:
            raise ValueError("sphere_radius must be positive")
        if self.min_size < 1:
            raise ValueError("min_size must be at least 1")
        if self.max_path_distance is not None and self.max_path_distance <= 0:
            raise ValueError("max_path_distance must be positive")

    @property
    def path_limit(self) -> float:
        return self.sphere_radius if self.max_path_distance is None else self.max_path_distance


def checked_configs(configs: DataFrame) -> DataFrame:
    """A table of clusterings with the defaults of their methods and what is wrong with them.

    ``configs``: (name, method, sphere_radius, min_size, max_path_distance), parameters NULL where
    not given.  Parameters that a method does not have become NULL.  ``problem`` names the first
    rule that a row breaks, NULL where it may be used; a name that comes twice is wrong each time.
    """
    sphere = F.col("method").isin("sphere", "sphere_parents")
    twice = F.count(F.lit(1)).over(Window.partitionBy("name")) > 1  # few clusterings share a name
    radius = F.when(sphere, F.coalesce("sphere_radius", F.lit(ClusterConfig.sphere_radius)))
    size = F.when(F.col("method") == "sphere", F.coalesce("min_size", F.lit(ClusterConfig.min_size)))
    path = F.when(F.col("method") == "sphere_parents", F.coalesce("max_path_distance", radius))
    problem = (
        F.when(F.col("name").isNull(), F.lit("no name")).when(twice, F.lit("name given twice"))
        .when(~F.coalesce(F.col("method").isin(*METHODS), F.lit(False)), F.lit("unknown method"))
        .when(radius <= 0, F.lit("sphere_radius must be positive"))
        .when(size < 1, F.lit("min_size must be at least 1"))
        .when(path <= 0, F.lit("max_path_distance must be positive"))
    )
    return configs.select(
        "name", "method", radius.alias("sphere_radius"), size.alias("min_size"), path.alias("max_path_distance"),
        F.when(F.col("method") == "brain_regions", F.lit(ClusterConfig.wm_unnesting)).alias("wm_unnesting"),
        problem.alias("problem"),
    )


def method_of(point_counts: DataFrame, config: ClusterConfig, *, atlas: object = None, recipe: object = None) -> DataFrame:
    """Method to use per axon: the configured one, or ``basic`` below five points.

    ``point_counts`` has a column ``n_points``.
    """
    if config.method == "brain_regions" and (atlas is None or recipe is None):
        raise ValueError("clustering by brain regions needs an atlas and a recipe")
    small = F.col("n_points") < MIN_AXON_POINTS
    return point_counts.withColumn(
        "method", F.when(small, F.lit("basic")).otherwise(F.lit(config.method))
    )


def cluster_axons(
    nodes: DataFrame, terminals: DataFrame, keys: Sequence[str], configs: dict[str, ClusterConfig], *,
    region_edges: DataFrame | None = None, node: str = "id", parent: str = "parent_id",
) -> tuple[DataFrame, DataFrame]:
    """All clusterings of all axons: clusters (config_name, keys, method, terminal_id, size, x, y,
    z) and members (config_name, keys, node, tuft_id).

    ``nodes``: (keys, node, parent, x, y, z), ``terminals``: (keys, node, x, y, z, is_root),
    ``region_edges``: (keys, source, target, region_id), cut at region borders, without which
    clustering by brain regions is an error.  Axons of fewer than five nodes are clustered as
    ``basic`` in every clustering; the root is a terminal only of path clusters.
    """
    keys = list(keys)
    counts = written(nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points")), "axon-sizes")
    clusters, members = [], []

    def of(rows: DataFrame, axons: DataFrame) -> DataFrame:
        return rows.join(axons.select(*keys), keys, "left_semi")

    def run(method: str, config: ClusterConfig, axons: DataFrame) -> tuple[DataFrame, DataFrame]:
        ends = of(terminals, axons)
        others = ends.filter(~F.col("is_root")).drop("is_root")
        if method == "basic":
            one = basic(others.withColumn("terminal_id", F.lit(1)), keys)
            return one, others.select(*keys, node, F.lit(1).cast("bigint").alias("tuft_id"))
        if method == "sphere":
            return sphere_clusters(others, keys, config, node=node)
        if method == "sphere_parents":
            return sphere_parent_clusters(of(nodes, axons), ends, keys, config, node=node, parent=parent)
        return region_clusters(of(region_edges, axons), others, keys, node=node)

    for name, config in configs.items():
        chosen = method_of(counts, config, atlas=region_edges, recipe=region_edges)
        for method in dict.fromkeys((config.method, "basic")):
            axons = chosen.filter(F.col("method") == method)
            if axons.isEmpty():
                continue
            table, placed = run(method, config, axons)
            label = F.lit(name).alias("config_name")
            clusters.append(table.select(
                label, *keys, F.lit(method).alias("method"), F.col("terminal_id").cast("bigint").alias("terminal_id"),
                F.col("size").cast("bigint").alias("size"), *geo.AXES,
            ))
            members.append(placed.select(label, *keys, node, F.col("tuft_id").cast("bigint").alias("tuft_id")))
    if not clusters:
        none = nodes.limit(0).select(F.lit("").alias("config_name"), *keys)
        empty = none.select("*", F.lit("").alias("method"), *[F.lit(0).cast("bigint").alias(c) for c in ("terminal_id", "size")], *[F.lit(0.0).alias(a) for a in geo.AXES])
        return empty, none.select("*", F.lit(0).cast("bigint").alias(node), F.lit(0).cast("bigint").alias("tuft_id"))
    out = [clusters[0], members[0]]
    for table, placed in zip(clusters[1:], members[1:]):
        out = [out[0].unionByName(table), out[1].unionByName(placed)]
    return out[0], out[1]


def basic(terminals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One cluster per axon: all terminals but the root, with their mean position."""
    return (
        terminals.filter("terminal_id <> 0").groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("size"), *[F.avg(a).alias(a) for a in geo.AXES])
        .withColumn("terminal_id", F.lit(1).cast("bigint"))
    )


# --- spheres --------------------------------------------------------------------------------


def dense_labels(labelled: DataFrame, keys: Sequence[str], *, into: str = "label") -> DataFrame:
    """Components numbered from 0 by their smallest id."""
    firsts = labelled.select(*keys, "component").distinct()
    named = accumulate(firsts, keys, ["component"], slice_by=id_slice("component"), number=into)
    return labelled.join(named.withColumn(into, F.col(into) - 1), [*keys, "component"])


def sphere_members(
    points: DataFrame, keys: Sequence[str], config: ClusterConfig, *, node: str = "id"
) -> DataFrame:
    """Points with their component, its size, centre distance and whether it is a cluster.

    A component is a cluster with at least ``min_size`` members, of which at least ``min_size``
    lie within the radius of the mean position.  Adds (label, size, distance, is_cluster).
    """
    keys = list(keys)
    found = close_components(points, keys, config.sphere_radius, node=node)
    labelled = written(
        points.join(dense_labels(found, keys), [*keys, node]), "sphere-labels"
    )
    centre = labelled.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(a).alias(f"_c{a}") for a in geo.AXES]
    )
    measured = labelled.join(centre, [*keys, "label"]).withColumn(
        "distance", geo.distance(["_cx", "_cy", "_cz"], list(geo.AXES))
    )
    inside = measured.groupBy(*keys, "label").agg(
        F.count(F.when(F.col("distance") <= config.sphere_radius, F.lit(1))).alias("_inside")
    )
    return (
        measured.join(inside, [*keys, "label"])
        .withColumn(
            "is_cluster",
            (F.col("size") >= config.min_size) & (F.col("_inside") >= config.min_size),
        )
        .drop("_cx", "_cy", "_cz", "_inside")
    )


def release_farthest(members: DataFrame, keys: Sequence[str], *, node: str = "id") -> DataFrame:
    """Release the farthest members of the smallest clusters so that four points remain.

    Clusters merge one after the other, smallest first (ties by label).  Before the i-th merges
    (i from 0) the points outside the first i+1 clusters and the i+1 clusters must be more than
    three; otherwise the missing number of farthest members is released.  Only the three smallest
    clusters of a group can ever be short, so three quotas per group settle the sequence.
    Adds ``released``.
    """
    keys = list(keys)
    sizes = members.filter("is_cluster").groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_s"))
    order = accumulate(
        sizes, keys, ["_s", "label"], slice_by=F.struct("_s", id_slice("label")), number="_rank"
    )
    total = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    firsts = order.filter("_rank <= 3").groupBy(*keys).agg(
        *[F.max(F.when(F.col("_rank") == n + 1, F.col("_s"))).alias(f"_s{n}") for n in range(3)]
    )
    table = firsts.join(total, keys)
    left: Column = F.col("_total")
    for n in range(3):
        # points outside the clusters merged so far, including those released before
        left = left - F.coalesce(F.col(f"_s{n}"), F.lit(0))
        if n:
            left = left + F.col(f"_q{n - 1}")
        short = (left + n + 1 <= 3) & F.col(f"_s{n}").isNotNull()
        table = table.withColumn(
            f"_q{n}", F.when(short, F.greatest(F.lit(0), F.lit(3 - n) - left)).otherwise(F.lit(0))
        )
    quota = F.coalesce(*[F.when(F.col("_rank") == n + 1, F.col(f"_q{n}")) for n in range(3)])
    quotas = order.filter("_rank <= 3").join(table, keys).withColumn("_quota", quota).filter(
        "_quota > 0"
    ).select(*keys, "label", "_quota")
    # at most three members go, so the three farthest per cluster are enough
    farthest = _top_three(members.join(quotas, [*keys, "label"]), [*keys, "label", "_quota"], node)
    gone = farthest.select(*keys, F.explode(F.slice("_far", 1, F.col("_quota").cast("int"))).alias("_f")).select(
        *keys, F.col(f"_f.{node}").alias(node), F.lit(True).alias("released")
    )
    return members.join(gone, [*keys, node], "left").withColumn(
        "released", F.coalesce("released", F.lit(False))
    )


def _top_three(rows: DataFrame, keys: Sequence[str], node: str) -> DataFrame:
    """The three farthest rows per group, found by repeated maxima instead of a sort."""
    value = F.struct("distance", node)
    picks = None
    rest = rows
    for n in range(3):
        best = rest.groupBy(*keys).agg(F.max(value).alias(f"_m{n}"))
        rest = rest.join(best, list(keys)).filter(value < F.col(f"_m{n}")).drop(f"_m{n}")
        picks = best if picks is None else picks.join(best, list(keys), "left")
    return picks.select(
        *keys, F.array_compact(F.array("_m0", "_m1", "_m2")).alias("_far")
    )


def sphere_clusters(
    points: DataFrame, keys: Sequence[str], config: ClusterConfig, *, node: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """Sphere clustering of terminals: cluster table and the cluster of every terminal.

    Clusters keep the number of their component as ``terminal_id``; points outside clusters fill
    the numbers the clusters leave free, in id order.  Returns clusters (keys, terminal_id, size,
    x, y, z) and members (keys, node, tuft_id).
    """
    keys = list(keys)
    members = written(
        release_farthest(sphere_members(points, keys, config, node=node), keys, node=node),
        "sphere-members",
    )
    merged = members.filter(F.col("is_cluster") & ~F.col("released"))
    alone = members.filter(~F.col("is_cluster") | F.col("released"))
    centres = merged.groupBy(*keys, F.col("label").alias("terminal_id")).agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(a).alias(a) for a in geo.AXES]
    )
    free = free_numbers(centres.select(*keys, F.col("terminal_id").alias("number")),
                        alone.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_free")), keys)
    order = accumulate(alone, keys, [node], slice_by=id_slice(node), number="_rank")
    singles = order.join(free, [*keys, "_rank"]).withColumn("terminal_id", F.col("number"))
    table = centres.unionByName(
        singles.select(*keys, "terminal_id", F.lit(1).cast("bigint").alias("size"), *geo.AXES)
    )
    members_out = merged.select(*keys, node, F.col("label").alias("tuft_id")).unionByName(
        singles.select(*keys, node, F.col("terminal_id").alias("tuft_id"))
    )
    return table, members_out


def free_numbers(used: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The smallest unused numbers from 0, ranked: (keys, number, _rank).

    ``used``: (keys, number); ``wanted``: (keys, n_free).
    """
    keys = list(keys)
    taken = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("_taken"))
    span = wanted.join(taken, keys, "left").withColumn(
        "number",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_free") + F.coalesce("_taken", F.lit(0)) - 1)),
    )
    free = span.join(used.select(*keys, "number"), [*keys, "number"], "left_anti").select(*keys, "number")
    return accumulate(free, keys, ["number"], slice_by=id_slice("number"), number="_rank")


# --- spheres with a path limit ------------------------------------------------------------------


def close_paths(
    nodes: DataFrame, terminals: DataFrame, keys: Sequence[str], config: ClusterConfig, *,
    node: str = "id", parent: str = "parent_id",
) -> DataFrame:
    """Pairs of terminals within the radius whose tree path nowhere spreads beyond the limit.

    ``nodes``: (keys, node, parent, x, y, z), ``terminals`` a subset without the root.  The
    largest distance between any two nodes of the path decides.  The box of the path settles
    most pairs; only for the rest the few nodes of the path are compared inside the row.
    """
    keys = list(keys)
    limit = config.path_limit
    pairs = written(
        pairs_within(terminals.withColumnRenamed(node, "id"), keys, config.sphere_radius).select(
            *keys, "a", "b"
        ),
        "terminal-pairs",
    )
    ends = pairs.select(*keys, F.col("a").alias(node)).unionByName(
        pairs.select(*keys, F.col("b").alias(node))
    ).distinct()
    up = ancestors(nodes, keys, node=node, parent=parent, of=ends)
    at = nodes.select(*keys, F.col(node).alias("ancestor"), *geo.AXES)
    up = written(up.join(at, [*keys, "ancestor"]), "terminal-ways")

    def paths(up: DataFrame, pairs: DataFrame) -> DataFrame:
        legs = pairs.join(up.withColumnRenamed(node, "a"), [*keys, "a"]).unionByName(
            pairs.join(up.withColumnRenamed(node, "b"), [*keys, "b"])
        )
        return legs.groupBy(*keys, "a", "b", "ancestor").agg(
            F.count(F.lit(1)).alias("_n"), F.min("steps").alias("_steps"), *[F.first(c).alias(c) for c in geo.AXES]
        )

    own, met = F.col("_n") == 1, F.col("_n") == 2
    lowest = F.min_by(F.struct(*geo.AXES), F.when(met, F.col("_steps")))

    def boxes(up: DataFrame, pairs: DataFrame) -> DataFrame:
        return paths(up, pairs).groupBy(*keys, "a", "b").agg(
            lowest.alias("_l"), *[f(F.when(own, F.col(c))).alias(f"_{n}{c}") for c in geo.AXES for n, f in (("min", F.min), ("max", F.max))]
        )

    def listed(up: DataFrame, pairs: DataFrame) -> DataFrame:
        spots = F.collect_list(F.when(own, F.struct(*geo.AXES)))
        return paths(up, pairs).groupBy(*keys, "a", "b").agg(F.concat(spots, F.array_compact(F.array(lowest))).alias("_path"))

    box = whole_graphs(up, pairs, keys, boxes, most=MOST_PAIRS).select(
        *keys, "a", "b", *[(F.greatest(f"_max{c}", f"_l.{c}") - F.least(f"_min{c}", f"_l.{c}")).alias(f"_w{c}") for c in geo.AXES]
    )
    wide = F.greatest("_wx", "_wy", "_wz")
    diagonal = geo.norm([F.col("_wx"), F.col("_wy"), F.col("_wz")])
    judged = written(
        box.filter(wide <= limit).select(*keys, "a", "b", (diagonal <= limit).alias("_sure")),
        "path-boxes",
    )
    open_paths = judged.filter(~F.col("_sure")).select(*keys, "a", "b")

    def apart(p: Column) -> Column:
        return F.exists("_path", lambda q: geo.distance([p["x"], p["y"], p["z"]], [q["x"], q["y"], q["z"]]) > limit)

    narrow = whole_graphs(up, open_paths, keys, listed, most=MOST_PAIRS).filter(~F.exists("_path", apart))
    return judged.filter("_sure").select(*keys, "a", "b").unionByName(narrow.select(*keys, "a", "b"))


def sphere_parent_clusters(
    nodes: DataFrame, terminals: DataFrame, keys: Sequence[str], config: ClusterConfig, *,
    node: str = "id", parent: str = "parent_id",
) -> tuple[DataFrame, DataFrame]:
    """Clusters of terminals joined by close paths, split until at least four exist.

    ``terminals``: (keys, node, x, y, z, is_root).  The root is a cluster of its own with
    terminal id 0; the others are numbered from 1, largest first, ties by smallest member.
    Returns clusters (keys, terminal_id, size, x, y, z) and members (keys, node, tuft_id).
    """
    keys = list(keys)
    others = terminals.filter(~F.col("is_root"))
    linked = close_paths(nodes, others, keys, config, node=node, parent=parent)
    comp = components(linked, keys).withColumnRenamed("id", node)
    joined = others.join(comp, [*keys, node], "left").withColumn(
        "_cluster", F.coalesce("component", node)
    ).drop("component")
    joined = written(joined, "path-clusters")
    members = split_small_groups(nodes, joined, keys, node=node, parent=parent)
    sizes = members.groupBy(*keys, "_cluster", "_part").agg(
        F.count(F.lit(1)).alias("size"), F.min(node).alias("_first"),
        *[F.avg(a).alias(a) for a in geo.AXES],
    )
    whole = sizes.groupBy(*keys, "_cluster").agg(F.sum("size").alias("_all"))
    ranked = accumulate(
        sizes.join(whole, [*keys, "_cluster"]).withColumn("_neg", -F.col("_all")),
        keys, ["_neg", "_cluster", "_first"],
        slice_by=F.struct("_neg", id_slice("_cluster")), number="terminal_id",
    )
    table = ranked.select(*keys, "terminal_id", "size", *geo.AXES).unionByName(
        terminals.filter("is_root").select(
            *keys, F.lit(0).cast("bigint").alias("terminal_id"),
            F.lit(1).cast("bigint").alias("size"), *geo.AXES,
        )
    )
    out = members.join(ranked.select(*keys, "_cluster", "_part", "terminal_id"), [*keys, "_cluster", "_part"]).select(
        *keys, node, F.col("terminal_id").alias("tuft_id")
    ).unionByName(
        terminals.filter("is_root").select(*keys, node, F.lit(0).cast("bigint").alias("tuft_id"))
    )
    return table, out


def split_small_groups(
    nodes: DataFrame, members: DataFrame, keys: Sequence[str], *, node: str, parent: str
) -> DataFrame:
    """Split clusters at the children of their common ancestor while a tree has too few.

    Trees with fewer than four clusters, the root's included, split the largest cluster first,
    part by part, until four exist or nothing is left to split.  Adds ``_part`` (a number per
    cluster).  At most three parts are added per tree, so three passes settle everything.
    """
    keys = list(keys)
    state = members.withColumn("_part", F.lit(0).cast("bigint"))
    counts = members.select(*keys, "_cluster").distinct().groupBy(*keys).agg(
        (F.count(F.lit(1)) + 1).alias("_k")
    )
    poor = written(counts.filter(F.col("_k") < MIN_GRAPH_POINTS).select(*keys), "poor-trees")
    if poor.limit(1).count() == 0:
        return state
    rich = state.join(poor, keys, "left_anti")
    state = written(state.join(poor, keys, "left_semi"), "poor-members")
    up = written(
        ancestors(nodes.join(poor, keys, "left_semi"), keys, node=node, parent=parent,
                  of=state.select(*keys, node)),
        "poor-paths",
    )
    for _ in range(MIN_GRAPH_POINTS - 1):
        parts = state.groupBy(*keys, "_cluster", "_part").agg(F.count(F.lit(1)).alias("_n"))
        total = parts.groupBy(*keys).agg((F.count(F.lit(1)) + 1).alias("_k"))
        sizes = parts.groupBy(*keys, "_cluster").agg(F.sum("_n").alias("_all"))
        open_parts = (
            parts.filter("_n > 1").join(total.filter(F.col("_k") < MIN_GRAPH_POINTS), keys)
            .join(sizes, [*keys, "_cluster"])
        )
        # the largest cluster that can still be split, and its earliest part
        chosen = open_parts.groupBy(*keys).agg(
            F.min_by(F.struct("_cluster", "_part", "_n"), F.struct(-F.col("_all"), "_cluster", "_part")).alias("_c")
        ).select(*keys, "_c.*")
        chosen = written(chosen, "split-chosen")
        if chosen.limit(1).count() == 0:
            break
        inside = state.join(chosen, [*keys, "_cluster", "_part"])
        shared = inside.join(up, [*keys, node]).groupBy(*keys, "_cluster", "_part", "_n", "ancestor").agg(
            F.count(F.lit(1)).alias("_m"), F.min("steps").alias("_steps")
        ).filter("_m = _n")
        lowest = shared.groupBy(*keys, "_cluster", "_part").agg(F.min_by("ancestor", "_steps").alias("_top"))
        # a member's way down from the common ancestor starts at one of its children
        to_top = inside.join(lowest, [*keys, "_cluster", "_part"]).join(
            up.select(*keys, node, F.col("ancestor").alias("_top"), F.col("steps").alias("_to")),
            [*keys, node, "_top"],
        )
        child = to_top.join(
            up.select(*keys, node, F.col("ancestor").alias("_child"), (F.col("steps") + 1).alias("_to")),
            [*keys, node, "_to"], "left",
        ).select(*keys, node, F.coalesce("_child", F.col(node)).alias("_child"))
        # new parts come after all parts so far: child ids are larger than any part number
        state = written(
            state.join(child, [*keys, node], "left")
            .withColumn("_part", F.coalesce("_child", "_part")).drop("_child"),
            "poor-members",
        )
    return rich.unionByName(state.select(*rich.columns))


# --- regions ------------------------------------------------------------------------------------


def region_clusters(
    edges: DataFrame, terminals: DataFrame, keys: Sequence[str], *, region: str = "region_id",
    node: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """Terminals grouped by the connected piece of the tree that they share inside one region.

    ``edges``: (keys, source, target, region), cut at region borders; a terminal belongs to the
    piece of the edge that ends in it.  Pieces are numbered from 0 by region and smallest node;
    only those with a terminal become clusters.  Returns clusters (keys, terminal_id, size, x, y,
    z) and members (keys, node, tuft_id).
    """
    keys = list(keys)
    pieces = components(
        edges.select(*keys, region, F.col("source").alias("a"), F.col("target").alias("b")),
        [*keys, region],
    )
    ends = edges.select(*keys, region, F.col("target").alias(node))
    placed = written(
        terminals.join(ends, [*keys, node]).join(pieces.withColumnRenamed("id", node), [*keys, region, node]),
        "region-terminals",
    )
    used = placed.select(*keys, region, "component").distinct()
    numbered_pieces = accumulate(
        used, keys, [region, "component"], slice_by=F.struct(region, id_slice("component")),
        number="_rank",
    ).withColumn("tuft_id", F.col("_rank") - 1).drop("_rank")
    members = placed.join(numbered_pieces, [*keys, region, "component"])
    table = members.groupBy(*keys, F.col("tuft_id").alias("terminal_id")).agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(a).alias(a) for a in geo.AXES]
    )
    return table, members.select(*keys, node, "tuft_id")


# --- properties ---------------------------------------------------------------------------------


def mean_tuft_length(
    volume: Column, n_pot: Column, fraction: Column, strength: Column, bouton_density: Column
) -> Column:
    """Synapses per active cell over the bouton density; NULL as soon as one part is."""
    return F.try_divide(F.try_divide(volume * strength, n_pot * fraction), bouton_density)


def cluster_properties(
    section_table: DataFrame, members: DataFrame, clusters: DataFrame, measures: DataFrame,
    keys: Sequence[str],
) -> DataFrame:
    """Properties of the clusters with a positive id.

    ``members``: (keys, section_id, tuft_id) with the terminal section of each member;
    ``clusters``: (keys, terminal_id, size, x, y, z); ``measures`` from
    :func:`arborframe.operators.trees.section_measures`.  The common ancestor is the lowest
    section all members share; a cluster of one takes the section above when its path is longer
    than two nodes.  Returns (keys, tuft_id, size, common_ancestor_id, common_ancestor_x.., u x y
    z of the orientation and the ancestor's measures).
    """
    keys = list(keys)
    wanted = members.filter("tuft_id > 0")
    shared = common_path(
        section_table, wanted, keys, ["tuft_id"], node="section_id", parent="parent_section_id"
    )
    shared = written(shared, "cluster-paths")
    span = shared.groupBy(*keys, "tuft_id").agg(F.max("depth").alias("_depth"))
    size = wanted.groupBy(*keys, "tuft_id").agg(F.count(F.lit(1)).alias("size"))
    # depth counts sections from 0; with the root node before them a path has depth + 2 nodes
    lift = F.when((F.col("size") == 1) & (F.col("_depth") + 2 > 2), F.lit(1)).otherwise(F.lit(0))
    chosen = (
        shared.join(span, [*keys, "tuft_id"]).join(size, [*keys, "tuft_id"])
        .filter(F.col("depth") == F.col("_depth") - lift)
        .select(*keys, "tuft_id", "size", F.col("ancestor").alias("section_id"))
    )
    centre = clusters.select(
        *keys, F.col("terminal_id").alias("tuft_id"), *[F.col(a).alias(f"_c{a}") for a in geo.AXES]
    )
    out = chosen.join(measures, [*keys, "section_id"]).join(centre, [*keys, "tuft_id"])
    toward = geo.unit(geo.vector(geo.triple("", "_last"), ["_cx", "_cy", "_cz"]))
    return out.select(
        *keys, "tuft_id", "size", F.col("section_id").alias("common_ancestor_id"),
        *[F.col(f"{a}_last").alias(f"common_ancestor_{a}") for a in geo.AXES],
        *[F.col(f"_c{a}").alias(f"center_{a}") for a in geo.AXES],
        *[c.alias(f"u{a}") for c, a in zip(toward, geo.AXES)],
        "path_distance", "radial_distance", "path_length", "max_path_extent",
    )


def assemble_terminals(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of cluster tables of several methods, unknown sizes counted as 1, in key order."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.withColumn("size", F.coalesce("size", F.lit(1))).orderBy(*keys, "terminal_id")


def morphology_name(path: Column) -> Column:
    """File name without folders and suffix."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


# --- density minima -----------------------------------------------------------------------------


def density_minima(
    values: DataFrame, keys: Sequence[str], *, value: str, bins: int = 100, threshold: float = 0.1
) -> DataFrame:
    """Positions of the minima of a Gaussian density estimate per group.

    The density is read at the centres of ``bins`` equal bins over the range of the values, with
    the bandwidth of Scott's rule.  Bins whose slope is below ``threshold`` times the steepest
    one (doubled until some qualify) and whose curvature is positive are minima; of those between
    two sign changes of the slope, then of the curvature, the upper middle one stays.  Returns
    (keys, bin, position).  Values meet bins inside partial sums; after that a group has one row
    per bin.
    """
    keys = list(keys)
    x = F.col(value)
    stats = values.groupBy(*keys).agg(
        F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(F.lit(1)).alias("_n"),
        F.var_samp(x).alias("_var"),
    ).filter("_n > 1 and _var > 0")
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    spread = F.col("_var") * F.pow(F.col("_n").cast("double"), F.lit(-0.4))
    asked = values.join(stats, keys).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    position = F.col("_lo") + (F.col("bin") + 0.5) * width
    gap = position - x
    density = (
        asked.withColumn("_e", F.exp(-gap * gap / (F.lit(2.0) * spread)))
        .groupBy(*keys, "bin")
        .agg(F.sum("_e").alias("_sum"), F.first(position).alias("position"),
             F.first(spread).alias("_spread"), F.first("_n").alias("_n"))
        .withColumn("_f", F.col("_sum") / (F.col("_n") * F.sqrt(F.lit(6.283185307179586) * F.col("_spread"))))
    )
    w = Window.partitionBy(*keys).orderBy("bin")

    def slope(name: str) -> Column:
        before, after, here = F.lag(name).over(w), F.lead(name).over(w), F.col(name)
        return F.when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise(
            (after - before) / 2
        )

    curve = density.withColumn("_d1", slope("_f")).withColumn("_d2", slope("_d1"))
    every = Window.partitionBy(*keys)
    ratio = F.abs("_d1") / F.max(F.abs("_d1")).over(every)
    curve = curve.withColumn("_ratio", ratio)
    least = F.min(F.when(F.col("_d2") > 0, F.col("_ratio"))).over(every)
    doublings = F.when(least < threshold, F.lit(0)).otherwise(
        F.floor(F.log2(least / F.lit(threshold))) + 1
    )
    # a change between a bin and the next one counts from that bin on
    for name in ("_d1", "_d2"):
        change = F.lead(F.signum(name)).over(w) != F.signum(name)
        curve = curve.withColumn(f"{name}_flip", F.coalesce(change, F.lit(False)).cast("int"))
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        curve = curve.withColumn(f"{name}_part", F.sum(f"{name}_flip").over(upto))
    low = curve.withColumn("_limit", F.lit(threshold) * F.pow(F.lit(2.0), doublings)).filter(
        (F.col("_ratio") < F.col("_limit")) & (F.col("_d2") > 0)
    )

    def middle(df: DataFrame, part: str) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct("bin", "position", "_d1_part", "_d2_part")))
        return df.groupBy(*keys, F.col(part).alias("_p")).agg(ordered.alias("_l")).select(
            *keys, F.element_at("_l", (F.floor(F.size("_l") / 2) + 1).cast("int")).alias("_m")
        ).select(*keys, "_m.*")

    return middle(middle(low, "_d1_part"), "_d2_part").select(*keys, "bin", "position")
