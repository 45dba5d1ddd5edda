"""Trees stored as point tables: sections, paths, ancestors, folds and subsets.

A point table has the key columns of its tree (``keys``), ``point_id``, ``parent_id`` (-1 or
NULL at the root), ``x, y, z, radius`` and usually ``type``.  Section ids are the id of the
point that opens the section; the root point belongs to section -1.

Sums along the way to the root and folds over subtrees are found by contraction, in pieces of
bounded size first; see :mod:`arborframe.operators.contraction`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborframe.functions import geometry as geo
from arborframe.operators.contraction import climb, is_root, ways_up
from arborframe.operators.core import Rounds, accumulate, id_slice, numbered, written
from arborframe.operators.intervals import common_ancestors, labels, paths_below

KEYS = ("morphology",)


def child_counts(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Number of children per point that has any: (keys, point_id, n_children)."""
    return (
        points.filter(~is_root())
        .groupBy(*keys, F.col("parent_id").alias("point_id"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )


# --- ways to the root ---------------------------------------------------------------------


def run_heads(
    nodes: DataFrame, keys: Sequence[str], *, node: str, parent: str, linked: str
) -> DataFrame:
    """Head of the unbranched run of every node and the number of links up to it.

    ``linked`` tells whether a node continues the run of its parent.  Returns
    (keys, node, head, steps).
    """
    found = climb(
        nodes, keys, node=node, parent=F.when(F.col(linked), F.col(parent)),
        up={"steps": F.when(F.col(linked), F.lit(1)).otherwise(F.lit(0)).cast("bigint")},
    )
    return found.select(*keys, node, F.col("_summit").alias("head"), "steps")


def fold(
    nodes: DataFrame,
    keys: Sequence[str],
    *,
    node: str,
    parent: str,
    up: dict[str, Column] | None = None,
    below: dict[str, tuple[str, Column]] | None = None,
    reach: dict[str, str] | None = None,
) -> DataFrame:
    """Sums along the path to the root and aggregates over each subtree, by contraction.

    ``up``: name -> value summed over the node and all its ancestors.
    ``below``: name -> ("sum" | "max" | "min", value) over the node and all its descendants.
    ``reach``: name -> an ``up`` name; the largest sum of that value on the way from the node
    (excluded) down to any descendant.
    Returns (keys, node, *names).
    """
    found = climb(
        nodes, keys, node=node, parent=F.when(~is_root(parent), F.col(parent)),
        up=up, below=below, reach=reach,
    )
    return found.drop("_summit")


def ancestors(
    nodes: DataFrame,
    keys: Sequence[str],
    *,
    node: str,
    parent: str,
    of: DataFrame | None = None,
) -> DataFrame:
    """Closure (keys, node, ancestor, steps) incl. the node itself at 0 steps.

    ``of`` restricts the left side to its distinct (keys, node) rows; the result then holds
    only the paths of those nodes.
    """
    return ways_up(nodes, keys, node=node, parent=F.when(~is_root(parent), F.col(parent)), of=of)


# --- sections -----------------------------------------------------------------------------


def assign_sections(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Points plus ``section_id``, ``sub_segment_num``, ``n_children`` and ``is_terminal``.

    A point opens a section when its parent is the root or has not exactly one child.  The
    root gets section -1 and counts as terminal.
    """
    keys = list(keys)
    counts = child_counts(points, keys)
    flagged = (
        points.join(counts, [*keys, "point_id"], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))
    )
    up = flagged.select(
        *keys,
        F.col("point_id").alias("parent_id"),
        F.col("n_children").alias("_pc"),
        is_root().alias("_proot"),
    )
    linked = flagged.join(up, [*keys, "parent_id"], "left").select(
        *keys, "point_id", "parent_id",
        F.coalesce((F.col("_pc") == 1) & ~F.col("_proot"), F.lit(False)).alias("_linked"),
    )
    heads = run_heads(linked, keys, node="point_id", parent="parent_id", linked="_linked")
    root = is_root()
    return (
        flagged.join(heads, [*keys, "point_id"])
        .withColumn("section_id", F.when(root, F.lit(-1)).otherwise(F.col("head")).cast("bigint"))
        .withColumn("sub_segment_num", F.col("steps"))
        .withColumn("is_terminal", root | (F.col("n_children") == 0))
        .drop("head", "steps")
    )


def with_parent_point(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Non-root points joined to their parent: coordinates as ``x_from ..`` and ``x_to ..``."""
    keys = list(keys)
    have_section = "section_id" in points.columns
    up = points.select(
        *keys,
        F.col("point_id").alias("parent_id"),
        *[F.col(a).alias(f"{a}_from") for a in geo.AXES],
        *([F.col("section_id").alias("parent_section_id")] if have_section else []),
    )
    own = points.filter(~is_root())
    for a in geo.AXES:
        own = own.withColumn(f"{a}_to", F.col(a))
    return own.join(up, [*keys, "parent_id"])


def sections(sectioned: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Section table from the result of :func:`assign_sections`.

    (keys, section_id, parent_section_id, first_point, last_point, n_points, n_children,
    is_leaf, length, x_first.., x_last..).  ``parent_section_id`` is -1 below the root.
    """
    keys = list(keys)
    seg = with_parent_point(sectioned, keys).withColumn(
        "_len", geo.distance(geo.triple("", "_from"), geo.triple("", "_to"))
    )
    last = F.struct("point_id", "n_children", "x", "y", "z")
    first = F.struct("parent_id", "parent_section_id", "x_from", "y_from", "z_from")
    grouped = seg.groupBy(*keys, "section_id").agg(
        F.min_by(first, "sub_segment_num").alias("_first"),
        F.max_by(last, "sub_segment_num").alias("_last"),
        (F.count(F.lit(1)) + 1).alias("n_points"),
        F.sum("_len").alias("length"),
    )
    return grouped.select(
        *keys,
        "section_id",
        F.col("_first.parent_section_id").alias("parent_section_id"),
        F.col("_first.parent_id").alias("first_point"),
        F.col("_last.point_id").alias("last_point"),
        "n_points",
        F.col("_last.n_children").alias("n_children"),
        (F.col("_last.n_children") == 0).alias("is_leaf"),
        "length",
        *[F.col(f"_first.{a}_from").alias(f"{a}_first") for a in geo.AXES],
        *[F.col(f"_last.{a}").alias(f"{a}_last") for a in geo.AXES],
    )


def axons(points: DataFrame, roots: DataFrame, *, axon_type: int, key: str = "morphology") -> DataFrame:
    """Axon neurites with their position among the axons of a morphology, from 0.

    ``roots`` has one row per neurite: (key, neurite, type, order) with a unique integer order.
    """
    chosen = numbered(roots.filter(F.col("type") == axon_type), [key], "order", "axon_id")
    return points.join(chosen.select(key, "neurite", "axon_id"), [key, "neurite"])


def keep_neurites(
    roots: DataFrame, *, neurite_type: int | None = None, position: int | None = None,
    drop: bool = False, key: str = "morphology",
) -> DataFrame:
    """Neurites of a type and, among those kept, the one at a position; or their complement."""
    out = roots
    if neurite_type is not None:
        out = out.filter(F.col("type") == neurite_type)
    if position is not None:
        out = numbered(out, [key], "order", "_pos").filter(F.col("_pos") == position).drop("_pos")
    if drop:
        return roots.join(out.select(key, "neurite"), [key, "neurite"], "left_anti")
    return out


def nodes_and_edges(
    sectioned: DataFrame, keys: Sequence[str] = KEYS, *, keep_section_segments: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Nodes and directed edges of a tree, from :func:`assign_sections`.

    Node id is the point id, -1 for the root.  Without segments only section ends remain and
    an edge joins the ends of parent and child section.
    """
    keys = list(keys)
    node_id = F.when(is_root(), F.lit(-1)).otherwise(F.col("point_id")).cast("bigint")
    wanted = ["x", "y", "z", "radius", "is_terminal", "section_id"]
    if keep_section_segments:
        nodes = sectioned.select(
            *keys, node_id.alias("id"), *wanted, "sub_segment_num"
        )
        roots = sectioned.filter(is_root()).select(*keys, F.col("point_id").alias("_root"))
        edges = (
            sectioned.filter(~is_root())
            .join(roots, keys)
            .select(
                *keys,
                F.when(F.col("parent_id") == F.col("_root"), F.lit(-1))
                .otherwise(F.col("parent_id")).cast("bigint").alias("source"),
                F.col("point_id").alias("target"),
            )
        )
        return nodes, edges
    table = sections(sectioned, keys)
    ends = table.select(*keys, F.col("last_point").alias("point_id"))
    kept = sectioned.join(ends, [*keys, "point_id"], "left_semi").unionByName(
        sectioned.filter(is_root())
    )
    nodes = kept.select(
        *keys, node_id.alias("id"), *wanted, F.lit(0).cast("bigint").alias("sub_segment_num")
    )
    above = table.select(
        *keys, F.col("section_id").alias("parent_section_id"), F.col("last_point").alias("_up")
    )
    edges = table.join(above, [*keys, "parent_section_id"], "left").select(
        *keys,
        F.coalesce("_up", F.lit(-1)).cast("bigint").alias("source"),
        F.col("last_point").alias("target"),
    )
    return nodes, edges


def edges_with_coords(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges with every node column of both ends, suffixed ``_from`` and ``_to``."""
    keys = list(keys)

    def side(end: str, suffix: str) -> DataFrame:
        return nodes.select(
            *keys,
            F.col("id").alias(end),
            *[F.col(c).alias(f"{c}{suffix}") for c in nodes.columns if c not in (*keys, "id")],
        )

    return edges.join(side("source", "_from"), [*keys, "source"]).join(
        side("target", "_to"), [*keys, "target"]
    )


def terminals(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Root as terminal 0, then the leaves numbered from 1 along the point order."""
    keys = list(keys)
    parents = points.select(*keys, F.col("parent_id").alias("point_id"))
    leaves = points.filter(~is_root()).join(parents, [*keys, "point_id"], "left_anti")
    found = numbered(leaves, keys, "point_id", "terminal_id", start=1)
    roots = points.filter(is_root()).withColumn("terminal_id", F.lit(0).cast("bigint"))
    return found.unionByName(roots.select(*found.columns))


# --- paths and subsets --------------------------------------------------------------------


def root_paths(nodes: DataFrame, keys: Sequence[str], *, node: str, parent: str) -> DataFrame:
    """Path from the root to every node, as one array per node: (keys, node, path)."""
    keys = list(keys)
    rounds = Rounds(nodes.sparkSession, "root-paths")
    state = rounds.cut(
        nodes.select(
            *keys, F.col(node).alias("_node"),
            F.when(~is_root(parent), F.col(parent)).alias("_hop"),
            F.array(F.col(node)).alias("path"),
        )
    )
    while True:
        rounds.next()
        far = state.select(
            *keys, F.col("_node").alias("_hop"), F.col("_hop").alias("_far"),
            F.col("path").alias("_head"),
        )
        state = rounds.cut(
            state.join(far, [*keys, "_hop"], "left").select(
                *keys, "_node", F.col("_far").alias("_hop"),
                F.when(F.col("_head").isNull(), F.col("path"))
                .otherwise(F.concat("_head", "path")).alias("path"),
            ),
            watch=F.col("_hop").isNotNull(),
        )
        if rounds.pending == 0:
            break
    return state.select(*keys, F.col("_node").alias(node), "path")


def terminals_below(
    nodes: DataFrame, leaves: DataFrame, keys: Sequence[str], *, node: str, parent: str
) -> DataFrame:
    """Relation (keys, node, terminal): which terminals lie below or at a node, one per row."""
    up = ancestors(nodes, keys, node=node, parent=parent, of=leaves)
    return up.select(*keys, F.col("ancestor").alias(node), F.col(node).alias("terminal"))


def common_path(
    nodes: DataFrame, members: DataFrame, keys: Sequence[str], sets: Sequence[str],
    *, node: str, parent: str,
) -> DataFrame:
    """Nodes on the path from the root that all members of a set share.

    ``members`` has (keys, sets, node).  Returns (keys, sets, ancestor, depth, is_lowest),
    depth counted from the root, ``is_lowest`` marking the lowest common ancestor.
    """
    keys, sets = list(keys), list(sets)
    labelled = labels(nodes, keys, node=node, parent=F.when(~is_root(parent), F.col(parent)))
    lowest = common_ancestors(labelled, members, keys, sets, node=node).filter(F.col("ancestor").isNotNull())
    lowest = written(lowest.withColumnRenamed("ancestor", node), "common-ancestors")
    # no way but those of the result is followed
    ways = ways_up(labelled, keys, node=node, parent=F.col("parent"), of=lowest)
    depth = labelled.select(*keys, F.col(node).alias("ancestor"), "depth")
    return lowest.join(ways, [*keys, node]).join(depth, [*keys, "ancestor"]).select(
        *keys, *sets, "ancestor", "depth", (F.col("steps") == 0).alias("is_lowest")
    )


def check_single_root(nodes: DataFrame, keys: Sequence[str], *, node: str, parent: str) -> DataFrame:
    """Trees that do not have exactly one root: (keys, n_roots)."""
    counts = nodes.groupBy(*keys).agg(
        F.sum(F.when(is_root(parent), 1).otherwise(0)).alias("n_roots")
    )
    return counts.filter(F.col("n_roots") != 1)


def tuft_nodes(
    nodes: DataFrame, members: DataFrame, keys: Sequence[str], sets: Sequence[str],
    *, node: str, parent: str,
) -> DataFrame:
    """Nodes on the paths to the members, without the shared path above the common ancestor.

    Returns (keys, sets, node, is_common_ancestor).
    """
    keys, sets = list(keys), list(sets)
    member = members.select(*keys, *sets, node).distinct()
    labelled = labels(nodes, keys, node=node, parent=F.when(~is_root(parent), F.col(parent)))
    lowest = written(common_ancestors(labelled, member, keys, sets, node=node), "common-ancestors")
    marked = lowest.select(*keys, *sets, F.col("ancestor").alias(node), F.lit(True).alias("_lowest"))
    return paths_below(labelled, member, keys, sets, node=node).join(marked, [*keys, *sets, node], "left").select(
        *keys, *sets, node, F.coalesce("_lowest", F.lit(False)).alias("is_common_ancestor")
    )


def trunk_and_clustered(
    section_table: DataFrame, kept: DataFrame, added: DataFrame, keys: Sequence[str] = KEYS
) -> tuple[DataFrame, DataFrame]:
    """Trunk: root sections plus the kept ones.  Clustered: the trunk plus straight sections.

    ``added`` has (keys, section_id of the common ancestor, x, y, z of a cluster centre).
    """
    keys = list(keys)
    top = section_table.filter(F.col("parent_section_id") == -1)
    lower = section_table.filter(F.col("parent_section_id") != -1).join(
        kept.select(*keys, "section_id").distinct(), [*keys, "section_id"], "left_semi"
    )
    cols = [*keys, "section_id", "parent_section_id", "length", *geo.triple("", "_first"),
            *geo.triple("", "_last")]
    trunk = top.unionByName(lower).select(*cols).withColumn("is_added", F.lit(False))
    ends = trunk.select(
        *keys, F.col("section_id").alias("parent_section_id"), *geo.triple("", "_last")
    )
    new = added.withColumnRenamed("section_id", "parent_section_id").join(
        ends, [*keys, "parent_section_id"]
    )
    extra = new.select(
        *keys,
        F.lit(None).cast("bigint").alias("section_id"),
        "parent_section_id",
        geo.distance(geo.triple("", "_last"), list(geo.AXES)).alias("length"),
        *[F.col(f"{a}_last").alias(f"{a}_first") for a in geo.AXES],
        *[F.col(a).alias(f"{a}_last") for a in geo.AXES],
        F.lit(True).alias("is_added"),
    )
    return trunk, trunk.unionByName(extra)


def resize_root_section(
    section_table: DataFrame, orientation: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Replace the root section by a unit segment that ends where it ended.

    ``orientation`` has one row per tree: (keys, ux, uy, uz).
    """
    out = section_table.join(orientation, list(keys), "left")
    hit = (F.col("parent_section_id") == -1) & F.col("ux").isNotNull()
    for a in geo.AXES:
        out = out.withColumn(
            f"{a}_first",
            F.when(hit, F.col(f"{a}_last") - F.col(f"u{a}")).otherwise(F.col(f"{a}_first")),
        )
    return out.withColumn("length", F.when(hit, F.lit(1.0)).otherwise(F.col("length"))).drop(
        "ux", "uy", "uz"
    )


def recenter(points: DataFrame, origin: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Shift every tree by minus its origin (keys, x, y, z), such as its soma point.

    Trees without an origin stay where they are; :func:`unplaced` names them.
    """
    o = origin.select(*keys, *[F.col(a).alias(f"_o{a}") for a in geo.AXES])
    out = points.join(o, list(keys), "left")
    for a in geo.AXES:
        out = out.withColumn(a, F.col(a) - F.coalesce(f"_o{a}", F.lit(0.0)))
    return out.drop("_ox", "_oy", "_oz")


def translate(points: DataFrame, positions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Shift every tree to its position (keys, atlas_x, atlas_y, atlas_z).

    Trees without a position stay where they are; :func:`unplaced` names them.
    """
    out = points.join(positions.select(*keys, *geo.triple("atlas_")), list(keys), "left")
    for a in geo.AXES:
        out = out.withColumn(a, F.col(a) + F.coalesce(f"atlas_{a}", F.lit(0.0)))
    return out.drop(*geo.triple("atlas_"))


def unplaced(points: DataFrame, places: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys of the trees that have no row in a table of origins or positions."""
    return points.select(*keys).distinct().join(places.select(*keys), list(keys), "left_anti")


def bounding_box(
    points: DataFrame, keys: Sequence[str], *,
    relative_buffer: float | None = None, absolute_buffer: float | None = None,
) -> DataFrame:
    """Box per group, widened per axis by the larger of the two buffers."""
    box = points.groupBy(*keys).agg(
        *[F.min(a).alias(f"{a}_min") for a in geo.AXES],
        *[F.max(a).alias(f"{a}_max") for a in geo.AXES],
    )
    for a in geo.AXES:
        options = []
        if relative_buffer is not None:
            options.append((F.col(f"{a}_max") - F.col(f"{a}_min")) * F.lit(relative_buffer))
        if absolute_buffer is not None:
            options.append(F.lit(float(absolute_buffer)))
        if options:
            box = box.withColumn("_b", F.greatest(*options) if len(options) > 1 else options[0])
            box = box.withColumn(f"{a}_min", F.col(f"{a}_min") - F.col("_b")).withColumn(
                f"{a}_max", F.col(f"{a}_max") + F.col("_b")
            )
    return box.drop("_b")


def merge_chains(
    section_table: DataFrame, tuft_roots: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Sections grouped into runs without branches: adds ``chain_id`` and ``chain_pos``.

    ``tuft_roots`` (keys, section_id, use_parent) ends a run after the section, or before it
    when ``use_parent`` is set.
    """
    keys = list(keys)
    up = section_table.select(
        *keys, F.col("section_id").alias("parent_section_id"), F.col("n_children").alias("_pc")
    )
    linked = section_table.join(up, [*keys, "parent_section_id"], "left").withColumn(
        "_linked", F.coalesce(F.col("_pc") == 1, F.lit(False))
    )
    if tuft_roots is not None:
        after = tuft_roots.filter(~F.col("use_parent")).select(
            *keys, F.col("section_id").alias("parent_section_id"), F.lit(True).alias("_cut_above")
        ).distinct()
        before = tuft_roots.filter("use_parent").select(
            *keys, "section_id", F.lit(True).alias("_cut_here")
        ).distinct()
        linked = (
            linked.join(after, [*keys, "parent_section_id"], "left")
            .join(before, [*keys, "section_id"], "left")
            .withColumn(
                "_linked",
                F.col("_linked") & F.col("_cut_above").isNull() & F.col("_cut_here").isNull(),
            )
        )
    heads = run_heads(
        linked, keys, node="section_id", parent="parent_section_id", linked="_linked"
    )
    return section_table.join(heads, [*keys, "section_id"]).withColumnsRenamed(
        {"head": "chain_id", "steps": "chain_pos"}
    )


def normalised_lengths(line: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds ``pos`` (1-based) and ``t``, the path length up to a point over the total."""
    keys = list(keys)
    numbered_pts = written(numbered(line, keys, order, "pos", start=1), "line")
    prev = numbered_pts.select(
        *keys, (F.col("pos") + 1).alias("pos"), *[F.col(a).alias(f"_p{a}") for a in geo.AXES]
    )
    steps = numbered_pts.join(prev, [*keys, "pos"], "left").withColumn(
        "_step",
        F.coalesce(geo.distance(["_px", "_py", "_pz"], list(geo.AXES)), F.lit(0.0)),
    )
    cum = written(
        accumulate(steps, keys, ["pos"], slice_by=id_slice("pos"), sums={"_cum": F.col("_step")}),
        "line-length",
    )
    total = cum.groupBy(*keys).agg(F.max("_cum").alias("_total"))
    return (
        cum.join(total, keys)
        .withColumn("t", F.when(F.col("_total") > 0, F.least(F.col("_cum") / F.col("_total"), F.lit(1.0))).otherwise(0.0))
        .drop("_px", "_py", "_pz", "_step", "_cum", "_total")
    )


def resample(
    line: DataFrame, target: DataFrame, keys: Sequence[str], *, order: str, value: str
) -> DataFrame:
    """Value of one polyline read at the normalised path lengths of another (linear).

    The spans between neighbouring points are spread over as many buckets of [0, 1] as the
    line has points, so each wanted position meets only a handful of spans.
    """
    keys = list(keys)
    have = normalised_lengths(line, keys, order).select(*keys, "pos", "t", value)
    size = have.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    nxt = have.select(
        *keys, (F.col("pos") - 1).alias("pos"), F.col("t").alias("_t1"), F.col(value).alias("_v1")
    )
    bucket = lambda t: F.least(F.floor(t * F.col("_n")), F.col("_n") - 1)
    spans = (
        have.join(nxt, [*keys, "pos"], "left")
        .join(size, keys)
        .withColumn("_t1", F.coalesce("_t1", "t"))
        .withColumn("_v1", F.coalesce("_v1", F.col(value)))
        .withColumn("_bucket", F.explode(F.sequence(bucket(F.col("t")), bucket(F.col("_t1")))))
        .select(*keys, "_bucket", F.col("t").alias("_t0"), "_t1", F.col(value).alias("_v0"), "_v1")
    )
    want = (
        normalised_lengths(target, keys, order)
        .join(size, keys)
        .withColumn("_bucket", bucket(F.col("t")))
        .select(*keys, F.col(order).alias("_row"), "t", "_bucket")
    )
    share = F.when(
        F.col("_t1") > F.col("_t0"), (F.col("t") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    ).otherwise(0.0)
    read = (
        want.join(spans, [*keys, "_bucket"])
        .filter((F.col("t") >= F.col("_t0")) & (F.col("t") <= F.col("_t1")))
        .withColumn("_value", F.col("_v0") + share * (F.col("_v1") - F.col("_v0")))
    )
    picked = read.groupBy(*keys, "_row").agg(F.max_by("_value", "_t0").alias(value))
    return picked.withColumnRenamed("_row", order)


def section_ends_from_origin(
    section_table: DataFrame, origin: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Last point of each section relative to the tree's origin (keys, x, y, z)."""
    o = origin.select(*keys, *[F.col(a).alias(f"_o{a}") for a in geo.AXES])
    return section_table.join(o, list(keys)).select(
        *keys, "section_id",
        *[(F.col(f"{a}_last") - F.col(f"_o{a}")).alias(a) for a in geo.AXES],
    )


def existing_axon_starts(
    roots: DataFrame, origin: DataFrame, *, axon_type: int, key: str = "morphology"
) -> DataFrame:
    """First point of every axon, relative to the origin of its morphology; axons of morphologies
    without an origin have no place."""
    roots = roots.join(origin.select(key), key, "left_semi")
    found = numbered(roots.filter(F.col("type") == axon_type), [key], "order", "axon_id")
    return recenter(found, origin, [key]).select(key, "axon_id", *geo.AXES)


def points_or_empty(names: DataFrame, points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Points of each named tree; a tree without points stays as one row of NULLs."""
    return names.select(*keys).distinct().join(points, list(keys), "left")


def section_graph(section_table: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Section-level tree: a node per section at its last point, root node -1 at the start."""
    keys = list(keys)
    top = section_table.filter(F.col("parent_section_id") == -1)
    start = top.groupBy(*keys).agg(
        F.min_by(F.struct(*geo.triple("", "_first")), "section_id").alias("_s")
    )
    nodes = section_table.select(
        *keys, F.col("section_id").alias("id"),
        *[F.col(f"{a}_last").alias(a) for a in geo.AXES],
        F.col("is_leaf").alias("is_terminal"),
    ).unionByName(
        start.select(
            *keys, F.lit(-1).cast("bigint").alias("id"),
            *[F.col(f"_s.{a}_first").alias(a) for a in geo.AXES],
            F.lit(True).alias("is_terminal"),
        )
    )
    edges = section_table.select(
        *keys, F.col("parent_section_id").alias("source"), F.col("section_id").alias("target")
    )
    return nodes, edges


def section_measures(section_table: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per section: path and radial distance of its end, length below, and longest path below.

    ``path_distance`` runs from the tree's start to the section end, ``path_length`` sums the
    section and everything below, ``max_path_extent`` is the longest way from the start to a
    leaf below.
    """
    keys = list(keys)
    folded = fold(
        section_table, keys, node="section_id", parent="parent_section_id",
        up={"path_distance": F.col("length")},
        below={"path_length": ("sum", F.col("length"))},
        reach={"_reach": "path_distance"},
    )
    start = section_table.filter(F.col("parent_section_id") == -1).groupBy(*keys).agg(
        F.min_by(F.struct(*geo.triple("", "_first")), "section_id").alias("_s")
    )
    radial = geo.distance(
        [F.col(f"_s.{a}_first") for a in geo.AXES], geo.triple("", "_last")
    )
    return (
        section_table.join(folded, [*keys, "section_id"])
        .join(start, keys)
        .withColumn("radial_distance", radial)
        .withColumn("max_path_extent", F.col("path_distance") + F.col("_reach"))
        .drop("_s", "_reach")
    )


