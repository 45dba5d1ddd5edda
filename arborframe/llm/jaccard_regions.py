"""Exact Jaccard join of documents: pivots of a metric space, triangle windows, pieces of regions.

Documents with equal shingle sets are one point.  1 - Jaccard is a metric, in which two unlike
texts are almost as far apart as can be: no window of two radii around a pivot leaves anything out
there.  Space is therefore cut first by rare shingles: linked points share one of the rarest
shingles of both, so the points that hold a rare shingle form a region and no link leaves it.  In
a region one pivot, the point that is most at home in regions, is compared with all others; what
lies within the radius is one component with it.  Where points of different components are left,
those outside the largest component are compared with the others, region by region in pieces of
bounded size.  A pair is left out by the triangle inequality over the pivot, by the shingles that
no other point of the crowded regions holds, or by counts of shingles in 128 classes, before it is
written; what is left is judged on full sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborframe.llm.shingles import in_short, shingle_set
from arborframe.operators.core import Scratch, written
from arborframe.operators.spatial import components

SKETCH_BITS, SKETCH_SLICES = 21, 64
PROFILE = 128
#: Regions of at most this many points do without counting shingles that one point alone holds
SMALL = 64
POINTS = "doc_id long, n_shingles long, point long, check long, slice int, counts binary"
BEFORE = 6


def set_names(shingles: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """A set's 128-bit digest as two signed numbers; the first one names its point."""
    raw = blake2b(shingles.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def points(docs: DataFrame, *, size: int = 5, salt: int = 0) -> DataFrame:
    """One row per document with its set's size and digest, and one sketch per partition.

    The sketch counts the documents' shingles in 2^21 slots, whatever the corpus holds.  It only
    orders shingles by how common they are; any order gives the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        waiting, n_waiting = [], 0
        for batch in in_short(batches):
            texts, rows = batch.column(1), []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                own = shingle_set(texts[i].as_py(), size)
                rows.append((doc, len(own), *set_names(own, salt)))
                waiting.append(own >> np.uint64(64 - SKETCH_BITS))
                n_waiting += len(own)
                if n_waiting > 1 << 20:
                    _count(counts, waiting)
                    waiting, n_waiting = [], 0
            yield _point_batch(rows, [])
        _count(counts, waiting)
        parts = np.split(counts, SKETCH_SLICES)
        yield _point_batch([], [(k, zlib.compress(c.tobytes(), 1)) for k, c in enumerate(parts) if c.any()])

    return docs.mapInArrow(run, POINTS)


def _count(counts: np.ndarray, waiting: list[np.ndarray]) -> None:
    """Adds the slots to a sketch, whose numbers stop at the largest that fits."""
    if waiting:
        more = np.bincount(np.concatenate(waiting).astype(np.int64), minlength=len(counts))
        counts[:] = np.minimum(counts + more, np.iinfo(np.uint32).max)


def _point_batch(rows: list[tuple], slices: list[tuple]) -> pa.RecordBatch:
    n, m = len(rows), len(slices)
    own = [list(c) for c in zip(*rows)] or [[], [], [], []]
    cut = [list(c) for c in zip(*slices)] or [[], []]
    return pa.RecordBatch.from_arrays(
        [
            *[pa.array(c + [None] * m, pa.int64()) for c in own],
            pa.array([None] * n + cut[0], pa.int32()), pa.array([None] * n + cut[1], pa.binary()),
        ],
        names=["doc_id", "n_shingles", "point", "check", "slice", "counts"],
    )


def sketch(made: DataFrame) -> np.ndarray:
    """The sum of all partitions' sketches, added up slice by slice: 2^21 numbers on a
    logarithmic scale, 4 MB, whatever the corpus holds."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.int64)
                total[k] = total[k] + own if k in total else own
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()),
             pa.array([zlib.compress(c.tobytes(), 1) for c in total.values()], pa.binary())],
            names=["slice", "counts"],
        )

    parts = made.filter(F.col("slice").isNotNull()).select("slice", "counts")
    kind = "slice int, counts binary"
    summed = parts.repartition(SKETCH_SLICES, "slice").mapInArrow(add, kind)
    out = np.zeros((SKETCH_SLICES, (1 << SKETCH_BITS) // SKETCH_SLICES), np.int64)
    for row in summed.collect():  # one row per slice
        out[row["slice"]] += np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return (np.log2(out.ravel() + 1.0) * 1000).astype(np.uint16)


def rare_shingles(
    docs: DataFrame, counts: np.ndarray, *, size: int = 5, percent: int = 80, salt: int = 0
) -> DataFrame:
    """Rows ``shingle, point``: the rarest shingles of each set, enough that two linked sets
    share one of them: all but ``ceil(percent / 100 * n) - 1``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # only saves work: a point may be sent twice
        for batch in in_short(batches):
            texts = batch.column(1)
            if len(seen) > 100_000:
                seen.clear()
            shingles, owners = [], []
            for i in range(batch.num_rows):
                own = shingle_set(texts[i].as_py(), size)
                point, n = set_names(own, salt)[0], len(own)
                if n == 0 or point in seen:
                    continue
                seen.add(point)
                slots = (own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                rank = np.argsort(counts[slots], kind="stable")  # ties in the order of the hash
                chosen = own[rank[: n - (percent * n + 99) // 100 + 1]]
                shingles.append(chosen.view(np.int64))
                owners.append(np.full(len(chosen), point, np.int64))
            if shingles:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (shingles, owners)], names=["shingle", "point"]
                )

    return docs.mapInArrow(run, "shingle long, point long")


def regions(rare: DataFrame) -> DataFrame:
    """Rows ``region, point`` of all shingles that two points or more hold as rare ones.

    A passage that the same points share is many shingles but one region: regions of up to
    ``SMALL`` points are listed whole and equal lists kept once.  Larger ones stream past.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = np.zeros((0, 2), np.int64), None
        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)])
            if not len(rows):
                continue
            fresh = np.append(True, (rows[1:] != rows[:-1]).any(1))
            rows = rows[fresh]
            starts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            ends = np.append(starts[1:], len(rows))
            lists: set[bytes] = set()
            large = []
            if rows[0, 0] == crowded:  # goes on from the batch before
                large.append(rows[: ends[0]])
                starts, ends = starts[1:], ends[1:]
            held = np.zeros((0, 2), np.int64)
            if len(starts):
                crowded = None
                if ends[-1] - starts[-1] <= SMALL:  # may go on in the next batch
                    held, starts, ends = rows[starts[-1] :], starts[:-1], ends[:-1]
                else:
                    crowded = rows[-1, 0]
            sizes = ends - starts
            for k in np.flatnonzero(sizes > 1).tolist():
                part = rows[starts[k] : ends[k]]
                if len(part) <= SMALL:
                    lists.add(part[:, 1].tobytes())
                else:
                    large.append(part)
            yield regions_of(lists, large)
        if len(held) > 1:
            yield regions_of({held[:, 1].tobytes()}, [])

    def regions_of(lists: set[bytes], large: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(large) if large else np.zeros((0, 2), np.int64)
        none = pa.nulls(len(lists), pa.int64())
        members = [np.frombuffer(m, np.int64) for m in lists]
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([none, pa.array(rows[:, 0])]), pa.concat_arrays([none, pa.array(rows[:, 1])]),
                pa.array([*members, *[None] * len(rows)], pa.list_(pa.int64())),
            ],
            names=["region", "point", "members"],
        )

    ordered = rare.repartition("shingle").sortWithinPartitions("shingle", "point")
    return ordered.mapInArrow(run, "region long, point long, members array<long>")


def members(listed: DataFrame) -> DataFrame:
    """Rows ``region, point`` from the written result of :func:`regions`."""
    small = listed.filter(F.col("members").isNotNull()).select("members").distinct()
    small = small.select(F.xxhash64("members").alias("region"), F.explode("members").alias("point"))
    return listed.filter(F.col("members").isNull()).select("region", "point").unionByName(small)


def small_side(table: DataFrame, *, most: int = 500_000) -> DataFrame:
    """A written table of numbers, marked for broadcast while it has at most ``most`` rows."""
    return F.broadcast(table) if table.count() <= most else table


def with_pivots(shared: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Regions with the point of each that is most at home in regions: ``region, point, n, pivot,
    n_pivot``.  Near the centre of a group a point has few shingles of its own, so most of its rare
    ones are regions.  ``sizes``: (point, n)."""
    homes = shared.groupBy("point").agg(F.count(F.lit(1)).alias("met"))
    homes = scratch.written(homes.join(sizes, "point"), "points-at-home")
    placed = shared.join(small_side(homes), "point")
    pivot = placed.groupBy("region").agg(F.max(F.struct("met", "point", "n")).alias("p")).select(
        "region", F.col("p.point").alias("pivot"), F.col("p.n").alias("n_pivot")
    )
    return placed.join(pivot, "region").select("region", "point", "n", "pivot", "n_pivot")


def profiles(docs: DataFrame, wanted: DataFrame, *, size: int = 5, salt: int = 0) -> DataFrame:
    """Rows ``point, n, profile`` for ``wanted`` (``doc_id, point``), read from the texts."""

    def one(own: np.ndarray) -> tuple:
        return set_names(own, salt)[0], len(own), _profile(own)

    return _from_texts(docs, wanted, one, {"point": "long", "n": "int", "profile": "binary"}, size)


def point_sets(docs: DataFrame, wanted: DataFrame, *, size: int = 5, salt: int = 0) -> DataFrame:
    """Rows ``point, shingles`` for ``wanted`` (``doc_id, point``), read from the texts."""

    def one(own: np.ndarray) -> tuple:
        return set_names(own, salt)[0], own.view(np.int64)

    return _from_texts(docs, wanted, one, {"point": "long", "shingles": "array<long>"}, size)


ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _from_texts(
    docs: DataFrame, wanted: DataFrame, one: Callable[[np.ndarray], tuple], kinds: dict[str, str], size: int
) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_short(batches):
            rows = [one(shingle_set(text.as_py(), size)) for text in batch.column(0)]
            cols = [list(c) for c in zip(*rows)] or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, ARROW[k]) for c, k in zip(cols, kinds.values())], names=list(kinds)
            )

    texts = among(docs, wanted.select("doc_id"), "doc_id").select("text")
    made = texts.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))
    # an id that is given to several texts brings sets of other points along
    return among(made, wanted.select("point"), "point")


class Sets:
    """Reads what is wanted of the points' sets from the texts, each point once."""

    def __init__(self, docs: DataFrame, places: DataFrame, scratch: Scratch, *, size: int, salt: int):
        self.docs, self.places, self.scratch = docs, places, scratch
        self.how = {"size": size, "salt": salt}

    def of(self, points: DataFrame, made=point_sets) -> DataFrame:
        """A written table for distinct points."""
        points = self.scratch.written(points, "wanted-points")
        wanted = self.scratch.written(among(self.places, points, "point"), "wanted")
        found = self.scratch.written(made(self.docs, wanted, **self.how), "sets")
        if found.count() > wanted.count():  # rows that were given more than once
            found = self.scratch.written(found.dropDuplicates(["point"]), "sets")
        return found


def _profile(own: np.ndarray) -> bytes:
    """How many shingles lie in each of 128 classes, in one byte each where that holds them."""
    counts = np.bincount((own % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def _profiles(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    rows = [r if len(r) > PROFILE else np.frombuffer(r, np.uint8).astype(np.uint32).tobytes() for r in raw]
    return np.frombuffer(b"".join(rows), np.uint32).reshape(-1, PROFILE)


def may_share(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray, percent: int):
    """Whether sets with these profiles can be linked: the smaller counts of the classes add up to
    at least the intersection."""
    most = np.minimum(one, two).sum(1).astype(np.int64)
    return 100 * most >= percent * (n_one + n_two - most)


def among(table: DataFrame, wanted: DataFrame, key: str, *, most: int = 500_000) -> DataFrame:
    """The rows of a table with a wanted key, a written table of numbers; those are broadcast while
    they are at most ``most``, and joined by a shuffle beyond."""
    return table.join(small_side(wanted, most=most), key, "left_semi")


def near_pairs(pairs: DataFrame, small: DataFrame, *, percent: int = 80) -> DataFrame:
    """The pairs ``a, b`` that may be linked, judged by their profiles before any set is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = _profiles(batch.column(4)), _profiles(batch.column(5))
            n_one, n_two = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            keep = pa.array(np.flatnonzero(may_share(one, two, n_one, n_two, percent)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"]
            )

    met = (
        small.toDF("b", "n_b", "profile_b").join(pairs, "b").join(small.toDF("a", "n_a", "profile_a"), "a")
        .select("a", "b", "n_a", "n_b", "profile_a", "profile_b")
    )
    return met.mapInArrow(run, "a long, b long")


def distances(pairs: DataFrame, sets: Sets, *, percent: int = 80) -> DataFrame:
    """Rows ``a, b, distance, linked`` of written pairs, judged by their whole sets, of which only
    those are read that a pair needs."""
    first, second = (sets.scratch.written(pairs.select(F.col(c).alias("point")).distinct(), "ends") for c in "ab")
    whole = sets.of(first.unionByName(second).distinct())
    met = (
        among(whole, second, "point").toDF("b", "set_b").join(small_side(pairs), "b")
        .join(among(whole, first, "point").toDF("a", "set_a"), "a")
    )
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return met.select("a", "b", common.alias("common"), union.alias("union")).select(
        "a", "b", (F.lit(1.0) - F.col("common") / F.col("union")).alias("distance"),
        (100 * F.col("common") >= percent * F.col("union")).alias("linked"),
    )


def lonely(crowd: DataFrame) -> DataFrame:
    """Rows ``point, alone`` of the points of which some shingles are in no other set of the crowd."""
    each = crowd.select("point", F.explode("shingles").alias("shingle"))
    return (
        each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"), F.min("point").alias("point"))
        .filter("held = 1").groupBy("point").agg(F.count(F.lit(1)).alias("alone"))
    )


ROW = "region, piece, part, role, point, component, open, n, alone, to_pivot, past, profile"


def left_pairs(rows: DataFrame, *, percent: int) -> DataFrame:
    """Rows ``a, b``: pairs of a region, of different components, that the bounds leave.

    In each (region, piece, part) a bounded number of askers (role 0) come first, against which the
    others stream past.  Of two open points the smaller one asks; a pair is met in the first of the
    regions that both name as earlier ones.
    """
    radius = (100 - percent) / 100

    def near(asking: _Rows, others: _Rows, block: int = 1 << 15) -> Iterator[tuple]:
        step = max(1, (1 << 19) // len(asking))
        for lo in range(0, len(others), step):
            b = others.part(slice(lo, lo + step))
            most = np.minimum((asking.n - asking.alone)[:, None], (b.n - b.alone)[None])
            may = 100 * most >= percent * (asking.n[:, None] + b.n[None] - most)
            may &= asking.component[:, None] != b.component[None]
            may &= ~b.open[None] | (asking.point[:, None] < b.point[None])
            # the triangle inequality over the pivot, where both distances are known
            may &= ~(np.abs(asking.to_pivot[:, None] - b.to_pivot[None]) > radius + 1e-9)
            i, j = np.nonzero(may)
            for k in range(0, len(i), block):
                p, q = i[k : k + block], j[k : k + block]
                good = may_share(asking.profile[p], b.profile[q], asking.n[p], b.n[q], percent)
                p, q = p[good], q[good]
                one, two = asking.past[p], b.past[q]
                met = ((one[:, :, None] == two[:, None, :]) & (asking.had[p][:, :, None] & b.had[q][:, None, :]))
                fresh = ~met.any((1, 2))
                yield asking.point[p[fresh]], b.point[q[fresh]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, asking = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            every = _Rows.of(batch)
            edges = (np.flatnonzero((every.place[1:] != every.place[:-1]).any(1)) + 1).tolist()
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                part = every.part(slice(lo, hi))
                *here, role = part.place[0].tolist()
                if here != place:
                    place, asking = here, None
                if role == 0:
                    asking = part if asking is None else asking.plus(part)
                elif asking is not None:
                    for a, b in near(asking, part):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    names = ROW.split(", ")
    ordered = rows.repartition(*names[:3]).sortWithinPartitions(*names[:4])
    return ordered.select(*names).mapInArrow(run, "a long, b long")


class _Rows:
    """Points of one region as columns."""

    FIELDS = ("place", "point", "component", "open", "n", "alone", "to_pivot", "past", "had", "profile")

    def __init__(self, **columns: np.ndarray):
        self.__dict__.update(columns)

    def __len__(self) -> int:
        return len(self.point)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        number = lambda k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)
        past = np.zeros((batch.num_rows, BEFORE), np.int64)
        had = np.zeros(past.shape, bool)
        for i, earlier in enumerate(batch.column(10).to_pylist()):
            past[i, : len(earlier)], had[i, : len(earlier)] = earlier, True
        return cls(
            place=np.stack([number(k) for k in range(4)], 1), point=number(4), component=number(5),
            open=number(6) == 1, n=number(7), alone=number(8), past=past, had=had,
            to_pivot=batch.column(9).to_numpy(zero_copy_only=False).astype(np.float64),
            profile=_profiles(batch.column(11)),
        )

    def part(self, where) -> _Rows:
        return _Rows(**{f: getattr(self, f)[where] for f in self.FIELDS})

    def plus(self, more: _Rows) -> _Rows:
        return _Rows(**{f: np.concatenate([getattr(self, f), getattr(more, f)]) for f in self.FIELDS})


def _components(links: DataFrame) -> DataFrame:
    return components(links, []).toDF("point", "component")


def _own() -> Column:
    return F.coalesce("component", "point").alias("component")


def open_regions(homes: DataFrame, component: DataFrame, known: DataFrame) -> DataFrame:
    """Points of the regions in which, beside the pivot, several components are left: ``region,
    point, n, to_pivot, component, open, size``.  Open points lie outside the largest component;
    of two points in different components one is open."""
    at = homes.filter("point <> pivot").join(small_side(component), "point", "left")
    at = at.select("region", "point", "n", "pivot", _own())
    held = at.groupBy("region", "component").agg(F.count(F.lit(1)).alias("held"))
    main = (
        held.groupBy("region").agg(
            F.max(F.struct("held", "component")).alias("m"), F.count(F.lit(1)).alias("parts"),
            F.sum("held").alias("size"),
        )
        .filter("parts > 1").select("region", F.col("m.component").alias("main"), "size")
    )
    to_pivot = known.select(F.col("a").alias("pivot"), F.col("b").alias("point"), F.col("distance").alias("to_pivot"))
    return (
        at.join(main, "region").join(small_side(to_pivot), ["pivot", "point"], "left")
        .select(
            "region", "point", "n", "to_pivot", "component",
            (F.col("component") != F.col("main")).alias("open"), "size",
        )
    )


def bounded(at: DataFrame, sets: Sets, *, percent: int) -> DataFrame:
    """Open regions with ``alone`` and ``past`` in the place of ``size``.

    In regions of more than ``SMALL`` points a point that holds too much of its own cannot be
    linked and goes.  ``past`` names up to six regions of the point before this one.
    """
    crowd = sets.of(at.filter(F.col("size") > SMALL).select("point").distinct())
    facts = sets.scratch.written(lonely(crowd), "lonely")
    at = at.join(facts, "point", "left").withColumn(
        "alone", F.when(F.col("size") > SMALL, F.coalesce("alone", F.lit(0))).otherwise(F.lit(0))
    )
    live = at.filter(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")).drop("size")
    along = Window.partitionBy("point").orderBy("region")
    earlier = [F.lag("region", k).over(along) for k in range(1, BEFORE + 1)]
    return live.withColumn("past", F.array_compact(F.array(*earlier)))


def in_pieces(at: DataFrame, small: DataFrame, *, asking: int, others: int) -> DataFrame:
    """Rows for :func:`left_pairs`: the open points of a region in pieces, repeated for every part
    of its points, and those for every piece."""
    dealt = at.groupBy("region").agg(
        F.ceil(F.sum(F.col("open").cast("int")) / F.lit(asking)).cast("int").alias("pieces"),
        F.ceil(F.count(F.lit(1)) / F.lit(others)).cast("int").alias("parts"),
    ).filter("pieces > 0")
    at = at.join(dealt, "region").join(small.select("point", "profile"), "point")
    at = at.withColumn("open", F.col("open").cast("int"))
    spot, names = F.xxhash64("point"), ROW.split(", ")
    askers = at.filter("open = 1").withColumns({
        "piece": F.pmod(spot, F.col("pieces")).cast("int"), "role": F.lit(0),
        "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)),
    })
    asked = at.withColumns({
        "part": F.pmod(spot, F.col("parts")).cast("int"), "role": F.lit(1),
        "piece": F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)),
    })
    return askers.select(*names).unionByName(asked.select(*names))


def linked_components(
    docs: DataFrame, *, size: int = 5, percent: int = 80, asking: int = 1024, others: int = 16_384
) -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``).

    Documents link when 100 * intersection >= percent * union of their shingle sets; the
    component is named by its smallest doc_id.  Texts without words, NULL ones among them, link
    with nothing and are their own component; so is a row with a NULL id, whose component is
    NULL.  Repeated rows are one point and come back as often as they were given.  A crowded
    region is compared in pieces of ``asking`` against ``others`` points.  Two sets never share a
    name: where two 64-bit names are equal and the other halves of the digests are not, all are
    named anew with another salt.  Jobs run while the plan is built; an empty table gives an empty
    result.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    salt = -1
    while True:
        salt += 1
        made = written(points(own, size=size, salt=salt), "points")
        named = made.filter(F.col("slice").isNull()).select("doc_id", "n_shingles", "point", "check")
        reps = scratch.written(
            named.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("point").agg(
                F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"),
                (F.min("check") != F.max("check")).alias("clash"),
            ),
            "points-first",
        )
        if reps.filter("clash").isEmpty():
            break
    usable = own.filter(F.col("doc_id").isNotNull())
    rare = rare_shingles(usable, sketch(made), size=size, percent=percent, salt=salt)
    shared = scratch.written(members(scratch.written(regions(rare), "region-lists")), "regions")
    sizes = reps.select("point", "n")
    homes = scratch.written(with_pivots(shared, sizes, scratch), "homes")
    stars = scratch.written(
        homes.filter("point <> pivot")
        .filter(100 * F.least("n", "n_pivot") >= percent * F.greatest("n", "n_pivot"))
        .groupBy(F.col("pivot").alias("a"), F.col("point").alias("b")).agg(F.count(F.lit(1)).alias("together")),
        "stars",
    )
    sets = Sets(usable, reps.select("doc_id", "point"), scratch, size=size, salt=salt)
    small = sets.of(shared.select("point").distinct(), profiles)
    # the pivot nearest to home first, then those pivots that may still join components
    best = stars.groupBy("b").agg(F.max(F.struct("together", "a")).alias("s")).select(F.col("s.a").alias("a"), "b")
    best = scratch.written(near_pairs(best, small, percent=percent), "near")
    known = scratch.written(distances(best, sets, percent=percent), "distances")
    component = scratch.written(_components(known.filter("linked")), "component")
    rest = (
        stars.join(best, ["a", "b"], "left_anti")
        .join(component.toDF("a", "in_a"), "a", "left").join(component.toDF("b", "in_b"), "b", "left")
        .filter(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).select("a", "b")
    )
    rest = scratch.written(near_pairs(rest, small, percent=percent), "near")
    if not rest.isEmpty():
        known = known.unionByName(scratch.written(distances(rest, sets, percent=percent), "distances"))
        component = scratch.written(_components(known.filter("linked")), "component")
    at = scratch.written(open_regions(homes, component, known), "open-regions")
    if not at.isEmpty():
        at = scratch.written(bounded(at, sets, percent=percent), "bounded")
        rows = in_pieces(at, small, asking=asking, others=others)
        left = scratch.written(left_pairs(rows, percent=percent).distinct(), "left-pairs")
        if not left.isEmpty():
            more = scratch.written(distances(left, sets, percent=percent), "distances")
            links = known.unionByName(more).filter("linked")
            component = scratch.written(_components(links), "component")
    # the smallest document of every component, and of every point beside them
    smallest = reps.join(component, "point", "left").select("point", "doc_id", _own())
    lowest = smallest.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    label = written(smallest.join(lowest, "component").select("point", "component_id"), "labels")
    scratch.clear()
    return named.join(label, "point", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id"))
        .when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select doc_id, list_sort(case when len(w) = 0 then [] else list_distinct(list_transform(
    range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) end) as g
  from w),
one as (
  select row_number() over () as p, min(doc_id) as first, len(g) as n, g
  from s where len(g) > 0 and doc_id is not null group by g),
x as (select p, n, unnest(g) as k from one),
pairs as (
  select a.p as a, b.p as b
  from x a join x b on a.k = b.k and a.p < b.p
    and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.p, b.p, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges as (select a, b from pairs union all select b, a from pairs),
reach as (
  select p, p as q from one
  union
  select reach.p, edges.b from reach join edges on reach.q = edges.a),
label as (
  select reach.p, min(one.first) as component_id
  from reach join one on one.p = reach.q group by reach.p)
select s.doc_id, len(s.g)::bigint as n_shingles,
  case when len(s.g) = 0 then s.doc_id when s.doc_id is not null then label.component_id
  end as component_id
from s left join one on one.g = s.g left join label on label.p = one.p
"""
