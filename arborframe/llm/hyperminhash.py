"""Near duplicates by HyperMinHash registers, banded, estimated and then confirmed on full sets.

A register keeps of the smallest hash in its bucket the number of leading zeros and a few bits
behind them (the mantissa), 16 bits in all.  A bucket without a shingle takes the register of
another one, chosen in an order of its own, so that short texts have all registers too.  Texts
that agree in all registers of a band meet.  In a band's bucket every text is compared with one
that stands for it; where texts of different components are left, those outside the largest
component are compared with the others, after two bounds: the shingles that no other text there
holds, and the estimate of the Jaccard index, corrected for registers that agree by accident.

What can be lost: with 256 registers in bands of 6, two sets of Jaccard 0.8 share no band with
odds of 3 in a million, and are estimated below the cut of 0.68 with odds of 1 in a million.  All
else is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborframe.llm.shingles import STEP, mixed, shingle_set
from arborframe.operators.core import Scratch, written
from arborframe.operators.spatial import components

BUCKET_BITS, MANTISSA_BITS = 8, 10
REGISTERS = 1 << BUCKET_BITS
BAND_ROWS = 6
BANDS = REGISTERS // BAND_ROWS
SIGNED = "doc_id long, n_shingles long, point binary, registers binary"


@lru_cache(maxsize=1)
def stand_in_ranks() -> np.ndarray:
    """For every bucket (row) the order in which it asks the other buckets."""
    every = np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(1)
    return mixed(mixed(every * STEP)).reshape(REGISTERS, REGISTERS)


def registers_of(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes, which come in ascending order."""
    bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    held, rest = bucket[first], shingles[first] << np.uint64(BUCKET_BITS)
    zeros = np.clip(64 - np.frexp(rest.astype(np.float64))[1], 0, 63 - BUCKET_BITS).astype(np.uint64)
    tail = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    out = np.zeros(REGISTERS, np.uint16)
    out[held] = (zeros << np.uint64(MANTISSA_BITS)) | tail
    if len(held) < REGISTERS:
        empty = np.ones(REGISTERS, bool)
        empty[held] = False
        empty = np.flatnonzero(empty)
        out[empty] = out[held[stand_in_ranks()[np.ix_(empty, held)].argmin(1)]]
    return out


def accidents(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The odds that the registers of two unlike sets of these sizes agree by accident."""
    level = np.arange(64 - BUCKET_BITS, dtype=np.float64)
    odds = []
    for n in (n_a, n_b):
        each = np.maximum(np.asarray(n, np.float64) / REGISTERS, 1.0)[:, None]
        below, above = (1 - 0.5 ** (level + 1)) ** each, (1 - 0.5**level) ** each
        odds.append(below - above)
    return (odds[0] * odds[1]).sum(1) / (1 << MANTISSA_BITS)


def estimated(agreeing: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard index by the share of agreeing registers, less what agrees by accident."""
    chance = accidents(n_a, n_b)
    return (agreeing / REGISTERS - chance) / (1 - chance)


def signed(docs: DataFrame, *, size: int = 4) -> DataFrame:
    """Rows ``doc_id, n_shingles, point, registers``: a set's 128-bit digest names its point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(1), []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                own = shingle_set(texts[i].as_py(), size)
                name = blake2b(own.tobytes(), digest_size=16).digest()
                rows.append((doc, len(own), name, registers_of(own).tobytes() if len(own) else None))
            cols = [list(c) for c in zip(*rows)] or [[] for _ in range(4)]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)],
                names=["doc_id", "n_shingles", "point", "registers"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def register_rows(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint16).reshape(-1, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band of registers."""
    parts = registers[:, : BANDS * BAND_ROWS].reshape(len(registers), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(BAND_ROWS):
        key = mixed(key * STEP + parts[:, :, k] + np.uint64(1))
    return key


def banded(points: DataFrame) -> DataFrame:
    """Rows ``key, point``, one for each band of every point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(register_rows(batch.column(1)))
            owner = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), batch.column(0).take(owner)],
                names=["key", "point"],
            )

    return points.select("point", "registers").mapInArrow(run, "key long, point binary")


def listed(table: DataFrame, wanted: DataFrame, key: str, *, most: int = 500_000) -> DataFrame:
    """Rows of a table whose key is among the wanted ones (a written table of a key column),
    which are broadcast up to ``most`` rows and shuffled beyond."""
    few = F.broadcast(wanted) if wanted.count() <= most else wanted
    return table.join(few, key, "left_semi")


def full_sets(docs: DataFrame, points: DataFrame, *, size: int = 4) -> DataFrame:
    """Rows ``point, shingles`` of the points ``doc_id, point``, read from the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0):
                own = shingle_set(text.as_py(), size)
                rows.append((blake2b(own.tobytes(), digest_size=16).digest(), own.view(np.int64)))
            cols = [list(c) for c in zip(*rows)] or [[], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.list_(pa.int64()))],
                names=["point", "shingles"],
            )

    texts = listed(docs, points.select("doc_id"), "doc_id").select("text")
    made = texts.mapInArrow(run, "point binary, shingles array<long>")
    # an id that is given to several texts brings texts of other points along
    return listed(made, points.select("point"), "point").groupBy("point").agg(
        F.first("shingles").alias("shingles")
    )


def confirmed(pairs: DataFrame, sets: DataFrame, *, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are linked, judged by their full sets."""
    met = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return met.filter(100 * common >= percent * union).select("a", "b")


def unshared(sets: DataFrame) -> DataFrame:
    """Rows ``point, n, alone``: a set's size, and how many of its shingles no other set holds."""
    each = sets.select("point", F.explode("shingles").alias("shingle"))
    single = (
        each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"), F.min("point").alias("point"))
        .filter("held = 1").groupBy("point").agg(F.count(F.lit(1)).alias("alone"))
    )
    return sets.select("point", F.size("shingles").cast("long").alias("n")).join(
        single, "point", "left"
    ).select("point", "n", F.coalesce("alone", F.lit(0)).alias("alone"))


def left_pairs(rows: DataFrame, *, percent: int, cut: float) -> DataFrame:
    """Rows ``a, b``: pairs of different components that meet in a bucket and may be linked.

    ``rows`` hold ``key, piece, part, role, point, component, open, n, alone, registers``; in each
    (key, piece, part) a bounded number of rows of role 0 come first, against which the others
    stream past.  A pair is met in the first band that it shares, and of two open points the
    smaller one asks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, asking, made = None, _Rows(), None
        for batch in batches:
            every = _Rows.of(batch)
            edges = np.flatnonzero((every.place[1:] != every.place[:-1]).any(1)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                part = every.part(slice(lo, hi))
                here = tuple(part.place[0].tolist()) if hi > lo else place
                if here[:3] != (place[:3] if place else None):
                    asking = _Rows()
                place = here
                if here[3] == 0:
                    asking = asking.plus(part)
                elif len(asking):
                    made = asking.near(part, percent, cut)
                    if len(made[0]):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(made[0], pa.binary()), pa.array(made[1], pa.binary())],
                            names=["a", "b"],
                        )

    where = ["key", "piece", "part", "role"]
    ordered = rows.repartition("key", "piece", "part").sortWithinPartitions(*where)
    return ordered.select(
        *where, "point", "component", F.col("open").cast("int").alias("open"), "n", "alone", "registers"
    ).mapInArrow(run, "a binary, b binary")


class _Rows:
    """Points of one bucket as columns."""

    FIELDS = ("place", "point", "component", "open", "n", "alone", "registers", "keys")

    def __init__(self, **columns):
        for name in self.FIELDS:
            setattr(self, name, columns.get(name))

    def __len__(self) -> int:
        return 0 if self.point is None else len(self.point)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        number = lambda k: batch.column(k).to_numpy().astype(np.int64)
        name = lambda k: np.array(batch.column(k).to_pylist() or [b""], "V16")[: batch.num_rows]
        registers = register_rows(batch.column(9))
        return cls(
            place=np.stack([number(k) for k in range(4)], 1), point=name(4), component=name(5),
            open=number(6) == 1, n=number(7), alone=number(8), registers=registers,
            keys=band_keys(registers).view(np.int64),
        )

    def part(self, where) -> _Rows:
        return _Rows(**{f: getattr(self, f)[where] for f in self.FIELDS})

    def plus(self, more: _Rows) -> _Rows:
        if not len(self):
            return more
        return _Rows(**{f: np.concatenate([getattr(self, f), getattr(more, f)]) for f in self.FIELDS})

    def near(self, others: _Rows, percent: int, cut: float, block: int = 1 << 15):
        """Pairs of an asking point and another one that the bounds leave."""
        key = others.place[0][0]
        found_a, found_b = [], []
        step = max(1, (1 << 22) // len(self))
        for lo in range(0, len(others), step):
            b = others.part(slice(lo, lo + step))
            most = np.minimum((self.n - self.alone)[:, None], (b.n - b.alone)[None])
            may = 100 * most >= percent * (self.n[:, None] + b.n[None] - most)
            may &= self.component[:, None] != b.component[None]
            may &= ~b.open[None] | _less(self.point, b.point)
            i, j = np.nonzero(may)
            for k in range(0, len(i), block):
                p, q = i[k : k + block], j[k : k + block]
                same = (self.registers[p] == b.registers[q]).sum(1)
                first = (self.keys[p] == b.keys[q]).argmax(1)
                good = estimated(same, self.n[p], b.n[q]) >= cut
                good &= self.keys[p, first] == key
                found_a += self.point[p[good]].tolist()
                found_b += b.point[q[good]].tolist()
        return found_a, found_b


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each name of ``a`` comes before each name of ``b``, byte by byte."""
    whole = [np.ascontiguousarray(x).view(">u8").reshape(-1, 2).astype(np.uint64) for x in (a, b)]
    (a1, a2), (b1, b2) = whole[0].T, whole[1].T
    return (a1[:, None] < b1[None]) | ((a1[:, None] == b1[None]) & (a2[:, None] < b2[None]))


def _components(links: DataFrame) -> DataFrame:
    return components(links, []).toDF("point", "component")


def _own(component: str = "component") -> Column:
    return F.coalesce(component, "point").alias("component")


def near_duplicates(
    docs: DataFrame, *, size: int = 4, percent: int = 80, cut: float = 0.68, asking: int = 1024,
    others: int = 16_384,
) -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id, text``).

    Documents link when 100 * intersection >= percent * union of their sets of ``size``-word
    shingles; the component is named by its smallest doc_id, which alone is kept.  Texts without
    words, NULL ones among them, link with nothing and are their own component; a row with a NULL
    id has a NULL component and is kept.  Repeated rows come back as often as they were given.
    Other columns are not read; an empty table gives an empty result.  A large bucket is compared
    in pieces of ``asking`` against ``others`` points.  Jobs run while the plan is built.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = scratch.written(signed(own, size=size), "registers")
    named = written(made.select("doc_id", "n_shingles", "point"), "signed")
    usable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    points = scratch.written(
        made.filter(usable).groupBy("point").agg(
            F.min("doc_id").alias("doc_id"), F.first("registers").alias("registers")
        ),
        "points",
    )
    bands = banded(points)
    crowded = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = scratch.written(bands.join(crowded, "key"), "buckets")
    # the point that is most often among many stands for a bucket
    known = buckets.groupBy("point").agg(F.sum("size").alias("met"))
    stand = (
        buckets.join(known, "point").groupBy("key")
        .agg(F.max(F.struct("met", "point")).alias("s")).select("key", F.col("s.point").alias("stand"))
    )
    buckets = scratch.written(buckets.join(stand, "key").select("key", "point", "stand"), "stars")
    stars = scratch.written(
        buckets.filter("point <> stand").groupBy(F.col("point").alias("b"), F.col("stand").alias("a"))
        .agg(F.count(F.lit(1)).alias("shared")),
        "star-pairs",
    )
    needed = scratch.written(
        points.select("doc_id", "point").join(buckets.select("point").distinct(), "point", "left_semi"),
        "needed",
    )
    sets = scratch.written(full_sets(own.filter(F.col("doc_id").isNotNull()), needed, size=size), "sets")
    # first the pair of every point that shares most bands, then those that still join components
    best = stars.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("s")).select("b", F.col("s.a").alias("a"))
    links = scratch.written(confirmed(best, sets, percent=percent), "links")
    component = scratch.written(_components(links), "component")
    of_b, of_a = component.toDF("b", "in_b"), component.toDF("a", "in_a")
    rest = scratch.written(
        stars.join(best.withColumn("done", F.lit(True)), ["a", "b"], "left").filter("done is null")
        .join(of_a, "a", "left").join(of_b, "b", "left")
        .filter(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).select("a", "b"),
        "more-pairs",
    )
    if not rest.isEmpty():
        links = scratch.written(links.unionByName(confirmed(rest, sets, percent=percent)), "links")
        component = scratch.written(_components(links), "component")
    # buckets where points beside the one that stands for them lie in different components
    at = buckets.filter("point <> stand").join(component, "point", "left").select("key", "point", _own())
    held = scratch.written(at.groupBy("key", "component").agg(F.count(F.lit(1)).alias("held")), "held")
    main = (
        held.groupBy("key")
        .agg(F.max(F.struct("held", "component")).alias("m"), F.count(F.lit(1)).alias("n_components"))
        .filter("n_components > 1").select("key", F.col("m.component").alias("main"))
    )
    at = scratch.written(
        at.join(main, "key").withColumn("open", F.col("component") != F.col("main")).drop("main"), "open-buckets"
    )
    if not at.isEmpty():
        crowd = scratch.written(at.select("point").distinct(), "crowd")
        facts = scratch.written(unshared(listed(sets, crowd, "point")), "unshared")
        live = facts.filter(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n"))
        at = scratch.written(at.join(live, "point"), "live-buckets")
        dealt = at.groupBy("key").agg(
            F.ceil(F.sum(F.col("open").cast("int")) / F.lit(asking)).cast("int").alias("pieces"),
            F.ceil(F.count(F.lit(1)) / F.lit(others)).cast("int").alias("parts"),
        ).filter("pieces > 0")
        at = at.join(dealt, "key").join(points.select("point", "registers"), "point")
        spot = F.xxhash64("point")
        wanted = ["key", "piece", "part", "role", "point", "component", "open", "n", "alone", "registers"]
        askers = at.filter("open").withColumns({
            "piece": F.pmod(spot, F.col("pieces")).cast("int"), "role": F.lit(0),
            "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)),
        })
        asked = at.withColumns({
            "part": F.pmod(spot, F.col("parts")).cast("int"), "role": F.lit(1),
            "piece": F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)),
        })
        left = scratch.written(
            left_pairs(askers.select(*wanted).unionByName(asked.select(*wanted)), percent=percent, cut=cut),
            "left-pairs",
        )
        if not left.isEmpty():
            links = links.unionByName(confirmed(left, sets, percent=percent))
            component = scratch.written(_components(scratch.written(links, "links")), "component")
    smallest = points.select("point", "doc_id").join(component, "point", "left").select("point", "doc_id", _own())
    lowest = smallest.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    label = written(smallest.join(lowest, "component").select("point", "component_id"), "classes")
    scratch.clear()
    found = named.join(label, "point", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id"))
        .when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select doc_id, list_sort(case when len(w) = 0 then [] else list_distinct(list_transform(
    range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) end) as g
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
  from reach join one on one.p = reach.q group by reach.p),
found as (
  select s.doc_id, len(s.g)::bigint as n_shingles,
    case when len(s.g) = 0 then s.doc_id when s.doc_id is not null then label.component_id
    end as component_id
  from s left join one on one.g = s.g left join label on label.p = one.p)
select *, coalesce(doc_id = component_id, true) as kept from found
"""
