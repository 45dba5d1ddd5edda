"""Stupid-backoff scores of documents from n-gram count tables partitioned by hash.

Documents are dealt to blocks.  A block sends each distinct n-gram once, with its count, to the
n-gram's hash range; there the blocks' counts are added up and every block gets the totals of the
n-grams that it asked for, in the order in which it asked.  The block joins them to the exploded
n-grams of its documents.  A document's own n-grams are taken out of the counts, so that it is
scored by the rest of the corpus and the backing off takes place.

Words and pairs go in one exchange, each longer order in one of its own: an n-gram that another
document holds begins and ends with shorter ones that another document holds, so a block sends only
those.  No n-gram that counts for any document is left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborframe.llm.shingles import mixed, word_hashes

BACKOFF = 0.4
#: Stands for the number of all words in the tables of counts.
TOTAL = np.uint64(0)
#: Orders up to this one go in the first exchange.
FIRST = 2
ASKED = "range int, block int, hashes binary, counts binary"
TOLD = "block int, level int, range int, counts binary"
SCORES = (
    "doc_id long, n_words long, n_backed_off long, n_unseen long, log_score double, score double"
)
STEP = np.uint64(0x9E3779B97F4A7C15)


def packed(ascending: np.ndarray) -> bytes:
    """Ascending 64-bit numbers: the first one, then differences of as few bytes as they need.

    The highest of these bytes is mostly small and goes ahead of the others, compressed.
    """
    if not len(ascending):
        return b""
    gaps = np.diff(ascending)
    width = max(1, -(-int(gaps.max(initial=0)).bit_length() // 8))
    low = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    first = ascending[:1].astype("<u8").tobytes()
    return bytes([width]) + first + zlib.compress(low[:, -1].tobytes(), 1) + low[:, :-1].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    width, top = raw[0], zlib.decompressobj()
    high = np.frombuffer(top.decompress(raw[9:]), np.uint8)
    gaps = np.zeros((len(high) + 1, 8), np.uint8)
    gaps[0] = np.frombuffer(raw, np.uint8, 8, 1)
    gaps[1:, width - 1] = high
    gaps[1:, : width - 1] = np.frombuffer(top.unused_data, np.uint8).reshape(len(high), width - 1)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts from 0 on as compressed bytes; those from 255 on follow in full."""
    low = np.minimum(counts, 255).astype(np.uint8)
    return zlib.compress(low.tobytes(), 1) + counts[low == 255].astype("<i8").tobytes()


def unpacked_counts(raw: bytes) -> np.ndarray:
    low = zlib.decompressobj()
    counts = np.frombuffer(low.decompress(raw), np.uint8).astype("<i8")
    counts[counts == 255] = np.frombuffer(low.unused_data, "<i8")
    return counts


class Grams:
    """The n-grams of a block of documents, level by level, as places in ascending tables."""

    def __init__(self, texts: list[str | None], order: int):
        words = [word_hashes(t) for t in texts]
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(words)), self.sizes)
        start = np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.before = np.arange(len(self.flat)) - start  # words before this one in its document
        self.levels = levels(order)
        self.words = 0  # of all documents, once told
        self.others: list[np.ndarray] = []  # by order: how often other documents hold the n-gram

    def hashes(self, n: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the n-grams that end at the given words."""
        run = self.flat[at]
        for j in range(1, n):  # longer by one word in front
            run = run + mixed(self.flat[at - j] * STEP + np.uint64(j))
        return np.maximum(mixed(run + np.uint64(n)), np.uint64(1))

    def ends(self, n: int) -> np.ndarray:
        """The words at which an n-gram ends whose count is needed.

        One that would begin before the document does not exist, and above the first level both
        parts of n - 1 words have to be in other documents.
        """
        there = self.before >= n - 1
        if n > FIRST:
            held = self.others[n - 2] > 0
            there &= held
            there[1:] &= held[:-1]
        return np.flatnonzero(there)

    def level(self, k: int) -> None:
        """Makes ``table``, ``counts`` and, by order, the words and their places in the table."""
        self.at = [self.ends(n) for n in self.levels[k]]
        every = np.concatenate([self.hashes(n, at) for n, at in zip(self.levels[k], self.at)])
        self.table, place, self.counts = np.unique(every, return_inverse=True, return_counts=True)
        self.places = np.split(place, np.cumsum([len(at) for at in self.at])[:-1])

    def learn(self, totals: np.ndarray) -> None:
        """Takes the totals of the table that ``level`` made."""
        for at, place in zip(self.at, self.places):
            others = np.zeros(len(self.flat), dtype=np.int64)
            others[at] = totals[place] - self.own(at, place)
            self.others.append(others)

    def own(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often the n-gram at each word occurs in that word's own document."""
        out = np.ones(len(at), dtype=np.int64)
        more = np.flatnonzero(self.counts[place] > 1)
        key = self.doc[at[more]] * max(len(self.table), 1) + place[more]
        kinds, back, counts = np.unique(key, return_inverse=True, return_counts=True)
        out[more] = counts[back]
        return out

    def told(self, answers: pa.Table, upto: int) -> None:
        """Goes through the levels before ``upto`` with the answers that the block has got."""
        names = ("level", "range", "counts")
        rows = sorted(zip(*[answers.column(c).to_pylist() for c in names]), key=lambda r: r[:2])
        for k in range(upto):
            own = [np.zeros(0, np.int64), *[unpacked_counts(c) for at, _, c in rows if at == k]]
            totals = np.concatenate(own)
            if k == 0:
                self.words, totals = int(totals[0]), totals[1:]
            self.level(k)
            self.learn(totals)


def levels(order: int) -> list[range]:
    """The orders of each exchange."""
    first = range(1, min(order, FIRST) + 1)
    return [first, *[range(n, n + 1) for n in range(FIRST + 1, order + 1)]]


def _asked(docs: pa.Table, told: pa.Table | None, level: int, order: int, ranges: int) -> pa.Table:
    rows = []
    if docs.num_rows:
        block = docs.column("block")[0].as_py()
        grams = Grams(docs.column("text").to_pylist(), order)
        if told is not None:
            grams.told(told, level)
        grams.level(level)
        hashes, counts = grams.table, grams.counts
        if level == 0:
            hashes = np.concatenate([[TOTAL], hashes]).astype(np.uint64)
            counts = np.concatenate([[len(grams.doc)], counts])
        shift = np.uint64(64 - (ranges.bit_length() - 1))
        of = (hashes >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(of, np.arange(ranges + 1))
        rows = [
            (r, block, packed(hashes[a:b]), packed_counts(counts[a:b]))
            for r, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a
        ]
    cols = [list(c) for c in zip(*rows)] or [[]] * 4
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table(
        [pa.array(c, t) for c, t in zip(cols, kinds)], names=["range", "block", "hashes", "counts"]
    )


def _told(table: pa.Table, level: int) -> pa.Table:
    """Adds up one hash range over all blocks, and answers each block in its own order."""
    blocks = table.column("block").to_pylist()
    asked = [unpacked(h) for h in table.column("hashes").to_pylist()]
    counts = [unpacked_counts(c) for c in table.column("counts").to_pylist()]
    kinds, back = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate(counts), minlength=len(kinds)).astype("<i8")
    answers, at = [], 0
    for own in asked:
        answers.append(packed_counts(total[back[at : at + len(own)]]))
        at += len(own)
    which = table.column("range").to_pylist()
    return pa.table(
        [pa.array(blocks, pa.int32()), pa.array([level] * len(blocks), pa.int32()),
         pa.array(which, pa.int32()), pa.array(answers, pa.binary())],
        names=["block", "level", "range", "counts"],
    )


def _scores(docs: pa.Table, told: pa.Table, order: int) -> pa.Table:
    grams = Grams(docs.column("text").to_pylist(), order)
    grams.told(told, len(grams.levels))
    n, n_docs, others = len(grams.doc), len(grams.sizes), grams.others
    rest = (grams.words - grams.sizes)[grams.doc].astype(np.float64)  # words of the other documents
    log, open_, backed = np.zeros(n), np.ones(n, bool), np.zeros(n, np.int64)
    for k in range(order, 1, -1):
        context = np.zeros(n, dtype=np.int64)
        context[1:] = others[k - 2][:-1]
        whole = grams.before >= k - 1
        hit = open_ & whole & (others[k - 1] > 0)
        log[hit] += np.log(others[k - 1][hit] / context[hit])
        open_ &= ~hit
        missed = open_ & whole
        log[missed] += np.log(BACKOFF)
        backed += missed
    unseen = open_ & (others[0] <= 0)
    log[open_] += np.log(np.maximum(others[0][open_], 0.5) / (rest[open_] + 1))
    total = np.bincount(grams.doc, weights=log, minlength=n_docs).astype(np.float64)
    sums = [np.bincount(grams.doc, weights=x, minlength=n_docs).astype(np.int64) for x in (backed > 0, unseen)]
    mean = total / np.maximum(grams.sizes, 1)
    return pa.table(
        [docs.column("doc_id").cast(pa.int64()).combine_chunks(), pa.array(grams.sizes),
         *[pa.array(s) for s in sums], pa.array(total), pa.array(mean)],
        names=[c.split()[0] for c in SCORES.split(", ")],
    )


def scored(
    docs: DataFrame, *, order: int = 2, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """Rows ``doc_id, n_words, n_backed_off, n_unseen, log_score, score`` for every document.

    ``log_score`` is the sum over the words of log S(w | words before it): the relative count
    after the longest context that the other documents hold, times 0.4 per shortening; a word
    that no other document holds counts half an occurrence.  ``score`` is the mean per word.
    Texts without words, NULL ones among them, score 0.  NULL ids and repeated rows stay; a
    repeated row counts as another document of the corpus.  An empty table gives an empty
    result.  A small job measures the input while the plan is built; blocks hold about
    ``block_bytes`` of text, and hash ranges about as many n-grams.
    """
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(8, -(-size // block_bytes))
    ranges = 1 << max(3, int(blocks - 1).bit_length())
    dealt = own.withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    )
    def exchange(told: DataFrame | None, level: int) -> DataFrame:
        by_block = dealt.groupBy("block")
        if told is None:
            asked = by_block.applyInArrow(lambda d: _asked(d, None, level, order, ranges), ASKED)
        else:
            asked = by_block.cogroup(told.groupBy("block")).applyInArrow(
                lambda d, t: _asked(d, t, level, order, ranges), ASKED
            )
        return asked.groupBy("range").applyInArrow(lambda t: _told(t, level), TOLD)

    told = exchange(None, 0)
    for level in range(1, len(levels(order))):
        told = told.unionByName(exchange(told, level))
    return (
        dealt.groupBy("block").cogroup(told.groupBy("block"))
        .applyInArrow(lambda d, t: _scores(d, t, order), SCORES)
    )
