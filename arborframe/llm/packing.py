"""Best-fit packing with exact complements: documents as token pieces in sequences of fixed size.

Only the histogram of piece lengths reaches the driver: at most ``capacity`` numbers whatever the
corpus holds.  The plan made from it lists runs of equal sequences; every piece then finds its
place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborframe.llm.encoding import encoder
from arborframe.operators.core import accumulate, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def token_pieces(
    docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: the document's ids and ``end_id``, cut only where they exceed a sequence.

    NULL and empty texts give one piece with the end id alone.  A repeated row gives its pieces
    again, a NULL id stays NULL.  Other columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids = enc.ids(texts[i].as_py()) + end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc, k, at, len(part) // 4, zlib.crc32(part)))
            cols = zip(*rows) if rows else ([], [], [], [], [])
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(cols, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(cut, PIECES)


class Plan:
    """Runs of equal sequences: which ranks of which lengths go where.

    A run is a block of sequences with consecutive numbers; a segment says that the ranks from
    ``rank`` on of one length fill the block at one offset, one per sequence.
    """

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.left = counts.astype(np.int64).copy()
        self.left[0] = 0
        self.used = np.zeros_like(self.left)
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.exact = 0

    def _place(self, length: int, base: int, offset: int, n: int) -> None:
        self.segments.append((length, int(self.used[length]), n, base, offset))
        self.used[length] += n
        self.left[length] -= n

    def _fill(self, lengths: list[int], n: int) -> None:
        offset = 0
        for length in lengths:
            self._place(length, self.sequences, offset, n)
            offset += length
        self.sequences += n
        self.exact += n * (offset == self.capacity)

    def _times(self, lengths: list[int]) -> int:
        """How often a combination can be taken under the counts that are left."""
        return min(int(self.left[x]) // lengths.count(x) for x in set(lengths))

    def _pair(self, gap: int, below: int) -> list[int] | None:
        """Two lengths that sum to the gap, the longer one as long as possible."""
        first = np.arange(min(gap - 1, below), (gap + 1) // 2 - 1, -1)
        if not len(first):
            return None
        ok = (self.left[first] > 0) & (self.left[gap - first] > 0)
        ok &= (2 * first != gap) | (self.left[first] > 1)
        at = np.flatnonzero(ok)
        return [int(first[at[0]]), int(gap - first[at[0]])] if len(at) else None

    def _pair_sums(self) -> np.ndarray:
        """Index of all sums of two lengths that are still there."""
        there = (self.left > 0).astype(np.float64)
        size = 2 * len(there)
        return np.rint(np.fft.irfft(np.fft.rfft(there, size) ** 2, size))[: len(there)] > 0

    def _complement(self, gap: int) -> list[int] | None:
        """Up to three lengths that fill the gap exactly."""
        if gap == 0:
            return []
        if self.left[gap] > 0:
            return [gap]
        pair = self._pair(gap, gap)
        if pair:
            return pair
        sums = self._sums
        first = np.flatnonzero(self.left[1:gap] > 0) + 1
        for a in first[sums[gap - first]][::-1]:
            pair = self._pair(gap - int(a), int(a))
            if pair and self._times([int(a), *pair]) > 0:
                return [int(a), *pair]
        return None

    def make(self) -> Plan:
        """Exact combinations first, longest piece first; what is left goes where it fits best."""
        self._sums = self._pair_sums()
        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                self.left[length] -= 1  # the piece whose gap is to be filled
                rest = self._complement(self.capacity - length)
                self.left[length] += 1
                n = 0 if rest is None else self._times([length, *rest])
                if n == 0:
                    break
                gone = self.left > 0
                self._fill([length, *rest], n)
                if np.any(gone & (self.left == 0)):
                    self._stale = getattr(self, "_stale", 0) + 1
                    if self._stale % 64 == 0:
                        self._sums = self._pair_sums()
        self._best_fit()
        return self

    def _best_fit(self) -> None:
        """Best-fit decreasing over counts: blocks of equal gap are filled together."""
        open_blocks: dict[int, list[tuple[int, int]]] = {}
        gaps = np.zeros(self.capacity + 1, dtype=np.int64)
        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                fits = np.flatnonzero(gaps[length:] > 0)
                if not len(fits):
                    base, n = self.sequences, int(self.left[length])
                    per = max(1, self.capacity // length)
                    full, more = divmod(n, per)
                    for size, k in ((full, per), (1, more)):
                        if size and k:
                            base = self.sequences
                            self.sequences += size
                            for j in range(k):
                                self._place(length, base, j * length, size)
                            gap = self.capacity - k * length
                            open_blocks.setdefault(gap, []).append((base, size))
                            gaps[gap] += size
                    continue
                gap = length + int(fits[0])
                base, size = open_blocks[gap].pop()
                n = min(size, int(self.left[length]))
                gaps[gap] -= n
                if n < size:
                    open_blocks[gap].append((base + n, size - n))
                self._place(length, base, self.capacity - gap, n)
                open_blocks.setdefault(gap - length, []).append((base, n))
                gaps[gap - length] += n

    def arrays(self) -> np.ndarray:
        """Segments by length and first rank, as columns of one array."""
        out = np.array(self.segments, dtype=np.int64).reshape(-1, 5)
        return out[np.lexsort((out[:, 1], out[:, 0]))]


def packed(pieces: DataFrame, *, capacity: int = 4096, slice_rows: int = 200_000) -> DataFrame:
    """Every piece with its sequence and its offset there; sequences have no gaps.

    ``pieces`` has the columns of :func:`token_pieces`.  A job counts the lengths while the plan
    is built.  Pieces of one length, however many, are ranked in slices of about ``slice_rows``.
    Equal rows are interchangeable; an empty table gives an empty result.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row["length"]] = row["count"]
    plan = Plan(counts).make().arrays()
    slices = max(64, int(counts.sum() // slice_rows))
    spread = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices))
    ranked = accumulate(
        pieces.filter(F.col("length").between(1, capacity)), ["length"],
        ["doc_id", "piece", "ids_crc32"], slice_by=spread, number="rank",
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one sorted key for (length, rank); ranks stay far below 2^48
        keys = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False) - 1
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            found = plan[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:5],
                    pa.array(found[:, 3] + rank - found[:, 1], pa.int64()),
                    pa.array(found[:, 4], pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked.select(*cols).mapInArrow(place, PLACED)


def pack_documents(
    docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1,
) -> DataFrame:
    """Cut, tokenise and place all documents; the pieces' table is written once and read twice.

    NULLs, empty texts and repeated rows are those of :func:`token_pieces`; pieces of equal length
    take their places in any order.  An empty table gives an empty result.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id), "pieces")
    return packed(pieces, capacity=capacity)
