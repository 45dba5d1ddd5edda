"""Groups of spelling variants: words one inserted, deleted or replaced character apart.

A word is written as the counts of its letters in a few groups, one after the other; words in that
order are a trie.  One edit adds at most one to a count and takes at most one from another, so a
depth-first search with a budget of one surplus and one deficit reaches all words that may be near,
and the words at its leaves are verified.  To meet every pair once, the deficit is spent only
after the surplus: a longer word is found from the shorter one, and of two words of one length one
finds the other.

The upper levels of the trie are dealt out: a branch is named by its first counts, every word goes
to its own branch to be found and to the few branches that its budget reaches to ask.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborframe.operators.core import Scratch, written

#: Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8
RUN = rb"(?:[A-Za-z]|\xc3[\x80-\xbf])"
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Longer words are compared one by one instead of as rows of a matrix
WIDE = 64
NEAR = "word string, n_near long, best_n long, best string"


def word_counts(
    docs: DataFrame, *, least_chars: int = 7, noise: int = 31, most: int = 200_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Rows ``word, n`` of all texts, counted in each task before the counts are added up.

    Words are maximal runs of Latin letters, A to Z lower-cased.  Where ``noise`` divides
    h = crc32("doc_id:run"), the run loses its code point h % length.  Words of fewer than
    ``least_chars`` code points are left out.  NULL texts have no words; a NULL id is hashed as
    an empty one.  A task holds at most ``most`` counts besides those of one text and sends them
    on when there are more.
    """
    runs = re.compile(RUN + b"{%d,}" % least_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i, doc in enumerate(batch.column(0).to_pylist()):
                raw = texts[i].as_py()
                if not raw:
                    continue
                start = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for word, n in Counter(runs.findall(raw.lower())).items():
                    h = zlib.crc32(word, start)
                    if h % noise == 0:
                        points = word.decode()
                        k = h % len(points)
                        if len(points) <= least_chars:
                            continue
                        word = (points[:k] + points[k + 1 :]).encode()
                    total[word] += n
                if len(total) > most:
                    yield counts_of(total)
                    total = Counter()
        yield counts_of(total)

    def counts_of(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())],
            names=["word", "n"],
        )

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = wanted.mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def letter_groups(words: DataFrame, groups: int = 12) -> list[list[str]]:
    """The letters of the words in groups that are used about equally often, the largest letters
    first.  One row for each letter of the alphabet reaches the driver."""
    used = (
        words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter")
        .agg(F.count(F.lit(1)).alias("n")).filter("letter <> ''").collect()
    )
    out: list[list[str]] = [[] for _ in range(groups)]
    load = [0] * groups
    for row in sorted(used, key=lambda r: (-r["n"], r["letter"])):
        k = load.index(min(load))
        out[k].append(row["letter"])
        load[k] += row["n"]
    return out


def group_table(groups: Sequence[Sequence[str]]) -> np.ndarray:
    """The group of every Latin-1 code."""
    table = np.zeros(256, np.int64)
    for k, letters in enumerate(groups):
        for letter in letters:
            table[ord(letter)] = k
    return table


def vectors_of(words: Sequence[bytes], table: np.ndarray, groups: int) -> np.ndarray:
    """Letter counts by group, one row for each Latin-1 word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    group = table[np.frombuffer(b"".join(words), np.uint8)]
    flat = np.bincount(owner * groups + group, minlength=len(words) * groups)
    return flat.reshape(len(words), groups).astype(np.int32)


def branch_names(counts: np.ndarray) -> np.ndarray:
    """One 64-bit name for the first counts in each row; a shared name costs time, not rows."""
    name = np.zeros(len(counts), np.uint64)
    for k in range(counts.shape[1]):
        name = (name + counts[:, k].astype(np.uint64) + np.uint64(1)) * STEP
        name ^= name >> np.uint64(29)
    return name.view(np.int64)


def reached_branches(counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and names of all branches that the budget reaches from the first counts."""
    everyone = np.arange(len(counts))
    out = [(everyone, branch_names(counts))]
    for i in range(counts.shape[1]):
        more = counts.copy()
        more[:, i] += 1
        out.append((everyone, branch_names(more)))
        for j in range(i + 1, counts.shape[1]):
            rows = np.flatnonzero(counts[:, j] > 0)
            moved = more[rows]
            moved[:, j] -= 1
            out.append((rows, branch_names(moved)))
    return out


class Trie:
    """The words of a branch in the order of their counts; a node is a run of that order."""

    def __init__(self, words: list[bytes], counts: np.ndarray, small: int = 24):
        order = np.lexsort(counts.T[::-1])
        self.words = [words[k] for k in order]
        self.order, self.counts, self.small = order, counts[order], small

    def candidates(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Asking rows, words found (in trie order) and states: 0 for equal counts, 1 for a
        surplus, 2 for a surplus and a deficit."""
        found: list[tuple] = []
        rows = np.arange(len(asked))
        self._visit(0, len(self.words), 0, rows, np.zeros(len(asked), np.int8), asked, found)
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*found))

    def _visit(self, lo, hi, depth, rows, state, asked, found) -> None:
        if not len(rows):
            return
        if depth == self.counts.shape[1] or hi - lo <= self.small:
            self._leaf(lo, hi, depth, rows, state, asked, found)
            return
        column = self.counts[lo:hi, depth]
        own = asked[rows, depth]
        edges = np.flatnonzero(np.diff(column)) + 1
        starts = np.concatenate([[0], edges])
        for a, b in zip(starts.tolist(), [*edges.tolist(), hi - lo]):
            more = column[a] - own
            surplus = (more == 1) & (state == 0)
            reach = (more == 0) | surplus | ((more == -1) & (state == 1))
            if reach.any():
                after = (state + (more != 0)).astype(np.int8)
                self._visit(lo + a, lo + b, depth + 1, rows[reach], after[reach], asked, found)

    def _leaf(self, lo, hi, depth, rows, state, asked, found, most: int = 1 << 21) -> None:
        """The rest of the counts of a small node at once, in blocks of bounded size."""
        width = (hi - lo) * max(self.counts.shape[1] - depth, 1)
        for k in range(0, len(rows), max(1, most // width)):
            own, was = rows[k : k + max(1, most // width)], state[k : k + max(1, most // width)]
            used = np.repeat(was[:, None], hi - lo, 1)
            alive = np.ones(used.shape, bool)
            for d in range(depth, self.counts.shape[1]):
                more = self.counts[None, lo:hi, d] - asked[own, d][:, None]
                alive &= (more == 0) | ((more == 1) & (used == 0)) | ((more == -1) & (used == 1))
                used = used + (more != 0)
                if not alive.any():
                    break
            i, j = np.nonzero(alive)
            if len(i):
                found.append((own[i], j + lo, used[i, j]))


def matrix_of(words: Sequence[bytes], width: int) -> np.ndarray:
    """Codes of the words' first ``width`` characters, zeros beyond their ends."""
    held = np.array([w[:width] for w in words], dtype=f"S{width}")
    return held.view(np.uint8).reshape(len(words), width)


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether ``a`` becomes ``b`` by one replaced or one inserted character."""
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[same + 1 :] == b[same + 1 :] if len(a) == len(b) else a[same:] == b[same + 1 :])


def verified(
    asking: Sequence[bytes], words: Sequence[bytes], rows: np.ndarray, found: np.ndarray,
    state: np.ndarray, block: int = 1 << 18,
) -> np.ndarray:
    """Which candidate pairs are one edit apart; a pair of equal counts holds once."""
    size_a = np.fromiter(map(len, asking), np.int64, len(asking))
    size_b = np.fromiter(map(len, words), np.int64, len(words))
    width = min(WIDE, max(size_a.max(), size_b.max())) + 1
    short_a, short_b = matrix_of(asking, width), matrix_of(words, width)
    place = np.arange(width)
    keep = np.zeros(len(rows), bool)
    for k in range(0, len(rows), block):
        part = slice(k, k + block)
        i, j = rows[part], found[part]
        a, b = short_a[i], short_b[j]
        differ = a != b
        longer = state[part] == 1
        first = differ.argmax(1)
        # one replaced character: a single difference
        near = ~longer & (differ.sum(1) == 1)
        # of two words with equal counts the smaller one asks
        near &= (state[part] != 0) | (a[np.arange(len(i)), first] < b[np.arange(len(i)), first])
        # one inserted character: equal again behind the first difference
        moved = np.zeros(differ.shape, bool)
        moved[:, :-1] = (a[:, :-1] != b[:, 1:]) & (place[:-1] >= first[:, None])
        near |= longer & differ.any(1) & ~moved.any(1)
        for m in np.flatnonzero((size_a[i] > WIDE) | (size_b[j] > WIDE)).tolist():
            x, y = asking[i[m]], words[j[m]]
            near[m] = (state[k + m] != 0 or x < y) and one_edit(x, y)
        keep[part] = near
    return keep


def near_words(
    words: DataFrame, *, groups: int = 12, mean: int = 4096, most: int = 8192, block: int = 16_384
) -> DataFrame:
    """Rows ``word, n_near, best_n, best`` of words with at least one near word, from rows
    ``word, n`` with distinct words.

    ``best`` is the near word of largest n, of equal ones the smallest.  The trie is dealt out at
    the smallest depth whose branches hold ``mean`` words on average.  A branch of more than
    ``most`` words lies in several pieces, all of which are asked, so no task holds a whole
    frequent branch; askers stream past in blocks.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.written(words.select("word", "n"), "words")
    table = group_table(letter_groups(words, groups))
    total = words.count()
    depth = 0
    while True:
        depth += 1
        named = _branches(words, table, groups, depth, asking=False)
        held = scratch.written(
            named.groupBy("branch").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("pieces")),
            "branches",
        )
        if depth == groups or total <= mean * held.count():
            break
    targets = named.join(held, "branch").select(
        "branch", F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int").alias("piece"),
        F.lit(0).alias("role"), "word", "n",
    )
    askers = (
        _branches(words, table, groups, depth, asking=True).join(held, "branch")
        .select(
            "branch", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
            F.lit(1).alias("role"), "word", "n",
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, piece_of = None, _Piece(table, groups)
        for batch in batches:
            for key, piece, role, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, piece) != place:
                    piece_of.close()
                    if len(piece_of.out) > block:
                        yield near_batch(piece_of.out)
                        piece_of.out = []
                    place, piece_of = (key, piece), _Piece(table, groups, piece_of.out)
                if role == 0:
                    piece_of.add(word, n)
                elif piece_of.ask(word, n) >= block:
                    piece_of.answer()
        piece_of.close()
        yield near_batch(piece_of.out)

    def near_batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = [list(c) for c in zip(*rows)] or [[] for _ in range(4)]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, kinds)], names=["word", "n_near", "best_n", "best"]
        )

    dealt = targets.unionByName(askers).repartition("branch", "piece")
    met = dealt.sortWithinPartitions("branch", "piece", "role").mapInArrow(run, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("order"), "best"))
    found = written(
        met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
        .select("word", "n_near", (-F.col("b.order")).alias("best_n"), F.col("b.best").alias("best")),
        "near-words",
    )
    scratch.clear()
    return found


class _Piece:
    """The words of a piece of a branch, and those that ask it."""

    def __init__(self, table: np.ndarray, groups: int, out: list[tuple] | None = None):
        self.table, self.groups = table, groups
        self.words: list[bytes] = []
        self.sizes: list[int] = []
        self.asking: list[bytes] = []
        self.asking_n: list[int] = []
        self.trie: Trie | None = None
        self.out = [] if out is None else out

    def add(self, word: str, n: int) -> None:
        self.words.append(word.encode("latin-1"))
        self.sizes.append(n)

    def ask(self, word: str, n: int) -> int:
        self.asking.append(word.encode("latin-1"))
        self.asking_n.append(n)
        return len(self.asking)

    def answer(self) -> None:
        """Finds the near words of those that wait; their rows are complete for this piece."""
        if self.words and self.trie is None:
            self.trie = Trie(self.words, vectors_of(self.words, self.table, self.groups))
            self.n = np.array(self.sizes, np.int64)[self.trie.order]
            self.met = np.zeros(len(self.n), np.int64)
            self.best: dict[int, tuple[int, bytes]] = {}
        if self.asking and self.trie is not None:
            words, asking = self.trie.words, self.asking
            pairs = self.trie.candidates(vectors_of(asking, self.table, self.groups))
            if len(pairs[0]):
                good = verified(asking, words, *pairs)
                rows, found = pairs[0][good], pairs[1][good]
                own_n = np.array(self.asking_n, np.int64)
                for i, k, n_near in _best(rows, found, self.n, words):
                    self.out.append((asking[i].decode("latin-1"), n_near, *_named(self.n[k], words[k])))
                for i, k, n_near in _best(found, rows, own_n, asking):
                    self.met[i] += n_near
                    # of the first: the larger n, of equal ones the smaller word
                    mine = (-int(own_n[k]), asking[k])
                    self.best[i] = min(self.best.get(i, mine), mine)
        self.asking, self.asking_n = [], []

    def close(self) -> None:
        self.answer()
        if self.trie is not None:
            for i, (less, word) in self.best.items():
                found = (int(self.met[i]), *_named(-less, word))
                self.out.append((self.trie.words[i].decode("latin-1"), *found))
            self.trie, self.words = None, []


def _named(n: int, word: bytes) -> tuple[int, str]:
    return int(n), word.decode("latin-1")


def _best(
    of: np.ndarray, others: np.ndarray, n: np.ndarray, words: Sequence[bytes]
) -> Iterator[tuple[int, int, int]]:
    """For each word met: itself, its near word of largest n (of equal ones the smallest), and
    how many it has."""
    if not len(of):
        return
    met = np.unique(others)
    ranked = sorted(met.tolist(), key=lambda k: (-int(n[k]), words[k]))
    rank = np.zeros(len(n), np.int64)
    rank[ranked] = np.arange(len(ranked))
    order = np.lexsort([rank[others], of])
    own, first, held = np.unique(of[order], return_index=True, return_counts=True)
    for i, k, c in zip(own.tolist(), others[order][first].tolist(), held.tolist()):
        yield i, k, c


def _branches(
    words: DataFrame, table: np.ndarray, groups: int, depth: int, *, asking: bool
) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            first = vectors_of(raw, table, groups)[:, :depth]
            everyone = np.arange(len(raw))
            sent = reached_branches(first) if asking else [(everyone, branch_names(first))]
            rows = np.concatenate([r for r, _ in sent])
            names = np.concatenate([n for _, n in sent])
            if asking:  # a word asks a branch once, also where two names are equal
                once = np.unique(np.stack([rows, names]), axis=1)
                rows, names = once
            picked = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), batch.column(0).take(picked), batch.column(1).take(picked)],
                names=["branch", "word", "n"],
            )

    return words.mapInArrow(run, "branch long, word string, n long")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows ``word, root`` of all words with a form: the word that their forms end at.

    A form is more frequent than its word, so no way goes round; each pass follows twice as many
    forms as the one before.
    """
    at = scratch.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = scratch.written(moved, "roots")
        at = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return at


def variants(
    docs: DataFrame, *, least_chars: int = 7, least_n: int = 2, factor: int = 10, noise: int = 31
) -> DataFrame:
    """Rows ``word, form, root, n, n_near, form_n``: every word of at least ``least_n``
    occurrences with its commoner spelling.

    Near words differ by one code point; the form is the near word of largest n (of equal ones
    the smallest in code-point order) if that n is at least ``factor`` times the word's, and the
    root is where the forms of forms end, the word itself without one.  Words are those of
    ``word_counts``, where NULL ids and texts are described; repeated rows count as often as they
    are given, other columns are not read, an empty table gives an empty result.  Jobs run while
    the plan is built.
    """
    scratch = Scratch(docs.sparkSession)
    counted = word_counts(docs, least_chars=least_chars, noise=noise).filter(F.col("n") >= least_n)
    words = scratch.written(counted, "spelling-words")
    near = near_words(words)
    common = F.col("best_n") >= factor * F.col("n")
    formed = scratch.written(
        words.join(near, "word", "left").select(
            "word", F.when(common, F.col("best")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(formed.filter(F.col("form").isNotNull()), scratch)
    out = formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
    rows = written(out, "variants")
    scratch.clear()
    return rows
