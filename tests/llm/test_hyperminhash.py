"""Near duplicates by HyperMinHash, against all pairs of full sets."""

import random

import numpy as np
import pytest

from arborframe.llm import entries, hyperminhash
from arborframe.llm.shingles import shingle_set

from . import messy


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lowered(text)).split(" ") if w]


def plain_duplicates(rows, size=4, percent=80):
    sets = []
    for doc, text in rows:
        w = words_of(text)
        k = min(size, len(w))
        grams = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()
        sets.append((doc, grams))
    usable = [(d, g) for d, g in sets if d is not None and g]
    parent = list(range(len(usable)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(usable):
        for j, (_, b) in enumerate(usable[:i]):
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(usable):
        least[top(i)] = min(d, least.get(top(i), d))
    at = iter(range(len(usable)))
    out = []
    for doc, grams in sets:
        named = least[top(next(at))] if doc is not None and grams else doc
        out.append((doc, len(grams), named, doc is None or doc == named))
    return out


def crowd(draw, n=150):
    """Versions of one text at all distances, some linked only by way of others."""
    base = messy.sentence(draw, 200).split(" ")
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(draw.randint(0, 25)):
            words[draw.randrange(len(words))] = draw.choice(["one", "two", messy.sentence(draw, 1)])
        if i % 7 == 0:
            words = words[: draw.randint(120, 200)]
        rows.append((500 + i, " ".join(words)))
    return rows


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("limits", [{}, {"asking": 3, "others": 8}])
def test_duplicates(spark, limits):
    draw = random.Random(5)
    rows = messy.texts() + crowd(draw) + [(41, "another text of an id given twice"), (700, "a b c d e")]
    got = hyperminhash.near_duplicates(messy.table(spark, rows), **limits).collect()
    want = plain_duplicates(rows)
    same(got, want)
    sizes = [r[2] for r in want]
    assert max(map(sizes.count, sizes)) > 30 and len(set(sizes)) > 60


def test_no_documents(spark):
    assert hyperminhash.near_duplicates(messy.empty(spark)).count() == 0
    rows = [(1, None), (2, ""), (None, "a b c d e f"), (3, "alone here")]
    same(hyperminhash.near_duplicates(messy.table(spark, rows)).collect(), plain_duplicates(rows))


def test_duplicates_query(spark, tmp_path):
    rows = messy.texts(8) + crowd(random.Random(2), 40)
    messy.table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    same(entries.op11(spark, str(tmp_path)).collect(), plain_duplicates(rows))


def overlapping(draw, n, share):
    """Two random sets of about n hashes with the given Jaccard index."""
    every = np.array([draw.getrandbits(64) for _ in range(n)], np.uint64)
    common = round(n * share)
    rest = (n - common) // 2
    a, b = every[: common + rest], np.append(every[:common], every[common + rest :])
    return np.sort(a), np.sort(b), common / n


@pytest.mark.parametrize("n", [12, 100, 1000, 20_000])
def test_estimates(n):
    draw = random.Random(n)
    for share in (0.3, 0.8):
        misses, banded = [], 0
        for _ in range(60):
            a, b, jaccard = overlapping(draw, n, share)
            one, two = hyperminhash.registers_of(a), hyperminhash.registers_of(b)
            got = hyperminhash.estimated(np.array([(one == two).sum()]), np.array([len(a)]), np.array([len(b)]))
            misses.append(got[0] - jaccard)
            both = hyperminhash.band_keys(np.stack([one, two]))
            banded += (both[0] == both[1]).any()
        assert abs(np.mean(misses)) < 0.03 and np.abs(misses).max() < 0.2
        assert banded == 60 if share == 0.8 else banded < 30


def test_registers_hold_zeros_and_mantissa():
    bucket, zeros, tail = 7, 5, 0b1011001110
    value = (bucket << 56) | (1 << (55 - zeros)) | (tail << (45 - zeros))
    larger = value | (1 << 54)
    got = hyperminhash.registers_of(np.array([value, larger], np.uint64))
    assert set(got.tolist()) == {(zeros << 10) | tail}  # the smaller hash, in all buckets
    assert hyperminhash.registers_of(shingle_set("one two three"))[0] == got.dtype.type(
        hyperminhash.registers_of(shingle_set("ONE two  three"))[0]
    )
    assert hyperminhash.registers_of(np.zeros(1, np.uint64)).dtype == np.uint16


def test_accidents_of_unlike_sets():
    draw = np.random.default_rng(3)
    sets = [np.sort(draw.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2)) for _ in range(40)]
    rows = np.stack([hyperminhash.registers_of(s) for s in sets])
    agree = np.mean([(rows[i] == rows[j]).mean() for i in range(40) for j in range(i)])
    assert 0.5 < agree / hyperminhash.accidents([5000], [5000])[0] < 2


def test_every_set_has_rows_in_its_bands(spark):
    made = hyperminhash.signed(messy.table(spark, messy.texts()).select("doc_id", "text"))
    n = made.filter("n_shingles > 0").count()
    assert hyperminhash.banded(made.filter("n_shingles > 0")).count() == n * hyperminhash.BANDS
    assert made.filter("n_shingles = 0 and registers is not null").count() == 0
