"""Operators that compare documents with the whole corpus, against brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborframe.llm import backoff, entries, jaccard_regions, runlength
from arborframe.llm.shingles import shingle_set

from . import messy


def plain_backoff(rows, order):
    words = [(t or "").encode().lower().split() for _, t in rows]
    own = [
        collections.Counter(
            tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)
        )
        for w in words
    ]
    every = sum(own, collections.Counter())
    total, out = sum(map(len, words)), []
    for (doc, _), w, mine in zip(rows, words, own):
        score = backed = unseen = 0
        for i in range(len(w)):
            shortened = 0
            for n in range(order, 1, -1):
                if i < n - 1:
                    continue
                gram = tuple(w[i - n + 1 : i + 1])
                if every[gram] > mine[gram]:
                    held = every[gram[:-1]] - mine[gram[:-1]]
                    score += math.log((every[gram] - mine[gram]) / held)
                    break
                score += math.log(0.4)
                shortened = 1
            else:
                left = every[(w[i],)] - mine[(w[i],)]
                score += math.log(max(left, 0.5) / (total - len(w) + 1))
                unseen += left <= 0
            backed += shortened
        out.append((doc, len(w), backed, unseen, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff(spark, order):
    rows = messy.texts()
    got = backoff.scored(messy.table(spark, rows), order=order, block_bytes=5000).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 3))
    for a, b in zip(sorted(got, key=key), sorted(plain_backoff(rows, order), key=key), strict=True):
        assert tuple(a)[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(a["score"], b[4] / max(b[1], 1), rel_tol=1e-9, abs_tol=1e-9)
    assert backoff.scored(messy.empty(spark)).count() == 0


def same_scores(got, want):
    for a, b in zip(sorted(map(tuple, got)), sorted(want), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9)


def test_backoff_query_scores_trigrams(spark, tmp_path):
    words = ["a b c d", "a b c e", "x a b c", "b c a b", "d d d d d", "q r s", "q r", None]
    rows = list(enumerate(words))
    messy.table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = entries.op5(spark, str(tmp_path)).collect()
    same_scores(got, plain_backoff(rows, 3))
    assert {r["doc_id"]: r["n_backed_off"] for r in got}[3] == 2  # b c held, c a and b c a not


@pytest.mark.parametrize("order", [4, 5])
def test_backoff_of_longer_orders(spark, order):
    draw = random.Random(order)
    rows = [(i, " ".join(draw.choices("abc", k=draw.randint(0, 12)))) for i in range(300)]
    got = backoff.scored(messy.table(spark, rows), order=order, block_bytes=60).collect()
    same_scores(got, plain_backoff(rows, order))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2000) | st.integers(0, 2**50), max_size=50))
def test_packed_counts(numbers):
    own = np.array(numbers, dtype=np.int64)
    assert backoff.unpacked_counts(backoff.packed_counts(own)).tolist() == numbers


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packed_numbers(numbers):
    own = np.unique(np.array(numbers, dtype=np.uint64))
    assert backoff.unpacked(backoff.packed(own)).tolist() == own.tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00ÿ", min_size=1, max_size=40), min_size=1, max_size=12))
def test_matching_statistics(texts):
    raws = [t.encode() for t in texts]
    index = runlength.RunLengthIndex(raws)
    neighbour, match = index.matching()
    # suffixes in order, each closed by a mark of its own that is less than any byte
    places = [(k, i) for k, r in enumerate(raws) for i in range(len(r) + 1)]
    order = sorted(places, key=lambda p: ([*[b + 1 for b in raws[p[0]][p[1] :]], 0], p[0]))
    at = {p: index.start[p[0]] + p[1] for p in places}
    for above, p in zip(order, order[1:]):
        a, b = raws[above[0]][above[1] :], raws[p[0]][p[1] :]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert (neighbour[at[p]], match[at[p]]) == (at[above], same)
    assert len(index.sample) <= index.n


def plain_repeats(rows, size):
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for s in range(len(raw) - size + 1 if doc is not None else 0):
            first[raw[s : s + size]] = min(first.get(raw[s : s + size], doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - size + 1 if doc is not None else 0):
            if first[raw[s : s + size]] < doc:
                gone[s : s + size] = b"\1" * size
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [2000, 2])
def test_repeats(spark, crowd):
    draw = random.Random(2)
    base = "".join(draw.choices("ab", k=300))
    rows = messy.texts() + [
        (300 + i, base[draw.randint(0, 150) :][: draw.randint(0, 200)] + "é\x00" * draw.randint(0, 40))
        for i in range(40)
    ]
    rows += [(None, base), (301, base), (305, base), (7, base[:120])]
    docs = messy.table(spark, rows)
    got = runlength.digest(docs, block_bytes=8000, crowd=crowd).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(plain_repeats(rows, 50), key=key)
    assert runlength.digest(messy.empty(spark)).count() == 0


def test_spans_of_repeats(spark):
    rows = [(1, "x" * 20 + "abcdefghij" * 6), (2, "abcdefghij" * 6 + "y" * 20)]
    got = {r["doc_id"]: r for r in runlength.without_repeats(messy.table(spark, rows)).collect()}
    assert got[1]["spans"] == [] and got[1]["n_removed"] == 0
    assert [tuple(s) for s in got[2]["spans"]] == [(0, 60)] and got[2]["kept"] == b"y" * 20


def plain_components(rows, percent=80):
    sets, first = [], {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        own = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None
        sets.append(own)
        if own and doc is not None:
            first[own] = min(first.get(own, doc), doc)
    kinds = list(first)
    up = {s: s for s in kinds}

    def top(s):
        while up[s] is not s:
            s = up[s]
        return s

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if 100 * len(a & b) >= percent * len(a | b) and top(a) is not top(b):
                up[top(a)] = top(b)
    least = {}
    for s in kinds:
        least[top(s)] = min(least.get(top(s), first[s]), first[s])
    return [
        (doc, len(own or ()), doc if not own or doc is None else least[top(own)])
        for (doc, _), own in zip(rows, sets)
    ]


def families(draw):
    """Chains of texts that drift apart, groups around one text, and a passage many share."""
    rows, doc = [], 1000
    for _ in range(4):
        words = messy.sentence(draw, 60).split(" ")
        for _ in range(25):
            words = words[:]
            words[draw.randrange(len(words))] = f"new{draw.randint(0, 99)}"
            rows.append((doc, " ".join(words)))
            doc += 1
    shared = messy.sentence(draw, 12)
    for _ in range(40):
        rows.append((doc, shared + " " + messy.sentence(draw, draw.randint(1, 6))))
        doc += 1
    draw.shuffle(rows)
    return rows


def test_jaccard_components(spark):
    rows = messy.texts() + families(random.Random(9))
    got = jaccard_regions.linked_components(messy.table(spark, rows)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_components(rows), key=key)
    assert jaccard_regions.linked_components(messy.empty(spark)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"asking": 3, "others": 7}])
def test_what_one_pivot_leaves_is_compared(spark, limits):
    """Many texts share their rarest shingles, in several components: one pivot is not enough."""
    draw = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(30))
    rows = []
    for i in range(150):
        tail = " ".join(f"t{i // 6}x{j}" for j in range(12))
        rows.append((i, f"{shared} {tail} {'w' if i % 2 else 'v'}{draw.randint(0, 3)}"))
    rows += [(1000 + i, f"{shared} u{i} " + " ".join(f"u{i}x{j}" for j in range(3))) for i in range(90)]
    rare = jaccard_regions.rare_shingles(
        messy.table(spark, rows).select("doc_id", "text"), np.zeros(1 << jaccard_regions.SKETCH_BITS, np.uint16)
    )
    held = collections.defaultdict(set)
    for r in rare.collect():
        held[r["shingle"]].add(r["point"])
    shared = collections.defaultdict(list)
    for r in jaccard_regions.members(jaccard_regions.regions(rare)).collect():
        shared[r["region"]].append(r["point"])
    want = {frozenset(own) for own in held.values() if len(own) > 1}
    assert {frozenset(own) for own in shared.values()} == want
    assert all(len(own) == len(set(own)) for own in shared.values())
    assert max(map(len, want)) > jaccard_regions.SMALL > 2 and len(want) < sum(len(o) > 1 for o in held.values())
    got = jaccard_regions.linked_components(messy.table(spark, rows), **limits).collect()
    assert sorted(map(tuple, got)) == sorted(plain_components(rows))


def test_bounds_on_pairs_of_a_region(spark):
    """Of the pairs with an open point those stay that no bound leaves out, each once."""
    profile = np.full(128, 2, np.uint8).tobytes()
    far = np.concatenate([np.full(64, 4, np.uint8), np.zeros(64, np.uint8)]).tobytes()
    wide = np.full(128, 300, np.uint32).tobytes()
    rows = [  # point, component, open, n, alone, distance to the pivot, earlier regions, profile
        (1, 1, 1, 256, 0, 0.3, [], profile), (2, 1, 0, 256, 0, 0.3, [], profile),
        (3, 3, 1, 256, 0, 0.45, [], profile), (4, 4, 1, 256, 0, 0.9, [], profile),
        (5, 5, 1, 256, 0, None, [], far), (6, 6, 1, 256, 40, 0.3, [], profile),
        (7, 7, 0, 256, 0, 0.3, [77], profile), (8, 8, 1, 256, 0, 0.3, [76, 77], profile),
        (9, 9, 1, 38400, 0, None, [], wide),
    ]
    n = collections.Counter()
    asked = [(5, 0, 0, 1, *r) for r in rows]
    asking = [(5, 0, 0, 0, *r) for r in rows if r[2]]
    kind = (
        "region long, piece int, part int, role int, point long, component long, open int, n long, "
        "alone long, to_pivot double, past array<long>, profile binary"
    )
    got = jaccard_regions.left_pairs(spark.createDataFrame(asking + asked, kind), percent=80)
    n.update((r["a"], r["b"]) for r in got.collect())
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and (a[2] or b[2]) and a[1] != b[1]:
                known = a[5] is not None and b[5] is not None
                if known and abs(a[5] - b[5]) > 0.2 or {a[0], b[0]} == {7, 8}:
                    continue
                most = min(a[3] - a[4], b[3] - b[4])
                own, other = (np.frombuffer(x[7], np.uint8 if len(x[7]) == 128 else np.uint32) for x in (a, b))
                most = min(most, int(np.minimum(own, other).sum()))
                if 100 * most >= 80 * (a[3] + b[3] - most):
                    want.add((a[0], b[0]) if a[2] else (b[0], a[0]))
    assert {tuple(sorted(p)) for p in n} == {tuple(sorted(p)) for p in want} and set(n.values()) == {1}


def test_names_of_sets_depend_on_the_salt():
    one, two = shingle_set("a b c d e f"), shingle_set("a b c d e g")
    assert jaccard_regions.set_names(one) == jaccard_regions.set_names(one.copy())
    names = [jaccard_regions.set_names(s, salt) for s in (one, two) for salt in (0, 1)]
    assert len(set(names)) == 4 and all(-(2**63) <= h < 2**63 for n in names for h in n)


def test_shingles_of_short_texts():
    assert len(shingle_set("a b c")) == 1 and len(shingle_set("")) == 0 and len(shingle_set(None)) == 0
    assert shingle_set("A b")[0] == shingle_set(" a  B\n")[0] != shingle_set("a b c")[0]
    assert len(shingle_set("a b c d e f")) == 2


def test_index_rows_are_in_the_order_of_whole_suffixes():
    rng = random.Random(3)
    texts = list({bytes(rng.choice(b"ab\xff") for _ in range(rng.randrange(1, 84))) for _ in range(60)})
    texts += [b"a" * 83, b"ba" * 41, b"a" * 40]
    index = runlength.RunLengthIndex(texts)
    whole = [(t[i:] + b"", k) for k, t in enumerate(texts) for i in range(len(t) + 1)]
    symbols = np.zeros(index.n + 8, dtype=np.int16)
    flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + 1
    symbols[: index.n] = flat
    symbols[index.start + [len(t) for t in texts]] = 0
    rows = index._suffix_order(symbols, 84)
    assert rows.tolist() == sorted(range(index.n), key=lambda r: (whole[r][0], r))


def test_rows_between_blocks_and_ranges_grow_slower_than_the_square_of_the_input():
    def rows(total):
        return total / runlength._block_bytes(total) * total / (2 << 20)

    assert rows(1 << 30) / (1 << 30) < 2e-4
    assert rows(10 << 30) / (10 << 30) < 3.2 * rows(1 << 30) / (1 << 30) * 1.01
