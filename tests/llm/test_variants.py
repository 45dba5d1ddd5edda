"""Rearranged texts and spelling variants, against brute force and round trips."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborframe.llm import entries, fill_middle, spelling

from . import messy

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: further texts: marks, parts of marks, characters of two to four bytes, white space at the ends
MARKED = [
    (100 + i, t)
    for i, t in enumerate(
        ["a <P> b", "x<S>", "<M>", "<P", "a <", "< S> <p> <<", " \n lead and tail \x0b\x0c", "é", "🙂🙂 🙂",
         "漢 字é🙂 x", "a b  c", "one", "\t", "ends<S", "<<<<", "P> S> M>"] * 8
    )
]


def plain_middle(rows, unit):
    out = []
    for doc, text in rows:
        text = text or ""
        parts = TOKENS.findall(text) if unit == "token" else list(text)
        h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        n = len(parts)
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
            out.append((doc, n, "plain", None, None, text))
            continue
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
        form = "spm" if h[3] % 100 < 80 else "psm"
        made = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
        out.append((doc, n, form, len(p), len(m), made))
    return out


def by_row(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("unit", ["token", "point"])
def test_rearranged(spark, unit):
    rows = messy.texts() + MARKED
    docs = messy.table(spark, rows)
    got = fill_middle.rearranged(docs, unit=unit)
    assert by_row(got.collect()) == by_row(plain_middle(rows, unit))
    back = got.select(fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(r[0] for r in back) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fill_middle.rearranged(messy.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        fill_middle.rearranged(docs, unit="line")


def test_rearranged_query(spark, tmp_path):
    rows = messy.texts() + MARKED + [(500, "wörd 🙂 " * 200_000)]
    messy.table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [
        (*r[:5], sha(r[5]), sha(t or "")) for r, (_, t) in zip(plain_middle(rows, "token"), rows)
    ]
    assert by_row(entries.op12(spark, str(tmp_path)).collect()) == by_row(want)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a \n\té漢🙂", max_size=30))
def test_index_of_exceptions(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    index = fill_middle.Exceptions(raw)
    cuts = range(len(text) + 1)
    places = [len(text[:c].encode()) for c in cuts]
    assert index.n_points == len(text)
    assert index.to_bytes(cuts).tolist() == places and index.to_points(places).tolist() == list(cuts)
    assert len(index.bytes) == sum(ord(c) > 127 for c in text)
    ends = np.cumsum([len(t.encode()) for t in TOKENS.findall(text)]).tolist()
    assert fill_middle.token_ends(raw).tolist() == ends


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_variants(rows, least_chars=7, least_n=2, factor=10, noise=31):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % noise == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            if len(word) >= least_chars:
                n[word] += 1
    n = {w: c for w, c in n.items() if c >= least_n}
    near = {w: [] for w in n}
    words = sorted(n)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if one_apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def spelled(seed, docs=40):
    """Texts over a small alphabet, so that most words have near ones, with counts far apart."""
    draw = random.Random(seed)
    stems = ["".join(draw.choices("abÉé×", k=draw.randint(6, 9))) for _ in range(30)]
    rows = messy.texts()
    for i in range(docs):
        words = []
        for _ in range(60):
            w = list(stems[min(int(draw.expovariate(0.3)), 29)])
            if draw.random() < 0.25:
                k = draw.randrange(len(w))
                w[k : k + 1] = draw.choice(["", "b", w[k] + "a", "é"])
            words.append("".join(w))
        rows.append((1000 + i, ", ".join(words)))
    chain = "zyxwvutsr " * 200 + "zyxwvuts " * 12
    rows += [(3000 + i, chain + "zyxwvut " * (i < 2)) for i in range(5)]
    long = "q" * 70 + "x"
    rows += [(2000 + i, f"{long}y {long} {long}a {long[1:]} " + "K" * 64 + " " + "k" * 65) for i in range(12)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, seed):
    rows = spelled(seed)
    want = plain_variants(rows)
    got = sorted(map(tuple, spelling.variants(messy.table(spark, rows)).collect()))
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 3 for r in want)


def test_variants_of_nothing(spark):
    assert spelling.variants(messy.empty(spark)).collect() == []
    assert spelling.variants(messy.table(spark, [(1, None), (2, ""), (None, "short words")])).count() == 0


def test_variants_query(spark, tmp_path):
    rows = spelled(3, docs=15)
    messy.table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, entries.op13(spark, str(tmp_path)).collect())) == plain_variants(rows)


@pytest.mark.parametrize("limits", [{"mean": 20, "most": 16, "block": 8}, {"mean": 1, "most": 3, "groups": 3}])
def test_near_words_in_small_pieces(spark, limits):
    """Deep branches, several pieces of a branch and blocks of askers give the same rows."""
    rows = spelled(4, docs=20)
    want = {r[0]: r[4] for r in plain_variants(rows) if r[4]}
    counted = spelling.word_counts(messy.table(spark, rows), most=50).filter("n >= 2")
    got = spelling.near_words(counted, **limits).collect()
    assert {r["word"]: r["n_near"] for r in got} == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=6), min_size=2, max_size=12, unique=True))
def test_trie(words):
    """Every pair one edit apart is met exactly once, whichever way the letters are grouped."""
    raw = [w.encode("latin-1") for w in words]
    table = spelling.group_table([["a", "é"], ["b"], ["c"]])
    counts = spelling.vectors_of(raw, table, 3)
    trie = spelling.Trie(raw, counts, small=2)
    pairs = trie.candidates(counts)
    good = spelling.verified(raw, trie.words, *pairs) if len(pairs[0]) else np.zeros(0, bool)
    met = [frozenset((raw[i], trie.words[j])) for i, j in zip(pairs[0][good], pairs[1][good])]
    want = {frozenset((a, b)) for a in raw for b in raw if a != b and one_apart(a.decode("latin-1"), b.decode("latin-1"))}
    assert len(met) == len(set(met)) and set(met) == want
