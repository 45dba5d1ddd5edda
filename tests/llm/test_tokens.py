"""Encoding, packing, the token cache and the fertility rules against the libraries."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arborframe.llm import entries, fertility, packing, token_cache
from arborframe.llm.encoding import Encoder

from . import messy

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
MADE = {}
ALPHABET = "aZé́\n\t  .,!'s1９  \x1cẖH̱漢字🙂|<>KKİſ"


def pair(name):
    if name not in MADE:
        path = public_tokenizers.path(name)
        MADE[name] = Encoder(path, most_parts=50, most_stems=50), Tokenizer.from_file(path)
    return MADE[name]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(alphabet=ALPHABET, max_size=60), st.text(max_size=40)))
def test_ids_are_the_librarys(name, text):
    ours, theirs = pair(name)
    assert np.frombuffer(ours.ids(text), "<u4").tolist() == theirs.encode(
        text, add_special_tokens=False
    ).ids


@pytest.mark.parametrize("name", FILES)
def test_special_strings_and_messy_texts(name):
    ours, theirs = pair(name)
    more = ["a <|endoftext|> b", "x<|ENDOFTEXT|>y", "a  b ", " a\n b", "we'll 'S it's", ""]
    for text in more + [t for _, t in messy.texts()]:
        got = np.frombuffer(ours.ids(text), "<u4").tolist()
        assert got == theirs.encode(text or "", add_special_tokens=False).ids


def test_way_of_cutting():
    assert [pair(n)[0].way for n in FILES] == ["words", "spaced"]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    draw = np.random.default_rng(seed)
    capacity = 64
    lengths = draw.integers(1, capacity + 1, draw.integers(0, 400))
    counts = np.bincount(lengths, minlength=capacity + 1)
    plan = packing.Plan(counts).make()
    fill, used = {}, np.zeros_like(counts)
    for length, rank, n, base, offset in plan.segments:
        assert rank == used[length]
        used[length] += n
        for i in range(n):
            fill.setdefault(base + i, []).append((offset, length))
    assert used.tolist() == counts.tolist() and len(fill) == plan.sequences
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert plan.sequences <= -(-int(lengths.sum()) // capacity) * 1.2 + 2


def test_plan_fills_exact_gaps_first():
    counts = np.zeros(101, dtype=np.int64)
    counts[[60, 40, 50, 30, 20, 90, 5, 3, 2]] = [2, 2, 1, 1, 1, 1, 1, 1, 1]
    plan = packing.Plan(counts).make()
    # 60+40 twice, 50+30+20, 90+5+3+2: single, pair and triple complements
    assert plan.sequences == 4 and plan.exact == 4


def check_places(rows, capacity):
    fill = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_packed_documents(spark):
    path, capacity = public_tokenizers.path(FILES[0]), 256
    rows = messy.texts()
    got = packing.pack_documents(messy.table(spark, rows), path, capacity=capacity).collect()
    tok = pair(FILES[0])[1]
    want = []
    for doc, text in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    check_places(got, capacity)
    assert packing.pack_documents(messy.empty(spark), path).count() == 0


def test_many_pieces_of_one_length(spark):
    same = spark.range(3000).selectExpr(
        "id doc_id", "0 piece", "0L start", "10L length", "id ids_crc32"
    )
    got = packing.packed(same, capacity=25, slice_rows=100).collect()
    check_places(got, 25)
    assert len({r["sequence_id"] for r in got}) == 1500


def test_token_cache(spark, tmp_path):
    path, cache = public_tokenizers.path(FILES[1]), str(tmp_path / "cache")
    tok, rows = pair(FILES[1])[1], messy.texts()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(
        ((d, len((t or "").encode()), len(tok.encode(t or "").ids)) for d, t in rows), key=key
    )
    for _ in range(2):  # the second call finds every count
        got = token_cache.token_counts(messy.table(spark, rows), path, cache)
        assert sorted(map(tuple, got.collect()), key=key) == want
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    more = messy.table(spark, rows + [(900, "a new text")])
    assert token_cache.token_counts(more, path, cache).filter("doc_id = 900").first()["n_tokens"] == 3
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows}) + 1
    # counts that another writer appended as well count once; another version is another cache
    twice = spark.read.parquet(cache).limit(5).collect()
    spark.createDataFrame(twice, token_cache.STORED).write.mode("append").parquet(cache)
    assert token_cache.token_counts(messy.table(spark, rows), path, cache).count() == len(rows)
    other = token_cache.token_counts(
        messy.table(spark, [(1, "one two")]), public_tokenizers.path(FILES[0]), cache
    )
    assert other.first()["n_tokens"] == 2
    fresh = str(tmp_path / "none")
    assert token_cache.token_counts(messy.empty(spark), path, fresh).count() == 0


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)
    )


def test_fertility_counts(spark):
    draw = random.Random(5)
    rows = messy.texts() + [
        (100 + i, " ".join(draw.choices(["a", "b", "c", "d|", "*", "é\n", "\n"], k=60)))
        for i in range(30)
    ]
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = fertility.judged(fertility.measures(messy.table(spark, rows), model)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], *[r[n] for n in names]) for r in got), key=key) == sorted(
        ((d, *plain_counts(t)) for d, t in rows), key=key
    )
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert fertility.judged(fertility.measures(messy.empty(spark), model)).count() == 0


def test_bands(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    good = "the quick brown fox jumps over a lazy dog while some people watch from far away " * 1
    words = good.split() + "and every day brings another story about how weather changes in spring".split()
    draw = random.Random(1)
    prose = " ".join(draw.choices(words, k=300))
    bytes_ = " ".join("".join(chr(draw.randint(0x1F300, 0x1F5FF)) for _ in range(3)) for _ in range(90))
    loop = " ".join(f"{'x' * (i % 7 + 1)}" for i in range(120))
    rows = [(1, prose), (2, "".join(c for c in bytes_)), (3, loop)]
    got = {r["doc_id"]: r for r in fertility.measures(messy.table(spark, rows), model).collect()}
    assert got[1]["byte_share"] == 0 and got[2]["byte_share"] > 0.5
    assert got[2]["script"] == "other" and got[1]["script"] == "latin"
    assert got[3]["entropy"] < got[1]["entropy"]
    assert fertility.script_of("привет мир") == "cyrillic" and fertility.script_of("漢字") == "other"
    mojibake = " ".join("Ð¿Ñ€Ð¸Ð" + chr(0xC0 + draw.randint(0, 60)) * 2 for _ in range(90))
    judged = fertility.judged(
        fertility.measures(messy.table(spark, [(1, prose), (2, mojibake)]), model),
        {"latin": fertility.Band(least_chars=1.6)}, most_repeated=100,
    )
    assert {r["doc_id"]: r["kept"] for r in judged.collect()} == {1: True, 2: False}


def test_fences_reject_junk_that_passes_the_base_rules(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = entries.op8(spark, sf).filter("not base_failed").join(labels, "doc_id").collect()
    junk = [r["kept"] for r in got if r["quality"] == 0]
    clean = [r["kept"] for r in got if r["quality"] == 1]
    assert len(junk) >= 20 and sum(junk) / len(junk) < 0.1 and sum(clean) / len(clean) > 0.95


def test_fences_follow_the_corpus(spark):
    names = [c.split()[0] for c in fertility.MEASURES.split(", ")]
    plain = dict.fromkeys(names, 0) | {"n_words": 200, "n_tokens": 400, "script": "other"}
    plain |= {"byte_share": 0.5, "entropy": 6.0, "chars_per_token": 0.6, "chars_per_token_2": 0.5}
    rows = [plain | {"doc_id": i, "entropy": 6 + i / 100} for i in range(40)]
    rows += [plain | {"doc_id": 100, "byte_share": 0.95}, plain | {"doc_id": 101, "entropy": 5.0}]
    rows += [plain | {"doc_id": 102, "chars_per_token_2": 0.3}]
    rows += [plain | {"doc_id": 103, "lang": "few", "byte_share": 0.95}]
    kinds = {c.split()[0]: c.split()[1] for c in fertility.MEASURES.split(", ")}
    table = [
        tuple(
            (r[c] or None) if c == "lang" else float(r[c]) if kinds[c] == "double" else r[c]
            for c in names
        )
        for r in rows
    ]
    docs = spark.createDataFrame(table, fertility.MEASURES)
    kept = {r["doc_id"]: r["kept"] for r in fertility.judged_by_corpus(docs).collect()}
    assert len(kept) == 44 and {i for i, k in kept.items() if not k} == {100, 101, 102}
