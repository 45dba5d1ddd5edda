"""Quality rules from tokenizer fertility, beside plain counts over words and lines.

A public vocabulary with byte fallback encodes every word, and a second one every text.  Text of a
language they know takes few tokens per character, hardly any byte tokens, and many different
tokens; mojibake, binary junk and loops leave those bands.  The bands by script are wide; ``fences``
measures narrower ones for each language of the corpus itself.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborframe.llm.encoding import Known, encoder, piece_processor
from arborframe.operators.core import written

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
MEASURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, script string, n_tokens long, chars_per_token double, "
    "byte_share double, entropy double, lang string, n_tokens_2 long, chars_per_token_2 double"
)
#: Measures with fences, and whether a text may lie below or above them.
FENCED = {
    "chars_per_token": (True, True),
    "chars_per_token_2": (True, True),
    "byte_share": (False, True),
    "entropy": (True, False),
}


@dataclass(frozen=True)
class Band:
    """Accepted measures: tokens neither too short nor too long, few bytes, enough variety."""

    least_chars: float = 1.2
    most_chars: float = 8.0
    most_bytes: float = 0.25
    least_entropy: float = 4.8


#: Bands by script; vocabularies of this kind spell out scripts they hardly know in bytes.
BANDS = {
    "latin": Band(),
    "greek": Band(least_chars=0.6, most_bytes=0.6),
    "cyrillic": Band(least_chars=0.9),
    "arabic": Band(least_chars=0.4, most_bytes=0.6),
    "hebrew": Band(least_chars=0.4, most_bytes=0.6),
    "hangul": Band(least_chars=0.25, most_bytes=0.9),
    "kana": Band(least_chars=0.3, most_bytes=0.6),
    "other": Band(least_chars=0.2, most_chars=10.0, most_bytes=1.0),
}
#: First and last code point of the scripts that have a band of their own.
SCRIPTS = {"latin": (0x41, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F),
           "hebrew": (0x590, 0x5FF), "arabic": (0x600, 0x6FF), "kana": (0x3040, 0x30FF),
           "hangul": (0xAC00, 0xD7A3)}


def script_of(text: str) -> str:
    """The script of most code points from ``A`` on that lie in a listed block, else other."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    points = points[points >= 0x41]
    shares = {k: int(((points >= a) & (points <= b)).sum()) for k, (a, b) in SCRIPTS.items()}
    best = max(shares, key=shares.get)
    return best if 2 * shares[best] > len(points) or not len(points) else "other"


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    key, width = codes[:n], len(seen)
    for k in range(1, size):
        if key.max(initial=0) > (2**62) // max(width, 1):
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * width + codes[k : k + n]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    start = np.flatnonzero(np.isin(key, twice))
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


class Fertility:
    """Tokens of words under one vocabulary; each process keeps the words it has met."""

    _made: dict[str, Fertility] = {}

    def __init__(self, path: str, most: int = 500_000):
        self.model = piece_processor(path)
        size = self.model.get_piece_size()
        self.size = size
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.words = Known(self._word, most)

    @classmethod
    def of(cls, path: str) -> Fertility:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _word(self, word: bytes) -> bytes:
        return array("I", self.model.encode(word.decode(), num_threads=1)).tobytes()

    def measure(self, words: list[bytes]) -> tuple[int, float, float]:
        """Number of tokens, share of byte tokens, entropy of the tokens in bits."""
        known = self.words
        ids = np.frombuffer(b"".join([known[w] for w in words]), "<u4")
        if not len(ids):
            return 0, 0.0, 0.0
        counts = np.bincount(ids, minlength=self.size)
        p = counts[counts > 0] / len(ids)
        return len(ids), float(counts[self.is_byte].sum() / len(ids)), float(-(p * np.log2(p)).sum())


def measures(
    docs: DataFrame, model: str, second: str | None = None, *, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str | None = None,
) -> DataFrame:
    """Counts and fertility of every whole text; one row for every row of ``docs``.

    Without a second vocabulary its measures are zero, without ``lang_col`` the language is NULL.
    NULL and empty texts have no words, no tokens and zero for every measure.  Repeated rows are
    measured again, NULL ids stay, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility.of(model)
        names = [c.split()[0] for c in MEASURES.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        types = [kinds[c.split()[1]] for c in MEASURES.split(", ")]
        for batch in batches:
            rows, texts, langs = [], batch.column(1), batch.column(2)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                text = texts[i].as_py() or ""
                raw = text.encode()
                words = raw.split()
                lines = [x for x in raw.split(b"\n") if x.strip()]
                chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
                n, share, entropy = fertility.measure(words)
                n_2 = len(encoder(second).ids(text)) // 4 if second else 0
                rows.append((
                    doc, len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)),
                    len(lines) - len(set(lines)), repeated_words(words), script_of(text), n,
                    chars / n if n else 0.0, share, entropy, langs[i].as_py(), n_2,
                    chars / n_2 if n_2 else 0.0,
                ))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(cols, types)], names=names
            )

    lang = F.col(lang_col) if lang_col else F.lit(None)
    wanted = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        lang.cast("string").alias("lang"),
    )
    return wanted.mapInArrow(run, MEASURES)


def base_rules(least_words: int = 50, most_repeated: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (
        100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")
    )


def fences(
    rows: DataFrame, *, reach: float = 2.0, least_spread: float = 0.01, least_share: float = 0.05,
    least_rows: int = 30, short: int = 100,
) -> DataFrame:
    """The accepted range of each measure for every script and language of the corpus.

    It ends ``reach`` times the distance of the quartiles beyond them; that distance counts as
    ``least_spread`` of the lower quartile at least, and byte shares up to ``least_share`` above
    the upper quartile are accepted.  Texts that fail the base rules or are ``short`` are not
    measured, groups of fewer than ``least_rows`` texts get no fences.  The quartiles are exact
    over values of three decimals, so that the counts to be merged stay small.
    """
    known = rows.filter(~base_rules() & (F.col("n_tokens") >= short))
    quartiles = known.groupBy("script", "lang").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.percentile(F.round(c, 3), F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in FENCED],
    )
    ends = []
    for c in FENCED:
        low, high = F.col(c)[0], F.col(c)[1]
        spread = reach * F.greatest(high - low, least_spread * low)
        ends += [(low - spread).alias(f"{c}_low")]
        ends += [
            (high + (F.greatest(spread, F.lit(least_share)) if c == "byte_share" else spread))
            .alias(f"{c}_high")
        ]
    return quartiles.filter(F.col("n") >= least_rows).select(
        F.col("script").alias("of_script"), F.col("lang").alias("of_lang"), *ends
    )


def judged_by_corpus(rows: DataFrame, **options) -> DataFrame:
    """``judged``, and a text is kept only inside the fences of its script and language.

    NULL languages are a group of their own; NULL and empty texts fail the base rules.  Repeated
    rows come back as often as they were given, an empty table gives an empty result.  The measures
    are written once, as they are read twice.
    """
    own = written(rows, "fertility")
    out = judged(own, **options).join(
        F.broadcast(fences(own, short=options.get("short", 100))),
        F.col("script").eqNullSafe(F.col("of_script")) & F.col("lang").eqNullSafe(F.col("of_lang")),
        "left",
    )
    inside = F.lit(True)
    for c, (below, above) in FENCED.items():
        if below:
            inside = inside & (F.col(c) >= F.col(f"{c}_low"))
        if above:
            inside = inside & (F.col(c) <= F.col(f"{c}_high"))
    free = F.col("of_script").isNull() | (F.col("n_tokens") < options.get("short", 100))
    return out.withColumn("kept", F.col("kept") & (free | inside)).select(
        *own.columns, "base_failed", "kept"
    )


def judged(
    rows: DataFrame, bands: dict[str, Band] = BANDS, *, least_words: int = 50,
    most_repeated: int = 50, short: int = 100,
) -> DataFrame:
    """Adds ``base_failed`` and ``kept``.

    A text fails its band with tokens too short or too long, too many byte tokens, or too little
    entropy; texts under ``short`` tokens cannot show much entropy and are not judged by it.
    """
    base = base_rules(least_words, most_repeated)
    verdict = F.lit(False)
    for script, band in bands.items():
        verdict = verdict | (
            (F.col("script") == script)
            & F.col("chars_per_token").between(band.least_chars, band.most_chars)
            & (F.col("byte_share") <= band.most_bytes)
            & ((F.col("n_tokens") < short) | (F.col("entropy") >= band.least_entropy))
        )
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & verdict)
