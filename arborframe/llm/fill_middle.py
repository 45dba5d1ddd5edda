"""Fill-in-the-middle rearrangement of whole texts, cut at tokens or at code points.

Tokens are found on the UTF-8 bytes; a text's index of exceptions lists its multibyte characters
alone, with the bytes they take beyond one.  Between two exceptions a code point is a byte, so a
cut is converted by one binary search and an addition, and a plain ASCII text has no index at all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
REARRANGED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Exceptions:
    """Where the multibyte characters of a UTF-8 text lie, and how many bytes they add."""

    def __init__(self, raw: np.ndarray):
        at = np.flatnonzero(raw >= 0xC0)
        lead = raw[at]
        excess = np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)
        self.bytes = at
        self.added = np.concatenate([[0], excess])  # by the number of exceptions before a cut
        self.points = at - self.added[:-1]
        self.n_points = len(raw) - int(self.added[-1])

    def to_points(self, byte_cuts: Sequence[int]) -> np.ndarray:
        """Code points before each byte cut, which lies at the edge of a character."""
        cuts = np.asarray(byte_cuts, np.int64)
        return cuts - self.added[np.searchsorted(self.bytes, cuts, "left")]

    def to_bytes(self, point_cuts: Sequence[int]) -> np.ndarray:
        """Bytes before each cut in code points."""
        cuts = np.asarray(point_cuts, np.int64)
        return cuts + self.added[np.searchsorted(self.points, cuts, "left")]


def token_ends(raw: np.ndarray) -> np.ndarray:
    """Byte ends of the tokens of a text: a run of other characters with the white space before
    it, and white space that ends the text."""
    if not len(raw):
        return np.zeros(0, np.int64)
    blank = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    inner = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(inner, len(raw))


def rearranged(
    docs: DataFrame, *, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80,
    unit: str = "token", marks: Sequence[str] = MARKS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: its units, its form and the text in that form.

    Both cuts, the choice of documents and the choice of the form follow from the SHA-256 of
    ``seed:doc_id``, so a task that runs again gives the same rows.  Forms: ``plain``, the text as
    it is; ``psm``, prefix, suffix, middle; ``spm``, suffix, prefix, middle, each after its mark.
    ``unit`` is ``token`` or ``point`` (a code point).

    NULL texts count as empty; empty texts, and texts that hold a mark, stay plain, with NULL for
    ``prefix_chars`` and ``middle_chars``.  A NULL id is hashed as an empty one and stays NULL.  A
    repeated row comes back as often as it was given.  Other columns are not read; an empty table
    gives an empty result.  A text has to fit into a task.
    """
    if unit not in ("token", "point"):
        raise ValueError(f"unknown unit {unit!r}")
    before, after, inside = (m.encode() for m in marks)
    held = re.compile(b"|".join(re.escape(m) for m in (before, after, inside)))

    def one(doc: int | None, raw: bytes) -> tuple:
        codes = np.frombuffer(raw, np.uint8)
        index = Exceptions(codes)
        ends = token_ends(codes) if unit == "token" else None
        n = index.n_points if ends is None else len(ends)
        draw = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(draw[k : k + 8], 16) for k in range(0, 32, 8))
        if not raw or h3 % 100 >= fim_percent or held.search(raw):
            return doc, n, "plain", None, None, raw
        units = sorted((h1 % (n + 1), h2 % (n + 1)))
        if ends is None:
            cuts, points = index.to_bytes(units), units
        else:
            cuts = [int(ends[u - 1]) if u else 0 for u in units]
            points = index.to_points(cuts)
        a, b = (int(c) for c in cuts)
        prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
        if h4 % 100 < spm_percent:
            form, output = "spm", after + suffix + before + prefix + inside + middle
        else:
            form, output = "psm", before + prefix + after + suffix + inside + middle
        return doc, n, form, int(points[0]), int(points[1] - points[0]), output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            rows = [
                one(doc, texts[i].as_py() or b"") for i, doc in enumerate(batch.column(0).to_pylist())
            ]
            cols = [list(c) for c in zip(*rows)] or [[] for _ in range(6)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds)]
            arrays[5] = arrays[5].cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                arrays, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            )

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(run, REARRANGED)


def restored(output: Column, form: Column, *, marks: Sequence[str] = MARKS) -> Column:
    """The text that an output was made of, put back in order by its marks and its form."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), 4)
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return (
        F.when(form == "psm", F.concat(first, middle, second))
        .when(form == "spm", F.concat(second, middle, first))
        .otherwise(output)
    )


def digest(docs: DataFrame) -> DataFrame:
    """The rearranged documents by the SHA-256 of their outputs and of the texts put back."""
    rows = rearranged(docs)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
with t as (
  select doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''),
      '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w,
    sha256('42:' || coalesce(doc_id::varchar, '')) as h
  from documents),
u as (
  select doc_id, text, w, len(w) as n,
    ('0x' || h[1:8])::ubigint % (len(w) + 1) as c1, ('0x' || h[9:16])::ubigint % (len(w) + 1) as c2,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
      or ('0x' || h[17:24])::ubigint % 100 >= 50 then 'plain'
      when ('0x' || h[25:32])::ubigint % 100 < 80 then 'spm' else 'psm' end as form
  from t),
v as (
  select doc_id, text, n, form, array_to_string(w[1:least(c1, c2)], '') as p,
    array_to_string(w[least(c1, c2) + 1:greatest(c1, c2)], '') as m,
    array_to_string(w[greatest(c1, c2) + 1:], '') as s
  from u)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(p) end::bigint as prefix_chars,
  case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from v
"""
