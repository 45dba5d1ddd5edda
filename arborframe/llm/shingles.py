"""Sets of hashed word shingles, for operators that compare whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from arborframe.llm.encoding import Known

# Odd multipliers of a 64-bit polynomial hash and of its last mixing step.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _word(word: bytes) -> bytes:
    return blake2b(word, digest_size=8).digest()


@lru_cache(maxsize=1)
def known_words() -> Known:
    return Known(_word, 150_000)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, A to Z lower-cased."""
    known = known_words()
    words = (text or "").encode().lower().split()
    return np.frombuffer(b"".join([known[w] for w in words]), "<u8")


def in_short(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that the sets of few texts are held at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of fewer words, one of the whole sequence."""
    k = min(size, len(words))
    if k == 0:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    out = words[:n].copy()
    for j in range(1, k):
        out = out * STEP + words[j : n + j]
    if k < size:
        out = out + np.uint64(k)
    return mixed(out)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct shingles of a text, ascending."""
    own = np.sort(gram_hashes(word_hashes(text), size))
    return own[np.append(True, own[1:] != own[:-1])] if len(own) else own


def set_digest(shingles: np.ndarray) -> int:
    """Signed 64-bit digest of a set; equal sets have equal digests."""
    raw = blake2b(shingles.tobytes(), digest_size=8).digest()
    return int.from_bytes(raw, "little", signed=True)
