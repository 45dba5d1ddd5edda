"""Token ids of whole texts, as the tokenizer libraries give them, with words encoded once.

A text is cut only where the tokenizer itself always cuts, so the ids of the parts, laid end to
end, are the ids of the text.  Parts repeat far more often than texts do, which makes this several
times faster than encoding every text; the bounded memory of known parts belongs to one task's
process and never changes a result.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

ASCII_SPACE = re.compile(r" (?=\s|$)")
COMBINING = re.compile("[\u0300-\U0010ffff]")
#: ASCII marks without the apostrophe, which opens contractions: a run of them is one piece
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
NO_IDS = b""


def _byte_alphabet() -> dict[int, int]:
    """Printable stand-ins of the bytes: visible Latin-1 is itself, the others follow from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


BYTE_ALPHABET = _byte_alphabet()


def way_of_cutting(config: dict) -> str:
    """``words``: white space is dropped; ``spaced``: a part may start with one space; ``whole``.

    Decided from the tokenizer's own configuration; anything unknown is encoded as a whole.
    """
    pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "spaced" if norm is None else "whole"
    steps = pre.get("pretokenizers") or [{}]
    kinds = {n.get("type") for n in (norm or {}).get("normalizers", [])}
    drops = steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
    matches = str((steps[0].get("pattern") or {}).get("Regex", ""))
    if drops and r"[^\s" in matches and kinds == {"NFC", "Replace", "Lowercase"}:
        return "words"
    return "whole"


class Known(dict):
    """Ids by part; an unknown part is encoded on first use and kept while there is room."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, part):
        ids = self.make(part)
        if len(self) < self.most:
            self[part] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the library's own."""

    def __init__(self, path: str, most_parts: int = 300_000, most_stems: int = 500_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        config = json.loads(self.tok.to_str())
        self.way = way_of_cutting(config)
        added = [t["content"] for t in config.get("added_tokens") or []]
        self.special = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        # the word after a space and the one after a line break differ where spaces count
        self.parts = Known(self._word if self.way == "words" else self._spaced, most_parts)
        self.stems = Known(self._stem, most_stems)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _stem(self, stem: str) -> bytes:
        shown = stem
        if not stem.isascii() or stem[0] in " \n":
            shown = stem.encode().decode("latin-1").translate(BYTE_ALPHABET)
        return array("I", [t.id for t in self.tok.model.tokenize(shown)]).tobytes()

    def _word(self, part: bytes) -> bytes:
        """Ids of one run between white space."""
        text = part.decode()
        base = text.rstrip(MARKS)
        tail = text[len(base) :]
        if base in self.stems or (
            base.isalpha() and (base.isascii() or not COMBINING.search(base))
            and base == base.lower()
        ):
            return self.stems[base] + self.stems[tail] if tail else self.stems[base]
        return self._whole(text)

    def _spaced(self, part: str) -> bytes:
        """Ids of a part and the space before it."""
        first, line, second = part.partition("\n")
        base, after = first.rstrip(MARKS), second.rstrip(MARKS)
        if not base.isalpha() or (line and not after.isalpha()):
            return self._whole(" " + part)
        ids, tail = self.stems[" " + base], first[len(base) :]
        if tail:
            ids += self.stems[tail]
        if line:
            ids += self.stems[line] + self.stems[after]
            if len(after) < len(second):
                ids += self.stems[second[len(after) :]]
        return ids

    def ids(self, text: str | None) -> bytes:
        """The ids of one text; NULL counts as empty."""
        if not text:
            return NO_IDS
        if self.way == "whole" or (self.special and self.special.search(text)):
            return self._whole(text)
        known = self.parts
        if self.way == "words":
            # lower-casing ASCII first changes nothing unless a mark may combine with a letter
            raw = text.encode()
            raw = raw if not text.isascii() and COMBINING.search(text) else raw.lower()
            return b"".join([known[p] for p in raw.split()])
        if ASCII_SPACE.search(text):
            # a space before other white space: cut only at spaces that open a word
            first, *rest = re.split(r" (?=\S)", text)
        else:
            first, *rest = text.split(" ")
        return self._whole(first) + b"".join([known[p] for p in rest])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file and process, kept between the tasks that the process runs."""
    return Encoder(path)


@lru_cache(maxsize=2)
def piece_processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def version_digest(path: str) -> str:
    """Digest of the tokenizer file, which names the version that made a stored count."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
