"""A small table with all that an operator has to bear: NULLs, empty, long and repeated texts,
equal ids, and further columns whose names operators like to use for themselves."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, row string, "
    "key long, size long, rid binary, words string, block int, point long, region long, y int, "
    "secret_spans string, component string, rules long"
)


def sentence(draw: random.Random, n: int) -> str:
    sounds = ["ta", "re", "mo", "li", "sün", "ka", "é"]
    return " ".join("".join(draw.choices(sounds, k=draw.randint(1, 4))) for _ in range(n))


def texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    draw = random.Random(seed)
    base = sentence(draw, 120)
    rows = [(i, sentence(draw, draw.randint(1, 90))) for i in range(20)]
    for i in range(20, 40):  # near copies of one text, some of them far from each other
        words = base.split(" ")
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = "altered"
        rows.append((i, " ".join(words)))
    rows += [(40, base), (41, base), (41, base), (41, base.upper()), (42, base + " more")]
    rows += [(50, None), (51, ""), (52, " \n\t "), (53, "one"), (54, "one two"), (55, "One two")]
    rows += [(None, base), (None, None), (56, "x" * 3000), (57, "ha " * 2000), (58, "ha " * 900)]
    rows += [(59, "no-break\x1cword \x00 漢字 🙂 é <|endoftext|> <|ENDOFTEXT|> it's")]
    rows += [(60, "\n".join(sentence(draw, 9) for _ in range(2000)))]
    return rows


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    more = (None, "en", 1, 0.5, "r", 1, 2, b"x", "w", 3, 4, 5, 1, "s", "c", 7)
    full = [(d, t, more[0], *more[1:]) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
