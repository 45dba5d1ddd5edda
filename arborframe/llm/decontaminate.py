"""Benchmark decontamination by winnowing, with DataFrame functions only.

From every run of ``window`` words the least hash of its k-word grams is kept.  Two equal windows
keep the same gram, so texts that share a window share a fingerprint.  Fingerprints of documents
meet those of the benchmark; around every meeting the whole windows are compared word by word.
Items shorter than a window are windows of their own length, fingerprinted by their whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborframe.operators.core import written

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for texts whose letters keep their case, where only the number of words counts.
BREAKS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Size:
    """A window length in words and the gram length whose least hash stands for a window."""

    window: int
    gram: int

    @property
    def grams(self) -> int:
        return self.window - self.gram + 1


def words(text: Column, breaks: str = BREAKS) -> Column:
    """Words of a text that has been lower-cased from A to Z; NULL has none."""
    parts = F.split(F.coalesce(text, F.lit("")), breaks)
    return F.filter(parts, lambda w: w != "")


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def bound(value: Column, make) -> Column:
    """``make(x)`` with x the value, evaluated once however often ``make`` uses it."""
    return F.get(F.transform(F.array(value), make), 0)


def _steps(count: Column, make) -> Column:
    """``make(i)`` for i from 1 to ``count``; nothing where that is less than 1."""
    upto = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
    return F.transform(F.slice(upto, F.lit(1), F.greatest(count, F.lit(0))), make)


def gram_hashes(listed: Column, size: int) -> Column:
    """Hashes of all grams, by the place of their first word."""
    return _steps(F.size(listed) - (size - 1), lambda i: F.xxhash64(F.slice(listed, i, size)))


def _kept(listed: Column, size: Size) -> Column:
    """The fingerprints of a text: the least gram hash of each window, each once."""

    def least(grams: Column) -> Column:
        return _steps(
            F.size(grams) - (size.grams - 1),
            lambda i: F.array_min(F.slice(grams, i, size.grams)),
        )

    grams = gram_hashes(listed, size.gram)
    return F.transform(
        F.array_distinct(bound(grams, least) if size.grams > 1 else grams),
        lambda h: F.struct(F.lit(size.window).alias("window"), h.alias("print")),
    )


def fingerprints(texts: DataFrame, sizes: list[Size]) -> DataFrame:
    """Rows ``rid, window, print`` of texts given as ``rid, words``."""
    kept = bound(F.col("words"), lambda w: F.concat(*[_kept(w, s) for s in sizes]))
    return texts.select("rid", F.explode(kept).alias("k")).select("rid", "k.window", "k.print")


def _near(listed: Column, size: Size) -> Column:
    """Whole windows around the grams that the benchmark shares with this text."""
    met = F.col(f"met_{size.window}")
    first = F.lit(size.grams - 1)
    marked = F.transform(
        gram_hashes(listed, size.gram),
        lambda h, i: F.when(F.array_contains(met, h), i + 1),
    )
    starts = F.flatten(
        F.transform(F.array_compact(marked), lambda i: F.sequence(i - first, i))
    )
    last = F.size(listed) - (size.window - 1)
    starts = F.filter(F.array_distinct(starts), lambda s: (s >= 1) & (s <= last))
    return F.transform(
        starts,
        lambda s: F.struct(
            s.alias("start"), F.lit(size.window).alias("window"),
            F.array_join(F.slice(listed, s, size.window), " ").alias("run"),
        ),
    )


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """Rows ``item_id, window, run``: the windows of every item that has words."""
    listed = items.select("item_id", words(lowered(F.col("text"))).alias("words")).filter(
        F.size("words") > 0
    )
    size = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    return (
        listed.withColumn("start", F.explode(starts))
        .select(
            "item_id", size.alias("window"),
            F.array_join(F.slice("words", F.col("start"), size), " ").alias("run"),
        )
        .distinct()
    )


def row_digest(id_col: str, text_col: str) -> Column:
    """A name for rows of one id and one text."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("~"))
    return F.unhex(F.md5(F.concat(name, F.lit("|"), F.coalesce(F.col(text_col), F.lit("")))))


def hits(
    docs: DataFrame, items: DataFrame, *, window: int = 13, gram: int = 5,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The documents as ``rid, doc_id, n_words``, and per hit text ``rid, n_hit, item_ids``.

    ``rid`` is a digest of id and text; a repeated row has the same hits and the same digest.
    Jobs run while the plan is built: the benchmark's tables are written, so that the planner
    broadcasts them only when the size of their files allows it.  The window lengths, at most
    ``window`` of them, are read.  NULL texts have no words.  Items without words match nothing;
    an item with a NULL id hits words but is not listed.  Empty tables give no hits.
    """
    own = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        row_digest(id_col, text_col).alias("rid"),
    )
    runs = written(
        item_windows(
            items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")),
            window,
        ),
        "item-windows",
    )
    lengths = sorted(r[0] for r in runs.select("window").distinct().collect())
    sizes = [Size(n, gram if n == window and gram < n else n) for n in lengths]
    if not sizes:
        sizes = [Size(window, gram)]
    marked = runs.select(F.col("run").alias("rid"), F.split("run", " ").alias("words"))
    prints = written(
        fingerprints(marked, sizes).filter(F.col("window").isin(lengths))
        .select("window", "print").distinct(),
        "item-prints",
    )
    listed = own.select("rid", words(lowered(F.col("text"))).alias("words"))
    met = fingerprints(listed, sizes).join(prints, ["window", "print"])
    lists = [
        F.collect_set(F.when(F.col("window") == s.window, F.col("print"))).alias(f"met_{s.window}")
        for s in sizes
    ]
    near = written(met.groupBy("rid").agg(*lists), "met")
    chosen = own.select("rid", "text").join(near, "rid")
    tried = chosen.select(
        "rid",
        F.explode(
            bound(
                words(lowered(F.col("text"))),
                lambda w: F.concat(*[_near(w, s) for s in sizes]),
            )
        ).alias("t"),
    )
    same = tried.select("rid", "t.start", "t.window", "t.run").join(runs, ["window", "run"])
    found = same.groupBy("rid").agg(
        F.collect_set(F.struct("start", "window")).alias("spans"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
    )
    # words covered by windows, in order of their starts: each adds what lies beyond the last end
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, s: Column) -> Column:
        end = s["start"] + s["window"]
        more = F.greatest(end - F.greatest(s["start"], state["end"]), F.lit(0))
        return F.struct(
            F.greatest(state["end"], end).alias("end"), (state["n"] + more).alias("n")
        )

    counted = found.select(
        "rid", F.aggregate(F.sort_array("spans"), start, step, lambda s: s["n"]).alias("n_hit"),
        "item_ids",
    )
    base = own.select(
        "rid", "doc_id", F.size(words(F.col("text"), BREAKS_ANY_CASE)).cast("long").alias("n_words")
    )
    return base, counted


def contamination(docs: DataFrame, items: DataFrame, *, share: int = 20, **options) -> DataFrame:
    """One row per document: words, words hit, items met, and whether it is contaminated.

    A document is contaminated when at least one in ``share`` of its words is hit.
    """
    base, counted = hits(docs, items, **options)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("item_ids", F.array().cast("array<string>"))
    return base.join(counted, "rid", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        "rid",
    )


def clean(docs: DataFrame, items: DataFrame, *, share: int = 20, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = contamination(docs, items, share=share, **options)
    bad = written(found.filter("contaminated").select("rid").distinct(), "contaminated")
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        row_digest(options.get("id_col", "doc_id"), options.get("text_col", "text")).alias("rid"),
    )
    kept = own.join(bad, "rid", "left_anti")
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])


ORACLE = r"""
with doc as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from documents),
item as (
  select item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from benchmark),
runs as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as run
  from (select item_id, w, least(len(w), 13) as n from item where len(w) > 0) t,
    lateral (select unnest(range(1, len(w) - n + 2)) as i)),
sizes as (select distinct n from runs),
tried as (
  select r, i, n, array_to_string(w[i:i + n - 1], ' ') as run
  from doc, sizes, lateral (select unnest(range(1, len(w) - n + 2)) as i)),
met as (select r, i, t.n, item_id from tried t join runs using (n, run)),
spots as (select distinct r, p from met, lateral (select unnest(range(i, i + n)) as p)),
hit as (select r, count(*) as n_hit from spots group by r),
named as (
  select r, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct r, item_id::varchar as id from met where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join hit using (r) left join named using (r)
"""
