"""Secret scans through a trigram index: Boolean trigram queries, postings, then verification.

Every rule's regular expression is turned into an OR of trigram sets that each text with a match
must contain.  Postings of those trigrams are intersected per content; only candidates meet the
expression itself.  A rule that forces no trigram is matched against every text.
All of it is DataFrame functions; Python only reads the rules.
"""

from __future__ import annotations

import itertools
import re._constants as kind
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of one group of a match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(words: str) -> str:
    """The expression with every ASCII letter in both cases."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in words)


# The base kinds, in the order in which spans of one start are listed.
ASSIGN = (
    "(" + either_case("password|passwd|secret|token|api_?key") + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Further kinds; each of them forces trigrams.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

Clauses = frozenset  # of frozensets of trigrams: at least one set must be there as a whole
ANY: Clauses = frozenset({frozenset()})
MOST = 64


def _least(clauses) -> Clauses:
    """Without the clauses that another clause implies."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Clauses, b: Clauses) -> Clauses:
    if len(a) * len(b) > MOST:  # weaker, never wrong
        return min(a, b, key=len) if ANY not in (a, b) else (b if a == ANY else a)
    return _least({x | y for x in a for y in b})


def _of_strings(strings: set[str]) -> Clauses:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _repeat(low: int, high, inner) -> tuple[set[str] | None, Clauses]:
    exact, query = _sequence(inner)
    if exact is not None and (low, high) == (0, 1):
        return exact | {""}, ANY
    if exact is not None and low == high and len(exact) ** low <= MOST:
        return {"".join(p) for p in itertools.product(exact, repeat=low)}, ANY
    if low == 0:
        return None, ANY
    return None, query if exact is None else _of_strings(exact)


def _one(op, arg) -> tuple[set[str] | None, Clauses]:
    """All lower-cased strings that a part of an expression matches, if few, else its query."""
    if op is kind.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is kind.IN:
        if all(o is kind.LITERAL for o, _ in arg) and len(arg) <= 8:
            return {chr(c).lower() for _, c in arg}, ANY
        return None, ANY
    if op is kind.AT:
        return {""}, ANY
    if op is kind.SUBPATTERN:
        return _sequence(arg[3])
    if op in (kind.MAX_REPEAT, kind.MIN_REPEAT):
        return _repeat(*arg)
    if op is kind.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        if all(exact is not None for exact, _ in parts):
            return set().union(*(exact for exact, _ in parts)), ANY
        either = {c for e, q in parts for c in (q if e is None else _of_strings(e))}
        return None, _least(either)
    return None, ANY


def _sequence(items) -> tuple[set[str] | None, Clauses]:
    run, query, whole = {""}, ANY, True
    for op, arg in items:
        exact, own = _one(op, arg)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
            continue
        query, whole = _both(query, _of_strings(run)), False
        run = {""} if exact is None else exact
        query = _both(query, own)
    return (run, ANY) if whole else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Clauses:
    """Trigram sets of which every lower-cased text with a match holds at least one."""
    exact, query = _sequence(parser.parse(pattern))
    return query if exact is None else _of_strings(exact)


def _matches(text: Column, at: int, rule: Rule) -> Column:
    """Spans ``(start, kind, end)`` of one rule: leftmost matches, one after the other.

    The text between matches and the matches alternate, so their lengths add up to the starts.
    """
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("before"),
        F.transform(F.regexp_extract_all(text, pattern, 0), F.length).alias("long"),
        F.transform(F.regexp_extract_all(text, pattern, rule.group), F.length).alias("value"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + m["before"]
        end = start + m["long"]
        span = F.struct(
            start.alias("start"), F.lit(at).alias("kind"), end.alias("end")
        )
        kept = F.when(
            m["value"] >= rule.least, F.concat(state["spans"], F.array(span))
        ).otherwise(state["spans"])
        return F.struct(F.coalesce(end, start).alias("at"), kept.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.aggregate(found, start, step, lambda s: s["spans"])


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows ``key, size, rules``: which rules' trigram queries a content satisfies, as bits.

    ``texts`` has ``key``, a hash of the content, ``size`` and ``text``.  Contents that share both
    share their postings, which can only add candidates.
    """
    spark = texts.sparkSession
    clauses = [
        (r, c, sorted(terms)[:62])
        for r, rule in enumerate(rules)
        for c, terms in enumerate(sorted(trigram_query(rule.pattern), key=sorted))
        if terms
    ]  # of a longer clause, the first 62 trigrams decide: a weaker query, never a wrong one
    terms = sorted({t for _, _, ts in clauses for t in ts})
    # one row per trigram that a rule needs: as long as the rules, whatever the corpus
    rows = ", ".join(
        f"('{t}', {r}, {c}, {1 << ts.index(t)}L, {(1 << len(ts)) - 1}L)"
        for r, c, ts in clauses for t in ts
    )
    index = spark.sql(f"select * from values {rows} as t(term, rule, clause, bit, need)")
    low = texts.select("key", "size", F.lower("text").alias("low"))
    there = F.array_compact(
        F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in terms])
    )
    postings = low.select("key", "size", F.explode(there).alias("term"))
    whole = (
        postings.join(F.broadcast(index), "term")
        .groupBy("key", "size", "rule", "clause")
        .agg(F.bit_or("bit").alias("bits"), F.max("need").alias("need"))
        .filter(F.col("bits") == F.col("need"))
    )
    return whole.groupBy("key", "size").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secret_spans``: sorted structs of start, kind (place in ``rules``) and end.

    Positions count code points, the end is exclusive.  NULL and empty texts have no spans; NULLs
    elsewhere, repeated rows and further columns pass through; a column ``secret_spans`` of the
    input is replaced.  An empty table gives an empty result.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).alias("text")
    )
    keyed = own.select(
        "row", "text", F.xxhash64("text").alias("key"), F.octet_length("text").alias("size")
    )
    # joined on the size as well, so that both sides are dealt anew and a hot content is split
    joined = keyed.join(candidates(keyed, rules), ["key", "size"], "left")
    spans = []
    for at, rule in enumerate(rules):
        listed = trigram_query(rule.pattern) != ANY
        bit = F.shiftright(F.col("rules"), at).bitwiseAND(F.lit(1)) == 1
        maybe = (bit if listed else F.lit(True)) & F.col("text").rlike(rule.pattern)
        none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
        spans.append(F.when(maybe, _matches(F.col("text"), at, rule)).otherwise(none))
    rest = [F.col(f"row.`{c}`") for c in docs.columns if c != "secret_spans"]
    return joined.select(*rest, F.array_sort(F.concat(*spans)).alias("secret_spans"))


def listed_spans(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as text: ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
        ),
        ",",
    )


def redacted(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The scanned documents with every span's text replaced by a mark; NULL texts stay NULL."""
    text, spans = F.col(f"`{text_col}`"), F.col("secret_spans")

    def step(state: Column, s: Column) -> Column:
        ahead = s["start"] >= state["at"]
        more = F.concat(
            state["out"],
            F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark),
        )
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(ahead, more).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(
        spans, start, step,
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    return docs.withColumn(
        text_col, F.when(F.size(spans) > 0, clean).otherwise(text)
    ).drop("secret_spans")


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text.

    NULL and empty texts have no spans: zeros, the digest of the empty string and an empty text.
    Repeated rows come back as often as they were given, NULL ids stay, other columns are not
    returned, an empty table gives an empty result.
    """
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))

    def number(k: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")

    return scan(docs, rules).select(
        F.col(id_col).alias("doc_id"),
        *[number(k).alias(f"n_{rule.kind}") for k, rule in enumerate(BASE)],
        F.sha2(listed_spans(base, rules), 256).alias("base_sha256"),
        listed_spans(spans, rules).alias("spans"),
    )


def _kind_sql(at: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    lengths = "list_transform({}, lambda p: length(p))"
    found = lengths.format(f"regexp_extract_all(text, '{pattern}', 0)")
    value = lengths.format(f"regexp_extract_all(text, '{pattern}', {rule.group})")
    before = lengths.format(f"string_split_regex(text, '{pattern}')")
    return f"""
  list_filter(list_transform(range(1, len({found}) + 1), lambda i: {{
    'start': list_sum({before}[1:i]) + coalesce(list_sum({found}[1:i - 1]), 0),
    'kind': {at},
    'end': list_sum({before}[1:i]) + list_sum({found}[1:i]),
    'ok': {value}[i] >= {rule.least}}}), lambda s: s.ok)"""


def _listed_sql(spans: str, rules: tuple[Rule, ...]) -> str:
    names = ", ".join(f"'{r.kind}'" for r in rules)
    return (
        f"array_to_string(list_transform({spans}, lambda s: "
        f"([{names}])[s.kind + 1] || ':' || s.start::bigint || ':' || s.\"end\"::bigint), ',')"
    )


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The digest query as plain SQL: every expression on every text."""
    every = ", ".join(_kind_sql(k, r) for k, r in enumerate(rules))
    numbers = ", ".join(
        f"len(list_filter(spans, lambda s: s.kind = {k}))::bigint as n_{r.kind}"
        for k, r in enumerate(BASE)
    )
    base = _listed_sql(f"list_filter(spans, lambda s: s.kind < {len(BASE)})", rules)
    return f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
found as (select doc_id, list_sort(flatten([{every}])) as spans from texts)
select doc_id, {numbers}, sha256({base}) as base_sha256,
  {_listed_sql('spans', rules)} as spans
from found"""
