"""Secret scans by a trigram inverted index: Boolean trigram queries, merged postings, verified candidates.

All work on texts is done by DataFrame functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import columns, cut, free_names, others, table


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and without overlap; those whose group has fewer characters than least are dropped after.

    The pattern is read by Java's engine at run time and by Python's parser for its trigrams. Ignoring case is meant for ASCII letters.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.ignore_case else self.pattern


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Candidates up to which they are broadcast, at some 30 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
MOST_STRINGS = 64
BLOCK = 512


def _strings(items) -> list[set[str] | None]:
    """For each item of a parsed pattern all the strings that it matches, or None if they are too many."""
    found: list[set[str] | None] = []
    for op, value in items:
        own: set[str] | None = None
        if op is parser.LITERAL:
            own = {chr(value)}
        elif op is parser.IN and all(kind is parser.LITERAL for kind, _ in value):
            own = {chr(code) for _, code in value}
        elif op is parser.SUBPATTERN:
            own = _joined(_strings(value[-1]))
        elif op is parser.BRANCH:
            branches = [_joined(_strings(branch)) for branch in value[1]]
            own = None if None in branches else set().union(*branches)
        elif op is parser.MAX_REPEAT and value[1] == 1 and value[0] == 0:
            inner = _joined(_strings(value[2]))
            own = None if inner is None else inner | {""}
        found.append(own if own is not None and len(own) <= MOST_STRINGS else None)
    return found


def _joined(parts: list[set[str] | None]) -> set[str] | None:
    if None in parts:
        return None
    out = {""}
    for part in parts:
        out = {a + b for a, b in product(out, part)}
        if len(out) > MOST_STRINGS:
            return None
    return out


def trigram_query(rule: Rule) -> list[frozenset[str]]:
    """Sets of lower-case trigrams of which a text with a match has all of at least one; [] if the rule has no mandatory trigrams.

    Each stretch of the pattern that matches few strings gives one alternative a string; the stretch whose weakest
    alternative is longest is taken. An alternative that contains another is left out.
    """
    runs: list[list[set[str]]] = [[]]
    for part in _strings(parser.parse(rule.pattern)):
        if part is None:
            runs.append([])
        else:
            runs[-1].append(part)
    best: list[frozenset[str]] = []
    for run in runs:
        strings = _joined(run) if run else None
        if not strings:
            continue
        sets = {frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in strings}
        least = [s for s in sets if not any(other < s for other in sets)]
        if min(map(len, least)) > (min(map(len, best)) if best else 0):
            best = sorted(least, key=sorted)
    return best


def candidates(docs: DataFrame, rules: Sequence[Rule], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, one boolean a rule): the keys whose texts may have matches of rules with mandatory trigrams.

    The index has posting rows (trigram, key) for the trigrams that some rule's query names, over folded texts. Merging a
    key's postings gives its set of trigrams as bits, on which each rule's alternatives are tested.
    """
    queries = {r.kind: trigram_query(r) for r in rules}
    grams = sorted(set().union(*(g for q in queries.values() for g in q)))
    folded = docs.select(F.col(key).alias("key"), F.lower(text).alias("folded"))
    postings = folded.select("key", F.explode(F.array_compact(F.array(*(F.when(F.contains("folded", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)), F.lit(None).cast("int")))).alias("trigram"))
    words = range(-(-len(grams) // 63))
    bits = postings.groupBy("key").agg(F.lit(True).alias("listed"), *(F.coalesce(F.expr(f"bit_or(CASE WHEN trigram DIV 63 = {w} THEN shiftleft(1L, trigram % 63) END)"), F.lit(0).cast("long")).alias(f"bits{w}") for w in words))

    def has(alternative: frozenset[str]) -> Column:
        masks = [sum(1 << (grams.index(g) % 63) for g in alternative if grams.index(g) // 63 == w) for w in words]
        return reduce(lambda a, b: a & b, (F.col(f"bits{w}").bitwiseAND(F.lit(m).cast("long")) == m for w, m in enumerate(masks) if m))

    flags = [reduce(lambda a, b: a | b, map(has, q)).alias(kind) for kind, q in queries.items() if q]
    if not flags:
        return postings.select("key").limit(0)
    return bits.select("key", *flags).where(reduce(lambda a, b: a | b, (F.col(kind) for kind, q in queries.items() if q)))


def _running(values: Column, start: Column) -> Column:
    """Running sums of a short array."""
    grow = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
    return F.aggregate(values, F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), grow, lambda acc: acc["out"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row; inside a lambda it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column) -> Column:
    """Running sums of an array of longs, block by block, so the work doesn't grow with the square of its length."""
    blocks = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
    part = lambda v, b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
    sums = lambda v: _running(F.transform(blocks(v), lambda b: F.aggregate(part(v, b), F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
    before = lambda v: F.concat(F.array(F.lit(0).cast("long")), sums(v))
    return _let(values, lambda v: _let(before(v), lambda w: F.flatten(F.transform(blocks(v), lambda b: _running(part(v, b), F.element_at(w, b + 1))))))


def matches(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, rank, end, kind) of the rule's matches in the text, in code points, end exclusive."""
    lengths = lambda strings: F.transform(strings, lambda x: F.length(x).cast("long"))
    found = lambda group: lengths(F.regexp_extract_all(text, F.lit(rule.java), F.lit(group)))
    parts = F.struct(found(0).alias("widths"), lengths(F.split(text, rule.java, -1)).alias("between"), *([found(rule.group).alias("counted")] if rule.group else []))

    def spans(p: Column) -> Column:
        ends = running_sums(F.zip_with(F.slice(p["between"], F.lit(1), F.size(p["widths"])), p["widths"], lambda a, b: a + b))
        zipped = F.arrays_zip(ends.alias("end"), p["widths"].alias("width"), p["counted" if rule.group else "widths"].alias("counted"))
        kept = F.filter(zipped, lambda x: x["counted"] >= rule.least)
        return F.transform(kept, lambda x: F.struct((x["end"] - x["width"]).alias("start"), F.lit(order).alias("rank"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")))

    return _let(parts, spans)


def _may_match(rule: Rule) -> str:
    """A pattern that a text with an undropped match of the rule contains, stricter than the rule's where that is safe."""
    plain = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{plain[1]}{{{rule.least}}}" if plain and not rule.group else rule.java


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES, text: str = "text", key: str = "doc_id", keep: Sequence[str] = ("doc_id",), out: str = "spans") -> DataFrame:
    """keep + text + `out`, an array of (start, rank, end, kind) ordered by start and the rules' order, for every row.

    Rules with mandatory trigrams are verified in the index's candidates only, the others in every text. Null and empty
    texts have no spans. Rows of equal or null keys share candidates and are verified one by one. Whole texts are read;
    repeated rows give repeated rows, an empty table an empty one; columns of `keep` may have any names without dots, one named as `out` is replaced.
    """
    keep = others(keep, out, text)
    own, candidate = free_names([*keep, text, out], "__key", "__candidate")
    flags = dict(zip((r.kind for r in rules), free_names([*keep, text, out, own, candidate], *(f"__{r.kind}" for r in rules)), strict=True))
    parts = free_names([*keep, text, out, own, candidate, *flags.values()], *(f"__spans{i}" for i in range(len(rules))))
    rows = docs.select(*columns(keep), F.col(key).alias(own), F.col(text).alias(text))
    queries = {r.kind: trigram_query(r) for r in rules}
    if any(queries.values()):
        found = cut(candidates(docs, rules, text, key).select(F.col("key").alias(candidate), *(F.col(k).alias(flags[k]) for k, q in queries.items() if q)))
        if found.count() <= BROADCAST_ROWS:
            found = F.broadcast(found)
        rows = rows.join(found, F.col(own).eqNullSafe(F.col(candidate)) & F.col(text).isNotNull(), "left")
    nothing = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    whole = F.coalesce(F.col(text), F.lit(""))
    spans = [F.when((F.coalesce(F.col(flags[r.kind]), F.lit(False)) if queries[r.kind] else F.lit(True)) & F.rlike(whole, F.lit(_may_match(r))), matches(whole, r, i)).otherwise(nothing) for i, r in enumerate(rules)]
    rows = rows.withColumns(dict(zip(parts, spans, strict=True)))
    return rows.select(*columns(keep), text, F.array_sort(F.concat(*parts)).alias(out))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with `mark` for each stretch that spans cover; spans ordered by start."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    part = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda acc, x: F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], part(acc["at"], x["start"]), F.lit(mark))).otherwise(acc["out"]).alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], part(acc["at"], F.length(text))))).otherwise(text)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def op2_secret_scans(spark, sf_dir):
    """doc_id, the number of each kind's secrets, base_sha256 and spans of every document; see find_secrets for nulls, long texts, repeats and empty tables."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    kinds = [_count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select("doc_id", *kinds, _listed(F.col("spans")).alias("spans")).select("doc_id", *(f"n_{r.kind}" for r in BASE_RULES), F.sha2("spans", 256).alias("base_sha256"), "spans")


_ASSIGN = """(?i:(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, row, {rank} AS rank, '{kind}' AS kind, list_transform(list_filter(list_transform(range(1, len(hits) + 1), lambda i: {{'e': list_sum(list_transform(parts[1:i], lambda x: length(x))) + list_sum(list_transform(hits[1:i], lambda x: length(x))), 'w': length(hits[i]), 'n': length(counted[i])}}), lambda x: x.n >= {least}), lambda x: {{'s': (x.e - x.w)::BIGINT, 'rank': {rank}, 'e': x.e::BIGINT, 'kind': '{kind}'}}) AS spans
  FROM (SELECT doc_id, row, string_split_regex(t, '{pattern}') AS parts, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS counted FROM texts)"""


ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
found AS ({_spans_sql("assign", 0, _ASSIGN, 2, 6)} UNION ALL {_spans_sql("access", 1, "AKIA[A-Z0-9]{16,}", 0, 20)} UNION ALL {_spans_sql("hex", 2, "[0-9a-f]{24,}", 0, 24)}),
joined AS (SELECT doc_id, row, list_sort(flatten(list(spans))) AS spans FROM found GROUP BY doc_id, row)
SELECT doc_id, len(list_filter(spans, lambda x: x.kind = 'assign'))::BIGINT AS n_assign, len(list_filter(spans, lambda x: x.kind = 'access'))::BIGINT AS n_access, len(list_filter(spans, lambda x: x.kind = 'hex'))::BIGINT AS n_hex, sha256(array_to_string(list_transform(spans, lambda x: x.kind || ':' || x.s || ':' || x.e), ',')) AS base_sha256, array_to_string(list_transform(spans, lambda x: x.kind || ':' || x.s || ':' || x.e), ',') AS spans FROM joined
"""
