"""How filters overlap: a histogram of failure masks, from which every order of the filters is counted.

All work on texts is done by DataFrame functions.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import cut, join_counted, table

#: The filters; a text's mask has bit i where it fails the i-th.
FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SPACE = r"[\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D, which look at a text alone, not null.

    A: under LEAST_WORDS words; B: less than LEAST_DISTINCT percent of them distinct; C: more than MOST_CAPITALS percent of the
    code points are A to Z; D: it holds one of MARKS. Words are stretches of other than ASCII white space.
    """
    words = F.array_remove(F.split(text, SPACE, -1), "")
    counts = F.struct(F.size(words).cast("long").alias("words"), F.size(F.array_distinct(words)).cast("long").alias("distinct"))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = lambda c: (
        c["words"] < LEAST_WORDS,
        100 * c["distinct"] < LEAST_DISTINCT * c["words"],
        100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        F.rlike(text, F.lit(MARKS)),
    )
    # the counts are an element of an array, so they are computed once a row
    return F.element_at(F.transform(F.array(counts), lambda c: sum(F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails(c)))), 1)


def mask_histogram(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail, and how many of them have quality 1 and toxic 1.

    Whole texts become masks and SHA-256 digests in one scan, written once; the smallest key of each digest that is there twice,
    found before the shuffle, meets its rows by join_counted, so a text that very many rows share isn't gathered. A row fails E
    if a row with a smaller key has the same text, whatever its part; rows with null keys never do, nor do they
    make others fail. A null text is an empty one, a null part the part ''. Of several labels of a key the greatest counts; null
    keys have none.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(key).alias("key"), F.unhex(F.sha2(whole, 256)).alias("digest"), text_mask(whole).alias("mask")))
    first = rows.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max("quality").eqNullSafe(1).cast("int").alias("good"), F.max("toxic").eqNullSafe(1).cast("int").alias("toxic"))
    marked = join_counted(rows, first, "digest", "rows", how="left").select("part", "key", F.when(F.col("key") > F.col("first"), F.col("mask") + REPEATED).otherwise(F.col("mask")).alias("mask"))
    marked = cut(marked.groupBy("part", "key", "mask").agg(F.count("*").alias("n")))
    none = F.lit(0).cast("long")
    labelled = marked.join(known, "key").select("part", "mask", none.alias("n"), (F.col("good") * F.col("n")).alias("good"), (F.col("toxic") * F.col("n")).alias("toxic"))
    every = marked.select("part", "mask", "n", none.alias("good"), none.alias("toxic")).unionByName(labelled)
    return every.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part and order of the filters a row a step, from a part's cells (part, mask, n, good, toxic), zeros included.

    kept: rows that fail no filter up to here; removed: those that fail this one and none before; redundant: those that fail it and one
    before; unique_fails: those that fail it alone; good_lost, toxic_lost: of the removed; shapley: removed, summed over all orders. A
    part's cells, 32 at most for five filters, are one row, which all orders read. Without cells there are no rows.
    """
    orders = ["".join(p) for p in permutations(filters)]
    bit = {f: 1 << i for i, f in enumerate(filters)}
    steps = [(order, i + 1, bit[f], sum(bit[x] for x in order[:i])) for order in orders for i, f in enumerate(order)]
    listed = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{i},"own":{own},"before":{before}}}' for o, i, own, before in steps) + "]"), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = parts.select("part", "cells", F.explode(listed).alias("at")).select("part", "cells", "at.*")
    hits = lambda x, bits: x["mask"].bitwiseAND(F.col(bits)) != 0

    def total(which, value=lambda x: x["n"]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, x: s + F.when(which(x), value(x)).otherwise(0))

    removed = lambda x: hits(x, "own") & ~hits(x, "before")
    # a row that fails s filters is removed by each of them in one order of s
    share = lambda x: x["n"] * F.element_at(F.array(*(F.lit(len(orders) // s) for s in range(1, len(filters) + 1))), F.bit_count(x["mask"]))
    counts = {
        "kept": total(lambda x: ~hits(x, "own") & ~hits(x, "before")),
        "removed": total(removed),
        "redundant": total(lambda x: hits(x, "own") & hits(x, "before")),
        "unique_fails": total(lambda x: x["mask"] == F.col("own")),
        "good_lost": total(removed, lambda x: x["good"]),
        "toxic_lost": total(removed, lambda x: x["toxic"]),
        "shapley": total(lambda x: hits(x, "own"), share),
    }
    return rows.select("part", "filter_order", "step", *(c.alias(name) for name, c in counts.items()))


def op12_filter_audit(spark, sf_dir):
    """part, filter_order, step and seven counts of the filters A to E over all documents; see mask_histogram for nulls, repeats and empty tables.

    An empty text fails A alone, unless a smaller doc_id has one too; texts of any length are read whole; other columns are not read.
    """
    return audit(mask_histogram(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def _oracle_sql() -> str:
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    bit = lambda c: f"(1 << (strpos('{FILTERS}', {c}) - 1))"
    before = " + ".join(f"CASE WHEN strpos(filter_order, '{f}') < step THEN {b} ELSE 0 END" for f, b in bits.items())
    return f"""
WITH texts AS (SELECT doc_id, coalesce(CAST(lang AS VARCHAR), '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
known AS (SELECT doc_id, coalesce(max(quality) = 1, false) AS good, coalesce(max(toxic) = 1, false) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < {LEAST_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '{MARKS}') THEN 8 ELSE 0 END + CASE WHEN texts.doc_id > first THEN {REPEATED} ELSE 0 END AS mask
  FROM texts JOIN firsts USING (t) LEFT JOIN known ON known.doc_id = texts.doc_id),
steps AS (SELECT filter_order, step::INT AS step, {bit("substr(filter_order, step::INT, 1)")} AS own, {before} AS earlier FROM (VALUES {orders}) o(filter_order), range(1, {len(FILTERS) + 1}) s(step)),
found AS (SELECT part, filter_order, step, own, count(*) FILTER (mask & (own | earlier) = 0) AS kept, count(*) FILTER (mask & own > 0 AND mask & earlier = 0) AS removed,
  count(*) FILTER (mask & own > 0 AND mask & earlier > 0) AS redundant, count(*) FILTER (mask = own) AS unique_fails,
  count(*) FILTER (mask & own > 0 AND mask & earlier = 0 AND good) AS good_lost, count(*) FILTER (mask & own > 0 AND mask & earlier = 0 AND toxic) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM found
"""


ORACLE_SQL = _oracle_sql()
