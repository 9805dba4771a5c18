"""Ranked lexical search over an index of two levels: impacts in bytes, rounded up, bound a score; exact counts settle it."""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vecloom.llm.common import by_bytes, cut, remove_folder, shared_folder, table

TOP = 10
#: Documents of a block, whose postings lie together, and bytes of their texts; a longer text is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 2048, 8 << 20
#: Impacts are under 1,000,000; so many of them are one step of a byte.
STEP = 3922
#: Items, and bytes of their texts, that one pass over the index answers, but for chance; a longer item has a pass with few others.
ITEMS, ITEM_BYTES = 512, 1 << 20
#: Terms whose bytes are laid out at once for all documents of a block.
SLAB = 1024
#: Digits, letters and bytes of what isn't ASCII stay, A to Z as a to z; all others part terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_lists(text: str | None) -> Iterator[list[bytes]]:
    """The text's terms in lists of some 8 MB of it: stretches of digits, letters and all that isn't ASCII, A to Z lower-cased, as UTF-8."""
    folded, start = (text or "").encode().translate(FOLD), 0
    while start < len(folded):
        end = folded.find(b" ", start + BLOCK_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def corpus_totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms they have, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [sum(map(len, term_lists(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in counts)], pa.int64()), pa.array([sum(counts)], pa.int64())], names=["docs", "terms"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's share in a score before its weight, by its occurrences and the document's length."""
    m = 10 + (90 * n_docs * n) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _narrow(x: np.ndarray) -> bytes:
    """Counts in one or four bytes each, which the first byte tells."""
    width = 1 if x.max(initial=0) < 256 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


@dataclass(frozen=True)
class LexicalIndex:
    """blocks of an index in a folder, and the totals that its bytes are made with."""

    blocks: DataFrame
    n_docs: int
    n_terms: int

    @classmethod
    def build(cls, docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> LexicalIndex:
        """Indexes every document's whole text in a new folder that all machines share.

        A row is a block of documents with the postings of all its terms, a term's together: of each posting the document's place in
        the block and its impact as a byte, rounded up (the first level), and how often the term occurs (the second); of each
        document its key and length. So no term, however common, is in one place, and texts aren't shuffled. Documents without
        terms, null and empty texts among them, aren't in it; rows that are there twice are two documents. Keys are whole
        numbers or null; others fail. Texts are read twice: for the totals, then for the postings.
        """
        n_docs, n_terms = corpus_totals(docs, text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in by_bytes(batch, "text", BLOCK_BYTES):
                    for start in range(0, part.num_rows, BLOCK_DOCS):
                        block = _block(part.slice(start, BLOCK_DOCS), n_docs, n_terms)
                        if block is not None:
                            yield block

        rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
        rows.mapInArrow(run, "terms binary, sizes binary, places binary, levels binary, tfs binary, lengths binary, keys array<long>").write.parquet(f"{path}/blocks")
        docs.sparkSession.createDataFrame([(n_docs, n_terms)], "docs long, terms long").coalesce(1).write.parquet(f"{path}/totals")
        return cls.open(docs.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LexicalIndex:
        totals = spark.read.parquet(f"{path}/totals").first()
        return cls(spark.read.parquet(f"{path}/blocks"), totals["docs"], totals["terms"])

    def search(self, items: DataFrame, k: int = TOP, text: str = "text", key: str = "item_id") -> DataFrame:
        """(key, rank, doc_id, score): of each item the k documents of highest score above 0, equal scores by doc_id, null last.

        Items are answered in passes of about ITEMS of them. A first scan of the index finds in how many documents each of their terms
        is; a second, of the first level alone, the k-th highest lower bound of each item's scores, as bytes less one step bound
        them from below; a third scores exactly, in whole numbers, every document whose upper bound reaches that. Each
        task hands on k rows an item at most. Items without terms, or whose terms no document has, have no rows; an item that is there
        twice, with the same text, is answered once, and under one key with different texts twice. An index without documents gives no rows.
        """
        asked = items.select(F.col(key).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
        size = asked.agg(F.count("*").alias("items"), F.sum(F.octet_length("text")).alias("bytes")).first()
        passes = max(1, -(-size["items"] // ITEMS), -(-(size["bytes"] or 0) // ITEM_BYTES))
        found = [self._answer(asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == i).sort("item", "text").collect(), asked.schema["item"], k) for i in range(passes)]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out.withColumnRenamed("item", key)

    def _answer(self, items: list, item_field: T.StructField, k: int) -> DataFrame:
        lists = [sorted({t for part in term_lists(r["text"]) for t in part}) for r in items]
        numbers = {t: i for i, t in enumerate(sorted(set().union(*lists)))}
        df = np.zeros(len(numbers), np.int64)
        for r in self.blocks.select("terms", "sizes").mapInArrow(_document_counts(numbers), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r["term"]] = r["df"]
        weights = np.array([weight(x, self.n_docs) if x else 0 for x in df.tolist()], np.int64)
        own = [np.array([numbers[t] for t in terms], np.int64) for terms in lists]
        queries = _Queries(numbers, own, weights)
        best = W.partitionBy("number").orderBy(F.desc("lower"))
        lower = self.blocks.select("terms", "sizes", "places", "levels", F.octet_length("lengths").alias("width")).mapInArrow(_lower_bounds(queries, k), "number int, lower long")
        lower = lower.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
        bounds = np.zeros(len(items), np.int64)
        for r in lower.groupBy("number").agg(F.min("lower").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k).collect():
            bounds[r["number"]] = r["bound"]
        schema = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("item", item_field.dataType), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
        scored = self.blocks.mapInArrow(_exact_scores(queries, bounds, [r["item"] for r in items], k, self.n_docs, self.n_terms, schema), schema)
        order = W.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return cut(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score"))


def _block(part: pa.RecordBatch, n_docs: int, n_terms: int) -> pa.RecordBatch | None:
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    term, n = [], []
    for t in part.column("text").to_pylist():
        own = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in term_lists(t)]
        term += own
        n.append(sum(map(len, own)))
    n = np.array(n, np.int64)
    have = np.flatnonzero(n)
    if not len(have):
        return None
    n = n[have]
    code, tf = np.unique(np.concatenate(term) * len(have) + np.repeat(np.arange(len(have)), n), return_counts=True)
    place = code % len(have)
    levels = -(-impacts(tf, n[place], n_docs, n_terms) // STEP)
    binary = lambda x: pa.array([x], pa.binary())
    return pa.RecordBatch.from_arrays(
        [binary(b" ".join(numbers)), binary(np.bincount(code // len(have)).astype("<u2").tobytes()), binary(place.astype("<u2").tobytes()), binary(levels.astype(np.uint8).tobytes()), binary(_narrow(tf)), binary(n.astype("<u4").tobytes()), pa.array([part.column("key").take(pa.array(have)).to_pylist()], pa.list_(pa.int64()))],
        names=["terms", "sizes", "places", "levels", "tfs", "lengths", "keys"],
    )


class _Queries:
    """The items' terms by number, and for each term the items that have it."""

    def __init__(self, numbers: dict[bytes, int], own: list[np.ndarray], weights: np.ndarray):
        self.numbers, self.own, self.weights = numbers, own, weights
        term, item = np.concatenate([*own, np.empty(0, np.int64)]), np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.argsort(term, kind="stable")
        self.items, self.begin = item[order], np.searchsorted(term[order], np.arange(len(numbers) + 1))

    def postings(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Which of a block's postings are of the items' terms, and these terms' numbers."""
        sizes = np.frombuffer(row["sizes"], "<u2").astype(np.int64)
        number = np.fromiter((self.numbers.get(t, -1) for t in row["terms"].split(b" ")), np.int64, len(sizes))
        of = np.repeat(number, sizes)
        at = np.flatnonzero(of >= 0)
        return at, of[at]

    def sums(self, of: np.ndarray, place: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """For each item and document the sum of weight * value over the item's terms; whole numbers, exact as doubles up to 2^53."""
        out = np.zeros((len(self.own), docs))
        present, row = np.unique(of, return_inverse=True)
        for low in range(0, len(present), SLAB):
            slab = present[low : low + SLAB]
            here = (row >= low) & (row < low + SLAB)
            x = np.zeros((len(slab), docs))
            x[row[here] - low, place[here]] = value[here]
            many = self.begin[slab + 1] - self.begin[slab]
            term = np.repeat(np.arange(len(slab)), many)
            item = self.items[np.arange(many.sum()) + np.repeat(self.begin[slab] - (np.cumsum(many) - many), many)]
            w = np.zeros((len(self.own), len(slab)))
            w[item, term] = self.weights[slab][term]
            out += w @ x
        return out


def _document_counts(numbers: dict[bytes, int]):
    """For a partition's blocks: in how many of their documents each of the numbered terms is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(numbers), np.int64)
        for batch in batches:
            for names, sizes in zip(batch.column("terms").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                for t, n in zip(names.split(b" "), np.frombuffer(sizes, "<u2").tolist(), strict=True):
                    if t in numbers:
                        df[numbers[t]] += n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], names=["term", "df"])

    return run


def _lower_bounds(queries: _Queries, k: int):
    """For a partition's blocks: each item's k highest lower bounds above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(queries.own), k))
        for batch in batches:
            for row in batch.to_pylist():
                at, of = queries.postings(row)
                if not len(at):
                    continue
                level = np.frombuffer(row["levels"], np.uint8)[at].astype(np.int64)
                found = STEP * queries.sums(of, np.frombuffer(row["places"], "<u2")[at], np.maximum(level - 1, 0), row["width"] // 4)
                both = np.hstack([best, found])
                best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        item, place = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(best[item, place].astype(np.int64))], names=["number", "lower"])

    return run


def _exact_scores(queries: _Queries, bounds: np.ndarray, ids: list, k: int, n_docs: int, n_terms: int, schema: T.StructType):
    """For a partition's blocks: of the documents whose upper bound is above 0 and reaches the item's, the k best by exact score."""
    types = [to_arrow_type(field.dataType) for field in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int]]] = [[] for _ in ids]
        for batch in batches:
            for row in batch.to_pylist():
                at, of = queries.postings(row)
                if not len(at):
                    continue
                n, place = np.frombuffer(row["lengths"], "<u4").astype(np.int64), np.frombuffer(row["places"], "<u2")[at]
                upper = STEP * queries.sums(of, place, np.frombuffer(row["levels"], np.uint8)[at].astype(np.int64), len(n))
                item, doc = np.nonzero((upper >= bounds[:, None]) & (upper > 0))
                if not len(item):
                    continue
                wanted = np.zeros(len(n), bool)
                wanted[doc] = True
                kept = wanted[place]
                exact = impacts(_wide(row["tfs"])[at[kept]], n[place[kept]], n_docs, n_terms)
                order = np.lexsort((place[kept], of[kept]))
                of, place, exact = of[kept][order], place[kept][order], exact[order]
                begins = np.searchsorted(of, np.arange(len(queries.numbers) + 1))
                for i, docs in zip(*_runs(item, doc), strict=True):
                    scores = np.zeros(len(n), np.int64)
                    for t in queries.own[i].tolist():
                        scores[place[begins[t] : begins[t + 1]]] += queries.weights[t] * exact[begins[t] : begins[t + 1]]
                    own = [(-score, row["keys"][d] is None, row["keys"][d] or 0) for d, score in zip(docs.tolist(), scores[docs].tolist(), strict=True) if score > 0]
                    best[i] = sorted(best[i] + own)[:k]
        flat = [(i, ids[i], None if no_key else key, -score) for i, own in enumerate(best) for score, no_key, key in own]
        columns = list(zip(*flat, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return run


def _runs(item: np.ndarray, doc: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Ascending items, and the documents of each."""
    cuts = np.flatnonzero(np.diff(item)) + 1
    return item[np.concatenate([[0], cuts])].tolist(), np.split(doc, cuts)


def op13_lexical_search(spark, sf_dir):
    """item_id, rank, doc_id and score of each benchmark item's ten best documents; see LexicalIndex.build and search for all cases.

    The index is made in the shared checkpoint folder and removed once the few result rows are written there.
    """
    path = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    found = cut(LexicalIndex.build(table(spark, sf_dir, "documents"), path).search(table(spark, sf_dir, "benchmark")))
    remove_folder(spark, path)
    return found


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
words AS (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs),
postings AS (SELECT row, doc_id, n, term, count(*) AS tf FROM words GROUP BY row, doc_id, n, term),
totals AS (SELECT count(*) FILTER (len(terms) > 0) AS big_n, sum(len(terms))::BIGINT AS big_l FROM docs),
dfs AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term),
wanted AS (SELECT DISTINCT item_id, text, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
scores AS (SELECT item_id, text, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM wanted JOIN postings USING (term) JOIN dfs USING (term), totals GROUP BY item_id, text, row, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
