"""Quality: ridge scores on random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

import operator
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.common import by_bytes, columns, cut, fold, free_names, others, table

#: Labelled documents that a fit reads at most, but for chance.
FIT_ROWS = 60_000
FIT_TASKS = 8
FEATURES = 384
RIDGE = 1e-3
SEED = 20240
BINS = 4096
SLICE_BYTES = 4 << 20
UPPER, LOWER, LETTER, DIGIT, SPACE, LINE, MARK, SYMBOL = range(8)
STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "upper", "digits", "spaces", "lines", "marks", "symbols",
    "distinct_words", "repeated_neighbours", "commonest_word", "capitals_only", "wordless", "distinct_lines", "log_line", "longest_word",
)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    by_category = {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Po": MARK, "Pd": MARK, "Ps": MARK, "Pe": MARK, "Pi": MARK, "Pf": MARK, "Zs": SPACE, "Zl": LINE, "Zp": LINE, "Cc": SPACE}
    out = np.full(0x110000, SYMBOL, np.uint8)
    for code in range(0x110000):
        category = unicodedata.category(chr(code))
        out[code] = by_category.get(category, LETTER if category[0] in "LM" else SYMBOL)
    out[10] = LINE
    return out


def statistics(text: str | None) -> list[float]:
    """The document's STATISTICS; all 0 for null and empty texts and those of white space."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATISTICS)
    n_chars, n_words = len(text), len(words)
    kinds = np.bincount(_classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=8)
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    counts = Counter(words)
    letters = max(1, int(kinds[UPPER] + kinds[LOWER] + kinds[LETTER]))
    lines = [line for line in text.split("\n") if line]
    return [
        float(np.log1p(n_chars)), float(np.log1p(n_words)), float(np.minimum(lengths, 40).mean()), float(np.minimum(lengths, 40).std()), kinds[UPPER] / letters, kinds[DIGIT] / n_chars, kinds[SPACE] / n_chars, kinds[LINE] / n_chars, kinds[MARK] / n_chars, kinds[SYMBOL] / n_chars,
        len(counts) / n_words, sum(map(operator.eq, words, words[1:])) / n_words, max(counts.values()) / n_words, sum(map(str.isupper, words)) / n_words, 1 - sum(map(str.isalpha, words)) / n_words, len(set(lines)) / max(1, len(lines)), float(np.log1p(n_chars / max(1, len(lines)))), float(np.log1p(lengths.max())),
    ]


def document_statistics(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep + statistics, an array of doubles, from every row's whole text.

    Null and empty texts and those of white space have zeros. Repeated rows give repeated rows, an empty table an empty one. Columns
    other than `keep` and `text` are not read, and those of `keep` may have any names without dots; one named statistics is replaced.
    """
    keep = others(keep, "statistics")
    read = free_names(keep, "__text")[0]
    rows = docs.select(*columns(keep), F.col(text).alias(read))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("statistics", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, read, SLICE_BYTES):
                found = [statistics(t) for t in part.column(read).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(found, pa.list_(pa.float64()))], names=[*keep, "statistics"])

    return rows.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS)) if len(column) else np.empty((0, len(STATISTICS)))


@dataclass(frozen=True)
class QualityModel:
    """cos(standardised statistics @ directions + phases) @ weights, then a monotone broken line; without `weights` always `base`."""

    base: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    directions: np.ndarray | None = None
    phases: np.ndarray | None = None
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of a Gaussian kernel, and a constant."""
        z = np.cos((np.clip((x - self.mean) / self.scale, -8, 8)) @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.knots is None:
            return np.full(len(x), self.base)
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def isotonic(at: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone line through the pooled shares of hits; at: ascending places with n cases each."""
    blocks: list[list[float]] = []
    for x, k, h in zip(at.tolist(), n.tolist(), hits.tolist(), strict=True):
        blocks.append([x * k, k, h])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    x, k, h = np.array(blocks).T
    return x / k, h / k


def fit_quality(stats: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", fit_rows: int = FIT_ROWS, features: int = FEATURES, ridge: float = RIDGE) -> QualityModel:
    """A model from (key, statistics) rows and labels, of which it reads about `fit_rows` if there are more.

    Each task of FIT_TASKS sums its part of the normal equations, so the driver adds a few matrices of fixed
    size. Two thirds of the rows fit the ridge, a third, told apart by the key's hash, the calibration, over
    BINS bins of the score. Null keys and labels give no rows; any label but 1 and 0 is an error; of several labels of a key the greatest
    counts, and a document that is there twice counts twice. Without rows of both classes every score is the share of label 1 (1
    without rows).
    """
    checked = F.coalesce(F.assert_true(F.col(label).isNull() | F.col(label).isin(0, 1), F.lit("labels are 0 or 1")).cast("int"), F.col(label))
    known = labels.select(key, checked.alias(label)).where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    share = min(1.0, fit_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = cut(stats.select(F.col(key).alias("key"), "statistics").join(F.broadcast(chosen), "key").withColumn("calibrates", F.pmod(F.hash("key", F.lit(SEED)), F.lit(3)) == 0).repartition(FIT_TASKS))
    totals = rows.groupBy("calibrates", "label").count().collect()
    n1, n = sum(r["count"] for r in totals if r["label"] == 1), sum(r["count"] for r in totals)
    if len(totals) < 4:
        return QualityModel(n1 / n if n else 1.0)

    fit = rows.where(~F.col("calibrates"))
    moments = fit.select(*(F.struct(F.avg(c := F.col("statistics")[i]).alias("mean"), F.stddev_pop(c).alias("sd")).alias(f"s{i}") for i in range(len(STATISTICS)))).first()
    mean, scale = np.array([m["mean"] for m in moments]), np.array([m["sd"] or 1.0 for m in moments])
    rng = np.random.default_rng(SEED)
    directions, phases = rng.normal(size=(len(STATISTICS), features)) / np.sqrt(len(STATISTICS)) * 1.5, rng.uniform(0, 2 * np.pi, features)
    blank = QualityModel(n1 / n, mean, scale, directions, phases)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            z = blank.features(_matrix(batch.column("statistics")))
            a += z.T @ z
            b += z.T @ batch.column("label").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["a", "b"])

    parts = fit.select("statistics", "label").mapInArrow(sums, "a binary, b binary").collect()
    a = np.sum([np.frombuffer(p["a"]).reshape(features + 1, -1) for p in parts], axis=0)
    b = np.sum([np.frombuffer(p["b"]) for p in parts], axis=0)
    penalty = np.full(features + 1, ridge * a[-1, -1] / features)
    penalty[-1] = 0
    model = QualityModel(n1 / n, mean, scale, directions, phases, np.linalg.solve(a + np.diag(penalty), b))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(model.raw(_matrix(batch.column("statistics"))), -1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.rint((raw + 1) / 3 * BINS).astype(np.int32)), batch.column("label")], names=["bin", "label"])

    bins = rows.where("calibrates").select("statistics", "label").mapInArrow(place, "bin int, label int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("hits")).orderBy("bin").collect()
    knots = isotonic(*(np.array([float(r[c]) for r in bins]) for c in ("bin", "n", "hits")))
    return QualityModel(n1 / n, mean, scale, directions, phases, model.weights, (knots[0] / BINS * 3 - 1, knots[1]))


def score_quality(stats: DataFrame, model: QualityModel, keep: Sequence[str] = ("doc_id",), score: str = "score") -> DataFrame:
    """keep + score, from 0 to 1, of every row of statistics.

    Repeated rows give repeated rows, an empty table an empty one; columns of `keep` may have any names without dots, one named as `score` is replaced.
    """
    keep = others(keep, score)
    read = free_names(keep, "__statistics")[0]
    rows = stats.select(*columns(keep), F.col("statistics").alias(read))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(model.scores(_matrix(batch.column(read))), pa.float64())], names=[*keep, score])

    return rows.mapInArrow(run, schema)


def score_texts(docs: DataFrame, model: QualityModel, text: str = "text", keep: Sequence[str] = ("doc_id",), score: str = "score") -> DataFrame:
    """As score_quality, of rows with texts, whose statistics are computed on the way; see document_statistics for null and empty ones."""
    keep = others(keep, score)
    read = text if text in keep else free_names(keep, "__text")[0]
    rows = docs.select(*columns(keep)) if text in keep else docs.select(*columns(keep), F.col(text).alias(read))
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, read, SLICE_BYTES):
                x = np.array([statistics(t) for t in part.column(read).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(model.scores(x), pa.float64())], names=[*keep, score])

    return rows.mapInArrow(run, schema)


def op3_quality(spark, sf_dir):
    """doc_id, held_out, score and predicted of every document; see document_statistics, fit_quality and score_quality for nulls, repeats and empty tables.

    A null doc_id isn't held out and its label isn't known, but it is scored. Other columns are not read.
    """
    stats = cut(document_statistics(table(spark, sf_dir, "documents")))
    model = fit_quality(stats, table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    return score_quality(stats, model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
