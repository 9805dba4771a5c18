"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.common import by_bytes, columns, cut, fold, free_names, labelled_rows, others, table

SIZES = (3, 4, 5, 6)
#: Hash buckets of the n-grams; every one that a labelled text has is weighed.
BUCKETS = 1 << 19
#: Buckets whose weights are used at once.
PART = 1 << 16
#: Labelled documents that a fit reads at most, but for chance.
FIT_ROWS = 40_000
#: Buckets of documents, two bytes each, that the task which fits holds at most, but for chance.
FIT_BUCKETS = 300_000_000
FIT_TASKS = 8
#: A labelled document in so many sets the threshold and not the weights.
CALIBRATES = 4
SMOOTH = 1.0
RIDGE = 1e-2
#: Steps of the fit at most, and the relative gain of the loss below which it ends.
ROUNDS, GAIN = 50, 1e-4
SLICE_BYTES = 4 << 20
#: Buckets of documents that a step of the fit takes at once, about.
SLICE_FEATURES = 1 << 20
MIX, END_MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def grams(text: str | None) -> np.ndarray:
    """Hash buckets of the text's character n-grams, repeats included.

    It is lower-cased, with one space for each run of white space and one at either end.
    """
    codes = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    h, found = codes, []
    for n in range(2, SIZES[-1] + 1):
        if len(codes) < n:
            break
        h = h[:-1] * MIX + codes[n - 1 :]
        if n in SIZES:
            mixed = (h ^ (h >> np.uint32(15))) * END_MIX
            found.append((mixed ^ (mixed >> np.uint32(13))) & np.uint32(BUCKETS - 1))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


class Present:
    """Distinct buckets of a text's n-grams, without sorting: a table keeps each bucket's last place."""

    def __init__(self) -> None:
        self.last = np.zeros(BUCKETS, np.int32)

    def __call__(self, text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
        buckets = grams(text)
        if wanted is not None:
            buckets = buckets[wanted[buckets]]
        places = np.arange(len(buckets), dtype=np.int32)
        self.last[buckets] = places
        return buckets[self.last[buckets] == places]


@dataclass(frozen=True)
class ToxicityModel:
    """weights: of each bucket, 0 for those not weighed; base: the score without any, as a logit; None without both classes.

    converged: whether the fit's loss had stopped falling, by GAIN, when it ended.
    """

    weights: np.ndarray | None
    base: float
    converged: bool = True

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        present, wanted = Present(), self.weights != 0
        logit = np.array([self.base + self.weights[present(t, wanted)].sum(dtype=float) for t in texts])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def minimised(loss_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], v: np.ndarray, rounds: int = ROUNDS, gain: float = GAIN, memory: int = 6) -> tuple[np.ndarray, bool]:
    """Where a convex function is least, by limited-memory quasi-Newton steps from v (Nocedal 1980), halved until the loss falls enough.

    The last `memory` moves are kept, in single precision. Also whether it ended before `rounds`, as a step gained too little.
    """
    loss, gradient = loss_and_gradient(v)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        ahead, shares = gradient.copy(), []
        for step, change in reversed(moves):
            shares.append((step @ ahead) / (change @ step))
            ahead -= shares[-1] * change
        ahead *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 0.01 / max(1e-12, np.abs(gradient).max())
        for (step, change), share in zip(moves, reversed(shares), strict=True):
            ahead += (share - (change @ ahead) / (change @ step)) * step
        length, slope = 1.0, gradient @ ahead
        while True:
            new_loss, new_gradient = loss_and_gradient(v - length * ahead)
            if new_loss <= loss - 1e-4 * length * slope or length < 1e-6:
                break
            length /= 2
        if new_loss >= loss:
            return v, True
        step, change = -length * ahead, new_gradient - gradient
        v, fell, loss, gradient = v + step, loss - new_loss, new_loss, new_gradient
        if step @ change > 1e-14:
            moves = [*moves, (step.astype(np.float32), change.astype(np.float32))][-memory:]
        if fell < gain * abs(loss):
            return v, True
    return v, False


def threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit from which on label 1 is told with the best F1, between the two nearest logits; 0 without rows of both classes."""
    if not 0 < y.sum() < len(y):
        return 0.0
    order = np.argsort(-logits, kind="stable")
    ordered, hits = logits[order], np.cumsum(y[order])
    f1 = np.where(np.append(ordered[1:] < ordered[:-1], True), 2 * hits / (np.arange(1, len(y) + 1) + y.sum()), -1)
    best = int(f1.argmax())
    return float((ordered[best] + ordered[best + 1]) / 2) if best + 1 < len(y) else float(ordered[-1])


class FitRows:
    """Labelled documents' distinct buckets, in slices of some documents; those that calibrate lie apart.

    A bucket has two bytes, its lower 16 bits: a slice keeps its buckets by their higher bits, so that each part of it meets a
    part of the weights that stays in the processor's cache, and how many buckets of each part a document has.
    """

    def __init__(self) -> None:
        self.fitted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.calibrating: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        sizes = np.frombuffer(b"".join(batch.column("sizes").to_pylist()), np.int32).reshape(batch.num_rows, -1)
        y, held = np.array(batch.column("label").to_pylist(), np.int8), np.array(batch.column("calibrates").to_pylist(), bool)
        low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint16)
        for own, slices in ((~held, self.fitted), (held, self.calibrating)):
            part, of, labels = low[np.repeat(own, sizes.sum(axis=1))], sizes[own], y[own]
            starts = np.concatenate([[0], np.cumsum(of.sum(axis=1), dtype=np.int64)])
            ends = np.unique(np.append(np.searchsorted(starts, np.arange(0, starts[-1], SLICE_FEATURES)), [0, len(labels)]))
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                high = np.repeat(np.tile(np.arange(of.shape[1], dtype=np.uint8), j - i), of[i:j].ravel())
                slices.append((part[starts[i] : starts[j]][np.argsort(high, kind="stable")], np.ascontiguousarray(of[i:j].T), labels[i:j]))

    def fit(self) -> ToxicityModel:
        counts, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2)
        for low, sizes, y in self.fitted:
            for k in (0, 1):
                n[k] += (y == k).sum()
                for at, part, own in _parts(low, sizes):
                    counts[k, at] += np.bincount(part[np.repeat(y == k, own)], minlength=PART)
        if not n.all():
            y = np.concatenate([y for *_, y in [*self.fitted, *self.calibrating]] or [np.zeros(1)])
            return ToxicityModel(None, float(y.mean()))
        share = (counts + SMOOTH) / (n + 2 * SMOOTH)[:, None]
        ratio = np.where(counts.any(axis=0), np.log(share[1] / share[0]), 0)
        del counts, share

        def loss_and_gradient(v: np.ndarray) -> tuple[float, np.ndarray]:
            w, loss, gradient = ratio * v[:-1], 0.0, np.zeros(BUCKETS + 1)
            for low, sizes, y in self.fitted:
                logit = _logits(w, v[-1], low, sizes)
                weight = 0.5 / n[y]  # either class counts a half
                error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight
                loss += float(weight @ (np.logaddexp(0, logit) - y * logit))
                for at, part, own in _parts(low, sizes):
                    gradient[at] += np.bincount(part, np.repeat(error, own), minlength=PART)
                gradient[-1] += error.sum()
            gradient[:-1] = gradient[:-1] * ratio + RIDGE * v[:-1]
            return loss + RIDGE / 2 * float(v[:-1] @ v[:-1]), gradient

        v, converged = minimised(loss_and_gradient, np.zeros(BUCKETS + 1))
        weights = (ratio * v[:-1]).astype(np.float32)
        held_out = [(_logits(weights.astype(float), v[-1], low, sizes), y) for low, sizes, y in self.calibrating]
        told = threshold(*(np.concatenate(x) for x in zip(*held_out, strict=True))) if held_out else 0.0
        return ToxicityModel(weights, float(v[-1]) - told, converged)


def _parts(low: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(place among all buckets, a slice's buckets there, how many each document has) by the buckets' higher bits."""
    ends = np.cumsum(sizes.sum(axis=1))
    for high, (end, own) in enumerate(zip(ends, sizes, strict=True)):
        yield slice(high * PART, (high + 1) * PART), low[end - own.sum() : end], own


def _logits(w: np.ndarray, base: float, low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    logit = np.full(sizes.shape[1], base)
    for at, part, own in _parts(low, sizes):
        there = np.flatnonzero(own)
        if len(there):
            logit[there] += np.add.reduceat(w[at][part], (np.cumsum(own) - own)[there])
    return logit


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """A model from the labelled documents, of which it reads about `fit_rows` if there are more.

    Tasks turn the texts into buckets, two bytes each, a table in the checkpoint folder. If these are more than FIT_BUCKETS, a share of
    the documents, told by their texts' hashes, is left. As its rows and bytes are bounded, one task then fits on it: log-count ratios of all buckets, and the ridge logistic weights of these. The driver gets the weights alone. One document
    in CALIBRATES, told by its text's hash, isn't fitted on: there the threshold of best F1 becomes the score 0.5. Null texts, keys
    and labels give no rows; any label but 1 and 0 is an error; of several labels of a key the greatest counts, and a text that is
    there twice counts twice. Without rows of both classes every score is the share of label 1 (0 without rows).
    """
    checked = F.coalesce(F.assert_true(F.col("label").isin(0, 1), F.lit("labels are 0 or 1")).cast("int"), "label")
    calibrates = F.pmod(F.xxhash64("text", F.lit(CALIBRATES)), F.lit(CALIBRATES)) == 0
    rows = labelled_rows(docs, labels, label, text, key, fit_rows).select("text", checked.alias("label"), calibrates.alias("calibrates"), F.pmod(F.xxhash64("text", F.lit("share")), F.lit(1 << 20)).alias("lot")).repartition(FIT_TASKS)

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = Present()
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                found = [np.sort(present(t)) for t in part.column("text").to_pylist()]
                low = [f.astype(np.uint16).tobytes() for f in found]
                sizes = [np.bincount(f >> 16, minlength=BUCKETS >> 16).astype(np.int32).tobytes() for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(low, pa.binary()), pa.array(sizes, pa.binary()), *(part.column(c) for c in ("label", "calibrates", "lot"))], names=["low", "sizes", "label", "calibrates", "lot"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = FitRows()
        for batch in batches:
            for part in by_bytes(batch, "low", SLICE_BYTES):
                rows.add(part)
        model = rows.fit()
        yield pa.RecordBatch.from_arrays([pa.array([None if model.weights is None else model.weights.tobytes()], pa.binary()), pa.array([model.base]), pa.array([model.converged])], names=["weights", "base", "converged"])

    table_of_rows = cut(rows.mapInArrow(feature_rows, "low binary, sizes binary, label int, calibrates boolean, lot long"))
    many = (table_of_rows.agg(F.sum(F.octet_length("low"))).first()[0] or 0) / 2
    if many > FIT_BUCKETS:
        table_of_rows = table_of_rows.where(F.col("lot") < int(FIT_BUCKETS / many * (1 << 20)))
    found = table_of_rows.coalesce(1).mapInArrow(fit, "weights binary, base double, converged boolean").collect()
    if not found:
        return ToxicityModel(None, 0.0)
    return ToxicityModel(None if found[0]["weights"] is None else np.frombuffer(found[0]["weights"], np.float32), found[0]["base"], found[0]["converged"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: Sequence[str] = ("doc_id",), score: str = "score") -> DataFrame:
    """keep + score, from 0 to 1, of every row's whole text; null and empty texts get the model's base.

    Repeated rows give repeated rows, an empty table an empty one; columns other than `keep` and `text` are not read, and those of
    `keep` may have any names without dots; one named as `score` is replaced.
    """
    keep = others(keep, score)
    read = text if text in keep else free_names(keep, "__text")[0]
    rows = docs.select(*columns(keep)) if text in keep else docs.select(*columns(keep), F.col(text).alias(read))
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, read, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(model.scores(part.column(read).to_pylist()), pa.float64())], names=[*keep, score])

    return rows.mapInArrow(run, schema)


def op4_toxicity(spark, sf_dir):
    """doc_id, held_out, score and predicted of every document; see fit_toxicity and score_toxicity for nulls, repeats and empty tables.

    A null doc_id isn't held out and its label isn't known, but it is scored. Other columns are not read.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(fold("doc_id", 5) != 0))
    return score_toxicity(docs, model).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
