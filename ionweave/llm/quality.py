"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features of a text are indicators: its byte trigrams (hashed to 2^17 values)
and bins of how far it repeats itself (equal neighbouring words, repeated words).
Each indicator is scaled by the log ratio of its smoothed frequency in the two
classes, rows are brought to unit length over their indicators, and a linear
hinge-loss model is fitted by dual coordinate descent.  A Platt sigmoid, fitted
on a fifth of the sample that the model did not see, turns margins into scores.

Fitting uses a bounded sample: about ``SAMPLE`` labelled rows of each class, chosen by a
hash of doc_id among the rows whose crc32(doc_id as text) mod 5 is not 0.  Class
shares come from all those labels.  Scoring reads every whole text in one pass without a
shuffle; the model is 2^17 floats.

Cases: null and empty texts have no trigrams and score by the intercept and
repetition bins; rows without doc_id are scored (held_out is null); labels that
are null or other than 0 and 1, or of absent documents, are skipped, and the
smallest of several labels of a document counts; repeated documents are scored
each and learned from once where their indicators are equal; further columns are ignored; without labels of both classes
every score is the share of label 1 (0.5 without any); an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .common import MOST_HASH, in_training, read_table, sample_hash, sample_limit, sized, slices

BITS = 17
HASHED = 1 << BITS
#: Bins of the share of words equal to the word before, and of words seen before.
ECHO = (0.0, 0.02, 0.1, 0.3, 0.6)
AGAIN = (0.2, 0.4, 0.6, 0.8, 0.95)
BIAS = HASHED + len(ECHO) + len(AGAIN)
WIDTH = BIAS + 1
#: Labelled rows per class that the model is fitted on, in expectation.
SAMPLE = 3000
THRESHOLD = 0.3
_CHUNK = 1 << 20
_GAP = re.compile(rb"\s")


def _word_lists(text: bytes):
    """The words of a text, a bounded piece at a time."""
    at = 0
    while at < len(text):
        end = at + _CHUNK
        if end < len(text) and (more := _GAP.search(text, end)):
            end = more.start()
        elif end < len(text):
            end = len(text)
        if words := text[at:end].split():
            yield words
        at = end


class Indicators:
    """Distinct feature ids of a text; keeps one scratch array per worker."""

    def __init__(self):
        self.stamp = np.zeros(HASHED, np.int32)

    def __call__(self, text: bytes | None) -> np.ndarray:
        data = np.frombuffer(text or b"", np.uint8).astype(np.uint32)
        found = np.zeros(0, np.int64)
        for at in range(0, max(0, len(data) - 2), _CHUNK):
            part = data[at : at + _CHUNK + 2]
            key = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
            key = (key * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            place = np.arange(len(key), dtype=np.int32)
            self.stamp[key] = place  # the last write wins, so one place per id passes
            found = np.concatenate([found, key[self.stamp[key] == place].astype(np.int64)])
        if len(data) > _CHUNK:
            found = np.unique(found)
        count, same, seen, last = 0, 0, set(), []
        for words in _word_lists(text or b""):
            same += sum(map(eq, last + words, words if last else words[1:]))
            seen.update(words)
            count, last = count + len(words), words[-1:]
        if count > 1:
            echo, again = same / (count - 1), 1 - len(seen) / count
            bins = [HASHED + i for i, x in enumerate(ECHO) if echo > x]
            bins += [HASHED + len(ECHO) + i for i, x in enumerate(AGAIN) if again > x]
            found = np.concatenate([found, np.array(bins, np.int64)])
        return found


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 15, seed: int = 0) -> np.ndarray:
    """Hinge-loss weights of indicator rows scaled by ``scale`` (dual coordinate descent)."""
    values = [scale[r] / np.sqrt(max(len(r), 1)) for r in rows]
    rows = [np.append(r, BIAS) for r in rows]
    values = [np.append(v, 1.0) for v in values]
    square = np.array([v @ v for v in values])
    alpha, w = np.zeros(len(rows)), np.zeros(WIDTH)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (values[i] @ w[rows[i]]) - 1
            step = min(max(alpha[i] - slope / square[i], 0.0), cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * y[i] * values[i]
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))), by Newton steps on smoothed targets."""
    good, bad = (weight * (y > 0)).sum(), (weight * (y < 0)).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        grad = np.array([g @ margin, g.sum()])
        hess = np.array([[h @ (margin * margin), h @ margin], [h @ margin, h.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


class Model:
    """``weights`` over feature ids (class ratio times support vector weight), and the sigmoid."""

    def __init__(self, weights: np.ndarray | None, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    def margin(self, ids: np.ndarray) -> float:
        if self.weights is None:
            return 0.0
        return float(self.weights[ids].sum(dtype=np.float64) / np.sqrt(max(len(ids), 1)) + self.bias)

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(ids) + self.b, -30, 30))))


def fit(rows: list[np.ndarray], y: np.ndarray, share: float) -> Model:
    """Model of rows with labels y (1 or -1); ``share`` is label 1's share among all labels."""
    if not len(y) or (y == y[0]).all():
        return Model(None, 0.0, 1.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    hold = np.arange(len(y)) % 5 == 0
    if len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
        hold = np.zeros(len(y), bool)
    count = {c: np.ones(WIDTH) for c in (1, -1)}
    for r, c, out in zip(rows, y, hold):
        if not out:
            count[c][r] += 1
    total = {c: max(1, (~hold & (y == c)).sum()) + 2 for c in (1, -1)}
    ratio = np.log(count[1] / total[1]) - np.log(count[-1] / total[-1])
    train = np.flatnonzero(~hold)
    per_class = {c: len(train) / (2 * max(1, (y[train] == c).sum())) for c in (1, -1)}
    w = dual_descent([rows[i] for i in train], y[train], ratio, np.array([per_class[c] for c in y[train]]))
    model = Model((w * ratio).astype(np.float32), float(w[BIAS]), 1.0, 0.0)
    check = np.flatnonzero(hold) if hold.any() else train
    margin = np.array([model.margin(rows[i]) for i in check])
    of = {1: share, -1: 1 - share}
    weight = np.array([len(check) * of[c] / max(1, (y[check] == c).sum()) for c in y[check]])
    model.a, model.b = platt(margin, y[check], weight)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` labelled rows of each class.

    Documents are drawn by id.  Rows that share an id and all indicators count
    once, and where a class still has more rows than ``sample`` allows (an id may
    have many texts), rows are drawn once more, by id and indicators: what reaches
    the driver is bounded by ``sample``, however often an id repeats.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & in_training(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    limit = F.lit(0).cast("long")
    for label, n in counts.items():
        limit = F.when(F.col("quality") == label, F.lit(sample_limit(n, sample)).cast("long")).otherwise(limit)
    chosen, _ = sized(known.where(sample_hash(F.col("doc_id")) <= limit))

    def features(batches):
        ids_of = Indicators()
        for batch in slices(batches):
            ids = pa.array([ids_of(x).astype("<i4").tobytes() for x in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], ["doc_id", "quality", "ids"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(chosen, "doc_id")
    rows = rows.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text").mapInArrow(features, "doc_id long, quality int, ids binary")
    rows = cut(rows.dropDuplicates(["doc_id", "quality", "ids"]))
    drawn = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    few = F.lit(False)
    for label, n in drawn.items():
        most = MOST_HASH if n <= 2 * sample else sample_limit(n, sample)
        few = few | ((F.col("quality") == label) & (F.shiftrightunsigned(F.xxhash64("ids", "doc_id"), 1) <= F.lit(most)))
    got = sorted(rows.where(few).collect(), key=lambda r: (r.doc_id, bytes(r.ids)))
    return fit([np.frombuffer(r.ids, "<i4").astype(np.int64) for r in got], np.array([1 if r.quality else -1 for r in got]), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        ids_of = Indicators()
        for batch in slices(batches):
            scores = pa.array([held.value.score(ids_of(x)) for x in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` that score at least ``threshold``; each row is judged on its own text."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        ids_of = Indicators()
        for batch in slices(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([held.value.score(ids_of(x)) >= threshold for x in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
