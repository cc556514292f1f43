"""Quality classifier: Bradley-Terry ranking from preference pairs, then a threshold at a quantile of scores."""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, lean, text_of
from .labels import MAX_TRAIN, held_out, training_rows

PAIRS = 40_000
L2 = 1e-3
FOLDS, FOLD = 3, 1

_GROUPS = (b"#$%&*^~=+@_\\<>{}[]", b"|", b"!?", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:", b"\n", b" \t", b"\"'()/-")
_GROUP = np.zeros((256, len(_GROUPS) + 1))
for _k, _bytes in enumerate(_GROUPS):
    _GROUP[list(_bytes), _k] = 1
_GROUP[128:, len(_GROUPS)] = 1


def features(text: str) -> np.ndarray:
    """Shares of kinds of characters, words and lines, each plain and as its root; the empty text has all zeros but the first."""
    data = np.frombuffer(text.encode(), np.uint8)
    shares = np.bincount(data, minlength=256) @ _GROUP / max(1, len(data))
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    ratios = np.array([
        *shares,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        text.count("!!") / n,
        min(1.0, len(text) / n / 50),
        min(1.0, len(words) / max(1, len(lines)) / 500),
    ])
    size = np.array([not words, np.log1p(len(words)) / 10])
    return np.concatenate([size, ratios, np.sqrt(ratios)])


class Ranker:
    """score = sigmoid(strength - threshold), where strength is linear in the standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 0):
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.weights, self.threshold = None, 0.0
        if not len(good) or not len(bad):
            return  # nothing to prefer: every text scores a half
        centre, scale = x.mean(0), x.std(0) + 1e-9
        scaled = (x - centre) / scale
        draw = np.random.default_rng(seed)
        d = scaled[draw.choice(good, pairs)] - scaled[draw.choice(bad, pairs)]
        w = np.zeros(x.shape[1])
        for _ in range(30):  # Newton's method on the mean logistic loss of the differences
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            gradient = -(d * p[:, None]).mean(0) + L2 * w
            hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + L2 * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w / scale
        # labels mark a share of rows as bad: the threshold is that quantile of the scores
        self.threshold = float(np.quantile(x @ self.weights, len(bad) / (len(good) + len(bad))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights - self.threshold, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Ranker:
    """Learn from at most about max_train labelled rows; features, not texts, reach the driver."""

    def measure(batches):
        for batch in batches:
            x = [features(t.as_py()).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = training_rows(docs, labels, label_col, FOLDS, FOLD, max_train=max_train, id_col=id_col, text_col=text_col).mapInArrow(lean(measure), "x array<double>, y int").collect()
    rows.sort()  # tasks end in any order
    width = len(features(""))
    return Ranker(np.array([r[0] for r in rows]).reshape(len(rows), width), np.array([r[1] for r in rows]))


def score_quality(docs: DataFrame, model: Ranker, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with out_col, 0 to 1. Null texts are empty; empty texts get the score of their features. Rows are independent."""
    kept = [c for c in docs.columns if c != out_col]
    rows = docs.select(*kept, text_of(text_col).alias(free_name(docs, "_scored")))

    def score(batches):
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            s = model.score(np.array(x)) if x else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64())], names=[*batch.schema.names[:-1], out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return rows.mapInArrow(lean(score), f"{schema}, `{out_col}` double")


def classify_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted (1 if score >= 0.5) of every row of docs."""
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col)
    rows = score_quality(docs.select(F.col(id_col), F.col(text_col).alias("_t")), model, text_col="_t")
    return rows.select(id_col, held_out(id_col, FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their columns."""
    name = free_name(docs, "_score")
    return score_quality(docs, fit_quality(docs, labels), out_col=name).filter(F.col(name) >= 0.5).drop(name)
