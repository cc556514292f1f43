"""Toxicity: a logistic classifier over words and word beginnings, regularised by counterfactual identity terms.

Every labelled sentence has a counterfactual: the identity terms that it names are swapped for others. Where it names
none, one is put in, and that text, the same with the term swapped, and the sentence as it was should score alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_of
from .labels import MAX_TRAIN, held_out, training_rows

FOLDS, FOLD = 4, 2
WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6, 7, 8)
MAX_FEATURES = 2_000
LEAST_TEXTS = 4
CACHE_WORDS = 200_000
L2 = 1.0
#: Weight of the squared change of a score when identity terms are swapped.
COUNTERFACTUAL = 10.0
#: Terms that name groups; terms of one row stand for each other. A parameter of fit_toxicity.
IDENTITY_TERMS = (
    ("women", "men", "woman", "man", "female", "male", "girls", "boys", "transgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslim", "christian", "jewish", "hindu", "catholic"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indian"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"),
    ("immigrants", "refugees", "natives", "foreigners", "elderly", "young", "disabled", "deaf", "blind"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("frauen", "männer", "muslime", "christen", "juden", "einwanderer"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)


def words_of(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def names_of(word: str) -> list[str]:
    """A word's features: itself, and its beginnings, which inflected forms share."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) >= k)]


def swap(words: Counter, terms=IDENTITY_TERMS) -> Counter | None:
    """The counterfactual text, each identity term replaced by the next of its row; None if there is none."""
    after = {t: row[(i + 1) % len(row)] for row in terms for i, t in enumerate(row)}
    found = [w for w in words if w in after]
    if not found:
        return None
    other = Counter({w: n for w, n in words.items() if w not in after})
    for w in found:
        other[after[w]] += words[w]
    return other


def counterfactuals(text: str, words: Counter, terms=IDENTITY_TERMS) -> list[tuple[Counter, Counter]]:
    """Pairs of texts whose scores should not differ: identity terms and their swap, put in where the text has none."""
    swapped = swap(words, terms)
    if swapped:
        return [(words, swapped)]
    row = terms[zlib.crc32(text.encode()) % len(terms)]
    term = row[zlib.crc32(text.encode(), 1) % len(row)]
    mention = words + Counter([term])
    return [(mention, swap(mention, terms)), (mention, words)]


class Lexicon(dict):
    """word -> the indices of its features among those selected; memory is bounded by starting anew."""

    def __init__(self, names: list[str]):
        super().__init__()
        self.index = {x: i for i, x in enumerate(names)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(i for x in names_of(word) if (i := self.index.get(x)) is not None)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found
        return found

    def counts(self, words: Counter) -> dict[int, int]:
        out: dict[int, int] = {}
        for word, n in words.items():
            for i in self[word]:
                out[i] = out.get(i, 0) + n
        return out


class Model:
    """score = sigmoid(bias + sum of weight * log(1 + count))."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float, pairs: int = 0):
        self.names, self.weights, self.bias = names, weights.tolist(), bias
        #: Counterfactual pairs that the fit used.
        self.pairs = pairs

    def scorer(self):
        lexicon, weights, bias = Lexicon(self.names), self.weights, self.bias

        def score(text: str) -> float:
            x = bias + sum(weights[i] * math.log1p(n) for i, n in lexicon.counts(words_of(text)).items())
            return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))

        return score


def _matrix(rows: list[dict[int, int]], n: int) -> np.ndarray:
    """Rows of log counts, and a last column of ones for the bias."""
    x = np.zeros((len(rows), n + 1))
    x[:, n] = 1
    for r, row in enumerate(rows):
        x[r, list(row)] = np.log1p(list(row.values()))
    return x


def solve(x: np.ndarray, y: np.ndarray, changes: np.ndarray, l2: float, weight: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Minimise the logistic loss, l2 |w|^2 / 2 and weight w' changes w / 2 by accelerated gradient steps.

    x ends in a column of ones; changes is the sum of the outer products of the pairs' differences, in the first columns.
    """
    few = len(changes)
    keep = np.append(np.full(x.shape[1] - 1, l2), 1e-6)

    def largest(times) -> float:  # the largest eigenvalue by power iteration
        v = np.random.default_rng(0).normal(size=x.shape[1])
        for _ in range(30):
            u = times(v)
            v = u / (np.linalg.norm(u) + 1e-12)
        return float(v @ times(v))

    rate = 1 / (1.05 * (largest(lambda v: x.T @ (x @ v)) / 4 + weight * largest(lambda v: np.append(changes @ v[:few], np.zeros(len(v) - few)))) + l2)
    w = v = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        gradient = x.T @ (p - y) + keep * v
        gradient[:few] += weight * (changes @ v[:few])
        new = v - rate * gradient
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (last - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", max_train: int = MAX_TRAIN, identity_terms=IDENTITY_TERMS, counterfactual: float = COUNTERFACTUAL, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from at most about max_train labelled rows.

    Features are chosen by how far their share of toxic texts is from the mean, counted by the executors; at most
    MAX_FEATURES names and the chosen features of the training rows reach the driver. The features of identity_terms
    are among them whether or not a training text names one, since counterfactuals do. With one class only, every
    text scores that class's share.
    """
    rows = training_rows(docs, labels, label_col, FOLDS, FOLD, max_train=max_train, id_col=id_col, text_col=text_col)
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("_label")).first()
    toxic = toxic or 0
    if not toxic or toxic == n:
        share = (toxic + 0.5) / (n + 1)
        return Model([], np.zeros(0), math.log(share / (1 - share)))

    def count(batches):
        for batch in batches:
            every, bad = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names = {x for w in words_of(text) for x in names_of(w)}
                every.update(names)
                if label:
                    bad.update(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([bad[x] for x in every], pa.int64())], names=["name", "n", "bad"])

    counts = rows.mapInArrow(count, "name string, n long, bad long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter(F.col("n") >= LEAST_TEXTS)
    expected = F.col("n") * F.lit(toxic / n)
    z = F.abs((F.col("bad") - expected) / F.sqrt(expected * (1 - F.col("n") / n) + 1))
    names = [r[0] for r in counts.orderBy(z.desc(), "name").limit(MAX_FEATURES).select("name").collect()]
    named = {x for row in identity_terms for term in row for x in names_of(term)}
    names = [*sorted(named), *(x for x in names if x not in named)]  # a swap changes the counts of the first alone

    def measure(batches):
        lexicon = Lexicon(names)
        kind = pa.map_(pa.int32(), pa.int64())
        for batch in batches:
            x, pairs = [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                x.append(list(lexicon.counts(words).items()))
                pairs.append([[(i, n) for i, n in lexicon.counts(w).items() if i < len(named)] for pair in counterfactuals(text, words, identity_terms) for w in pair])
            yield pa.RecordBatch.from_arrays([pa.array(x, kind), pa.array(pairs, pa.list_(kind)), batch.column(1)], names=["x", "pairs", "y"])

    found = rows.mapInArrow(measure, "x map<int,long>, pairs array<map<int,long>>, y int").collect()
    found.sort(key=lambda r: (r["y"], sorted(r["x"].items()), str(r["pairs"])))  # tasks end in any order
    first, second = ([w for r in found for w in r["pairs"][k::2]] for k in (0, 1))
    d, used = _matrix(first, len(named)) - _matrix(second, len(named)), len(first)
    changes = d.T @ d
    x, y = _matrix([r["x"] for r in found], len(names)), np.array([r["y"] for r in found])
    del found, first, second, d
    weights, bias = solve(x, y, changes, L2, counterfactual / max(1, used) * len(x))
    return Model(names, weights, bias, used)


def score_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with out_col, 0 to 1. Null texts are empty; empty texts get the score of no words. Rows are independent."""
    kept = [c for c in docs.columns if c != out_col]
    rows = docs.select(*kept, text_of(text_col).alias(free_name(docs, "_scored")))

    def score(batches):
        of = model.scorer()
        for batch in batches:
            s = [of(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64())], names=[*batch.schema.names[:-1], out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(score, f"{schema}, `{out_col}` double")


def classify_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted (1 if score >= threshold) of every row of docs."""
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col)
    rows = score_toxicity(docs.select(F.col(id_col), F.col(text_col).alias("_t")), model, text_col="_t")
    return rows.select(id_col, held_out(id_col, FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
