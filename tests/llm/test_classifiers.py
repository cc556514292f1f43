import random
import zlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import quality, toxicity
from barloom.llm.labels import training_rows

LABELS = "doc_id long, quality int, toxic int, text string"


def prose(rng, n):
    return " ".join(rng.choice(["the", "house", "stands", "near", "a", "river", "and", "people", "walk", "slowly"]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def quality_corpus(n=300):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(rng, rng.randint(5, 120))
        if bad:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "### "), " ".join(w for w in text.split() for _ in range(9))])
        docs.append((i, text))
        labels.append((i, int(not bad), None, "clash"))
    return [*docs, (5000, None), (5001, ""), (5002, "x" * 200_000), (None, "no id here")], [*labels, (9999, 1, 1, None), (3, None, None, None), (None, 0, 1, None)]


def test_quality(spark, documents):
    docs, labels = quality_corpus()
    rows = quality.classify_quality(documents(docs), spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(docs)
    known = {i: q for i, q, *_ in labels}
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 5000]
    assert sum(r["predicted"] == known[r["doc_id"]] for r in held) / len(held) > 0.97


def test_held_out_labels_do_not_matter(spark, documents):
    docs, labels = quality_corpus(120)
    other = [(i, q if i is None or q is None or zlib.crc32(str(i).encode()) % 3 != 1 else 1 - q, t, x) for i, q, t, x in labels]
    table = documents(docs)
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify_quality(table, spark.createDataFrame(v, LABELS)).collect()} for v in (labels, other))
    assert a == b


@pytest.mark.parametrize("labels", [[], [(1, 1, 1, None)], [(1, 0, 0, None), (2, 0, 0, None)]])
def test_one_class_or_none(spark, documents, labels):
    docs = documents([(1, "a b"), (2, None), (3, "c")])
    table = spark.createDataFrame(labels, LABELS)
    assert all(r["score"] == 0.5 for r in quality.classify_quality(docs, table).collect())
    assert all(0 <= r["score"] <= 1 for r in toxicity.classify_toxicity(docs, table).collect())
    assert quality.keep_quality(docs, table).columns == docs.columns


def toxic_corpus(n=400):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = prose(rng, rng.randint(10, 60)).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "clown", "vileux", "vileuxment", "vileuxaux"]))
        if i % 5 == 0 or i % 9 == 0:  # groups are named more often in toxic texts
            words.append(rng.choice(["women", "muslims"]))
        docs.append((i, " ".join(words)))
        labels.append((i, None, int(toxic), None))
    return docs, labels


def test_toxicity(spark, documents):
    docs, labels = toxic_corpus()
    docs += [(6000, "you vileuxish vileuxon moron"), (6001, "women walk near the river"), (6002, ""), (6003, None), (6003, None), (None, "moron clown moron")]
    table = spark.createDataFrame(labels, LABELS)
    rows = toxicity.classify_toxicity(documents(docs), table).collect()
    assert len(rows) == len(docs)
    known = {i: t for i, _, t, _ in labels}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 60 and all(r["predicted"] == known[r["doc_id"]] for r in held)
    by = {r["doc_id"]: r for r in rows}
    assert by[6000]["predicted"] == 1 and by[6001]["predicted"] == 0 and by[6002]["predicted"] == 0 and by[None]["predicted"] == 1


def test_swapping_groups_hardly_moves_a_score(spark, documents):
    docs, labels = toxic_corpus()
    table, known = documents(docs), spark.createDataFrame(labels, LABELS)
    moved = {}
    for weight in (0.0, 50.0):
        score = toxicity.fit_toxicity(table, known, counterfactual=weight).scorer()
        moved[weight] = max(abs(score(f"{a} walk near the river") - score(f"{b} walk near the river")) for row in toxicity.IDENTITY_TERMS for a, b in zip(row, row[1:], strict=False))
    assert moved[50.0] < moved[0.0] / 3


def test_counterfactuals_of_the_tables_are_at_work(spark):
    """The tables name no group, so mentions are put in: neutral ones stay harmless, and swaps move no score."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    assert model.pairs >= 2 * training_rows(docs, labels, "toxic", toxicity.FOLDS, toxicity.FOLD).count() > 0
    score = model.scorer()
    clean = [r["text"] for r in docs.join(labels.filter("toxic = 0"), "doc_id").select("text").limit(60).collect()]
    for k, text in enumerate(clean):
        row = toxicity.IDENTITY_TERMS[k % len(toxicity.IDENTITY_TERMS)]
        scores = [score(f"{text} {term}") for term in row]
        assert max(scores) - min(scores) < 0.02 and abs(scores[0] - score(text)) < 0.02
    assert all(score(f"many {term} live here") < 0.3 for row in toxicity.IDENTITY_TERMS for term in row)


def test_counterfactuals():
    (a, b), (c, d) = toxicity.counterfactuals("x y", Counter("xy"))
    assert a == c and d == Counter("xy") and a - d != b - d and sum(a.values()) == sum(b.values()) == 3
    assert toxicity.counterfactuals("men", Counter(["men"])) == [(Counter(["men"]), Counter(["woman"]))]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "p", "q"), (2, "c", "r", "s")], "doc_id long, text string, _scored string, _score string")
    labels = spark.createDataFrame([(1, 1, 1, None), (2, 0, 0, None)], LABELS)
    scored = toxicity.score_toxicity(docs, toxicity.Model([], np.zeros(0), 0.0))
    assert scored.columns == ["doc_id", "text", "_scored", "_score", "score"] and {r["_scored"] for r in scored.collect()} == {"p", "r"}
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r["_score"] for r in kept.collect()} <= {"q", "s"}


def test_repeated_ids_do_not_pass_the_bound(spark):
    docs = spark.createDataFrame([(i % 4, f"t{i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, None, None) for i in range(4)], LABELS)
    assert training_rows(docs, labels, "quality", 3, 1).count() <= 4


def test_swap_and_solver():
    assert toxicity.swap(Counter({"women": 2, "x": 1})) == Counter({"men": 2, "x": 1}) and toxicity.swap(Counter({"x": 1})) is None
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-x @ [2, -1, 0.5] - 0.3))).astype(float)
    x1 = np.hstack([x, np.ones((400, 1))])
    w, b = toxicity.solve(x1, y, np.zeros((4, 4)), 1e-3, 1.0, steps=3000)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + 1e-3 * w).max() < 1e-3
    d = np.array([[1.0, -1.0, 0.0, 0.0]])
    w, _ = toxicity.solve(x1, y, d.T @ d, 1e-3, 1e4, steps=3000)
    assert abs(w[0] - w[1]) < 0.1


def test_training_rows_are_bounded(spark, documents):
    docs = documents([(i, f"t{i}") for i in range(900)])
    labels = spark.createDataFrame([(i, i % 2, None, None) for i in range(900)] * 2, LABELS)
    n = training_rows(docs, labels, "quality", 3, 1, max_train=100).count()
    assert 60 < n < 150
    assert training_rows(docs, labels, "quality", 3, 1).count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(900))
