import random
import re

import numpy as np
import pytest

from barloom.llm import common
from barloom.llm import ngram_join as N
from barloom.llm.components import connected_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(docs, n, percent):
    sets = [brute_set(t, n) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), least[find(i)] if sets[i] else doc_id) for i, (doc_id, _) in enumerate(docs)}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choice(words) for _ in range(60)]
    docs = []
    for g in range(30):  # groups of near copies, some of them long chains
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 25 if g < 3 else 5)):
            base = list(base) if rng.random() < 0.5 else base
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            base = copy if rng.random() < 0.5 else base
            docs.append(" ".join(copy))
    docs += [" ".join(shared + [rng.choice(words) for _ in range(rng.randint(1, 90))]) for _ in range(40)]  # a passage that many share
    docs += ["", "  \n", "one", "ONE", "one two", "a b c d", docs[0].upper(), docs[0] + " ", "z " * 9000]
    rng.shuffle(docs)
    return [(i * 3, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize(("seed", "n", "percent", "block"), [(1, 3, 90, 5), (2, 5, 80, 1000), (3, 2, 60, 4)])
def test_join_equals_brute_force(documents, monkeypatch, seed, n, percent, block):
    monkeypatch.setattr(N, "FREQUENT", 4)
    monkeypatch.setattr(N, "SHORT_LIST", 3)
    monkeypatch.setattr(N, "BLOCK", block)
    docs = corpus(seed) + [(1, None)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.ngram_join(documents(docs), n=n, percent=percent).collect()}
    assert got == brute(docs, n, percent)


@pytest.mark.parametrize("anchor", [1, 1 << 20])
def test_hot_lists_and_components(documents, monkeypatch, anchor):
    """Lists cut into parts, and groups too many to broadcast, give the same components."""
    monkeypatch.setattr(N, "FREQUENT", 2)
    monkeypatch.setattr(N, "HOT_LEVEL", 2)
    monkeypatch.setattr(N, "ANCHOR", anchor)
    monkeypatch.setattr(N, "BLOCK", 5)
    monkeypatch.setattr(common, "BROADCAST_GROUPS", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    docs = corpus(4) + [(1, None)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.ngram_join(documents(docs), n=3, percent=80).collect()}
    assert got == brute(docs, 3, 80)


def test_parts_of_hot_lists():
    postings = np.zeros(40_000, N._POSTING)
    postings["gram"], postings["node"] = 77, np.arange(40_000)
    level = np.full(40_000, N.HOT_LEVEL + 2, "u1")
    dealt, bucket = N._in_parts(postings, level, 16)
    assert bucket.min() >= 16 and len(np.unique(bucket)) == 8 and np.bincount(bucket).max() < 6000
    assert np.array_equal(np.unique(dealt["node"]), postings["node"])
    nodes, times = np.unique(dealt["node"], return_counts=True)
    assert set(times) == {1, 9}  # its own part, and each once more


def test_runs():
    for values in ([], [5], [1, 1, 2, 9, 9, 9]):
        got = N._runs(np.array(values, "u4"))
        want = np.unique(np.array(values, "u4"), return_counts=True)
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    assert len(N._unpack(N._pack(np.zeros(0, "u4")))) == 0


@pytest.mark.parametrize("docs", [[], [(1, None), (2, "")], [(7, "a b c d")] * 3, [(None, "a b c d"), (4, "a b c d"), (9, "q")]])
def test_edges(documents, docs):
    rows = N.ngram_join(documents(docs), n=3, percent=90).collect()
    assert len(rows) == len(docs)
    assert all(r["component_id"] == (4 if r["doc_id"] in (None, 4) else r["doc_id"]) for r in rows)


def test_sets_do_not_depend_on_their_batch():
    texts = ["A b c d", "", "b  c\td", "é É é É é", "x", "x y", "same same same same", "q " * 5000]
    one_by_one = [next(iter(N.shingle_sets([t], 3))) for t in texts]
    for a, b, t in zip(N.shingle_sets(texts, 3), one_by_one, texts, strict=True):
        assert np.array_equal(a, b) and len(a) == len(brute_set(t, 3))
    assert len(np.intersect1d(one_by_one[0], one_by_one[2])) == 1  # b c d


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    for most in (900, 5000):
        sets = [N.mix(np.unique(rng.integers(0, 6000, rng.integers(1, most))).astype("u8")) for _ in range(60)]
        a, b = sets[::2], sets[1::2]
        differ = N.sketches_differ([N.sketch_of(x) for x in a], [N.sketch_of(x) for x in b])
        assert all(d <= len(np.setxor1d(x, y)) for d, x, y in zip(differ, a, b, strict=True)) and differ.max() > 200
    large = N.mix(np.arange(3000, dtype="u8"))
    cells = N.mix(large ^ np.uint64(0x27D4EB2F165667C5)) % np.uint64(N.SKETCH_BITS)
    assert np.array_equal(N.fold([N.sketch_of(large)])[0].view(np.uint8), np.packbits(np.bincount(cells.astype(int), minlength=N.SKETCH_BITS) & 1))


def test_packed_numbers():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 32, 5000, dtype="u4"))
    assert np.array_equal(N._unpack(N._pack(values)), values)


@pytest.mark.parametrize("task_edges", [1000, 10])
def test_components(spark, task_edges):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(50)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(30)] + [(7, 7), (3, 2)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), task_edges=task_edges).collect())
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
