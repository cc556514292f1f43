import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from barloom.llm import common, sharding
from barloom.llm import exact_dedup as exact_dedup_module
from barloom.llm.exact_dedup import exact_dedup

HEAD = "x" * 80
CASES = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, HEAD + "1"), (7, HEAD + "2"), (8, HEAD + "1"), (None, "a"), (9, "é"), (9, "é"), (10, "é" * 50_000), (11, "é" * 50_000), (12, "lonely text")]


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_dedup(documents, broadcast_rows, digest_all):
    groups = defaultdict(list)
    for i, t in CASES:
        groups[t or ""].append(i)
    rows = exact_dedup(documents(CASES), digest_all=digest_all, broadcast_rows=broadcast_rows).collect()
    assert len(rows) == len(CASES) and sum(r["kept"] for r in rows) == len(groups)
    text_of = {i: t or "" for i, t in CASES}
    for r in rows:
        own = groups["a" if r["doc_id"] is None else text_of[r["doc_id"]]]
        top = max(x for x in own if x is not None)
        assert (r["keep_id"], r["group_size"]) == (top, len(own)) and (r["doc_id"] == top or not r["kept"])
        digest = hashlib.sha256(("a" if r["doc_id"] is None else text_of[r["doc_id"]]).encode()).hexdigest()
        assert r["text_sha256"] == digest or (not digest_all and r["text_sha256"] is None and len(own) == 1)
    # a lone length is settled without a digest, however the classes are told
    assert digest_all or next(r for r in rows if r["doc_id"] == 12)["text_sha256"] is None


def test_many_groups_are_joined_without_a_hot_task(documents, monkeypatch):
    want = sorted(map(str, exact_dedup(documents(CASES)).collect()))
    monkeypatch.setattr(common, "BROADCAST_GROUPS", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert sorted(map(str, exact_dedup(documents(CASES), broadcast_rows=0).collect())) == want


def test_digests_are_of_surviving_rows_alone(documents, monkeypatch):
    """The one plan that hashes texts does so above the join with the classes, and no filter asks for a digest."""
    plans = []
    kept = exact_dedup_module.written
    monkeypatch.setattr(exact_dedup_module, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or kept(df, name))
    exact_dedup(documents(CASES)).collect()
    assert [name for name, _ in plans] == ["refined", "hashed", "groups"]
    assert "sha2" not in plans[0][1] and "sha2" not in plans[2][1]
    lines = plans[1][1].split("\n")
    assert min(k for k, x in enumerate(lines) if "sha2" in x) < next(k for k, x in enumerate(lines) if "Join" in x)
    assert not any("sha2" in x for x in lines[next(k for k, x in enumerate(lines) if "Join" in x) :]) and "CASE WHEN" in plans[1][1]


def test_exact_dedup_of_nothing(documents):
    assert exact_dedup(documents([])).collect() == []


def check_shards(rows, docs, shards):
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(str(i) for i, _ in docs)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_sharding_is_even_and_keeps_groups(documents):
    rng = random.Random(3)
    docs = [(i, "w" * rng.randint(1, 400)) for i in range(1200)] + [(5000 + i, "hot text " * 9) for i in range(600)] + [(9000, None), (9001, ""), (None, "no id")]
    rows = sharding.shard_documents(documents(docs, 5), 8).collect()
    sizes = check_shards(rows, docs, 8)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) < 1.06 * mean and min(sizes.values()) > 0.94 * mean
    text = dict(docs)
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in rows)
    small = defaultdict(set)
    for r in rows:
        if text[r["doc_id"]] != "hot text " * 9:
            small[text[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) > 1 for s in small.values()) <= 3


@pytest.mark.parametrize("docs", [[], [(1, "a")], [(1, "a")] * 30, [(i, "same") for i in range(50)], [(1, "x" * 300_000), (2, "y"), (3, "z")]])
def test_sharding_edges(documents, docs):
    check_shards(sharding.shard_documents(documents(docs), 4).collect(), docs, 4)


def test_splitter_search(spark):
    cuts = sorted({(random.Random(i).randint(-9, 9), random.Random(-i).randint(-3, 3)) for i in range(40)})
    keys = [(k, t) for k in range(-10, 11) for t in range(-4, 5)]
    df = spark.createDataFrame(keys, "_key long, _tie long")
    got = {(r[0], r[1]): r[2] for r in df.select("_key", "_tie", sharding._range_of(cuts)).collect()}
    assert got == {x: sum(c <= x for c in cuts) for x in keys}


def test_plans_are_native(documents):
    docs = documents([(1, "a"), (2, "a")])
    for df in (exact_dedup(docs, digest_all=True), sharding.shard_documents(docs, 4)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
