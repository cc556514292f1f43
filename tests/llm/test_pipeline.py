import random

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__
from barloom.llm.queries import QUERIES, SQL

from .test_classifiers import LABELS, prose, quality_corpus
from .test_ngram_join import brute as near_brute
from .test_tokens_and_packing import check_packing, exact

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names and set(SQL) <= set(names)
    assert [s.split("_")[0] for s, _ in corpus_pipeline.STAGES] == ["quality", "exact", "ngram", "decontamination", "best"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    QUERIES[name](spark, SMALL).write.parquet(str(tmp_path / "out"))
    con.sql(f"CREATE TABLE want AS {SQL[name]}")
    con.sql(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    listed = ", ".join(f'"{c}"' for c in sorted(c[0] for c in con.sql("DESCRIBE want").fetchall()))
    for a, b in (("want", "got"), ("got", "want")):
        assert con.sql(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b}").fetchall() == []


def test_pipeline(spark, table_dir):
    rng = random.Random(8)
    docs, labels = quality_corpus()
    texts = dict(docs)
    bad = {i for i, q, *_ in labels if q == 0 and i is not None}
    good = prose(rng, 150)
    near = good.split()
    near[70] = "changed"
    item = " ".join(f"item{i}" for i in range(14))
    extra = {7000: good, 7001: good, 7002: " ".join(near), 7003: prose(rng, 60) + " " + item + " " + prose(rng, 60), 7004: item}
    rows = [(i, t, None, None, None if t is None else len(t)) for i, t in [*docs, *extra.items()]]
    folder = table_dir(documents=(rows, DOCS), labels=(labels, LABELS), benchmark=([(1, item)], "item_id long, text string"))
    table = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, folder)
        assert table.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
        table = spark.createDataFrame(table.collect(), DOCS)
        kept.append({r["doc_id"]: r["text"] for r in table.collect()})
    assert not bad & set(kept[0]) and {i for i in texts if i is not None and i < 5000} - bad <= set(kept[0])
    want = {t or "": i for i, t in sorted(kept[0].items(), key=lambda x: (x[0] is not None, x[0]))}
    assert set(kept[1]) == set(want.values())
    known = [(i, t) for i, t in kept[1].items() if i is not None]
    assert {i for i in kept[2] if i is not None} == {i for i, (_, c) in near_brute(known, 5, 80).items() if i == c}
    assert ({7001, 7002} & set(kept[2])) == {7001}
    assert set(kept[2]) - set(kept[3]) == {7004} & set(kept[2]) and "item3" not in kept[3][7003]
    assert all(kept[3][i] == kept[2][i] for i in kept[3] if i != 7003)
    pieces = corpus_pipeline.run(spark, folder).collect()
    check_packing(pieces, 2048)
    assert {r["doc_id"] for r in pieces} == set(kept[3])
    assert sum(r["length"] for r in pieces) == sum(len(exact(t or "")) + 1 for t in kept[3].values())


def test_named_rows_stay_before_others_and_repeats_go(spark, documents, tmp_path):
    good = prose(random.Random(1), 120)
    near = good.split()
    near[60] = "changed"
    docs = documents([(None, good), (5, " ".join(near)), (6, "alone here"), (6, "alone here"), (None, "alone here")])
    docs = docs.withColumn("_key", docs["shard"])
    docs.write.parquet(str(tmp_path / "clash"))
    docs = spark.read.parquet(str(tmp_path / "clash"))
    kept = corpus_pipeline.near(spark, docs, "")
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect() if len(r["text"]) > 20] == [5] and {r["_key"] for r in kept.collect()} == {"x"}
    kept = corpus_pipeline.exact(spark, docs, "").collect()
    assert sorted(map(str, (r["doc_id"] for r in kept))) == ["5", "6", "None"]


def test_pipeline_of_nothing(spark, table_dir):
    folder = table_dir(documents=([], DOCS), labels=([], LABELS), benchmark=([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, folder).collect() == []
