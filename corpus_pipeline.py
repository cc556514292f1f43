"""The corpus pipeline: documents to packed training sequences, in five stages that each call one operator.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and read
again as the docs of the next. All but the last return the columns of documents. Nulls and empty texts: quality
scores them like any text; deduplication counts null as empty, and texts without words have no near copies;
decontamination leaves them as they are; packing gives them one piece. Rows that repeat an id and a text are exact
copies, of which one stays; an id with several texts is several documents. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import free_name, maybe_broadcast, placed, table, written
from barloom.llm.decontaminate import decontaminate
from barloom.llm.exact_dedup import exact_dedup
from barloom.llm.ngram_join import ngram_join
from barloom.llm.packing import pack_documents
from barloom.llm.quality import keep_quality

CAPACITY = 2048


def _without(docs: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose key is dropped; texts are shuffled only if the dropped keys are too many to broadcast."""
    name = free_name(docs, "_key")
    return docs.select("*", key.alias(name)).join(maybe_broadcast(written(dropped.select(F.col("_key").alias(name)), "dropped")), name, "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays."""
    docs, place = placed(docs)
    key = F.struct(docs["doc_id"], place.alias("place"))  # ties of id and text: one of the repeated rows stays
    rows = exact_dedup(docs.select(key.alias("_key"), "text"), "_key")
    return _without(docs, key, rows.filter(~F.col("kept")).select("_key"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 over five-word n-grams the smallest id stays."""
    docs, place = placed(docs)
    key = F.struct(docs["doc_id"].isNull().alias("unnamed"), docs["doc_id"], place.alias("place"))  # null ids come last
    rows = ngram_join(docs.select(key.alias("_key"), "text"), n=5, percent=80, id_col="_key")
    return _without(docs, key, rows.filter(F.col("_key") != F.col("component_id")).select("_key"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten words of a benchmark item go; so does a document that is mostly such passages."""
    clean = decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, CAPACITY)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("decontamination", decontamination),
    ("best_fit_packing", packing),
]
#: SQL cannot express the classifier or the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
