import pytest
from pyspark.sql import types as T

#: Columns of documents, and some that could clash with names of the operators.
EXTRA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("shard", T.StringType()), T.StructField("score", T.StringType()), T.StructField("length", T.StringType()), T.StructField("node", T.StringType()), T.StructField("piece", T.StringType()),
])


@pytest.fixture
def documents(spark, tmp_path):
    """Documents from (doc_id, text) pairs as a table of several partitions, with clashing further columns."""

    def make(rows, partitions=3):
        path = str(tmp_path / f"docs{len(list(tmp_path.iterdir()))}")
        full = [(i, t, None, "s", None if t is None else len(t), "x", "y", "z", "n", "p") for i, t in rows]
        spark.createDataFrame(full, EXTRA).repartition(partitions).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture
def table_dir(spark, tmp_path):
    """A folder of tables by name, from rows and schemas."""

    def make(**tables):
        folder = tmp_path / f"sf{len(list(tmp_path.iterdir()))}"
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return make
