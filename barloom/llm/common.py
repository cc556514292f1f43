"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that a Python worker hands over at once, about.
HANDED_BYTES = 4 << 20
#: Rows of a key table that may be broadcast. At up to 32 bytes a key this is at most 16 MB.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master, whose driver
    and executor are one process, gets a temporary one; a cluster raises."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where if ":/" in where else f"file://{where}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df with a Parquet table in the shared folder, which outlives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch that no later step reads, through the store that it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Give the system back what this process has freed but its allocators keep."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run, *caches):
    """run, a function for mapInArrow, with large batches handed over in pieces. Spark keeps a task's worker for later
    ones, so at the end each of caches is called to empty what it names, and freed memory goes back to the system."""

    def whole(batches):
        try:
            for batch in run(batches):
                step = max(1, batch.num_rows * HANDED_BYTES // max(1, batch.nbytes))
                for at in range(0, max(1, batch.num_rows), step):
                    yield batch.slice(at, step)
                del batch
        finally:
            for empty in caches:
                empty()
            release()

    return whole


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has no more than limit rows; it counts at most one more."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is small; else Spark shuffles the join, and AQE splits its hot keys."""
    return F.broadcast(df) if small(df, limit) else df


#: Rows of a group from which on it is hot. There are at most so many times fewer hot groups than rows.
HOT_ROWS = 10_000
#: Groups that may be broadcast with their columns, at up to 150 bytes each: 15 MB.
BROADCAST_GROUPS = 100_000


def left_join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows with the columns of their group, one row a key in groups, whose rows count tells; null where there is none.

    A few groups are broadcast. Of many, only the hot ones are, so that rows of a hot key are not dealt by it, and the
    rest are dealt by key. Keys have no nulls. groups is read several times, as a table.
    """
    if small(groups, BROADCAST_GROUPS):
        return rows.join(F.broadcast(groups), keys, "left")
    hot = groups.filter(F.col(count) > HOT_ROWS)
    others = [c for c in groups.columns if c not in keys]
    first = rows.join(maybe_broadcast(hot, BROADCAST_GROUPS), keys, "left")
    rest = first.filter(F.col(count).isNull()).drop(*others).join(groups.filter(F.col(count) <= HOT_ROWS), keys, "left")
    return first.filter(F.col(count).isNotNull()).select(*rest.columns).unionAll(rest)


def placed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs and a column that tells its rows apart: (hash of the file, row in it). Rows that don't come straight from a
    Parquet table are written as one first, so that each read gives them the same place."""
    plans, straight = [docs._jdf.queryExecution().analyzed()], True
    while plans:
        plan = plans.pop()
        straight &= plan.nodeName() in ("Project", "Filter", "SubqueryAlias") or plan.nodeName().startswith(("LogicalRelation", "Relation"))
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    try:
        meta = docs.metadataColumn("_metadata") if straight else None
        docs.select(meta["row_index"])
    except (AnalysisException, TypeError):  # no file source, or one whose rows have no numbers
        docs = written(docs, "placed")
        meta = docs.metadataColumn("_metadata")
    return docs, F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row"))


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of docs is called so."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return name


def text_of(column: str | Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
