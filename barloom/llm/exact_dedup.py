"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, left_join_groups, small, text_of, written

#: Characters of a text that its prefix hash reads.
PREFIX_CHARS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS, digest_all: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Rows are counted by byte length and the hash of their first characters, with partial aggregation; from that table
    come the lengths that occur once, which settle their rows, and the classes of length and prefix that have more
    than one row. Only rows of such classes are grouped by the SHA-256 of the whole text; all others are unique.
    Of equal texts one row stays, with the largest id. text_sha256 is null for rows that were settled earlier,
    unless digest_all asks for every digest; it is computed once and decides nothing for them.

    The classes are broadcast while they have at most broadcast_rows rows, so that only rows of a class are hashed and
    no text moves. Beyond it rows are hashed where they are read and narrow rows are joined with the classes; the
    result is the same. Groups are joined back past the settled rows, hot ones by broadcast.

    Nulls: a null text is the empty text; a null id is smaller than any other. Of repeated rows of one id and text
    one is kept. An empty table gives no rows. Columns of docs other than the two named are not read, so their names
    cannot clash.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.withColumns({"_len": F.octet_length("_text"), "_head": F.xxhash64(F.substring("_text", 1, prefix_chars))})
    counts = written(rows.groupBy("_len", "_head").agg(F.count(F.lit(1)).alias("_m")), "refined")
    lengths = counts.groupBy("_len").agg(F.sum("_m").alias("_of_length")).filter("_of_length > 1")
    classes = counts.filter("_m > 1").join(lengths, "_len", "left_semi")
    sha = F.sha2(F.col("_text").cast("binary"), 256)
    if small(classes, broadcast_rows):
        marked = rows.join(F.broadcast(classes), ["_len", "_head"], "left")
        digest = sha if digest_all else F.when(F.col("_m").isNotNull(), sha)
        hashed = marked.select("_id", digest.alias("_sha"), F.col("_m").isNotNull().alias("_hit"))
    else:
        every = written(rows.select("_id", "_len", "_head", sha.alias("_sha")), "digests")
        hit = F.col("_m").isNotNull()
        marked = left_join_groups(every, classes, ["_len", "_head"], "_m")
        hashed = marked.select("_id", (F.col("_sha") if digest_all else F.when(hit, F.col("_sha"))).alias("_sha"), hit.alias("_hit"))
    # a table: nothing can move the digest to rows that the classes leave out, and each is computed once
    hashed = written(hashed.withColumn("_row", F.monotonically_increasing_id()), "hashed")
    groups = hashed.filter("_hit").groupBy("_sha").agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    found = left_join_groups(hashed.filter("_hit"), written(groups, "groups"), ["_sha"], "_n")
    grouped = F.col("_n").isNotNull()
    found = found.select(
        F.col("_id").alias(id_col),
        F.when(grouped, F.col("_keep._id")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | (F.col("_row") == F.col("_keep._row"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    settled = hashed.filter("NOT _hit").select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    return found.unionAll(settled)
