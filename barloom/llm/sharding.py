"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

#: Fine ranges a shard is built from. A group of equal texts up to the size of a range stays in one shard.
RANGES_PER_SHARD = 25
#: Samples drawn for each range, on average. shards * RANGES_PER_SHARD * SAMPLES_PER_RANGE keys reach the driver.
SAMPLES_PER_RANGE = 20
#: A range over this many times the mean is subdivided.
OVERFULL = 2.0
ROUNDS = 3
LOWEST = -(1 << 63)


def _sample(rows: DataFrame, rate: float, seed: int) -> list[tuple[int, int]]:
    """Keys drawn with a chance in proportion to size. The draw hashes the key, so a retried task draws the same."""
    draw = (F.xxhash64("_key", "_tie", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    return sorted((r[0], r[1]) for r in rows.filter(draw < F.col("_size") * F.lit(rate)).select("_key", "_tie").collect())


def _quantiles(keys: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    """Boundaries at the quantiles. A text that fills less than a whole range is not cut: its boundary moves to its start."""
    picked = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
    seen: dict[int, int] = {}
    for key, _ in picked:
        seen[key] = seen.get(key, 0) + 1
    return sorted({(key, tie if seen[key] > 1 else LOWEST) for key, tie in picked})


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below the key, by binary search in two constant arrays, which Catalyst folds."""
    if not splitters:
        return F.lit(0)
    steps = [1 << b for b in range(len(splitters).bit_length() - 1, -1, -1)]
    keys, ties = (F.split(F.lit(",".join(str(x[i]) for x in splitters)), ",").cast("array<bigint>") for i in (0, 1))

    def step(low: Column, by: Column) -> Column:
        at = low + by - 1
        key = F.get(keys, at)
        reached = (low + by <= len(splitters)) & ((key < F.col("_key")) | ((key == F.col("_key")) & (F.get(ties, at) <= F.col("_tie"))))
        return F.when(reached, low + by).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def sampled_splitters(docs: DataFrame, size_col: str, key_col: str, tie_col: str, shards: int, *, ranges_per_shard: int = RANGES_PER_SHARD, seed: int = 7) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (gapless from 0 within the shard); law: bytes.

    Splitters are quantiles of a sample drawn by size, so each range of (key, tie) holds about the same bytes,
    and a hot key is cut at its ties. Ranges that turn out overfull are sampled again on their own and subdivided.
    Exact sums over the ranges, a bounded table, place each range in the whole order, and a running sum inside a
    range places the middle of each group, so that shards differ by about the size of a range or of one long document.

    key_col and tie_col are longs without nulls and size_col is a positive long; docs should be narrow, since its
    rows are shuffled once by range. Rows of one key stay together unless they outgrow a range. Repeated rows
    share a place in the order, one after another. An empty table gives no rows. Names beginning with _ are ours.
    """
    rows = docs.withColumns({"_key": F.col(key_col), "_tie": F.col(tie_col), "_size": F.col(size_col)})
    total, n, longest = rows.agg(F.sum("_size"), F.count(F.lit(1)), F.max("_size")).first()
    total = total or 0
    parts = max(1, min(shards * ranges_per_shard, n or 1))
    splitters: list[tuple[int, int]] = []
    if parts > 1:
        splitters = _quantiles(_sample(rows, parts * SAMPLES_PER_RANGE / total, seed), parts)

    full = max(OVERFULL * total / parts, longest or 0)
    for again in range(ROUNDS):
        placed = rows.withColumn("_range", _range_of(splitters))
        sums = {r[0]: (r[1], r[2]) for r in placed.groupBy("_range").agg(F.sum("_size"), F.count(F.lit(1))).collect()}
        over = {i: b for i, (b, c) in sums.items() if b > full and c > 1}
        if not over or again == ROUNDS - 1:
            break
        drawn = _sample(placed.filter(F.col("_range").isin(list(over))), parts * SAMPLES_PER_RANGE * 4 / total, seed + again + 1)
        by_range: dict[int, list[tuple[int, int]]] = {}
        for key in drawn:
            by_range.setdefault(bisect.bisect_right(splitters, key), []).append(key)
        more: set[tuple[int, int]] = set()
        for i, keys in by_range.items():
            pieces = 1 + int(over.get(i, 0) * parts / total)
            # an overfull range may be one hot text: cut at ties
            more |= {keys[len(keys) * j // pieces] for j in range(1, pieces)}
        if not more - set(splitters):
            break
        splitters = sorted(set(splitters) | more)

    before, offsets = 0, []
    first = 0
    for i in range(len(splitters) + 1):
        offsets.append((i, before, first))
        before += sums.get(i, (0, 0))[0]
        first += sums.get(i, (0, 0))[1]
    spark = docs.sparkSession
    starts = spark.createDataFrame(offsets, "_range int, _before long, _first long")  # one row a range
    in_range = Window.partitionBy("_range").orderBy("_key", "_tie")
    placed = placed.join(F.broadcast(starts), "_range").withColumns({
        "_upto": F.sum("_size").over(in_range.rowsBetween(Window.unboundedPreceding, -1)),
        "_nth": F.row_number().over(in_range),
    })
    group = Window.partitionBy("_range", "_key")
    middle = F.min(F.coalesce("_upto", F.lit(0))).over(group) + F.sum("_size").over(group) / 2
    shard = F.least(F.floor((F.col("_before") + middle) * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int")
    placed = placed.withColumns({"shard": shard, "_at": F.col("_first") + F.col("_nth") - 1})
    placed = written(placed.drop("_key", "_tie", "_size", "_before", "_first", "_upto", "_nth", "_range"), "sharded")
    lows = placed.groupBy("shard").agg(F.min("_at").alias("_low"))  # one row a shard
    return placed.join(F.broadcast(lows), "shard").withColumn("slot", F.col("_at") - F.col("_low")).drop("_at", "_low")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place each row of docs in a shard by bytes: id, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot.

    The order is by the hash of the text, then the id, so equal texts are neighbours. A null text is empty; a null id
    comes before the others.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_text_hash"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("_order"),
    )
    return sampled_splitters(rows, "size", "_text_hash", "_order", shards).withColumn("law", F.lit("bytes")).drop("_text_hash", "_order")
