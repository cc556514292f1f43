"""Best-fit packing of token sequences, in bulk-synchronous rounds over range-sorted items and gaps."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, text_of, written
from .tokens import chunks, default_vocabulary, forget

#: Rows of a range that one task sweeps, about.
PART_ROWS = 200_000
#: How many items of a band a sequence surely holds, for each band from the longest items on.
BANDS = (1, 2, 3, 4, 5, 6, 8, 12, 24, 64, 512)
#: Items that a gap takes in one round at most.
COPIES = 16
NAMES = ["kind", "size", "tie", "item", "seq", "offset", "part", "pos", "level"]

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Cut each document, its ids and then id 0, into pieces of at most capacity ids: PIECES, without the ids."""
    path = vocabulary or default_vocabulary()

    def cut(batches):
        ids_of = chunks(path).ids
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(ids_of(text.as_py()), np.uint16(0)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for column, value in zip(out, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(lean(cut, functools.partial(forget, path)), PIECES)


_EVENT = "kind int, size int, tie long, item {item}, seq long, offset long, part int, pos long, level long"
GAP, ITEM, COPY, NET = range(4)


def _sweep(events: DataFrame, most: int, capacity: int, parts: int) -> DataFrame:
    """One successor sweep of items over gaps, both range-sorted by falling size.

    Down the sizes, a gap is laid on a stack and an item takes the top: the narrowest gap that is left of those that
    hold it. Items that compete for a gap are thus resolved by rank, the longer first; the others take its successors. A
    gap stands for as many items of the band (of at most most) as it surely holds, up to COPIES.

    A task sweeps its own range: it places items and narrows gaps, and numbers what stays open on both sides by the
    height of the stack, from its own start. NET is the height at its end, which the next range would start from.
    """
    schema = _EVENT.format(item=events.schema["item"].dataType.simpleString())
    order = [F.desc("size"), "kind", "tie"]
    sorted_ = (events.repartitionByRange(parts, *order) if parts > 1 else events.coalesce(1)).sortWithinPartitions(*order)

    def run(batches):
        table = pa.Table.from_batches(list(batches)).combine_chunks()  # about PART_ROWS
        kind, size, seq = (table.column(c).to_numpy() for c in ("kind", "size", "seq"))
        n, part = len(kind), TaskContext.get().partitionId()
        row = np.repeat(np.arange(n), np.where(kind == GAP, np.clip(size // most, 1, COPIES), 1))
        step = np.where(kind[row] == GAP, 1, -1)
        height = np.cumsum(step)
        level = np.where(step > 0, height, height + 1)
        order = np.argsort(level, kind="stable")  # on a level, laying down and taking take turns
        meet = np.flatnonzero((level[order][1:] == level[order][:-1]) & (step[order][:-1] > 0) & (step[order][1:] < 0))
        gap = np.full(n, -1)
        gap[row[order[meet + 1]]] = row[order[meet]]
        item = np.flatnonzero(gap >= 0)
        item = item[np.argsort(gap[item], kind="stable")]  # those of one gap follow one another
        own, length = gap[item], size[item].astype("i8")
        before = np.cumsum(length) - length
        first = np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
        before -= np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(own))))
        offset, place = np.zeros(n, "i8"), seq.copy()
        offset[item], place[item] = capacity - size[own] + before, seq[own]
        used = np.bincount(own, length, n).astype("i4") if n else np.zeros(0, "i4")
        taken = np.zeros(len(row), bool)
        taken[order[meet]] = taken[order[meet + 1]] = True
        at = np.zeros(n, "i8")
        at[row] = level
        open_ = (kind == ITEM) & (gap < 0)
        yield pa.RecordBatch.from_arrays(
            [
                table.column("kind").chunk(0) if n else pa.array([], pa.int32()), pa.array((size - used).astype("i4")), table.column("tie").combine_chunks(), table.column("item").combine_chunks(),
                pa.array(place.astype("i8"), mask=open_), pa.array(offset, mask=gap < 0), pa.array(np.full(n, part, "i4")), pa.array(np.cumsum(open_) - open_), pa.array(at),
            ],
            names=NAMES,
        )
        left = row[lone := np.flatnonzero(~taken & (step > 0))] if parts > 1 else np.zeros(0, int)
        m = len(left) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(np.full(m - 1, COPY), NET).astype("i4")), pa.array(np.append((size - used)[left], 0).astype("i4")), pa.nulls(m, pa.int64()), pa.nulls(m, table.schema.field("item").type),
                pa.array(np.append(seq[left], 0).astype("i8")), pa.nulls(m, pa.int64()), pa.array(np.full(m, part, "i4")), pa.nulls(m, pa.int64()),
                pa.array(np.append(level[lone] if m > 1 else np.zeros(0, int), height[-1] if len(height) else 0).astype("i8")),
            ],
            names=NAMES,
        )

    return sorted_.select("kind", "size", "tie", "item", F.coalesce("seq", F.lit(-1)).alias("seq")).mapInArrow(lean(run), schema)


def _across(swept: DataFrame, capacity: int) -> DataFrame:
    """Place what the ranges left open: an item takes the gap that an earlier range left on its level of the stack.

    A range leaves one item and one gap a level at most, so a level is a small group, whatever sizes are frequent.
    """
    spark = swept.sparkSession
    starts, height = [], 0
    for part, net in sorted(map(tuple, swept.filter(F.col("kind") == NET).select("part", "level").collect())):  # one row a range
        starts.append((part, height))
        height += net
    told = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    open_ = (F.col("kind") == ITEM) & F.col("seq").isNull()
    lone = swept.filter(open_ | (F.col("kind") == COPY)).join(told, "part").withColumn("level", F.col("level") + F.col("start"))
    turn = Window.partitionBy("level").orderBy("part", "kind")
    lone = lone.withColumns({"_kind": F.lag("kind").over(turn), "_seq": F.lag("seq").over(turn), "_width": F.lag("size").over(turn)}).filter(F.col("kind") == ITEM)
    meets = F.coalesce(F.col("_kind") == COPY, F.lit(False))
    own = Window.partitionBy("_seq").orderBy(F.desc("size"), "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(own), F.lit(0))
    met = lone.filter(meets).withColumns({"offset": capacity - F.col("_width") + before, "seq": F.col("_seq")}).select(*swept.columns)
    nth = F.row_number().over(Window.partitionBy("part").orderBy("pos")) - 1  # rows of a range
    still = lone.filter(~meets).withColumn("pos", nth.cast("long")).select(*swept.columns)
    met = written(met.unionAll(still), "met")
    used = met.filter("seq IS NOT NULL").groupBy("seq").agg(F.sum("size").alias("_used"))
    gaps = swept.filter(F.col("kind") == GAP).join(used, "seq", "left").withColumn("size", (F.col("size") - F.coalesce("_used", F.lit(0))).cast("int"))
    return swept.filter((F.col("kind") == ITEM) & F.col("seq").isNotNull()).unionAll(met).unionAll(gaps.select(*swept.columns))


def _fresh(open_: DataFrame, each: int, first: int, capacity: int) -> DataFrame:
    """Items that no gap holds, each to a sequence, the longest first; a row for each gap that they leave."""
    counts = dict(open_.groupBy("part").count().collect())  # one row a range
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    told = F.broadcast(open_.sparkSession.createDataFrame(starts, "part int, start long"))
    ranked = open_.join(told, "part").withColumn("_rank", F.col("start") + F.col("pos")).withColumn("seq", F.lit(first) + F.floor(F.col("_rank") / each))
    own = Window.partitionBy("seq").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.withColumn("offset", F.coalesce(F.sum("size").over(own), F.lit(0))).select(*open_.columns)


def best_fit_pack(items: DataFrame, length_col: str, capacity: int) -> DataFrame:
    """items with sequence_id and offset: each item has a place of its own length in a sequence of at most capacity.

    Bulk-synchronous best-fit. Items are range-sorted by falling length and taken in bands: those of which k, but not
    k + 1, surely fit a sequence. In a round, the band's items and all gaps are range-sorted by size, a distributed
    successor sweep matches them, conflicts are resolved by rank, and the gaps are narrowed; rounds repeat while an item is left
    that some gap holds. The rest of the band opens sequences, k neighbours in rank to each, as best-fit decreasing does.

    A round's table lies in the shared folder, so lost tasks and executors cost a stage. The driver holds counts of
    lengths (at most capacity), of ranges and of a round, never items or gaps. Ties are broken by a hash of the columns;
    repeated rows are separate items; one length may be that of all rows. Lengths are 1 to capacity; others raise.
    An empty table gives no rows. Columns sequence_id and offset of items are replaced.
    """
    spark = items.sparkSession
    kept = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    plain = items.select(F.lit(ITEM).alias("kind"), F.col(length_col).cast("int").alias("size"), F.xxhash64(*kept).alias("tie"), F.struct(*kept).alias("item"))
    counts = {r[0]: r[1] for r in plain.groupBy("size").count().collect()}  # at most capacity rows
    if any(x is None or not 1 <= x <= capacity for x in counts):
        raise ValueError("a length is null or outside 1 to the capacity")
    ranges = max(1, -(-sum(counts.values()) // PART_ROWS))
    documents = written(plain.repartitionByRange(ranges, F.desc("size"), "tie").sortWithinPartitions(F.desc("size")), "items")
    tables: list[DataFrame] = []
    gaps = spark.createDataFrame([], "seq long, size int")
    n_gaps = sequences = 0

    def gaps_of(rounds: DataFrame) -> DataFrame:
        return rounds.filter((F.col("kind") == GAP) & (F.col("size") > 0)).select("seq", "size")

    for k, following in zip(BANDS, [*BANDS[1:], None], strict=True):
        most, least = capacity // k, capacity // following if following else 0
        n = sum(m for x, m in counts.items() if least < x <= most)
        if not n:
            continue
        left = documents.filter((F.col("size") > least) & (F.col("size") <= most))
        while n:
            waiting = left.select("kind", "size", "tie", "item", F.lit(None).cast("long").alias("seq"))
            laid = gaps.select(F.lit(GAP).alias("kind"), "size", F.xxhash64("seq").alias("tie"), F.lit(None).cast(documents.schema["item"].dataType).alias("item"), "seq")
            parts = -(-(n + n_gaps) // PART_ROWS)
            swept = written(_sweep(waiting.unionAll(laid), most, capacity, parts), "swept")
            if parts > 1:
                swept = written(_across(swept, capacity), "placed")
            tables.append(swept)
            gaps = gaps_of(swept)
            left = swept.filter((F.col("kind") == ITEM) & F.col("seq").isNull())
            is_gap = (F.col("kind") == GAP) & (F.col("size") > 0)
            is_left = (F.col("kind") == ITEM) & F.col("seq").isNull()
            n, shortest, n_gaps, widest = swept.agg(F.count_if(is_left), F.min(F.when(is_left, F.col("size"))), F.count_if(is_gap), F.max(F.when(is_gap, F.col("size")))).first()
            if not n or widest is None or shortest > widest:
                break
        if n:
            each = capacity // most
            fresh = written(_fresh(left, each, sequences, capacity), "fresh")
            tables.append(fresh)
            sequences += -(-n // each)
            opened = fresh.groupBy("seq").agg((capacity - F.sum("size")).cast("int").alias("size")).filter("size > 0")
            gaps = gaps.unionAll(opened.select("seq", "size"))
            n_gaps += -(-n // each)

    if not tables:
        return documents.select("item.*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = [t.filter((F.col("kind") == ITEM) & F.col("seq").isNotNull()).select("item.*", F.col("seq").alias("sequence_id"), "offset") for t in tables]
    return functools.reduce(DataFrame.unionAll, places)


def pack_documents(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per piece: PIECES, sequence_id, offset. A null or empty text is one piece of one id, 0."""
    pieces = written(token_pieces(docs, capacity, id_col, text_col, vocabulary), "pieces")  # range-sorting reads its input twice
    return best_fit_pack(pieces, "length", capacity)
