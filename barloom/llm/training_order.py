"""Training-order materialisation: a keyed permutation gives every sequence its place, and shards hold places in order."""

from __future__ import annotations

import functools
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, placed, remove, scratch, text_of, written
from .tokens import chunks, default_vocabulary, forget

#: A record's head: doc_id, piece, how many ids, whether doc_id is null. The ids follow as 16-bit numbers, padded with zeros.
HEAD = (("doc_id", "<i8"), ("piece", "<i4"), ("n", "<u2"), ("null", "<u2"))
#: Bytes of records that a task holds before it hands them on.
HELD_BYTES = 8 << 20
#: Of the compression of sequences between tasks.
LEVEL = 6
MANIFEST = "shard int, path string, first_slot long, rows long, seq_len int"
RECORD = "slot long, shard int, doc_id long, piece int, n_tokens long, ids_crc32 long"
ROUNDS = 6


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1 that depends on key: a balanced Feistel network over the next even number of bits,
    walked along its cycle until it is back inside the range."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) & 0xFFFFFFFFFFFFFFFF) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << shift) | right

    out = once(np.asarray(index, "u8"))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype("i8")


def _record(seq_len: int) -> np.dtype:
    return np.dtype([*HEAD, ("ids", "<u2", (seq_len,))])


def _pack(records: np.ndarray) -> bytes:
    """Records as their ids and the planes of their heads' bytes, compressed."""
    import zstandard

    data = records.view("u1").reshape(len(records), -1)
    head = data.shape[1] - 2 * records.dtype["ids"].shape[0]
    return zstandard.ZstdCompressor(level=LEVEL).compress(data[:, head:].tobytes() + data[:, :head].T.tobytes())


def _unpack(blob: bytes, n: int, dtype: np.dtype) -> np.ndarray:
    import zstandard

    body = 2 * dtype["ids"].shape[0]
    data = np.empty((n, dtype.itemsize), "u1")
    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "u1")
    data[:, dtype.itemsize - body :] = plain[: n * body].reshape(n, body)
    data[:, : dtype.itemsize - body] = plain[n * body :].reshape(-1, n).T
    return data.view(dtype).ravel()


def _splits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text, and the split that a row is read from: _file, _block."""
    docs, _ = placed(docs)  # a shuffle would part the rows of a split
    meta = docs.metadataColumn("_metadata")
    return docs.select(docs[id_col].cast("long").alias("_id"), text_of(docs[text_col]).alias("_text"), meta["file_path"].alias("_file"), meta["file_block_start"].alias("_block"))


def _sequences(rows: DataFrame, seq_len: int, path: str) -> DataFrame:
    """Tokenise the rows once: blobs of up to HELD_BYTES of consecutive sequences, with the split they are from and how
    many sequences of that split come before."""
    dtype = _record(seq_len)
    limit = max(1, HELD_BYTES // dtype.itemsize)

    def cut(batches):
        ids_of = chunks(path).ids
        run, before = (None, 0), 0
        heads: list[tuple[int, int, int]] = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal before, heads, held, size
            doc, count, last = np.array(heads, "i8").reshape(-1, 3).T
            records = np.zeros(size, dtype)
            records["ids"] = np.concatenate(held).reshape(size, seq_len)
            records["doc_id"] = np.repeat(doc, count)
            records["null"] = np.repeat([n is None for n in nulls], count)
            ends = np.cumsum(count)
            records["piece"] = np.arange(size) - np.repeat(ends - count, count)
            records["n"] = seq_len
            records["n"][ends - 1] = last
            at, before, heads, held, size = before, before + size, [], [], 0
            nulls.clear()
            return pa.RecordBatch.from_pydict({"file": [run[0]], "block": [run[1]], "before": [at], "n": pa.array([len(records)], pa.int32()), "blob": [_pack(records)]})

        nulls: list = []
        for batch in batches:
            for doc_id, text, *split in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if tuple(split) != run:
                    if size:
                        yield flush()
                    run, before = tuple(split), 0
                ids = ids_of(text.as_py())
                count = len(ids) // seq_len + 1  # with the id 0 that ends the document, which the padding holds already
                padded = np.zeros(count * seq_len, "<u2")
                padded[: len(ids)] = ids
                heads.append((doc_id or 0, count, len(ids) + 1 - (count - 1) * seq_len))
                nulls.append(doc_id)
                held.append(padded)
                size += count
                if size >= limit:
                    yield flush()
        if size:
            yield flush()

    return rows.mapInArrow(lean(cut, functools.partial(forget, path)), "file string, block long, before long, n int, blob binary")


def write_training_order(docs: DataFrame, folder: str | None = None, *, seq_len: int = 256, key: int = 20240101, rows_per_shard: int = 16_384, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Write the sequences of docs in training order to fixed-stride shards in folder; returns their MANIFEST.

    A document's ids, ended by id 0, are cut into sequences of seq_len; the last may be shorter and is padded in the
    file. Sequences are numbered by their document's file (in the order of the names) and row in it, and the number's
    image under the keyed permutation is the global slot: the order depends on the key and the table, not on how a
    cluster splits the table into tasks. Slots are dealt to shards by range; each shard is sorted and written by one task
    under a name of its own, which counts only once it is in the manifest, so lost tasks can run again.

    Texts are tokenised once; the sequences are staged compressed in the shared folder until the shards are written.
    Two numbers a split reach the driver and all tasks. A null or empty text is one
    sequence of one id. Null ids are flagged; repeated rows are separate sequences; an empty table gives no shards.
    Other columns are not read. Rows that are computed rather than read from files are written as a table first, so
    their order follows their partitions.
    """
    path = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    folder = folder or scratch(spark, "training-order")
    dtype = _record(seq_len)
    staging = scratch(spark, "sequences")
    _sequences(_splits(docs.select(id_col, text_col), id_col, text_col), seq_len, path).write.option("compression", "none").parquet(staging)
    staged = spark.read.schema("file string, block long, before long, n int, blob binary").parquet(staging)
    run = F.xxhash64("file", "block").alias("run")
    counts = staged.groupBy("file", "block").agg(F.sum("n").alias("n")).orderBy("file", "block").select(run, "n")
    runs = np.array([tuple(r) for r in counts.toLocalIterator()], "i8").reshape(-1, 2)  # in the order of the table
    total = int(runs[:, 1].sum())
    order = np.argsort(runs[:, 0])
    names, firsts = runs[order, 0], (np.cumsum(runs[:, 1]) - runs[:, 1])[order]
    if len(np.unique(names)) != len(names):
        raise RuntimeError("two splits have one hash")
    told = spark.sparkContext.broadcast((names, firsts))  # 16 bytes a split of the table

    def deal(batches):
        names, firsts = told.value
        held: list[np.ndarray] = []
        numbers: list[np.ndarray] = []
        size = 0

        def flush():
            records = np.concatenate(held)
            slots = feistel(np.concatenate(numbers), total, key)
            order = np.argsort(slots)
            slots, records = slots[order], records[order]
            shards = slots // rows_per_shard
            at = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]]))
            ends = [*at[1:].tolist(), len(slots)]
            return pa.RecordBatch.from_pydict({
                "shard": pa.array(shards[at].astype("i4")),
                "slots": pa.array([slots[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
                "blob": pa.array([_pack(records[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary()),
            })

        for batch in batches:
            for name, before, n, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                held.append(_unpack(blob.as_py(), n, dtype))
                numbers.append(firsts[np.searchsorted(names, name)] + before + np.arange(n))
                size += n
                if size * dtype.itemsize >= HELD_BYTES:
                    yield flush()
                    held, numbers, size = [], [], 0
        if size:
            yield flush()

    def write(batches):
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        slots: list[np.ndarray] = []
        held: list[np.ndarray] = []
        shard = None

        def flush():
            all_ = np.concatenate(slots)
            order = np.argsort(all_)
            if (all_[order] != shard * rows_per_shard + np.arange(len(all_))).any():
                raise RuntimeError("slots are missing or doubled")
            name = f"shard-{shard:08d}-{uuid.uuid4().hex}.bin"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(np.concatenate(held)[order].tobytes())
            row = (shard, f"{folder}/{name}", shard * rows_per_shard, len(all_), seq_len)
            types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

        for batch in batches:
            for at, own, blob in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if at != shard:  # sorted by shard: one is in memory at a time
                    if held:
                        yield flush()
                    shard, slots, held = at, [], []
                slots.append(np.frombuffer(own.as_py(), "<i8"))
                held.append(_unpack(blob.as_py(), len(slots[-1]), dtype))
        if held:
            yield flush()

    shards = max(1, -(-total // rows_per_shard))
    tasks = min(shards, 20_000)
    dealt = staged.select(run, "before", "n", "blob").mapInArrow(lean(deal), "shard int, slots binary, blob binary")
    dealt = dealt.repartitionById(tasks, (F.col("shard") * F.lit(tasks) / F.lit(shards)).cast("int")).sortWithinPartitions("shard")
    manifest = written(dealt.mapInArrow(lean(write), MANIFEST), "shards")
    remove(spark, staging)
    return manifest


def read_training_order(manifest: DataFrame, from_slot: int = 0) -> DataFrame:
    """The RECORDs from a slot on, to resume there: shards before it are not opened, and the first is entered at its stride."""
    rows = manifest.filter(F.col("first_slot") + F.col("rows") > from_slot)
    n = max(1, rows.count())

    def read(batches):
        import pyarrow.fs

        for batch in batches:
            for shard, path, first, count, seq_len in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                dtype = _record(seq_len)
                fs, where = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(where) as file:
                    for at in range(max(0, from_slot - first), count, 4096):
                        data = np.frombuffer(file.read_at(dtype.itemsize * min(4096, count - at), dtype.itemsize * at), dtype)
                        sizes = data["n"].astype("i8")
                        wide = memoryview(np.ascontiguousarray(data["ids"].astype("<u4"))).cast("B")
                        sums = [zlib.crc32(wide[k : k + 4 * m]) for k, m in zip(range(0, 4 * seq_len * len(data), 4 * seq_len), sizes.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(first + at + np.arange(len(data))), pa.array(np.full(len(data), shard, "i4")), pa.array(data["doc_id"].copy(), mask=data["null"] != 0),
                                pa.array(data["piece"].copy()), pa.array(sizes), pa.array(sums, pa.int64()),
                            ],
                            names=[x.split()[0] for x in RECORD.split(", ")],
                        )

    return rows.repartition(min(n, 10_000)).mapInArrow(lean(read), RECORD)
