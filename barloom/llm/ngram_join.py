"""N-gram Jaccard join: T-occurrence search over inverted lists, the short ones merged and the long ones probed.

A document is the set of its word n-grams, as 64-bit hashes; documents with one set are one node. Two nodes that
reach the similarity share at least T n-grams, so they meet in the lists of the rarest size - T + 1 n-grams of
either: these short lists are what a query merges, and the T - 1 longest lists are never merged. A candidate found
in a short list whose sketch does not rule it out is then probed by binary search in the sorted set for an overlap of T. The merge of all
queries' short lists is one distributed sort by n-gram.

Lists are short because rarity is counted over the whole corpus, and frequent n-grams come last in the common order.
Lists of many near copies stay long, and in those not all pairs are made: neighbours in an order that puts like sets
side by side are probed first, their links are joined to components, and only pairs of one list that are in
different components are probed afterwards, which leaves out no link between components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, left_join_groups, maybe_broadcast, small, text_of, written
from .components import connected_components

#: A list up to this long makes all its pairs at once.
SHORT_LIST = 8
#: In a longer list, the next entries that each is tried with at first.
NEIGHBOURS = 4
#: Texts that hold an n-gram before its frequency is told to all tasks, at least; and n-grams told at most (20 MB).
FREQUENT = 24
MAX_FREQUENT = 4_000_000
#: Entries of a long list that a task compares with as many others.
BLOCK = 20_000
#: N-grams and postings that one bucket holds on average.
COUNTED = 6_000_000
POSTINGS = 600_000
#: Bits of a set's sketch, and of one over LARGE members. The larger folds to the smaller.
SKETCH_BITS = 1024
LARGE_BITS = 16_384
LARGE = 1_200
#: Bytes of text that are hashed at once.
SLICE_BYTES = 1 << 20
#: Logarithm of how many texts hold an n-gram whose list is cut into parts of about so many; and of a part's entries, one in
#: how many stands for its list in all other parts.
HOT_LEVEL = 17
ANCHOR = 512

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype="u8") | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_ORDER = _RANDOM.integers(1, 1 << 63, 16, dtype="u8") | np.uint64(1)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        _powers[:] = [np.cumprod(np.full(size, b, "u8"), dtype="u8") for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sets_of_bytes(parts: list[bytes], n: int) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    separator = _SEPARATOR[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], separator]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]  # of words: the last byte is a separator
    power, inverse = _power(len(data) + 1)
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum(_BYTE[data] * power[: len(data)], dtype="u8")])
    words = mix((total[ends] - total[starts]) * inverse[starts])
    bounds = np.cumsum([len(p) + 1 for p in parts])
    last = np.searchsorted(starts, bounds)  # of each text, the words before its end
    grams = np.zeros(max(0, len(words) - n + 1), "u8")
    for k in range(n):
        grams += words[k : len(words) - n + 1 + k] * _ORDER[k] if len(grams) else grams
    grams = mix(grams)
    out, first = [], 0
    for end in last.tolist():
        count = end - first
        if count >= n:
            own = np.sort(grams[first : end - n + 1])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            out.append(own[keep])
        elif count:  # the whole sequence, told from n-grams by its length
            out.append(mix(np.array([sum(int(words[first + k]) * int(_ORDER[k]) for k in range(count)) + count & 0xFFFFFFFFFFFFFFFF], "u8")))
        else:
            out.append(np.zeros(0, "u8"))
        first = end
    return out


def shingle_sets(texts: list[str], n: int):
    """Per text the sorted set of its word n-grams; only A-Z are lower-cased, words lie between ASCII white space."""
    parts: list[bytes] = []
    size = 0
    for text in texts:
        parts.append(text.encode().lower())
        size += len(parts[-1])
        if size >= SLICE_BYTES:
            yield from _sets_of_bytes(parts, n)
            parts, size = [], 0
    if parts:
        yield from _sets_of_bytes(parts, n)


def node_of(grams: np.ndarray) -> int:
    """A name for the set: a sum of mixed members."""
    return int((mix(grams + np.uint64(len(grams))).sum(dtype="u8")).astype("i8"))


def sketch_of(grams: np.ndarray) -> bytes:
    """The parity of the members in each cell: two sketches differ in no more bits than their sets in members."""
    bits = LARGE_BITS if len(grams) > LARGE else SKETCH_BITS
    cell = mix(grams ^ np.uint64(0x27D4EB2F165667C5)) % np.uint64(bits)
    return np.packbits(np.bincount(cell.astype(np.int64), minlength=bits) & 1).tobytes()


def fold(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of SKETCH_BITS bits in 64-bit words."""
    out = np.empty((len(sketches), SKETCH_BITS // 64), "<u8")
    for i, x in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, "<u8").reshape(-1, SKETCH_BITS // 64), axis=0)
    return out


def sketches_differ(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many bits each pair differs, at the finer of the sizes that both have."""
    differ = np.empty(len(x), np.int64)
    large = np.array([len(a) == len(b) == LARGE_BITS // 8 for a, b in zip(x, y, strict=True)], bool)
    for i in np.flatnonzero(large):
        differ[i] = np.bitwise_count(np.frombuffer(x[i], "<u8") ^ np.frombuffer(y[i], "<u8")).sum()
    rest = np.flatnonzero(~large)
    differ[rest] = np.bitwise_count(fold([x[i] for i in rest]) ^ fold([y[i] for i in rest])).sum(1)
    return differ


def _required(size: int, percent: int) -> int:
    """The least overlap with any set that is similar enough: its n-grams beyond this number form the short lists."""
    return -(-percent * size // 100)


def _texts(batch, column: int):
    """Lists of row numbers and texts, each of about a slice."""
    rows: list[int] = []
    texts: list[str] = []
    size = 0
    for i, text in enumerate(batch.column(column)):
        rows.append(i)
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= SLICE_BYTES:
            yield rows, texts
            rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _nodes(rows: DataFrame, n: int) -> DataFrame:
    """_id, n_shingles, node and sketch of every row; the last two are null for an empty set."""

    def run(batches):
        for batch in batches:
            sizes, nodes, sketches = [], [], []
            for _, texts in _texts(batch, 1):
                for grams in shingle_sets(texts, n):
                    sizes.append(len(grams))
                    nodes.append(node_of(grams) if len(grams) else None)
                    sketches.append(sketch_of(grams) if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary())], names=["_id", "n_shingles", "node", "sketch"])

    return rows.mapInArrow(lean(run), f"_id {rows.schema['_id'].dataType.simpleString()}, n_shingles long, node long, sketch binary")


def _pack(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as the planes of their differences, compressed."""
    import zstandard

    d = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype="u4")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers among sorted ones, and how often each occurs."""
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
    return values[at], np.diff(np.append(at, len(values)))


def _frequent(rows: DataFrame, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (first 32 bits, sorted) that many texts hold, and the logarithm of how many.

    All texts are counted, by a shuffle of sorted, compressed hashes; each is sent once for some millions, with its
    count, so that an n-gram of all texts is a few numbers in its bucket. The order they give needs only to be the same
    everywhere, so what a bound leaves out or two n-grams with one hash cost time, not results.
    """
    buckets = max(16, total // COUNTED)
    width = -(-(1 << 32) // buckets)

    def deal(batches):
        held, size = [], 0

        def flush():
            all_ = np.concatenate(held)
            held.clear()  # not twice in memory
            all_.sort()
            values, times = _runs(all_)
            cuts = np.searchsorted(values, np.arange(1, buckets, dtype="u8") * np.uint64(width))
            parts = [(k, v, t - 1) for k, (v, t) in enumerate(zip(np.split(values, cuts), np.split(times, cuts), strict=True)) if len(v)]
            columns = [_pack(v) for _, v, _ in parts], [_pack(v[t > 0]) for _, v, t in parts], [_pack(np.cumsum(t[t > 0], dtype="u4")) for _, _, t in parts]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in parts], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "blob", "again", "times"])

        for batch in batches:
            for _, texts in _texts(batch, 1):
                for grams in shingle_sets(texts, n):
                    held.append((grams >> np.uint64(32)).astype("u4"))
                    size += len(grams)
                    if size >= 4 * COUNTED // 3:
                        yield flush()
                        held, size = [], 0
        if size:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        values, counts = _runs(np.sort(np.concatenate([_unpack(b.as_py()) for b in table.column("blob")])))
        again = np.concatenate([_unpack(b.as_py()) for b in table.column("again")])
        times = np.concatenate([np.diff(_unpack(b.as_py()), prepend=np.uint32(0)) for b in table.column("times")])
        counts = counts + np.bincount(np.searchsorted(values, again), weights=times, minlength=len(values)).astype("i8")
        keep = counts >= FREQUENT
        found, level = values[keep], np.log2(counts[keep]).astype("u1")
        levels = [int(x) for x in np.unique(level)]
        return pa.table({"level": pa.array(levels, pa.int32()), "n": pa.array([int((level == x).sum()) for x in levels], pa.int64()), "grams": pa.array([found[level == x].astype("<u4").tobytes() for x in levels], pa.binary())})

    counted = written(rows.mapInArrow(lean(deal), "bucket int, blob binary, again binary, times binary").groupBy("bucket").applyInArrow(count, "level int, n long, grams binary"), "frequent")
    room, least = MAX_FREQUENT, 99
    for level, m in counted.groupBy("level").agg(F.sum("n")).orderBy(F.desc("level")).collect():
        if m > room:
            break
        room, least = room - m, level
    grams, levels = [np.zeros(0, "u4")], [np.zeros(0, "u1")]
    for level, blob in counted.filter(F.col("level") >= least).select("level", "grams").toLocalIterator():  # at most MAX_FREQUENT
        grams.append(np.frombuffer(blob, "<u4"))
        levels.append(np.full(len(grams[-1]), level, "u1"))
    grams, levels = np.concatenate(grams), np.concatenate(levels)
    order = np.argsort(grams)
    return grams[order], levels[order]


_POSTING = [("gram", "<u8"), ("node", "<i8"), ("size", "<u4"), ("like", "<u4")]


def _in_parts(postings: np.ndarray, level: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Postings of hot n-grams and their buckets, from buckets on: a list's part by node, some nodes in all parts."""
    parts = np.uint64(1) << (level.astype("u8") - np.uint64(HOT_LEVEL) + np.uint64(1))
    name = mix(postings["node"].astype("u8"))
    part = name % parts
    anchors = np.flatnonzero(mix(name ^ np.uint64(0x2545F4914F6CDD1D)) % (parts * np.uint64(ANCHOR)) == 0)
    all_ = np.concatenate([np.arange(len(postings)), np.repeat(anchors, parts[anchors].astype("i8"))])
    part = np.concatenate([part, *(np.arange(parts[i], dtype="u8") for i in anchors)])
    return postings[all_], (np.uint64(buckets) + (mix(postings["gram"][all_]) % np.uint64(buckets) + part) % np.uint64(buckets)).astype("i4")


def _short_lists(rows: DataFrame, n: int, percent: int, total: int, frequent) -> DataFrame:
    """Postings of each node's rarest n-grams, in blobs by bucket of n-grams. A partition names a node once.

    The list of an n-gram told to be in 2^HOT_LEVEL texts or more is dealt in parts by node, so that no task gets all of it;
    each part counts as a long list, whatever its length, which leaves the pairs of different parts to the comparison of
    long lists. A few nodes lie in all parts: what is like them becomes one component through them. An n-gram that is
    not told is in fewer than FREQUENT texts, or 2 * total / MAX_FREQUENT.
    """
    buckets = max(16, total * (100 - percent) // 100 // POSTINGS)
    told = rows.sparkSession.sparkContext.broadcast(frequent)  # at most MAX_FREQUENT of 5 bytes

    def rarest(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(grams) - _required(len(grams), percent) + 1
        if not len(told.value[0]):
            return grams[:size], np.zeros(size, "u1")
        short = (grams >> np.uint64(32)).astype("u4")
        at = np.minimum(np.searchsorted(told.value[0], short), len(told.value[0]) - 1)
        level = np.where(told.value[0][at] == short, told.value[1][at], 0)
        order = np.argsort(level, kind="stable")[:size] if level[:size].any() else slice(size)
        return grams[order], level[order]

    def deal(batches):
        seen: set[int] = set()
        held, levels, size = [], [], 0

        def flush():
            all_, level = np.concatenate(held), np.concatenate(levels)
            held.clear()
            levels.clear()
            bucket = (all_["gram"] % np.uint64(buckets)).astype("i4")
            hot = np.flatnonzero(level >= HOT_LEVEL)
            if len(hot):
                more, moved = _in_parts(all_[hot], level[hot], buckets)
                cool = level < HOT_LEVEL
                all_, bucket = np.concatenate([all_[cool], more]), np.concatenate([bucket[cool], moved])
            order = np.argsort(bucket, kind="stable")
            all_, bucket = all_[order], bucket[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array([p.tobytes() for p in np.split(all_, at[1:])], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for _, texts in _texts(batch, 1):
                for grams in shingle_sets(texts, n):
                    node = node_of(grams) if len(grams) else None
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    own, level = rarest(grams)
                    postings = np.empty(len(own), _POSTING)
                    postings["gram"], postings["node"], postings["size"] = own, node, len(grams)
                    postings["like"] = mix(grams ^ np.uint64(0x5851F42D4C957F2D)).min() >> np.uint64(32)
                    held.append(postings)
                    levels.append(level)
                    size += len(own)
                    if size >= 2 * POSTINGS:
                        yield flush()
                        held, levels, size = [], [], 0
        if size:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        p = np.concatenate([np.frombuffer(b.as_py(), _POSTING) for b in table.column("blob")])
        hot = table.column("bucket")[0].as_py() >= buckets
        if not hot:
            p = p[np.argsort(p["gram"], kind="stable")]
            same = p["gram"][1:] == p["gram"][:-1]
            p = p[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # lists of one end here
        p = p[np.lexsort((p["node"], p["size"], p["like"], p["gram"]))]
        if len(p):
            p = p[np.concatenate([[True], (p["gram"][1:] != p["gram"][:-1]) | (p["node"][1:] != p["node"][:-1])])]
        at = np.flatnonzero(np.concatenate([[True], p["gram"][1:] != p["gram"][:-1]])) if len(p) else np.zeros(0, int)
        length = np.repeat(np.diff(np.append(at, len(p))), np.diff(np.append(at, len(p)))) if not hot else np.full(len(p), SHORT_LIST + 1)
        pairs = []
        for step in range(1, SHORT_LIST):
            near = (p["gram"][step:] == p["gram"][:-step]) & ((length[step:] <= SHORT_LIST) | (step <= NEIGHBOURS))
            a, b = p[:-step][near], p[step:][near]
            low, high = np.minimum(a["size"], b["size"]), np.maximum(a["size"], b["size"])
            fits = (100 * low.astype("i8") >= percent * high.astype("i8")) & (a["node"] != b["node"])
            pairs.append(np.stack([np.minimum(a["node"], b["node"])[fits], np.maximum(a["node"], b["node"])[fits]], 1))
        found = np.unique(np.concatenate(pairs), axis=0)
        long = p[length > SHORT_LIST] if len(p) else p
        none = pa.nulls(len(found), pa.int64())
        return pa.table({
            "a": pa.concat_arrays([pa.array(found[:, 0]), pa.array(long["node"])]),
            "b": pa.concat_arrays([pa.array(found[:, 1]), pa.nulls(len(long), pa.int64())]),
            "gram": pa.concat_arrays([none, pa.array(long["gram"].astype("i8"))]),
            "size": pa.concat_arrays([none, pa.array(long["size"].astype("i8"))]),
        })

    return written(rows.mapInArrow(lean(deal), "bucket int, blob binary").groupBy("bucket").applyInArrow(merge, "a long, b long, gram long, size long"), "short-lists")


def _plausible(first: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b without those whose sketches prove that their sets differ in too many members."""

    def run(batches):
        for batch in batches:
            m, k = (batch.column(i).to_numpy() for i in (2, 4))
            differ = sketches_differ(batch.column(3).to_pylist(), batch.column(5).to_pylist())
            # |A xor B| is |A| + |B| - 2 overlap, and overlap * (100 + percent) >= percent * (|A| + |B|)
            keep = (100 + percent) * differ <= (100 - percent) * (m + k)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))

    x = first.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("x"))
    y = first.select(F.col("node").alias("b"), F.col("size").alias("k"), F.col("sketch").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "m", "x", "k", "y").mapInArrow(lean(run), "a long, b long")


def _across(lists: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of one list and different components (gram, node, size, root) that sizes and sketches allow.

    Only such pairs become rows. A list is cut into blocks of about BLOCK entries, and a task compares two of them.
    """
    mixed = lists.groupBy("gram").agg(F.min("root").alias("_r"), F.max("root").alias("_s"), F.count(F.lit(1)).alias("_m")).filter("_r <> _s")
    blocks = F.ceil(F.col("_m") / BLOCK).cast("int")
    mixed = written(mixed.select("gram", "_m", blocks.alias("_blocks")), "mixed")
    rows = left_join_groups(lists, mixed, ["gram"], "_m").filter("_m IS NOT NULL").join(first.select("node", "sketch"), "node")
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("gram", F.least("_block", "_other").alias("low"), F.greatest("_block", "_other").alias("high"), "_block", "node", "size", "root", "sketch")
    keys = ["gram", "low", "high"]

    def compare(part: np.ndarray, block: np.ndarray, node: np.ndarray, size: np.ndarray, root: np.ndarray, sketch: np.ndarray):
        order = np.argsort(size, kind="stable")
        block, node, size, root, sketch = block[order], node[order], size[order], root[order], sketch[order]
        within = part[1] == part[2]
        # of each row, the rows before it that are large enough
        first_fit = np.searchsorted(size, -(-percent * size // 100))
        step = max(1, (1 << 18) // max(1, len(node)))
        for at in range(0, len(node), step):
            end = min(at + step, len(node))
            low = int(first_fit[at])
            differ = np.bitwise_count(sketch[at:end, None] ^ sketch[None, low:end]).sum(2, dtype=np.int64)
            allowed = (100 - percent) * (size[at:end, None] + size[None, low:end])
            index = np.arange(low, end)[None, :]
            fits = ((100 + percent) * differ <= allowed) & (index < np.arange(at, end)[:, None]) & (index >= first_fit[at:end, None]) & (root[at:end, None] != root[None, low:end])
            if not within:
                fits &= block[at:end, None] != block[None, low:end]
            i, j = np.nonzero(fits)
            x, y = node[i + at], node[j + low]
            yield np.minimum(x, y), np.maximum(x, y)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table):
            part = np.stack([table.column(c).to_numpy() for c in range(3)], 1)
            values = [table.column(c).to_numpy() for c in range(3, 7)]
            sketch = fold(table.column(7).to_pylist())
            cuts = np.flatnonzero((part[1:] != part[:-1]).any(1)) + 1
            found = [pair for at, end in zip([0, *cuts], [*cuts, len(part)], strict=True) for pair in compare(part[at], *(v[at:end] for v in values), sketch[at:end])]
            pairs = np.unique(np.stack([np.concatenate([f[i] for f in found]) for i in (0, 1)], 1), axis=0)  # lists share pairs
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:  # sorted: a group may go on in the next batch
            if not batch.num_rows:
                continue
            part = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            last = int(np.argmax((part == part[-1]).all(1)))
            if held and (np.array([held[-1].column(c)[-1].as_py() for c in range(3)]) != part[-1]).any() or last:
                yield from flush(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from flush(pa.Table.from_batches(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), "a long, b long")


def _probe(rows: DataFrame, first: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs a, b of nodes whose overlap reaches what their sizes require, counted by binary search."""
    pairs = written(_plausible(first, pairs, percent), "candidates")
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(first.select("node", "_first").join(wanted, "node").select(F.col("_first").alias("_key"), F.col("node").alias("_node")), "wanted")

    def hold(batches):
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            for which, texts in _texts(batch, 1):
                out = [(nodes[i], g.astype("<u8").tobytes()) for i, g in zip(which, shingle_sets(texts, n), strict=True) if len(g) and node_of(g) == nodes[i]]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["node", "grams"])

    # one text a node; an id that several texts have brings in others, which hold drops
    sets = rows.withColumn("_key", F.xxhash64("_id")).join(maybe_broadcast(wanted), "_key").select("_node", "_text").mapInArrow(lean(hold), "node long, grams binary")
    sets = written(sets.dropDuplicates(["node"]), "sets")

    def probe(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                short, long = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(long, short)
                overlap = int((long[np.minimum(at, len(long) - 1)] == short).sum())
                keep.append(100 * overlap >= percent * (len(x) + len(y) - overlap))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    return written(joined.select("a", "b", "x", "y").mapInArrow(lean(probe), "a long, b long"), "links")


def ngram_join(docs: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id of every row: the smallest id that links of similarity percent / 100 reach.

    Texts with fewer than n words are one n-gram; those without words, null and empty ones among them, link with
    nothing and are their own component. Rows with equal sets are one component at any size. Null ids come after all
    others in a component; repeated rows are separate rows of one component. An empty table gives no rows. Other
    columns are not read. docs is read several times and must give the same rows, as a table does.

    Nodes are 64-bit names of sets: two different sets share one with a chance of about N^2 / 2^65.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    nodes = written(_nodes(rows, n), "nodes")
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    if not total:
        return nodes.select(F.col("_id").alias(id_col), "n_shingles", F.col("_id").alias("component_id"))
    first = nodes.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.xxhash64("_id")).alias("_first"), F.max("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("_n"))
    first = written(first, "sketches")
    lists = _short_lists(rows, n, percent, total, _frequent(rows, n, total))

    pairs = lists.filter("b IS NOT NULL").select("a", "b").distinct()
    links = _probe(rows, first, pairs, n, percent)
    parts = connected_components(links)
    long = lists.filter("b IS NULL").select(F.col("a").alias("node"), "gram", "size")
    if not small(long, 0):
        named = long.join(parts, "node", "left").select("gram", "node", "size", F.coalesce("root", "node").alias("root"))
        named = written(named, "long-lists")
        across = _across(named, first, percent).distinct().join(written(pairs, "tried"), ["a", "b"], "left_anti")
        across = written(across, "across")
        if not small(across, 0):
            links = links.unionAll(_probe(rows, first, across, n, percent))
            parts = connected_components(links)
    linked = written(parts.join(first.select("node", "_n"), "node"), "linked")
    placed = left_join_groups(nodes.filter("node IS NOT NULL").select("_id", "n_shingles", "node"), linked, ["node"], "_n")
    placed = written(placed.select("_id", "n_shingles", F.coalesce("root", "node").alias("_root")), "placed")
    least = written(placed.groupBy("_root").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_m")).filter("_m > 1"), "least")
    found = left_join_groups(placed, least, ["_root"], "_m")  # a component may hold a third of all rows
    found = found.select(F.col("_id").alias(id_col), "n_shingles", F.when(F.col("_m").isNull(), F.col("_id")).otherwise(F.col("_least")).alias("component_id"))
    empty = nodes.filter("node IS NULL").select(F.col("_id").alias(id_col), "n_shingles", F.col("_id").alias("component_id"))
    return found.unionAll(empty)
