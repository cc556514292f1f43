"""Benchmark decontamination with a generalised suffix automaton over the words of test items."""

from __future__ import annotations

import hashlib
import pickle
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, scratch, text_of

#: Words an automaton holds. A larger benchmark is cut at items into several, used one after another from the shared folder.
AUTOMATON_WORDS = 200_000
#: The same words in a text whose letters keep their case.
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
#: Lower-cases A-Z and turns every ASCII byte that no word holds into a space; bytes from 0x80 on belong to words.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split() if text else []


class Automaton:
    """States of a generalised suffix automaton, and for each state which items a match there brings in."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, list[int]]] = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            state, states = 0, []
            for x in ids:
                state = self._extend(state, x)
                states.append(state)
            ends.append((len(ends), states))
        self.items = [item for item, _ in items]
        self.least = min([window, *(len(w) for _, w in items if w)])
        #: state -> [(words a match must have, items)]
        self.found: list[list[tuple[int, frozenset[int]]]] = [[] for _ in self.link]
        at: dict[tuple[int, int], set[int]] = {}
        for k, states in ends:
            need = min(window, len(states))
            for end, state in enumerate(states):
                if end + 1 < need:
                    continue
                while self.length[self.link[state]] >= need:  # up to the state of the suffix of need words
                    state = self.link[state]
                at.setdefault((state, need), set()).add(k)
        for (state, need), found in at.items():
            self.found[state].append((need, frozenset(found)))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.found[state] = self.found[state] + self.found[self.link[state]] if self.found[self.link[state]] else self.found[state]

    def _extend(self, last: int, x: int) -> int:
        """Add word x after state last; words added before are kept, so items may share states."""
        nxt, link, length = self.next, self.link, self.length
        if x in nxt[last] and length[nxt[last][x]] == length[last] + 1:
            return nxt[last][x]
        made = None
        if x not in nxt[last]:
            made = self._new(length[last] + 1, {})
        p = last
        while p >= 0 and x not in nxt[p]:
            nxt[p][x] = made
            p = link[p]
        if p < 0:
            link[made] = 0
            return made
        q = nxt[p][x]
        if length[q] != length[p] + 1:
            copy = self._new(length[p] + 1, dict(nxt[q]))
            link[copy], link[q] = link[q], copy
            while p >= 0 and nxt[p].get(x) == q:
                nxt[p][x] = copy
                p = link[p]
            q = copy
        if made is None:
            return q
        link[made] = q
        return made

    def _new(self, length: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def scan(self, words: list[bytes], hit: np.ndarray, items: set) -> None:
        """Stream words, keep the length of the longest match that ends at each, and mark what is in a window."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), "i4", len(words))
        # a match needs that many known words in a row; only such stretches reach the automaton
        known = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]])))
        for a, b in zip(known[::2], known[1::2], strict=True):
            if b - a < self.least:
                continue
            state = size = 0
            for i, x in enumerate(ids[a:b].tolist(), int(a)):
                while state and x not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                if x in self.next[state]:
                    state, size = self.next[state][x], size + 1
                for need, found in self.found[state]:
                    if size >= need:
                        hit[i + 1 - need : i + 1] = True
                        items.update(self.items[k] for k in found)


def _chunks(items: DataFrame, id_col: str, text_col: str, window: int, limit: int):
    part, words = [], 0
    for row in items.select(F.col(id_col), text_of(text_col)).toLocalIterator():
        own = words_of(row[1])
        if own and part and words + len(own) > limit:
            yield Automaton(part, window)
            part, words = [], 0
        if own:
            part.append((row[0], own))
            words += len(own)
    if part:
        yield Automaton(part, window)


def _automata(items: DataFrame, id_col: str, text_col: str, window: int, limit: int):
    """A function that yields the automata in a worker, and whether there are several: one is broadcast, of a checked size; several lie in
    the shared folder."""
    import pyarrow.fs

    spark = items.sparkSession
    made = _chunks(items, id_col, text_col, window, limit)
    first, second = next(made, None), next(made, None)
    if second is None:
        held = spark.sparkContext.broadcast(pickle.dumps([first] if first else []))
        return _from_broadcast(held), False
    folder, paths = scratch(spark, "automata"), []
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    for automaton in (first, second, *made):
        paths.append(f"{root}/{len(paths)}")
        with fs.open_output_stream(paths[-1]) as out:
            out.write(pickle.dumps(automaton))

    def load():
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for path in paths:
            with fs.open_input_file(path) as f:
                yield pickle.loads(f.read())

    return load, True


def _from_broadcast(held):
    made: list = []

    def load():
        if not made:
            made.append(pickle.loads(held.value))
        yield from made[0]

    return load


def _scan_batches(load, ids: list, texts: list):
    """Per text: its words, hits and items. Automata change in the outer loop, so one is in memory at a time."""
    words = [words_of(t) for t in texts]
    hits = [np.zeros(len(w), bool) for w in words]
    items: list[set] = [set() for _ in words]
    for automaton in load():
        for w, h, found in zip(words, hits, items, strict=True):
            if len(w) >= automaton.least:
                automaton.scan(w, h, found)
    return zip(ids, words, hits, items, strict=True)


#: Texts whose words are in memory at once, where one automaton is held; and bytes of texts, where several are read in turn.
SLICE = 256
SLICE_BYTES = 16 << 20


def _slices(batches, column: int, several: bool):
    """The rows in batches of SLICE texts, or, so that automata are read once for many texts, of about SLICE_BYTES."""
    held, size = [], 0
    for batch in batches:
        if not several:
            yield from (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE))
            continue
        ends = pc.cumulative_sum(pc.cast(pc.coalesce(pc.binary_length(batch.column(column)), 0), pa.int64())).to_numpy()
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = min(batch.num_rows, int(np.searchsorted(ends, before + SLICE_BYTES - size)) + 1)
            held.append(batch.slice(at, end - at))
            size += int(ends[end - 1]) - before
            at = end
            if size >= SLICE_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if size or any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit, items (sorted as strings), coverage.

    A word is hit if it lies in an occurrence of window consecutive words of one item, or of a whole item that has
    fewer. Null and empty texts have no words; items without words match nothing; a null item id is given as ''.
    Repeated rows are separate; equal items are all listed. Empty tables give no rows, or no hits.
    Only the columns named are read.
    """
    load, several = _automata(items, item_id, item_text, window, automaton_words)

    def scan(batches):
        for part in _slices(batches, 1, several):
            rows = [
                (i, len(w), int(h.sum()), sorted({"" if x is None else str(x) for x in found}))
                for i, w, h, found in _scan_batches(load, part.column(0).to_pylist(), part.column(1).to_pylist())
            ]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], part.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.string()))],
                names=[id_col, "n_words", "n_hit", "items"],
            )

    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    out = rows.mapInArrow(scan, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_words long, n_hit long, items array<string>")
    return out.withColumn("coverage", F.try_divide("n_hit", "n_words"))


def _cut(text: str, hit: np.ndarray) -> str:
    """text without its hit words and what lies between two hit neighbours."""
    kept, last, inside = [], 0, False
    for m, bad in zip(WORD.finditer(text), hit, strict=True):
        if bad and not inside:
            kept.append(text[last : m.start()])
        if bad:
            last = m.end()
        inside = bool(bad)
    kept.append(text[last:])
    return "".join(kept)


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """docs without the spans that items have: same columns, text_col changed where it had hits.

    A row whose words are hit to more than max_coverage goes as a whole. Removing a span can bring its neighbours
    together, so a changed text is scanned again until nothing is hit. Rows without hits, among them null and empty
    texts, stay as they are.
    """
    load, several = _automata(items, item_id, item_text, window, automaton_words)
    at = docs.columns.index(text_col)
    schema = docs.schema

    def clean(batches):
        for part in _slices(batches, at, several):
            texts = part.column(at).to_pylist()
            todo, dropped = list(range(len(texts))), set()
            first = True
            while todo:
                again = []
                for i, words, hit, _ in _scan_batches(load, todo, [texts[i] for i in todo]):
                    if hit.any():
                        if first and hit.sum() > max_coverage * len(words):
                            dropped.add(i)
                        else:
                            texts[i] = _cut(texts[i], hit)
                            again.append(i)
                todo, first = again, False
            part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
            yield part.filter(pa.array([i not in dropped for i in range(len(texts))]))

    return docs.mapInArrow(lean(clean), schema)


def items_digest(items):
    """Column: lowercase hex SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.concat_ws(",", items), 256)


EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
