import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm.decontaminate import EMPTY_DIGEST, Automaton, contamination, decontaminate, items_digest, words_of

import numpy as np

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(words, items, window):
    hit, found = [False] * len(words), set()
    for name, own in items:
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[k : k + n]:
                    hit[i : i + n] = [True] * n
                    found.add(name)
    return hit, found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", max_size=9), max_size=4), st.text("abcd", max_size=30), st.integers(1, 4))
def test_automaton_equals_brute_force(items, text, window):
    named = [(i, [bytes([c]) for c in x.encode()]) for i, x in enumerate(items)]
    words = [bytes([c]) for c in text.encode()]
    hit, found = np.zeros(len(words), bool), set()
    held = [x for x in named if x[1]]
    if held:
        Automaton(held, window).scan(words, hit, found)
    assert (hit.tolist(), found) == brute(words, named, window)


def test_words():
    text = "It's ÉCOLE 3x_y\n你好-mir Z"
    assert [w.decode() for w in words_of(text)] == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(LOW)) and words_of(None) == []


ITEM = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(10, ITEM), (2, "short item here"), (3, None), (4, " ?! "), (5, ITEM), (None, "null id item words")]
DOCS = [
    (1, f"clean start. {ITEM.upper()} and the end."), (2, "nothing of that kind at all"), (3, None), (4, ""), (5, "A short, item; here!"), (6, "one two three four five six seven eight nine"),
    (7, f"before the cut one two three four five {ITEM} six seven eight nine ten and after the cut " + "more clean words " * 20), (8, "short item her"), (9, "x null id item words y"), (9, "x null id item words y"), (None, "w " * 30_000 + ITEM),
]


@pytest.mark.parametrize("automaton_words", [1000, 10])
def test_contamination(spark, documents, automaton_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = contamination(documents(DOCS), items, automaton_words=automaton_words).withColumn("d", items_digest("items")).collect()
    assert len(rows) == len(DOCS)
    named = [("" if i is None else str(i), words_of(t)) for i, t in ITEMS]
    text = dict(DOCS)
    for r in rows:
        words = words_of(text[r["doc_id"]])
        hit, found = brute(words, named, 10)
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(words), sum(hit), sorted(found))
        assert (r["d"] == EMPTY_DIGEST) == (not found - {""})


def test_decontaminate(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(DOCS)
    rows = decontaminate(docs, items, max_coverage=0.5).collect()
    assert docs.columns == decontaminate(docs, items).columns
    got = {r["doc_id"]: r["text"] for r in rows}
    assert 1 not in got and 5 not in got  # mostly items
    assert got[2] == DOCS[1][1] and got[3] is None and got[4] == "" and got[6] == DOCS[5][1] and got[8] == "short item her"
    assert "eleven" not in got[7] and got[7].startswith("before the cut") and "and after the cut" in got[7] and got[None].strip() == "w " * 29_999 + "w"
    again = contamination(spark.createDataFrame(rows, docs.schema), items)
    assert again.filter("n_hit > 0").count() == 0


@pytest.mark.parametrize(("docs", "items"), [([], ITEMS), (DOCS, []), ([], [])])
def test_empty_tables(spark, documents, docs, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    assert contamination(documents(docs), table).filter("n_hit > 0").count() == 0
    assert decontaminate(documents(docs), table).count() == len(docs)
