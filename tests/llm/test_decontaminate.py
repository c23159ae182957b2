from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stripmill.llm import decontaminate as dc

SCHEMA = "doc_id long, text string, item_id string, edits int"


def slow_edits(item, text):
    """Fewest edits that turn item into any part of text."""
    row = [0] * (len(text) + 1)
    for r, c in enumerate(item, 1):
        new = [r]
        for k, t in enumerate(text, 1):
            new.append(min(row[k - 1] + (c != t), row[k] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=30))
def test_alignment(item, text):
    n = len(item) + len(text)
    got = dc.align(dc._points(item), dc._points(text), -n, n, n)
    best = slow_edits(item, text)
    assert got[2] == best
    start, end, _ = got
    assert 0 <= start <= end <= len(text) and slow_edits(item, text[start:end]) == best
    low = dc.align(dc._points(item), dc._points(text), -n, n, best)
    assert low is not None and low[2] == best


def corpus():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeéfgh", k=rng.randrange(2, 8))) for _ in range(80)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, say(rng.randrange(8, 50)).capitalize() + ".") for k in range(12)]
    docs = []
    for k in range(150):
        text = say(rng.randrange(0, 200))
        if k % 3 == 0:
            t = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 1, 2, 4, 8, 30])):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice(["", "z", t[at] + "y"])
            text += " \n*" + "".join(t).upper() + " * " + say(rng.randrange(50))
        docs.append((k, text))
    return items, docs


def test_against_brute_force(spark):
    items, docs = corpus()
    odd = [(900, None), (901, ""), (902, "x"), (903, "y " * 3000 + items[3][1]), (903, "y " * 3000 + items[3][1]), (None, items[0][1])]
    index = dc.Index([(i, dc.normal(t)) for i, t in items])
    want = set()
    for d, t in docs:
        for k, (i, item) in enumerate(items):
            e = slow_edits(dc.normal(item), dc.normal(t))
            if e <= index.edits[k]:
                want.add((d, i, e))
    assert len(want) > 20
    table = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs + odd], SCHEMA)
    bench = spark.createDataFrame([*items, (50, None), (51, "too short"), (52, "")], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.edits) for r in dc.contaminated(table, bench).collect()]
    assert {g for g in got if g[0] is not None and g[0] < 900} == want
    assert sorted(str(g) for g in got if g[0] is None or g[0] >= 900) == ["(903, 3, 0)"] * 2 + ["(None, 0, 0)"]
    clean = dc.clean_documents(table, bench)
    assert clean.columns == table.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in docs} - {w[0] for w in want} | {900, 901, 902})


def test_slices_windows_and_empty_tables(spark, monkeypatch):
    items, docs = corpus()
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, dc.contaminated(table, bench).collect()))
    monkeypatch.setattr(dc, "INDEX_CHARS", 900)
    assert sorted(map(tuple, dc.contaminated(table, bench).collect())) == whole
    monkeypatch.setattr(dc, "WINDOW", 300)
    index = dc.Index([(i, dc.normal(t)) for i, t in items])
    assert sorted((d, i, *f) for d, t in docs for i, *f in index.found(t)) == whole
    assert dc.contaminated(table.limit(0), bench).collect() == dc.contaminated(table, bench.limit(0)).collect() == []
    assert dc.clean_documents(table, bench.limit(0)).count() == len(docs)
    assert np.all(index.bound > 0)


def test_short_items_are_found_verbatim(spark):
    docs = [(1, "Say Too, short! twice: too short."), (2, "too shortened"), (3, "x"), (4, "not at all"), (5, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(51, "too short"), (52, "X"), (53, " . "), (54, "too short")], "item_id long, text string")
    got = sorted(map(tuple, dc.contaminated(table, bench).collect()))
    assert got == [(1, 51, 4, 13, 0), (1, 54, 4, 13, 0), (3, 52, 0, 1, 0)]
    assert sorted(r.doc_id for r in dc.clean_documents(table, bench).collect()) == [2, 4, 5]


def test_long_repetitive_texts_take_bounded_time_and_memory():
    import time
    import tracemalloc

    index = dc.Index([(1, "q r s t u " + "a" * 300), (2, "a" * 300 + " v w x y z")])
    text = "b " + "a" * 300_000 + " " + "ab" * 100_000
    tracemalloc.start()
    began = time.perf_counter()
    found = index.found(text)
    assert time.perf_counter() - began < 60 and tracemalloc.get_traced_memory()[1] < 600 << 20
    tracemalloc.stop()
    assert [k for k, *_ in found] == [0, 1] and all(0 < e <= 31 for *_, e in found)


def test_matches_in_parts_give_the_same(monkeypatch):
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choices("ab", k=3)) for _ in range(n))
    items = [(k, say(20)) for k in range(6)]
    texts = [say(200) + " " + items[k % 6][1] + " " + say(100) for k in range(12)]
    index = dc.Index(items)
    whole = [index.found(t) for t in texts]
    monkeypatch.setattr(dc, "MATCHES", 50)
    assert [index.found(t) for t in texts] == whole and all(whole)
