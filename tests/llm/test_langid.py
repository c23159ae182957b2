from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np

from stripmill.llm import langid

WORDS = {"xx": "thoran dele mith ander wes".split(), "yy": "ouvé leaux quer énto bair".split(), "zz": "schen ützer gekeit lich von".split()}
SCHEMA = "doc_id long, text string, lang string, score double"


def corpus(n=300):
    rng = random.Random(4)
    return [(k, " ".join(rng.choices(WORDS[lang], k=rng.randrange(1, 60))), lang, 0.5) for k in range(n) for lang in [rng.choice(sorted(WORDS))]]


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus() + [(1000, None, "xx", 0.0), (1001, "", "xx", 0.0), (1002, "12 34 !!", "yy", 0.0), (None, "von lich", "zz", 0.0), (1003, "von lich", None, 0.0), (5, rows_text := corpus()[5][1], None, 0.0), (1004, "漢字", None, 0.0)]
    got = langid.predicted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3
    assert by[None].lang_pred == by[1003].lang_pred == "zz" and not by[None].held_out
    assert by[1004].lang_pred in WORDS and by[1004].score == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    truth = {d: lang for d, _, lang, _ in corpus()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_learnt(spark):
    rows = [(d, t, "wrong" if zlib.crc32(str(d).encode()) % 4 == 2 else lang, s) for d, t, lang, s in corpus(80)]
    assert "wrong" not in {r.lang_pred for r in langid.predicted(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_no_labels_and_no_rows(spark):
    assert langid.predicted(spark.createDataFrame([], SCHEMA)).collect() == []
    (one,) = langid.predicted(spark.createDataFrame([(1, "some words", None, 0.0)], SCHEMA)).collect()
    assert (one.lang_pred, one.score) == ("und", 0.0)


def test_filters_have_no_false_negatives_and_many_languages():
    rng = np.random.default_rng(0)
    hashes = langid.grams("abcdefghijklmnop")
    masks = rng.integers(0, 2**63, (len(hashes), 2)).astype(np.uint64)
    filters = langid.Filters([f"l{k}" for k in range(100)], hashes, masks)
    for word, table in enumerate(filters.tables):
        found = np.bitwise_and.reduce([table[at] for at in langid._positions(hashes, len(table))])
        assert ((found & masks[:, word]) == masks[:, word]).all()
    assert len(filters.counts("abcdef")) == 100


def test_known_documents_are_in_a_learnt_language(spark):
    learnt = corpus()
    foreign = [(9000, "Быстрая лиса, 12, прыгает через ленивую собаку. " * 20, None, 0.0), (9001, "犬, 12. 猫, 34. " * 30, None, 0.0)]
    kept = {r.doc_id for r in langid.known_documents(spark.createDataFrame(learnt + foreign, SCHEMA)).collect()}
    assert kept == {d for d, *_ in learnt}


def plain_sets(rows):
    """For each language, most frequent first, the n-grams that it contains, by the rules but without hashes and filters."""
    learnt = [(t, lang) for d, t, lang, _ in rows if lang and t is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    count = Counter(lang for _, lang in learnt)
    languages = sorted(count, key=lambda x: (-count[x], x))
    n = {lang: Counter() for lang in languages}
    for t, lang in learnt:
        n[lang].update(plain_grams(t))
    total = Counter()
    for lang in languages:
        total.update(n[lang])
    kept = {g for g, k in total.items() if k >= langid.LEAST_COUNT}
    size = {lang: sum(k for g, k in n[lang].items() if g in kept) for lang in languages}
    rate = {g: {lang: n[lang][g] / max(1, size[lang]) for lang in languages} for g in kept}
    return languages, {lang: {g for g, r in rate.items() if r[lang] and r[lang] >= langid.SHARE * max(r.values())} for lang in languages}


def plain_grams(text):
    text = f" {text.lower()} "
    return [text[k : k + n] for n in langid.LENGTHS for k in range(len(text) - n + 1)]


def test_against_plain_sets(spark):
    rows = corpus(200)
    languages, sets = plain_sets(rows)
    filters = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert filters.languages == languages
    rng = random.Random(3)
    every = [w for words in WORDS.values() for w in words]
    texts = [t for _, t, *_ in rows[:60]] + [" ".join(rng.choices(every, k=30)) for _ in range(60)] + ["thoran " * 100_000, "neither known nor near"]
    sure = 0
    for t in texts:
        exact = np.array([sum(g in sets[lang] for g in plain_grams(t)) for lang in languages])
        found = filters.counts(t)
        noise = 3 + 0.05 * len(t)
        assert np.abs(exact - found).max() <= noise
        first, second = sorted(exact)[-1:-3:-1]
        if first - second > 2 * noise:
            sure += 1
            assert filters.predict(t)[0] == languages[int(exact.argmax())]
    assert sure > 60


def test_ties_numerals_and_long_texts(spark):
    rows = [(k, "same words here", lang, 0.0) for k, lang in enumerate(["bb", "aa"] * 40)]
    extra = [(1000, "\u00bd \u00b2 \u2167", "aa", 0.0), (1001, "same words here " * 50_000, None, 0.0)]
    got = {r.doc_id: r for r in langid.predicted(spark.createDataFrame(rows + extra, SCHEMA)).collect()}
    count = Counter(lang for d, _, lang, _ in rows + extra if lang and zlib.crc32(str(d).encode()) % 4 != 2)
    first = min(count, key=lambda x: (-count[x], x))  # the more frequent language, then the first by name
    assert got[0].lang_pred == got[1].lang_pred == got[1001].lang_pred == first
    assert (got[1000].lang_pred, got[1000].score) == ("und", 0.0)
