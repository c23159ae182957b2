from __future__ import annotations

import random

import numpy as np
import pytest

from stripmill.llm import simhash

SCHEMA = "doc_id long, text string"


def jaccard(a, b):
    x, y = (set(zip(*(t.split()[k:] for k in range(5)))) for t in (a, b))
    return len(x & y) / len(x | y)


def fresh(rng, n):
    return [f"w{rng.getrandbits(40):x}" for _ in range(n)]


def slow_groups(rows):
    group = {d: d for d, _ in rows}
    for d, t in rows:
        for e, u in rows:
            if e < d and group[e] != group[d] and jaccard(t, u) >= 0.8:
                x, y = sorted((group[e], group[d]))
                group = {k: x if g == y else g for k, g in group.items()}
    return group


def pair(rng, least, most):
    """Two texts whose ends differ, at a similarity between the bounds."""
    while True:
        n = rng.randrange(60, 400)
        base, cut = fresh(rng, n), rng.randrange(1, n // 4)
        a, b = " ".join(base), " ".join(base[:-cut] + fresh(rng, rng.randrange(1, cut + 1)))
        if least <= jaccard(a, b) < most:
            return a, b


def test_pairs_at_the_threshold_are_met(spark):
    rng = random.Random(3)
    rows = [(2 * k + h, t) for k in range(200) for h, t in enumerate(pair(rng, 0.80, 0.85))]
    got = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_pairs_below_the_threshold_are_not_linked(spark):
    rng = random.Random(4)
    rows = [(2 * k + h, t) for k in range(200) for h, t in enumerate(pair(rng, 0.70, 0.80))]
    got = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {d: d for d, _ in rows}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 5])
def test_hot_family(spark, bucket):
    """Variants of one text at 0.6 to 0.95 to one another share bands; each pair counts, in whichever blocks."""
    rng = random.Random(5)
    base = fresh(rng, 120)
    rows = []
    for k in range(90):
        cut = rng.choice([2, 8, 14, 20, 26])
        at = rng.randrange(3) * 40
        rows.append((k, " ".join(base[:at] + fresh(rng, cut) + base[at + cut :])))
    want = slow_groups(rows)
    assert 3 < len(set(want.values())) < 80
    got = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows, SCHEMA), bucket=bucket).collect()}
    assert got == want


def test_null_and_repeated_ids_lose_no_text(spark):
    rng = random.Random(6)
    texts = [" ".join(fresh(rng, 50)) for _ in range(40)]
    rows = [(None if k % 2 else 7, t) for k, t in enumerate(texts)] + [(None, texts[0]), (7, texts[1]), (7, texts[2]), (None, texts[3])]
    got = [tuple(r) for r in simhash.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(t for _, t in got) == sorted(texts)
    assert {t: d for d, t in got} == {t: 7 if k % 2 == 0 or k == 1 else None for k, t in enumerate(texts)}


def test_similar_sets_against_all_pairs():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 25, 20).astype(np.uint64)) for _ in range(60)]
    label = simhash.similar_sets(sets, np.arange(60))
    group = list(range(60))
    for i in range(60):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) * 5 >= 4 * len(np.union1d(sets[i], sets[j])):
                x, y = sorted((group[i], group[j]))
                group = [x if g == y else g for g in group]
    assert list(label) == group


def test_fingerprints_link_candidates_without_bands(spark):
    """No node has a band key, so what is joined is joined by prints, directly or through others."""
    prints = spark.createDataFrame([(1, 0b1111), (2, 0b1100), (3, 0b110000), (3, 5 << 40), (4, 7 << 40), (5, 0x0F0F0F0F << 20), (6, 5 << 40)], "node long, fp long")
    distinct = prints.select("node").distinct().selectExpr("node", "array_remove(array(node), node) AS keys")
    got = {tuple(r) for r in simhash.candidates(distinct, prints).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (6, 3)}


def test_prints_are_compared_and_their_links_verified(spark, monkeypatch):
    """Texts that repeat three words have one print whatever their ends, which the sets tell apart."""
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints, *more: asked.append(prints.count()) or links(prints, *more))
    rng = random.Random(9)
    rows = [(k, "u v w " * 200 + " ".join(fresh(rng, 12))) for k in range(4)] + [(9, "U v w " * 200 + "End"), (10, "u v w " * 200 + "end")]
    assert len({simhash.fingerprint(t) for _, t in rows}) == 1
    assert sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()) == [0, 1, 2, 3, 9]
    assert asked == [1]
