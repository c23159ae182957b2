from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from stripmill.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long"


def corpus():
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 3, 50, 900])), rng.choice(["b", "a", "é", "hot", "hot", "hot", None]), 9) for k in range(300)]
    return [*rows, (7, "a b c", "a", 9), (None, "x y", "b", 9), (400, None, "b", 9), (401, "only one", "tiny", 9), (402, "", "none", 9), (403, " w\t" * 60_000, "long", 9)]


def test_targets():
    assert mixing.targets([]) == []
    assert mixing.targets([100]) == [150.0]
    # weights 5, 2, 1 over 1500 words: the first stops at 200, then the second at 1000 does not
    assert mixing.targets([100, 500, 400]) == pytest.approx([200, 1300 * 2 / 3 if 1300 * 2 / 3 <= 1000 else 1000, 1300 / 3])
    assert mixing.targets([0, 10]) == [0.0, 15.0]
    for sizes in ([5, 5, 5, 1000], [1, 2, 3, 4, 5, 6, 7]):
        got = mixing.targets(sizes)
        assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s for t, s in zip(got, sizes))


def test_permutation():
    for n in (1, 2, 5, 64, 1000):
        p = mixing.Permutation(np.full(n, n), np.full(n, 77))
        image = p.of(np.arange(n))
        assert sorted(image.tolist()) == list(range(n)) and (p.inverse(image) == np.arange(n)).all()


def slow(rows):
    """Words taken by each row, word by word."""
    by = defaultdict(list)
    for d, t, s, _ in rows:
        by[s].append((d, len((t or "").split())))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    plan = mixing.Plan(order, [sum(n for _, n in by[s]) for s in order])
    source, block, words, shard = plan.table(np.arange(plan.total))
    times = {k: Counter() for k in range(len(order))}
    for k, b, w in zip(source.tolist(), block.tolist(), words.tolist()):
        times[k].update(range(b * mixing.BLOCK, b * mixing.BLOCK + w))
    return order, plan, times, by, shard


def test_against_brute_force(spark):
    rows = corpus()
    order, plan, times, by, shard = slow(rows)
    mix = mixing.Mixture(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = mix.rows.collect()
    assert len(got) == len(rows)
    number = {d: order.index(s) for d, _, s, _ in rows if d != 7}
    for r in got:
        if r.size and r.doc_id in number:
            assert r.taken == sum(times[number[r.doc_id]][w] for w in range(r.start, r.start + r.size))
            assert r.copies == times[number[r.doc_id]][r.start]
        assert 0 <= r.taken <= 2 * r.size
    total = Counter()
    for r in got:
        if r.doc_id in number:
            total[number[r.doc_id]] += r.taken
    for k, s in enumerate(order):
        size = sum(n for _, n in by[s])
        assert sum(times[k].values()) == min(round(plan.targets[k]), 2 * size)
        assert {r.target for r in got if number.get(r.doc_id) == k} == {plan.targets[k]}
        assert {r.source_size for r in got if number.get(r.doc_id) == k} == {size}
        assert max(times[k].values(), default=0) <= 2
    sizes = np.bincount(shard, minlength=mixing.SHARDS)
    assert sizes.max() - sizes.min() <= 1


def test_documents_and_odd_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    copies = {r.doc_id: r.copies for r in mixing.Mixture(docs).rows.collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter(r.doc_id for r in out.collect())
    assert all(got[d] == copies[d] for d in copies if d != 7)
    assert sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, mixing.mixed(docs.repartition(5)).collect()))
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).collect() == []
    nulls = spark.createDataFrame([(1, None, None, 0), (None, None, None, 0)], SCHEMA)
    assert [(r.size, r.target, r.taken) for r in mixing.mixed(nulls).collect()] == [(0, 0.0, 0)] * 2


def test_rows_of_one_id_are_taken_each_for_itself(spark):
    rows = [(1, "x " * (10 + k), "b", k) for k in range(60)] + [(2, "the same row", "a", 0)] * 9 + [(3, "other " * 4000, "a", 1)]
    schema = "doc_id long, text string, source string, _n long"
    docs = spark.createDataFrame(rows, schema)
    keyed = docs.withColumns(dict(zip(("k1", "k2"), mixing.row_keys(docs))))
    of = {(r.k1, r.k2): (r.doc_id, r.text, r.source, r["_n"]) for r in keyed.collect()}
    want = Counter()
    for r in mixing.Mixture(keyed, ("k1", "k2")).rows.collect():
        want[of[r.k1, r.k2]] += r.copies
    got = Counter(tuple(r) for r in mixing.mixed_documents(docs).collect())
    assert got == +want and {n for r, n in got.items() if r[0] == 1} == {1, 2} and got[rows[60]] > 2


def test_missing_and_repeated_ids_are_spread(spark, monkeypatch):
    chunks = Counter()
    sums = mixing.prefix_sums

    def counted(rows, *rest):
        chunks.update(r.chunk for r in rows.collect())
        return sums(rows, *rest)

    monkeypatch.setattr(mixing, "prefix_sums", counted)
    rows = [(7, "the same row", "a", 0)] * 900 + [(None, "no id " * (k + 1), "a", 0) for k in range(900)] + [(10 + k, "x y", "b", 0) for k in range(900)]
    got = mixing.Mixture(spark.createDataFrame(rows, SCHEMA)).rows.collect()
    assert sum(chunks.values()) == 1801 and max(chunks.values()) < 200
    assert sorted(r.size for r in got) == sorted(len(t.split()) for _, t, *_ in rows)
    for source, n in (("a", 1800), ("b", 900)):
        part = sorted((r.start, r.size, r.taken) for r in got if r.source_size == sum(len(t.split()) for _, t, s, _ in rows if s == source))
        target = next(r.target for r in got if r.source_size == sum(size for _, size, _ in part))
        assert len(part) == n and all(a + size == b for (a, size, _), (b, *_) in zip(part, part[1:]))
        assert sum(taken for *_, taken in part) == min(round(target), 2 * sum(size for _, size, _ in part))
