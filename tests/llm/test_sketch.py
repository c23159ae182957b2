from __future__ import annotations

import hashlib
import random

import numpy as np

from stripmill.llm import sketch


def slow(rows):
    """rows: (doc_id, text) -> expected columns, by sorting and multisets."""
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for k, (d, t) in enumerate(rows):
        t, f = t or "", rows[(k + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 2] + f[: len(t) // 2]

        def near(x, y):
            a, b = (set(sketch.digests(z.encode()).tolist()) for z in (x, y))
            return len(a & b) / len(a | b) if a | b else 1.0

        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), near(t, e), near(t, f))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choices("ab cdé fghi jk lmnop q".split(), k=rng.randrange(30)))
    rows = [(7 * k, "\n".join(line() for _ in range(rng.randrange(40)))) for k in range(120)]
    rows += [(1, None), (2, ""), (3, "x"), (4, "é\n" * 3000), (5, "é\n" * 3000), (841, "word " * 50_000)]
    df = spark.createDataFrame([(d, t, "f") for d, t in rows], "doc_id long, text string, fingerprint string").repartition(5)
    got = {r.doc_id: r for r in sketch.compared(df).collect()}
    for d, (n, sha, edited, following) in slow(rows).items():
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert abs(r.near_edited - edited) < 1e-12 and abs(r.near_next - following) < 1e-12
    assert len(got) == len(rows)
    assert got[4].fingerprint == got[5].fingerprint != got[3].fingerprint


def test_peeling_recovers_the_differing_digests():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**63, 500).astype(np.uint64)
    a, b = (np.r_[shared, rng.integers(0, 2**63, 9).astype(np.uint64)] for _ in range(2))
    third = np.array([20])
    two = [sketch.sketches(s, np.zeros(len(s), np.int64), third) for s in (a, b)]
    _, items, done = sketch.peel([x - y for x, y in zip(*two)], third)
    assert done.all() and set(items.tolist()) == set(a[500:].tolist()) | set(b[500:].tolist())


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert sketch.compared(spark.createDataFrame([], schema)).collect() == []
    (one,) = sketch.compared(spark.createDataFrame([(5, "a b")], schema)).collect()
    assert (one.n_chars, one.edited_sha256, one.near_next) == (3, hashlib.sha256(b"a a").hexdigest(), 1.0)
    twins = sketch.compared(spark.createDataFrame([(5, "a b"), (5, "a b"), (None, None), (None, "z")], schema)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in twins) == [("5", 3), ("5", 3), ("None", 0), ("None", 1)]
