from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from stripmill.llm import simhash

SCHEMA = "doc_id long, text string, fingerprint string, component_id long"


def slow_print(text, width=3):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=2):
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def texts():
    rng = random.Random(5)
    words = [f"W{k}é" for k in range(50)]
    out = [None, "", " \t\n", "one", "One two", "Ä x y z", "x " * 4000]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(30)]
    out += base + [b + " end" for b in base] + [b.upper() for b in base[:5]]
    return out + ["same text again and again"] * 4


def test_against_brute_force(spark):
    rows = [(3 * k, t) for k, t in enumerate(texts())]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame([(d, t, "f", 1) for d, t in rows], SCHEMA)).collect()}
    prints = {d: slow_print(t) for d, t in rows}
    assert {d: p for d, (p, _) in got.items()} == prints
    assert {d: c for d, (_, c) in got.items()} == slow_components(prints)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_links_of_planted_prints(spark, bucket):
    rng = random.Random(1)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            prints.add(p)
            for _ in range(rng.randrange(1, 4)):
                p ^= 1 << rng.randrange(64)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), bucket=bucket).collect()
    from_edges = {p: {p} for p in prints}
    for a, b in edges:
        a, b = a % (1 << 64), b % (1 << 64)
        merged = from_edges[a] | from_edges[b]
        for x in merged:
            from_edges[x] = merged
    want = slow_components({p: p for p in prints})
    assert {p: min(s) for p, s in from_edges.items()} == want


def test_near_pairs_long_runs():
    rng = np.random.default_rng(2)
    prints = np.unique(rng.integers(0, 2**12, 300).astype(np.uint64) << np.uint64(20))
    label = simhash.near_pairs(np.zeros(len(prints), np.int64), prints, 2)
    want = slow_components({k: int(p) for k, p in enumerate(prints)})
    assert list(label) == [want[k] for k in range(len(prints))]


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "zz yy xx")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(rows).collect())
    assert got == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
