from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from stripmill.llm import substrings

SCHEMA = "doc_id long, text string, key string, n int"


def slow(rows):
    seen = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        seen.update(b[k : k + 200] for k in range(len(b) - 199))
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def corpus():
    rng = random.Random(12)
    say = lambda n: "".join(rng.choices("abcdé \n", k=n))
    shared = [say(rng.choice([120, 170, 199, 200, 201, 300, 900])) for _ in range(14)]
    rows = []
    for k in range(90):
        text = "".join(rng.choice([say(rng.randrange(300)), rng.choice(shared), rng.choice(shared)[rng.randrange(60) :]]) for _ in range(rng.randrange(1, 6)))
        rows.append((k, text, "x", 1))
    near = list(say(3000))
    for k in range(12):
        near[rng.randrange(3000)] = rng.choice("xyz")
        rows.append((100 + k, "".join(near), "x", 1))
    odd = [(200, None, "x", 1), (201, "", "x", 1), (202, "short", "x", 1), (203, "a" * 199, "x", 1), (204, "b" * 200, "x", 1), (205, "c" * 201, "x", 1), (206, "ab" * 2000, "x", 1), (None, say(500), "x", 1), (207, say(60_000) + shared[-1], "x", 1)]
    return [*rows, *odd, rows[0], rows[0], (300, rows[1][1], "x", 1)]


@pytest.mark.parametrize("bucket", [substrings.BUCKET, 3])
def test_against_brute_force(spark, bucket):
    rows = corpus()
    got = substrings.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(3), bucket).collect()
    assert sorted(str(tuple(r)) for r in got) == slow(rows)


def test_empty(spark):
    assert substrings.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_string_has_an_anchor_at_the_same_place():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, 3000).astype(np.uint8)
    part = text[700:900]
    places = set(substrings.anchors(text, [len(text)]).tolist())
    (own,) = substrings.anchors(part, [len(part)]).tolist()
    assert 700 + own in places
    assert all(any(p in places for p in range(s, s + substrings.STARTS)) for s in range(3000 - 199))
