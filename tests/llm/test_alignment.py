from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from stripmill.llm import alignment as A

SIGNS = "abcdest''  \n\t.,!?0123 éèüßñçΣЖЯ中文あ한̧́​　½²🙂👍🏽\x85 ﻿ﬁ▁\r"
TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "<|endoftext|>", "</s> <s>", "<0x41>", "▁", "a▁b", "word " * 2000 + "x", "word " * 3 + "x", "word " * 3 + "x", "x" * 5000, "  double  spaces ", "nul \x00 sign"]


@pytest.fixture(scope="module")
def given():
    a, b = map(public_tokenizers.path, A.VOCABULARIES)
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        return f.read(), g.read()


def texts():
    rng = random.Random(5)
    found = ["".join(rng.choices(SIGNS, k=rng.randrange(80))) for _ in range(400)]
    words = ["the", "ing", "Ünder", "tion,", "don't", "naïve", "x1y2", "日本語", "\n\nNew"]
    return TEXTS + found + [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(200)]


def slow(given, rows):
    """The columns by reading token after token of whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_str(given[0])
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_proto=given[1])
    a_side, b_side = A.byte_level(given[0]), A.of_pieces(given[1])
    out, linked = [], []
    for text in rows:
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if not text or any(b"".join(side.pieces[k] for k in ids) != want for side, ids in ((a_side, a), (b_side, b))):
            out.append([0, 0, 0, 0, ""])
            linked.append(Counter())
            continue

        def spans(ids, side):
            at, found = 0, []
            for k in ids:
                found.append((at, at + len(side.pieces[k]), k))
                at += len(side.pieces[k])
            return found

        x, y = spans(a, a_side), spans(b, b_side)
        cuts = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        pairs, k = Counter(), 0
        for low, high, p in x:
            while y[k][1] <= low:
                k += 1
            m = k
            while m < len(y) and y[m][0] < high:
                pairs[p, y[m][2]] += 1
                m += 1
        said, i, j = [], 0, 0
        for c in cuts:
            g = [[], []]
            while i < len(x) and x[i][1] <= c:
                g[0].append(str(x[i][2]))
                i += 1
            while j < len(y) and y[j][1] <= c:
                g[1].append(str(y[j][2]))
                j += 1
            said.append(",".join(g[0]) + "|" + ",".join(g[1]))
        out.append([len(a), len(b), len(cuts), sum(pairs.values()), hashlib.sha256(";".join(said).encode()).hexdigest()])
        linked.append(pairs)
    total = sum(linked, Counter())
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return [(*row, sum(n for (a, b), n in p.items() if total[a, b] == most[b]), sum(n * total[q] for q, n in p.items())) for row, p in zip(out, linked)]


@pytest.mark.parametrize("kept", [1 << 22, 10])
def test_columns_of_a_batch(given, monkeypatch, kept):
    monkeypatch.setattr(A, "WORDS", kept)
    rows = texts()
    work = A.Aligner(A.byte_level(given[0]), A.of_pieces(given[1]))
    got = []
    for k in range(0, len(rows), 64):
        found = work.aligned(rows[k : k + 64])
        got += list(zip(*(list(found[n]) for n in A.NAMES)))
    assert [tuple(g) for g in got] == [r[:5] for r in slow(given, rows)]


@pytest.mark.parametrize("pairs", [1 << 20, 150])
def test_rows(spark, given, monkeypatch, pairs):
    monkeypatch.setattr(A, "PAIRS", pairs)
    rows = texts()
    df = spark.createDataFrame([(None if k % 7 == 0 else k % 50, k, t, "x", "y") for k, t in enumerate(rows)], "doc_id long, _row long, Text string, n_a string, links string").repartition(5)
    got = A.aligned(df, ["_row", "doc_id", "n_a"], "Text")
    assert got.columns == ["_row", "doc_id", "n_a", "n_a_", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    found = sorted(map(tuple, got.collect()))
    assert [r[3:] for r in found] == slow(given, rows)
    assert [r[0] for r in found] == list(range(len(rows)))


def test_empty_table_and_no_tokens(spark):
    df = spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")
    assert A.aligned(df.limit(0), ["doc_id"]).collect() == []
    assert [tuple(r) for r in A.aligned(df, ["doc_id"]).collect()] == [(1, 0, 0, 0, 0, "", 0, 0)] * 2
