from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stripmill.llm import tokencount as C

SIGNS = "abcdestmrvl'''  \n\t.,!?0123 éèüßñçΣσςΩжЖДЯ中文あ한글̧́İıſǅ​　½²Ⅷ٣🙂👍🏽\x00\x85 ﻿ﬁẞ"


@pytest.fixture(scope="module")
def source():
    with open(public_tokenizers.path(C.VOCABULARY), encoding="utf-8") as f:
        return f.read()


def library(source, texts):
    return [len(x.ids) for x in Tokenizer.from_str(source).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts():
    rng = random.Random(1)
    found = ["".join(rng.choices(SIGNS, k=rng.randrange(60))) for _ in range(1500)]
    found += ["".join(rng.choices(["the", "ing", "and", "er", "tion", "a", "b", "ab", "é"], k=rng.randrange(120))) for _ in range(300)]
    found += ["it's don't 'll 're'ves we'll've ''s 'sx 'r 'v 'l 'r", "'", "a'", "'re'", "x'r e", "'r", "'l l", "aaaaaaaaaaaaaaaaaaaaaaa" * 50, "the" * 500]
    return found + ["<|startoftext|>x<|endoftext|>y <|endof", "<|endoftext|><|endoftext|>", "a<|endoftext|>́", "", None, " ", "\n\n", "'s" * 300, "word " * 3000]


def test_counts_are_the_librarys(source):
    texts = odd_texts()
    assert C.Counter(source).counts(texts).tolist() == library(source, texts)


def test_a_table_begun_anew_and_short_pieces_and_chunks_change_nothing(source, monkeypatch):
    texts = odd_texts()[::3]
    monkeypatch.setattr(C, "CHUNK", 3)
    monkeypatch.setattr(C, "PIECE", 7)
    counter = C.Counter(source)
    counter.machine.most = 20
    assert counter.counts(texts).tolist() == library(source, texts)


@pytest.mark.parametrize("chunk", [1, 2, 5, 64])
def test_scanned_maps_give_the_states_of_one_machine_run_in_order(monkeypatch, chunk):
    rng = np.random.default_rng(chunk)
    classes = rng.integers(0, len(C.CLASSES), 1000).astype(np.uint8)
    want, state = [], C.BETWEEN
    for c in classes.tolist():
        state, said = C._word_step(state, c)
        want.append(said)
    monkeypatch.setattr(C, "CHUNK", chunk)
    assert C.word_marks(classes).tolist() == want
    assert C.word_marks(classes[:0]).tolist() == []


def test_transitions_add_up_to_tokens_of_every_prefix(source):
    machine, lib = C.Counter(source).machine, Tokenizer.from_str(source)
    for word in ("internationalisation", "aaaaaaa", "zzyzx", "therethethen"):
        state, total = machine.START, 0
        for k, byte in enumerate(word.encode()):
            whole = total + machine.step(state, byte + 256)[1]
            assert whole == len(lib.encode(word[: k + 1], add_special_tokens=False).ids)
            state, emitted = machine.step(state, byte)
            total += emitted


def test_another_splitting_is_refused(source):
    with pytest.raises(ValueError):
        C.Counter(source.replace("'s|'t|", "'s|"))


def test_rows(spark, source):
    rows = [(k, t, k, "x") for k, t in enumerate(odd_texts()[-40:])] + [(None, "null id", 1, "x"), (7, "again", 1, "x"), (7, "again", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, Text string, N_Bytes long, extra string").repartition(3)
    got = C.counted(df, ["doc_id", "N_Bytes", "Text"], "Text")
    assert got.columns == ["doc_id", "N_Bytes", "Text", "n_bytes_", "n_tokens"]
    found = got.collect()
    assert len(found) == len(rows)
    want = library(source, [r.Text for r in found])
    assert [r.n_tokens for r in found] == want and all(r.n_bytes_ == len((r.Text or "").encode()) for r in found)
    assert C.counted(df.limit(0), ["doc_id"], "Text").collect() == []


def test_query(spark, source, tmp_path):
    texts = ["a " * 2048, "a " * 2049, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = C.op11_token_counts(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, 4096, 2048, False), (1, 4098, 2049, True), (2, 0, 0, False), (3, 0, 0, False)]
