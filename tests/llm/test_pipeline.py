from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from stripmill.llm import decontaminate, langid, mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    words = {lang: ["".join(rng.choices(letters, k=rng.randrange(3, 9))) for _ in range(60)] for lang, letters in (("xx", "thornawes"), ("yy", "ouvébixl"))}
    say = lambda lang, n: rng.choices(words[lang], k=n)
    rows = [[k, " ".join(say(lang, rng.randrange(120, 200))), lang, f"s{k % 3}", 0] for k in range(120) for lang in [rng.choice(["xx", "yy"])]]
    near = []
    for k in range(40):
        t = rows[k][1].split()
        if k % 2:
            t[len(t) // 2] = "changed"
        near.append([500 + k, " ".join(t), rows[k][2], "s1", 0])
    bench = [(k, " ".join(say("xx", 30))) for k in range(4)]
    leaks = [[700 + k, rows[60 + k][1] + " filler" + str(k) + " " + b + " " + " ".join(say("xx", 80)), "xx", "s0", 0] for k, (_, b) in enumerate(bench)]
    junk = [[900, None, "xx", "s0", 0], [901, "123 456", "yy", "s0", 0], [902, "", None, None, 0]]
    return [tuple(r) for r in rows + near + leaks + junk], bench


def jaccard(a, b):
    x, y = (set(zip(*(t.split()[k:] for k in range(5)))) for t in (a, b))
    return len(x & y) / len(x | y)


def test_stages_against_brute_force(spark, tmp_path):
    rows, bench = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    now, at = {r[0]: r for r in rows}, docs
    for name in ("language", "near_duplicates", "decontamination"):
        out = stages[name](spark, at, str(tmp_path))
        assert out.schema.names == docs.columns
        got = {r.doc_id: tuple(r) for r in out.collect()}
        if name == "language":
            want = {d: r for d, r in now.items() if d < 900}
        elif name == "near_duplicates":
            want = {d: r for d, r in now.items() if not any(e < d and jaccard(r[1], s[1]) >= 0.8 for e, s in now.items())}
            assert len(want) < len(now) - 30
        else:
            want = {d: r for d, r in now.items() if not 700 <= d < 800}
        assert not set(got) ^ set(want), (name, sorted(set(got) ^ set(want)))
        assert got == want
        now, at = want, spark.createDataFrame(list(want.values()), SCHEMA)
    copies = {r.doc_id: r.copies for r in mixing.Mixture(at).rows.collect()}
    mixed = stages["mixing"](spark, at, str(tmp_path))
    got = Counter(tuple(r) for r in mixed.collect())
    assert got == Counter({r: copies[d] for d, r in now.items() if copies[d]})
    out = stages["sharding"](spark, mixed, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == Counter({d: n for d, n in copies.items() if n})
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in run) == Counter(r.doc_id for r in out)


def test_large_buckets_and_repeated_rows(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    rows = []
    for k in range(60):
        t = list(base)
        t[rng.randrange(300)] = f"edit{k}"
        rows.append((k, " ".join(t)))
    rows += [(100, " ".join(rng.choices(base, k=300))), (7, rows[7][1]), (100, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in simhash.similar_components(docs, bucket=4).collect()}
    assert all(groups[k] == 0 for k in range(60))
    kept = simhash.one_of_each(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["0", "100"]


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (langid.known_documents(empty), simhash.one_of_each(empty), decontaminate.clean_documents(empty, bench), mixing.mixed_documents(empty)):
        assert out.collect() == [] and out.columns == empty.columns
