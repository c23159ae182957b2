from __future__ import annotations

import math
import random
import textwrap

import pytest

from stripmill.llm import licenses

SCHEMA = "doc_id long, path string, text string, license string, found int"


def corpus():
    rng = random.Random(9)
    words = "the work under public thé version alpha beta gamma delta license rights of".split()
    say = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 40)))
    rows = []
    for k in range(160):
        lines = [say() for _ in range(rng.randrange(0, 6))]
        if k % 5 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(licenses.TEMPLATES)[1] + rng.choice(["", " alpha", " beta gamma delta thé alpha beta"]))
        if k % 16 == 0:
            lines = [rng.choice(licenses.TEMPLATES)[1].upper()]
        if k % 7 == 0:
            mark = rng.choice(["", "# ", " * ", "// "])
            wrapped = textwrap.wrap(rng.choice(["", "alpha beta "]) + rng.choice(licenses.TEMPLATES)[1], rng.randrange(20, 81))
            lines[1:1] = [mark + x for x in wrapped[: rng.choice([1, 2, 99, 99])]]
        rows.append((k, "/".join(["ab"[k % 2], *[str(rng.randrange(2)) for _ in range(k % 4)], f"f{k}"]), "\n".join(lines), "x", 1))
    for k, path in enumerate(sorted(licenses.TEXTS.glob("*.txt"))):
        text = path.read_text().replace("<year>", "2020").replace("<copyright holders>", "Some One")
        rows.append((300 + k, f"w{k}/LICENSE", text, "x", 1))
        rows.append((400 + k, f"w{k}/src/deep/f", "beta beta", "x", 1))
    rows.append((450, "half/LICENSE", licenses.TEXTS.joinpath("GPL-3.0.txt").read_text()[:2500], "x", 1))
    odd = [(500, "a/0/n", None, "x", 1), (501, "top", "", "x", 1), (502, "a/0/1/long", "beta " * 60_000 + "\nReleased under the MIT License.", "x", 1), (3, "b/1/f", "same", "x", 1), (3, "b/1/f", "same", "x", 1), (None, "b/f", "plain", "x", 1)]
    return rows + odd


def slow(rows):
    n, df = len(rows), {}
    for r in rows:
        for t in set(licenses.terms(r[2] or "")):
            df[t] = df.get(t, 0) + 1
    idf, vectors = licenses.weights(n, df)
    mean = sum(idf.values()) / len(idf)

    def best(text):
        found = licenses.terms(text)
        v = {t: (1 + math.log(found.count(t))) * idf.get(t, mean) for t in set(found)}
        length = math.sqrt(sum(w * w for w in v.values())) or 1
        all_ = [(-round(sum(w * t.get(k, 0) for k, w in v.items()) / length, 9), name) for name, t in vectors]
        return [x for x in all_ if -x[0] >= licenses.THRESHOLD]

    own, dirs = [], {}
    for d, path, text, *_ in rows:
        whole, lines = best(text or ""), [x for line in (text or "").split("\n") for x in best(line)]
        full = [words for line in (text or "").split("\n") if (words := licenses.terms(line))]
        for a in range(len(full)):
            for b in range(a + 2, len(full) + 1):
                if len(run := sum(full[a:b], [])) > licenses.RUN_TERMS:
                    break
                lines += best(" ".join(run))
        s = min(whole + lines, default=None)
        own.append((s, bool(whole)))
        if whole:
            dirs.setdefault(path.rpartition("/")[0], []).append((s[0], d, s[1]))
    out = []
    for (d, path, *_), (s, is_file) in zip(rows, own):
        if s:
            out.append((d, path, s[1], "file" if is_file else "header"))
            continue
        at = path.rpartition("/")[0]
        while at and at not in dirs:
            at = at.rpartition("/")[0]
        out.append((d, path, min(dirs[at])[2] if at in dirs else None, "inherited" if at in dirs else None))
    return out


def test_against_brute_force(spark):
    rows = corpus()
    got = licenses.scanned(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = slow(rows)
    assert sorted(str((r.doc_id, r.path, r.license, r.found)) for r in got) == sorted(map(str, want))
    assert {w[3] for w in want} == {"file", "header", "inherited", None}


def test_whole_license_texts_are_files_and_inherited(spark):
    wanted = ["Apache-2.0", "GPL-3.0", "MIT"]
    rows = [(k, f"{name}/LICENSE", licenses.TEXTS.joinpath(f"{name}.txt").read_text().replace("<copyright holders>", "Some One"), "x", 1) for k, name in enumerate(wanted)]
    rows += [(10 + k, f"{name}/src/a", f"plain words {k}", "x", 1) for k, name in enumerate(wanted)] + [(20 + k, f"other/{k}", f"more words {k}", "x", 1) for k in range(30)]
    got = {r.doc_id: (r.license, r.found) for r in licenses.scanned(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: (n, "file") for k, n in enumerate(wanted)} | {10 + k: (n, "inherited") for k, n in enumerate(wanted)} | {20 + k: (None, None) for k in range(30)}


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_headers(spark, mark):
    rows, want = [], {}
    for name, text in licenses.TEMPLATES:
        for width in range(30, 81, 10):
            want[len(rows)] = name
            lines = ["first words of code", "", *(mark + x for x in textwrap.wrap(text, width)), mark.strip(), "last words of code"]
            rows.append((len(rows), f"d{len(rows)}/f", "\n".join(lines), "x", 1))
    # in the midst of many lines, at the border of two tiles
    for k in range(licenses.TILE - 7, licenses.TILE + 2):
        want[len(rows)] = "GPL-3.0"
        rows.append((len(rows), f"d{len(rows)}/f", "\n".join(["code"] * k + textwrap.wrap(licenses.TEMPLATES[9][1], 60) + ["code"] * 70), "x", 1))
    rows += [(len(rows) + k, f"g{k}/f", f"plain words {k}\nof the code\nand more", "x", 1) for k in range(300)]
    got = licenses.scanned(spark.createDataFrame(rows, SCHEMA)).where("license is not null").collect()
    assert {r.doc_id: r.license for r in got} == want


def test_documents_and_empty(spark):
    docs = spark.createDataFrame([(None, None, "All rights reserved.", 1), (12345, "s", "plain", 2)], "doc_id long, source string, text string, path int")
    got = sorted((r.path, r.license) for r in licenses.scanned(licenses.document_paths(docs)).collect())
    assert got == [("_/_/_/_", "Proprietary"), ("s/12/34/12345", None)]
    assert licenses.scanned(spark.createDataFrame([], SCHEMA)).collect() == []
