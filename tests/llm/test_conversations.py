from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from stripmill.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def order(row):
    _, turn, role, text = row
    return turn is not None, turn or 0, role, text[:32]


def facts(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        said = text.rstrip(SPACE)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def sound(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def search(rows, faults):
    """Cheapest edits by going through prefixes of sound conversations, with the whole text of edits for each."""
    held = {"": (0, "")}
    def going_on(s):
        return any(sound(s + more) for more in ("", "a", "ua"))

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for s, (cost, edits) in list(out.items()):
                for r in "ua":
                    if going_on(s + r):
                        way = cost + 3, edits + "I"
                        key = s + r if len(s) < 4 else (s[0] == "s") * "s" + "ua" * 2 + ("u" if r == "u" else "")
                        out[key] = min(out.get(key, way), way)
        return out

    for (_, _, role, _), fault in zip(rows, faults):
        new = {}
        for s, (cost, edits) in inserted(held).items():
            ways = [(s, cost + 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways.append((s + (role[:1] or "?"), cost + more, "K"))
                ways += [(s + r, cost + 3 + more, "R") for r in "ua"]
            for t, price, edit in ways:
                if t == s or going_on(t):
                    t = t if len(t) < 6 else (t[0] == "s") * "s" + "ua" * 2 + (t[-1] == "u") * "u"
                    new[t] = min(new.get(t, (price, edits + edit)), (price, edits + edit))
        held = new
    return min(way for s, way in inserted(held).items() if sound(s))


def applied(rows, audit):
    out, k, last = [], 0, ""
    for e in audit:
        if e == "I":
            last = "a" if last == "u" else "u"
            out.append(("user" if last == "u" else "assistant") + ":")
            continue
        _, _, role, text = rows[k]
        k += 1
        if e != "D":
            if e == "R":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            out.append(f"{role}:{text}")
    assert k == len(rows) and sound("".join(x[0] for x in out))
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def slow(rows, ids):
    out = {}
    for conv in ids:
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        faults = facts(mine)
        initials = [r[2][:1] for r in mine]
        turns = {r[1] for r in mine if r[1] is not None}
        cost, audit = search(mine, faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, applied(mine, audit))
    return out


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, ""]) if rng.random() < 0.4 else ["user", "assistant"][turn % 2]
            text = rng.choice(["Yes.", "No", "what? ", "\t\n", "", None, "é…", "same text!", f"t{rng.random()}.\n"])
            rows.append((conv, None if rng.random() < 0.05 else turn + 3 * (rng.random() < 0.1), role, text))
    return rows


@pytest.mark.parametrize("bits", [0, 1, 2, 12])
def test_against_a_search_with_whole_texts(spark, monkeypatch, tmp_path, bits):
    monkeypatch.setattr(C, "CHUNK_BITS", bits)
    # equal beginnings are told apart by a digest, which the search here doesn't know: texts are short
    rows = conversations(bits, 150)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, pos string").repartition(6)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r[1:]) for r in C.op12_conversations(spark, str(tmp_path)).collect()}
    assert got == slow(damage(rows), {r[0] for r in rows})


def test_maps_of_parts_give_what_the_whole_gives():
    rng, layers = random.Random(9), C.Layers()
    for _ in range(400):
        kinds = [rng.choice([0, 1, 2, 1, 2, 3, 4, 5, 6, 9, 10]) for _ in range(rng.randrange(30))]
        whole = C.put_together([C.run_map(layers, kinds, (C.NOTHING,))])
        cuts = sorted(rng.randrange(len(kinds) + 1) for _ in range(3))
        parts = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, len(kinds)]) if a < b]
        assert C.put_together([C.run_map(layers, p, C.STATES) for p in parts]) == whole
        rows = [(0, k, ["system", "user", "assistant", "tool"][kind & 3], "x") for k, kind in enumerate(kinds)]
        assert search(rows, ["blank" if k & 4 else "truncated" if k & 8 else "" for k in kinds]) == whole
    assert len(layers.layers) < 500


def test_one_large_conversation_and_repaired_turns(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BITS", 6)
    rng = random.Random(2)
    rows = [(1, k, ["user", "assistant"][(k + (k % 37 == 0)) % 2], rng.choice(["same.", f"a{k}.", f"b{k}", ""])) for k in range(3000)] + [(2, 0, "system", "s."), (3, 0, "user", "Hi."), (4, 5, "tool", "x" * 100_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r[0]: tuple(r[1:]) for r in C.digests(C._plain(df), df.select("conv_id")).collect()}
    assert got == slow(rows, {1, 2, 3, 4})
    turns = {}
    for r in C.repaired(df).orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append(r)
    for conv, found in turns.items():
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in found).encode()).hexdigest() == got[conv][-1]
        assert [r.turn for r in found] == list(range(len(found))) and "".join(r.edit for r in found) == got[conv][-2].replace("D", "")
    assert 2 not in turns and got[2][5:7] == (4, "D")


def test_nothing_left_and_empty(spark):
    df = spark.createDataFrame([(7, 1, "user", "x.")], "conv_id long, turn long, role string, text string")
    got = C.digests(C._plain(df).where("turn > 5"), df.select("conv_id")).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.repaired(df.limit(0)).collect() == []
