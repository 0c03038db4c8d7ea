"""Conversation repair against every cheapest edit list."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from notelake.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, conv string, o long, code string, k long"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(codes):
    """All states and audits by plain relaxation, row by row."""
    def insert(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                to = C.ASSISTANT if s == C.USER else C.USER
                best[to] = min(best.get(to, (10**9, "")), (c + 3, a + "I"))
        return best

    best = insert({C.NOTHING: (0, "")})
    for code in codes:
        new = {}
        for s, (c, a) in best.items():
            for edit, cost, to in C.moves(code, s):
                new[to] = min(new.get(to, (10**9, "")), (c + cost, a + edit))
        best = insert(new)
    return min(best[s] for s in C.LEGAL if s in best)


def test_a_star_equals_relaxation():
    rng = random.Random(3)
    runs = ["".join(x) for n in range(5) for x in itertools.product("suaobdSUA", repeat=n)]
    runs += ["".join(rng.choice("suaoSUAObd") for _ in range(rng.randint(5, 60))) for _ in range(300)]
    for codes in runs:
        got = C.cheapest(codes)
        assert min(got.values()) == cheapest(codes), codes


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else text.translate({ord(c): None for c in ".!?"}) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain(rows):
    hurt, out = damage(rows), []
    for conv in {r[0] for r in rows}:
        said = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
        own = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, said(r)))
        codes, seen, fault = "", set(), {"b": 0, "d": 0, "t": 0}
        for r in own:
            bare = r[3].strip(WHITE)
            f = "b" if not bare else "d" if r[2:] in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add(r[2:])
            fault[f] = fault.get(f, 0) + 1
            role = r[2][:1] if r[2][:1] in ("s", "u", "a") else "o"
            codes += f if f in ("b", "d") else role.upper() if f else role
        cost, audit = cheapest(codes)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        lines, i = [], 0
        for e in audit:
            row = own[i] if e != "I" else None
            i += e != "I"
            if e != "D":
                lead = bool(lines) and lines[0].startswith("s") and not lines[0].startswith(("user", "assistant"))
                role = row[2] if e == "K" else ["user", "assistant"][(len(lines) - lead) % 2]
                lines.append(f"{role}:{row[3] if row else ''}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, fault["b"], fault["d"], fault["t"], illegal, cost, audit, sha))
    return sorted(out, key=str)


def conversations(seed=5):
    rng, rows = random.Random(seed), []
    say = lambda: rng.choice(["Hello there.", "Why?", "no end", "Good!", "", "  \n", "end. \t", "a" * 3000 + ".", "日本。", None, "Hello there.", "new\nline."])
    for conv in range(60):
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "Umbrella"])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), role, rng.choice([say(), f"line {turn}."])))
    rows += [(100, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(300)]
    return rows + [(None, 1, "user", "x."), (None, None, "user", "y."), *rows[:6], (-7, 1, "a", "b"), (200, None, None, None)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "clash", 1, "clash", 2) for r in conversations()], SCHEMA)


@pytest.mark.parametrize("bits", [12, 2])
def test_audits(table, monkeypatch, bits):
    """Also with blocks of four rows, across which most conversations are chained."""
    monkeypatch.setattr(C.repair, "__defaults__", (bits,))
    got = C.audited(table)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(conversations())


def test_rows_lost_and_empty(spark, table):
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = C.audited(spark.createDataFrame([(*gone, "user", "hi.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert C.audited(table.limit(0)).collect() == []


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi?"), (1, 3, "tool", "ok."), (1, 4, "user", " ")]
    done, report = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    shown = [(r["edit"], r["role"], r["text"]) for r in done.orderBy("o", "k").collect()]
    assert report.first()["cost"] == sum({"k": 0, "u": 3, "a": 3, "U": 3, "A": 3}[e] for e, _, _ in shown) + 4 * (5 - sum(e in "kua" for e, _, _ in shown))
    assert [r[:1] for _, r, _ in shown] in (list("suaua"), list("sua"))
    assert done.where(F.col("edit") == "k").count() >= 2
