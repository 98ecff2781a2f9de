from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from gridspark.llm import repair
from gridspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = "\x20\t\n\x0b\x0c\r"


def cheapest(letters: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Least (cost, audit) by a plain sweep over (turns read, state); letters: (role initial, must go, truncated)."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "a": {"u": "u"}, "u": {"a": "a"}}
    labels: dict[str, tuple[int, str]] = {"": (0, "")}

    def insert() -> None:
        for _ in range(4):
            for q, (c, a) in list(labels.items()):
                to, path = "a" if q == "u" else "u", (c + 5, a + "I")
                labels[to] = min(labels.get(to, path), path)

    insert()
    for kind, must, short in letters:
        found: dict[str, tuple[int, str]] = {}
        for q, (c, a) in labels.items():
            options = [(q, c + 2, "D")]
            if not must:
                options.append(("a" if q == "u" else "u", c + 1 + 5 * short, "R"))
                if kind in after[q]:
                    options.append((kind, c + 5 * short, "K"))
            for to, cost, edit in options:
                found[to] = min(found.get(to, (cost, a + edit)), (cost, a + edit))
        labels = found
        insert()
    return min(labels[q] for q in ("", "a") if q in labels)


def report(turns: list[tuple]) -> dict:
    """turns: (turn, role, text) in order."""
    seen, letters, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in turns:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        if fault:
            n[fault] += 1
        letters.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    known = [t for t, _, _ in turns if t is not None]
    cost, audit = cheapest(letters)
    out, state, rows = [], "", iter(turns)
    for edit in audit:
        _, role, text = (None, "", "") if edit == "I" else next(rows)
        if edit in "IR":
            role = "assistant" if state == "u" else "user"
        if edit != "D":
            out.append(f"{role}:{text}")
            state = role[:1]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return {"gaps": gaps, **n, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def damaged(rows: list[tuple]) -> dict:
    out: dict = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        own += [] if fault == 0 else [(turn, role, text)] * (2 if fault == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


def rows(seed: int = 3, n: int = 260) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for conv in [None, *range(n)]:
        for turn in range(rng.choice([1, 1, 2, 4, 9, 40])):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None, "u", "User"])
            text = rng.choice(["Yes.", "No!", "cut off", "So?\n", " \t", "", None, "Long. " * 30, "ends. but", "zß.", f"{conv} {turn}."])
            out += [(conv, rng.choice([turn] * 12 + [None, turn + 7, -3]), role, text)] * rng.choice([1] * 9 + [3])
    return out


def found(df) -> dict:
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


@pytest.mark.parametrize("most", [2048, 3])
def test_reports_match_a_plain_sweep(spark, most):
    """Whole, and with conversations above three turns cut into stretches."""
    made = rows()
    df = spark.createDataFrame(made, SCHEMA).repartition(6)
    want = {k: report(v) for k, v in damaged(made).items()}
    got = found(repair.repair(repair.damage(df), present_col="present", most=most))
    assert got == want
    assert any(not v for v in damaged(made).values()) and any(r["cost"] > 20 for r in want.values())


def test_stretches_of_a_few_turns(spark, monkeypatch):
    monkeypatch.setattr(repair, "MOST", 5)
    monkeypatch.setattr(repair, "BLOCK", 2)
    turns = [("user", "a."), ("user", "a."), ("assistant", "b"), ("tool", "c."), ("user", " "), ("assistant", "d!")] * 9
    made = [(1, k // 2, *t) for k, t in enumerate(turns)] + [(1, None, "system", "s.")] * 4
    want = report(sorted(made and [r[1:] for r in made], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])))
    assert repair.cheapest("".join(repair.sign(r, t, False) for _, _, r, t in made[:7])) == cheapest([(r[:1], not t.strip(), t.strip()[-1:] not in tuple(".!?")) for _, _, r, t in made[:7]])
    df = spark.createDataFrame(made, SCHEMA).repartition(3)
    assert found(repair.repair(df, most=2)) == {1: want}


@pytest.mark.parametrize("most", [2048, 3])
def test_repaired_turns_are_legal(spark, most):
    df = spark.createDataFrame(rows(5, 60), SCHEMA)
    reports = {r["conv_id"]: r["repaired_sha256"] for r in repair.repair(df, most=most).collect()}
    turns: dict = {}
    for r in sorted(repair.repaired_turns(df, most=most).collect(), key=lambda r: r["position"]):
        turns.setdefault(r["conv_id"], []).append(r)
    for conv, digest in reports.items():
        own = turns.get(conv, [])
        assert [r["position"] for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest() == digest


def test_empty_tables_and_clashing_names(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "a.", 5, 6, 7)], SCHEMA + ", _id int, audit int, piece int")
    assert found(repair.repair(odd))[1]["audit"] == "D"
    names = spark.createDataFrame([("x", 0, "user", "a."), ("x", 1, "assistant", "b.")], "conv_id string, turn int, role string, text string")
    assert found(repair.repair(names))["x"]["audit"] == "KK"


def test_query(spark):
    made = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op11_conversation_repair"](spark, SF)) == {k: report(v) for k, v in damaged(made).items()}
