"""Conversation repair against a search over whole audits; conversations over many blocks; nulls, copies, ties, empty tables, clashing names."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from plumbline.llm import conversations

DATA = "/root/testdata/sf0.01"
ROWS = "conv_id long, turn long, role string, text string, at long, code int, block long, audit string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
LETTER = {"s": ("", "s"), "u": ("s?(ua)*", "u"), "a": ("", "a")}


def prefix_ok(s):
    return re.fullmatch("s?(ua)*u?", s) is not None


def cheapest(rows):
    """Best-first search over (cost, audit): rows of (initial, fault)."""
    queue, seen = [(0, "", 0, "")], set()
    while True:
        cost, audit, k, made = heapq.heappop(queue)
        if (k, made[:1] == "s", made[-1:]) in seen:
            continue
        seen.add((k, made[:1] == "s", made[-1:]))
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            return cost, audit
        for x in "ua":
            if prefix_ok(made + x):
                heapq.heappush(queue, (cost + 5, audit + "I", k, made + x))
        if k < len(rows):
            initial, fault = rows[k]
            heapq.heappush(queue, (cost + 2, audit + "D", k + 1, made))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if initial and initial in "sua" and prefix_ok(made + initial):
                    heapq.heappush(queue, (cost + more, audit + "K", k + 1, made + initial))
                for x in "ua":
                    if prefix_ok(made + x):
                        heapq.heappush(queue, (cost + 1 + more, audit + "R", k + 1, made + x))


def damaged(table):
    out = []
    for conv, turn, role, text in table:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def repaired(rows, ids):
    out = []
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, seen = [], set()
        for _, _, role, text in own:
            bare = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in own if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = cheapest([(r[2][:1], f) for r, f in zip(own, faults)])
        made, k = [], 0
        for e in audit:
            wanted = "assistant" if made and made[-1][0][:1] == "u" else "user"
            if e == "I":
                made.append((wanted, ""))
                continue
            if e != "D":
                made.append((wanted if e == "R" else own[k][2], own[k][3]))
            k += 1
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def made(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def given(spark, table):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in table], ROWS).repartition(5)


def odd_table(seed, conversations_, turns):
    """Ties within a turn differ in role or text."""
    rng, out = random.Random(seed), []
    for conv in [None, *range(conversations_)]:
        for _ in range(rng.randint(1, turns)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher", "Assistant"])
            text = rng.choice([None, "", " \t", "a.", "b!", "why?", "cut", "é.\n", "x" * 300 + ".", "same.", ". cut", f"n{rng.randint(0, 9)}."])
            out.append((conv, rng.choice([None, rng.randint(-3, 12), rng.randint(0, 40)]), role, text))
    return out


def test_codes_of_moves():
    assert conversations.ENDS == (0, 10, 5, 0)
    assert conversations.walked(bytes([1, 2]), 0, conversations.ENDS, True) == ("KK", 0, 3)
    assert conversations.walked(bytes([1]), 0, conversations.ENDS, True) == ("D", 2, 0)


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_repair_against_search(spark, monkeypatch, bits):
    """Blocks of 2, 8 and 4096 rows: a conversation over many blocks is repaired as in one."""
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits)
    table = odd_table(bits, 12, 9) + odd_table(50 + bits, 2, 40) + [(7, 3, "user", "again.")] * 15
    df = given(spark, table)
    ids = sorted({r[0] for r in table}, key=repr)
    assert made(conversations.repaired(conversations.damaged(df), df)) == repaired(damaged(table), ids)


def test_repair_turns(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK_BITS", 2)
    table = [(1, k, ["user", "assistant"][k % 2], f"t{k}.") for k in range(30) if k != 11] + [(2, 0, "user", "alone"), (3, 0, "system", "only."), (4, 1, "user", "x."), (4, 2, "user", "y."), (5, 1, "assistant", " ")]
    got = {}
    for r in conversations.repaired(given(spark, table), turns=True).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    for rows in got.values():
        assert [r[0] for r in rows] == list(range(len(rows)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[1][0] for r in rows))
    assert {r.conv_id: r.repaired_sha256 for r in conversations.repaired(given(spark, table)).collect()} == {k: hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in got.get(k, [])).encode()).hexdigest() for k in range(1, 6)}


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], ROWS)
    assert conversations.repaired(conversations.damaged(none), none).collect() == []
    ids = spark.createDataFrame([(9,), (None,)], "conv_id long")
    empty = hashlib.sha256(b"").hexdigest()
    assert made(conversations.repaired(none, ids)) == sorted([(9, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)], key=repr)


def test_query_whole_table(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert made(conversations.op12_conversation_repair(spark, DATA)) == repaired(damaged(table), sorted({r[0] for r in table}))


def test_query_and_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    rel = c.sql(conversations.SQL)
    got = conversations.op12_conversation_repair(spark, "/root/testdata/sf0.01")
    assert sorted(rel.columns) == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*rel.columns).collect()), key=repr) == sorted(rel.fetchall(), key=repr)
