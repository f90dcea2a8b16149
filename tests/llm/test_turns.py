"""Repair of conversations against a search over all edits, and the query against its SQL."""

import hashlib
import heapq
import random
import zlib

import duckdb
import pytest

from tidegrid.llm import queries, turns

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, edits, repaired turns) by Dijkstra's search over (row, last initial) with the edits as tie-break; ``rows`` are (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(out)
        push = lambda c, e, j, to, turn: heapq.heappush(heap, (cost + c, audit + e, j, to, out + turn))
        for x in "ua":
            if (to := NEXT.get((last, x))) is not None:
                push(3, "I", i, to, (f"{FULL[x]}:",))
        if i < len(rows):
            role, text, fault = rows[i]
            push(4, "D", i + 1, last, ())
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                if (to := NEXT.get((last, role[:1]))) is not None:
                    push(late, "K", i + 1, to, (f"{role}:{text}",))
                for x in "ua":
                    if (to := NEXT.get((last, x))) is not None:
                        push(3 + late, "R", i + 1, to, (f"{FULL[x]}:{text}",))


def expected(rows):
    """The query's rows, straight from its definition."""
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        role = "user" if k == 4 else role
        own += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, judged = set(), []
        for _, role, text in own:
            solid = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        count = lambda f: sum(x == f for _, _, x in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, repaired = cheapest(judged)
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(t, x, r, c, "z") for c, t, r, x in rows], "turn long, text string, role string, conv_id long, at string")
    return sorted(map(tuple, turns.damaged_and_repaired(df).collect()), key=repr)


def made(seed, convs=40):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        turn = 0
        for _ in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "well", "", " \t", "a\nb?", None, f"row {rng.random()}.", f"row {rng.random()}", "été 😀.", "x "])
            rows.append((conv if conv else None, None if rng.random() < 0.1 else turn, role, text))
            turn += rng.choice([0, 1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_repairs_equal_a_search_over_all_edits(spark, seed):
    rows = made(seed)
    assert got(spark, rows) == expected(rows)


def test_long_conversations_are_repaired_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(turns, "PIECE", 4)
    rows = [(i % 2, t, random.Random(t * 7 + i).choice(["user", "assistant", "system"]), f"{t}{random.Random(t).choice('.!x')}") for i in range(2) for t in range(120)]
    assert got(spark, rows) == expected(rows)


def test_walks_equal_a_search(spark):
    rng = random.Random(1)
    faults = {"x": "blank"}
    for _ in range(3000):
        letters = "".join(rng.choice("suaoxSUAO") for _ in range(rng.randrange(7)))
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), str(i), faults.get(c) or ("truncated" if c.isupper() else None)) for i, c in enumerate(letters)]
        cost, audit, _ = cheapest(rows)
        assert turns.walk(letters, turns._AT_END, 0, True)[0] == audit and turns.costs_along(letters, turns._AT_END)[0][0] == cost


def test_odd_tables(spark):
    assert got(spark, []) == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone."), (5, None, None, None), (5, None, "user", "word " * 200_000 + "end."), (6, 3, "user", "Same."), (6, 3, "user", "Same."), (6, 3, "user", "Same.")]
    out = {r[0]: r for r in got(spark, rows)}
    assert out[dropped][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert out[5] == next(r for r in expected(rows) if r[0] == 5) and out[6] == next(r for r in expected(rows) if r[0] == 6)


def test_repaired_turns_are_whole_conversations(spark):
    rows = made(7)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = {}
    for r in sorted(turns.repaired_turns(df).collect(), key=lambda r: (repr(r["conv_id"]), r["place"])):
        by.setdefault(r["conv_id"], []).append(r["role"][0])
    assert by and all("".join(x).removeprefix("s") == "ua" * (len("".join(x).removeprefix("s")) // 2) for x in by.values())


def test_the_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    want = duckdb.sql(queries.ORACLE_SQL["op12_turns"].replace("FROM conversations", f"FROM '{sf}/conversations.parquet'"))
    rows = queries.QUERIES["op12_turns"](spark, sf)
    assert sorted(map(tuple, rows.select(*want.columns).collect())) == sorted(want.fetchall())
