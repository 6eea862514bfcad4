import hashlib
import heapq
import random
import re
import zlib

import pytest

from tallyglass.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, copies int, symbol string"
ORDER = {"": "su", "s": "u", "u": "a", "a": "u"}


def brute(rows):
    """Dijkstra over (rows consumed, state) by (cost, audit): the cheapest edits, the ASCII-least of them; plain Python."""
    seen, marks = set(), []
    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        marks.append(fault)
        if fault:
            counts[fault] += 1
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        put = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[put]
        heapq.heappush(heap, (cost + 5, audit + "I", i, put, (*lines, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if marks[i] not in ("blank", "duplicate"):
                more = 5 * (marks[i] == "truncated")
                if role[:1] and role[:1] in ORDER[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, put, (*lines, f"{name}:{text}")))
    turns = {r[0] for r in rows if r[0] is not None}
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return {"gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def damaged(rows):
    """conv_id -> rows after damage in order."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if fault == 4 else role
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out.setdefault(conv, []).extend([(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1))
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def check(spark, rows, **options):
    got = cr.repair(cr.damaged(spark.createDataFrame(rows, SCHEMA)), **options).collect()
    got = {r["conv_id"]: {c: v for c, v in r.asDict().items() if c != "conv_id"} for r in got}
    want = {conv: brute(own) for conv, own in damaged(rows).items()}
    assert got == want
    return got


def invented(n, seed, longest=9):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u2"]
    texts = ["Fine.", "Why?", "no end", " ", "", None, "A b c!", "x. \n", "é世😀.", " "]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            rows.append((None if conv == 3 else conv, rng.choice([turn, turn * 2, None, 3]) if conv % 4 == 0 else turn, rng.choice(roles), rng.choice(texts) if conv % 2 else f"t{turn}.", 9, "z"))
    return rows


def test_against_brute_force(spark):
    edits = "".join(v["audit"] for v in check(spark, invented(250, 1)).values())
    assert set(edits) == set("DIKR")


@pytest.mark.parametrize("bits,piece", [(0, 3), (2, 1 << 20)])
def test_long_conversations_go_by_blocks(spark, bits, piece):
    check(spark, invented(60, 2, 25), long_rows=4, block_bits=bits, piece=piece)


def test_a_hot_conversation_and_long_texts(spark):
    rng = random.Random(5)
    hot = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{i}.", "same.", "open"]), 0, "") for i in range(3000)]
    hot += [(7, 5000, "user", "alike.", 0, "")] * 500 + [(8, 1, "user", "x" * 300_000, 0, ""), (8, 2, "assistant", "y " * 200_000 + ".", 0, "")]
    check(spark, hot + invented(20, 3), long_rows=1000, long_bytes=400_000, block_bits=6, piece=1000)


def test_every_symbol_and_state_of_the_automaton():
    rng, automaton = random.Random(0), cr.Determinised()
    for _ in range(400):
        symbols = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 8)))
        rows = [(i, {"s": "system", "u": "user", "a": "assistant"}.get(s.lower(), "tool"), "" if s == "x" else f"t{i}" + ("" if s.isupper() else ".")) for i, s in enumerate(symbols)]
        cost, edits, last = automaton.solve(symbols)
        want = brute(rows)
        assert (cost, "".join(edits) + last) == (want["cost"], want["audit"])
    # finitely many states, met again and again
    assert len(automaton.vectors) < 60 and len(automaton.steps) <= 9 * len(automaton.vectors)


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out = check(spark, [(gone, 0, "user", "Hi.", 0, "")])
    assert out[gone] == {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    assert check(spark, []) == {}
    check(spark, [(gone, 0, "user", "Hi.", 0, "")] + invented(5, 4), long_rows=0)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: r.asDict() for r in cr.op13(spark, sf).collect()}
    want = {conv: {"conv_id": conv, **brute(own)} for conv, own in damaged(rows).items()}
    assert got == want
