import hashlib
import heapq
import random
import re
import zlib

import pytest

from clearfold.llm import repair as rp
from clearfold.llm.queries import damaged, op13_structure_repair
from clearfold.session import cut

LEGAL = re.compile(r"(s?(ua)+)?")


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def shown(rows):
    """Rows in order, nulls as one space."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        text_shown = text.strip(" \t\n\x0b\x0c\r")
        if not text_shown:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text_shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """Least-cost, then least-letters edits, by Dijkstra over (row, roles so far cut to a state)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            assert LEGAL.fullmatch("".join(r[0] for r, _ in kept))
            return cost, audit, kept
        nxt = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}[state]
        heapq.heappush(heap, (cost + 2, audit + "I", i, nxt[1], (*kept, (nxt[0], ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, kept))
            if kinds[i] in ("", "truncated"):
                extra = kinds[i] == "truncated"
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role[:1]))
                if to is not None:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, to, (*kept, (role, text))))
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, nxt[1], (*kept, (nxt[0], text))))


def brute(rows):
    rows = shown(rows)
    kinds = faults(rows)
    initials = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, kept = cheapest(rows, kinds)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest(),
    )


def some_rows(seed, most=12):
    draw = random.Random(seed)
    rows = []
    for c in range(60):
        n = draw.randint(1, most)
        for _ in range(n):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"])
            text = draw.choice(["Yes.", "no", "", None, " \n", "What?\t", "aé.", "so!", "t1.", "t2", "t3.", "t4?"])
            turn = draw.choice([None, *range(n), 2 * n])
            rows += [(c, turn, role, text)] * draw.choice([1, 1, 1, 2])
    return rows + [(None, 0, "user", "x."), (None, 1, "tool", "y")]


def found(spark, rows, **sizes):
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = cut(turns.selectExpr("*", "1 AS g", "'x' AS rows", "2 AS n"))
    return {r["conv_id"]: tuple(r)[1:] for r in rp.report(turns, rp.repair(turns, **sizes)).collect()}


def want(rows):
    groups = {}
    for c, *row in rows:
        groups.setdefault(c, []).append(tuple(row))
    return {c: brute(v) for c, v in groups.items()}


@pytest.mark.parametrize("sizes", [{}, {"span": 3}, {"span": 1, "chunk_rows": 1}, {"span": 4, "chunk_rows": 2}])
def test_equals_brute_force(spark, sizes):
    rows = some_rows(1)
    assert found(spark, rows, **sizes) == want(rows)


def test_one_long_conversation_in_chunks(spark):
    draw = random.Random(9)
    rows = [(1, i, draw.choice(["user", "assistant"]) if draw.random() < 0.2 else ("user", "assistant")[i % 2], f"t{i}.") for i in range(900)]
    rows += [(1, 950, "user", "again and again.")] * 400 + [(2, None, "user", "again.")] * 50
    assert found(spark, rows, span=16, chunk_rows=20) == want(rows)


def test_fix_up_equals_a_full_run():
    draw = random.Random(4)
    for _ in range(300):
        n = draw.randint(0, 12)
        initials, marks = "".join(draw.choice("suax") for _ in range(n)), bytes(draw.randrange(3) for _ in range(n))
        old, new = rp.GUESS, rp.left_vector("".join(draw.choice("sua") for _ in range(4)), bytes(4), rp.END)
        assert rp.fix_up(initials, marks, old, new, rp.left_vector(initials, marks, old)) == rp.left_vector(initials, marks, new)


def test_empty(spark):
    assert found(spark, [(None, None, None, None)]) == want([(None, None, None, None)])
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert rp.repair(turns).count() == 0 and rp.report(turns, rp.repair(turns)).count() == 0


def damage(rows):
    out = []
    for c, t, r, x in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        out += [(c, t, "user" if code == 4 else r, x)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def test_damage(spark):
    rows = some_rows(3)
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert sorted(map(str, (tuple(r) for r in damaged(turns).collect()))) == sorted(map(str, damage(rows)))


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r["conv_id"]: tuple(r)[1:] for r in op13_structure_repair(spark, sf_dir).collect()}
    assert got == dict.fromkeys({r[0] for r in rows}, nothing) | want(damage(rows))
    repaired = rp.repaired_turns(rp.repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    by_conv = {}
    for r in repaired.orderBy("conv_key", "k", "place").collect():
        by_conv[r["conv_key"]] = by_conv.get(r["conv_key"], "") + r["role"][:1]
    assert by_conv and all(LEGAL.fullmatch(x) for x in by_conv.values())
