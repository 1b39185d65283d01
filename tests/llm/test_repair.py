"""Conversation repair against all edit lists and against a plain table over rows and roles."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tideline.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, extra int, fault string"


def by_table(rows):
    """Least (cost, audit) over rows of (initial, fault): fault f is deleted, t costs 3 to keep."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(cur):
        for _ in range(3):
            for q, (c, a) in list(cur.items()):
                cur[step[q]] = min(cur.get(step[q], (10**9, "")), (c + 3, a + "I"))
        return cur

    cur = inserted({"": (0, "")})
    for ini, fault in rows:
        new = defaultdict(lambda: (10**9, ""))
        for q, (c, a) in cur.items():
            new[q] = min(new[q], (c + 4, a + "D"))
            if fault != "f":
                more = 3 if fault == "t" else 0
                new[step[q]] = min(new[step[q]], (c + 3 + more, a + "R"))
                if ini == step[q] or ini == "s" and q == "":
                    new[ini] = min(new[ini], (c + more, a + "K"))
        cur = inserted(dict(new))
    return min(cur[q] for q in ("", "a") if q in cur)


def by_trying(rows, most):
    """The same by trying every edit list with few insertions."""
    best = (10**9, "")
    for kinds in itertools.product("DKua", repeat=len(rows)):
        for ins in itertools.product(range(most + 1), repeat=len(rows) + 1):
            for fill in itertools.product("ua", repeat=sum(ins)):
                fill, out, audit, cost = list(fill), "", "", 0
                for k in range(len(rows) + 1):
                    for _ in range(ins[k]):
                        out, audit, cost = out + fill.pop(0), audit + "I", cost + 3
                    if k == len(rows):
                        break
                    (ini, fault), e = rows[k], kinds[k]
                    if e == "D":
                        audit, cost = audit + "D", cost + 4
                        continue
                    cost += (10**9 if fault == "f" else 3 if fault == "t" else 0) + (0 if e == "K" else 3)
                    out, audit = out + (ini if e == "K" else e), audit + ("K" if e == "K" else "R")
                if re.fullmatch("(s?(ua)+)?", out):
                    best = min(best, (cost, audit))
    return best


def coded(rows):
    return [(repair.INITIALS.get(i, repair.START), {"f": repair.FORCED, "t": repair.TRUNCATED}.get(f, repair.SOUND)) for i, f in rows]


def test_table_agrees_with_trying_everything():
    rng = random.Random(3)
    for _ in range(40):
        rows = [(rng.choice("suax"), rng.choice("--tf")) for _ in range(rng.randint(0, 3))]
        assert by_table(rows) == by_trying(rows, 2), rows


@pytest.mark.parametrize("tight", [True, False])
def test_search_is_optimal_with_any_lower_bounds(tight):
    rng = random.Random(4)
    for _ in range(1500):
        rows = [(rng.choice("suuaax"), rng.choice("---tf")) for _ in range(rng.randint(0, 11))]
        code = coded(rows)
        low = repair.bounds(code, repair.DONE) if tight else [[0] * 4] * (len(code) + 1)
        assert repair.search(code, low)[:2] == by_table(rows), rows


def test_bounds_never_exceed_what_the_rest_costs():
    rng = random.Random(5)
    for _ in range(200):
        code = coded([(rng.choice("suax"), rng.choice("--tf")) for _ in range(rng.randint(1, 8))])
        low = repair.bounds(code, repair.DONE)
        for i in range(len(code) + 1):
            for q in range(4):
                assert low[i][q] <= repair.search(code[i:], [[0] * 4] * (len(code) - i + 1), q)[0]


def test_long_conversations_are_searched_in_linear_steps():
    rows = [("u", "-")] * 20000
    cost, audit, _ = repair.search(coded(rows), repair.bounds(coded(rows), repair.DONE))
    assert (cost, len(audit)) == (30_000, 20_000)  # every second row gets the other role


def damaged(rows):
    """Conversations after damage, by plain Python."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]  # noqa: B018
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out[conv] += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def expected(rows):
    want = {}
    for conv, lines in damaged(rows).items():
        seen, code, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in lines:
            solid = re.sub("[\x20\x09-\x0d]+\\Z", "", text)
            kind = "blank" if not re.search("[^\x20\x09-\x0d]", text) else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            if kind:
                n[kind] += 1
            code.append((role[:1] or "-", {"blank": "f", "duplicate": "f", "truncated": "t"}.get(kind, "-")))
        turns = {t for t, _, _ in lines if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(lines[:-1], lines[1:]))
        cost, audit = by_table(code)
        kept, rest, state = [], iter(lines), ""
        for letter in audit:
            turned = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            if letter == "I":
                kept.append((turned, ""))
                state = turned[0]
                continue
            _, role, text = next(rest)
            if letter != "D":
                role = turned if letter == "R" else role
                kept.append((role, text))
                state = role[0]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        want[conv] = (gaps, *n.values(), illegal, cost, audit, sha)
    return want


def result(df):
    rows = df.collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_against_plain_python(spark, sf):
    rows = [tuple(r.values()) for r in pq.read_table(f"{sf}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    got = result(queries.queries()["op11_structure_repair"](spark, sf))
    assert got == expected(rows) and got


def odd_rows():
    rng = random.Random(8)
    words = ["Yes.", "No!", "what", "", " \t", None, "Done. ", "zwölf?\n", "end\x0b", "a\xa0", "x" * 3000]
    roles = ["user", "assistant", "system", "tool", None, "", "usher", "ärger"]
    rows = [(c, rng.choice([None, -2, 0, 1, 2, 5, 9]), rng.choice(roles), rng.choice(words)) for c in [None, 1, 2, 3, 7] for _ in range(30)]
    rows += [(4, t, "user", "Again and again.") for t in range(40)] + [(5, 3, "user", "Same.")] * 25 + [(c, 1, "user", "Hi.") for c in range(50, 90)]
    rows += [(6, None, "assistant", "Late.")] * 3 + [(-9, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(-5, 70)]
    return rows


@pytest.mark.parametrize("long_rows,part_rows", [(10**6, 10**6), (20, 4), (0, 3), (0, 1)])
def test_odd_rows_on_both_paths(spark, long_rows, part_rows):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(5)
    assert result(repair.repair(df, long_rows=long_rows, part_rows=part_rows)) == expected(rows)


def test_lost_conversation_and_empty_table(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Gone.", 1, "")], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    for long_rows in (0, 10):
        assert result(repair.repair(df, long_rows=long_rows)) == {lost: (0, 0, 0, 0, 0, 0, "", empty)}
    assert repair.repair(df.filter(F.lit(False))).count() == 0


def test_very_long_text(spark):
    rows = [(1, 5, "user", "word " * 400_000 + "."), (1, 6, "assistant", "no end " * 200_000)]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    assert result(repair.repair(df)) == expected(rows) == result(repair.repair(df, long_bytes=1000))
