"""Conversation structure repair by depth-first branch-and-bound.

A conversation is damaged, its faults are counted, and the cheapest edits are
found that give its roles the form ``(s?(ua)+)?``. A node of the search is (rows
read, last role given); edits lead from node to node. The search keeps an
explicit stack, prunes by lower bounds of the rest, holds the best complete
(cost, audit) as incumbent, and a table at every node keeps the best prefix that
reached it: a dearer one, or one of equal cost whose audit is greater, goes no
further. Two audits of one node and cost never are prefixes of each other,
because every letter has its cost, so the table loses no optimum. The stack runs
empty only when no better edit list is left.

Rows are shuffled once, by conversation. Conversations beyond ``long_rows`` rows
or ``long_bytes`` bytes never meet in one task: their rows are dealt over range
shards, every shard is a segment of the search, and segments are joined by their
cost from each entry role to each exit role (see ``_long``).

Defined results
* null role, text, conv_id or turn reads as one space where a value is needed; a null
  conv_id is a conversation of its own, a null turn stands first and counts in no gap
* rows of one turn stand by role, then by text, after the damage; a repeated row follows itself
* a role whose initial is not s, u or a (an empty one too) can't be kept
* a conversation without rows after damage: zeros, empty audit, hash of the empty text
* an empty table gives no rows; more columns in the input are ignored
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship
from .groups import runs
from .store import Scratch
from .textblock import trimmed

SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
SOUND, FORCED, TRUNCATED = range(3)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The only role that an insertion or a new role can give after each role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
DONE = {START: 0, ASSISTANT: 0}
INFINITE = 1 << 60
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
STUB = 3  # more for a truncated row that stays

LONG_ROWS, LONG_BYTES, PART_ROWS = 50_000, 1 << 26, 50_000
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_rows long"

Row = tuple[int, int]  # role as a state (START: none of the three), fault


def after(state: int, role: int) -> bool:
    """Whether a row of this role may be kept after this state."""
    return role == SYSTEM and state == START or role == NEXT[state]


def bounds(rows: list[Row], ends: dict[int, int], last: bool = True) -> list[list[int]]:
    """For every row and state a lower bound of what the rows from there on cost.

    It follows roles and faults but knows nothing of audits. ``ends`` has the cost
    of ending in a state; behind the end of a segment that is not the ``last`` no
    row is inserted, the next segment may.
    """
    low = [ends.get(q, INFINITE) for q in range(4)]
    table = [low]
    if last:
        _insert(low)
    for role, fault in reversed(rows):
        stub = STUB if fault == TRUNCATED else 0
        here = []
        for q in range(4):
            best = DELETE + low[q]
            if fault != FORCED:
                best = min(best, REROLE + stub + low[NEXT[q]])
                if after(q, role):
                    best = min(best, KEEP + stub + low[role])
            here.append(best)
        _insert(here)
        table.append(here)
        low = here
    return table[::-1]


def _insert(low: list[int]) -> None:
    """Lower the bounds by insertions; more than two in a row come back to where they began."""
    for _ in range(2):
        for q in range(4):
            low[q] = min(low[q], INSERT + low[NEXT[q]])


class _Path:
    """An audit as a chain of letters."""

    __slots__ = ("before", "letter", "length")

    def __init__(self, before: _Path | None, letter: str):
        self.before, self.letter = before, letter
        self.length = before.length + 1 if before else 0

    def text(self) -> str:
        out, at = [], self
        while at.before:
            out.append(at.letter)
            at = at.before
        return "".join(reversed(out))


def _less(a: _Path, b: _Path) -> bool:
    """Whether a's audit is ASCII-less; as far back as the two differ only."""
    tie = a.length < b.length
    while a.length > b.length:
        a = a.before
    while b.length > a.length:
        b = b.before
    if a is b:
        return tie
    while a.before is not b.before:
        a, b = a.before, b.before
    return a.letter < b.letter


def search(rows: list[Row], low: list[list[int]], entry: int = START, ends: dict[int, int] = DONE, last: bool = True) -> tuple[int, str, int] | None:
    """Least cost, then ASCII-least audit, of bringing the rows from the entry state to one of the ends; and the end.

    ``low`` may be any table of lower bounds. None if no end can be reached.
    """
    n = len(rows)
    best: list[dict[int, tuple[int, _Path]]] = [{} for _ in range(n + 1)]
    found: tuple[int, _Path, int] | None = None
    root = _Path(None, "")
    best[0][entry] = (0, root)
    stack = [(0, entry, 0, root)]
    while stack:
        i, q, cost, path = stack.pop()
        if best[i][q][1] is not path or found and cost + low[i][q] > found[0]:
            continue  # a better prefix came by since, or no better end is left
        if i == n and q in ends:
            total = cost + ends[q]
            if total < INFINITE and (not found or total < found[0] or total == found[0] and _less(path, found[1])):
                found = (total, path, q)
        options = []
        if i < n:
            role, fault = rows[i]
            options.append(("D", i + 1, q, DELETE))
            if fault != FORCED:
                stub = STUB if fault == TRUNCATED else 0
                options.append(("R", i + 1, NEXT[q], REROLE + stub))
                if after(q, role):
                    options.append(("K", i + 1, role, KEEP + stub))
        if i < n or last:
            options.append(("I", i, NEXT[q], INSERT))
        options = [(cost + c + low[j][p], letter, j, p, cost + c) for letter, j, p, c in options]
        options.sort(reverse=True)  # the least bound, then the least letter, lies on top
        for bound, letter, j, p, spent in options:
            if bound >= INFINITE or found and bound > found[0]:
                continue
            step = _Path(path, letter)
            known = best[j].get(p)
            if known is None or spent < known[0] or spent == known[0] and _less(step, known[1]):
                best[j][p] = (spent, step)
                stack.append((j, p, spent, step))
    return (found[0], found[1].text(), found[2]) if found else None


def repaired(lines: list[tuple[str, str]], audit: str, state: int = START) -> Iterator[tuple[str, str]]:
    """Role and text of every row that the edits leave, from the rows and the audit."""
    rest = iter(lines)
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            yield NAMES[state], ""
            continue
        role, text = next(rest)
        if letter == "D":
            continue
        if letter == "R":
            state = NEXT[state]
            role = NAMES[state]
        else:
            state = INITIALS[role[:1]]
        yield role, text


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and fault of all rows after damage; dropped rows stay as marks."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    how = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(how <= 1, F.lit("")).when(how == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(how == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), (how == 0).alias("dropped"),
        F.explode(F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    solid = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(solid == "", FORCED).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    return rows.withColumn("fault", fault.cast("int")).drop("copy")


def _digest(role: str, text: str) -> bytes:
    r = role.encode()
    return hashlib.blake2b(len(r).to_bytes(4, "little") + r + text.encode(), digest_size=16).digest()


class _Conversation:
    """The rows of one conversation, as they come in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.lines, self.seen, self.turns = conv_id, [], [], set(), set()
        self.counts = [0, 0, 0]  # blank, duplicate, truncated
        self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        key = _digest(role, text)
        if fault == FORCED:
            self.counts[0] += 1
        elif key in self.seen:
            self.counts[1] += 1
            fault = FORCED
        elif fault == TRUNCATED:
            self.counts[2] += 1
        self.seen.add(key)
        if turn is not None:
            self.turns.add(turn)
        if self.lines and self.lines[-1][0][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.rows.append((INITIALS.get(role[:1], START), fault))
        self.lines.append((role, text))

    def result(self) -> tuple:
        cost, audit, _ = search(self.rows, bounds(self.rows, DONE))
        text = "\n".join(f"{r}:{t}" for r, t in repaired(self.lines, audit))
        gaps = max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0
        return (self.conv_id, gaps, *self.counts, self.illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), len(self.rows))


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at: _Conversation | None = None
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES_OUT)

    for new, piece in runs(batches, "conv_id"):
        if new:
            if at:
                out.append(at.result())
            at = _Conversation(piece.column(0)[0].as_py())
        for turn, role, text, dropped, fault in zip(*(piece.column(i).to_pylist() for i in range(1, 6)), strict=True):
            if not dropped:
                at.add(turn, role, text, fault)
        if len(out) >= 4096:
            yield made()
            out = []
    if at:
        out.append(at.result())
    if out:
        yield made()


NAMES_OUT = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.string() if x.split()[1] == "string" else pa.int64() for x in SCHEMA.split(", ")]


def _order() -> list:
    return ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]


def _within_tasks(rows: DataFrame) -> DataFrame:
    """Conversations that fit into a task, each read in order by one."""
    return rows.repartition("conv_id").sortWithinPartitions(*_order()).mapInArrow(trimmed(_short), SCHEMA)


# ------------------------------------------------------- conversations of any length

_PART = ["conv_id", "shard", "part"]


def _steps(g: pd.DataFrame) -> list[Row]:
    return list(zip(g["role"].tolist(), g["fault"].tolist(), strict=True))


def _costs(g: pd.DataFrame) -> pd.DataFrame:
    """Least cost of a segment from each entry state to each end state, and what its ends look like."""
    g = g.sort_values("pos")
    rows, ini = _steps(g), g["initial"].tolist()
    cost = [c for q in range(4) for c in bounds(rows, {q: 0}, last=False)[0]]  # end by end
    key = [g[c].iloc[0] for c in _PART]
    wrong = sum(a + b not in LEGAL for a, b in zip(ini[:-1], ini[1:], strict=True))
    return pd.DataFrame([[*key, cost, ini[0], ini[-1], wrong]], columns=[*_PART, "cost", "first", "final", "illegal"])


def _chain(g: pd.DataFrame) -> pd.DataFrame:
    """Cost of the rest behind every segment of a conversation, from the last one back; a row a segment."""
    g = g.sort_values(["shard", "part"]).reset_index(drop=True)
    low = [DONE.get(q, INFINITE) for q in range(4)]
    _insert(low)
    out = []
    for k in range(len(g) - 1, -1, -1):
        is_last = k == len(g) - 1
        out.append([list(low), is_last])
        cost = g["cost"].iloc[k]
        low = [min(min(int(cost[4 * p + q]) + low[p] for p in range(4)), INFINITE) for q in range(4)]
    g["ends"], g["last"] = [x[0] for x in out[::-1]], [x[1] for x in out[::-1]]
    joints = sum(a + b not in LEGAL for a, b in zip(g["final"][:-1], g["first"][1:], strict=True))
    g["total"], g["illegal"] = low[START], int(g["illegal"].sum()) + joints
    return g[[*_PART, "ends", "last", "total", "illegal"]]


def _solve(key: tuple, g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
    """Best audit and end of a segment for each entry state."""
    rows, last = _steps(g.sort_values("pos")), bool(c["last"].iloc[0])
    ends = DONE if last else {q: int(v) for q, v in enumerate(c["ends"].iloc[0]) if v < INFINITE}
    low = bounds(rows, ends, last)
    got = [search(rows, low, q, ends, last) for q in range(4)]
    return pd.DataFrame([[*key, [x[1] if x else None for x in got], [x[2] if x else START for x in got], int(c["total"].iloc[0]), int(c["illegal"].iloc[0])]], columns=[*_PART, "audits", "exits", "total", "illegal"])


def _entries(g: pd.DataFrame) -> pd.DataFrame:
    """The entry state of every segment of a conversation, from the first one on."""
    g = g.sort_values(["shard", "part"]).reset_index(drop=True)
    state, out = START, []
    for exits in g["exits"]:
        out.append(state)
        state = int(exits[state])
    g["entry"] = out
    return g[[*_PART, "entry"]]


def _edits(key: tuple, g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
    """What becomes of every row of a segment: lines set before and behind it, and its new role's name."""
    state, at, out, before = int(c["entry"].iloc[0]), 0, [], []
    roles = g.sort_values("pos")
    pos, role = roles["pos"].tolist(), roles["role"].tolist()
    for letter in c["audit"].iloc[0]:
        if letter == "I":
            state = NEXT[state]
            before.append(f"{NAMES[state]}:")
            continue
        new = None
        if letter == "R":
            state = NEXT[state]
            new = NAMES[state]
        elif letter == "K":
            state = role[at]
        out.append([pos[at], letter, "\n".join(before) if before else None, new, None])
        before = []
        at += 1
    if before:
        out[-1][4] = "\n".join(before)
    return pd.DataFrame(out, columns=["pos", "letter", "before", "new_role", "behind"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, as they stream by."""
    ids, shas, h, empty = [], [], None, True
    for new, piece in runs(batches, "conv_id"):
        if new:
            if h:
                shas.append(h.hexdigest())
            ids.append(piece.column(0)[0].as_py())
            h, empty = hashlib.sha256(), True
        for line in piece.column(2).to_pylist():
            if line is not None:
                h.update(("" if empty else "\n").encode() + line.encode())
                empty = False
    if h:
        shas.append(h.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.string())], names=["conv_id", "repaired_sha256"])


def _long(rows: DataFrame, scratch: Scratch, part_rows: int = PART_ROWS) -> DataFrame:
    """Conversations of any length: no task holds more than ``part_rows`` rows of one, texts only stream by.

    Rows get their place from range shards of (conv_id, turn, role, text). The chain
    over a conversation's segments has one small row a segment. The one thing that has to
    pass one task in order is the repaired text on its way into SHA-256.
    """
    key = ["conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 256)]
    rows = rows.filter(~F.col("dropped")).repartitionByRange(*key).sortWithinPartitions(*_order()).withColumn("pos", F.monotonically_increasing_id())
    rows = scratch.keep(rows, "ordered")
    name = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    firsts = rows.groupBy("conv_id", name.alias("name")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    initial = F.substring("role", 1, 1)
    state = F.coalesce(F.create_map(*(F.lit(x) for p in INITIALS.items() for x in p))[initial], F.lit(START))
    codes = rows.select(
        "conv_id", "turn", "pos", initial.alias("initial"), state.alias("role"), F.col("fault").alias("own"),
        F.shiftright("pos", 33).alias("shard"), F.floor(F.col("pos").bitwiseAND((1 << 33) - 1) / part_rows).alias("part"),
    )
    codes = codes.join(firsts, "pos", "left").withColumn("again", F.col("is_first").isNull() & (F.col("own") != FORCED))
    codes = scratch.keep(codes.withColumn("fault", F.when(F.col("again"), FORCED).otherwise(F.col("own"))).drop("is_first"), "codes")
    turns = codes.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), *(F.sum(c.cast("long")).alias(n) for n, c in (
        ("blank", F.col("own") == FORCED), ("duplicate", F.col("again")), ("truncated", ~F.col("again") & (F.col("own") == TRUNCATED)))))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))  # one row a turn by now
    counts = turns.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum("n").alias("n_rows"))
    steps = codes.select(*_PART, "pos", "role", "fault", "initial")
    part = "conv_id long, shard long, part long"
    costs = steps.groupBy(*_PART).applyInPandas(_costs, f"{part}, cost array<long>, first string, final string, illegal long")
    chain = costs.groupBy("conv_id").applyInPandas(_chain, f"{part}, ends array<long>, last boolean, total long, illegal long")
    solved = steps.groupBy(*_PART).cogroup(chain.groupBy(*_PART)).applyInPandas(_solve, f"{part}, audits array<string>, exits array<int>, total long, illegal long")
    solved = scratch.keep(solved, "solved")
    entries = solved.select(*_PART, "exits").groupBy("conv_id").applyInPandas(_entries, f"{part}, entry int")
    same = [solved[c].eqNullSafe(entries[c]) for c in _PART]
    chosen = solved.join(entries, on=same).select(*(solved[c] for c in _PART), "entry", "total", "illegal", F.expr("audits[entry]").alias("audit"))
    chosen = scratch.keep(chosen, "chosen")
    edits = steps.groupBy(*_PART).cogroup(chosen.groupBy(*_PART)).applyInPandas(_edits, "pos long, letter string, before string, new_role string, behind string")
    stays = F.when(F.col("letter") != "D", F.concat_ws(":", F.coalesce("new_role", "role"), "text"))
    line = F.concat_ws("\n", "before", stays, "behind")  # nulls are left out
    line = F.when(F.coalesce(F.col("before"), stays, F.col("behind")).isNotNull(), line)
    lines = rows.join(edits, "pos").select("conv_id", "pos", line.alias("line"))
    hashes = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(trimmed(_hashes), "conv_id long, repaired_sha256 string")
    audits = chosen.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("shard", "part", "audit"))), lambda x: x["audit"]), "").alias("audit"), F.max("total").alias("cost"), F.max("illegal").alias("illegal"))
    # conv_id may be null, so joins compare a text that is not
    known = lambda df: df.withColumn("id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    out = known(counts).join(known(audits).drop("conv_id"), "id").join(known(hashes).drop("conv_id"), "id")
    return out.select(*NAMES_OUT)


def repair(conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, part_rows: int = PART_ROWS) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of every conversation, after damage."""
    spark = ship(conversations.sparkSession)
    scratch = Scratch(spark, "repair")
    size = F.sum(F.coalesce(F.octet_length("role"), F.lit(1)) + F.coalesce(F.octet_length("text"), F.lit(1)).cast("long"))
    sizes = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.count("*").alias("rows"), size.alias("bytes"))
    large = scratch.keep(sizes.filter((F.col("rows") > long_rows) | (F.col("bytes") > long_bytes)).select("conv_id"), "large")
    rows = damage(conversations).select("conv_id", "turn", "role", "text", "dropped", "fault")
    if large.isEmpty():
        return _within_tasks(rows)
    large = large.withColumnRenamed("conv_id", "large_id")
    same = F.col("conv_id").eqNullSafe(F.col("large_id"))
    # a mark for each keeps those that lost all their rows
    marks = large.select(F.col("large_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(True).alias("dropped"), F.lit(0).alias("fault"))
    whole = _long(rows.join(large, same, "left_semi"), scratch, part_rows)
    whole = scratch.keep(whole, "long")
    lost = marks.join(whole.select(F.col("conv_id").alias("done_id")), F.col("conv_id").eqNullSafe(F.col("done_id")), "left_anti")
    return _within_tasks(rows.join(large, same, "left_anti").unionByName(lost)).unionByName(whole)


def _sql() -> str:
    """The same for whole tables in DuckDB: a recursive table over rows, with the best (cost, audit, text) after each role.

    There a null conv_id or turn is none of the test tables' cases.
    """
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ord(ch)::BIGINT)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))))"
    )
    made = lambda s, cost, letter, line: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {s}.t || {line}}} END"
    line = "chr(10) || {0} || ':' || x"
    least = lambda *o: f"list_min([{', '.join(o)}])"
    kept = lambda s, ini: f"CASE WHEN ini = '{ini}' THEN {made(s, 'stub', 'K', line.format('role'))} END"
    turned = lambda s, name: made(s, "stub + 3", "R", line.format(f"'{name}'"))
    forced = lambda o: f"CASE WHEN NOT forced THEN {o} END"
    ins = lambda s, name: made(s, 3, "I", f"chr(10) || '{name}:'")
    gone = lambda s: made(s, 4, "D", "''")
    from_u = [o for s in ("p0", "p1", "p3") for o in (forced(kept(s, "u")), forced(turned(s, "user")))]
    return f"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS how
  FROM conversations),
rows_left AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS x,
    unnest(CASE WHEN how = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hit WHERE how <> 0),
numbered AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, x ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid, lag(left(role, 1)) OVER w AS before
  FROM rows_left WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, x, copy)),
faults AS (
  SELECT *, solid = '' AS blank, solid <> '' AND again AS duplicate, solid <> '' AND NOT again AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated
  FROM numbered),
steps AS (
  SELECT conv_id, i, role, x, left(role, 1) AS ini, blank OR duplicate AS forced, CASE WHEN truncated THEN 3 ELSE 0 END AS stub FROM faults),
blank_start AS (SELECT DISTINCT conv_id, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s FROM conversations),
start_u AS (SELECT *, {ins("s", "user")} AS u FROM blank_start),
best AS (
  SELECT conv_id, 0::BIGINT AS i, s AS p0, CASE WHEN false THEN s END AS p1, u AS p2, {ins("u", "assistant")} AS p3 FROM start_u
  UNION ALL
  SELECT conv_id, i, q0, q1, {least("u1", ins("a1", "user"))}, a1
  FROM (SELECT *, {least("q3", ins("u1", "assistant"))} AS a1
    FROM (SELECT *, {least("q2", ins("q0", "user"), ins("q1", "user"), ins("q3", "user"))} AS u1
      FROM (SELECT r.conv_id, r.i, {gone("p0")} AS q0,
          {least(gone("p1"), forced(kept("p0", "s")))} AS q1,
          {least(gone("p2"), *from_u)} AS q2,
          {least(gone("p3"), forced(kept("p2", "a")), forced(turned("p2", "assistant")))} AS q3
        FROM best b JOIN steps r ON r.conv_id = b.conv_id AND r.i = b.i + 1)))),
ends AS (SELECT conv_id, arg_max({least("p0", "p3")}, i) AS e FROM best GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (i > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows
  FROM faults GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, e.c AS cost, e.a AS audit, sha256(substr(e.t, 2)) AS repaired_sha256, coalesce(n_rows, 0) AS n_rows
FROM ends LEFT JOIN counts USING (conv_id)"""


SQL = _sql()
