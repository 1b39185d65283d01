"""Tool-call linking: calls and results joined by identifier, ordered and checked.

Calls are (conv_id, turn, call_id, name, arguments, after), results are
(conv_id, turn, call_id, content); ``arguments`` is JSON text and ``after`` the
identifier of a call whose result must come first. Both sides meet in a hash
join on (conv_id, call_id), so a conversation of any length spreads over all
tasks. The order is a key, not a running number, so no task sees a whole
conversation: (turn, rank), where a result never precedes its call nor a call
the result it waits for. Chains of waiting calls are settled by pointer doubling.

Defined results
* a call or result without conversation or identifier is kept as ``no_id``
* calls that repeat an identifier are one call, the earliest; ``copies`` counts them
* results may repeat: each is linked; a result without call is ``orphan``
* arguments: ``ok``, ``bad_json`` (null, not JSON or no object), ``bad_arguments``
  (a field of the schema is missing, too short or of another type), ``unknown_tool``
* calls on or behind a cycle are ``cyclic``
* empty tables give no rows; more columns in the inputs are ignored
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

KEYS = ["conv_id", "call_id"]


@dataclass(frozen=True)
class Field:
    """One argument: JSON type, whether it must be there, and a string's least length."""

    kind: str
    required: bool = True
    least: int = 0


Schemas = dict[str, dict[str, Field]]

_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}


def _fits(value: Column, name: str, field: Field) -> Column:
    at = F.try_variant_get(value, f"$.{name}", "variant")
    kind = F.schema_of_variant(at)
    good = kind.rlike(_TYPES[field.kind])
    if field.kind == "string" and field.least:
        good = good & (F.char_length(F.try_variant_get(value, f"$.{name}", "string")) >= field.least)
    missing = at.isNull() | (kind == "VOID")
    return F.coalesce(F.when(missing, F.lit(not field.required)).otherwise(good), F.lit(False))


def check_arguments(name: Column, value: Column, schemas: Schemas) -> Column:
    """Status of parsed arguments under the schema of their tool."""
    out = F.when(value.isNull() | ~F.schema_of_variant(value).startswith("OBJECT"), "bad_json")
    for tool, fields in schemas.items():
        good = reduce(lambda a, b: a & b, [_fits(value, f, spec) for f, spec in fields.items()], F.lit(True))
        out = out.when(name == tool, F.when(good, "ok").otherwise("bad_arguments"))
    return out.otherwise("unknown_tool")


def _order(turn: Column, rank: Column) -> Column:
    return F.struct(turn.cast("long").alias("turn"), rank.cast("int").alias("rank"))


def _ordered_calls(calls: DataFrame, results: DataFrame, scratch: Scratch) -> DataFrame:
    """Calls with an order key after the first result of the call each waits for.

    A call waits for one other at most, so every round doubles the part of its
    chain that its key regards; what still waits after more steps than the
    conversation has edges is on or behind a cycle and keeps its own turn.
    """
    first = results.groupBy(*KEYS).agg(F.min("turn").alias("result_turn"))
    calls = calls.withColumn("at", _order(F.col("turn"), F.lit(0)))
    done = calls.join(first, KEYS).select("conv_id", F.col("call_id").alias("after"), F.col("result_turn"), F.greatest(_order(F.col("result_turn"), F.lit(0)), _order(F.col("at.turn"), F.col("at.rank") + 1)).alias("done"))
    edges = calls.filter("after is not null").join(done, ["conv_id", "after"]).select(*KEYS, "after", "result_turn", "at", "done")
    if edges.filter(F.col("done") >= F.col("at")).isEmpty():
        return calls.withColumn("cyclic", F.lit(False))
    most = edges.groupBy("conv_id").count().agg(F.max("count")).first()[0]
    waits = edges.select(*KEYS, F.col("after").alias("jump"), F.greatest("at", _order(F.col("result_turn"), F.lit(1))).alias("best"))
    now = scratch.keep(calls.select(*KEYS, "at").join(waits, KEYS, "left").select(*KEYS, "jump", F.coalesce("best", "at").alias("best")), "chains")
    step = 1
    while step <= most and not now.filter("jump is not null").isEmpty():
        far = now.select("conv_id", F.col("call_id").alias("jump"), F.col("jump").alias("next"), F.col("best").alias("there"))
        best = F.greatest("best", _order(F.col("there.turn"), F.col("there.rank") + 2 * step))
        now = scratch.keep(now.join(far, ["conv_id", "jump"], "left").select(*KEYS, F.col("next").alias("jump"), best.alias("best")), "chains")
        step *= 2
    cyclic = F.col("jump").isNotNull()
    return calls.join(now, KEYS).withColumn("cyclic", cyclic).withColumn("at", F.when(cyclic, F.col("at")).otherwise(F.col("best"))).drop("jump", "best")


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call and result, with its order key, status and canonical JSON."""
    scratch = Scratch(calls.sparkSession, "chat")
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after")
    results = results.select("conv_id", "turn", "call_id", "content")
    one = calls.filter(known).groupBy(*KEYS).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"), F.count("*").alias("copies")).select(*KEYS, "c.*", "copies")
    named = results.filter(known)
    one = _ordered_calls(scratch.keep(one, "calls"), named, scratch)
    answers = named.groupBy(*KEYS).agg(F.count("*").alias("n_results"))
    call_rows = one.join(answers.hint("shuffle_hash"), KEYS, "left").select(
        *KEYS, F.lit("call").alias("kind"), "name", "arguments", F.lit(None).cast("string").alias("content"), "copies", "at", "cyclic",
        F.coalesce("n_results", F.lit(0).cast("long")).alias("links"), F.lit(True).alias("identified"),
    )
    caller = one.select(*KEYS, "name", F.col("at").alias("call_at"), "cyclic").hint("shuffle_hash")
    after_call = F.when(F.col("call_at").isNotNull(), _order(F.col("call_at.turn"), F.col("call_at.rank") + 1))
    result_rows = named.join(caller, KEYS, "left").select(
        *KEYS, F.lit("result").alias("kind"), "name", F.lit(None).cast("string").alias("arguments"), "content", F.lit(1).cast("long").alias("copies"),
        F.greatest(_order(F.col("turn"), F.lit(0)), after_call).alias("at"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        F.col("call_at").isNotNull().cast("long").alias("links"), F.lit(True).alias("identified"),
    )

    def loose(df: DataFrame, kind: str) -> DataFrame:
        empty = F.lit(None).cast("string")
        return df.filter(~known).select(
            *KEYS, F.lit(kind).alias("kind"), (F.col("name") if kind == "call" else empty).alias("name"), (F.col("arguments") if kind == "call" else empty).alias("arguments"),
            (F.col("content") if kind == "result" else empty).alias("content"), F.lit(1).cast("long").alias("copies"), _order(F.col("turn"), F.lit(0)).alias("at"),
            F.lit(False).alias("cyclic"), F.lit(0).cast("long").alias("links"), F.lit(False).alias("identified"),
        )

    rows = reduce(DataFrame.unionByName, [call_rows, result_rows, loose(calls, "call"), loose(results, "result")])
    rows = rows.withColumn("value", F.try_parse_json("arguments"))
    status = (
        F.when(~F.col("identified"), "no_id").when(F.col("cyclic"), "cyclic")
        .when(F.col("kind") == "result", F.when(F.col("links") > 0, "ok").otherwise("orphan"))
        .otherwise(check_arguments(F.col("name"), F.col("value"), schemas))
    )
    # fields in alphabetical order; a variant's keys are sorted already, and nulls are left out
    call_json = F.to_json(F.struct(F.col("value").alias("arguments"), F.col("call_id").alias("id"), "name", F.lit("call").alias("type")))
    result_json = F.to_json(F.struct("content", F.col("call_id").alias("id"), "name", F.lit("result").alias("type")))
    return rows.withColumn("status", status).select(
        "conv_id", F.col("at.turn").alias("order_turn"), F.col("at.rank").alias("order_rank"), "kind", "call_id", "name", "status", "links", "copies",
        F.when(F.col("kind") == "call", call_json).otherwise(result_json).alias("json"),
    )


#: A turn asked of the assistant, as a tool.
TURN_SCHEMAS: Schemas = {
    "ask": {"prompt": Field("string", least=1), "turn": Field("integer")},
    "configure": {"prompt": Field("string", least=1), "turn": Field("integer")},
}


def calls_of_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain chat turns: a user or system turn calls, the assistant's next turn answers.

    A user turn waits for the answer to the user turn two before it.
    Turns of any other role, or of none, give no row, as in ``TURNS_SQL``.
    """
    ident = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    asked = F.col("role").isin("user", "system")
    calls = messages.filter(asked).select(
        "conv_id", "turn", F.when(F.col("turn").isNotNull(), ident(F.col("turn"))).alias("call_id"),
        F.when(F.col("role") == "user", "ask").otherwise("configure").alias("name"),
        F.to_json(F.struct("turn", F.col("text").alias("prompt"))).alias("arguments"),
        F.when(F.col("turn") >= 2, ident(F.col("turn") - 2)).alias("after"),
    )
    results = messages.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.when(F.col("turn").isNotNull(), ident(F.col("turn") - 1)).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


def link_turns(messages: DataFrame) -> DataFrame:
    return link(*calls_of_turns(messages), TURN_SCHEMAS)


#: ``link_turns`` over ``conversations`` that hold each turn once.
TURNS_SQL = """
WITH m AS (SELECT conv_id, turn, role, text FROM conversations),
calls AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, CASE role WHEN 'user' THEN 'ask' ELSE 'configure' END AS name, text FROM m WHERE role IN ('user', 'system')),
results AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text FROM m WHERE role = 'assistant'),
answers AS (SELECT conv_id, call_id, count(*) AS n FROM results GROUP BY ALL)
SELECT c.conv_id, c.turn AS order_turn, cast(0 AS int) AS order_rank, 'call' AS kind, c.call_id, c.name, CASE WHEN length(text) >= 1 THEN 'ok' ELSE 'bad_arguments' END AS status,
       coalesce(a.n, 0) AS links, cast(1 AS bigint) AS copies,
       '{"arguments":{' || coalesce('"prompt":' || to_json(text) || ',', '') || '"turn":' || c.turn || '},"id":"' || c.call_id || '","name":"' || c.name || '","type":"call"}' AS json
FROM calls c LEFT JOIN answers a ON c.conv_id = a.conv_id AND c.call_id = a.call_id
UNION ALL
SELECT r.conv_id, r.turn, 0, 'result', r.call_id, c.name, CASE WHEN c.call_id IS NULL THEN 'orphan' ELSE 'ok' END, CASE WHEN c.call_id IS NULL THEN 0 ELSE 1 END, 1,
       '{' || coalesce('"content":' || to_json(r.text) || ',', '') || '"id":"' || r.call_id || '"' || coalesce(',"name":"' || c.name || '"', '') || ',"type":"result"}'
FROM results r LEFT JOIN calls c ON r.conv_id = c.conv_id AND r.call_id = c.call_id
"""
