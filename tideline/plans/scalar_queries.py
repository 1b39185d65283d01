"""Each scalar function over a whole test table, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S
from .catalog import query
from .fixtures import view, with_views

HEX = "0123456789abcdef"


def _add(name: str, source: str, key: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str]) -> None:
    text = with_views(f"SELECT {key}, {', '.join(f'{e} AS {n}' for n, e in sql.items())} FROM {source}")

    def run(spark, sf_dir):
        return view(spark, sf_dir, source).select(key, *[c.alias(n) for n, c in columns().items()])

    query(name, text)(run)


def _stamp(ms: str) -> str:
    return f"make_timestamp(({ms}) * 1000)"


_add("f1_ts_to_date", "v_pages", "event_id", lambda: {"d": S.ts_to_date("ts")}, {"d": f"strftime({_stamp('ts')}, '%Y-%m-%d')"})
_add("f2_ts_to_datetime", "v_pages", "event_id", lambda: {"d": S.ts_to_datetime("ts")}, {"d": f"strftime({_stamp('ts')}, '%Y-%m-%d %H:%M:%S')"})
_add("f3_ts_to_partition", "v_pages", "event_id", lambda: {"d": S.ts_to_partition("ts")}, {"d": f"strftime({_stamp('ts')}, '%Y%m%d')"})
_add("f4_datetime_to_ts", "v_pages", "event_id", lambda: {"ms": S.datetime_to_ts(S.ts_to_datetime("ts"))}, {"ms": "(ts // 1000) * 1000 - 28800000"})
_add("f5_date_to_ts", "v_pages", "event_id", lambda: {"ms": S.date_to_ts(S.ts_to_date("ts"))}, {"ms": "(ts // 86400000) * 86400000 - 28800000"})
_add(
    "f6_format_ts", "events", "event_id", lambda: {"a": S.format_ts(F.col("ts").cast("timestamp")), "b": S.format_ts(F.col("ts").cast("timestamp"), "HH:mm dd/MM/yyyy")},
    {"a": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "b": "strftime(ts, '%H:%M %d/%m/%Y')"},
)
_add("f7_ms_string_to_date", "v_detail", "id", lambda: {"d": S.ms_string_to_date("create_time")}, {"d": f"strftime({_stamp('ts')}, '%Y-%m-%d')"})
_add("f8_event_time", "v_pages", "event_id", lambda: {"us": F.unix_micros(S.event_time("ts"))}, {"us": "ts * 1000"})
_add(
    "f10_day_partitions", "orders", "o_orderkey",
    lambda: {
        "days": F.array_join(S.day_list(F.col("o_orderdate").cast("date"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 4).cast("int"))), ","),
        "none": F.size(S.day_list(F.col("o_orderdate").cast("date"), F.date_sub(F.col("o_orderdate").cast("date"), 1))),
    },
    {
        "days": "array_to_string(list_transform(range(0, o_orderkey % 4 + 1), lambda i: strftime(o_orderdate + to_days(cast(i AS int)), '%Y%m%d')), ',')",
        "none": "cast(0 AS int)",
    },
)
_add(
    "f11_amount", "v_detail", "id", lambda: {"a": S.amount("sku_num", "order_price").cast("string")},
    {"a": "cast(cast(sku_num AS decimal(9,2)) * cast(order_price AS decimal(9,2)) AS string)"},
)
_add("f12_conditional", "v_orders", "id", lambda: {"a": F.when(F.col("code") > "2", F.col("user_id")).otherwise(F.col("province_id"))}, {"a": "CASE WHEN code > '2' THEN user_id ELSE province_id END"})
_add(
    "f13_field", "v_orders", "id", lambda: {"a": S.field(F.create_map(F.lit("k"), F.col("code")), "k"), "b": S.field(F.create_map(F.lit("k"), F.col("code")), "none")},
    {"a": "code", "b": "cast(NULL AS string)"},
)
_add("f14_json_field", "events", "event_id", lambda: {"k": F.from_json("props", "k bigint")["k"]}, {"k": "K(props)"})

_BUCKET = " + ".join(f"(strpos('{HEX}', substr(md5(id), {30 + i}, 1)) - 1) * {16 ** (2 - i)}" for i in range(3))
_add("f15_hash_mod", "v_detail", "id", lambda: {"b": S.hash_mod("id", 128)}, {"b": f"lpad(cast(({_BUCKET}) % 128 AS string), 4, '0')"})
_add(
    "f16_hash_mod_hot", "v_detail", "id", lambda: {"b": S.hash_mod_hot("id", {"7-1": "9001", "8-2": "9002"})},
    {"b": f"CASE lower(id) WHEN '7-1' THEN '9001' WHEN '8-2' THEN '9002' ELSE lpad(cast(({_BUCKET}) % 128 AS string), 4, '0') END"},
)


def _big() -> Column:
    return F.col("l_orderkey") * 1000003 + F.col("l_partkey")


_add(
    "f17_hex_to_decimal", "lineitem", "l_orderkey",
    lambda: {
        "a": S.hex_to_decimal(F.concat(F.lit("0x"), F.hex(_big()))), "b": S.hex_to_decimal(_big().cast("string"), True), "c": S.hex_to_decimal(F.lit(None).cast("string")),
        "long": S.hex_to_decimal(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(_big())), 64, "0"))), "wei": S.hex_to_decimal(F.concat("l_partkey", F.lit("5" + "0" * 17)), True),
        "signed": S.hex_to_decimal(F.concat(F.lit("-"), _big().cast("string"), F.lit(".50"))), "power": S.hex_to_decimal(F.concat("l_partkey", F.lit("e3"))),
    },
    {
        "a": "cast(l_orderkey * 1000003 + l_partkey AS string)", "b": "rtrim('0.' || lpad(cast(l_orderkey * 1000003 + l_partkey AS string), 18, '0'), '0')", "c": "'0'",
        "long": "cast(l_orderkey * 1000003 + l_partkey AS string)", "wei": "l_partkey || '.5'", "signed": "'-' || (l_orderkey * 1000003 + l_partkey) || '.50'", "power": "CASE l_partkey WHEN 0 THEN '0' ELSE l_partkey || '000' END",
    },
)
_add(
    "f18_append_json_list", "events", "event_id",
    lambda: {"a": S.append_json_list(F.concat(F.lit('["'), "event_type", F.lit('"]')), F.col("user_id").cast("string")), "b": S.append_json_list(F.lit(None).cast("string"), F.col("event_type"))},
    {"a": """'["' || event_type || '","' || user_id || '"]'""", "b": """'["' || event_type || '"]'"""},
)
_add("f19_hex_words", "v_detail", "id", lambda: {"w": F.array_join(S.hex_words(F.concat(F.lit("0x"), F.repeat(F.md5(F.col("id")), F.lit(5)))), "|")}, {"w": "'0x' || repeat(md5(id), 2) || '|0x' || repeat(md5(id), 2)"})
_add(
    "f20_join", "part", "p_partkey", lambda: {"a": S.to_csv(F.array("p_name", F.lit(None).cast("string"), "p_brand")), "b": S.to_csv(F.array("p_name", "p_type"), "-")},
    {"a": "p_name || ', ' || p_brand", "b": "p_name || '-' || p_type"},
)
_add(
    "f21_first_letter", "part", "p_partkey", lambda: {"a": S.capitalise_first("p_name"), "b": S.lowercase_first("p_brand")},
    {"a": "upper(substr(p_name, 1, 1)) || substr(p_name, 2)", "b": "lower(substr(p_brand, 1, 1)) || substr(p_brand, 2)"},
)
_add("f22_repeat", "part", "p_partkey", lambda: {"a": S.zeros((F.col("p_size") % 9).cast("int")), "b": S.repeat("p_type", 2)}, {"a": "repeat('0', p_size % 9)", "b": "p_type || p_type"})
_add(
    "f23_empty_blank", "v_detail", "id",
    lambda: {"a": S.is_empty("split_coupon_amount"), "b": S.is_blank(F.coalesce("split_coupon_amount", F.lit(" \t"))), "c": S.is_blank("id")},
    {"a": "split_coupon_amount IS NULL", "b": "split_coupon_amount IS NULL", "c": "false"},
)
# as a class of DuckDB's expressions; characters are those of the fixed value in functions.scalars
CHARS = r"""[\x{4e00}-\x{9fa5}a-zA-Z0-9\[\]\-_+{}:：“<>`?!—·~@#$%\^&*(、，。；‘【】！￥…（）)"]+"""
_add(
    "f24_matches_charset", "conversations", "conv_id",
    lambda: {
        "turn": F.col("turn"), "text_ok": S.matches_charset("text"), "joined_ok": S.matches_charset(F.translate("text", " \n,.", "@#_-")),
        "mark_ok": S.matches_charset(F.substr("text", F.col("turn") + 1, F.lit(1))), "none": S.matches_charset(F.lit("|")),
    },
    {
        "turn": "turn", "text_ok": f"regexp_full_match(text, '{CHARS}')", "joined_ok": f"regexp_full_match(translate(text, ' \n,.', '@#_-'), '{CHARS}')",
        "mark_ok": f"regexp_full_match(substr(text, turn + 1, 1), '{CHARS}')", "none": "false",
    },
)
_add("f26_negate", "v_detail", "id", lambda: {"a": S.negate(F.col("split_coupon_amount").cast("decimal(16,2)")).cast("double")}, {"a": "cast(-coalesce(cast(split_coupon_amount AS decimal(16,2)), 0) AS double)"})
_add("f27_normalise_epoch", "v_pages", "event_id", lambda: {"a": S.normalise_epoch(F.floor(F.col("ts") / 1000)), "b": S.normalise_epoch("ts")}, {"a": "(ts // 1000) * 1000", "b": "ts"})
_add(
    "f28_row_key", "part", "p_partkey", lambda: {"a": S.row_key(["p_brand", "p_partkey"], ("p_brand",)), "b": S.row_key(["p_brand", "p_partkey"], (), "|", True)},
    {"a": "md5(p_brand) || '_' || p_partkey", "b": "md5(p_brand || '|' || p_partkey)"},
)
