"""The warehouse operators as named queries, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import words as W
from ..operators import cdc as C
from ..operators import changelog as L
from ..operators import joins as J
from ..operators import keyed as K
from ..operators import windows as A
from ..sources import readers as R
from ..sources import sinks as O
from ..streaming.run import work_dir
from . import fixtures as X
from .catalog import query as _query
from .fixtures import view, with_views


def query(name: str, sql: str | None = None):
    return _query(name, None if sql is None else with_views(sql))


def labels(ms: str, size_ms: int, kind: str = "") -> str:
    """Window labels in SQL."""
    start = f"(({ms}) // {size_ms}) * {size_ms}"
    full = "%Y-%m-%d %H:%M:%S"
    return (
        f"strftime(make_timestamp(({start}) * 1000), '{full}') AS stt, strftime(make_timestamp(({start} + {size_ms}) * 1000), '{full}') AS edt, "
        f"strftime(make_timestamp(({start}) * 1000), '%Y-%m-%d') AS cur_date"
    )


def day_sql(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%d')"


VERSION = ["ts", "l_partkey", "l_suppkey", "l_extendedprice"]
VERSION_SQL = ", ".join(VERSION)

# --- sources ---------------------------------------------------------------

CDC_ROWS = """
SELECT 'order_detail' AS tbl, 'c' AS op, id, ts FROM v_detail
UNION ALL SELECT 'order_info', 'c', id, ts FROM v_orders UNION ALL SELECT 'order_info', 'u', id, ts FROM v_orders
UNION ALL SELECT 'order_detail_activity', 'c', id, 0 FROM v_activity UNION ALL SELECT 'order_detail_coupon', 'c', id, 0 FROM v_coupon
UNION ALL SELECT 'order_refund_info', 'c', id, ts FROM v_refund
UNION ALL SELECT 'refund_payment', 'c', id, ts FROM v_refund UNION ALL SELECT 'refund_payment', 'u', id, ts FROM v_refund
UNION ALL SELECT 'cart_info', CASE WHEN old_num IS NULL THEN 'c' ELSE 'u' END, id, ts FROM v_cart
UNION ALL SELECT 'comment_info', 'c', id, ts FROM v_refund"""


@query("s1_read_cdc", CDC_ROWS)
def s1(spark: SparkSession, d: str) -> DataFrame:
    lines = C.rows_to_json(X.cdc(spark, d, whole=True))
    return R.read_cdc(lines, entries=["id"]).select(C.entry("source", "table").alias("tbl"), "op", C.entry("after", "id").alias("id"), F.unix_millis("et").alias("ts"))


@query("s3_read_json_table", "SELECT K(props) AS k, count(*) AS n FROM events GROUP BY 1")
def s3(spark, d):
    from pyspark.sql.types import StructType

    lines = view(spark, d, "events").select(F.col("props").alias("value"))
    return R.read_json_table(lines, StructType.fromDDL("k bigint")).groupBy("k").agg(F.count("*").alias("n"))


@query("s4_read_dim", "SELECT dic_code, dic_name FROM v_dic")
def s4(spark, d):
    return R.read_dim(view(spark, d, "v_dic"), "dic_code", ["dic_name"]).select("dic_code", "info.dic_name")


@query(
    "s5_scan_limit",
    """SELECT p_partkey AS row_key, '{"row_key":"' || p_partkey || '","p_name":"' || p_name || '","p_brand":"' || p_brand || '"}' AS json
FROM part ORDER BY p_partkey LIMIT 100""",
)
def s5(spark, d):
    return R.scan_limit(view(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey", 100)


@query("s6_row_count", "SELECT count(*) AS n FROM lineitem")
def s6(spark, d):
    return R.row_count(view(spark, d, "lineitem"))


@query("s7_point_lookup", "SELECT * FROM v_orders WHERE id IN (SELECT order_id FROM v_detail WHERE sku_num = '50')")
def s7(spark, d):
    keys = view(spark, d, "v_detail").filter("sku_num = '50'").select(F.col("order_id").alias("id")).distinct()
    return R.point_lookup(view(spark, d, "v_orders"), "id", keys)


@query("s8_camel_columns", 'SELECT c_custkey AS "cCustkey", c_name AS "cName", c_nationkey AS "cNationkey", c_mktsegment AS "cMktsegment" FROM customer')
def s8(spark, d):
    df = view(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return S.camel_columns(df.toDF(*(c.upper() for c in df.columns)))


@query("s9_read_json_lines", "SELECT event_id, event_type, value FROM events")
def s9(spark, d):
    path = work_dir(spark, "json")
    df = view(spark, d, "events").select("event_id", "event_type", "value")
    df.write.json(path)
    return R.read_json_lines(spark, path, df.schema)


# --- sinks -----------------------------------------------------------------


@query("k1_write_lines", "SELECT p_partkey, p_name, p_type FROM part")
def k1(spark, d):
    path = work_dir(spark, "lines")
    df = view(spark, d, "part").select("p_partkey", "p_name", "p_type")
    O.write_lines(df, path)
    return C.parse_or_drop(R.read_lines(spark, path), df.schema)


LATEST = f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM v_detail) WHERE rn = 1"


@query("k2_upsert_latest", LATEST)
def k2(spark, d):
    return L.upsert_latest(view(spark, d, "v_detail"), ["id"], VERSION)


DAILY_KEYWORDS = f"SELECT {labels('ts', 86_400_000)}, item AS keyword, count(*) AS keyword_count FROM v_pages GROUP BY ALL"


@query("k3_write_window_result", DAILY_KEYWORDS)
def k3(spark, d):
    pages = A.with_event_time(view(spark, d, "v_pages").withColumnRenamed("item", "keyword"), "ts")
    result = A.keyword_window(pages.select("et", "keyword"), "1 day")
    path = work_dir(spark, "windows")
    for _ in range(2):  # the second write replaces the first
        O.write_window_result(result, path)
    return spark.read.schema(result.schema).parquet(path).select(result.columns)


DIM_CHANGES = """
WITH gone AS (SELECT row_key, max(seq) FILTER (WHERE op = 'd') AS gone FROM v_changes GROUP BY 1),
puts AS (SELECT c.* FROM v_changes c JOIN gone g ON c.row_key = g.row_key WHERE op <> 'd' AND (gone IS NULL OR seq > gone))
SELECT row_key, max_by(page, seq) FILTER (WHERE page <> '') AS page, max_by(k, seq) FILTER (WHERE k <> '') AS k FROM puts GROUP BY row_key"""


@query("k4_apply_dim_changes", DIM_CHANGES)
def k4(spark, d):
    changes = view(spark, d, "v_changes").select("row_key", "op", "seq", X._cells(["page", "k"]).alias("cells"))
    return L.apply_dim_changes(changes, ["page", "k"])


@query(
    "k5_write_day_buckets",
    """
WITH e AS (SELECT K(props) AS k, event_id, MS(ts) AS ms FROM events)
SELECT CASE WHEN k % 20 = 0 THEN '19700101' WHEN k % 20 = 1 THEN 'error_bucket' ELSE strftime(make_timestamp(((ms // 1000) * 1000) * 1000), '%Y%m%d') END AS day,
       count(*) AS n FROM e GROUP BY 1""",
)
def k5(spark, d):
    e = view(spark, d, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    seconds = F.floor(F.col("ms") / 1000)
    stamp = F.when(F.col("k") % 20 == 1, "no time").when(F.col("k") % 20 != 0, F.when(F.col("event_id") % 2 == 0, seconds).otherwise(F.col("ms")).cast("string"))
    path = work_dir(spark, "days")
    O.write_day_buckets(e.select("event_id", stamp.alias("stamp")), path, "stamp")
    return spark.read.text(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("k6_delete_by_keys", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def k6(spark, d):
    keys = view(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return L.delete_by_keys(view(spark, d, "part").select("p_partkey", "p_name"), keys, ["p_partkey"])


# --- projections, filters, routing ------------------------------------------


@query("p1_cdc_fact", f"SELECT {', '.join(J.DETAIL)}, cast(ts AS string) AS ts_ms FROM v_detail")
def p1(spark, d):
    return C.cdc_fact(X.cdc(spark, d), "order_detail", J.DETAIL)


@query("p2_status_changed_to", "SELECT id, user_id, province_id, cast(ts AS string) AS ts_ms FROM v_orders WHERE order_status = '1005'")
def p2(spark, d):
    return C.status_changed_to(X.cdc(spark, d), "order_info", "order_status", "1005", ["id", "user_id", "province_id"])


CART_ADD = """
SELECT id, user_id, sku_id, cast(CASE WHEN old_num IS NULL THEN cast(sku_num AS int) ELSE cast(sku_num AS int) - cast(old_num AS int) END AS int) AS sku_num, ts
FROM v_cart WHERE old_num IS NULL OR cast(sku_num AS int) > cast(old_num AS int)"""


@query("p3_cart_add", CART_ADD)
def p3(spark, d):
    return C.cart_add(X.cdc(spark, d))


@query("p4_split_valid_json", "SELECT true AS good, props AS value FROM events UNION ALL SELECT false, text FROM conversations")
def p4(spark, d):
    good, bad = C.split_valid_json(X.lines(spark, d))
    return good.select(F.lit(True).alias("good"), "value").unionByName(bad.select(F.lit(False).alias("good"), "value"))


@query("p5_parse_or_drop", "SELECT K(props) AS k, count(*) AS n FROM events GROUP BY 1")
def p5(spark, d):
    from pyspark.sql.types import StructType

    return C.parse_or_drop(X.lines(spark, d), StructType.fromDDL("k bigint")).groupBy("k").agg(F.count("*").alias("n"))


@query("p6_unwrap_log", "SELECT mid, is_new, CASE WHEN page_id <> 'error' THEN page_id END AS page_id, ts FROM v_pages")
def p6(spark, d):
    logs = C.unwrap_log(X.log_cdc(spark, d))
    return logs.select(C.entry("common", "mid").alias("mid"), C.entry("common", "is_new").alias("is_new"), C.entry("page", "page_id").alias("page_id"), "ts")


@query("p7_split_by_field", "SELECT page_id, event_id FROM v_pages WHERE page_id <> 'error'")
def p7(spark, d):
    return C.with_field(X.page_logs(spark, d)).select(C.entry("page", "page_id").alias("page_id"), "event_id")


@query("p8_search_keywords", "SELECT item AS keyword, ts FROM v_pages WHERE last_page_id = 'search' AND item_type = 'keyword'")
def p8(spark, d):
    return C.search_keywords(X.page_logs(spark, d))


ROUTED = """
SELECT 'dim' AS side, 'part' AS tbl, 'dim_part' AS sink_table, cast(p_partkey AS string) AS id FROM part
UNION ALL SELECT 'dim', 'nation', 'dim_nation', cast(n_nationkey AS string) FROM nation
UNION ALL SELECT 'dim', 'customer', 'dim_customer', cast(c_custkey AS string) FROM customer"""


def _routed(dim: DataFrame, fact: DataFrame) -> DataFrame:
    key = F.coalesce(*[C.entry("after", c) for c in ("p_partkey", "n_nationkey", "c_custkey", "id")])
    d = dim.select(F.lit("dim").alias("side"), F.col("source_table").alias("tbl"), "sink_table", key.alias("id"))
    f = fact.select(F.lit("fact").alias("side"), F.col("source_table").alias("tbl"), F.lit(None).cast("string").alias("sink_table"), key.alias("id"))
    return d.unionByName(f)


@query("p9_route_by_rules", f"{ROUTED} UNION ALL SELECT 'fact', tbl, NULL, id FROM ({CDC_ROWS})")
def p9(spark, d):
    return _routed(*C.route_by_rules(X.cdc(spark, d).unionByName(X.dim_cdc(spark, d)), X.rules(spark)))


@query(
    "p10_current_rules",
    """SELECT source_table, sink_table, sink_family, sink_columns, sink_row_key FROM
(SELECT *, row_number() OVER (PARTITION BY source_table ORDER BY ts_ms DESC) AS rn FROM v_rule_log) WHERE rn = 1 AND op <> 'd'""",
)
def p10(spark, d):
    log = view(spark, d, "v_rule_log")
    cells = X._cells(["source_table", "sink_table", "sink_family", "sink_columns", "sink_row_key"])
    none = F.lit(None).cast("map<string,string>")
    envelopes = log.select("op", "ts_ms", "seq", F.when(F.col("op") != "d", cells).otherwise(none).alias("after"), F.when(F.col("op") == "d", cells).otherwise(none).alias("before"))
    return C.current_rules(envelopes)


@query(
    "p11_project_sink_columns",
    """SELECT 'part' AS tbl, '{"p_partkey":"' || p_partkey || '","p_name":"' || p_name || '"}' AS cells FROM part
UNION ALL SELECT 'nation', '{"n_name":"' || n_name || '"}' FROM nation
UNION ALL SELECT 'customer', '{"c_custkey":"' || c_custkey || '","c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' FROM customer""",
)
def p11(spark, d):
    dim, _ = C.route_by_rules(X.dim_cdc(spark, d), X.rules(spark))
    return C.project_sink_columns(dim).select(F.col("source_table").alias("tbl"), F.to_json("after").alias("cells"))


@query(
    "p12_drop_empty_cells",
    """SELECT seq, '{' || concat_ws(',', CASE WHEN page <> '' THEN '"page":"' || page || '"' END, CASE WHEN k <> '' THEN '"k":"' || k || '"' END) || '}' AS cells FROM v_changes""",
)
def p12(spark, d):
    return view(spark, d, "v_changes").select("seq", F.to_json(C.drop_empty_cells(X._cells(["page", "k"]))).alias("cells"))


@query(
    "p13_rows_to_json",
    """SELECT '{"id":"' || id || '","order_id":"' || order_id || '"' || CASE WHEN split_coupon_amount IS NULL THEN '' ELSE ',"split_coupon_amount":"' || split_coupon_amount || '"' END || '}' AS value FROM v_detail""",
)
def p13(spark, d):
    return C.rows_to_json(view(spark, d, "v_detail").select("id", "order_id", "split_coupon_amount"))


# --- joins ------------------------------------------------------------------


@query("j1_detail_with_order", "SELECT d.id, d.order_id, d.sku_id, o.user_id, o.province_id FROM v_detail d JOIN v_orders o ON d.order_id = o.id")
def j1(spark, d):
    return J.detail_with_order(view(spark, d, "v_detail").select("id", "order_id", "sku_id"), view(spark, d, "v_orders"))


@query("j2_left_activity", "SELECT d.id, d.sku_id, a.activity_id, a.activity_rule_id FROM v_detail d LEFT JOIN v_activity a ON d.id = a.order_detail_id")
def j2(spark, d):
    return J.with_activity(view(spark, d, "v_detail").select("id", "sku_id"), view(spark, d, "v_activity"))


@query("j3_left_coupon", "SELECT d.id, d.sku_id, c.coupon_id FROM v_detail d LEFT JOIN v_coupon c ON d.id = c.order_detail_id")
def j3(spark, d):
    return J.with_coupon(view(spark, d, "v_detail").select("id", "sku_id"), view(spark, d, "v_coupon"))


WIDE = f"""
SELECT d.id, d.order_id, o.user_id, d.sku_id, d.sku_name, o.province_id, a.activity_id, a.activity_rule_id, c.coupon_id, {day_sql('d.ts')} AS date_id, d.create_time, d.sku_num,
       cast(cast(d.sku_num AS decimal(9,2)) * cast(d.order_price AS decimal(9,2)) AS string) AS split_original_amount,
       d.split_activity_amount, d.split_coupon_amount, d.split_total_amount, cast(d.ts AS string) AS ts_ms
FROM v_detail d JOIN v_orders o ON d.order_id = o.id LEFT JOIN v_activity a ON d.id = a.order_detail_id LEFT JOIN v_coupon c ON d.id = c.order_detail_id"""


@query("j4_order_detail", WIDE)
def j4(spark, d):
    return J.order_detail(X.cdc(spark, d))


def _dic(spark, d):
    return R.read_dim(view(spark, d, "v_dic"), "dic_code", ["dic_name"])


REFUNDS = f"""SELECT r.id, r.user_id, r.order_id, r.sku_id, o.province_id, {day_sql('r.ts')} AS date_id, r.create_time, r.refund_type, a.dic_name AS refund_type_name,
r.refund_reason_type, b.dic_name AS refund_reason_type_name, r.refund_reason_txt, r.refund_num, r.refund_amount, cast(r.ts AS string) AS ts_ms
FROM v_refund r JOIN v_orders o ON r.order_id = o.id AND o.order_status = '1005' JOIN v_dic a ON r.refund_type = a.dic_code JOIN v_dic b ON r.refund_reason_type = b.dic_code"""


@query("j5_order_refund", REFUNDS)
def j5(spark, d):
    return J.order_refund(X.cdc(spark, d), _dic(spark, d))


REFUNDS_PAID = f"""SELECT p.id, o.user_id, p.order_id, p.sku_id, o.province_id, p.refund_type AS payment_type, a.dic_name AS payment_type_name, {day_sql('p.ts')} AS date_id, p.create_time AS callback_time,
r.refund_num, p.refund_amount, cast(p.ts AS string) AS ts_ms
FROM v_refund p JOIN v_refund r ON p.order_id = r.order_id AND p.sku_id = r.sku_id JOIN v_orders o ON p.order_id = o.id AND o.order_status = '1006' JOIN v_dic a ON p.refund_type = a.dic_code"""


@query("j6_refund_success", REFUNDS_PAID)
def j6(spark, d):
    return J.refund_success(X.cdc(spark, d), _dic(spark, d))


@query("j7_lookup_join", "SELECT o.id, o.code, d.dic_name AS code_name FROM v_orders o JOIN v_dic d ON o.code = d.dic_code")
def j7(spark, d):
    return J.lookup_join(view(spark, d, "v_orders").select("id", "code"), _dic(spark, d), "code", "code_name")


@query("j8_enrich", "SELECT d.id, d.sku_id, s.sku_name AS name, s.tm_id FROM v_detail d JOIN v_sku s ON d.sku_id = s.id")
def j8(spark, d):
    return J.enrich(view(spark, d, "v_detail").select("id", "sku_id"), view(spark, d, "v_sku"), "sku_id", "id", {"sku_name": "name", "tm_id": "tm_id"})


def _chain(spark, d):
    v = lambda n: view(spark, d, n)
    return [
        (v("v_sku"), "sku_id", "id", {"sku_name": "sku_name", "spu_id": "spu_id", "category3_id": "category3_id", "tm_id": "tm_id"}),
        (v("v_spu"), "spu_id", "id", {"spu_name": "spu_name"}),
        (v("v_category3"), "category3_id", "id", {"name": "category3_name", "category2_id": "category2_id"}),
        (v("v_category2"), "category2_id", "id", {"name": "category2_name", "category1_id": "category1_id"}),
        (v("v_trademark"), "tm_id", "id", {"tm_name": "tm_name"}),
    ]


CHAIN = """s.sku_name, s.spu_id, s.category3_id, s.tm_id, p.spu_name, c3.name AS category3_name, c3.category2_id, c2.name AS category2_name, c2.category1_id, t.tm_name"""
CHAIN_FROM = """JOIN v_sku s ON x.sku_id = s.id LEFT JOIN v_spu p ON s.spu_id = p.id LEFT JOIN v_category3 c3 ON s.category3_id = c3.id
LEFT JOIN v_category2 c2 ON c3.category2_id = c2.id LEFT JOIN v_trademark t ON s.tm_id = t.id"""


@query("j9_enrich_chain", f"SELECT x.id, x.sku_id, {CHAIN} FROM v_detail x {CHAIN_FROM}")
def j9(spark, d):
    return J.enrich_chain(view(spark, d, "v_detail").select("id", "sku_id"), _chain(spark, d))


@query("j10_enrich_province", "SELECT o.id, o.province_id, p.name AS province_name FROM v_orders o JOIN v_province p ON o.province_id = p.id")
def j10(spark, d):
    return A.enrich_province(view(spark, d, "v_orders").select("id", "province_id"), view(spark, d, "v_province"))


@query("j11_flag_members", "SELECT p_partkey, split_part(p_name, ' ', 1) AS w, split_part(p_name, ' ', 1) <> '' AND length(split_part(p_name, ' ', 1)) % 2 = 0 AS flagged FROM part")
def j11(spark, d):
    bad = view(spark, d, "v_words").filter(F.length("word") % 2 == 0)
    return J.flag_members(view(spark, d, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w")), "w", bad)


# --- keyed and retraction -----------------------------------------------------

FIRST = f"""SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR {day_sql('lag(ts) OVER w')} <> {day_sql('ts')} THEN 1 ELSE 0 END AS first_of_day FROM v_pages
WINDOW w AS (PARTITION BY mid ORDER BY ts, event_id)"""


@query("w1_first_of_day", f"SELECT mid, event_id, cast(first_of_day AS int) AS first_of_day FROM ({FIRST})")
def w1(spark, d):
    return K.first_of_day(view(spark, d, "v_pages"), "mid", "ts", "event_id").select("mid", "event_id", "first_of_day")


FIXED = f"""SELECT mid, event_id, CASE WHEN is_new = '1' AND {day_sql('ts')} <> anchor THEN '0' ELSE is_new END AS is_new FROM
(SELECT *, first_value(CASE WHEN is_new = '1' THEN {day_sql('ts')} ELSE {day_sql('ts - 86400000')} END) OVER (PARTITION BY mid ORDER BY ts, event_id) AS anchor FROM v_pages)"""


@query("w2_fix_is_new", FIXED)
def w2(spark, d):
    return K.fix_is_new(view(spark, d, "v_pages"), "mid", "is_new", "ts", "event_id").select("mid", "event_id", "is_new")


@query("w3_session_start", "SELECT event_id, cast(CASE WHEN last_page_id IS NULL OR last_page_id = '' THEN 1 ELSE 0 END AS int) AS sv FROM v_pages")
def w3(spark, d):
    return view(spark, d, "v_pages").select("event_id", K.session_start("last_page_id").alias("sv"))


@query("w4_latest_by_key", LATEST)
def w4(spark, d):
    return L.latest_by_key(view(spark, d, "v_detail"), ["id"], [F.desc(c) for c in VERSION])


def _versions(spark, d):
    money = [F.col(c).cast("decimal(16,2)").alias(c) for c in ("split_total_amount", "split_coupon_amount")]
    return view(spark, d, "v_detail").select("id", "sku_id", *money, *VERSION)


def _retract_sql(keep: str) -> str:
    zero = "coalesce(cast(split_coupon_amount AS decimal(16,2)), 0)"
    lead = "lead(ts) OVER (PARTITION BY id ORDER BY ts, l_partkey, l_suppkey, l_extendedprice)"
    return f"""
SELECT id, sku_id, ts, cast(cast(split_total_amount AS decimal(16,2)) AS double) AS total, cast({zero} AS double) AS coupon, 1 AS sign FROM v_detail
UNION ALL SELECT id, sku_id, ts, cast(-cast(split_total_amount AS decimal(16,2)) AS double), cast(-{zero} AS double), -1 FROM
(SELECT *, {lead} AS next_ts FROM v_detail) WHERE next_ts IS NOT NULL{keep}"""


def _retracted(df: DataFrame) -> DataFrame:
    return df.select("id", "sku_id", "ts", F.col("split_total_amount").cast("double").alias("total"), F.col("split_coupon_amount").cast("double").alias("coupon"), "sign")


@query("t1_retract_pairs", _retract_sql(""))
def t1(spark, d):
    return _retracted(L.retract_pairs(_versions(spark, d), ["id"], VERSION, ["split_total_amount", "split_coupon_amount"]))


MONTH = 30 * 86_400_000


@query("t2_retract_ttl", _retract_sql(f" AND next_ts - ts <= {MONTH}"))
def t2(spark, d):
    return _retracted(L.retract_pairs(_versions(spark, d), ["id"], VERSION, ["split_total_amount", "split_coupon_amount"], ttl_ms=MONTH))


@query(
    "t3_changelog_rows",
    """WITH j AS (SELECT d.id, d.sku_id, c.coupon_id FROM v_detail d LEFT JOIN v_coupon c ON d.id = c.order_detail_id)
SELECT id, sku_id, NULL AS coupon_id, 0 AS step, 1 AS sign FROM j UNION ALL SELECT id, sku_id, NULL, 1, -1 FROM j WHERE coupon_id IS NOT NULL
UNION ALL SELECT id, sku_id, coupon_id, 2, 1 FROM j WHERE coupon_id IS NOT NULL""",
)
def t3(spark, d):
    return L.changelog_rows(J.with_coupon(view(spark, d, "v_detail").select("id", "sku_id"), view(spark, d, "v_coupon")), ["coupon_id"])


# --- windows -----------------------------------------------------------------


def _first_carts(spark, d):
    adds = C.cart_add(X.cdc(spark, d))
    return A.with_event_time(K.first_of_day(adds, "user_id", "ts", "id").filter("first_of_day = 1"), "ts")


@query(
    "a1_cart_uu_window",
    f"""WITH a AS ({CART_ADD}), f AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id) AS old FROM a)
SELECT {labels('ts', 10_000)}, count(*) AS cart_add_uu_ct FROM f WHERE old IS NULL OR {day_sql('old')} <> {day_sql('ts')} GROUP BY ALL""",
)
def a1(spark, d):
    return A.cart_uu_window(_first_carts(spark, d))


@query("a2_keyword_window", f"SELECT {labels('ts', 3_600_000)}, item AS keyword, count(*) AS keyword_count FROM v_pages WHERE last_page_id = 'search' AND item_type = 'keyword' GROUP BY ALL")
def a2(spark, d):
    return A.keyword_window(A.with_event_time(C.search_keywords(X.page_logs(spark, d)), "ts"), "1 hour")


AMOUNTS = "original_amount coupon_amount activity_amount total_amount".split()


def _latest_amounts(spark, d):
    last = L.upsert_latest(view(spark, d, "v_detail"), ["id"], VERSION)
    money = lambda c: F.col(c).cast("decimal(16,2)")
    return A.with_event_time(last, "ts").select(
        "et", "sku_id", "order_id", S.amount("sku_num", "order_price").cast("decimal(16,2)").alias("original_amount"), money("split_coupon_amount").alias("coupon_amount"),
        money("split_activity_amount").alias("activity_amount"), money("split_total_amount").alias("total_amount"),
    )


@query(
    "a3_sku_order_window",
    f"""WITH l AS ({LATEST}), x AS (SELECT {labels('ts', 86_400_000)}, sku_id,
cast(sum(cast(cast(sku_num AS decimal(9,2)) * cast(order_price AS decimal(9,2)) AS decimal(16,2))) AS double) AS original_amount,
cast(sum(coalesce(cast(split_coupon_amount AS decimal(16,2)), 0)) AS double) AS coupon_amount, cast(sum(cast(split_activity_amount AS decimal(16,2))) AS double) AS activity_amount,
cast(sum(cast(split_total_amount AS decimal(16,2))) AS double) AS total_amount FROM l GROUP BY ALL)
SELECT x.*, {CHAIN} FROM x {CHAIN_FROM}""",
)
def a3(spark, d):
    sums = A.sku_order_window(_latest_amounts(spark, d), "1 day")
    for c in AMOUNTS:
        sums = sums.withColumn(c, F.col(c).cast("double"))
    return J.enrich_chain(sums, _chain(spark, d))


@query(
    "a4_province_order_window",
    f"""WITH w AS ({WIDE}), x AS (SELECT {labels('cast(ts_ms AS bigint)', 86_400_000)}, province_id, cast(sum(cast(split_total_amount AS decimal(16,2))) AS double) AS total,
count(DISTINCT order_id) AS order_count FROM w GROUP BY ALL) SELECT x.*, p.name AS province_name FROM x JOIN v_province p ON x.province_id = p.id""",
)
def a4(spark, d):
    wide = J.order_detail(X.cdc(spark, d)).select("province_id", "order_id", F.col("split_total_amount").alias("total_amount"), F.col("ts_ms").cast("bigint").alias("ms"))
    out = A.province_order_window(A.with_event_time(wide, "ms"), "1 day").withColumn("total", F.col("total").cast("double"))
    return A.enrich_province(out, view(spark, d, "v_province"))


@query(
    "a4_province_order_sketch_window",
    f"""SELECT {labels('ts', 7 * 86_400_000)}, cast(l_suppkey % 25 AS string) AS province_id, cast(sum(cast(cast(cents AS decimal(14,0)) * cast(0.01 AS decimal(3,2)) AS decimal(16,2))) AS double) AS total,
count(DISTINCT l_orderkey) AS exact_count, true AS within_bound FROM v_money GROUP BY ALL""",
)
def a4_sketch(spark, d):
    """Distinct orders of a week from the sketches of its days, at most 2.5 % (three standard errors) from the exact count."""
    rows = view(spark, d, "v_money").select(
        F.timestamp_millis("ts").alias("et"), (F.col("l_suppkey") % 25).cast("string").alias("province_id"), F.col("l_orderkey").alias("order_id"),
        (F.col("cents").cast("decimal(14,0)") * F.lit("0.01").cast("decimal(3,2)")).alias("total_amount"),
    )
    week = A.merge_order_sketches(A.order_sketch_window(rows, "1 day"), "7 days")
    exact = A.window_labels(A.tumble(rows, "7 days", ["province_id"], [F.count_distinct("order_id").alias("exact_count")]))
    near = F.abs(F.col("order_count") - F.col("exact_count")) <= F.greatest(F.lit(1), 3 * 1.04 / 2 ** (A.SKETCH_BITS / 2) * F.col("exact_count"))
    both = week.join(exact.drop("edt", "cur_date"), ["stt", "province_id"])
    return both.select("stt", "edt", "cur_date", "province_id", F.col("total").cast("double").alias("total"), "exact_count", near.alias("within_bound"))


@query(
    "a5_traffic_window",
    f"""SELECT {labels('ts', 86_400_000)}, ar, ch, vc, is_new, count(*) AS pv, cast(sum(first_of_day) AS bigint) AS uv,
cast(sum(CASE WHEN last_page_id IS NULL THEN 1 ELSE 0 END) AS bigint) AS sv, cast(sum(during_time) AS bigint) AS dur FROM ({FIRST}) GROUP BY ALL""",
)
def a5(spark, d):
    v = K.first_of_day(view(spark, d, "v_pages"), "mid", "ts", "event_id", "uv").withColumn("sv", K.session_start("last_page_id"))
    return A.traffic_window(A.with_event_time(v, "ts"), "1 day")


# --- words -------------------------------------------------------------------


@query("u1_split_words", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[\p{L}\p{N}]+')) AS word FROM part) GROUP BY 1")
def u1(spark, d):
    text = view(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"))
    return W.split_words(text, "t").groupBy("word").agg(F.count("*").alias("n"))


@query("u1_split_words_documents", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents) GROUP BY 1")
def u1_documents(spark, d):
    return W.split_words(view(spark, d, "documents").select("text"), "text").groupBy("word").agg(F.count("*").alias("n"))


@query("u4_registered_functions", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY 1")
def u4(spark, d):
    W.register(spark, "split_words")
    view(spark, d, "part").createOrReplaceTempView("u4_part")
    return spark.sql("SELECT w.word, count(*) AS n FROM u4_part, LATERAL split_words(p_name) w GROUP BY w.word")


# --- event time --------------------------------------------------------------


@query("st2_event_time_fallback", "SELECT event_id, CASE WHEN K(props) % 2 = 0 THEN MS(ts) // 1000 ELSE event_id END * 1000 AS ms FROM events")
def st2(spark, d):
    e = view(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("s"))
    e = e.select("event_id", F.when(F.col("k") % 2 == 0, F.col("s")).alias("block_timestamp"), F.col("event_id").alias("timestamp"))
    return A.with_event_time_fallback(e, ["block_timestamp", "timestamp"]).select("event_id", F.unix_millis("et").alias("ms"))


@query("st2_list_time", "SELECT order_id AS user_id, min(ts) AS ms FROM v_detail GROUP BY 1")
def st2_list(spark, d):
    lists = view(spark, d, "v_detail").groupBy("order_id").agg(F.array(F.min(F.struct(F.col("ts").alias("window_start_time")))).alias("items"))
    return A.with_list_time(lists, "items").select(F.col("order_id").alias("user_id"), F.unix_millis("et").alias("ms"))


@query("st3_tumble", "SELECT (ts // 5000) * 5000 AS start_ms, event_type, count(*) AS n FROM (SELECT MS(ts) AS ts, event_type FROM events) GROUP BY ALL")
def st3(spark, d):
    e = view(spark, d, "events").withColumn("et", F.col("ts").cast("timestamp"))
    return A.tumble(e, "5 seconds", ["event_type"], [F.count("*").alias("n")]).select(F.unix_millis("window.start").alias("start_ms"), "event_type", "n")


@query("st4_window_labels", f"SELECT {labels('ts', 10_000)}, count(*) AS n FROM (SELECT MS(ts) AS ts FROM events) GROUP BY ALL")
def st4(spark, d):
    e = view(spark, d, "events").withColumn("et", F.col("ts").cast("timestamp"))
    return A.window_labels(A.tumble(e, "10 seconds", [], [F.count("*").alias("n")]))


@query(
    "st5_late_rows",
    """WITH e AS (SELECT id, ts, l_linenumber AS batch FROM v_detail), t AS (SELECT batch, max(ts) AS top FROM e GROUP BY 1),
m AS (SELECT lead(batch, 2) OVER (ORDER BY batch) AS batch, max(top) OVER (ORDER BY batch) - 10000 AS mark FROM t)
SELECT e.id, e.ts, e.batch, coalesce((e.ts // 10000) * 10000 + 10000 <= m.mark, false) AS late FROM e LEFT JOIN m ON e.batch = m.batch""",
)
def st5(spark, d):
    e = A.with_event_time(view(spark, d, "v_detail"), "ts").select("id", "ts", F.col("l_linenumber").alias("batch"), "et")
    return A.late_rows(e, "batch", 10, 10).select("id", "ts", "batch", "late")


# --- documented operators ------------------------------------------------------


@query("x1_order_cancel", f"SELECT w.*, cast(o.ts AS string) AS cancel_ts_ms FROM ({WIDE}) w JOIN v_orders o ON w.order_id = o.id AND o.order_status = '1003'")
def x1(spark, d):
    changes = X.cdc(spark, d)
    return J.order_cancel(changes, J.order_detail(changes))


@query(
    "x2_pay_success",
    """SELECT a.id, b.event_id AS pay_id, a.user_id FROM v_cart a JOIN v_pages b ON a.user_id = b.mid
WHERE a.event_type = 'purchase' AND b.ts - a.ts BETWEEN -900000 AND 5000""",
)
def x2(spark, d):
    left = view(spark, d, "v_cart").filter("event_type = 'purchase'").select("id", "user_id", F.col("ts").alias("cart_ts"))
    right = view(spark, d, "v_pages").select(F.col("mid").alias("user_id"), F.col("event_id").alias("pay_id"), F.col("ts").alias("page_ts"))
    return J.within(left, right, "user_id", "cart_ts", "page_ts").select("id", "pay_id", "user_id")


@query("x3_comments", "SELECT r.id, r.user_id, r.sku_id, r.refund_type AS appraise, d.dic_name AS appraise_name, cast(r.ts AS string) AS ts_ms FROM v_refund r JOIN v_dic d ON r.refund_type = d.dic_code")
def x3(spark, d):
    return J.comments(X.cdc(spark, d), _dic(spark, d))


@query(
    "x4_route_facts",
    """SELECT 'order_info' AS source_table, 'u' AS op, 'dwd_order_status' AS sink_topic, id, ts FROM v_orders
UNION ALL SELECT 'order_detail', 'c', 'dwd_order_detail', id, ts FROM v_detail""",
)
def x4(spark, d):
    rules = X.literal_rows(spark, [("order_info", "u", "dwd_order_status"), ("order_detail", "c", "dwd_order_detail"), ("part", "r", "none")], ["source_table", "op", "sink_topic"])
    routed = C.route_facts(X.cdc(spark, d).unionByName(X.dim_cdc(spark, d)), rules)
    return routed.select("source_table", "op", "sink_topic", C.entry("data", "id").alias("id"), "ts")


@query(
    "x5_user_login_window",
    f"""WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY mid ORDER BY ts, event_id) AS old FROM v_pages WHERE page_id = 'signup')
SELECT {labels('ts', 86_400_000)}, cast(sum(CASE WHEN old IS NULL OR {day_sql('old')} <> {day_sql('ts')} THEN 1 ELSE 0 END) AS bigint) AS uu,
cast(sum(CASE WHEN date_diff('day', cast(make_timestamp(old * 1000) AS date), cast(make_timestamp(ts * 1000) AS date)) > 7 THEN 1 ELSE 0 END) AS bigint) AS back FROM l GROUP BY ALL""",
)
def x5(spark, d):
    logins = view(spark, d, "v_pages").filter("page_id = 'signup'")
    marked = K.returning_user(K.first_of_day(logins, "mid", "ts", "event_id", "uu"), "mid", "ts", "event_id", 7, "back")
    return A.window_labels(A.tumble(A.with_event_time(marked, "ts"), "1 day", [], [F.sum("uu").alias("uu"), F.sum("back").alias("back")]))


@query(
    "x6_home_detail_uv_window",
    f"""WITH p AS (SELECT *, lag(ts) OVER (PARTITION BY mid, page_id ORDER BY ts, event_id) AS old FROM v_pages WHERE page_id IN ('view', 'click'))
SELECT {labels('ts', 10_000)}, cast(sum(CASE WHEN page_id = 'view' AND (old IS NULL OR {day_sql('old')} <> {day_sql('ts')}) THEN 1 ELSE 0 END) AS bigint) AS home_uv,
cast(sum(CASE WHEN page_id = 'click' AND (old IS NULL OR {day_sql('old')} <> {day_sql('ts')}) THEN 1 ELSE 0 END) AS bigint) AS detail_uv FROM p GROUP BY ALL""",
)
def x6(spark, d):
    pages = view(spark, d, "v_pages").filter("page_id in ('view', 'click')").withColumn("key", F.concat_ws(":", "mid", "page_id"))
    first = K.first_of_day(pages, "key", "ts", "event_id", "uv")
    uv = lambda page: F.sum(F.when(F.col("page_id") == page, F.col("uv")).otherwise(0))
    return A.window_labels(A.tumble(A.with_event_time(first, "ts"), "10 seconds", [], [uv("view").alias("home_uv"), uv("click").alias("detail_uv")]))


@query("x7_preloaded_rules", ROUTED)
def x7(spark, d):
    log = view(spark, d, "v_rule_log").select("op", "ts_ms", "seq", X._cells(["source_table", "sink_table", "sink_family", "sink_columns", "sink_row_key"]).alias("after"), F.lit(None).cast("map<string,string>").alias("before"))
    live = C.current_rules(log)
    loaded = X.rules(spark).join(live.select("source_table"), "source_table", "left_anti").unionByName(live)
    dim, fact = C.route_by_rules(X.dim_cdc(spark, d), loaded)
    return _routed(dim, fact)
