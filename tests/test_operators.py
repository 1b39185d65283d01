"""Hand-written rows: the cases that test tables do not hold."""

from datetime import date
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.functions.words import words
from tideline.operators import cdc as C
from tideline.operators import changelog as L
from tideline.operators import joins as J
from tideline.operators import keyed as K
from tideline.operators import windows as A
from tideline.sources import readers as R
from tideline.sources import sinks as O
from tideline.sources.schemas import CDC
from tideline.streaming import state
from tideline.streaming.run import drain, retract_stream, route_stream, work_dir

DAY = 86_400_000


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def envelope(table, op, after=None, before=None, ts=1):
    return ({"table": table, "ts_ms": str(ts)}, op, ts, after, before)


def test_first_of_day_counts_a_user_once_a_day(spark):
    rows = [("u", 10, 1), ("u", 20, 2), ("u", DAY + 1, 3), ("v", 30, 4)]
    df = K.first_of_day(spark.createDataFrame(rows, "user string, ts long, id long"), "user", "ts", "id")
    assert {r.id: r.first_of_day for r in df.collect()} == {1: 1, 2: 0, 3: 1, 4: 1}


def test_fix_is_new_keeps_the_mark_on_the_first_day_only(spark):
    rows = [("a", "1", 10, 1), ("a", "1", 20, 2), ("a", "1", DAY + 1, 3), ("b", "0", 10, 4), ("b", "1", 20, 5), ("c", None, 10, 6), ("c", "1", 20, 7)]
    df = K.fix_is_new(spark.createDataFrame(rows, "mid string, is_new string, ts long, id long"), "mid", "is_new", "ts", "id")
    assert {r.id: r.is_new for r in df.collect()} == {1: "1", 2: "1", 3: "0", 4: "0", 5: "0", 6: None, 7: "0"}


def test_bad_json_leaves_the_main_output(spark):
    lines = ['{"a":1}', "", "not json", "12", "[1]", '"x"', None]
    good, bad = C.split_valid_json(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.value for r in good.collect()] == ['{"a":1}']
    assert bad.count() == 6


def test_parse_or_fail_fails_on_a_bad_line(spark):
    from pyspark.sql.types import StructType

    lines = spark.createDataFrame([("{",)], "value string")
    with pytest.raises(Exception, match="MALFORMED"):
        C.parse_or_fail(lines, StructType.fromDDL("a int")).collect()


def test_cart_add_takes_new_rows_and_increases(spark):
    cart = lambda n: {"id": n, "user_id": "u", "sku_id": "s", "sku_num": n}
    rows = [
        envelope("cart_info", "c", cart("3")), envelope("cart_info", "u", cart("5"), {"sku_num": "2"}), envelope("cart_info", "u", cart("1"), {"sku_num": "2"}),
        envelope("cart_info", "u", cart("2"), {"sku_num": "2"}), envelope("cart_info", "u", cart("x"), {"sku_num": "2"}), envelope("cart_info", "d", None, cart("9")),
        envelope("cart_info", "r", cart("8")), envelope("other", "c", cart("7")),
    ]
    got = C.cart_add(spark.createDataFrame(rows, CDC))
    assert sorted((r.id, r.sku_num) for r in got.collect()) == [("3", 3), ("5", 3)]


def test_rules_are_deleted_by_the_row_before(spark):
    rule = lambda t: {"source_table": t, "sink_table": f"dim_{t}"}
    rows = [("c", 1, 1, rule("a"), None), ("c", 2, 2, rule("b"), None), ("d", 3, 3, None, rule("a")), ("d", 4, 4, None, rule("b")), ("u", 5, 5, rule("b"), rule("b"))]
    df = spark.createDataFrame(rows, "op string, ts_ms long, seq long, after map<string,string>, before map<string,string>")
    assert [r.source_table for r in C.current_rules(df).collect()] == ["b"]


def test_dim_changes_keep_the_last_value_after_the_last_delete(spark):
    rows = [("k", "u", 1, {"a": "1", "b": "x"}), ("k", "d", 2, None), ("k", "u", 3, {"a": "", "b": "y"}), ("k", "u", 4, {"a": None, "b": ""}), ("g", "u", 1, {"a": "9"}), ("g", "d", 2, None)]
    df = spark.createDataFrame(rows, "row_key string, op string, seq long, cells map<string,string>")
    assert [tuple(r) for r in L.apply_dim_changes(df, ["a", "b"]).collect()] == [("k", None, "y")]


def test_retraction_sums_equal_the_latest_rows(spark):
    rows = [("k", 1, Decimal("5.00")), ("k", 2, None), ("k", 3, Decimal("7.50")), ("j", 1, Decimal("1.00"))]
    df = spark.createDataFrame(rows, "id string, ts long, amount decimal(16,2)")
    out = L.retract_pairs(df, ["id"], ["ts"], ["amount"])
    assert out.count() == 6
    assert {r.id: r.s for r in out.groupBy("id").agg(F.sum("amount").alias("s")).collect()} == {"k": Decimal("7.50"), "j": Decimal("1.00")}
    assert L.retract_pairs(df.withColumn("ts", F.col("ts") * 100), ["id"], ["ts"], ["amount"], ttl_ms=50).filter("sign = -1").count() == 0


def test_upsert_is_idempotent_and_honours_deletes(spark):
    rows = [("a", 1, "c"), ("a", 2, "d"), ("b", 1, "c"), ("b", 2, "u")]
    df = spark.createDataFrame(rows, "id string, ts long, op string")
    once = L.upsert_latest(df, ["id"], ["ts"], "op")
    assert [tuple(r) for r in once.collect()] == [("b", 2, "u")]
    assert L.upsert_latest(once.unionByName(once), ["id"], ["ts"], "op").count() == 1


def test_windows_sum_three_rows_and_count_distinct_orders(spark):
    rows = [(1000, "p", "o1", Decimal("1.00")), (2000, "p", "o1", Decimal("2.00")), (3000, "p", "o2", Decimal("4.00")), (12_000, "p", "o1", None)]
    df = A.with_event_time(spark.createDataFrame(rows, "ms long, province_id string, order_id string, total_amount decimal(16,2)"), "ms")
    got = sorted((r.stt, r.total, r.order_count) for r in A.province_order_window(df).collect())
    assert got == [("1970-01-01 00:00:00", Decimal("7.00"), 2), ("1970-01-01 00:00:10", None, 1)]


def test_enrich_drops_misses_unless_left(spark):
    df = spark.createDataFrame([("1",), ("2",)], "k string")
    dim = spark.createDataFrame([("1", "one")], "id string, name string")
    assert J.enrich(df, dim, "k", "id", {"name": "n"}).count() == 1
    assert {r.k: r.n for r in J.enrich(df, dim, "k", "id", {"name": "n"}, "left").collect()} == {"1": "one", "2": None}


def test_flag_members_handles_null_and_empty(spark):
    df = spark.createDataFrame([("a",), ("",), (None,), ("b",)], "w string")
    words_ = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "word string")
    assert sorted((str(r.w), r.flagged) for r in J.flag_members(df, "w", words_).collect()) == [("", False), ("None", False), ("a", True), ("b", False)]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.datetime_to_ts(lit("1970-01-01 08:00:00"))) == 0
    assert one(spark, S.datetime_to_ts(lit("nonsense"))) is None
    assert one(spark, S.hex_to_decimal(lit("0xff"))) == "255"
    assert one(spark, S.hex_to_decimal(lit("0x" + "f" * 31))) == str(16**31 - 1)
    for text in ("0x" + "f" * 33, "0x" + "0" * 62 + "ff", "0x" + "9e3779b97f4a7c15" * 8, "0x-1F", "0x0"):
        assert one(spark, S.hex_to_decimal(lit(text))) == str(int(text[2:], 16))
    plain = {"-1.5": "-1.5", "1e3": "1000", "+007.50": "7.50", ".5": "0.5", "5.": "5", "-0": "0", "12e-3": "0.012", "9" * 60: "9" * 60, " 5": None, "0Xff": None, "0x": None, "x": None, ".": None, "": None}
    for text, want in plain.items():
        assert one(spark, S.hex_to_decimal(lit(text))) == want, text
    scaled = {"1500000000000000000": "1.5", "1000000000000000000": "1", "0": "0", "0.00": "0.00", "-1.5": "-0.0000000000000000015", "0x0de0b6b3a7640000": "1", "2" + "0" * 20: "200", "1e30": "1000000000000", "1.50": "0.0000000000000000015"}
    for text, want in scaled.items():
        assert one(spark, S.hex_to_decimal(lit(text), True)) == want, text
    charset = {"a b": False, "a@b": True, "汉字，（）": True, "": False, "x.y": False, "[a]{b}<c>~`": True, "“q‘": True, "”": False, 'say"': True, "it's": False}
    for text, want in charset.items():
        assert one(spark, S.matches_charset(lit(text))) is want, text
    assert one(spark, S.hex_words(lit("0x"))) == []
    assert one(spark, S.day_list(lit(date(2024, 2, 28)), lit(date(2024, 3, 1)))) == [20240228, 20240229, 20240301]
    assert one(spark, S.day_list(lit(date(2024, 3, 2)), lit(date(2024, 3, 1)))) == []
    assert one(spark, S.normalise_epoch(lit(5))) == 5000
    assert one(spark, S.is_blank(lit(" \t"))) is True
    assert one(spark, S.capitalise_first(lit("ab cd"))) == "Ab cd"
    assert one(spark, S.append_json_list(lit("oops"), lit("x"))) == '["x"]'
    assert S.camel("UPPER_UNDER_SCORE") == "upperUnderScore"
    assert one(spark, O.day_bucket(lit("10"))) == "19700101"
    assert one(spark, O.day_bucket(lit("x"))) == "error_bucket"
    assert one(spark, O.day_bucket(lit(None).cast("string"))) == "19700101"


def test_words_take_bigrams_of_cjk_runs(spark):
    assert one(spark, words(F.lit("Phone 手机壳 A1 书"))) == ["phone", "手机", "机壳", "a1", "书"]
    assert one(spark, words(F.lit(None).cast("string"))) == []


def test_dates_follow_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        assert one(spark, S.ts_to_datetime(F.lit(0))) == "1970-01-01 08:00:00"
        assert one(spark, S.datetime_to_ts(S.ts_to_datetime(F.lit(0)))) == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_scan_limit_is_in_key_order(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "k string, v int")
    assert [r.row_key for r in R.scan_limit(df, "k", 2).collect()] == ["a", "b"]


def _files(spark, path, schema, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_stream_drops_rows_later_than_two_batches(spark, tmp_path):
    stream = _files(spark, str(tmp_path), "id long, ms long", [(1, 1_000)], [(2, 60_000)], [(3, 61_000)], [(4, 2_000), (5, 62_000)])
    out = A.window_labels(A.tumble(A.with_event_time(stream, "ms", "5 seconds"), "10 seconds", [], [F.count("*").alias("n")]))
    got = {r.stt: r.n for r in drain(out, str(tmp_path / "out")).collect()}
    assert got == {"1970-01-01 00:00:00": 1}


def test_late_rows_follow_the_same_rule(spark):
    rows = [(0, 1_000), (1, 60_000), (2, 61_000), (3, 2_000), (3, 62_000)]
    df = A.with_event_time(spark.createDataFrame(rows, "batch int, ms long"), "ms")
    assert [r.ms for r in A.late_rows(df, "batch", 10, 5).filter("late").collect()] == [2_000]


def test_stateful_streams_equal_their_batch_forms(spark, tmp_path):
    schema = "user string, is_new string, ts long, id long"
    first = [("u", "1", 10, 1), ("v", "0", 20, 2)]
    second = [("u", "1", DAY + 5, 3), ("u", "1", DAY + 6, 4), ("v", "1", 30, 5)]
    whole = spark.createDataFrame(first + second, schema)
    stream = _files(spark, str(tmp_path / "a"), schema, first, second)
    got = drain(state.first_of_day(stream, "user", "ts", "id"), str(tmp_path / "a/out"))
    want = K.first_of_day(whole, "user", "ts", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    stream = _files(spark, str(tmp_path / "b"), schema, first, second)
    got = drain(state.fix_is_new(stream, "user", "is_new", "ts", "id"), str(tmp_path / "b/out"))
    want = K.fix_is_new(whole, "user", "is_new", "ts", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_days_follow_the_session_zone(spark, tmp_path):
    schema = "user string, is_new string, ts long, id long"
    late = DAY - 3_600_000  # already the next day in Shanghai
    rows = [("u", "1", 10, 1), ("u", "1", late, 2), ("u", "1", DAY + 5, 3), ("v", "0", late, 4), ("v", "1", late - DAY, 5)]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        whole = spark.createDataFrame(rows, schema)
        for name, batch, keyed in (
            ("a", K.first_of_day(whole, "user", "ts", "id"), lambda s: state.first_of_day(s, "user", "ts", "id")),
            ("b", K.fix_is_new(whole, "user", "is_new", "ts", "id"), lambda s: state.fix_is_new(s, "user", "is_new", "ts", "id")),
        ):
            stream = _files(spark, str(tmp_path / name), schema, rows)
            assert sorted(map(tuple, drain(keyed(stream), str(tmp_path / name / "out")).collect())) == sorted(map(tuple, batch.collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_cluster_needs_a_shared_folder(tmp_path):
    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://head:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(cluster, "x")


def test_retraction_over_batches(spark, tmp_path):
    schema = "id string, ts long, amount decimal(16,2)"
    a, b, c = ("k", 1, Decimal("5.00")), ("k", 2, Decimal("6.00")), ("k", 3, Decimal("7.00"))
    stream = _files(spark, str(tmp_path), schema, [a], [b, ("j", 1, Decimal("1.00"))], [c])
    out = retract_stream(stream, str(tmp_path / "out"), ["id"], ["ts"], ["amount"])
    assert out.filter("id = 'k'").count() == 5
    assert {r.id: r.s for r in out.groupBy("id").agg(F.sum("amount").alias("s")).collect()} == {"k": Decimal("7.00"), "j": Decimal("1.00")}


def test_rows_before_any_rule_wait(spark, tmp_path):
    schema = "source map<string,string>, op string, id long"
    stream = _files(spark, str(tmp_path), schema, [({"table": "a"}, "c", 1)], [({"table": "b"}, "c", 2)], [({"table": "a"}, "c", 3)])
    rules = spark.createDataFrame([("a", "dim_a")], "source_table string, sink_table string")
    dims, facts = route_stream(stream, lambda batch: rules if batch == 2 else rules.limit(0), str(tmp_path / "out"))
    assert sorted(r.id for r in spark.read.parquet(dims).collect()) == [1, 3]
    assert [r.id for r in spark.read.parquet(facts).collect()] == [2]


def test_facts_read_only_their_own_tables(spark, sf):
    from tideline.operators import joins
    from tideline.plans import fixtures

    plan = joins.order_detail(fixtures.cdc(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 6 and "Union" not in plan


def test_queries_can_be_read_by_many_tasks():
    from tideline.sources import readers

    whole = readers.query_options("jdbc:x", "select 1")
    assert whole == {"url": "jdbc:x", "query": "select 1"}
    split = readers.query_options("jdbc:x", "select 1", ("id", 0, 100, 8))
    assert split["dbtable"] == "(select 1) q" and split["numPartitions"] == "8" and "query" not in split


def test_left_join_of_streams_gives_each_row_once(spark, tmp_path):
    start, minute, late = DAY, 60_000, 10 * DAY  # a watermark starts at 1970, which rows have to be after
    details = _files(spark, str(tmp_path / "d"), "id string, ms long", [("met", start), ("alone", start)], [("far", start + minute)], [("~", late)])
    rights = _files(
        spark, str(tmp_path / "a"), "order_detail_id string, activity_id string, activity_rule_id string, ms long",
        [("met", "1", "r", start + 2 * minute)], [("far", "2", "r", start + 120 * minute), (None, "3", "r", start)], [("~", "4", "r", late)],
    )
    wide = J.with_activity(A.with_event_time(details, "ms", "10 seconds"), A.with_event_time(rights, "ms", "10 seconds"))
    rows = drain(wide.select("id", "activity_id"), str(tmp_path / "out")).filter("id <> '~'")
    assert sorted(map(tuple, rows.collect()), key=str) == [("alone", None), ("far", None), ("met", "1")]


def test_streams_meet_across_arrivals_and_outlive_a_restart(spark, tmp_path):
    left, right = "id string, order_id string, ms long", "id string, user_id string, province_id string, ms long"
    arrivals = [([("d1", "o1", DAY)], [("o2", "u", "p", DAY)]), ([("d2", "o2", DAY + 60_000)], [("o1", "u", "q", DAY + 30_000)])]
    for details, orders in arrivals:  # each side's partner comes with the other arrival
        d, o = _files(spark, str(tmp_path / "d"), left, details), _files(spark, str(tmp_path / "o"), right, orders)
        joined = J.detail_with_order(A.with_event_time(d, "ms", "1 hour"), A.with_event_time(o, "ms", "1 hour"))
        rows = drain(joined.select("id", "province_id"), str(tmp_path / "out"))
    assert sorted(map(tuple, rows.collect())) == [("d1", "q"), ("d2", "p")]


def test_stream_counts_an_order_of_several_arrivals_once(spark, tmp_path):
    schema = "province_id string, order_id string, total_amount decimal(16,2), ms long"
    five = Decimal("5.00")
    stream = _files(spark, str(tmp_path), schema, [("p", "o1", five, 1), ("p", "o2", None, 2)], [("p", "o1", five, 3)], [("~", "~", five, DAY)])
    out = drain(A.province_order_window(A.with_event_time(stream, "ms", "5 seconds")), str(tmp_path / "out"))
    assert [tuple(r) for r in out.select("stt", "province_id", "total", "order_count").collect()] == [("1970-01-01 00:00:00", "p", Decimal("10.00"), 2)]


def test_dimension_changes_by_batches(spark, tmp_path):
    schema = "row_key string, op string, seq long, cells map<string,string>"
    batches = [
        [("a", "u", 1, {"x": "1", "y": "2"}), ("b", "u", 2, {"x": "5"})],
        [("a", "u", 3, {"x": "", "y": "9"}), ("b", "d", 4, None), ("c", "u", 5, {})],
        [("b", "u", 6, {"y": "7"})],
    ]
    write = O.dim_batches(str(tmp_path), ["x", "y"])
    for i, rows in enumerate(batches):
        for _ in range(2):  # a replayed batch changes nothing
            write(spark.createDataFrame(rows, schema), i)
    whole = L.apply_dim_changes(spark.createDataFrame(sum(batches, []), schema), ["x", "y"])
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/version=2").collect()))
    assert got == sorted(map(tuple, whole.collect())) == [("a", "1", "9"), ("b", None, "7"), ("c", None, None)]
