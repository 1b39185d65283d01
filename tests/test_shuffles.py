"""What joins shuffle."""

from tideline.operators import cdc as C
from tideline.operators import joins as J
from tideline.plans import fixtures as X
from tideline.sources import readers as R


def test_rules_have_a_size_that_spark_knows(spark):
    """Rows from Python counted as boundless, so every change was shuffled by its table's name."""
    for table in (X.rules(spark), X.literal_rows(spark, [("a", "b"), ("c", "d")], ["x", "y"])):
        assert int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 100_000
    assert sorted(map(tuple, X.literal_rows(spark, [("a", "b"), ("c", "d")], ["x", "y"]).collect())) == [("a", "b"), ("c", "d")]


def test_the_whole_log_reads_its_rows_once_a_source(spark, sf):
    """Refunds were joined once for each of their four kinds of envelopes, orders once for each of two."""
    whole, apart = X.cdc(spark, sf, whole=True), X.cdc(spark, sf)
    text = lambda df: sorted(r.value for r in C.rows_to_json(df).collect())
    assert text(whole) == text(apart)
    scans = lambda df: sum("Relation" in x and "l_orderkey" in x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert (scans(apart), scans(whole)) == (7, 4)


def test_named_entries_are_what_the_maps_hold(spark):
    lines = [
        '{"source":{"table":"a","ts_ms":"5"},"op":"c","ts_ms":5,"after":{"id":"1","n":"x","deep":{"id":7}},"before":null}',
        '{"source":{"table":"b"},"op":"u","ts_ms":6,"after":{"id":2,"n":null},"before":{"n":1.50}}',
        '{"op":"d","ts_ms":7,"after":null,"before":{"id":{"k":[1]}}}', '{"source":{},"after":{}}', "{}", "[]", "not json", '{"op":"c","after":{"id":"9"', "", None,
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    entries = [C.entry(m, c).alias(f"{m}_{c}") for m in ("after", "before") for c in ("id", "n")] + [C.entry("source", c).alias(c) for c in ("table", "ts_ms")]
    rows = lambda read: read.select(*entries, "op", "et", "source_table").collect()
    assert rows(R.read_cdc(df, entries=["id", "n"])) == rows(R.read_cdc(df))


def _exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]


def test_facts_of_a_stream_are_dealt_out_once_by_the_orders_key(spark, sf):
    """Envelopes of strings were shuffled to get their time, and the details by their id and again by their order."""
    from tideline.streaming.run import dealt_once

    dic = R.read_dim(X.literal_rows(spark, [("1", "one"), ("2", "two")], ["dic_code", "dic_name"]), "dic_code", ["dic_name"])
    jobs = {4: (X.TRADE[:4], J.order_detail), 3: (("refund_payment", "order_refund_info", "order_info"), lambda log: J.refund_success(log, dic))}
    for exchanges, (tables, job) in jobs.items():
        rows = X.trade_rows(spark, sf, tables)
        assert not [f.name for f in rows.schema if f.dataType.typeName() == "map"]
        log = spark.createDataFrame(rows.limit(1_000).collect(), rows.schema).repartition("l_orderkey")
        threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 5_000)
        try:
            with dealt_once(spark):
                found = _exchanges(job(X.trade_changes(log, tables)))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        found = [x for x in found if "hashpartitioning(dic_code" not in x]  # the dictionary's own
        assert len(found) == exchanges and all("hashpartitioning(l_orderkey" in x for x in found)


def test_rows_of_a_log_meet_within_their_key(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], f"id string, {C.KEY} long")
    right = spark.createDataFrame([("a", 1, "x"), ("b", 3, "y")], f"id string, {C.KEY} long, v string")
    assert sorted((r.id, r.v) for r in J.meet(left, right, "id", "left").collect()) == [("a", "x"), ("b", None)]
