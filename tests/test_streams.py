"""Keyed state, tables and sinks of streams: order, lifetime, failures, replays."""

import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tideline.operators import changelog as L
from tideline.operators import joins as J
from tideline.operators import keyed as K
from tideline.operators import windows as A
from tideline.sources import sinks as O
from tideline.sources.tables import BucketTable, Files, commit_batch, committed
from tideline.streaming import state
from tideline.streaming.run import drain, keep_rules, kept_rules, late_rows_aside, lookup_stream, retract_stream, route_stream

PAGES = "user string, _is_new string, ts long, id long, cents long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def arrivals(spark, path, schema, parts):
    """Each part in turn appended to a folder, and the stream that reads it."""
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{path}/in")
        yield spark.readStream.schema(schema).parquet(f"{path}/in")


def pages():
    day = 86_400_000
    # a hot user, ties in time, and rows over midnight
    return [(f"u{i % 3 if i % 2 else 0}", "1" if i % 4 else "0", 5 * day + (i // 2) * day // 7, i, None if i % 9 == 0 else i) for i in range(90)]


@pytest.mark.parametrize("frame_rows,names", [(10_000, ("first", "new")), (4, ("pairs",))])
def test_rows_in_any_order_give_the_batch_result(spark, tmp_path, frame_rows, names):
    rows = pages()
    day = 86_400_000
    jumbled = sorted(rows, key=lambda r: r[2] + (r[3] * 7919) % 100 * day // 100)
    marks = [("mark", "0", 100 * day, 1000, 0)]
    parts = [jumbled[:35], jumbled[35:36], jumbled[36:] + marks]
    whole = spark.createDataFrame(rows, PAGES)
    # the jumble really is one: a stream that takes rows as they come must differ
    assert [r[3] for r in jumbled] != [r[3] for r in rows]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", frame_rows)
    try:
        for name, run, want in (
            ("first", lambda s: state.first_of_day(s, "user", "ts", "id", delay="1 day"), K.first_of_day(whole, "user", "ts", "id")),
            ("new", lambda s: state.fix_is_new(s, "user", "_is_new", "ts", "id", delay="1 day", slice_ms=day // 3), K.fix_is_new(whole, "user", "_is_new", "ts", "id")),
            ("pairs", lambda s: state.retract_pairs(s, ["user"], "ts", "id", ["cents"], delay="1 day"), L.retract_pairs(whole, ["user"], ["ts", "id"], ["cents"])),
        ):
            if name not in names:
                continue
            for stream in arrivals(spark, tmp_path / name, PAGES, parts):
                got = drain(run(stream), str(tmp_path / name / "out"))
            assert rows_of(got) == rows_of(want.withColumn("cents", F.col("cents").cast("long"))), name
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_later_than_the_delay_are_dropped(spark, tmp_path):
    day = 86_400_000
    row = lambda t, i: ("u", "1", t, i, 1)
    parts = [[row(10 * day, 1)], [row(20 * day, 2)], [row(9 * day, 3), row(19 * day + 1, 4)], [row(60 * day, 5)]]
    for stream in arrivals(spark, tmp_path, PAGES, parts):
        got = drain(state.first_of_day(stream, "user", "ts", "id", delay="1 day"), str(tmp_path / "out"))
    assert [r.id for r in got.orderBy("ts").collect()] == [1, 4, 2]  # 3 came too late, 5 still waits


def test_a_key_expires_between_two_batches(spark, tmp_path):
    row = lambda user, i: (user, "1", i, i, 10 * i)
    parts = [[row("a", 1), row("a", 2)], [row("a", 3)]]
    out = {}
    for name, ttl, wait in (("short", 1000, 3.0), ("long", 600_000, 0.0)):
        for i, stream in enumerate(arrivals(spark, tmp_path / name, PAGES, parts)):
            if i:
                time.sleep(wait)
            got = drain(state.retract_pairs(stream, ["user"], "ts", "id", ["cents"], ttl_ms=ttl), str(tmp_path / name / "out"), empty_batches=False)
        out[name] = sorted((r.id, r.cents, r.sign) for r in got.collect())
    assert out["short"] == [(1, -10, -1), (1, 10, 1), (2, 20, 1), (3, 30, 1)]  # 2 was forgotten before 3 came
    assert out["long"] == [(1, -10, -1), (1, 10, 1), (2, -20, -1), (2, 20, 1), (3, 30, 1)]
    with pytest.raises(ValueError):
        state.retract_pairs(stream, ["user"], "ts", "id", ["cents"], ttl_ms=1, delay="1 day")


# --- tables, ledgers, rules, snapshots -----------------------------------------


class Stopped(Exception):
    pass


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, ["id"], n_buckets=100)
    write = O.upserts(table, ["ts"])
    frame = lambda rows: spark.createDataFrame(rows, "id long, ts long, v string")
    write(frame([(i, 1, "old") for i in range(2000)]), 0)
    before = table.version()
    write(frame([(7, 2, "new"), (7, 3, "newer"), (7, 0, "late")]), 1)
    after = table.version()
    changed = [b for b in after.buckets if after.buckets[b] != before.buckets.get(b)]
    assert len(before.buckets) == 100 and len(changed) == 1
    data = Files(spark, path)
    new = {f.rsplit("/", 1)[0] for b in changed for f in after.buckets[b]}
    assert {r.v for r in table.read().filter("id = 7").collect()} == {"newer"} and table.read().count() == 2000
    assert sum(len(data.names(f"{path}/{d}")) for d in new) == len(after.buckets[changed[0]])
    write(frame([(7, 9, "again")]), 1)  # seen already
    assert table.version() == after
    assert {r.v for r in table.read(1).filter("id = 7").collect()} == {"old"}
    table.vacuum(keep=1)
    assert table.versions() == [2] and table.read().count() == 2000
    write(frame([]), 2)
    assert table.version().batch == 2 and table.read().count() == 2000


def test_a_crash_between_data_and_version_changes_nothing(spark, tmp_path, monkeypatch):
    table = BucketTable(spark, str(tmp_path / "t"), ["id"], n_buckets=4)
    write = O.upserts(table, ["ts"])
    rows = spark.createDataFrame([(i, 1) for i in range(50)], "id long, ts long")
    write(rows, 0)
    with monkeypatch.context() as m:
        m.setattr(BucketTable, "_commit", lambda *_: (_ for _ in ()).throw(Stopped()))
        with pytest.raises(Stopped):
            write(rows.withColumn("ts", F.lit(2).cast("long")), 1)
    assert {r.ts for r in table.read().collect()} == {1} and table.version().number == 1
    write(rows.withColumn("ts", F.lit(2).cast("long")), 1)
    assert {r.ts for r in table.read().collect()} == {2} and table.read().count() == 50
    with pytest.raises(ValueError):
        BucketTable(spark, str(tmp_path / "t"), ["ts"]).read()


def test_dimension_table_equals_the_batch_form(spark, tmp_path):
    schema = "row_key string, op string, seq long, cells map<string,string>"
    batches = [[("a", "u", 1, {"x": "1", "y": "2"}), ("b", "u", 2, {"x": "5"})], [("a", "u", 3, {"x": "", "y": "9"}), ("b", "d", 4, None), ("c", "u", 5, {})], [("b", "u", 6, {"y": "7"})]]
    table = BucketTable(spark, str(tmp_path), ["row_key"], n_buckets=3)
    write = O.dim_changes(table, ["x", "y"])
    for i, rows in enumerate(batches):
        for _ in range(2):
            write(spark.createDataFrame(rows, schema), i)
    assert rows_of(table.read()) == rows_of(L.apply_dim_changes(spark.createDataFrame(sum(batches, []), schema), ["x", "y"]))


def test_batches_are_committed_once_and_nothing_half(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    df = spark.range(5).withColumn("cur_date", F.lit("2020-01-01"))
    assert commit_batch(df, path, 3, "cur_date") and not commit_batch(df, path, 3, "cur_date")
    with monkeypatch.context() as m:
        m.setattr(Files, "rename", lambda *_: (_ for _ in ()).throw(Stopped()))
        with pytest.raises(Stopped):
            commit_batch(df, path, 4)
    assert committed(spark, path) == {3} and spark.read.schema("id long, cur_date string").parquet(path).count() == 5
    assert commit_batch(df.limit(0), path, 4, "cur_date") and committed(spark, path) == {3, 4}


@pytest.mark.parametrize("where", ["rows", "table"])
def test_a_failed_batch_of_retractions_is_made_up_for(spark, tmp_path, monkeypatch, where):
    """A second stream reads the first one's folder and must see nothing twice."""
    schema = "id string, ts long, cents long"
    parts = [[("k", 1, 5), ("j", 1, 1)], [("k", 2, 6)], [("k", 3, 7), ("j", 2, 2)]]
    failed = []

    def fail(batch_id):
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise Stopped("in mid-batch")

    if where == "table":
        whole = BucketTable._commit

        def late(self, version):
            fail(version.batch)
            whole(self, version)

        monkeypatch.setattr(BucketTable, "_commit", late)
    for stream in arrivals(spark, tmp_path, schema, parts):
        stream = stream.withColumn("cents", F.col("cents").cast("decimal(16,2)"))
        run = lambda s=stream: retract_stream(s, str(tmp_path / "out"), ["id"], ["ts"], ["cents"], between=fail if where == "rows" else None)
        try:
            signed = run()
        except StreamingQueryException:
            signed = run()
        again = spark.readStream.schema(signed.schema).parquet(str(tmp_path / "out/rows")).drop("batch")
        got = drain(again, str(tmp_path / "copy"))
    want = L.retract_pairs(spark.createDataFrame(sum(parts, []), schema).withColumn("cents", F.col("cents").cast("decimal(16,2)")), ["id"], ["ts"], ["cents"])
    assert failed == [1] and rows_of(got) == rows_of(want) == rows_of(signed)


def test_rows_wait_again_when_all_rules_are_gone(spark, tmp_path):
    schema = "source map<string,string>, op string, id long"
    rules = spark.createDataFrame([("a", "dim_a")], "source_table string, sink_table string")
    parts = [[({"table": "a"}, "c", 1)], [({"table": "a"}, "c", 2)], [({"table": "a"}, "c", 3)], [({"table": "b"}, "c", 4)]]
    for i, stream in enumerate(arrivals(spark, tmp_path, schema, parts)):
        dims, facts = route_stream(stream, lambda _, i=i: rules.filter(F.lit(i in (1, 3))), str(tmp_path / "out"))
    assert sorted((r.batch, r.id) for r in spark.read.parquet(dims).collect()) == [(1, 1), (1, 2), (3, 3)]
    assert [(r.batch, r.id) for r in spark.read.parquet(facts).collect()] == [(3, 4)]
    assert committed(spark, str(tmp_path / "out/pending")) == {0, 2}  # each written once


def test_a_late_rule_change_does_not_bring_back_a_deleted_rule(spark, tmp_path):
    rule = {"source_table": "a", "sink_table": "dim_a"}
    schema = "op string, ts_ms long, seq long, after map<string,string>, before map<string,string>"
    table = BucketTable(spark, str(tmp_path / "rules"), ["rule_key"], n_buckets=2)
    assert kept_rules(table).count() == 0
    for part, n in (([("c", 1, 1, rule, None)], 1), ([("d", 5, 5, None, rule)], 0), ([("u", 3, 3, rule, rule)], 0), ([("c", 9, 9, rule, None)], 1)):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "log"))
        keep_rules(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), table, str(tmp_path / "run"))
        assert kept_rules(table).count() == n


def test_a_replayed_batch_reads_the_snapshot_of_its_time(spark, tmp_path, monkeypatch):
    table = BucketTable(spark, str(tmp_path / "dim"), ["k"], n_buckets=2)
    write = O.upserts(table, ["seq"])
    write(spark.createDataFrame([("a", "old", 1)], "k string, name string, seq int"), 0)
    stream = next(arrivals(spark, tmp_path, "k string, id long", [[("a", 1)]]))
    seen = []

    def join(df, dim):
        out = df.join(dim.select("k", "name"), "k")
        seen.append(1)
        if len(seen) == 1:
            write(spark.createDataFrame([("a", "new", 2)], "k string, name string, seq int"), 1)
            raise Stopped("in mid-batch")
        return out

    with pytest.raises(StreamingQueryException):
        lookup_stream(stream, table, str(tmp_path / "out"), join)
    rows = lookup_stream(stream, table, str(tmp_path / "out"), join)
    assert [r.name for r in spark.read.parquet(rows).collect()] == ["old"] and len(seen) == 2


def test_a_lookup_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "dim"), ["k"], n_buckets=50)
    write = O.upserts(table, ["seq"])
    write(spark.createDataFrame([(i, f"name {i}", 1) for i in range(1000)], "k long, name string, seq int"), 0)
    read = []

    def join(df, dim):
        read.append(len(dim.inputFiles()))
        return df.join(dim.select("k", "name"), df.code.try_cast("long") == F.col("k"), "left").select("id", "name")

    # the stream's keys are text: unreadable, null and unknown ones meet nothing
    parts = [[("7", 1), ("8", 2), ("7", 3), ("x", 4), (None, 5), ("5000", 6)], [("9", 7)], [(None, 8)]]
    for i, stream in enumerate(arrivals(spark, tmp_path, "code string, id long", parts)):
        if i == 1:
            write(spark.createDataFrame([(9, "new name", 2)], "k long, name string, seq int"), 1)
        rows = lookup_stream(stream, table, str(tmp_path / "out"), join, on=["code"])
    got = {r.id: r.name for r in spark.read.parquet(rows).collect()}
    assert got == {1: "name 7", 2: "name 8", 3: "name 7", 4: None, 5: None, 6: None, 7: "new name", 8: None}
    assert read[0] <= 4 and read[1] == 1 and read[2] <= 1
    with pytest.raises(ValueError):
        table.read_near(spark.createDataFrame([(1,)], "a long"), [])
    assert BucketTable(spark, str(tmp_path / "none"), ["k"]).read_near(spark.createDataFrame([(1,)], "k long"), ["k"]) is None


def test_a_table_keeps_a_bounded_number_of_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        BucketTable(spark, path, ["id"], keep=1)
    table = BucketTable(spark, path, ["id"], n_buckets=4, keep=2)
    write = O.upserts(table, ["ts"])
    for batch in range(6):
        write(spark.createDataFrame([(i, batch, f"v{batch}") for i in range(batch, 20)], "id long, ts long, v string"), batch)
    assert table.versions() == [5, 6]
    used = {f for n in (5, 6) for fs in table.version(n).buckets.values() for f in fs}
    there = {f"data/{d}/{b}/{f}" for d in table.files.names(f"{path}/data") for b in table.files.names(f"{path}/data/{d}") for f in table.files.names(f"{path}/data/{d}/{b}") if b.startswith("_bucket")}
    assert {f for f in there if f.endswith(".parquet")} == used
    assert {r.id: r.v for r in table.read().collect()} == {i: f"v{min(i, 5)}" for i in range(20)}


def test_interval_join_makes_no_far_pairs(spark):
    left = spark.createDataFrame([("u", 1000 * i, i) for i in range(300)] + [("u", None, -1)], "user string, a long, i long")
    right = spark.createDataFrame([("u", 1000 * i + 1, i) for i in range(-50, 350)] + [("v", 5, 0)], "user string, b long, j long")
    got = J.within(left, right, "user", "a", "b", before_ms=3000, after_ms=1500)
    assert sorted((r.i, r.j) for r in got.collect()) == [(i, j) for i in range(300) for j in range(i - 3, i + 2)]
    assert sorted((r.i, r.j) for r in J.within(left, left.select("user", F.col("a").alias("b"), F.col("i").alias("j")), "user", "a", "b", 0, 0).collect()) == [(i, i) for i in range(300)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan.split("Join Inner", 1)[1].split("\n")[0]


def test_order_sketches_merge_to_any_window(spark):
    rows = spark.range(60_000).select(F.timestamp_seconds(F.col("id") * 10).alias("et"), F.lit("p").alias("province_id"), (F.col("id") % 20_000).alias("order_id"), F.lit(1).alias("total_amount"))
    days = A.order_sketch_window(rows, "1 hour")
    week = A.merge_order_sketches(days, "7 days").collect()
    assert [abs(r.order_count - 20_000) < 500 for r in week if r.total > 50_000] == [True] and sum(r.total for r in week) == 60_000


def test_trade_facts_build_their_maps_once(spark, sf):
    from tideline.plans import fixtures

    plan = J.order_detail(fixtures.cdc(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "map(" in x]


def test_files_roll_by_size_age_and_idleness(spark, tmp_path):
    day, schema = 86_400_000, "id long, ts long, pad string"
    clock = {"now": 0.0}
    roll = O.RollingFiles(str(tmp_path), "ts", most_bytes=2000, age_s=600, idle_s=300, chunks=4, now=lambda: clock["now"])
    made = []

    def batch(n, now, days=1):
        clock["now"] = now
        rows = [(len(made) + i, day * (18_000 + i % days), "x" * (i % 30)) for i in range(n)]
        made.extend(rows)
        number = batch.n = getattr(batch, "n", -1) + 1
        for _ in range(2):  # replayed at another time
            roll(spark.createDataFrame(rows, schema), number)
            clock["now"] += 5000
        return sorted((f.parent.parent.name, f.stat().st_size) for f in tmp_path.glob(f"lines/batch={number}/*/*/*.txt"))

    assert batch(10, 0) == []  # too little for a file
    assert batch(10, 100) == []
    sizes = batch(500, 200, days=2)
    assert len(sizes) > 8 and all(1860 <= s <= 2000 for _, s in sizes)
    assert batch(1, 400) == []  # the first day is touched again, the second is not yet idle
    assert [d for d, _ in batch(1, 520)] == ["day=20190415"]  # the second was idle for 300 s
    assert [d for d, _ in batch(1, 810)] == ["day=20190414"]  # the first was never idle but is 600 s old
    got = spark.read.text(f"{tmp_path}/lines").select(F.get_json_object("value", "$.id").cast("long").alias("id"))
    assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in made)
    assert spark.read.parquet(f"{tmp_path}/_open").filter(F.col("batch") == batch.n).count() == 0


def test_the_registered_words_function_is_native(spark):
    from tideline.functions import words as W

    rows = [(1, "Phone 手机壳 A1 书"), (2, None), (3, ""), (4, "Zwölf-x_y 手 I'm"), (5, "ÀÉ ﬁ ٣٤")]
    df = spark.createDataFrame(rows, "id int, t string")
    W.register(spark, "split_words_here")
    df.createOrReplaceTempView("texts_here")
    got = spark.sql("SELECT id, w.word FROM texts_here, LATERAL split_words_here(t) w")
    assert rows_of(got) == rows_of(W.split_words(df, "t").select("id", "word")) and got.count() == 14
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_routing_joins_once(spark):
    from tideline.operators import cdc as C

    cdc = spark.createDataFrame([("a", "c", 1), ("b", "c", 2), (None, "c", 3)], "source_table string, op string, id long")
    rules = spark.createDataFrame([("a", "dim_a")], "source_table string, sink_table string")
    dim, fact = C.route_by_rules(cdc, rules)
    assert [tuple(r) for r in dim.collect()] == [("a", "c", 1, "dim_a")]
    assert rows_of(fact) == [("b", "c", 2), (None, "c", 3)] and fact.columns == cdc.columns


# --- outside sources -------------------------------------------------------------


@pytest.fixture(scope="module")
def database(spark):
    """A database inside the JVM, with 1,000 orders, three of them without a number."""
    url = "jdbc:derby:memory:orders;create=true"
    rows = spark.range(1000).select(F.when(F.col("id") % 400 != 7, F.col("id")).alias("ORDER_ID"), (F.col("id") % 7).cast("int").alias("USER_ID"), F.concat(F.lit("n"), "id").alias("ORDER_NAME"))
    rows.write.format("jdbc").options(url=url, dbtable="ORDERS", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    return url


def test_a_query_is_read_by_one_task_or_by_many(spark, database):
    from tideline.sources import readers as R

    sql = "SELECT ORDER_ID, ORDER_NAME FROM ORDERS WHERE USER_ID < 5"
    one = R.read_query(spark, database, sql, camel_names=True)
    many = R.read_query(spark, database, sql, camel_names=True, by="ORDER_ID", parts=5)
    given = R.read_query(spark, database, sql, split=("ORDER_ID", 300, 600, 3))
    assert one.columns == many.columns == ["orderId", "orderName"]
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 5 and given.rdd.getNumPartitions() == 3
    assert rows_of(one) == rows_of(many) == rows_of(given) and one.count() > 700
    assert max(r["count"] for r in many.groupBy(F.spark_partition_id()).count().collect()) < 200
    assert R.query_bounds(spark, database, sql, "ORDER_ID", 5) == ("ORDER_ID", 0, 998, 5)
    none = R.read_query(spark, database, "SELECT ORDER_ID FROM ORDERS WHERE USER_ID > 50", by="ORDER_ID")
    assert none.count() == 0


def test_kafka_reads_are_told_where_to_begin_and_end():
    from tideline.sources.readers import topic_options

    assert topic_options("h:1", "t") == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest"}
    got = topic_options("h:1", ["a", "b"], {"a": {1: 5, 0: "latest"}, "b": {0: "earliest"}}, end=1_700_000_000_000, per_trigger=9, min_parts=40)
    assert got["startingOffsets"] == '{"a": {"0": -1, "1": 5}, "b": {"0": -2}}' and got["endingTimestamp"] == "1700000000000"
    assert got["subscribe"] == "a,b" and got["maxOffsetsPerTrigger"] == "9" and got["minPartitions"] == "40"
    assert topic_options("h:1", "t", 5, "latest")["startingTimestamp"] == "5"
    for bad in ({"start": "first"}, {"end": "earliest"}, {"start": {"other": {0: 1}}}):
        with pytest.raises(ValueError):
            topic_options("h:1", "t", **bad)


def test_folders_of_streams_can_be_removed(spark):
    from tideline.streaming.run import clear_work, work_dir

    path = work_dir(spark, "gone")
    spark.range(3).write.parquet(f"{path}/rows")
    assert Files(spark, path).exists(path)
    clear_work(spark)
    assert not Files(spark, path).exists(path)


def test_rows_after_their_window_has_closed_are_put_aside(spark, tmp_path):
    schema = "id long, ms long"
    # delay 5, windows of 10: after 27 the watermark is 22, so windows up to 20 are closed
    parts = [[(0, 1_000), (1, 12_000), (2, 27_000)], [(10, 3_000), (11, 19_999), (12, 20_000), (13, None), (14, 60_000)], [(20, 49_999), (21, 50_000), (22, 27_000)]]
    for stream in arrivals(spark, tmp_path, schema, parts):
        timed = stream.withColumn("et", F.timestamp_millis("ms"))
        for _ in range(2):  # the second run finds nothing new
            in_time, late = late_rows_aside(timed, str(tmp_path / "out"), 10, 5)
    assert sorted(r.id for r in spark.read.parquet(late).collect()) == [10, 11, 20, 22]
    assert sorted(r.id for r in spark.read.parquet(in_time).collect()) == [0, 1, 2, 12, 13, 14, 21]


def test_processing_time_is_now(spark):
    from tideline.functions import scalars as S

    seconds = spark.range(1).select(F.unix_timestamp(S.processing_time()).alias("t")).first().t
    assert abs(seconds - time.time()) < 60
