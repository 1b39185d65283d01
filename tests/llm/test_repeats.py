"""Rows repeated many times: sharding and the classifier's sample."""

from collections import Counter

from pyspark.sql import functions as F

from tideline.llm import gbt, sharding


def test_shards_stay_even_when_one_row_is_repeated(spark):
    other = spark.range(2000).select("id", F.concat(F.lit("text "), F.col("id").cast("string"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("text"))
    same = spark.range(20_000).select(F.lit(None).cast("long").alias("id"), F.lit("one text").alias("text"))
    rows = sharding.shard_documents(other.unionByName(same).withColumnRenamed("id", "doc_id"), 4).collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert len(rows) == 22_000 and max(load.values()) - min(load.values()) <= 100
    for shard in load:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert {r.map_version for r in rows} == {2}
    assert max(Counter(r.vslot for r in rows).values()) < 20


def test_a_repeated_document_is_one_labelled_row(spark):
    words = ["alpha beta gamma delta", "AAA !!! ### 111"]
    docs = spark.createDataFrame([(i, f"{words[i % 2]} {i} " * (3 + i % 4)) for i in range(40)] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    once = docs.dropDuplicates(["doc_id"])
    a, b = gbt.train(docs, labels, sample=20), gbt.train(once, labels, sample=20)
    assert len(a.feature) and a.base == b.base
    assert (a.feature == b.feature).all() and (a.threshold == b.threshold).all() and (a.leaf == b.leaf).all()


def test_labels_of_absent_documents_change_nothing(spark):
    words = ["alpha beta gamma delta", "AAA !!! ### 111"]
    docs = spark.createDataFrame([(i, f"{words[i % 2]} {i} " * (3 + i % 4)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    absent = spark.range(1000, 201_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    a, b = gbt.train(docs, labels, sample=150), gbt.train(docs, labels.unionByName(absent), sample=150)
    assert a.base == b.base and len(a.feature)
    assert (a.feature == b.feature).all() and (a.threshold == b.threshold).all() and (a.leaf == b.leaf).all()


def test_splits_are_those_of_an_exhaustive_search():
    """The first tree's root is the best of all splits of a small table; scores follow its leaves one by one."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (120, 4)).astype(np.float32)
    y = ((x[:, 2] > 4) | (rng.random(120) < 0.1)).astype(float)
    model = gbt.fit(x, y, rounds=3, depth=2)
    p = 1 / (1 + np.exp(-model.base))
    g, h = y - p, np.full(len(y), p * (1 - p))

    def gain(j, t):
        left = x[:, j] <= t
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 2.0)
        return part(left) + part(~left) - part(np.ones(len(y), bool)) if min(h[left].sum(), h[~left].sum()) >= 4.0 else -1

    best = max(gain(j, t) for j in range(4) for t in range(9))
    assert abs(gain(model.feature[0, 0], model.threshold[0, 0]) - best) < 1e-9
    for row, got in zip(x, model.score(x), strict=True):
        total = model.base
        for tree in range(3):
            node = 0
            while node < 3:
                node = 2 * node + 1 + (row[model.feature[tree, node]] > model.threshold[tree, node])
            total += model.leaf[tree, node - 3]
        assert abs(1 / (1 + np.exp(-total)) - got) < 1e-9
