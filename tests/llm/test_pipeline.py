"""Every stage of the pipeline on empty, null, repeated and clashing input, and the whole on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import decontaminate, gbt, neardup, secrets
from tideline.llm.inputs import table

EXTRA = {"quality_score": "7", "component_id": "x", "kept": "y", "grp": "1", "rep": "2", "start": "s", "secret": "t", "score": "z", "hub": "h", "key": "k", "word": "w", "item_id": "i"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


@pytest.fixture(scope="module")
def odd(spark, sf):
    passage = table(spark, sf, "benchmark").orderBy("item_id").first().text
    prose = "The quiet river bends around the old mill, and nobody in the village remembers who built the wheel that still turns there. " * 4
    texts = [
        (1, prose), (2, prose), (2, prose), (3, prose + "And one more."), (4, None), (4, None), (None, None), (None, prose), (5, ""), (6, " \n\t"), (7, "one"), (8, f"{prose} {passage} {prose}"),
        (9, f'{prose} token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" {prose}'), (10, "word " * 100_000), (11, "é" * 50_000), (12, "!!! ### $$$ " * 300),
    ]
    return spark.createDataFrame([(i, t, None, "a.env", 5, *EXTRA.values()) for i, t in texts], SCHEMA)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_a_stage_takes_odd_rows_and_empty_tables(spark, sf, odd, name, stage):
    out = stage(spark, odd, sf)
    if name != "packing":
        assert out.columns == odd.columns
        rows = out.collect()
        assert all(r.quality_score == "7" and r.secret == "t" for r in rows) and len(rows) <= odd.count()
    else:
        assert out.select("doc_id").distinct().count() == 13
    none = stage(spark, odd.filter(F.lit(False)), sf)
    assert none.count() == 0 and (name == "packing" or none.columns == odd.columns)


def test_what_each_stage_does_to_odd_rows(spark, sf, odd):
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    clean = ids(stages["decontamination"](spark, odd, sf))
    assert 8 not in clean and len(clean) == odd.count() - 1
    masked = {r.doc_id: r for r in stages["secret_scan"](spark, odd, sf).collect() if r.doc_id}
    assert len(masked) == 12 and '"[SECRET]"' in masked[9].text and masked[9].n_chars == len(masked[9].text)
    assert masked[1].n_chars == 5 and masked[4].text is None
    left = ids(stages["near_dedup"](spark, odd, sf))
    # of the same prose the first id is left, of a repeated id one row, and all rows without an id
    assert [i for i in left if i in (1, 2, 3)] == [1] and left.count(4) == 1 and left.count(None) == 2 and {5, 6, 7, 9, 10, 11, 12} <= set(left)


def test_the_whole_equals_its_operators_one_by_one(spark, sf):
    docs = table(spark, sf, "documents")
    kept = gbt.keep_good(docs, table(spark, sf, "labels"))
    one = neardup.one_of_each(kept, k=5, percent=80)
    last = secrets.redact(decontaminate.clean(one, table(spark, sf, "benchmark")))
    want = {r.doc_id for r in last.select("doc_id").collect()}
    got = corpus_pipeline.run(spark, sf)
    pieces = {}
    for r in got.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(pieces) == want and 0 < len(want) < docs.count()
    for rows in pieces.values():
        at = 0
        for start, length, total in sorted(rows):
            assert start == at
            at += length
        assert at == total
