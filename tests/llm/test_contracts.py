"""Each query against a brute-force version on the smallest tables."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tideline.llm import html, queries, rules, tokens
from tideline.llm.inputs import tokenizer_path

Q = queries.queries()


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(sets, percent):
    """Smallest linked id of every document, by comparing all pairs that share a shingle."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def test_decontamination_finds_every_passage(spark, sf, docs):
    norm = lambda t: " ".join((t or "").lower().split())
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    want = {(d, i) for d, t in docs for i, p in items if norm(p) in norm(t)}
    rows = Q["op1_lemma_decontamination"](spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and want
    text = dict(docs)
    for r in rows:
        assert r.start < r.end <= len(text[r.doc_id])


def test_shards_are_even_and_positions_gapless(spark, sf, docs):
    rows = Q["op2_virtual_slot_shards"](spark, sf).collect()
    text = dict(docs)
    assert len(rows) == len(docs)
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(load) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in rows)
    assert max(load.values()) - min(load.values()) <= largest


def test_language_model_counts_exactly_and_beats_the_base(spark, sf, docs):
    seqs = {i: [*words(t), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in seqs}
    count = Counter(w for i, s in seqs.items() if not held[i] for w in s)
    n, v = sum(count.values()), len(count)
    rows = Q["op3_maxent_scores"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        s = seqs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(s), sum(count[w] > 0 for w in s), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in s), rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_secrets_are_told_from_numbers(spark, sf):
    import re

    sf = sf.replace("sf0.001", "sf0.01")  # the smallest tables hold no token
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    text = dict(docs)
    rows = Q["op4_secret_forest"](spark, sf).collect()
    found = {(r.doc_id, r.start, r.end): r.secret for r in rows}
    want = {(d, m.start(1), m.end(1)) for d, t in docs for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t or "")}
    assert want and sum(found.get(k, False) for k in want) >= 0.9 * len(want)
    assert not any(v for k, v in found.items() if text[k[0]][k[1] : k[2]].isdigit())


def test_pages_give_their_article(spark, sf):
    import html as entities
    import re

    pages = duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in Q["op5_block_extraction"](spark, sf).collect()}
    for page_id, page in pages:
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", page, re.S)[1]
        lines = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", "\n", inner)).split("\n")
        want = "\n".join(x for x in (" ".join(entities.unescape(s).split()) for s in lines) if x)
        assert got[page_id].text == want and got[page_id].n_chars == len(want)


def test_quality_rules_equal_their_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(rules.sql())
    df = Q["op6_quality_rules"](spark, sf)
    assert sorted(df.columns) == sorted(want.columns)
    fix = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(fix(tuple(r)) for r in df.select(*want.columns).collect()) == sorted(map(fix, want.fetchall()))
    assert "Python" not in df._jdf.queryExecution().toString()


def test_good_documents_pass_the_rules(spark, sf):
    good = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{sf}/labels.parquet' WHERE quality = 1").fetchall()}
    rows = [r for r in Q["op6_quality_rules"](spark, sf).collect() if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in rows) >= 0.98 * len(rows)


def test_packing_loses_no_token(spark, sf, docs):
    tokenizer = tokens.WordTokenizer(tokenizer_path())
    pieces = defaultdict(list)
    windows = defaultdict(list)
    for r in Q["op7_tiered_packing"](spark, sf).collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in docs:
        ids = np.append(tokenizer.encode_whole(text or ""), 2)
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length].astype("<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0  # nothing is padded


def test_turns_are_linked(spark, sf):
    turns = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    role = {(c, t): r for c, t, r, _ in turns}
    rows = Q["op8_tool_call_linking"](spark, sf).collect()
    assert len(rows) == len(turns)
    for r in rows:
        turn = int(r.call_id.split(":")[1])
        if r.kind == "call":
            assert r.links == (role.get((r.conv_id, turn + 1)) == "assistant")
        else:
            assert (r.status == "ok") == (role.get((r.conv_id, turn)) in ("user", "system"))
    plan = Q["op8_tool_call_linking"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_components_equal_all_pairs(spark, sf, docs):
    sets = {i: shingles(t, 4) for i, t in docs}
    want = components(sets, 80)
    for r in Q["op9_chosen_path_dedup"](spark, sf).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_classifier_on_held_out_labels(spark, sf):
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    rows = Q["op10_boosted_quality"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert sum(p == y for p, y in held) >= 0.8 * len(held)


def test_pipeline_stages_follow_brute_force(spark, sf, docs):
    import corpus_pipeline as P

    stages = dict(P.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontamination", "secret_scan", "packing"]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    good = stages["quality"](spark, table, sf)
    scored = {r.doc_id for r in Q["op10_boosted_quality"](spark, sf).filter("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == scored and good.columns == table.columns
    one = stages["near_dedup"](spark, table, sf)
    sets = {i: shingles(t, 5) for i, t in docs}
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for i, c in components(sets, 80).items()})
    clean = stages["decontamination"](spark, table, sf)
    bad = {r.doc_id for r in Q["op1_lemma_decontamination"](spark, sf).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - bad
    safe = {r.doc_id: r for r in stages["secret_scan"](spark, table, sf).collect()}
    hits = Q["op4_secret_forest"](spark, sf).filter("secret").collect()
    assert len(safe) == len(docs)
    for r in hits:
        assert safe[r.doc_id].text.count("[SECRET]") >= 1 and safe[r.doc_id].n_chars == len(safe[r.doc_id].text)
    packed = P.run(spark, sf).select("doc_id").distinct().count()
    assert 0 < packed <= len(docs)


def test_blocks_of_other_page_shapes():
    page = """<body><header><h1>Site</h1></header><aside class="sidebar">links of the day in the world</aside><div class="cookie-notice">We use the cookies of the site</div>
<main><h2>Title</h2><p>A short.</p><p>The text of the article is in &quot;here&quot;   and&nbsp;it was &amp; good.</p><form>Name <input></form><div id="comments"><p>I like the article of the day</p></div></main></body>"""
    assert html.main_text(page) == 'Title\nA short.\nThe text of the article is in "here" and it was & good.'
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>") == ""
