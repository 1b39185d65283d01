"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in column expression of the whole text; a rule is a
row of ``RULES``. Nothing is shuffled and no user function runs.

Repeated 8-word windows are found from window hashes held in an array: where all
are distinct, nothing repeats; only otherwise are (hash, position) pairs sorted
and equal neighbours turned into covered positions, so the cost stays at
n log n for a text of n words.

Defined results
* null text counts as empty: no words, all counts 0, ``base_failed``
* ratios of a text without words are 0
* repeated rows and ids are each judged; an empty table gives no rows; more
  columns in the input are ignored
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\u000b\f\r"
WINDOW = 8

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it was for on are as with at be this by from or have an they which "
    "de la le et les des en un une du que est pour qui dans par au sur pas ce "
    "der die und das von zu mit den im ist nicht ein eine auf dem sich des "
    "el los las y del se con por una su para al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails if ``measure`` lies outside ``low``..``high`` and it has at least ``words`` words."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    words: int = 1


RULES = (
    Rule("word_length", "mean_word", 2.0, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.02, None, 50),
    Rule("upper_case", "upper_ratio", None, 0.4),
    Rule("same_lines", "dup_line_ratio", None, 0.4),
    Rule("bullet_lines", "bullet_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_ratio", None, 0.3),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def total(s: Column) -> Column:
        def same(e: Column, k: Column) -> Column:
            before = (k > 0) & (F.get(s, k - 1)["h"] == e["h"])
            return before | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))

        at = F.array_sort(F.transform(F.filter(s, same), lambda e: e["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"), p.alias("last"))
        return F.aggregate(at, zero, step, lambda a: a["n"])

    return F.get(F.transform(F.array(pairs), total), F.lit(0))


def measures(docs: DataFrame) -> DataFrame:
    """Counts and ratios of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.trim(F.col("t"), F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+"))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    one = docs.select("doc_id", text.alias("t")).select("doc_id", "t", words.alias("ws"), lines.alias("ls"))
    stop = F.filter("ws", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(*STOP_WORDS))
    starts = F.sequence(F.lit(1), F.size("ws") - (WINDOW - 1))
    windows = F.when(F.size("ws") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("ws", i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    two = one.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.char_length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.char_length("t").alias("chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("[A-Z]")).alias("upper"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.size("ls").alias("n_lines"),
        F.size(stop).alias("n_stop"),
        F.size(F.filter("ls", lambda x: F.ltrim(x, F.lit(SPACES)).rlike("^[-*•]"))).alias("n_bullets"),
        F.size(F.filter("ls", lambda x: F.rtrim(x, F.lit(SPACES)).rlike("(\\.\\.\\.|…)$"))).alias("n_ellipses"),
        windows.alias("hs"),
    )
    repeated = F.when(F.size("hs") > F.size(F.array_distinct("hs")), _covered(F.col("hs"))).otherwise(F.lit(0).cast("long"))
    c = F.col
    return two.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"),
        _ratio(c("word_chars"), c("n_words")).alias("mean_word"),
        _ratio(c("n_symbols"), c("n_words")).alias("symbol_ratio"),
        _ratio(c("n_stop"), c("n_words")).alias("stop_ratio"),
        _ratio(c("upper"), c("chars")).alias("upper_ratio"),
        _ratio(c("n_dup_lines"), c("n_lines")).alias("dup_line_ratio"),
        _ratio(c("n_bullets"), c("n_lines")).alias("bullet_ratio"),
        _ratio(c("n_ellipses"), c("n_lines")).alias("ellipsis_ratio"),
    )


def failed(rule: Rule) -> Column:
    out = F.lit(False)
    if rule.low is not None:
        out = out | (F.col(rule.measure) < rule.low)
    if rule.high is not None:
        out = out | (F.col(rule.measure) > rule.high)
    return out & (F.col("n_words") >= rule.words)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, ``base_failed``, the names of failed rules and the verdict."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    names = F.filter(F.array(*[F.when(failed(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    bad = reduce(lambda a, b: a | b, [failed(r) for r in rules], F.lit(False))
    return measures(docs).select("*", base.alias("base_failed"), F.array_join(names, ",").alias("failed_rules"), (~(base | bad)).alias("kept"))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same table as DuckDB SQL over ``documents``."""
    tests = []
    for r in rules:
        sides = [f"{r.measure} < {r.low}"] if r.low is not None else []
        sides += [f"{r.measure} > {r.high}"] if r.high is not None else []
        tests.append((r.name, f"(({' OR '.join(sides)}) AND n_words >= {r.words})"))
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END"
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    spaces = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: trim(x, {spaces}) <> '') AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(8, i - before))::BIGINT AS n FROM
        (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) AS before FROM rep) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(t) AS chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '[A-Z]')) AS upper_n,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
             len(list_filter(ws, lambda x: rtrim(lower(x), '.,;:!?') IN ({stops}))) AS n_stop,
             len(list_filter(ls, lambda x: regexp_matches(ltrim(x, {spaces}), '^[-*•]'))) AS n_bullets,
             len(list_filter(ls, lambda x: regexp_matches(rtrim(x, {spaces}), '(\.\.\.|…)$'))) AS n_ellipses,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
m AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
             {ratio('word_chars', 'n_words')} AS mean_word, {ratio('n_symbols', 'n_words')} AS symbol_ratio,
             {ratio('n_stop', 'n_words')} AS stop_ratio, {ratio('upper_n', 'chars')} AS upper_ratio,
             {ratio('n_dup_lines', 'n_lines')} AS dup_line_ratio, {ratio('n_bullets', 'n_lines')} AS bullet_ratio,
             {ratio('n_ellipses', 'n_lines')} AS ellipsis_ratio,
             (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM c)
SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests)}) AS failed_rules,
       NOT (base_failed OR {' OR '.join(t for _, t in tests)}) AS kept FROM m
"""
