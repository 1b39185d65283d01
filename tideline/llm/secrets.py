"""Secret scans with a random forest that removes false positives.

Candidates are runs of at least ``least`` key characters that hold a digit or
begin like a known kind of key, values of any characters but a digit or sign among
them that are assigned to a credential's name, signed tokens of three parts, and
private keys from their first line to their last; with ``plain`` runs and values
without a digit or sign too. A value has no greatest length. A name before ``=`` is
no part of a value.

Each candidate gets figures on its length, on its character transitions (kinds,
repeats, and how surprising its pairs of characters are under the corpus's own), on
how much of it words of the corpus cover, on the path it stands in and on its
neighbouring words; those of a block are worked out together, by array arithmetic.
Pairs are counted over all texts, as are words, of which the ``WORDS`` most frequent
are the dictionary.

A random forest trained on labelled findings alone decides. Labels are
(doc_id, start, end, secret). Where no reviewed findings are given, findings are
planted: ``PLANTED`` made-up secrets and harmless values of many forms are set into
snippets of the corpus's own texts, so what is true of each is known from its making
and not from its figures.

Findings carry a fingerprint, never the value. Offsets count characters.

Defined results
* null and empty texts have no candidates
* null ``source``, or no such column, is an empty path; null ``doc_id`` is scanned but never a label
* repeated rows are each reported and are one labelled finding; an empty table gives no rows; more columns
  are ignored by ``scan`` and kept by ``redact``
* with given labels of one class only, or none that meet a candidate, every score is the labels' share
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import ship
from .forest import Forest, fit
from .plant import plant
from .store import Scratch
from .textblock import LOWER, U64, Words, arrow_bytes, slices, trimmed

LEAST = 16
SAMPLE = 20_000
PLANTED = 6000
SNIPPETS = 1000
CUT = 0.5
MASK = "[SECRET]"
CONTEXT = 48
WORDS = 50_000
SHORT = 6  # least length of a value assigned to a credential's name

# Names credentials are assigned to, and words found in harmless identifiers.
KEY_WORDS = "token secret key apikey api_key access_key password passwd pwd auth bearer credential credentials private signature".split()
HARMLESS = "example sample test dummy placeholder uuid guid sha1 sha256 md5 checksum digest commit revision hash order phone card isbn".split()
_KEY = np.zeros(256, bool)
_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=-")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_KIND = np.zeros(256, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_VOWEL, _HEX = np.zeros(256, bool), np.zeros(256, bool)
_VOWEL[list(b"aeiouAEIOU")] = True
_HEX[list(b"0123456789abcdefABCDEF")] = True
_WORD = re.compile(rb"[A-Za-z_]{2,}")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_ENDS = re.compile(rb"[?&,;\n]")
_ASSIGNED = re.compile(
    rb"(?:token|secret|password|passwd|pwd|passphrase|api_?key|access_?key|credentials?|signature)[A-Za-z0-9_]{0,40}[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"'`]?"
    rb"([^\s\"'`<>,;&?(){}\[\]]{%d,})" % SHORT, re.I
)
_TELLING = re.compile(rb"[0-9!@#$%^*~]")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
# kinds of bytes for pairs: letters, digit, and some marks of their own
_PAIR = np.full(256, 31, np.int64)
_PAIR[97:123] = _PAIR[65:91] = np.arange(26)
_PAIR[48:58], _PAIR[128:] = 26, 32
for _j, _bytes in enumerate((b"_-", b"/.", b"+=", b" \t\r\n"), 27):
    _PAIR[list(_bytes)] = _j
PAIRS = 33
_PEM = re.compile(
    rb"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    rb"(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{32,})*)"
)
_JWT = re.compile(rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*")
_PREFIX = re.compile(
    rb"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{16}|github_pat_[A-Za-z0-9_]{16}|xox[baprs]-[A-Za-z0-9-]{10}|sk[-_][A-Za-z0-9_-]{16}|eyJ[A-Za-z0-9_-]{8}|AIza[A-Za-z0-9_-]{16}"
)
_BEARER = re.compile(rb"(?:bearer|authorization[\"']?\s*[:=]\s*[\"']?(?:basic|token))\s+[\"'`]?$", re.I)

NAMES = (
    "length log_length lower upper digit other hex_only digits_only entropy surprise switches vowel_pairs repeats longest_run covered "
    "prefix pem slashes in_url path_test path_code key_before key_near harmless_name harmless_near assigned quoted spaced_after bearer"
).split()
FOUND = "doc_id long, start long, end long, kind string, fingerprint string, x array<float>"
_AT = {n: i for i, n in enumerate(NAMES)}


@dataclass
class Corpus:
    """What is usual in the texts: bits of each pair of character kinds, hashes of frequent words (ascending)."""

    bits: np.ndarray
    words: np.ndarray

    def surprises(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean bits of the pairs of each value."""
        kind = _PAIR[data]
        bits = np.append(self.bits[kind[:-1], kind[1:]], 0.0) if len(kind) else np.zeros(0)
        bits[offsets[1:-1] - 1] = 0.0  # pairs over an edge
        bits[-1:] = 0.0
        return _sums(bits, offsets) / np.maximum(1, np.diff(offsets) - 1)

    def coverage(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Share of each value in words of three letters and more that the corpus knows."""
        words = _letter_words(data, offsets)
        size = words.end - words.start
        known = size >= 3
        if len(self.words):
            known &= self.words[np.minimum(np.searchsorted(self.words, words.hash), len(self.words) - 1)] == words.hash
        else:
            known[:] = False
        of = np.searchsorted(offsets, words.start, side="right") - 1
        return np.bincount(of[known], size[known], len(offsets) - 1) / np.maximum(1, np.diff(offsets))

    def surprise(self, value: bytes) -> float:
        return float(self.surprises(np.frombuffer(value, np.uint8), np.array([0, len(value)]))[0])

    def covered(self, value: bytes) -> float:
        return float(self.coverage(np.frombuffer(value, np.uint8), np.array([0, len(value)]))[0])


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _letter_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(np.where(_LETTER[data], LOWER[data], np.uint8(0x20)), offsets)


def corpus_of(docs: DataFrame) -> Corpus:
    """Pairs and words counted over all texts; the result is bounded."""
    spark = ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(PAIRS * PAIRS, np.int64)
        for batch in batches:
            data, offsets = arrow_bytes(batch.column(0))
            for a, b in slices(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                code = _PAIR[part[:-1]] * PAIRS + _PAIR[part[1:]]
                inside = np.ones(len(code), bool)
                edge = at[(at > 0) & (at < len(part))]
                inside[edge - 1] = False
                pairs += np.bincount(code[inside], minlength=PAIRS * PAIRS)
                words = _letter_words(part, at)
                hashes, n = np.unique(words.hash[words.end - words.start >= 3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), bool)), pa.array(hashes.view(np.int64)), pa.array(n)], ["word", "what", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(pairs), bool)), pa.array(np.arange(len(pairs))), pa.array(pairs)], ["word", "what", "n"])

    counts = docs.select("text").mapInArrow(trimmed(run), "word boolean, what long, n long").groupBy("word", "what").agg(F.sum("n").alias("n"))
    counts = Scratch(spark, "corpus").keep(counts, "counts")
    pairs = np.zeros(PAIRS * PAIRS)
    for r in counts.filter("not word").collect():  # PAIRS * PAIRS rows
        pairs[r.what] = r.n
    pairs = pairs.reshape(PAIRS, PAIRS) + 1
    top = counts.filter("word").orderBy(F.desc("n"), "what").limit(WORDS).toArrow().column("what").to_numpy()
    return Corpus(-np.log2(pairs / pairs.sum(axis=1, keepdims=True)), np.sort(top.view(U64)))


def candidates(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, plain: bool = False) -> list[tuple[int, int, int]]:
    """(text, first byte, end byte) of every candidate, in order and disjoint, bytes counted from ``data``'s start."""
    key = _KEY[data]
    if len(key):  # a name's '=' before a value ends a run, a value's own last ones do not
        names = (data[:-1] == ord("=")) & key[1:] & (data[1:] != ord("="))
        names[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))] - 1] = False
        key[:-1] &= ~names
    first, last = key.copy(), key.copy()
    if len(key):
        first[1:] &= ~key[:-1]
        last[:-1] &= ~key[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[edge] = key[edge]
    last[edge - 1] = key[edge - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = e - s >= least
    s, e = s[long], e[long]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    held = (digits[e] > digits[s]) | plain
    raw = data.tobytes()
    held[[i for i in np.flatnonzero(~held) if _PREFIX.match(raw, s[i])]] = True
    runs = list(zip((np.searchsorted(offsets, s[held], side="right") - 1).tolist(), s[held].tolist(), e[held].tolist(), strict=True))
    whole: list[tuple[int, int, int]] = []
    if b"-----BEGIN " in raw or b"eyJ" in raw:
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            text = raw[a:b]
            keys = [(i, a + m.start(), a + m.end()) for m in _PEM.finditer(text)] if b"-----BEGIN " in text else []
            signed = [(i, a + m.start(), a + m.end()) for m in _JWT.finditer(text)] if b"eyJ" in text else []
            whole += keys + _outside(signed, keys)
    whole.sort()
    named, at = [], 0
    for hit in _named_places(LOWER[data].tobytes()):
        m = _ASSIGNED.match(raw, hit) if hit >= at else None
        if not m:
            continue
        i = int(np.searchsorted(offsets, m.start(), side="right")) - 1
        a, at = m.start(1), min(m.end(1), int(offsets[i + 1]))  # texts stand side by side: a value ends with its text
        b = a + len(raw[a:at].rstrip(b".:"))
        if b - a >= SHORT and (plain or _TELLING.search(raw, a, b)):
            named.append((i, a, b))
    named = _outside(named, whole)
    return sorted(_outside(_outside(runs, named), whole) + named + whole)


def _named_places(lowered: bytes) -> list[int]:
    """Where one of the names in ``_ASSIGNED`` begins; plain searches, much faster than the pattern."""
    out = []
    for name in (b"token", b"secret", b"password", b"passwd", b"pwd", b"passphrase", b"apikey", b"api_key", b"accesskey", b"access_key", b"credential", b"signature"):
        at = lowered.find(name)
        while at >= 0:
            out.append(at)
            at = lowered.find(name, at + 1)
    return sorted(out)


def _outside(spans: list[tuple[int, int, int]], whole: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that meet none of ``whole``, which is sorted and disjoint."""
    ends = [e for _, _, e in whole]
    out = []
    for span in spans:
        j = bisect_right(ends, span[1])
        if j == len(whole) or whole[j][1] >= span[2]:
            out.append(span)
    return out


def _parts(name: bytes) -> list[str]:
    """A name, and the words it is made of: ``db_password``, ``accessToken``."""
    text = name.decode()
    return [text.lower().strip("_"), *(w.lower() for w in _PART.findall(text))]


def figures(data: np.ndarray, offsets: np.ndarray, spans: list[tuple[int, int, int]], sources: list[str], corpus: Corpus) -> np.ndarray:
    """The forest's input for candidates of some texts, a row each."""
    x = np.zeros((len(spans), len(NAMES)), np.float32)
    if not spans:
        return x
    text, s, e = np.array(spans, np.int64).T
    n = e - s
    value = np.concatenate([data[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)])
    at = np.concatenate([[0], np.cumsum(n)])
    of = np.repeat(np.arange(len(spans)), n)
    kind = _KIND[value]
    pair = of[1:] == of[:-1]  # neighbours of one candidate
    share = lambda flags: np.bincount(of, flags, len(spans)) / n
    pairs = lambda flags: np.bincount(of[1:], flags & pair, len(spans))
    x[:, 0], x[:, 1] = n, np.log(n)
    for j, k in enumerate((1, 2, 3, 0), 2):
        x[:, j] = share(kind == k)
    x[:, 6], x[:, 7] = share(_HEX[value]) == 1, share(kind == 3) == 1
    cells, count = np.unique(of * 256 + value, return_counts=True)
    p = count / n[cells // 256]
    x[:, 8] = -np.bincount(cells // 256, p * np.log2(p), len(spans))
    x[:, 9] = corpus.surprises(value, at)
    x[:, 10] = pairs(kind[1:] != kind[:-1]) / np.maximum(1, n - 1)
    x[:, 11] = pairs(_VOWEL[value[1:]] != _VOWEL[value[:-1]]) / n
    x[:, 12] = pairs(value[1:] == value[:-1]) / n
    begin = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | ~pair]))
    run = np.diff(np.append(begin, len(value)))
    x[:, 13] = np.maximum.reduceat(run, np.searchsorted(begin, at[:-1]))
    x[:, 14] = corpus.coverage(value, at)
    x[:, 17] = np.bincount(of, value == ord("/"), len(spans))
    raw, last, path = data.tobytes(), -1, [0, 0]
    for row, (i, a, b) in zip(x, spans, strict=True):
        if i != last:
            last, source = i, sources[i].lower()
            path = [any(w in source for w in ("test", "example", "fixture", "sample")), source.endswith((".py", ".js", ".java", ".env", ".yml", ".json", ".cfg", ".ini"))]
        before, after = raw[max(int(offsets[i]), a - CONTEXT) : a], raw[b : min(b + 1, int(offsets[i + 1]))]
        row[15], row[16] = _PREFIX.match(raw, a, b) is not None, raw.startswith(b"-----BEGIN", a, b)
        row[18:] = [b"://" in before[-40:] or b"www." in before[-40:], *path, *_beside(before, after)]
    return x


def _beside(before: bytes, after: bytes) -> list[bool]:
    """Figures of the words and marks around a value."""
    tail = before.rstrip(b" \"'`")
    near = [_parts(w) for w in _WORD.findall(_ENDS.split(tail.rstrip())[-1])][-4:]  # of the same field
    named = [any(p in KEY_WORDS for p in w) for w in near]
    harmless = [w[0] in HARMLESS or w[-1] in HARMLESS for w in near]
    return [
        bool(named) and named[-1], any(named), bool(harmless) and harmless[-1], any(harmless), tail.rstrip().endswith((b"=", b":", b"=>")),
        before[-1:] in (b'"', b"'", b"`") and after in (b'"', b"'", b"`"), after in (b" ", b"\n", b""), _BEARER.search(before) is not None,
    ]


def _kind(x: np.ndarray) -> str:
    if x[_AT["pem"]]:
        return "private_key"
    if x[_AT["prefix"]]:
        return "known_prefix"
    if x[_AT["digits_only"]]:
        return "digits"
    return "hex" if x[_AT["hex_only"]] else "text"


Block = tuple[np.ndarray, np.ndarray, int, list[tuple[int, int, int]], np.ndarray]


def _examine(column: pa.Array, sources: pa.Array | None, corpus: Corpus, least: int, plain: bool) -> Iterator[Block]:
    """A block's bytes and offsets, its first row, its candidates and their figures."""
    data, offsets = arrow_bytes(column)
    paths = [x or "" for x in sources.to_pylist()] if sources is not None else [""] * len(column)
    for a, b in slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        spans = candidates(part, at, least, plain)
        if spans:
            yield part, at, a, spans, figures(part, at, spans, paths[a:b], corpus)


def find(docs: DataFrame, corpus: Corpus, least: int = LEAST, plain: bool = False) -> DataFrame:
    """Every candidate with its figures."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(corpus)  # WORDS hashes and a table of pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.string()] * 2
        for batch in batches:
            for data, offsets, first, spans, x in _examine(batch.column(1), batch.column(2), shared.value, least, plain):
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                text, s, e = np.array(spans, np.int64).T
                start = chars[offsets[text]]
                prints = [hashlib.sha256(data[a:b].tobytes()).hexdigest()[:16] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(first + text)), chars[s] - start, chars[e] - start, [_kind(row) for row in x], prints]
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)), flat], [c.split()[0] for c in FOUND.split(", ")])

    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), "text", source.alias("source")).mapInArrow(trimmed(run), FOUND)


def train(found: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on at most ``sample`` labelled findings, half of each class: a bounded table."""
    at = ["doc_id", "start", "end"]
    one = found.groupBy(*at).agg(F.min("x").alias("x"))  # repeated rows are one finding
    truth = labels.filter("secret is not null").groupBy(*at).agg((F.avg(F.col("secret").cast("int")) >= 0.5).alias("secret"))
    known = one.join(truth, at)
    order = [F.xxhash64("doc_id", "start"), "doc_id", "start"]
    rows = []
    for flag in (True, False):
        rows += known.filter(F.col("secret") == flag).orderBy(*order).limit(sample // 2).select("x").collect()
        if flag:
            positive = len(rows)
    x = np.array([r.x for r in rows], np.float32).reshape(-1, len(NAMES))
    return fit(x, (np.arange(len(rows)) < positive).astype(np.float64))


def score(found: DataFrame, model: Forest) -> DataFrame:
    """Findings with the forest's score in place of their figures."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in found.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), np.float32).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(shared.value.score(x))], names=[*keep, "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "x")
    return found.mapInArrow(trimmed(run), f"{schema}, score double")


def snippets(docs: DataFrame, n: int = SNIPPETS, size: int = 400) -> list[str]:
    """A bounded sample of passages, by hash: where made-up findings are planted. Other rows are scored all the same."""
    hashed = docs.filter("text is not null").select(F.xxhash64("text").alias("key"), "text")
    keys = [r.key for r in hashed.select("key").distinct().orderBy("key").limit(n).collect()]  # copies are one
    at = F.pmod("key", F.greatest(F.char_length("text") - size, F.lit(1))) + 1
    some = hashed.filter(F.col("key").isin(keys)).groupBy("key").agg(F.min(F.col("text").substr(at.cast("int"), F.lit(size))).alias("text"))
    return [r.text for r in some.orderBy("key").collect()] if keys else []


def planted_forest(passages: list[str], corpus: Corpus, least: int = LEAST, plain: bool = False, n: int = PLANTED) -> Forest:
    """Fit on made-up findings set into passages, half of them secrets."""
    made = plant(passages, n, plain=plain)
    texts = pa.array([m.text for m in made])
    at = {i: (m.start, m.end) for i, m in enumerate(made)}
    x, y = [], []
    for data, offsets, first, spans, figs in _examine(texts, pa.array([m.source for m in made]), corpus, least, plain):
        for (i, s, e), row in zip(spans, figs, strict=True):
            if (s - int(offsets[i]), e - int(offsets[i])) == at[first + i]:
                x.append(row)
                y.append(float(made[first + i].secret))
    return fit(np.array(x, np.float32).reshape(-1, len(NAMES)), np.array(y))


def model_for(docs: DataFrame, labels: DataFrame | None = None, least: int = LEAST, plain: bool = False) -> tuple[Forest, Corpus]:
    """A forest and what is usual in the corpus; trained on planted findings unless labels are given."""
    corpus = corpus_of(docs)
    if labels is None:
        return planted_forest(snippets(docs), corpus, least, plain), corpus
    return train(find(docs, corpus, least, plain), labels), corpus


def scan(docs: DataFrame, labels: DataFrame | None = None, cut: float = CUT, least: int = LEAST, plain: bool = False) -> DataFrame:
    """Every candidate with its score and verdict."""
    model, corpus = model_for(docs, labels, least, plain)
    return score(find(docs, corpus, least, plain), model).withColumn("secret", F.col("score") >= cut)


def redact(docs: DataFrame, labels: DataFrame | None = None, cut: float = CUT, least: int = LEAST, plain: bool = False) -> DataFrame:
    """All rows and columns of ``docs``, secrets in ``text`` replaced and ``n_chars`` counted anew."""
    shared = docs.sparkSession.sparkContext.broadcast(model_for(docs, labels, least, plain))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, usual = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            cleaned: dict[int, str] = {}
            for data, offsets, first, spans, x in _examine(batch.column(at), batch.column("source") if "source" in names else None, usual, least, plain):
                raw, pieces, done = data.tobytes(), {}, {}
                for (i, s, e), bad in zip(spans, forest.score(x) >= cut, strict=True):  # in order of place
                    if bad:
                        pieces.setdefault(i, []).append(raw[done.get(i, int(offsets[i])) : s] + MASK.encode())
                        done[i] = e
                for i, parts in pieces.items():
                    cleaned[first + i] = (b"".join(parts) + raw[done[i] : int(offsets[i + 1])]).decode()
            if cleaned:
                columns = {"text": cleaned} | ({"n_chars": {i: len(t) for i, t in cleaned.items()}} if "n_chars" in names else {})
                for name, new in columns.items():
                    j = batch.schema.get_field_index(name)
                    values = batch.column(j).to_pylist()
                    for i, v in new.items():
                        values[i] = v
                    batch = batch.set_column(j, batch.schema.field(j), pa.array(values, batch.schema.field(j).type))
            yield batch

    return docs.mapInArrow(trimmed(run), docs.schema)
