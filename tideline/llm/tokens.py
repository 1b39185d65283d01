"""Token ids of texts by a public tokenizer, a word at a time where that is exact."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from .textblock import SPACE

PROBE = "The  probe's text,\tÉtat 12 naïve-test... (x)\n\nGrüße <|end|> über #tags a.b 3.14 l'eau ÀÖÞ×ß÷ÿ !?,. aaaa1b22c"

# The normaliser and the split pattern that ``Merges`` follows.
NORMALIZERS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

NONE = np.int32(2**31 - 1)
_LETTER, _DIGIT, _MARK, _UNSAFE = 0, 1, 2, 3
#: Kind of a byte where it is not the second of a two-byte letter.
_KIND = np.full(256, _UNSAFE, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x27] = _UNSAFE  # an apostrophe may begin a contraction


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    name = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [name[b] for b in range(256)]


class Merges:
    """Byte-pair merging of many words side by side.

    A step joins, in every piece that still has a known pair, the leftmost pair
    of least rank: what merging the pieces one by one does. Only words of ASCII
    and of the letters U+00C0 to U+00FF are taken; others are told by ``safe``.
    """

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        names = byte_names()
        self.inside = np.array([vocab[n] for n in names], np.int32)
        self.last = np.array([vocab[n + suffix] for n in names], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([(vocab[a] << 16) | vocab[b] for a, b in pairs], np.int64)
        self.bits = max(8, int(len(keys) * 8).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.key[slot] not in (-1, key):
                slot = (slot + 1) & ((1 << self.bits) - 1)
            if self.key[slot] == -1:
                self.key[slot], self.rank[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; NONE if they are never joined."""
        key = (a.astype(np.int64) << 16) | b
        slot = self._slots(key)
        out = self.rank[slot]
        miss = np.flatnonzero((self.key[slot] != key) & (self.key[slot] != -1))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & ((1 << self.bits) - 1)
            found = self.key[slot[miss]]
            out[miss] = self.rank[slot[miss]]
            miss = miss[(found != key[miss]) & (found != -1)]
        return out

    def pieces(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lowered bytes, where pieces begin, and which words (bytes first[i]:first[i + 1]) are safe."""
        data = data.copy()
        kind = _KIND[data]
        lead = data == 0xC3
        second = np.zeros(len(data), bool)
        second[1:] = lead[:-1] & (data[1:] & 0xC0 == 0x80)
        letter = second & (data != 0x97) & (data != 0xB7)
        mark = second & ~letter
        for where, what in ((letter, _LETTER), (mark, _MARK)):
            kind[where] = what
            kind[np.flatnonzero(where) - 1] = what
        data[letter & (data < 0x9F)] += 0x20
        data[(kind == _LETTER) & (data < 0x5B)] += 0x20
        edge = np.ones(len(data), bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        edge[first[:-1]] = True
        bad = np.concatenate([[0], np.cumsum(kind == _UNSAFE)])
        return data, np.flatnonzero(edge), bad[first[1:]] == bad[first[:-1]]

    def join(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has; a piece is the bytes from one start to the next."""
        n = np.diff(np.append(start, len(data)))
        symbol = self.inside[data]
        symbol[start + n - 1] = self.last[data[start + n - 1]]
        rank = np.full(len(data), NONE)
        rank[:-1] = self.ranks(symbol[:-1], symbol[1:])
        rank[start + n - 1] = NONE
        piece = np.arange(len(start))
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(piece):
            best = np.minimum.reduceat(rank, start)
            live = best != NONE
            if not live.all():
                stay = np.repeat(live, n)
                ended.append((piece[~live], n[~live], symbol[~stay]))
                symbol, rank, piece, n, best = symbol[stay], rank[stay], piece[live], n[live], best[live]
                start = np.cumsum(n) - n
                if not len(piece):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, n))
            at = hit[np.searchsorted(hit, start)]  # leftmost in each piece
            symbol[at] = self.merged[best]
            end = start + n
            rank[at] = NONE
            more = at[at + 2 < end]
            rank[more] = self.ranks(symbol[more], symbol[more + 2])
            back = at[at > start]
            rank[back - 1] = self.ranks(symbol[back - 1], symbol[back])
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            symbol, rank, n = symbol[stay], rank[stay], n - 1
            start = np.cumsum(n) - n
        count = np.zeros(sum(len(p) for p, _, _ in ended), np.int64)
        for p, k, _ in ended:
            count[p] = k
        first = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.uint32)
        for p, k, s in ended:
            out[np.repeat(first[p] - (np.cumsum(k) - k), k) + np.arange(len(s))] = s
        return out, count


class _Index(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class WordTokenizer:
    """Encodes each distinct word once and joins the ids.

    Exact only for tokenizers whose ids for a text are those of its words in a
    row; the constructor tries that on a probe and otherwise every text is
    encoded whole. Words of a byte-level vocabulary with the fixed pattern above
    are merged side by side, any other word by the library. ``limit`` bounds the
    words remembered in a worker process, ``limit_ids`` their ids.
    """

    def __init__(self, path: str, limit: int = 400_000, limit_ids: int = 8_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.limit_ids = limit, limit_ids
        whole = self.encode_whole(PROBE)
        parts = [self.encode_whole(w) for w in PROBE.split()]
        lowered = [self.encode_whole(w.lower()) for w in PROBE.split()]
        self.wordwise = list(whole) == [i for p in parts for i in p] == [i for p in lowered for i in p]
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = self._merges(json.loads(self.tokenizer.to_str())) if self.wordwise else None
        self._reset()

    @staticmethod
    def _merges(spec: dict) -> Merges | None:
        """Side-by-side merging, where the tokenizer is of the kind that it follows."""
        model, normal, split = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in normal.get("normalizers", [])]
        cuts = split.get("pretokenizers", [])
        same = steps == NORMALIZERS and len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": PATTERN} and cuts[0].get("invert") and cuts[1]["type"] == "ByteLevel"
        same = same and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and len(model["vocab"]) <= 1 << 16
        plain = model["type"] == "BPE" and model["end_of_word_suffix"] and not (model["dropout"] or model["continuing_subword_prefix"] or model.get("ignore_merges"))
        return Merges(model) if same and plain else None

    def _reset(self) -> None:
        self.index = _Index()
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _by_library(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)] if texts else []
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has."""
        if not words or self.merges is None:
            return self._by_library(words)
        first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        joined = b"".join(words)
        data, start, safe = self.merges.pieces(np.frombuffer(joined, np.uint8), first)
        safe &= np.diff(first) < 200  # one merge a step: long words would take many
        if any(t in joined.lower() for t in self.special):
            safe &= np.array([not any(t in w.lower() for t in self.special) for w in words])
        other = [words[i] for i in np.flatnonzero(~safe)]
        word = np.searchsorted(first, start, side="right") - 1
        keep = np.repeat(safe, np.diff(first))
        place = np.cumsum(keep) - keep  # of each byte among the bytes kept
        ids, n = self.merges.join(data[keep], place[start[safe[word]]]) if keep.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        length = np.zeros(len(words), np.int64)
        np.add.at(length, word[safe[word]], n)
        if not other:
            return ids, length
        more, n = self._by_library(other)
        length[~safe] = n
        at = np.repeat(safe, length)
        out = np.zeros(len(at), np.uint32)
        out[at], out[~at] = ids, more
        return out, length

    def _learn(self, new: list[bytes]) -> None:
        flat, starts, lengths, at = [self.flat], [self.start], [self.length], len(self.flat)
        for i in range(0, len(new), 20_000):
            ids, n = self._ids(new[i : i + 20_000])
            flat.append(ids)
            starts.append(at + np.cumsum(n) - n)
            lengths.append(n)
            at += len(ids)
        self.flat, self.start, self.length = np.concatenate(flat), np.concatenate(starts), np.concatenate(lengths)

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (UTF-8 bytes) in a row, each with ``end`` behind it, and how many each has."""
        tail = [] if end is None else [end]
        if not self.wordwise:
            found = [np.append(self.encode_whole(t.decode()), np.array(tail, np.uint32)) for t in texts]
            return np.concatenate([np.zeros(0, np.uint32), *found]).astype(np.uint32), np.array([len(x) for x in found], np.int64)
        if len(self.index) > self.limit or len(self.flat) > self.limit_ids:
            self._reset()
        number = self.index.__getitem__
        known = len(self.index)
        words: list[int] = []
        bound = [0]
        for t in texts:
            low = t.lower()
            if any(s in low for s in self.special):
                words.append(number(t.strip(bytes(np.flatnonzero(SPACE).tolist()))))  # the text as one word
            else:
                words.extend(map(number, low.split()))
            bound.append(len(words))
        if len(self.index) > known:
            self._learn(list(self.index)[known:])
        w = np.array(words, np.int64)
        n = self.length[w]
        step = np.cumsum(n) - n
        ids = self.flat[np.repeat(self.start[w] - step, n) + np.arange(int(n.sum()))]
        total = np.concatenate([[0], np.cumsum(n)])
        cut = total[bound]
        if end is not None:
            ids = np.insert(ids, cut[1:], np.uint32(end))
        return ids, np.diff(cut) + len(tail)


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
