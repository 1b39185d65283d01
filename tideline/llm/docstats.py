"""Statistics of whole texts, for models of their quality."""

from __future__ import annotations

import numpy as np

from .textblock import Words

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&|<>", "stop": b".?!", "bang": b"!",
    "pause": b",;:", "quote": b"\"'()[]{}", "space": b" \t\v\f\r", "line": b"\n", "wide": range(128, 256), "equal": b"=_/@+\\~^",
}
NAMES = [
    *(f"{n}_share" for n in _CLASSES), "log_bytes", "log_words", "mean_word", "long_word", "longest_word", "short_words", "distinct_words",
    "top_word", "repeated_pairs", "words_a_line", "lines", "same_lines", "short_lines", "stops_a_line", "capital_words",
]
_TABLE = np.zeros((256, len(_CLASSES)), np.float32)
for _j, _bytes in enumerate(_CLASSES.values()):
    _TABLE[list(_bytes), _j] = 1


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def doc_stats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of len(NAMES) figures a text; zeros for an empty one."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    size = np.diff(offsets).astype(np.float64)
    count = words.counts().astype(np.float64)
    some, any_word = np.maximum(size, 1), np.maximum(count, 1)
    out = np.zeros((n, len(NAMES)), np.float32)
    kinds = len(_CLASSES)
    for i in range(n):
        if size[i]:
            out[i, :kinds] = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256).astype(np.float32) @ _TABLE
    lines = out[:, list(_CLASSES).index("line")] + 1
    stops = out[:, list(_CLASSES).index("stop")].copy()
    out[:, :kinds] /= some[:, None]
    length = (words.end - words.start).astype(np.float64)
    capital = (data[words.start] >= 65) & (data[words.start] <= 90) if len(words.start) else np.zeros(0, bool)
    col = dict(zip(NAMES, range(len(NAMES)), strict=True))
    out[:, col["log_bytes"]] = np.log1p(size)
    out[:, col["log_words"]] = np.log1p(count)
    out[:, col["mean_word"]] = _per_text(length, words.first) / any_word
    out[:, col["long_word"]] = _per_text(length > 15, words.first) / any_word
    out[:, col["short_words"]] = _per_text(length <= 3, words.first) / any_word
    out[:, col["capital_words"]] = _per_text(capital, words.first) / any_word
    out[:, col["words_a_line"]] = count / lines
    out[:, col["lines"]] = np.log1p(lines)
    out[:, col["stops_a_line"]] = stops / lines
    for i in range(n):
        a, b = words.first[i], words.first[i + 1]
        if b == a:
            continue
        h = np.sort(words.hash[a:b])
        runs = np.diff(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])))
        out[i, col["distinct_words"]] = len(runs) / (b - a)
        out[i, col["top_word"]] = runs.max() / (b - a)
        out[i, col["longest_word"]] = np.log1p(length[a:b].max())
        if b - a > 1:
            pairs = np.sort(words.hash[a : b - 1] * np.uint64(3) + words.hash[a + 1 : b])
            out[i, col["repeated_pairs"]] = (pairs[1:] == pairs[:-1]).mean() if len(pairs) > 1 else 0
        text = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
        held = [x for x in text if x.strip()]
        out[i, col["same_lines"]] = 1 - len(set(held)) / max(1, len(held))
        out[i, col["short_lines"]] = sum(len(x) < 30 for x in held) / max(1, len(held))
    return out
