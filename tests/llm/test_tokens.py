"""Token ids of whole texts, word by word, against the library's."""

import random

import numpy as np
import pytest

from tideline.llm import tokens
from tideline.llm.inputs import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.WordTokenizer(tokenizer_path())


def test_odd_texts_have_the_ids_of_the_library(tokenizer):
    assert tokenizer.merges is not None
    rng = random.Random(1)
    parts = [*"abcXYZ  \t\n012'.,!?-_<|>éÉßÀ×÷ÿñ€漢字İΣσ́ \x1c %&#*()ªµ", "<|endoftext|>", "'s", "'re", " the ", "x" * 300]
    for _ in range(1500):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        ids, n = tokenizer.encode([t.encode() for t in texts], 2)
        want = [[*tokenizer.encode_whole(t).tolist(), 2] for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_a_full_word_table_begins_anew(tokenizer):
    small = tokens.WordTokenizer(tokenizer_path(), limit=5)
    for text in ("one two three four five six", "seven one", "two eight nine"):
        ids, n = small.encode([text.encode(), b""])
        assert ids.tolist() == tokenizer.encode_whole(text).tolist() and n.tolist() == [len(ids), 0]


def test_merging_takes_the_leftmost_pair_of_least_rank():
    names = tokens.byte_names()
    vocab = {n: i for i, n in enumerate(names)} | {n + "$": 256 + i for i, n in enumerate(names)}
    for t in ("ab", "abab", "ba$", "abc$"):
        vocab[t] = len(vocab)
    m = tokens.Merges({"vocab": vocab, "end_of_word_suffix": "$", "merges": ["a b", "ab ab", "b a$", "ab c$"]})
    for word, want in ((b"ababa", ["abab", "a$"]), (b"aba", ["ab", "a$"]), (b"bba", ["b", "ba$"]), (b"abc", ["abc$"]), (b"ababab", ["abab", "a", "b$"])):
        ids, n = m.join(np.frombuffer(word, np.uint8), np.array([0]))
        assert ids.tolist() == [vocab[t] for t in want] and n.tolist() == [len(want)]
