"""Token counts against the library, on odd texts, fuzzed texts and small bounds."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablemill.llm import transducer
from tablemill.llm.common import text_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return transducer.Counter(f.read())


def same(counter, library, texts):
    got = counter(*text_bytes(texts))
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got.tolist() == want, [t for t, a, b in zip(texts, got, want) if a != b][:3]


PARTS = ["a", "b", "s", "t", "'", "re", "'s", "'LL", " ", "  ", "\n", "\t", "1", "23", "!", "--", "é", "中", "🙂", "\xa0", "　", "<|endoftext|>", "<|endof", "the", "Ⅷ", "̀", "\x00", "Ᲊ"]


@pytest.mark.parametrize("seed", range(3))
def test_fuzzed_texts(counter, library, seed):
    rng = random.Random(seed)
    same(counter, library, ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(1500)])
    same(counter, library, ["".join(rng.choice("abehinostr ") for _ in range(rng.randint(0, 200))) for _ in range(100)])


def test_long_words_and_spaces(counter, library):
    rng = random.Random(5)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40_000))
    same(counter, library, [" " * 70_001 + "x", "a" * 100_000, "ab" * 30_000, "=-" * 30_000, letters, "\n" * 513, *("a" * n for n in range(200))])


def test_ends_of_texts_and_special_strings(counter, library):
    same(counter, library, ["", " ", "a ", " a", "a\n\n", "", "<|endoftext|>", "  <|endoftext|>\n x", "<|endoftext|><|endoftext|>'s", "it'", "it'r", "'re", "<|endof", "text|>", "don't've"])


def test_bounds_change_nothing(counter, library, monkeypatch):
    monkeypatch.setattr(transducer, "KEPT", 50)
    monkeypatch.setattr(transducer, "STRETCH", 300)
    small = transducer.Counter(open(PATH, encoding="utf-8").read())
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(300)) for _ in range(5)]
    same(small, library, [*texts, "a" * 2000, ""])
    assert len(small.states) < len(counter.states) or small.known <= 400


def test_word_machine_by_scan_equals_one_step_at_a_time():
    symbols = np.random.default_rng(3).integers(0, 9, 5000).astype(np.uint8)
    symbols[::700] += 9
    state, want = transducer.FRESH, []
    for s in symbols.tolist():
        want.append(bool(transducer.WORD_MARK[s, state]))
        state = transducer.WORD_TO[s, state]
    for n in (1, 255, 256, 257, 5000):
        assert transducer.word_starts(symbols[:n]).tolist() == want[:n]


def test_table(spark, documents, odd_rows, library):
    got = transducer.count_tokens(documents(odd_rows), PATH, limit=300)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), n(t), n(t) > 300) for i, t in odd_rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert transducer.count_tokens(documents([]), PATH).count() == 0


def test_other_vocabularies_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        transducer.Counter(f.read())
