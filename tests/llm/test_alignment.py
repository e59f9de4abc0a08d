"""Alignment of two tokenizers against plain loops over tokens."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablemill.llm import alignment
from tablemill.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    letter = {c: b for b, c in enumerate(byte_letters())}
    found, counts = [], Counter()
    for key, text in rows:
        groups, a, b = [], [], []
        if text:
            a = [(i, bytes(letter[c] for c in lib.id_to_token(i))) for i in lib.encode(" " + text, add_special_tokens=False).ids]
            for i in pieces.encode(text):
                p = pieces.id_to_piece(i)
                b.append((i, bytes.fromhex(p[3:5]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
            want = (" " + text).encode()
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a, b = [], []
        spans = []
        for tokens in (a, b):
            at, own = 0, []
            for i, x in tokens:
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        links, i, j = [], 0, 0
        while i < len(spans[0]) and j < len(spans[1]):  # every overlap, by the end that comes first
            (_, end_a, x), (_, end_b, y) = spans[0][i], spans[1][j]
            links.append((x, y))
            i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        left = [list(side) for side in spans]
        for end in ends:
            parts = []
            for side in left:
                n = next((k for k, (_, e, _) in enumerate(side) if e == end)) + 1
                parts.append(",".join(str(t) for _, _, t in side[:n]))
                del side[:n]
            groups.append("|".join(parts))
        counts.update(links)
        found.append((key, len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(k, na, nb, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), d) for k, na, nb, g, ls, d in found]


@pytest.fixture
def rows(odd_rows):
    rng = random.Random(4)
    parts = ["the ", "Word", "ing", "é", "中文", " ", "  ", "\n", "12", "'s", "<|endoftext|>", "<s>", "🙂", "!?"]
    own = [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    own += [(200, "one ▁ two"), (201, " lead"), (202, "tail "), (203, "\x00nul"), (204, " " * 1500 + "x"), (205, "ሀሁ ሂ ᲊ")] + [(300, "same copy of a text")] * 40
    return [(i, t if t is None or len(t) < 3000 else t[:2500]) for i, t in odd_rows] + own


@pytest.mark.parametrize("block, task", [(1 << 20, 1 << 23), (500, 300), (7, 1 << 23)])
def test_against_loops(spark, documents, rows, monkeypatch, block, task):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "TASK", task)
    got = alignment.align(documents(rows).repartition(3), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)


def test_long_text_and_empty_table(spark, documents, odd_rows):
    text = dict(odd_rows)[7]
    [row] = alignment.align(documents([(1, text)]), A, B).collect()
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.n_groups > 10_000
    assert alignment.align(documents([]), A, B).count() == 0
    assert [tuple(r) for r in alignment.align(documents([(1, None)]), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_fast_encoder_equals_the_library():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        enc = alignment.Encoders(f.read(), g.read())
    rng = random.Random(2)
    letters = [chr(c) for c in range(1, 0x600)] + [" ", "\n", "a", "1", "'s", "ᲊ"] * 30
    for _ in range(300):
        text = " " + "".join(rng.choice(letters) for _ in range(60))
        assert enc.a(text).tolist() == enc.library.encode(text, add_special_tokens=False).ids
