import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablemill.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library_on_random_text(library):
    rng = random.Random(1)
    pool = [chr(c) for c in (*range(0x250), *range(0x300, 0x400), 0x1C, 0x85, 0xA0, 0x200B, 0x2028, 0x3000, 0x130, 0x1F600, *range(0x1100, 0x1110), 0xAC00, 0xBD)]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.3 else rng.choice("abcdefgh''stlrevmd 0123 \n<|endoftext|>") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += ["a" * 1001, "!" * 600, "x<|endoftext|>y<|startoftext|>", "'s't're", "İI ΑΣ", "", "the " * 3000]
    codec = bpe.WordBpe(bpe.read_spec(PATH))
    ids, offsets, _ = codec.encode(texts)
    for i, text in enumerate(texts):
        own = ids[offsets[i] : offsets[i + 1]]
        assert own.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert codec.decode(own) == library.decode(own.tolist(), skip_special_tokens=False)


def test_cache_overflow_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 5)
    codec = bpe.WordBpe(bpe.read_spec(PATH))
    for text in ("one two three", "four five six seven eight", "one nine"):
        assert codec.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_decode_of_odd_rows(documents, odd_rows, library):
    got = bpe.encode_decode(documents(odd_rows), PATH).collect()
    assert len(got) == len(odd_rows)
    by_text = {t or "": library.encode(t or "", add_special_tokens=False).ids for _, t in odd_rows}
    assert sorted(map(len, by_text.values())) == sorted({tuple(r.ids): len(r.ids) for r in got}.values()) or all(list(r.ids) in by_text.values() for r in got)
    assert bpe.encode_decode(documents([]), PATH).count() == 0


@pytest.mark.parametrize("window", [8, 16])
def test_best_cuts_against_all_ways(window):
    rng = np.random.default_rng(window)
    for _ in range(30):
        at = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, window // 2, 9))]))
        cost = rng.integers(0, 4, len(at))
        best = {0: 0}
        for j in range(1, len(at)):
            ways = [best[i] + packing.padding(int(at[j] - at[i]), window) + int(cost[j]) for i in range(j) if at[j] - at[i] <= window]
            best[j] = min(ways)
        cuts = packing.best_cuts(at, cost, window).tolist()
        places = [int(np.searchsorted(at, c)) for c in cuts]
        total = sum(packing.padding(b - a, window) for a, b in zip(cuts, cuts[1:])) + sum(int(cost[p]) for p in places[1:])
        assert cuts[0] == 0 and cuts[-1] == at[-1] and max(np.diff(cuts)) <= window and total == best[len(at) - 1]


def test_pieces_hold_each_id_once(documents, odd_rows, library):
    rows = [(i, t) for i, t in odd_rows if i is not None and i != 6]
    pieces = packing.pack(documents(rows), PATH, block_tokens=20_000).collect()
    texts = dict(rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, found in by_doc.items():
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        found.sort(key=lambda p: p.start)
        assert [x for p in found for x in np.frombuffer(p.piece, "<u4").tolist()] == ids
        assert all(p.doc_tokens == len(ids) and zlib.crc32(bytes(p.piece)) == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in found)
    padded = 0
    for found in by_sequence.values():
        found.sort(key=lambda p: p.offset)
        filled = 0
        for p in found:
            assert p.offset == filled
            filled += p.length
        assert filled <= 2048 and all(p.sequence_length == filled for p in found)
        padded += packing.padding(filled, 2048)
    assert set(by_doc) == set(texts) and padded <= 0.01 * sum(p.length for p in pieces)
    assert packing.pack(documents([]), PATH).count() == 0
