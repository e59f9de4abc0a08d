import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablemill.llm import chunks, minhash, suffix
from tablemill.llm.common import mix, text_bytes


def prose(rng, n):
    return [rng.choice(["lo", "mi", "ta", "ren", "sol", "ka"]) + rng.choice(["ba", "du", "fen", "gor", "hi"]) + str(rng.randint(0, 99)) for _ in range(n)]


@pytest.fixture
def corpus():
    rng = random.Random(5)
    rows = [(i, " ".join(prose(rng, rng.randint(30, 200)))) for i in range(100, 140)]
    base = prose(rng, 150)
    for i in range(200, 230):  # near copies of one base, some beyond the limit
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(150)] = "other" + str(rng.randint(0, 999))
        rows.append((i, " ".join(words)))
    passage = " ".join(prose(rng, 60))
    rows += [(i, f"{' '.join(prose(rng, 20))} {passage} {' '.join(prose(rng, 20))}") for i in range(300, 306)]
    return rows + [(400, rows[0][1]), (401, rows[0][1]), (402, rows[1][1].upper())]


def classes(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
        if w:
            sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a, shared, b = (mix(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (40, 100, 60))
    elements, rows = np.concatenate([a, shared, shared, b]), np.repeat([0, 1], [140, 160])
    signature = minhash.dart_signatures(elements, rows, 3, 1000)
    assert abs((signature[0] == signature[1]).mean() - 0.5) < 0.05 and (signature[2] == np.uint64(2**64 - 1)).all()
    weights = np.concatenate([np.full(140, 2.5), np.full(160, 1.0)])
    weighted = minhash.dart_signatures(elements, rows, 2, 1000, weights)
    assert abs((weighted[0] == weighted[1]).mean() - 100 / (40 * 2.5 + 100 * 2.5 + 60)) < 0.05


def test_near_duplicates_against_all_pairs(documents, corpus):
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(documents(corpus)).collect()}
    assert got == classes(corpus)


def test_near_duplicates_of_odd_rows(documents, odd_rows):
    got = minhash.near_duplicates(documents(odd_rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd_rows if i is not None)
    assert all(r.class_id == r.doc_id for r in got)
    docs = documents([*odd_rows, (60, "same text here")])
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert minhash.near_duplicates(documents([])).count() == 0


def covered(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    for b in raw:
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s] += 1
                gone[s + length] -= 1
        yield b, np.cumsum(gone)[:-1] > 0


def test_suffix_removal_against_all_strings(documents, corpus, odd_rows):
    odd = [(i, t if i != 7 else t[:3000]) for i, t in odd_rows]
    rows = [*corpus, *odd, (500, "b" * 450), (501, "xy" * 99 + "q"), (502, corpus[3][1][:250] + "!"), (503, "é" * 300)]
    got = Counter(tuple(r) for r in suffix.deduplicate(documents(rows)).collect())
    want = Counter()
    for (i, _), (b, gone) in zip(rows, covered([t for _, t in rows])):
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert got == want
    assert suffix.deduplicate(documents([])).count() == 0


def test_stripped_texts_stay_valid(documents):
    rng = random.Random(8)
    passage = "ß" + " ".join(prose(rng, 50)) + "é"
    rows = [(1, f"🙂{passage}中"), (2, f"ä{passage}文"), (3, None), (4, "short")]
    docs = documents(rows)
    out = {r.doc_id: r.text for r in suffix.strip_repeats(docs).collect()}
    assert suffix.strip_repeats(docs).columns == docs.columns
    assert out == {1: "🙂中", 2: "ä文", 3: None, 4: "short"}


def test_gear_hash_and_ends():
    rng = np.random.default_rng(0)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in (0, 500, 0, 10, 3000, 70, 0)]
    data, offsets = text_bytes(texts)
    together = chunks.chunk_ends(data, offsets).tolist()
    alone = [e + int(offsets[i]) for i, t in enumerate(texts) for e in chunks.chunk_ends(*text_bytes([t])).tolist()]
    assert together == alone and max(np.diff([0, *together])) <= chunks.MOST
    inserted = chunks.chunk_ends(*text_bytes([texts[4][:1000] + "new words" + texts[4][1000:]])).tolist()
    old = set(chunks.chunk_ends(*text_bytes([texts[4]])).tolist())
    assert len({e - 9 for e in inserted if e > 1700} & old) > 0.9 * len([e for e in old if e > 1700])


def test_chunk_dedup_against_a_loop(documents, corpus, odd_rows):
    rows = [*corpus, *odd_rows]
    got = Counter(tuple(r) for r in chunks.deduplicate(documents(rows)).collect())
    seen, done, want = {}, {}, Counter()
    for i, t in sorted(((i, t) for i, t in rows), key=lambda r: (r[0] or 0, r[1] or "")):
        if (i, t) not in done:
            data, offsets = text_bytes([t])
            b, start, runs = (t or "").encode(), 0, []
            for end in chunks.chunk_ends(data, offsets).tolist():
                if b[start:end] in seen:
                    other, at = seen[b[start:end]]
                    if runs and runs[-1][1] == start:
                        runs[-1][1], runs[-1][3] = end, (other, at + end - start)
                    else:
                        runs.append([start, end, (other, at), (other, at + end - start)])
                else:
                    seen[b[start:end]] = b, start
                start = end
            covered = np.zeros(len(b) + 1, bool)
            for lo, hi, (left, x), (right, y) in runs:
                while lo and x and b[lo - 1] == left[x - 1]:
                    lo, x = lo - 1, x - 1
                while hi < len(b) and y < len(right) and b[hi] == right[y]:
                    hi, y = hi + 1, y + 1
                covered[lo:hi] = True
            edges = np.flatnonzero(np.diff(covered, prepend=False)).reshape(-1, 2).tolist()
            runs = [r for r in edges if r[1] - r[0] >= chunks.RUN]
            stay = np.ones(len(b), bool)
            for a, z in runs:
                stay[a:z] = False
            done[(i, t)] = (i, len(b), int((~stay).sum()), len(runs), hashlib.sha256(data[stay].tobytes()).hexdigest())
        want[done[(i, t)]] += 1
    assert got == want
    found, passage = {r[0]: r[2] for r in got}, rows[70][1].split(" ", 20)[20].rsplit(" ", 20)[0]
    assert all(found[i] >= len(passage) for i in range(301, 306)) and found[300] == 0
    assert chunks.deduplicate(documents([])).count() == 0


def test_extension_goes_on_beyond_one_round(documents, monkeypatch):
    monkeypatch.setattr(chunks, "REACH", 2)
    monkeypatch.setattr(chunks, "FAR", 8)
    rng = random.Random(12)
    passage = " ".join(prose(rng, 60))
    rows = [(i, f"{' '.join(prose(rng, 30))}<{passage}>{' '.join(prose(rng, 30))}") for i in range(6)]
    got = {r.doc_id: r for r in chunks.deduplicate(documents(rows)).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == len(passage) + 2 and got[i].n_spans == 1 for i in range(1, 6))


def test_planted_passages_of_fifty_words_go_whole(documents):
    rng = random.Random(13)
    passages = [" ".join(prose(rng, 52)) for _ in range(150)]
    rows = [(j * 1000 + i, f"{' '.join(prose(rng, 40))} {p} {' '.join(prose(rng, 40))}") for j in range(2) for i, p in enumerate(passages)]
    got = {r.doc_id: r.n_removed for r in chunks.deduplicate(documents(rows)).collect()}
    assert not any(got[i] for i in range(150))
    assert sum(got[1000 + i] >= len(p) for i, p in enumerate(passages)) >= 0.9 * 150


def test_gear_hash_is_its_recurrence():
    data = np.random.default_rng(3).integers(0, 256, 500).astype(np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = (2 * h + int(chunks.GEAR[b])) % 2**32
        want.append(h)
    assert chunks.gear_hash(data).tolist() == want


def test_identifiers_name_equal_strings():
    rng = np.random.default_rng(9)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    data[3000:3400] = data[100:500]
    ids = suffix.Identifiers(data, 64, 5)
    for depth in (64, 128, 185, 200, 321):
        at = np.arange(len(data) - depth + 1)
        names = ids(at, depth)
        strings = [data[i : i + depth].tobytes() for i in at]
        assert len(set(zip(names.tolist(), strings))) == len(set(names.tolist())) == len(set(strings))
    assert (ids.all(200)[:50] == suffix.Identifiers(data, 64, 5)(np.arange(50), 200)).all()


def test_heavy_groups_join_like_others(spark):
    from tablemill.llm.common import join_groups

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 700}") for i in range(3000)], "i int, k string").repartition(4)
    groups = rows.groupBy("k").count().where("k <> 'k3'").selectExpr("k", "count as n", "length(k) as size").cache()
    for how in ("inner", "left"):
        got = Counter(map(tuple, join_groups(rows, groups, ["k"], 3000, how).select("i", "k", "size").collect()))
        assert got == Counter(map(tuple, rows.join(groups.drop("n"), "k", how).select("i", "k", "size").collect()))
    assert join_groups(rows.limit(0), groups, ["k"], 0, "left").count() == 0


def test_a_long_text_is_cut_into_windows(documents, monkeypatch):
    monkeypatch.setattr(suffix, "STEP", 1 << 10)
    rng = random.Random(77)
    long = " ".join(prose(rng, 900))
    rows = [(1, long), (2, long[2000:3100] + " ".join(prose(rng, 40))), (3, " ".join(prose(rng, 30)) + long[4090:4400]), (4, "xyz" * 1500)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.deduplicate(documents(rows)).collect()}
    want = {}
    for (i, _), (_, gone) in zip(rows, covered([t for _, t in rows])):
        want[i] = (int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()))
    assert got == want
