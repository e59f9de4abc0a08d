import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.llm import media


def test_round_trip_of_odd_rows(documents, odd_rows):
    got = media.read(media.store(documents(odd_rows))).collect()
    want = []
    for _, t in odd_rows:
        b = (t or "").encode()
        want.append((len(b), b + b" " * (-len(b) % 192 if b else 192)))
    assert sorted((r.n_bytes, bytes(r.payload)) for r in got) == sorted(want)
    assert len({(bytes(r.media), r.feature) for r in got if r.doc_id == 6}) == 1
    assert media.read(media.store(documents([]))).count() == 0
    row = next(r for r in got if r.doc_id == 4)
    assert hashlib.sha256(bytes(row.payload)).hexdigest() and zlib.crc32(bytes(row.payload)[-16:]) == zlib.crc32(b" " * 16)


def test_any_samples_survive():
    rng = np.random.default_rng(1)
    for samples in (rng.integers(0, 256, (50, media.UNIT)), np.tile([0, 255], (3, 96)), np.full((2, 192), 255)):
        flat = samples.astype(np.uint8)
        avi = media.write_avis(flat.ravel(), np.array([len(flat)]))[0]
        video = media.parse_avi(avi)
        back = media.decode_frames(np.frombuffer(avi, np.uint8), video.starts, video.sizes)
        assert (np.array(back) == flat).all() and len(video.starts) == len(flat)
        cut = avi.index(b"idx1")
        plain = avi[:cut]
        assert (media.parse_avi(plain).starts == video.starts).all()


def test_broken_bytes_have_no_video(spark):
    good = media.write_avis(np.full(192 * 3, 65, np.uint8), np.array([3]))[0]
    harmed = bytearray(good)
    harmed[media.parse_avi(good).starts[1]] ^= 0xFF
    rows = [(1, good), (2, b""), (3, None), (4, b"RIFF"), (5, bytes(harmed)), (6, good[:-60])]
    frame = spark.createDataFrame(rows, "doc_id long, media binary")
    got = {r.doc_id: r for r in media.read(frame).collect()}
    assert got[1].payload is not None and all(got[i].payload is None and got[i].feature is None for i in (2, 3, 4, 5, 6))
    assert [r.doc_id for r in media.clips(frame).collect()] == [1]
    with pytest.raises(ValueError):
        media.read(frame.withColumn("feature", F.lit(1)))


def test_shots_are_found(spark):
    rng = np.random.default_rng(4)
    scenes = [(20, 60), (200, 40), (90, 30)]
    frames = np.concatenate([np.clip(rng.normal(level, 5, (n, 192)), 0, 255).astype(np.uint8) for level, n in scenes])
    avi = media.write_avis(frames.ravel(), np.array([len(frames)]))[0]
    clips = sorted(media.clips(spark.createDataFrame([(1, avi)], "doc_id long, media binary")).collect(), key=lambda r: r.clip)
    assert [(c.first_frame, c.n_frames, c.start_ms) for c in clips] == [(0, 60, 0), (60, 40, 2400), (100, 30, 4000)]
    assert clips[-1].end_ms == 130 * 40


def baseline_jpeg(planes, quantise, restart=0, tables=True):
    """A baseline frame of planes (h, w) at full size, the second and third of them halved."""
    from tablemill.llm import baseline

    h, w = planes[0].shape
    parts = [(1, 2, 2, 0, 0)] + [(i, 1, 1, 0, 1) for i in range(2, len(planes) + 1)] if len(planes) > 1 else [(1, 1, 1, 0, 0)]
    unit = 16 if len(planes) > 1 else 8
    coded = {}
    for kind, counts in ((0, baseline.DC_COUNTS), (1, baseline.AC_COUNTS)):
        for t in (0, 1):
            code, at, own = 0, 0, {}
            for bits, n in enumerate(counts[t], 1):
                for value in baseline.standard_symbols(kind, t)[at : at + n]:
                    own[value] = format(code, f"0{bits}b")
                    code += 1
                at += n
                code <<= 1
            coded[kind, t] = own

    def extra(v, size):
        return format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    grids = []
    for plane, (_, ph, pv, _, _) in zip(planes, parts):
        small = plane if ph == 2 or len(planes) == 1 else plane[::2, ::2]
        rows, columns = -(-h // unit) * 8 * pv, -(-w // unit) * 8 * ph
        grids.append(np.pad(small.astype(float), ((0, rows - small.shape[0]), (0, columns - small.shape[1])), mode="edge") - 128)
    out, bits, before, count = b"", "", [0] * len(parts), 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for my in range(-(-h // unit)):
        for mx in range(-(-w // unit)):
            if restart and count and count % restart == 0:
                out, bits, before = out + flush(bits) + bytes([0xFF, 0xD0 + (count // restart - 1) % 8]), "", [0] * len(parts)
            count += 1
            for p, (_, ph, pv, _, t) in enumerate(parts):
                for by in range(pv):
                    for bx in range(ph):
                        y, x = (my * pv + by) * 8, (mx * ph + bx) * 8
                        spectrum = baseline.COSINE @ grids[p][y : y + 8, x : x + 8] @ baseline.COSINE.T
                        z = np.rint(spectrum.ravel()[baseline.ZIGZAG] / quantise).astype(int).tolist()
                        d, before[p] = z[0] - before[p], z[0]
                        size = abs(d).bit_length()
                        bits += coded[0, t][size] + extra(d, size)
                        run = 0
                        for k in range(1, 64):
                            if not any(z[k:]):
                                bits += coded[1, t][0]
                                break
                            if z[k] == 0:
                                run += 1
                                if run == 16:
                                    bits, run = bits + coded[1, t][0xF0], 0
                                continue
                            size = abs(z[k]).bit_length()
                            bits, run = bits + coded[1, t][run << 4 | size] + extra(z[k], size), 0
    head = b"\xff\xd8\xff\xdb" + (67).to_bytes(2, "big") + b"\x00" + bytes(int(q) for q in quantise)
    if tables:
        for (kind, t), _ in coded.items():
            counts = (baseline.DC_COUNTS, baseline.AC_COUNTS)[kind][t]
            symbols = baseline.standard_symbols(kind, t)
            head += b"\xff\xc4" + (19 + len(symbols)).to_bytes(2, "big") + bytes([kind << 4 | t, *counts]) + symbols
    head += b"\xff\xc0" + (8 + 3 * len(parts)).to_bytes(2, "big") + b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([len(parts)])
    head += b"".join(bytes([c, ph << 4 | pv, q]) for c, ph, pv, q, _ in parts)
    if restart:
        head += b"\xff\xdd\x00\x04" + restart.to_bytes(2, "big")
    head += b"\xff\xda" + (6 + 2 * len(parts)).to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([c, t << 4 | t]) for c, _, _, _, t in parts) + b"\x00\x3f\x00"
    return head + out + flush(bits) + b"\xff\xd9"


@pytest.mark.parametrize(("colours", "restart", "tables"), [(1, 0, True), (1, 3, False), (3, 0, False), (3, 2, True)])
def test_baseline_frames(colours, restart, tables):
    from tablemill.llm import baseline

    rng = np.random.default_rng(7)
    y, x = np.mgrid[0:37, 0:52]
    planes = [np.clip(110 + 60 * np.sin(x / (5 + i)) + 40 * np.cos(y / 4) + rng.normal(0, 8, x.shape), 0, 255).astype(np.uint8) for i in range(colours)]
    frame = baseline_jpeg(planes, np.ones(64), restart, tables)
    assert media.is_baseline(frame)
    got = baseline.luma(frame)
    assert got.shape == (37, 52) and np.abs(got.astype(int) - planes[0]).max() <= 2
    coarse = baseline.luma(baseline_jpeg(planes, np.full(64, 24), restart, tables))
    assert 2 < np.abs(coarse.astype(int) - planes[0]).max() < 60
    with pytest.raises(baseline.BaselineError):
        baseline.luma(frame[: len(frame) * 2 // 3])


def test_an_ordinary_motion_jpeg_has_clips(spark):
    frames = [baseline_jpeg([np.full((16, 24), level, np.uint8)], np.full(64, 3)) for level in (20,) * 6 + (200,) * 5]
    movi = b"".join(b"00dc" + len(f).to_bytes(4, "little") + f + b"\x00" * (len(f) % 2) for f in frames)
    avih = b"avih" + (56).to_bytes(4, "little") + (40_000).to_bytes(4, "little") + bytes(52)
    hdrl = b"LIST" + (4 + len(avih)).to_bytes(4, "little") + b"hdrl" + avih
    body = b"AVI " + hdrl + b"LIST" + (4 + len(movi)).to_bytes(4, "little") + b"movi" + movi
    avi = b"RIFF" + len(body).to_bytes(4, "little") + body
    table = spark.createDataFrame([(1, avi), (2, avi[:200])], "doc_id long, media binary")
    clips = sorted(media.clips(table).collect(), key=lambda r: r.clip)
    assert [(c.doc_id, c.first_frame, c.n_frames, c.start_ms, c.end_ms, c["mean"]) for c in clips] == [(1, 0, 6, 0, 240, 20.0), (1, 6, 5, 240, 440, 200.0)]
    back = {r.doc_id: r for r in media.read(table).collect()}
    assert len(back[1].payload) == 11 * 16 * 24 and back[1].feature.startswith("11 frames, 2 clips, ") and back[2].payload is None
