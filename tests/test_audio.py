"""WAV by ranges and the properties that heads of files tell, against the standard library and odd bytes."""

import random
import struct
import wave

import pytest

from tablemill.sources import properties, wav


@pytest.fixture(scope="module")
def registered(spark):
    spark.dataSource.register(wav.WavSource)
    return spark


def read(spark, folder, **options):
    rows = spark.read.format("wav").option("path", str(folder)).options(**options).load().collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.path, r.block_id)):
        name = r.path.rsplit("/", 1)[-1]
        first = out.setdefault(name, (r.channels, r.sample_rate, [], []))
        first[2].extend(r.samples)
        first[3].append(r.block_id)
    return out


@pytest.mark.parametrize("options", [{}, {"blockFrames": "7", "rangeBytes": "50"}, {"blockFrames": "100", "rangeBytes": "1000"}])
def test_samples_of_all_widths_by_ranges(registered, tmp_path, options):
    rng = random.Random(1)
    want = {}
    for width, channels in ((1, 1), (2, 2), (3, 1), (4, 3)):
        frames = rng.randint(150, 400)
        values = [rng.randrange(-(1 << 8 * width - 1), 1 << 8 * width - 1) for _ in range(frames * channels)]
        raw = bytes(v + 128 for v in values) if width == 1 else b"".join(v.to_bytes(width, "little", signed=True) for v in values)
        with wave.open(str(tmp_path / f"w{width}.wav"), "wb") as f:
            f.setparams((channels, width, 44100, 0, "NONE", ""))
            f.writeframes(raw)
        want[f"w{width}.wav"] = (channels, [v / (1 << 8 * width - 1) for v in values])
    floats = [0.5, -0.25, 1.5]
    head = struct.pack("<4sI4s4sIHHIIHH", b"RIFF", 0, b"WAVE", b"fmt ", 16, 3, 1, 8000, 32000, 4, 32)
    (tmp_path / "f.WAV").write_bytes(head + b"odd \x03\x00\x00\x00abc\x00" + b"data\x0c\x00\x00\x00" + struct.pack("<3f", *floats))
    want["f.WAV"] = (1, floats)
    got = read(registered, tmp_path, **options)
    assert {n: (c, pytest.approx(v, abs=1e-6)) for n, (c, v) in want.items()} == {n: (c, s) for n, (c, _, s, _) in got.items()}
    assert all(blocks == list(range(len(blocks))) for *_, blocks in got.values())


def test_broken_files_keep_their_prefix(registered, tmp_path):
    head = lambda n: struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 2, 8000, 32000, 4, 16, b"data", n)
    (tmp_path / "cut.wav").write_bytes(head(400) + b"\x00\x40" * 7)  # three whole frames and a half
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "none.wav").write_bytes(head(0))
    (tmp_path / "other.wav").write_bytes(b"RIFX" + head(4)[4:] + b"\x00" * 4)
    (tmp_path / "headless.wav").write_bytes(head(4)[:30])
    (tmp_path / "text.txt").write_bytes(head(4) + b"\x00" * 4)
    assert read(registered, tmp_path) == {"cut.wav": (2, 8000, [0.5] * 6, [0])}
    assert read(registered, tmp_path, blockFrames="2") == {"cut.wav": (2, 8000, [0.5] * 6, [0, 1])}


def test_written_files_are_read_by_others(registered, tmp_path):
    rows = [("a.wav", 1, 8000, 16, b"\x01\x00\xff\xff", None), ("b.wav", 2, 44100, 8, b"", None)]
    registered.createDataFrame(rows, wav.FILES).write.format("wav").option("path", str(tmp_path)).mode("append").save()
    with wave.open(str(tmp_path / "a.wav")) as f:
        assert (f.getnchannels(), f.getsampwidth(), f.getframerate(), f.readframes(9)) == (1, 2, 8000, b"\x01\x00\xff\xff")


def tag(version, frames, flags=0):
    body = b""
    for name, text in frames:
        size = len(text)
        body += name + (size.to_bytes(3, "big") if version == 2 else (bytes(size >> s & 127 for s in (21, 14, 7, 0)) if version == 4 else size.to_bytes(4, "big")) + b"\x00\x00") + text
    body += b"\x00" * 20
    return b"ID3" + bytes([version, 0, flags]) + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + body


FRAME = b"\xff\xfb\x90\x00" + b"\x00" * 100


@pytest.mark.parametrize("version, names", [(2, (b"TT2", b"TP1", b"PIC")), (3, (b"TIT2", b"TPE1", b"APIC")), (4, (b"TIT2", b"TPE1", b"APIC"))])
def test_id3_of_all_versions(version, names):
    frames = [(names[0], b"\x01" + "Tïtle".encode("utf-16") + b"\x00\x00"), (b"XYZ9"[: len(names[0])], b"?" * 200), (names[1], b"\x00Art\xefst\x00more"), (names[2], b"\x00picture")]
    head = tag(version, frames) + FRAME
    found = properties.read_head(head, len(head) - len(FRAME) + 16000)
    assert found == {"container": "mpeg", "channels": 2, "sample_rate": 44100, "duration": 1.0, "bitrate": 128, "artist": "Artïst", "title": "Tïtle", "has_cover": True, "tagged": True}


def test_heads_that_tell_nothing_are_neutral(spark):
    flac = b"fLaC\x80\x00\x00\x22" + b"\x10\x00\x10\x00" + b"\x00" * 6 + ((44100 << 44) | (1 << 41) | (15 << 36) | 88200).to_bytes(8, "big") + b"\x00" * 16
    assert properties.read_head(flac, 100_000) | {"bitrate": 400} == {"container": "flac", "channels": 2, "sample_rate": 44100, "duration": 2.0, "bitrate": 400, "artist": None, "title": None, "has_cover": False, "tagged": False}
    rng = random.Random(2)
    whole = [flac, tag(3, [(b"TIT2", b"\x03x"), (b"TPE1", b"\x03y")]) + FRAME, struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 0, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", 9) + b"123456789"]
    for head in whole:
        for cut in range(len(head)):  # no prefix and no changed byte raises
            properties.read_head(head[:cut], cut)
            broken = bytearray(head)
            broken[cut] = rng.randrange(256)
            properties.read_head(bytes(broken), len(head))
    rows = [(1, None, None, "a"), (2, b"", 0, "b"), (3, b"RIFF", 4, "c"), (4, whole[2], None, "d"), (5, b"\xff" * 50, 50, None)]
    got = properties.with_properties(spark.createDataFrame(rows, "id long, head binary, size_bytes long, other string")).collect()
    neutral = {k: v for k, v in properties.NEUTRAL.items()}
    assert [{k: r[k] for k in neutral} for r in sorted(got, key=lambda r: r.id) if r.id != 4] == [neutral] * 4
    assert [(r.other, r.container, r.duration) for r in got if r.id == 4] == [("d", "wav", 9 / 8000)]


def test_very_many_small_ranges_share_tasks(tmp_path):
    for i in range(3000):
        (tmp_path / f"{i}.wav").write_bytes(b"x" * (60 + i % 80))
    parts = wav.WavReader({"path": str(tmp_path), "rangebytes": "50"}).partitions()
    assert len(parts) <= wav.TASKS + 2
    met = {}
    for path, size, start, end in (r for p in parts for r in p.found):
        assert start == met.get(path, 0) < end <= size  # each byte once, in order
        met[path] = end
    assert len(met) == 3000 and all(end == 60 + int(path.rsplit("/", 1)[1][:-4]) % 80 for path, end in met.items())
