"""Baseline JPEG frames (DCT, Huffman codes) as motion-JPEG files hold them: the brightness plane."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

# Fixed values of the JPEG standard, for frames that leave their tables out, as motion JPEG may:
# how many codes of each length, and the first symbols; the others follow in rising order.
DC_COUNTS = {0: (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), 1: (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0)}
AC_COUNTS = {0: (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), 1: (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119)}
AC_FIRST = {
    0: bytes.fromhex("0102030004110512213141061351610722711432 8191a1082342b1c11552d1f02433627282".replace(" ", "")),
    1: bytes.fromhex("0001020311040521310612415107617113223281 08144291a1b1c109233352f0156272d10a162434e125f1".replace(" ", "")),
}
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_row = np.arange(8)
COSINE = np.sqrt(np.where(_row == 0, 1, 2) / 8)[:, None] * np.cos((2 * _row[None, :] + 1) * _row[:, None] * np.pi / 16)


class BaselineError(ValueError):
    """The bytes are no baseline JPEG frame."""


def standard_symbols(kind: int, table: int) -> bytes:
    """The symbols of a standard table: kind 0 are DC categories, 1 AC runs and categories."""
    if kind == 0:
        return bytes(range(12))
    every = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    return AC_FIRST[table] + bytes(sorted(set(every) - set(AC_FIRST[table])))


@lru_cache(maxsize=64)
def lookup(counts: tuple[int, ...], symbols: bytes) -> tuple[list[int], list[int]]:
    """(symbol, code length) by the next 16 bits; length 0 where no code fits."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, at = 0, 0
    for bits, n in enumerate(counts, 1):
        for value in symbols[at : at + n]:
            first = code << (16 - bits)
            symbol[first : first + (1 << (16 - bits))], length[first : first + (1 << (16 - bits))] = value, bits
            code += 1
        at += n
        code <<= 1
    return symbol.tolist(), length.tolist()


def is_baseline(frame: bytes) -> bool:
    """Whether the first frame header is that of the baseline process."""
    at = 2
    while at + 4 <= len(frame) and frame[at] == 0xFF:
        if 0xC0 <= frame[at + 1] <= 0xCF and frame[at + 1] not in (0xC4, 0xC8, 0xCC):
            return frame[at + 1] == 0xC0
        at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
    return False


def luma(frame: bytes) -> np.ndarray:
    """The first component's samples, (height, width) bytes. Tables that the frame lacks are the
    standard ones; restart intervals and subsampled components are followed."""
    quantise: dict[int, np.ndarray] = {}
    codes = {(kind, t): lookup(counts[t], standard_symbols(kind, t)) for kind, counts in ((0, DC_COUNTS), (1, AC_COUNTS)) for t in (0, 1)}
    at, restart, parts, size = 2, 0, [], None
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise BaselineError("no marker")
        marker, n = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + n]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                quantise[body[0] & 15], body = values.astype(np.float64), body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                codes[body[0] >> 4, body[0] & 15], body = lookup(tuple(body[1:17]), bytes(body[17 : 17 + total])), body[17 + total :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise BaselineError("only samples of 8 bits are read")
            size = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            break
        at += 2 + n
    if size is None or not parts or body[0] != len(parts) or min(size) == 0:
        raise BaselineError("a scan that is not read here")
    tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:  # blocks of a single component come one by one
        wide = high = 1
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    columns, rows = -(-size[1] // (8 * wide)), -(-size[0] // (8 * high))
    scan = re.sub(rb"\xff\xd9.*\Z", b"", frame[at + 2 + n :], flags=re.S)
    blocks: list[list[int]] = []
    done = 0
    for piece in re.split(rb"\xff[\xd0-\xd7]", scan):
        count = min(restart or rows * columns, rows * columns - done)
        _scan(piece.replace(b"\xff\x00", b"\xff"), count, parts, tables, codes, blocks)
        done += count
    if done < rows * columns:
        raise BaselineError("the scan ends early")
    _, h, v, q = parts[0]
    if q not in quantise:
        raise BaselineError("no quantisation table")
    spectrum = np.zeros((len(blocks), 64))
    spectrum[:, ZIGZAG] = np.array(blocks, np.float64) * quantise[q]
    samples = COSINE.T @ spectrum.reshape(-1, 8, 8) @ COSINE + 128
    grid = samples.reshape(rows, columns, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(rows * v * 8, columns * h * 8)
    return np.clip(np.rint(grid), 0, 255).astype(np.uint8)[: -(-size[0] * v // high), : -(-size[1] * h // wide)]


def _scan(data: bytes, count: int, parts: list, tables: dict, codes: dict, blocks: list[list[int]]) -> None:
    """Decode `count` units of one restart interval; the first component's blocks are kept."""
    padded = np.frombuffer(data + bytes(4), np.uint8).astype(np.int64)
    window = ((padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]).tolist()
    end, at = 8 * len(data), 0
    before = [0] * len(parts)
    plan = [(i, codes[0, tables[c][0]], codes[1, tables[c][1]]) for i, (c, h, v, _) in enumerate(parts) for _ in range(h * v)]

    def number(size: int) -> int:
        nonlocal at
        value = (window[at >> 3] >> (8 - (at & 7)) & 0xFFFF) >> (16 - size)
        at += size
        return value if value >> (size - 1) else value - (1 << size) + 1

    for _ in range(count):
        for part, (dc, dc_length), (ac, ac_length) in plan:
            if at > end:
                raise BaselineError("the scan ends early")
            block = [0] * 64
            bits = window[at >> 3] >> (8 - (at & 7)) & 0xFFFF
            at += dc_length[bits]
            if dc[bits]:
                before[part] += number(dc[bits])
            block[0] = before[part]
            k = 1
            while k < 64:
                if at > end:
                    raise BaselineError("the scan ends early")
                bits = window[at >> 3] >> (8 - (at & 7)) & 0xFFFF
                if not ac_length[bits]:
                    raise BaselineError("no such code")
                at += ac_length[bits]
                run, size = ac[bits] >> 4, ac[bits] & 15
                if size:
                    k += run
                    if k > 63:
                        raise BaselineError("a run leaves its block")
                    block[k] = number(size)
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    break
            if part == 0:
                blocks.append(block)
    if at > end:
        raise BaselineError("the scan ends early")
