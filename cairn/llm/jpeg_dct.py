"""Baseline JPEG frames: Huffman-coded DCT blocks, restart intervals, subsampled parts, and the tables that motion-JPEG leaves out."""

from __future__ import annotations

import numpy as np

# Fixed values of the JPEG standard: the usual Huffman tables' numbers of codes by length, and their symbols.
_DC = {0: (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), 1: (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0)}
_AC = {0: (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), 1: (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119)}
_AC_FIRST = {
    0: "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    1: "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
}
#: Pixels of a frame at most: larger ones are an error, so that a frame's memory is bounded.
PIXELS = 1 << 26


def _usual(kind: int, which: int) -> tuple[list[int], list[int]]:
    """(numbers of codes by length, symbols) of the table that a frame without one means; the symbols of the longest codes follow in order."""
    if kind == 0:
        return list(_DC[which]), list(range(12))
    first = [int(s, 16) for s in _AC_FIRST[which].split()]
    every = [0, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    return list(_AC[which]), first + sorted(set(every) - set(first))


def zigzag() -> np.ndarray:
    """Places in a block, row by row, of the coefficients in their coded order."""
    cells = sorted(((i + j, (i if (i + j) % 2 else j), i, j) for i in range(8) for j in range(8)))
    return np.array([i * 8 + j for _, _, i, j in cells])


_PLACE = zigzag()
_BASIS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


class Unreadable(ValueError):
    """A frame that is no baseline JPEG, or a broken one."""


def lookup(counts: list[int], symbols: list[int]) -> list[int]:
    """By the next 16 bits: symbol * 32 + code length; 0 where there is no code."""
    out, code, k = [0] * (1 << 16), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            begin = code << (16 - length)
            if begin >= 1 << 16 or k >= len(symbols):
                raise Unreadable("broken Huffman table")
            out[begin : begin + (1 << (16 - length))] = [symbols[k] * 32 + length] * (1 << (16 - length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _header(frame: bytes):
    """(height, width, parts, quantisers, tables, restart interval, parts of the scan, where its data begins)."""
    quant, tables, restart, shape, parts, at = {}, {}, 0, None, [], 2
    if frame[:2] != b"\xff\xd8":
        raise Unreadable("no JPEG")
    while True:
        while frame[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise Unreadable("broken header")
        marker, body = frame[at + 1], frame[at + 4 : at + 2 + int.from_bytes(frame[at + 2 : at + 4], "big")]
        at += 4 + len(body)
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                if len(body) < 1 + 64 * wide:
                    raise Unreadable("broken quantiser")
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.float64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while len(body) >= 17:
                n = sum(body[1:17])
                tables[body[0]] = lookup(list(body[1:17]), list(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if len(body) < 6 or body[0] != 8 or len(body) < 6 + 3 * body[5]:
                raise Unreadable("unsupported precision")
            shape = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            if not all(shape) or shape[0] * shape[1] > PIXELS or len(parts) not in (1, 3) or any(not 1 <= f <= 4 for _, h, v, _ in parts for f in (h, v)):
                raise Unreadable("unsupported size or parts")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise Unreadable("not baseline")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if shape is None or not body or body[0] != len(parts) or len(body) < 1 + 2 * len(parts):
                raise Unreadable("unsupported scan")
            scan = []
            for k, (name, h, v, q) in enumerate(parts):
                chosen = body[2 + 2 * k]
                if body[1 + 2 * k] != name or q not in quant:
                    raise Unreadable("unsupported scan")
                for kind, which in ((0, chosen >> 4), (1, chosen & 15)):
                    if kind << 4 | which not in tables:
                        tables[kind << 4 | which] = lookup(*_usual(kind, min(which, 1)))
                scan.append((h, v, quant[q], tables[chosen >> 4], tables[16 | chosen & 15]))
            return *shape, scan, restart, at


class _Bits:
    """A reader of a run of data without markers."""

    def __init__(self, data: bytes):
        self.data, self.at, self.word, self.held = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def fill(self):
        chunk = self.data[self.at : self.at + 6]
        self.at += 6
        self.word = (self.word << 48) | int.from_bytes(chunk + b"\xff" * (6 - len(chunk)), "big")  # behind the end ones, as a writer fills up
        self.held += 48
        if self.at > len(self.data) + 64:
            raise Unreadable("data ends early")

    def symbol(self, table: list[int]) -> int:
        if self.held < 16:
            self.fill()
        entry = table[self.word >> (self.held - 16) & 0xFFFF]
        if not entry:
            raise Unreadable("broken data")
        self.held -= entry & 31
        self.word &= (1 << self.held) - 1
        return entry >> 5

    def value(self, size: int) -> int:
        if not size:
            return 0
        if self.held < size:
            self.fill()
        self.held -= size
        got = self.word >> self.held
        self.word &= (1 << self.held) - 1
        return got if got >> (size - 1) else got - (1 << size) + 1


def decode(frame: bytes) -> np.ndarray:
    """Samples (row, column, red green blue; or one grey part) of a baseline frame."""
    height, width, scan, restart, at = _header(frame)
    h_most, v_most = max(s[0] for s in scan), max(s[1] for s in scan)
    if len(scan) == 1:  # a single part's blocks stand in its own rows
        scan = [(1, 1, *scan[0][2:])]
        h_most = v_most = 1
    across, down = -(-width // (8 * h_most)), -(-height // (8 * v_most))
    planes = [np.zeros((down * v, across * h, 64)) for h, v, *_ in scan]
    runs = [_Bits(r) for r in _runs(frame[at:])]
    last, run = [0] * len(scan), 0
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            last, run = [0] * len(scan), run + 1
        if run >= len(runs):
            raise Unreadable("data ends early")
        bits = runs[run]
        row, column = divmod(unit, across)
        for k, (h, v, _, dc, ac) in enumerate(scan):
            for y in range(v):
                for x in range(h):
                    block = planes[k][row * v + y, column * h + x]
                    last[k] += bits.value(bits.symbol(dc))
                    block[0] = last[k]
                    i = 1
                    while i < 64:
                        symbol = bits.symbol(ac)
                        if symbol == 0:
                            break
                        i += symbol >> 4
                        if symbol != 0xF0:
                            if i > 63:
                                raise Unreadable("broken data")
                            block[i] = bits.value(symbol & 15)
                        i += 1
    out = []
    for (h, v, quant, *_), plane in zip(scan, planes):
        natural = np.zeros_like(plane)
        natural[..., _PLACE] = plane * quant
        pixels = np.einsum("xu,rcuv,yv->rxcy", _BASIS, natural.reshape(*plane.shape[:2], 8, 8), _BASIS) + 128
        pixels = pixels.reshape(plane.shape[0] * 8, plane.shape[1] * 8)
        out.append(pixels.repeat(v_most // v, 0).repeat(h_most // h, 1)[:height, :width])
    if len(out) == 1:
        return np.clip(np.rint(out[0]), 0, 255).astype(np.uint8)[:, :, None]
    y, cb, cr = out[0], out[1] - 128, out[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def _runs(data: bytes) -> list[bytes]:
    """The coded data up to the next other marker, cut at its restart markers."""
    out, begin, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        marker = data[at + 1] if 0 <= at < len(data) - 1 else None
        if marker is None:
            return [*out, data[begin:]]
        if 0xD0 <= marker <= 0xD7:
            out.append(data[begin:at])
            begin = at + 2
        elif marker not in (0x00, 0xFF):
            return [*out, data[begin:at]]
        at += 2 if marker != 0xFF else 1
