"""Ordinary motion-JPEG files: baseline frames of a plain encoder, subsampling, restarts, left-out tables, indexes of large files."""

import struct

import numpy as np
import pytest

from cairn.llm import jpeg_dct, media


def codes(counts, symbols):
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = format(code, f"0{length}b")
            code, k = code + 1, k + 1
        code <<= 1
    return out


def encode(rgb, sampling=(1, 1), restart=0, tables=True, step=2):
    """A baseline JPEG by direct cosine sums: brightness at full size, colours subsampled."""
    h, w, _ = rgb.shape
    r, g, b = (rgb[..., k].astype(float) for k in range(3))
    y, cb, cr = 0.299 * r + 0.587 * g + 0.114 * b, -0.168736 * r - 0.331264 * g + 0.5 * b + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128
    sx, sy = sampling
    across, down = -(-w // (8 * sx)), -(-h // (8 * sy))
    pad = lambda p: np.pad(p, ((0, down * 8 * sy - h), (0, across * 8 * sx - w)), mode="edge")
    shrink = lambda p: pad(p).reshape(down * 8, sy, across * 8, sx).mean((1, 3))
    planes = [(pad(y), sx, sy, 0), (shrink(cb), 1, 1, 1), (shrink(cr), 1, 1, 1)]
    usual = {(k, c): jpeg_dct._usual(k, c) for k in (0, 1) for c in (0, 1)}
    code = {key: codes(*t) for key, t in usual.items()}
    order = jpeg_dct.zigzag()
    bits, data, last, marker = "", b"", [0, 0, 0], 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            data, bits, last = data + flush(bits) + bytes([0xFF, 0xD0 + marker % 8]), "", [0, 0, 0]
            marker += 1
        row, column = divmod(unit, across)
        for k, (plane, fx, fy, c) in enumerate(planes):
            for v in range(fy):
                for u in range(fx):
                    a, o = (row * fy + v) * 8, (column * fx + u) * 8
                    block = jpeg_dct._BASIS.T @ (plane[a : a + 8, o : o + 8] - 128) @ jpeg_dct._BASIS
                    q = np.rint(block.ravel()[order] / step).astype(int)
                    put = lambda n: "" if not n else format(n if n > 0 else n + (1 << abs(n).bit_length()) - 1, f"0{abs(n).bit_length()}b")
                    d, last[k] = int(q[0] - last[k]), int(q[0])
                    bits += code[0, c][abs(d).bit_length()] + put(d)
                    run = 0
                    for n in q[1 : 1 + max(np.flatnonzero(q[1:]) + 1, default=0)].tolist():
                        if n == 0:
                            run += 1
                            continue
                        while run > 15:
                            bits, run = bits + code[1, c][0xF0], run - 16
                        bits, run = bits + code[1, c][run << 4 | abs(n).bit_length()] + put(n), 0
                    if not q[63]:
                        bits += code[1, c][0]
    data += flush(bits)
    segment = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    head = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([step] * 64)) + segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, sx << 4 | sy, 0, 2, 0x11, 0, 3, 0x11, 0]))
    if tables:
        head += segment(0xC4, b"".join(bytes([k << 4 | c, *t[0], *t[1]]) for (k, c), t in usual.items()))
    if restart:
        head += segment(0xDD, struct.pack(">H", restart))
    return head + segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + data + b"\xff\xd9"


def picture(seed, h=21, w=37):
    x, y = np.meshgrid(np.linspace(0, 1, w), np.linspace(0, 1, h))
    base = np.array([90 + 100 * (seed % 2), 120, 200 - 90 * (seed % 2)])
    return np.clip(base + 40 * np.stack([x, y, x * y], axis=2) * (1 + seed % 3), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("sampling", [(1, 1), (2, 1), (2, 2)])
@pytest.mark.parametrize("restart,tables", [(0, True), (2, False)])
def test_baseline_frames(sampling, restart, tables):
    rgb = picture(1)
    got = jpeg_dct.decode(encode(rgb, sampling, restart, tables))
    assert got.shape == rgb.shape and np.abs(got.astype(int) - rgb).max() <= (6 if sampling == (1, 1) else 14)


def test_noise_survives():
    rgb = np.random.default_rng(3).integers(0, 256, (16, 16, 3)).astype(np.uint8)
    assert np.abs(jpeg_dct.decode(encode(rgb, step=1)).astype(int) - rgb).mean() < 2


def test_broken_frames():
    whole = encode(picture(0))
    for bad in (b"", b"\xff\xd8", whole[:200], whole[:-400] + b"\xff\xd9", whole.replace(b"\xff\xc0", b"\xff\xc2", 1)):
        out = media.decode_frames([bad])[0]
        assert isinstance(out, str)
    assert [isinstance(x, str) for x in media.decode_frames([whole, b"x", whole])] == [False, True, False]


def large_avi(frames):
    """A file with an index tree instead of idx1: two lists of frames, each with an index of its own."""
    head = struct.pack("<14I", 40_000, 0, 0, 0x10, len(frames), 0, 1, 0, 37, 21, 0, 0, 0, 0)
    stream = b"vidsMJPG" + bytes(48)
    size = 24 + 16 * 2
    place = 12 + 8 + 4 + 8 + len(head) + 8 + 4 + 8 + len(stream) + 8 + size
    body, lists = b"", []
    for part in (frames[: len(frames) // 2], frames[len(frames) // 2 :]):
        chunk = b"".join(media._chunk(b"00dc", f) for f in part)
        start, rows, at = place + len(body) + 12, [], 0
        for f in part:
            rows.append(struct.pack("<II", at + 8, len(f)))
            at += 8 + len(f) + (len(f) & 1)
        own = struct.pack("<HBBI4sQI", 2, 0, 1, len(part), b"00dc", start, 0) + b"".join(rows)
        lists.append(start + len(chunk))
        body += media._chunk(b"LIST", b"movi" + chunk + media._chunk(b"ix00", own))
    tree = struct.pack("<HBBI4sQI", 4, 0, 0, 2, b"00dc", 0, 0) + b"".join(struct.pack("<QII", at, 0, 0) for at in lists)
    headers = media._chunk(b"LIST", b"hdrl" + media._chunk(b"avih", head) + media._chunk(b"LIST", b"strl" + media._chunk(b"strh", stream) + media._chunk(b"indx", tree)))
    assert len(headers) == place - 12
    return b"RIFF" + struct.pack("<I", 4 + len(headers + body)) + b"AVI " + headers + body


def test_clips_of_ordinary_files(spark):
    """Timed clips of baseline files by either index, of repeated and null ids; a cut is where the pictures change."""
    frames = [encode(picture(0)) for _ in range(12)] + [encode(picture(1)) for _ in range(8)]
    plain, large = media.write_avi(frames, 37, 21), large_avi(frames)
    assert media.read_avi(large) == (frames, 25.0, None) and media.read_avi(plain)[0] == frames
    rows = [(1, plain), (2, large), (1, plain), (None, large), (3, plain[:-20]), (4, None), (5, media.write_avi([frames[0], b"\xff\xd8junk"]))]
    out = sorted(media.clips(spark.createDataFrame(rows, "id long, media binary")).collect(), key=str)
    good = [(r.id, r.clip, r.first_frame, r.frames, r.begin_s, r.end_s) for r in out if r.error is None]
    assert sorted(good, key=str) == sorted([(i, *c) for i in (1, 2, 1, None) for c in ((0, 0, 12, 0.0, 0.48), (1, 12, 8, 0.48, 0.8))], key=str)
    assert {r.id: r.error for r in out if r.error} == {3: "broken index", 4: "no AVI", 5: "broken header"}
