"""Motion-JPEG in AVI: payloads as losslessly coded frames, and timed clips read back from AVI files.

Frames are 8 by 8 pixels of three 8-bit samples, 192 bytes of payload each, coded as lossless
JPEG (SOF3, predictor 1), so the samples are the payload's bytes. The reader walks the RIFF
chunks, takes the frames from the file's index (`idx1`, or the `indx` tree of large files),
decodes each by itself, these lossless frames and ordinary baseline ones (jpeg_dct), and finds
shots where the difference of neighbouring frames' histograms stands out from those around it.

A stored text is one cell, which holds 2 GB at most: of texts beyond some 1.3 GB the task fails.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import jpeg_dct

SIDE, CHANNELS, FPS = 8, 3, 25
FRAME = SIDE * SIDE * CHANNELS
#: Payload bytes coded or decoded at a time.
PART = 1 << 20
#: Code lengths of the size categories 0 to 8, any complete enough choice; texts use 3 to 7 most.
LENGTHS = (4, 4, 4, 3, 3, 3, 3, 3, 4)
#: Histogram cells, frames around a difference that it is compared with, standard deviations and least height of a cut.
CELLS, AROUND, DEVIATIONS, LEAST = 16, 8, 2.0, 0.25


# ---------------------------------------------------------------- JPEG


def _canonical(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table given as numbers of codes by length and symbols in order."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


_ORDER = sorted(range(9), key=lambda c: (LENGTHS[c], c))
_COUNTS = [LENGTHS.count(n) for n in range(1, 17)]
_CODES = {s: (c, n) for s, c, n in _canonical(_COUNTS, _ORDER)}
_CODE = np.array([_CODES[s][0] for s in range(9)], np.int64)
_CODE_LENGTH = np.array([_CODES[s][1] for s in range(9)], np.int64)
_CATEGORY = np.array([abs(d).bit_length() for d in range(-255, 256)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEAD = (
    b"\xff\xd8"
    + _segment(0xC3, struct.pack(">BHHB", 8, SIDE, SIDE, CHANNELS) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(CHANNELS)))
    + _segment(0xC4, b"\0" + bytes(_COUNTS) + bytes(_ORDER))
    + _segment(0xDA, bytes([CHANNELS]) + b"".join(bytes([c + 1, 0]) for c in range(CHANNELS)) + bytes([1, 0, 0]))
)
TAIL = b"\xff\xd9"


def _differences(frames: np.ndarray) -> np.ndarray:
    """Samples less their predictions: the left one, in the first column the one above, 128 at first."""
    d = frames.astype(np.int64)
    out = d.copy()
    out[:, :, 1:] -= d[:, :, :-1]
    out[:, 1:, 0] -= d[:, :-1, 0]
    out[:, 0, 0] -= 128
    return out


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """JPEG files of the payload's frames (its length is a multiple of FRAME)."""
    n = len(payload) // FRAME
    diff = _differences(payload.reshape(n, SIDE, SIDE, CHANNELS)).reshape(n, FRAME)
    size = _CATEGORY[diff + 255]
    value = (_CODE[size] << size) | np.where(diff < 0, diff + (1 << size) - 1, diff)
    bits = _CODE_LENGTH[size] + size
    ends = np.cumsum(bits, axis=1)
    length = -(-ends[:, -1] // 8)
    begin = np.cumsum(length) - length
    at = (begin * 8)[:, None] + ends - bits
    placed = value << (24 - (at & 7) - bits)
    total = int(length.sum())
    where = (at >> 3).ravel()
    out = np.zeros(total + 3)
    for k, shift in enumerate((16, 8, 0)):  # a code touches three bytes at most and shares no bit
        out[k:] += np.bincount(where, ((placed >> shift) & 255).ravel(), total + 3 - k)[: total + 3 - k]
    data = out[:total].astype(np.uint8)
    data[begin + length - 1] |= ((1 << (length * 8 - ends[:, -1])) - 1).astype(np.uint8)  # a frame ends in ones
    full = np.flatnonzero(data == 255)  # and every 255 is followed by a zero
    data = np.insert(data, full + 1, 0).tobytes()
    stops = begin + length
    stops = (stops + np.searchsorted(full, stops)).tolist()
    return [HEAD + data[a:b] + TAIL for a, b in zip([0, *stops], stops)]


class _Header:
    """What a frame's JPEG header says; `error` where this decoder does not know the kind."""

    def __init__(self, frame: bytes):
        self.error, self.size, tables, at = None, 0, {}, 2
        self.shape = self.predictor = self.lookup = None
        if frame[:2] != b"\xff\xd8":
            self.error = "no JPEG"
        while not self.error:
            if at + 4 > len(frame) or frame[at] != 0xFF:
                self.error = "broken header"
                break
            marker, length = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
            body = frame[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xC4:
                while len(body) >= 17:
                    n = sum(body[1:17])
                    tables[body[0]] = _canonical(list(body[1:17]), list(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xC3:
                bits, height, width, parts = struct.unpack(">BHHB", body[:6])
                self.shape = (height, width, parts)
                if bits != 8 or any(body[7 + 3 * c] != 0x11 for c in range(parts)):
                    self.error = "unsupported sampling"
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                self.error = "not lossless"
            elif marker == 0xDD and any(body):
                self.error = "restart intervals"
            elif marker == 0xDA:
                parts = body[0]
                used = {body[2 + 2 * c] >> 4 for c in range(parts)}
                self.predictor, transform = body[1 + 2 * parts], body[3 + 2 * parts]
                if self.shape is None or parts != self.shape[2] or len(used) != 1 or used - set(tables) or self.predictor != 1 or transform:
                    self.error = "unsupported scan"
                else:
                    self.lookup = _lookup(tables[used.pop()])
                self.size = at
                break


def _lookup(table: list[tuple[int, int, int]]) -> np.ndarray:
    """By the next 16 bits: symbol * 32 + code length; 0 for no code."""
    out = np.zeros(1 << 16, np.int64)
    for symbol, code, length in table:
        out[code << (16 - length) : (code + 1) << (16 - length)] = symbol * 32 + length
    return out


def _decode(frames: list[bytes], head: _Header) -> np.ndarray:
    """Samples (frame, row, column, part) of frames under one header. All frames are read side by side, a sample a step."""
    raw = [f[head.size : -2] for f in frames]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    stuffed = np.flatnonzero((data[:-1] == 255) & (data[1:] == 0)) + 1
    ends = ends - np.searchsorted(stuffed, ends)
    data = np.concatenate([np.delete(data, stuffed), np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | data[k : len(data) - 7 + k]
    at = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) * 8
    height, width, parts = head.shape
    out = np.empty((height * width * parts, len(frames)), np.int64)
    last = len(word) - 1
    for k in range(len(out)):
        ahead = word[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint64)
        entry = head.lookup[(ahead >> np.uint64(48)).astype(np.int64)]
        length, size = entry & 31, entry >> 5
        bits = ((ahead << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        out[k] = np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)
        at += length + size
    d = out.T.reshape(len(frames), height, width, parts)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 255).astype(np.uint8)


def _baseline(frame: bytes) -> bool:
    """Whether a frame's header tells of Huffman-coded DCT blocks."""
    at = 2
    while at + 4 <= len(frame) and frame[at] == 0xFF:
        if frame[at + 1] in (0xC0, 0xC1):
            return True
        if frame[at + 1] in (0xC3, 0xDA):
            return False
        at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big") if frame[at + 1] != 0xFF else 1
    return False


def decode_frames(frames: list[bytes], take=lambda samples: samples) -> list:
    """What `take` makes of each frame's samples (row, column, part), or why it cannot be decoded."""
    out: list = [None] * len(frames)
    groups: dict[bytes, list[int]] = {}
    heads: dict[bytes, _Header] = {}
    for i, f in enumerate(frames):
        if _baseline(f):
            try:
                out[i] = take(jpeg_dct.decode(f))
            except jpeg_dct.Unreadable as e:
                out[i] = str(e)
            continue
        key = next((k for k in heads if f.startswith(k) and k), None)
        if key is None:
            head = _Header(f)
            key = f[: head.size] if not head.error else f
            heads[key] = head
        if heads[key].error:
            out[i] = heads[key].error
        else:
            groups.setdefault(key, []).append(i)
    for key, own in groups.items():
        for i, samples in zip(own, _decode([frames[i] for i in own], heads[key])):
            out[i] = take(samples)
    return out


# ---------------------------------------------------------------- AVI


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    """An AVI file with one motion-JPEG stream and an index."""
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    sizes = np.array([len(f) for f in frames], np.int64)
    offsets = 4 + np.cumsum(8 + sizes + (sizes & 1)) - (8 + sizes + (sizes & 1))
    index = np.column_stack([np.full(len(frames), 0x63643030), np.full(len(frames), 0x10), offsets, sizes]).astype("<u4")
    body = head + _chunk(b"LIST", b"movi" + b"".join([_chunk(b"00dc", f) for f in frames])) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


def _entries(data: bytes, at: int) -> list[tuple[int, int]]:
    """(place, size) of the frames that an index chunk of a large file names: by further chunks, or by offsets."""
    width, _, kind, used, _, base = struct.unpack("<HBBI4sQ", data[at + 8 : at + 28])
    if kind == 0:
        out = []
        for k in range(used):
            out += _entries(data, int.from_bytes(data[at + 32 + 16 * k : at + 40 + 16 * k], "little"))
        return out
    rows = np.frombuffer(data[at + 32 : at + 32 + 4 * width * used], "<u4").reshape(used, width).astype(np.int64)
    return list(zip((rows[:, 0] + base).tolist(), (rows[:, 1] & 0x7FFFFFFF).tolist()))


def read_avi(data: bytes | None) -> tuple[list[bytes], float, str | None]:
    """(frames of the first video stream by the file's index, frames a second, error)."""
    if not data or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return [], 0.0, "no AVI"
    movi, index, tree, fps, at = None, None, None, 0.0, 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if kind == b"LIST" and data[at + 8 : at + 12] == b"movi" and movi is None:
            movi = at + 8
        elif kind == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            k = data.find(b"avih", at, at + 8 + size)
            step = int.from_bytes(data[k + 8 : k + 12], "little") if k > 0 else 0
            fps = 1_000_000 / step if step else 0.0
            video = data.find(b"strh", at, at + 8 + size)
            while video > 0 and data[video + 8 : video + 12] != b"vids":
                video = data.find(b"strh", video + 4, at + 8 + size)
            tree = data.find(b"indx", video, at + 8 + size) if video > 0 else -1
        elif kind == b"idx1":
            body = data[at + 8 : at + 8 + size]
            if len(body) < size or size % 16:
                return [], fps, "broken index"
            index = np.frombuffer(body, "<u4").reshape(-1, 4)
        elif kind == b"RIFF":  # a large file goes on in further parts
            size = 4
        at += 8 + size + (size & 1)
    if tree is not None and tree > 0:
        try:
            places = _entries(data, tree)
        except (struct.error, ValueError, RecursionError):
            return [], fps, "broken index"
        if any(b + n > len(data) for b, n in places):
            return [], fps, "index beyond the file"
        return [data[b : b + n] for b, n in places], fps, None
    if movi is None or index is None:
        return [], fps, "no index"
    video = index[(index[:, 0] >> 16 == 0x6364) | (index[:, 0] >> 16 == 0x6264)].astype(np.int64)  # dc or db
    # offsets count from the list's name, in some files from the file's start
    base = movi if not len(video) or video[0, 2] < movi else 0
    if len(video) and (video[:, 2] + video[:, 3] + base + 8).max() > len(data):
        return [], fps, "index beyond the file"
    begins = (video[:, 2] + base + 8).tolist()
    return [data[b : b + n] for b, n in zip(begins, video[:, 3].tolist())], fps, None


def shots(histograms: np.ndarray) -> list[int]:
    """Frames at which a shot begins (0 first): local peaks of the histogram difference over mean and deviations around."""
    if not len(histograms):
        return []
    d = np.abs(np.diff(histograms, axis=0)).sum(1) / 2
    n = len(d)
    total, square = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    low, high = np.maximum(np.arange(n) - AROUND, 0), np.minimum(np.arange(n) + AROUND + 1, n)
    count = np.maximum(high - low - 1, 1)
    mean = (total[high] - total[low] - d) / count
    spread = np.sqrt(np.maximum((square[high] - square[low] - d * d) / count - mean * mean, 0))
    before, after = np.concatenate([[-1], d[:-1]]), np.concatenate([d[1:], [-1]])
    peaks = (d >= LEAST) & (d > mean + DEVIATIONS * spread) & (d >= before) & (d > after)
    return [0, *(np.flatnonzero(peaks) + 1).tolist()]


def look(samples: np.ndarray) -> tuple[np.ndarray, float]:
    """(a frame's shares of samples in CELLS equal ranges, its mean sample)."""
    return np.bincount(samples.ravel() // (256 // CELLS), minlength=CELLS) / samples.size, float(samples.mean())


def histograms(frames: list[np.ndarray]) -> np.ndarray:
    """Each frame's shares of samples in CELLS equal ranges."""
    if not frames:
        return np.zeros((0, CELLS))
    cell = np.stack(frames).reshape(len(frames), -1) // (256 // CELLS) + np.arange(len(frames))[:, None] * CELLS
    return np.bincount(cell.ravel(), minlength=len(frames) * CELLS).reshape(len(frames), CELLS) / cell.shape[1]


# ---------------------------------------------------------------- Spark


def _payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % FRAME or (0 if raw else FRAME))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (an AVI file) of every row of docs(doc_id, text).

    The payload is the text's UTF-8 bytes and spaces up to a positive multiple of 192; a null is empty.
    """

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            a = 0
            while a < len(texts):
                parts, b, size = [], a, 0
                while b < len(texts) and size < PART:
                    parts.append(_payload(texts[b]))
                    size += len(parts[-1])
                    b += 1
                frames, media = [], []
                joined = np.frombuffer(b"".join(parts), np.uint8)
                for k in range(0, size, PART // FRAME * FRAME):
                    frames += encode_frames(joined[k : k + PART // FRAME * FRAME])
                k = 0
                for p in parts:
                    media.append(write_avi(frames[k : k + len(p) // FRAME]))
                    k += len(p) // FRAME
                n = [len((t or "").encode()) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                a = b

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _decoded(media: list[bytes | None], take=lambda samples: samples):
    """(what is taken of each frame's samples, or an error; frames a second; error) of each file, decoding about PART bytes of small frames, or one large frame, at a time."""
    files = [read_avi(m) for m in media]
    flat = [f for frames, _, _ in files for f in frames]
    k = 0
    samples: list = []
    while k < len(flat):
        step = PART // FRAME
        samples += decode_frames(flat[k : k + step], take)
        k += step
    k = 0
    for frames, fps, error in files:
        yield samples[k : k + len(frames)], fps, error
        k += len(frames)


def _some(media: list[bytes | None]):
    """Index ranges of files with a few MB together."""
    a, size = 0, 0
    for b, m in enumerate(media, 1):
        size += len(m or b"")
        if size >= 2 * PART or b == len(media):
            yield a, b
            a, size = b, 0


def read_texts(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored files give back: payload and media digests and a feature string."""

    def run(batches):
        for batch in batches:
            ids, n, media = (batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))
            for a, b in _some(media):
                rows = []
                for d, size, m, (frames, fps, error) in zip(ids[a:b], n[a:b], media[a:b], _decoded(media[a:b])):
                    bad = error or next((f for f in frames if isinstance(f, str)), None)
                    if bad:
                        raise ValueError(f"document {d}: its stored media cannot be read back: {bad}")
                    payload = b"".join([f.tobytes() for f in frames])
                    begins = shots(histograms(frames))
                    feature = f"frames={len(frames)};fps={fps:g};clips={len(begins)};begins={','.join(map(str, begins))}"
                    rows.append((d, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def clips(videos: DataFrame) -> DataFrame:
    """(id, clip, first_frame, frames, begin_s, end_s, brightness, error): the shots of every row of videos(id, media).

    A file that cannot be read, or with a frame that cannot (neither baseline nor 8-bit lossless
    JPEG, or a broken one), gives one row with clip null and the reason in error; a null media is
    no AVI; a file without frames gives no rows. Repeated and null ids keep their rows. Of each
    frame only a histogram and a mean are kept.
    """

    def run(batches):
        for batch in batches:
            ids, media = batch.column("id").to_pylist(), batch.column("media").to_pylist()
            rows = []
            for a, b in _some(media):
                for d, (frames, fps, error) in zip(ids[a:b], _decoded(media[a:b], look)):
                    bad = error or next((f for f in frames if isinstance(f, str)), None)
                    if bad:
                        rows.append((d, None, None, None, None, None, None, bad))
                        continue
                    begins = shots(np.array([h for h, _ in frames]).reshape(len(frames), CELLS))
                    for k, (s, e) in enumerate(zip(begins, [*begins[1:], len(frames)])):
                        rate = fps or FPS
                        rows.append((d, k, s, e - s, s / rate, e / rate, float(np.mean([m for _, m in frames[s:e]])), None))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string())
            names = ["id", "clip", "first_frame", "frames", "begin_s", "end_s", "brightness", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names=names)

    return videos.select(F.col("id").cast("long").alias("id"), "media").mapInArrow(run, "id long, clip int, first_frame int, frames int, begin_s double, end_s double, brightness double, error string")
