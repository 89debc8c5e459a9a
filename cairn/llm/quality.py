"""Document quality by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise part is
evaluated in linear time as half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2, summed over the factors.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import U, map_text, text_bytes, word_hashes, word_spans

#: Cells of hashed words, cells of each bucketed statistic, factors.
WORDS, BINS, FACTORS = 1 << 13, 16, 8
#: Labelled rows that the model is fitted on, at most: those with the least hash of doc_id.
SAMPLE = 8192
#: Passes over them, steps at least, rows of a step, learning rate, weight decay.
EPOCHS, STEPS, BATCH, RATE, DECAY = 8, 600, 128, 0.05, 1e-4

_UPPER, _LOWER, _DIGIT, _WIDE, _SPACE, _LINE, _STOP, _SHOUT, _SYMBOL, _BAR, _OTHER = range(11)
_CLASS = np.full(256, _OTHER, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _WIDE
for _marks, _kind in ((b" \t\r\v\f", _SPACE), (b"\n", _LINE), (b".,;:", _STOP), (b"!?", _SHOUT), (b"#$%&*@~^+=<>{}[]\\/_", _SYMBOL), (b"|", _BAR)):
    _CLASS[list(_marks)] = _kind


def _line_spans(raw: np.ndarray, offsets: np.ndarray):
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    edge[1:] |= raw == 10
    starts = np.flatnonzero(edge[:-1])
    ends = np.append(starts[1:], len(raw))
    return starts, ends, np.searchsorted(starts, offsets)


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.array([len(np.unique(values[a:b])) for a, b in zip(first[:-1], first[1:])], np.float64)


def features(text: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(statistics by text, metadata included; hashed words of each text). A null n_chars counts as 0."""
    raw, offsets = text_bytes(text)
    told = np.maximum(np.asarray(n_chars.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)), 0)
    n = len(offsets) - 1
    size = np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n), size) * 11 + _CLASS[raw], minlength=n * 11).reshape(n, 11).astype(np.float64)
    starts, ends, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends, lower=True)
    count = np.diff(first).astype(np.float64)
    lines, line_ends, line_first = _line_spans(raw, offsets)
    line_count = np.diff(line_first).astype(np.float64)
    line_kinds = _distinct(word_hashes(raw, lines, line_ends), line_first)
    cells = [np.unique((words[a:b] >> U(51)).astype(np.int64)) for a, b in zip(first[:-1], first[1:])]
    chars = np.maximum(size, 1.0)
    some = np.maximum(count, 1.0)
    edge = np.concatenate([np.zeros(1), np.cumsum(_CLASS[raw[ends - 1]] >= _SHOUT)]) if len(ends) else np.zeros(1)
    stats = np.column_stack(
        [
            *(kinds[:, k] / chars for k in (_UPPER, _LOWER, _DIGIT, _WIDE, _SPACE, _LINE, _STOP, _SHOUT, _SYMBOL, _BAR, _OTHER)),
            kinds[:, _UPPER] / np.maximum(kinds[:, _UPPER] + kinds[:, _LOWER], 1),
            (edge[first[1:]] - edge[first[:-1]]) / some,
            np.log1p(size) / 16,
            np.log1p(count) / 12,
            np.log1p(chars / some) / 6,
            np.log1p(count / np.maximum(line_count, 1)) / 8,
            line_kinds / np.maximum(line_count, 1),
            _distinct(words, first) / some,
            np.array([len(c) for c in cells]) / some,
            np.log1p(told) / 16,
            np.minimum(told / chars, 4.0),
        ]
    )
    return stats, cells


def _design(stats: np.ndarray, cells: list[np.ndarray], mean, scale, low, high):
    """Sparse rows (ids, values, first): words, then standardised statistics, then their bins."""
    width = stats.shape[1]
    z = np.clip((stats - mean) / scale, -4, 4) / 4
    bins = np.clip(((stats - low) / (high - low) * BINS).astype(np.int64), 0, BINS - 1)
    own = WORDS + width + np.arange(width) * BINS + bins
    ids, values, first = [], [], [0]
    for i, c in enumerate(cells):
        ids += [c, WORDS + np.arange(width), own[i]]
        values += [np.full(len(c), 1 / np.sqrt(len(c) or 1)), z[i], np.full(width, 1 / np.sqrt(width))]
        first.append(first[-1] + len(c) + 2 * width)
    return np.concatenate(ids), np.concatenate(values), np.array(first)


def _forward(model, ids, values, first):
    vx = model["v"][ids] * values[:, None]
    s = np.add.reduceat(vx, first[:-1])
    square = np.add.reduceat(vx * vx, first[:-1])
    linear = np.add.reduceat(model["w"][ids] * values, first[:-1])
    return model["w0"][0] + linear + 0.5 * (s * s - square).sum(1), s, vx


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(stats: np.ndarray, cells: list[np.ndarray], y: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """A model by mini-batch AdaGrad on the log loss."""
    rng = np.random.default_rng(seed)
    low, high = np.quantile(stats, 0.005, axis=0), np.quantile(stats, 0.995, axis=0)
    shape = {"mean": stats.mean(0), "scale": stats.std(0) + 1e-6, "low": low, "high": np.maximum(high, low + 1e-6)}
    size = WORDS + stats.shape[1] * (BINS + 1)
    model = shape | {"w0": np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1))]), "w": np.zeros(size), "v": rng.normal(0, 0.05, (size, FACTORS))}
    seen = {"w0": np.full(1, 1e-2), "w": np.full(size, 1e-2), "v": np.full((size, FACTORS), 1e-2)}
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            rows = order[a : a + BATCH]
            ids, values, first = _design(stats[rows], [cells[r] for r in rows], *shape.values())
            z, s, vx = _forward(model, ids, values, first)
            slope = (_sigmoid(z) - y[rows]) / len(rows)
            each = np.repeat(slope, np.diff(first)) * values
            grad_v = each[:, None] * (np.repeat(s, np.diff(first), axis=0) - vx)
            used, at = np.unique(ids, return_inverse=True)
            gw = np.bincount(at, each, len(used)) + DECAY * model["w"][used]
            gv = np.column_stack([np.bincount(at, grad_v[:, f], len(used)) for f in range(FACTORS)]) + DECAY * model["v"][used]
            for name, g, where in (("w0", np.array([slope.sum()]), slice(None)), ("w", gw, used), ("v", gv, used)):
                seen[name][where] += g * g
                model[name][where] -= RATE * g / np.sqrt(seen[name][where])
    return model


def predict(model, stats: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
    ids, values, first = _design(stats, cells, *(model[k] for k in ("mean", "scale", "low", "high")))
    return _sigmoid(_forward(model, ids, values, first)[0])


def _train(batches):
    stats, cells, y = [], [], []
    for batch in batches:
        stats += batch.column("stats").to_pylist()
        cells += [np.asarray(c, np.int64) for c in batch.column("cells").to_pylist()]
        y += batch.column("quality").to_pylist()
    out = io.BytesIO()
    if y:
        np.savez(out, **fit(np.array(stats), cells, np.array(y, np.float64)))
    yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])


def _told(docs: DataFrame) -> DataFrame:
    """docs with the metadata column n_chars as a number; null where docs has none."""
    return docs.withColumn("n_chars", F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long"))


def train_quality(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | None:
    """A model of labels.quality, fitted on at most SAMPLE labelled rows; None without any.

    The rows are those with the least xxhash64(doc_id). Rows with a null doc_id or quality are left
    out; a doc_id with several labels counts with its least. Fitting is one task over the rows'
    features; the driver gets the parameters, whose number is fixed.
    """
    wanted = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    # a range of hashes with about twice as many rows first, so that what is sorted for the limit does not grow
    whole = wanted.count()
    if whole > 2 * SAMPLE:
        wanted = wanted.where(F.xxhash64("doc_id") < int(-(2.0**63) + 2.0**64 * 2 * SAMPLE / whole))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def extract(batch):
        stats, cells = features(batch.column("text"), batch.column("n_chars"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array(list(stats), pa.list_(pa.float64())), pa.array(cells, pa.list_(pa.int64()))],
            names=["doc_id", "quality", "stats", "cells"],
        )

    sample = _told(docs).select("doc_id", "text", "n_chars").join(F.broadcast(wanted), "doc_id")  # SAMPLE rows of two numbers
    rows = map_text(sample.select("doc_id", "quality", "text", "n_chars"), extract, "doc_id long, quality double, stats array<double>, cells array<long>")
    rows = rows.repartition(1).sortWithinPartitions("doc_id", "cells", "stats")
    model = rows.mapInArrow(_train, "model binary").collect()
    blob = max((r.model for r in model), key=len, default=b"")
    return dict(np.load(io.BytesIO(blob))) if blob else None


def score_quality(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """The rows of docs (any columns) with score: 0 to 1, higher where quality 1 is likelier.

    The metadata is n_chars, where docs has it. Null and empty texts are scored as empty; without a model every score is 0.5. A column named
    score is replaced.
    """
    bare = "n_chars" not in docs.columns
    docs = _told(docs.drop("score")).withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch):
        stats, cells = features(batch.column("text"), batch.column("n_chars"))
        p = predict(shared.value, stats, cells) if shared.value else np.full(len(cells), 0.5)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "score"])

    out = map_text(docs, score, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double"]))
    return out.drop("n_chars") if bare else out


def fold(column: str, parts: int):
    """crc32 of the number as text, modulo parts."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))
