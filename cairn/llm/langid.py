"""Language identification with language-bitmask n-gram filters.

The learned state is a bit-sliced Bloom filter: cells in proportion to the distinct trigrams,
each a mask with one bit a language. A letter trigram sets its languages' bits in a few cells;
the AND of those cells' masks returns all languages that contain it.

In a large corpus a stray text gives most languages most trigrams. So the filter has further
slices of masks, in which a language has the bit of a trigram only if its rate there is a given
share of the trigram's highest rate. A text's hits are counted per language and slice, corrected
for the false positives that the slice's fill implies, and their mean over the slices decides.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import U, cut, map_text, mix, table

#: Cells for each distinct trigram, cells of a trigram, languages of a mask word.
ROOM, HASHES, WORD_BITS = 8, 3, 63
#: Cells at least; numbers of masks up to which a filter goes to every task (384 MB). A larger one stays a table of cells,
#: which the texts' distinct trigrams are joined to; both give the same languages.
FEWEST, MOST = 1 << 12, 3 << 24
#: Trigrams that a task holds before it hands on their counts.
HELD = 1 << 22
#: Shares of a trigram's highest rate in any language that a language needs in each slice; all that contain it are in the first.
SLICES = (0.0, 1 / 16, 1 / 4)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ends): the letter trigrams of all texts and where each text's end among them.

    Every letter is the middle of one trigram; what is no letter counts as a word's edge.
    """
    low = [(t or "").lower() for t in text.to_pylist()]
    codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    codes = np.where(_letters()[codes], codes, 0)
    middle = codes[1:-1] != 0
    keys = ((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[middle]
    ends = np.cumsum([len(t) + 1 for t in low]) - 1  # a separator follows each text
    return keys, np.concatenate([np.zeros(1, np.int64), np.cumsum(middle)])[np.minimum(ends, len(middle))]


def _count(batches):
    """(lang, key, n) over a task's texts."""
    seen: dict[str, list] = {}
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), object)
        for a in range(0, batch.num_rows, 1000):
            keys, ends = trigrams(batch.column("text").slice(a, 1000))
            own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            part = lang[a : a + 1000]
            for name in set(part):
                here = np.unique(keys[np.isin(own, np.flatnonzero(part == name))], return_counts=True)
                old = seen.get(name)
                if old:
                    k, at = np.unique(np.concatenate([old[0], here[0]]), return_inverse=True)
                    here = (k, np.bincount(at, np.concatenate([old[1], here[1]])).astype(np.int64))
                seen[name] = here
            if sum(len(k) for k, _ in seen.values()) > HELD:
                yield from _counts(seen)
                seen = {}
    yield from _counts(seen)


def _counts(seen: dict):
    for name, (k, n) in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["lang", "key", "n"])


def _cells(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cells (of a power of two) of each key, one row for each hash."""
    h = keys.astype(np.uint64)
    return np.stack([(mix(h + U(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))) & U(cells - 1)).astype(np.int64) for i in range(HASHES)])


def learn(docs: DataFrame, most_masks: int | None = None) -> dict:
    """languages (sorted), size and fill of the filter, from docs(text, lang); rows with a null lang or text are left out.

    A filter of up to most_masks (MOST) numbers is cells, by (cell, slice, word of the mask), in the
    driver; a larger one is table, rows (cell, word, a mask for each slice). The driver gets one row
    a language beside that.
    """
    limit = MOST if most_masks is None else most_masks
    known = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    counts = known.mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    names = sorted(r.lang for r in totals.select("lang").collect())
    if not names:
        return {"languages": [], "size": FEWEST, "cells": np.zeros((FEWEST, len(SLICES), 1), np.int64), "fill": np.zeros((0, len(SLICES)))}
    number = docs.sparkSession.createDataFrame([(s, i) for i, s in enumerate(names)], "lang string, number int")
    rate = counts.join(F.broadcast(totals), "lang").join(F.broadcast(number), "lang").withColumn("rate", F.col("n") / F.col("total"))
    most = rate.groupBy("key").agg(F.max("rate").alias("most"))
    bit = F.expr(f"shiftleft(1L, cast(number % {WORD_BITS} as int))")
    masks = [F.bit_or(F.when(F.col("rate") >= s * F.col("most"), bit).otherwise(0)).alias(f"m{i}") for i, s in enumerate(SLICES)]
    held = cut(rate.join(most, "key").groupBy("key", F.floor(F.col("number") / WORD_BITS).cast("int").alias("word")).agg(*masks))
    distinct = most.count()
    size = max(FEWEST, 1 << (ROOM * distinct - 1).bit_length())
    columns = [f"m{i}" for i in range(len(SLICES))]

    def place(batches):
        for batch in batches:
            cells = _cells(batch.column("key").to_numpy(), size)
            rest = [pa.array(np.tile(batch.column(c).to_numpy(), HASHES)) for c in ("word", *columns)]
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), *rest], names=["cell", "word", *columns])

    rows = held.mapInArrow(place, "cell long, word int, " + ", ".join(f"{c} long" for c in columns)).groupBy("cell", "word").agg(*(F.bit_or(c).alias(c) for c in columns))
    words = (len(names) - 1) // WORD_BITS + 1
    if size * len(SLICES) * words > limit:
        kept = table(rows)
        return {"languages": names, "size": size, "table": kept, "fill": _fill(kept, len(names), size)}
    rows = rows.toArrow()
    cells = np.zeros((size, len(SLICES), words), np.int64)
    for i, c in enumerate(columns):
        cells[rows.column("cell").to_numpy(), i, rows.column("word").to_numpy()] = rows.column(c).to_numpy()
    # (language, slice): share of cells that hold the bit
    fill = np.array([(cells[:, :, i // WORD_BITS] >> (i % WORD_BITS) & 1).mean(0) for i in range(len(names))])
    return {"languages": names, "size": size, "cells": cells, "fill": fill}


def _bits(mask: np.ndarray) -> np.ndarray:
    """(row, bit) of masks as zeros and ones."""
    return (mask[:, None] >> np.arange(WORD_BITS)) & 1


def _fill(cells: DataFrame, languages: int, size: int) -> np.ndarray:
    """(language, slice): share of cells that hold the bit; tasks hand on one row a word of languages."""
    columns = [f"m{i}" for i in range(len(SLICES))]

    def run(batches):
        for batch in batches:
            word = batch.column("word").to_numpy()
            for w in np.unique(word):
                n = np.stack([_bits(batch.column(c).to_numpy()[word == w]).sum(0) for c in columns], 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(WORD_BITS, dtype=np.int32) + int(w) * WORD_BITS), *(pa.array(n[:, i]) for i in range(len(SLICES)))], names=["number", *columns])

    rows = cells.mapInArrow(run, "number int, " + ", ".join(f"{c} long" for c in columns)).groupBy("number").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    out = np.zeros((languages, len(SLICES)))
    number = rows.column("number").to_numpy()
    for i, c in enumerate(columns):
        out[number[number < languages], i] = rows.column(c).to_numpy()[number < languages] / size
    return out


def containing(keys: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The masks (key, slice, word) of the languages that the filter says contain each key: the AND of its cells."""
    rows = _cells(keys, len(cells))
    out = cells[rows[0]]
    for row in rows[1:]:
        out &= cells[row]
    return out


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs (any columns) with lang_pred and score (0 to 1: the corrected share of trigrams that the language contains).

    lang_pred is `und`, with score 0, where the text is null or has no letter, or nothing was
    learned. Ties go to the language first in order. Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    wrong = np.minimum(model["fill"], 0.999) ** HASHES
    if "table" in model:
        return _predict_joined(docs, model, wrong)
    shared = docs.sparkSession.sparkContext.broadcast({"languages": model["languages"], "cells": model["cells"], "wrong": wrong})

    def decide(batch):
        names, wrong = shared.value["languages"], shared.value["wrong"]
        keys, ends = trigrams(batch.column("text"))
        n = np.diff(ends, prepend=0)
        share = np.zeros((len(n), max(1, len(names))))
        kinds, at = np.unique(keys, return_inverse=True)
        masks = containing(kinds, shared.value["cells"])
        for i in range(len(names)):
            bits = (masks[:, :, i // WORD_BITS] >> (i % WORD_BITS) & 1).astype(np.float64)
            # of each trigram its corrected hits, the mean of the slices
            value = ((bits - wrong[i]) / (1 - wrong[i])).mean(1)[at]
            sums = np.concatenate([np.zeros(1), np.cumsum(value)])[ends]
            share[:, i] = np.diff(sums, prepend=0) / np.maximum(n, 1)
        share = np.round(share, 9)  # ties are ties however the sums are added up
        best = share.argmax(1)
        sure = (n > 0) & bool(names)
        pred = [names[b] if s else "und" for b, s in zip(best, sure)]
        score = np.where(sure, np.clip(share[np.arange(len(n)), best], 0, 1), 0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return map_text(docs, decide, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string", "score double"]))


def _predict_joined(docs: DataFrame, model: dict, wrong: np.ndarray) -> DataFrame:
    """predict with a filter that is a table: each distinct trigram meets its cells once, each distinct text its trigrams' masks."""
    columns, size, names = [f"m{i}" for i in range(len(SLICES))], model["size"], model["languages"]

    def count(batch):
        """(h, key, n): the distinct trigrams of each text."""
        keys, ends = trigrams(batch.column("text"))
        own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        order = np.lexsort((keys, own))
        keys, own = keys[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])])) if len(keys) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("h").take(pa.array(own[first])), pa.array(keys[first]), pa.array(np.diff(np.append(first, len(keys))))], names=["h", "key", "n"])

    def place(batches):
        for batch in batches:
            key = batch.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(key, HASHES)), pa.array(np.repeat(np.arange(HASHES, dtype=np.int32), len(key))), pa.array(_cells(key, size).ravel())], names=["key", "k", "cell"])

    def hits(batches):
        """(h, number, value): of a text's trigrams, what they add to the score of each language whose bits they have."""
        for batch in batches:
            h, n, word = batch.column("h"), batch.column("n").to_numpy(), batch.column("word").to_numpy()
            value = np.zeros((len(n), WORD_BITS))
            for w in np.unique(word):
                here = word == w
                last = min(WORD_BITS, len(names) - int(w) * WORD_BITS)
                weight = 1 / (1 - wrong[int(w) * WORD_BITS :][:last]) / len(SLICES)
                for i, c in enumerate(columns):
                    value[here, :last] += _bits(batch.column(c).to_numpy()[here])[:, :last] * weight[:, i]
            rows, bits = np.nonzero(value)
            yield pa.RecordBatch.from_arrays([h.take(pa.array(rows)), pa.array((word[rows].astype(np.int64) * WORD_BITS + bits).astype(np.int32)), pa.array(value[rows, bits] * n[rows])], names=["h", "number", "value"])

    docs = docs.withColumn("_text_key", F.sha2("text", 256))
    texts = docs.where("text is not null").groupBy(F.col("_text_key").alias("h")).agg(F.first("text").alias("text"))
    grams = table(map_text(texts, count, "h string, key long, n long"))
    asked = grams.select("key").distinct().mapInArrow(place, "key long, k int, cell long")
    # a trigram is in the languages that all its cells name
    found = asked.join(model["table"], "cell").groupBy("key", "word").agg(F.count("*").alias("k"), *(F.bit_and(c).alias(c) for c in columns)).where(F.col("k") == HASHES).drop("k")
    values = grams.join(found, "key").select("h", "n", "word", *columns).mapInArrow(hits, "h string, number int, value double").groupBy("h", "number").agg(F.sum("value").alias("value"))
    # without a hit a language has what the correction takes off
    base = (-wrong / (1 - wrong)).mean(1)
    spark = docs.sparkSession
    numbered = spark.createDataFrame([(i, name, float(b)) for i, (name, b) in enumerate(zip(names, base))], "number int, name string, base double")
    total = grams.groupBy("h").agg(F.sum("n").alias("total"))
    shares = values.join(F.broadcast(numbered), "number").join(total, "h").select("h", F.round(F.col("value") / F.col("total") + F.col("base"), 9).alias("share"), F.negative("number").alias("number"), "name")
    least = int(base.argmax())
    floor = total.select("h", F.lit(round(float(base[least]), 9)).alias("share"), F.lit(-least).alias("number"), F.lit(names[least]).alias("name"))
    best = shares.union(floor).groupBy(F.col("h").alias("_text_key")).agg(F.max(F.struct("share", "number", "name")).alias("_found"))
    found = docs.join(best, "_text_key", "left")
    score = F.when(F.col("_found").isNull(), 0.0).otherwise(F.greatest(F.least("_found.share", F.lit(1.0)), F.lit(0.0)))
    return found.withColumns({"lang_pred": F.coalesce("_found.name", F.lit("und")), "score": score}).drop("_text_key", "_found")
