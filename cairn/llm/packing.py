"""Best-fit packing of tokenized documents into fixed-length sequences, by hierarchical residual packing.

Documents are cut into pieces of at most `length` tokens and dealt among groups by a hash. A
group packs its pieces best-fit in decreasing order. Bins that are nearly full are final; the
underfull bins of a group go on as items of one piece each, eight groups at a time, into
further best-fit rounds up a tree. Only sizes travel.

Two bins fit together only if one of them is at most half full. So in a round with d such bins
no more than d bins of a group can take one of them, and its emptiest do as well as any others:
a group hands on its bins that are at most half full and the d emptiest of the others that
could take the emptiest bin of all. Best fit leaves one bin at most half full in a group, so d
is at most the number of groups and falls by eight with each round.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut

LENGTH = 2048
#: Pieces that a group should hold, groups that meet in a node of the tree, free tokens of a nearly full bin.
GROUP_ROWS, FAN_IN, NEARLY = 20_000, 8, 8
#: Texts' words whose ids a task remembers.
REMEMBERED = 500_000

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0  -     　]")


def _vocabulary(path: str) -> dict[bytes, int]:
    """Ids by the tokens' bytes, from a tokenizers file of a byte-level BPE; its letters stand for bytes."""
    model = json.loads(Path(path).read_text())["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}


class Ids(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes; remembers those of words.

    A text is cut at its lone spaces, where the tokenizer's own splitting cuts too, and a space
    goes to the word behind it. So a word and its space have the same ids in every text, and
    only new words are encoded. They are encoded by the tokenizers file's vocabulary.
    """

    def __init__(self, path: str):
        super().__init__()
        ranks = _vocabulary(path)
        for special in json.loads(Path(path).read_text()).get("added_tokens", ()):
            ranks.pop(special["content"].encode(), None)  # in a text it is ordinary text
        self.encode = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = array("I", self.encode(" " + word)).tobytes()
        return ids

    def of(self, text: str) -> bytes:
        words = text.split(" ")
        if "" in words or "\n " in text or " \n" in text or _OTHER_SPACE.search(text):
            words = _LONE_SPACE.split(text)
        if len(self) > REMEMBERED:
            self.clear()
        first = array("I", self.encode(words[0])).tobytes()
        return first + b"".join(map(self.__getitem__, words[1:]))


@lru_cache(1)
def _ids(path: str) -> Ids:
    """One encoder for each worker process, over all of its tasks."""
    return Ids(path)


def pieces_of(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; where it is cut, the first piece may be the shorter one."""
    first = n if n <= length else n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, where asked for) of every row of docs(doc_id, text)."""

    def run(batches):
        encode = _ids(tokenizer).of
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                texts = batch.column("text").slice(a, 1000).to_pylist()
                rows = []
                for d, text in zip(batch.column("doc_id").slice(a, 1000).to_pylist(), texts):
                    raw = encode(text or "") + b"\0\0\0\0"  # id 0 ends a document
                    for k, (s, n) in enumerate(pieces_of(len(raw) // 4, length)):
                        part = raw[4 * s : 4 * (s + n)]
                        rows.append((d, k, s, n, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if ids else None))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns[: 5 + ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, packed best-fit in the given order.

    Bins wait by free space; the nonempty ones are bits of one number, so the least sufficient
    free space is its lowest bit from the item's size on.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, n = 0, 0
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = waiting[left].pop()
            if not waiting[left]:
                free ^= 1 << left
        else:
            b, left, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - left
        left -= size
        if left:
            waiting[left].append(b)
            free |= 1 << left
    return bins, offsets


def _packer(capacity: int, size: str, ties: list[str], key: str, names: tuple[str, str]):
    """A grouped function: the group's rows, largest first, with their bin (numbered within all groups) and offset."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(size, "descending"), *((t, "ascending") for t in ties)])
        bins, offsets = best_fit(group.column(size).to_numpy(), capacity)
        number = (group.column(key).to_numpy().astype(np.int64) << 32) + bins
        return group.append_column(names[0], pa.array(number)).append_column(names[1], pa.array(offsets))

    return run


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """pieces (doc_id, piece, length and any others) with sequence_id and offset.

    Every sequence holds at most `length` tokens, gapless from offset 0. Ties go by doc_id and
    piece, nulls of doc_id last; repeated rows are packed each for itself; no rows give none.
    """
    pieces = cut(pieces)
    groups = max(1, -(-pieces.count() // GROUP_ROWS))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(groups)).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    first = dealt.groupBy("group").applyInArrow(_packer(length, "length", ["doc_id", "piece"], "group", ("bin", "at")), schema + ", bin long, at long")
    first = cut(first)
    bins = first.groupBy("bin", "group").agg(F.sum("length").alias("used"))
    rounds = 0
    moved = None  # (bin, sequence_id, base): where the bins that went on have ended
    while groups > 1:
        half = bins.where(2 * F.col("used") <= length).agg(F.count("*").alias("d"), F.min("used").alias("least")).first()
        if not half.d:
            break  # no two bins fit together
        groups = -(-groups // FAN_IN)
        order = F.row_number().over(Window.partitionBy("group", F.col("used") * 2 <= length).orderBy("used", "bin"))
        handed = bins.where((F.col("used") < length - NEARLY) & (F.col("used") + half.least <= length)).withColumn("r", order)
        handed = handed.where((2 * F.col("used") <= length) | (F.col("r") <= half.d)).drop("r")
        handed = handed.withColumn("group", F.floor(F.col("group") / FAN_IN).cast("long"))
        rounds += 1  # a round's bins are numbered apart from those of the rounds before
        handed = handed.withColumn("node", F.col("group") + F.lit(rounds << 27))
        merged = handed.groupBy("group").applyInArrow(_packer(length, "used", ["bin"], "node", ("to", "at")), "bin long, group long, used long, node long, to long, at long")
        merged = cut(merged)
        step = merged.select("bin", F.col("to").alias("sequence_id"), F.col("at").alias("base"))
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("bin").alias("sequence_id"), F.col("sequence_id").alias("next"), F.col("base").alias("more"))
            moved = moved.join(later, "sequence_id", "left").select("bin", F.coalesce("next", "sequence_id").alias("sequence_id"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        bins = merged.groupBy(F.col("to").alias("bin"), "group").agg(F.sum("used").alias("used"))
    if moved is None:
        return first.withColumnsRenamed({"bin": "sequence_id", "at": "offset"}).drop("group")
    out = first.join(moved, "bin", "left").withColumn("sequence_id", F.coalesce("sequence_id", "bin"))
    return out.withColumn("offset", F.col("at") + F.coalesce("base", F.lit(0))).drop("group", "bin", "at", "base")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs(doc_id, text).

    A null text is empty: its only token is the closing id 0. A null doc_id keeps its row.
    """
    return pack(token_pieces(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), length), length)


def sequences(packed: DataFrame, docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """sequence_id and ids of the packed sequences; doc_id must name one row of docs."""
    ids = token_pieces(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), length, ids=True).select("doc_id", "piece", "ids")
    rows = packed.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    # a sequence's ids are at most `length` numbers
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda r: r["ids"])).alias("ids"))
