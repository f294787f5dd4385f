"""Best-fit packing with Martello-Toth dominance reduction.

Documents become token ids; only those above the capacity are cut, the short piece first.  What the
packer needs of the corpus is the number of pieces of each length, 2,048 counters at most.  On them,
sets of up to three lengths that provably dominate every alternative are fixed for good, the instance
shrinks, and best-fit decreasing packs the rest.  The plan says how many sequences share which
lengths; pieces take their places by their rank among pieces of their length, found with a two-level
prefix sum (length and one of 256 hash buckets), so no task holds a length.

Defined results: null text counts as empty and still ends in the end id, so every document has a
piece; null ids and repeated rows are pieces like others; an empty table gives no rows; other columns
are never read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_number, materialise

CAPACITY, END = 2048, 0
VOCABULARY = "byte_bpe_50k"
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids by the byte-level BPE of `vocabulary`.json.

    The same vocabulary as ranks is about four times as fast and gives the same ids; it is used for
    texts of Latin script, where the tests compare the two code point by code point.  Other texts, and
    those with the special token's name, go to the JSON tokenizer itself.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, vocabulary: str):
        import base64
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {}
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self._fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._plain = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self._other = re.compile(r"[^\x00-ɏ]|<\|endoftext\|>").search

    @property
    def width(self) -> str:
        """Of ids as bytes: little-endian, two bytes where all ids fit."""
        return "<u2" if self._plain.get_vocab_size() <= 1 << 16 else "<u4"

    @classmethod
    def of(cls, vocabulary: str) -> Encoder:
        if vocabulary not in cls._made:
            cls._made[vocabulary] = cls(vocabulary)
        return cls._made[vocabulary]

    def plain(self, text: str) -> list[int]:
        return self._plain.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        return self.plain(text) if self._other(text) else self._fast.encode_ordinary(text)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, doc_id: str, text: str, capacity: int, vocabulary: str, with_ids: bool) -> DataFrame:
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(vocabulary)
        width = encode.width
        for batch in batches:
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                found = np.array([*encode(t), END], dtype="<u4")
                for k, (s, n) in enumerate(cuts(len(found), capacity)):
                    part = found[s : s + n]
                    owner.append(row), piece.append(k), start.append(s), length.append(n)
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(width).tobytes())
            out = {
                "doc_id": batch.column(0).take(pa.array(owner, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            } | ({"ids": pa.array(ids, pa.binary())} if with_ids else {})
            yield pa.RecordBatch.from_pydict(out)

    return source.mapInArrow(cut, PIECES.format(id=id_type) + (", ids binary" if with_ids else ""))


class Lengths:
    """A multiset of lengths with the queries that the packers ask."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            self.sizes.pop(bisect_right(self.sizes, size) - 1)

    def largest(self, room: int, used: tuple[int, ...]) -> int | None:
        """The largest length up to `room`, where `used` items are no longer there."""
        at = bisect_right(self.sizes, room) - 1
        while at >= 0:
            if self.n[self.sizes[at]] > used.count(self.sizes[at]):
                return self.sizes[at]
            at -= 1
        return None

    def smallest(self, k: int, used: int) -> list[int]:
        """The k smallest items but one of length `used`."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(self.n[s] - (s == used), k - len(out))
            if len(out) == k:
                break
        return out


def dominating(left: Lengths, size: int, capacity: int) -> tuple[int, ...] | None:
    """A set with one item of `size` that dominates every other such set; None where none is proven.

    Alone if nothing fits beside it; with k, the largest that fits, if that fills the sequence or only
    one more item can fit; with k and b if two can fit at most and no pair that fits has a smaller item
    above b.
    """
    room = capacity - size
    k = left.largest(room, (size,))
    if k is None:
        return (size,)
    if k == room:
        return (size, k)
    low = left.smallest(3, size)
    if sum(low[:2]) > room or len(low) < 2:
        return (size, k)
    if len(low) == 3 and sum(low) <= room:
        return None
    b = left.largest(room - k, (size, k))
    half = left.largest(room // 2, (size,))
    if b is not None and half is not None and b >= half:
        return (size, k, b)
    return None


def times(left: Lengths, items: tuple[int, ...]) -> int:
    return min(left.n[s] // items.count(s) for s in items)


def reduce(left: Lengths, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Fix dominating sets, from the largest length down; `left` keeps what no set is proven for."""
    fixed = []
    for size in sorted(left.n, reverse=True):
        while left.n.get(size):
            items = dominating(left, size, capacity)
            if items is None:
                break
            k = times(left, items) if sum(items) == capacity or len(items) == 1 else steady(left, items)
            for s in items:
                left.take(s, k)
            fixed.append((runs(items), k))
    return fixed


def steady(left: Lengths, items: tuple[int, ...]) -> int:
    """How often the same set stays dominating: until one of its lengths, or a smallest item, runs out.

    The proofs use the largest lengths that fit and the three smallest items; while each length used
    keeps more items than the proof looks at, they don't change.
    """
    return max(1, min((left.n[s] - 3) // items.count(s) for s in items))


def runs(items: tuple[int, ...] | list[int]) -> list[tuple[int, int]]:
    """(length, how often), longest first."""
    return [(s, items.count(s)) for s in sorted(set(items), reverse=True)]


def best_fit(left: Lengths, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over counters: groups of sequences with equal contents move together."""
    groups: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []

    def put(room: int, content: list[tuple[int, int]], n: int) -> None:
        if room not in groups:
            groups[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        groups[room].append((content, n))

    for size in sorted(left.n, reverse=True):
        n = left.n[size]
        while n:
            at = bisect_right(rooms, size - 1)
            if at == len(rooms):
                each = capacity // size
                if n >= each:
                    put(capacity - each * size, [(size, each)], n // each)
                if n % each:
                    put(capacity - n % each * size, [(size, n % each)], 1)
                break
            room = rooms[at]
            content, m = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = min(room // size, n)
            moved = min(m, n // each)
            if m > moved:
                put(room, content, m - moved)
            put(room - each * size, [*content, (size, each)], moved)
            n -= moved * each
    return [g for gs in groups.values() for g in gs]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """(contents, number of sequences); contents are (length, how often) runs, laid out in order."""
    left = Lengths(counts)
    fixed = reduce(left, capacity)
    return fixed + best_fit(left, capacity)


def places(packed: list[tuple[list[tuple[int, int]], int]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By length: (first rank, end rank, first sequence, offset, how often in a sequence)."""
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for content, n in packed:
        offset = 0
        for size, each in content:
            low = ranks.get(size, 0)
            ranks[size] = low + n * each
            out.setdefault(size, []).append((low, low + n * each, sequence, offset, each))
            offset += size * each
        sequence += n
    return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one row a piece; ids as bytes of Encoder.width."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, doc_id, text, capacity, vocabulary, with_ids), "pack-pieces")
    name = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece"))
    cut = cut.withColumn("bucket", hex_number(F.md5(name.cast("binary")), 1, 2).cast("int"))
    cells = materialise(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), "pack-cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    slots = [(size, *at) for size, xs in places(plan(counts, capacity)).items() for at in xs]
    slots = spark.createDataFrame(slots, "length long, low long, high long, sequence long, offset long, each long")
    # at most three groups a length are ever made and 63 lengths fit one, so the table is bounded by `capacity` alone
    slots = F.broadcast(slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "sequence", "offset", "each"))).alias("slots")))
    earlier = Window.partitionBy("length").orderBy("bucket")
    starts = cells.select("length", "bucket", (F.sum("n").over(earlier) - F.col("n")).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = cut.withColumn("rank", F.row_number().over(inside)).join(starts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rank") - 1).join(slots, "length")
    slot = F.element_at(F.filter("slots", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"])), 1)
    placed = ranked.withColumn("slot", slot).withColumn("at", F.col("rank") - F.col("slot.low"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []),
        (F.col("slot.sequence") + F.floor(F.col("at") / F.col("slot.each"))).alias("sequence_id"),
        (F.col("slot.offset") + F.col("at") % F.col("slot.each") * F.col("length")).alias("offset"),
    )


def write_sequences(docs: DataFrame, path: str, **options) -> None:
    """Write (sequence_id, ids): a sequence's pieces in order of their offsets, `capacity` ids at most, as bytes of Encoder.width."""
    packed = pack(docs, with_ids=True, **options).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    packed.select("sequence_id", joined.alias("ids")).write.parquet(path)
