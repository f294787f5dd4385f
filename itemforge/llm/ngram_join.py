"""N-gram Jaccard join with token-combination prefixes.

Texts become sets of hashed word shingles; equal sets collapse to one representative first.  Two sets
link when shared * scale >= similarity * union, in whole numbers.

Shingles have one global order: by document count, unique ones first (counts in steps of an eighth of an
octave, then by hash), then those that were not counted (the upper part of the hash range, which prefixes
hardly reach).  Of a set of n, e = n * (scale - similarity) // scale members at most can be missing from a
partner, and d = n * (scale - similarity) // similarity bounds what either lacks.  So a linked pair

* shares a member of both prefixes of e + 1: where it is rare, it is a key by itself (unique ones
  can't be shared and are no keys);
* or only members from the frequent classes on, and then, in both prefixes extended to e + d + 2, some
  two shared members are neighbours in both orders: neighbouring pairs of frequent members are keys.

Counts are a dictionary distributed by hash.  Batches of documents ask each of its parts for their distinct
shingles, with their counts in the batch, and get back one byte a shingle; so a shingle that all documents
share costs an entry a batch, and nothing of it passes the driver.

Either way a linked pair shares a key, so nothing is lost, and no set has more than n keys.  Sizes of
linked sets differ by the similarity's ratio at most, so a key counts within two neighbouring bands of
sizes only.  Sets that share keys form clusters (components over key hubs).  A cluster is compared in
one task.  A larger one is cut in bounded blocks, or, where that sends fewer rows, in the lists of sets
under its keys, those of one hub together, long lists again in blocks.  Blocks are compared each by itself first, then all with the
sets of most links; what those join needs no more comparing with each other, so only sets outside the
largest component so far meet all blocks.  Tasks compare by products of membership matrices and return each
set's smallest linked id, never pairs.

Defined results: null and empty texts have no shingles and link with nothing; a text with fewer words
than a shingle has one, the whole sequence; a row of null id is counted, linked with nothing and has a
null component; rows that share an id are one node; repeated rows are copies; ties of equal sets go to the
smallest id; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MADE, IdFilter, components, discard, materialise, spread_join

WORDS, SIMILARITY, SCALE = 3, 90, 100
#: A shingle in so many documents is frequent; the part of all shingles that is counted beyond the longest prefix, so
#: that prefixes hold few frequent ones.
FREQUENT, BEYOND = 32, 0.12
#: Rows and shingles that one task compares; keys of so few rows go by their hub within large clusters; sets of most links that a large cluster tries.
GROUP_ROWS, GROUP_SHINGLES, SHORT_LIST, LEADERS = 1024, 2_000_000, 64, 64
#: Shingles that one counting task holds, bytes hashed at once, and of a slice of a batch.
COUNTED, CHUNK, SLICE = 2_000_000, 1 << 18, 2 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: A random value for each byte, and an odd base with its inverse modulo 2**64.
BYTES = np.random.default_rng(20).integers(0, 2**64, size=256, dtype=np.uint64)
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of INVERSE below `size`, by doubling."""
    out = []
    for base in (BASE, INVERSE):
        p, k = np.ones(size, dtype=np.uint64), 1
        while k < size:
            p[k : 2 * k] = p[: min(k, size - k)] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        out.append(p)
    return out[0], out[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word; a hash doesn't depend on the place."""
    b = np.frombuffer(data, dtype=np.uint8)
    edge = np.diff(np.concatenate([[True], SPACE[b], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    size = max(CHUNK, 1 << int(len(b)).bit_length())
    up, down = powers(size)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(BYTES[b] * up[: len(b)], dtype=np.uint64)])
    h = (total[end] - total[start]) * down[start]
    return start, (h ^ (h >> np.uint64(32))) * MIX


def cut_words(data: bytes) -> np.ndarray:
    """Hashes of the words of one text, taken in chunks that end at white space."""
    parts, at = [], 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        parts.append(word_hashes(data[at:end])[1])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = np.full(max(0, len(h) - n + 1), n, dtype=np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * MIX + h[i : len(h) - n + 1 + i]
    out ^= out >> np.uint64(32)
    out *= MIX
    return out ^ (out >> np.uint64(29))


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each UTF-8 text, A-Z in lower case."""
    at = 0
    while at < len(texts):
        some, size = [texts[at]], len(texts[at])
        while at + len(some) < len(texts) and size < CHUNK // 2:
            some.append(texts[at + len(some)])
            size += len(some[-1]) + 1
        at += len(some)
        if len(some) == 1:
            bounds, h = np.array([0]), cut_words(some[0].lower())
            bounds = np.array([0, len(h)])
        else:
            start, h = word_hashes(b" ".join(some).lower())
            bounds = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in some]))
        every = runs(h, n)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= n:
                yield np.unique(every[a : b - n + 1])
            else:
                yield runs(h[a:b], b - a) if b > a else h[:0]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def sets_of(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    return shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), n)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about SLICE bytes, so that a task's arrays stay small."""
    for b in batches:
        rows = max(1, b.num_rows * SLICE // max(1, b.nbytes))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def allowances(size: int, similarity: int, scale: int) -> tuple[int, int]:
    """e and d of the module's description."""
    return size * (scale - similarity) // scale, size * (scale - similarity) // similarity


def levels_of(counts: np.ndarray) -> np.ndarray:
    """0 for a unique shingle, else eight steps an octave, in one byte."""
    return np.where(counts < 2, 0, np.minimum(255, np.floor(8 * np.log2(np.maximum(counts, 1))))).astype(np.uint8)


def keys_of(low: np.ndarray, levels: np.ndarray, rest: np.ndarray, size: int, similarity: int, scale: int) -> np.ndarray:
    """Keys of a set of `size`: its counted members with their levels, and as many of the rest as its prefix may reach."""
    if size < 2:
        return low[:0]  # equal sets only, and those have collapsed
    e, d = allowances(size, similarity, scale)
    order = np.lexsort((low, levels))
    members = np.concatenate([low[order], rest])[: e + d + 2]
    level = np.concatenate([levels[order].astype(np.int64), np.full(len(rest), 256)])[: e + d + 2]
    bar = int(levels_of(np.array([FREQUENT]))[0])
    single = members[: e + 1][(level[: e + 1] > 0) & (level[: e + 1] < bar)]
    frequent = level >= bar
    both = np.flatnonzero(frequent[:-1] & frequent[1:])
    left, right = members[both], members[both + 1]
    return np.unique(np.concatenate([single, ((left ^ (left >> np.uint64(31))) * MIX + right) * MIX]))


def linked(ids: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, similarity: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id of its component, links) of each of the given sets; ids ascend.  Pairs whose sides are both 0 aren't compared."""
    m, first = len(sets), np.flatnonzero(sides)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    every = np.concatenate(sets)
    every.sort()
    names = np.unique(every[1:][every[1:] == every[:-1]])  # members of two sets or more
    del every
    row, column = [], []
    for i, s in enumerate(sets):
        at = np.searchsorted(names, s)
        at = at[at < len(names)][names[at[at < len(names)]] == s[at < len(names)]].astype(np.int32)
        row.append(np.full(len(at), i, dtype=np.int32)), column.append(at)
    row, column = np.concatenate(row), np.concatenate(column)
    both = np.zeros((len(first), m), dtype=np.float32 if size.max(initial=0) < 1 << 24 else np.float64)  # exact either way
    step = max(1, 2_000_000 // m)
    for start in range(0, len(names), step):
        at = (column >= start) & (column < start + step)
        part = np.zeros((m, step), dtype=np.float32)
        part[row[at], column[at] - start] = 1
        both += part[first] @ part.T
    del row, column
    near = np.zeros(both.shape, dtype=bool)
    for k, i in enumerate(first):
        shared = both[k].astype(np.int64)
        near[k] = (scale * shared >= similarity * (size[i] + size - shared)) & (size[i] > 0) & (size > 0) | (ids == ids[i])
    links = np.zeros(m, dtype=np.int64)
    links[first] = near.sum(axis=1) - 1
    label = np.arange(m, dtype=np.int32)
    top = np.int32(m)
    while True:
        lower = label.copy()
        lower[first] = np.minimum(lower[first], np.where(near, label[None, :], top).min(axis=1, initial=m))
        lower = np.minimum(lower, np.where(near, lower[first, None], top).min(axis=0, initial=m))
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            return ids[label], links
        label = lower


def indexed(source: DataFrame, n: int, limit: np.uint64, similarity: int, scale: int) -> DataFrame:
    """A row a batch of documents: ids, sizes, 128-bit signatures, the members below `limit`, and what prefixes may need of the rest."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            size, high, low, counted, rest = [], [], [], [], []
            for s in sets_of(b, n):
                d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8")
                size.append(len(s)), high.append(d[0]), low.append(d[1])
                k = int(np.searchsorted(s, limit))
                counted.append(s[:k]), rest.append(s[k : k + max(0, sum(allowances(len(s), similarity, scale)) + 2 - k)])
            if size:
                longs = lambda xs: pa.array([np.array(xs, dtype=np.int64)], pa.list_(pa.int64()))
                whole = lambda xs: pa.array([packed(short(np.concatenate(xs))).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), longs(size), longs(high), longs(low),
                     longs([len(x) for x in counted]), whole(counted), longs([len(x) for x in rest]), whole(rest)],
                    ["batch", "ids", "sizes", "s1", "s2", "n_counted", "counted", "n_rest", "rest"],
                )

    return source.mapInArrow(index, "batch string, ids array<long>, sizes array<long>, s1 array<long>, s2 array<long>, n_counted array<long>, counted binary, n_rest array<long>, rest binary")


def short(members: np.ndarray) -> np.ndarray:
    """48-bit prefixes, by which shingles are counted, ordered and keyed.

    Where two agree both count as one that occurs twice: overlaps and candidates only grow.
    """
    return members >> np.uint64(16)


def packed(prefixes: np.ndarray) -> np.ndarray:
    """Rows of six bytes."""
    return np.ascontiguousarray(prefixes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def unpacked(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    raw[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return raw.view("<u8").ravel()


def edges_of(prefixes: np.ndarray, bits: int) -> np.ndarray:
    """Where the parts of the dictionary begin and end among sorted prefixes."""
    return np.r_[0, np.searchsorted(prefixes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(48 - bits)), len(prefixes)]


def keyed(source: DataFrame, n: int, similarity: int, scale: int) -> DataFrame:
    """(doc_id, n, s1, s2, keys): size, 128-bit signature and keys of each row's set."""
    away = (scale - similarity) / scale
    limit = np.uint64(min(2**64 - 1, int(2**64 * (away + away * scale / similarity + BEYOND))))
    total = (source.agg(F.sum(F.length("text"))).first()[0] or 0) // 6
    bits = min(20, max(4, (total // COUNTED).bit_length()))
    base = materialise(indexed(source, n, limit, similarity, scale), "ngram-batches", "none")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, counted in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                value, count = np.unique(unpacked(counted.as_py()), return_counts=True)
                edge, more = edges_of(value, bits), np.flatnonzero(count > 1)
                six = packed(value)
                repeats = np.stack([more, count[more]], axis=1).astype("<u4") if len(more) else np.zeros((0, 2), dtype="<u4")
                at = np.searchsorted(more, edge)
                parts = [p for p in range(1 << bits) if edge[p + 1] > edge[p]]
                local = lambda p: (repeats[at[p] : at[p + 1]] - np.array([edge[p], 0], dtype="<u4")).tobytes()
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(parts, pa.int32()),
                    "batch": pa.array([batch] * len(parts), pa.string()),
                    "shingles": pa.array([six[edge[p] : edge[p + 1]].tobytes() for p in parts], pa.binary()),
                    "repeats": pa.array([local(p) for p in parts], pa.binary()),
                })

    def count(t: pa.Table) -> pa.Table:
        values, times = [], []
        for s, r in zip(t.column("shingles"), t.column("repeats"), strict=True):
            values.append(unpacked(s.as_buffer()))
            each = np.ones(len(values[-1]), dtype="<u4")
            pairs = np.frombuffer(r.as_buffer(), dtype="<u4").reshape(-1, 2)
            each[pairs[:, 0]] = pairs[:, 1]
            times.append(each)
        ends = np.cumsum([0, *map(len, values)])
        every, times = np.concatenate(values), np.concatenate(times)
        del values
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        lengths = np.diff(np.r_[first, len(every)])
        del every
        level = np.empty(len(order), dtype=np.uint8)
        level[order] = np.repeat(levels_of(np.add.reduceat(times[order].astype(np.int64), first)), lengths)
        told = [level[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        some = [i for i, x in enumerate(told) if x.any()]  # without an answer all are unique
        return pa.table({
            "batch": t.column("batch").take(pa.array(some, pa.int64())),
            "part": t.column("part").take(pa.array(some, pa.int64())),
            "levels": pa.array([told[i].tobytes() for i in some], pa.binary()),
        })

    def index(docs: pa.Table, told: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        answers = dict(zip(told.column("part").to_pylist(), told.column("levels").to_pylist(), strict=True))
        for r in docs.to_pylist():
            counted, rest = unpacked(r["counted"]), unpacked(r["rest"])
            value, at = np.unique(counted, return_inverse=True)
            level, edge = np.zeros(len(value), dtype=np.uint8), edges_of(value, bits)
            for part, found in answers.items():
                level[edge[part] : edge[part + 1]] = np.frombuffer(found, dtype=np.uint8)
            level, a, c = level[at], np.cumsum([0, *r["n_counted"]]), np.cumsum([0, *r["n_rest"]])
            for i, size in enumerate(r["sizes"]):
                keys = keys_of(counted[a[i] : a[i + 1]], level[a[i] : a[i + 1]], rest[c[i] : c[i + 1]], size, similarity, scale)
                for column, x in zip(out, (r["ids"][i], size, r["s1"][i], r["s2"][i], signed(keys)), strict=True):
                    column.append(x)
        return pa.table({
            "doc_id": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int64()), "s1": pa.array(out[2], pa.int64()), "s2": pa.array(out[3], pa.int64()),
            "keys": pa.array(out[4], pa.list_(pa.int64())),
        })

    asked = base.select("batch", "counted").mapInArrow(ask, "part int, batch string, shingles binary, repeats binary")
    told = asked.groupBy("part").applyInArrow(count, "batch string, part int, levels binary")
    return base.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(index, "doc_id long, n long, s1 long, s2 long, keys array<long>")


def needed_sums() -> Column:
    """Blocks of rows with sizes n."""
    return F.greatest(F.ceil(F.count("*") / GROUP_ROWS), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int")


def needed(rows: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(rows) / GROUP_ROWS), F.ceil(F.col(shingles) / GROUP_SHINGLES)).cast("int")


class Groups:
    """Sets to compare together: (gid, doc_id, side) tables made of postings: key, doc_id, n, hub, m (rows), size (shingles) of shared keys."""

    def __init__(self, postings: DataFrame):
        cluster = components(postings.select("hub", "doc_id"), "hub", "doc_id").withColumnRenamed("node", "doc_id")
        placed = materialise(postings.join(cluster, "doc_id"), "ngram-placed")
        each = materialise(placed.select("component", "doc_id", "n").distinct(), "ngram-each")
        sizes = each.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
        sizes = sizes.withColumn("blocks", needed("rows", "shingles"))
        # the lists of one hub go together, so sets that share many keys meet once
        hubs = materialise(placed.where(F.col("m") <= SHORT_LIST).select("component", "hub", "doc_id", "n").distinct(), "ngram-hubs")
        near = hubs.groupBy("component").agg(F.count("*").alias("near"))
        far = placed.groupBy("component").agg(F.sum(F.when(F.col("m") > SHORT_LIST, needed("m", "size"))).alias("far"), F.count("*").alias("posts"))
        by_key = far.join(near, "component", "left").withColumn("sent", F.coalesce("near", F.lit(0)) + F.coalesce("far", F.lit(0)))
        # at worst, where leaders join nothing, a set meets all blocks
        sizes = sizes.join(by_key, "component").withColumn("whole", F.col("rows") * F.col("blocks") <= F.col("sent"))
        sizes = materialise(sizes.select("component", "rows", "posts", "near", "blocks", "whole"), "ngram-sizes")
        blocked = spread_join(each, sizes.where("whole").select("component", "rows", "blocks"), ["component"], "rows", each.count())
        #: component, doc_id, block and the number of blocks
        self.blocked = materialise(blocked.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "ngram-blocked")
        own = self.blocked.select(F.concat_ws("-", F.lit("c"), "component", "block").alias("gid"), "doc_id")
        large = spread_join(placed, sizes.where("not whole").select("component", "posts"), ["component"], "posts", placed.count())
        some = spread_join(hubs, sizes.where("not whole and near is not null").select("component", "near"), ["component"], "near", hubs.count())
        by_hub = some.groupBy("hub").agg(needed_sums().alias("blocks"))
        lists = paired(some.join(by_hub, "hub").select("hub", "doc_id", "blocks"), "l", "hub")
        long = large.where(F.col("m") > SHORT_LIST).select("key", "doc_id", needed("m", "size").alias("blocks"))
        self.first = own.unionByName(lists).unionByName(paired(long, "b", "key")).withColumn("side", F.lit(1))
        self.several = self.blocked.where("blocks > 1")

    def with_leaders(self, found: DataFrame) -> DataFrame:
        """Every block of a cluster of several, with the cluster's sets of most links.  found: (doc_id, links) of first comparisons."""
        best = self.several.join(found, "doc_id").groupBy("component", "blocks", "block").agg(F.max_by(F.struct("doc_id", "links"), F.struct("links", -F.col("doc_id"))).alias("best"))
        rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("best.links"), "best.doc_id"))
        leaders = best.withColumn("r", rank).where(F.col("r") <= LEADERS).select("component", "blocks", F.col("best.doc_id").alias("doc_id"))
        leaders = leaders.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "doc_id", F.lit(1).alias("side"))
        both = self.several.select("component", "block", "doc_id", F.lit(0).alias("side")).unionByName(leaders)
        both = both.groupBy("component", "block", "doc_id").agg(F.max("side").alias("side"))
        return both.select(F.concat_ws("-", F.lit("s"), "component", "block").alias("gid"), "doc_id", "side")

    def left_over(self, merged: DataFrame) -> DataFrame:
        """Blocks of the sets outside the largest component of their cluster, each with all blocks.  merged: (node, label) so far."""
        now = self.several.join(merged.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        now = materialise(now, "ngram-several")
        sizes = now.groupBy("component", "label").agg(F.count("*").alias("k")).groupBy("component").agg(F.max_by("label", F.struct("k", -F.col("label"))).alias("top"), F.sum("k").alias("rows"))
        now = spread_join(now, sizes, ["component"], "rows", now.count()).withColumn("side", (F.col("label") != F.col("top")).cast("int"))
        now = materialise(now, "ngram-left")
        outside = now.where("side = 1").groupBy("component").agg(F.countDistinct("block").alias("out"), F.array_sort(F.collect_set("block")).alias("outside"), F.max("blocks").alias("blocks"))
        counts = now.groupBy("component").agg(F.count("*").alias("rows"))
        now = spread_join(now.drop("blocks"), outside.join(counts, "component"), ["component"], "rows", now.count())
        # a block's outside sets meet the outside sets of later blocks, and the inside ones of all
        meets = F.filter("outside", lambda o: (F.col("side") == 0) | (o <= F.col("block")))
        mine = now.select("component", "doc_id", "side", "block", F.explode(meets).alias("with"))
        home = now.where("side = 1").select("component", "doc_id", "side", "block", "blocks").select("component", "doc_id", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("block").alias("with"))
        both = mine.unionByName(home).groupBy("component", "block", "with", "doc_id").agg(F.max("side").alias("side"))
        return both.select(F.concat_ws("-", F.lit("o"), "component", "block", "with").alias("gid"), "doc_id", "side")


def paired(rows: DataFrame, prefix: str, key: str) -> DataFrame:
    """(gid, doc_id): each row in all pairs of its block with one of the `blocks` of its key."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return rows.select(F.concat_ws("-", F.lit(prefix), key, F.least("own", "other"), F.greatest("own", "other")).alias("gid"), "doc_id")


def members_of(source: DataFrame, those: DataFrame, n: int) -> DataFrame:
    """(doc_id, members) of the documents whose ids `those` holds, and of few others; texts aren't shuffled."""
    look = IdFilter(those, "doc_id").may_hold()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            b = b.filter(pa.array(look(np.asarray(b.column(2), dtype=np.int64))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets_of(b, n)], pa.binary())], ["doc_id", "members"])

    return source.withColumn("h", F.xxhash64("doc_id")).mapInArrow(expand, "doc_id long, members binary")


def compare(sets: DataFrame, grouped: DataFrame, similarity: int, scale: int) -> DataFrame:
    """(a, b, links): each set's id, the smallest id of its component within a group, and its links there."""

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        members = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in t.column("members")]
        a = np.asarray(t.column("doc_id"), dtype=np.int64)
        b, links = linked(a, members, np.asarray(t.column("side"), dtype=np.int64), similarity, scale)
        return pa.table({"a": a, "b": b, "links": links}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())]))

    return sets.join(grouped, "doc_id").select("gid", "doc_id", "side", "members").groupBy("gid").applyInArrow(meet, "a long, b long, links long")


def edges_within(source: DataFrame, postings: DataFrame, n: int, similarity: int, scale: int) -> DataFrame:
    """(a, b): edges that join all sets linked over any chain."""
    groups = Groups(postings)
    first = materialise(groups.first.distinct(), "ngram-groups")
    sets = materialise(members_of(source, first.select("doc_id").distinct(), n), "ngram-members", "none")
    found = materialise(compare(sets, first, similarity, scale), "ngram-found")
    edges = found.where("a <> b").select("a", "b")
    if groups.several.limit(1).count():
        links = found.groupBy(F.col("a").alias("doc_id")).agg(F.max("links").alias("links"))
        more = materialise(compare(sets, groups.with_leaders(links), similarity, scale).where("a <> b").select("a", "b"), "ngram-led")
        edges = edges.unionByName(more)
        merged = materialise(components(edges, "a", "b").withColumnRenamed("component", "label"), "ngram-merged")
        rest = materialise(groups.left_over(merged), "ngram-rest")
        if rest.limit(1).count():
            edges = edges.unionByName(compare(sets, rest, similarity, scale).where("a <> b").select("a", "b"))
    return edges.distinct()


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: int = SIMILARITY, scale: int = SCALE) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row a document."""
    if 10 * similarity < 7 * scale or similarity > scale:
        raise ValueError("the prefixes need a similarity from 0.7 to 1")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = len(MADE)
    base = materialise(keyed(source, words, similarity, scale), "ngram-base", "none")
    discard(docs.sparkSession, MADE[made:-1])
    real = base.select("doc_id", "n", "s1", "s2").where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = materialise(real.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "ngram-classes")
    n_real = real.count()
    indexed = base.where(F.col("doc_id").isNotNull() & (F.size("keys") > 0))
    chosen = indexed.join(classes.select("s1", "s2", F.col("rep").alias("doc_id")), ["doc_id", "s1", "s2"]).dropDuplicates(["doc_id", "s1", "s2"])
    band = F.floor(F.log("n") / float(1.0001 * np.log(scale / similarity))) if similarity < scale else F.col("n")
    posted = chosen.select("doc_id", "n", F.explode("keys").alias("key"), band.alias("band"))
    posted = posted.select("doc_id", "n", F.explode(F.array("band", F.col("band") + 1)).alias("level"), "key")
    posted = materialise(posted.select("doc_id", "n", F.xxhash64("key", "level").alias("key")), "ngram-posted", "none")
    shared = posted.groupBy("key").agg(F.count("*").alias("m"), F.min("doc_id").alias("hub"), F.sum("n").alias("size")).where("m > 1")
    shared = materialise(shared, "ngram-shared", "none")
    postings = materialise(spread_join(posted, shared.withColumn("of", F.col("m")), ["key"], "of", posted.count()), "ngram-postings", "none")
    discard(docs.sparkSession, MADE[-3:-1])  # what was posted, and its lists
    edges = edges_within(source, postings, words, similarity, scale)
    # a copy belongs to its class's representative; rows of one id in several classes tie these together
    owned = spread_join(real.select("doc_id", "s1", "s2"), classes, ["s1", "s2"], "copies", n_real).select("doc_id", "rep").distinct()
    split = owned.groupBy("doc_id").agg(F.min("rep").alias("low"), F.count("*").alias("k")).where("k > 1").select("doc_id", "low")
    ties = owned.join(split, "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    merged = materialise(components(edges.unionByName(ties), "a", "b"), "ngram-components")
    named = classes.join(merged.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "copies", F.coalesce("component", "rep").alias("component_id"))
    named = materialise(named, "ngram-named")
    out = spread_join(real, named, ["s1", "s2"], "copies", n_real).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    # an empty text's row shares the component of its id's other rows
    empty = base.where((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"))
    empty = empty.join(out.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left")
    return out.unionByName(empty.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component, columns unchanged.

    Rows that share an id are judged one by one: of near duplicates one stays, rows of different texts all do.
    """
    number = F.col(doc_id).cast("long")
    repeated = docs.select(number.alias("~id")).where("`~id` is not null").groupBy("~id").count().where("count > 1")
    if repeated.limit(1).count():
        # numbers that follow the ids, so the smallest stays
        own = docs.where(number.isNotNull()).repartitionByRange(number).sortWithinPartitions(number)
        own = materialise(own.withColumn("~row", F.monotonically_increasing_id()), "ngram-rows")
        return docs.where(number.isNull()).unionByName(first_of_each(own, "~row", text, **options).drop("~row"))
    judged = materialise(join(docs, doc_id, text, **options).where(F.col("doc_id").isNotNull()), "ngram-judged")
    gone = judged.where("doc_id <> component_id").select(F.col("doc_id").alias("~id")).distinct()
    maybe = IdFilter(gone, "~id").column(number)
    # only rows that the filter can't clear meet the exact join
    return docs.where(~maybe).unionByName(docs.where(maybe).join(gone, number == F.col("`~id`"), "left_anti"))
