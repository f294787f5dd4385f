"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order, a prefix of half of them.  It is posted in the
inverted files of its POSTED nearest pivots, one shuffle whatever the number of queries.  A query goes
to the files of its own nearest pivots only; there it meets every vector once (in the first of its files
that holds it), ranks it by footrule distance of the two prefixes, and ranks again, by exact cosine in
double precision, all within its radius.

Pivots are spread by farthest-first choice within bounded samples of rows and of queries, so a dense
group of near copies doesn't take them all and queries unlike the rows have pivots of their own.  Their
number grows with the root of the table, so files stay short; a long file (a group that holds a third of
all rows) is cut in chunks.  How many files a query probes, and the radius, are measured against brute
force: MEASURED of the queries are compared with every row, and probes and radius must each reach TARGET
of their true neighbours, whatever the rows are like.  The radius of a query is the footrule distance of
its k-th nearest in the sample, a threshold, not a count: all rows at that distance are ranked again.
A query that meets fewer than `top` is answered from all files.

Equal vectors are one point; it carries its top + 1 smallest ids, since no others can be among the
nearest of any query.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or whose
length isn't the table's most frequent one, take no part; nor do rows of null id.  Rows repeated with
their id count once, as query and as candidate; rows of one id and several vectors are several
candidates; ties go to the smaller id; with fewer candidates than asked, all are returned; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Pivots at least and at most; sampled rows and queries for each; queries that are compared with every row to measure.
PIVOTS, MOST_PIVOTS, SAMPLED, ASKED, MEASURED = 256, 4096, 8, 2, 512
#: Files that hold a vector, share of pivots in a prefix, share of true neighbours that probes and radius must each reach.
POSTED, PREFIX, TARGET = 4, 0.5, 0.985
#: Vectors that one task compares, orders it holds (queries times pivots), rows ordered at once.
CHUNK, HELD, SLICE = 8192, 1 << 24, 1024
EVERY, TOP = 50, 5


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id long, v) of the rows that take part; v keeps its type."""
    kept = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    return kept.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, safe from overflow and underflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the least near to those before; the first row first."""
    near, chosen = x @ x[0], [0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


@dataclass(frozen=True)
class Index:
    """pivots, unit rows; prefix: length m; probes: files that a query visits; share: of the sample within a radius, past 1 without one; sample: prefixes."""

    pivots: np.ndarray
    prefix: int
    probes: int
    share: float
    sample: np.ndarray

    def order(self, x: np.ndarray) -> np.ndarray:
        """All pivots of each unit row, nearest first."""
        parts = [np.argsort(-(x[at : at + SLICE] @ self.pivots.T), axis=1, kind="stable").astype(np.uint16) for at in range(0, len(x), SLICE)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.pivots)), dtype=np.uint16)

    def ranks(self, order: np.ndarray) -> np.ndarray:
        """The place of each pivot in each order."""
        out = np.empty(order.shape, dtype=np.int16)
        np.put_along_axis(out, order.astype(np.int64), np.arange(order.shape[1], dtype=np.int16)[None, :], axis=1)
        return out

    def closeness(self, ranks: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
        """What shared pivots take off the footrule distance of prefixes, halved: more is nearer."""
        m = prefixes.shape[1]
        worse = np.maximum(ranks[prefixes], np.arange(m, dtype=np.int16))
        return np.maximum(m - worse, 0).sum(axis=1, dtype=np.int32)

    def radius(self, ranks: np.ndarray) -> int:
        """The closeness that a `share` of the sample reaches."""
        if not len(self.sample):
            return 0
        near = self.closeness(ranks, self.sample)
        k = max(1, int(np.ceil(self.share * len(near))))
        return 0 if k > len(near) else int(np.partition(near, len(near) - k)[len(near) - k])

    def measured(self, ranks: np.ndarray, needed: np.ndarray, close: np.ndarray, least: float = 0.0) -> Index:
        """Probes and radius by what true neighbours need: the ranks of their query, the files and the closeness that find each."""
        if not len(needed) or not len(self.sample):
            return self
        near = {r.tobytes(): np.sort(self.closeness(r, self.sample)) for r in np.unique(ranks, axis=0)}
        n = len(self.sample)
        places = [n - np.searchsorted(near[r.tobytes()], c, side="right") + 1 for r, c in zip(ranks, close, strict=True)]
        at_least = lambda xs: float(np.quantile(xs, TARGET, method="higher"))
        return replace(self, probes=int(at_least(needed)), share=max(least, at_least(places) / n))

    @classmethod
    def fit(cls, sample: np.ndarray, n_pivots: int, top: int, asked: np.ndarray | None = None) -> Index:
        """From unit rows, and queries: pivots, then probes and radius by what the sample's own nearest need."""
        both = sample if asked is None or not len(asked) else np.concatenate([sample, asked])
        if both is not sample:
            both = both[np.sort(np.unique(both, axis=0, return_index=True)[1])]
        pivots = farthest_first(both, n_pivots) if len(both) else both
        m = max(1, int(PREFIX * len(pivots)))
        index = cls(pivots, m, len(pivots), 1.0, np.zeros((0, m), dtype=np.uint16))
        if len(sample) <= top:
            return index
        order = index.order(sample)
        near, files, needed, places = order[:, :m], order[:, :POSTED], [], []
        for q in range(min(MEASURED, len(sample))):
            cosine = sample @ sample[q]
            cosine[q] = -2.0
            true = np.argsort(-cosine, kind="stable")[:top]
            ranks = index.ranks(order[q : q + 1])[0]
            needed += (ranks[files[true]].min(axis=1) + 1).tolist()
            close = index.closeness(ranks, near)
            close[q] = -1
            places += [int((close >= close[t]).sum()) for t in true]
        at_least = lambda xs: float(np.quantile(xs, TARGET, method="higher"))
        return cls(pivots, m, int(at_least(needed)), min(1.0, (at_least(places) + 1) / len(sample)), near.copy())


def meet(index: Index, x: np.ndarray, q: np.ndarray, radii: np.ndarray, pivot: int, top: int) -> list[tuple[int, int, float]]:
    """(query, row, cosine) of each query's nearest `top` in the file of a pivot, and all that tie with the last."""
    out: list[tuple[int, int, float]] = []
    order = index.order(x)
    prefixes, files = order[:, : index.prefix], order[:, :POSTED].astype(np.int64)
    ranks = index.ranks(index.order(q))
    for k in range(len(q)):
        first = np.flatnonzero(ranks[k][files].min(axis=1) == ranks[k][pivot])
        rows = first[index.closeness(ranks[k], prefixes[first]) >= radii[k]]
        if not len(rows):
            continue
        cosine = (x[rows] * q[k]).sum(axis=1)
        least = np.partition(cosine, len(rows) - top)[len(rows) - top] if len(rows) > top else -2.0
        out += [(k, int(rows[i]), float(cosine[i])) for i in np.flatnonzero(cosine >= least)]
    return out


def points_of(base: DataFrame, top: int) -> DataFrame:
    """(h, v, ids): distinct vectors and the top + 1 smallest ids of each; copies beyond leave before the shuffle."""
    copies = Window.partitionBy("h", "v").orderBy("vec_id")
    few = base.withColumn("h", F.xxhash64("v")).withColumn("c", F.dense_rank().over(copies)).where(F.col("c") <= top + 1)
    return few.groupBy("h", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))


def truly_nearest(index: Index, points: DataFrame, asked: list[tuple[int, np.ndarray]], top: int) -> DataFrame:
    """(k, needed, close): of each of a few queries (id, unit row), by comparing it with every point, what finds its nearest `top`."""
    shared = points.sparkSession.sparkContext.broadcast((index, np.array([i for i, _ in asked]), np.array([v for _, v in asked])))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, own, q = shared.value
        best: list[list[tuple[float, list[int], np.ndarray]]] = [[] for _ in own]
        floor = np.full(len(own), -2.0)
        for part in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            x, ids = unit(matrix(part.column(0), q.shape[1])), part.column(1).to_pylist()
            cosine = q @ x.T
            alone = np.array([len(n) == 1 for n in ids])
            cosine[(own[:, None] == np.array([n[0] for n in ids])[None, :]) & alone[None, :]] = -2.0
            for k in np.flatnonzero(cosine.max(axis=1) > floor):
                new = np.flatnonzero(cosine[k] > floor[k])
                new = new[np.argsort(-cosine[k][new], kind="stable")[:top]]
                best[k] = sorted(best[k] + [(float(cosine[k][i]), ids[i], x[i]) for i in new], key=lambda f: -f[0])[:top]
                floor[k] = best[k][-1][0] if len(best[k]) == top else -2.0
        for k, found in enumerate(best):
            if found:
                order, ranks = ix.order(np.array([f[2] for f in found])), ix.ranks(ix.order(q[k : k + 1]))[0]
                needed, close = ranks[order[:, :POSTED]].min(axis=1) + 1, ix.closeness(ranks, order[:, : ix.prefix])
                columns = [[k] * len(found), [int(own[k])] * len(found), [f[1] for f in found], [f[0] for f in found], needed.tolist(), close.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["k", "own", "ids", "score", "needed", "close"])

    types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.int32(), pa.int32()]
    met = points.select("v", "ids").mapInArrow(compare, "k int, own long, ids array<long>, score double, needed int, close int")
    order = Window.partitionBy("k").orderBy(F.desc("score"), "vec_id")
    each = met.withColumn("vec_id", F.explode("ids")).where("vec_id <> own").withColumn("rank", F.row_number().over(order))
    return each.where(F.col("rank") <= top).select("k", "needed", "close")


def search(rows: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP, n_pivots: int | None = None, rerank: int = 0, block: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest rows of each query, its own id left out.

    rerank: rows, or more, that the radius lets in, were all files probed; block: vectors that one task compares.
    """
    spark = rows.sparkSession
    base = usable(rows, vec_id, vector)
    sizes = {r["n"]: r["count"] for r in base.groupBy(F.size("v").alias("n")).count().collect()}
    dim = min(sizes, key=lambda n: (-sizes[n], n), default=1)
    points = materialise(points_of(base.where(F.size("v") == dim), top), "nearest-points")
    asked = usable(queries, vec_id, vector).where(F.size("v") == dim).distinct().withColumn("key", F.xxhash64("vec_id", "v"))
    n = max(1, points.count())
    wanted = n_pivots or min(MOST_PIVOTS, max(PIVOTS, 1 << int(np.ceil(np.log2(n**0.5)))))
    sampled = [r["v"] for r in points.orderBy(F.xxhash64("h"), "h", "v").limit(SAMPLED * wanted).select("v").collect()]  # a bounded sample
    some = asked.orderBy("key", "vec_id", "v").limit(max(MEASURED, ASKED * wanted)).select("vec_id", "v").collect()  # a bounded sample
    some_rows = unit(np.array([r["v"] for r in some], dtype=np.float64)) if some else np.zeros((0, dim))
    index = Index.fit(unit(np.array(sampled, dtype=np.float64)) if sampled else np.zeros((0, dim)), wanted, top, some_rows)
    if some and sampled:
        needs = truly_nearest(index, points, [(r["vec_id"], v) for r, v in zip(some[:MEASURED], some_rows, strict=False)], top).collect()  # MEASURED * top at most
        ranks = index.ranks(index.order(some_rows[:MEASURED]))
        index = index.measured(ranks[[r["k"] for r in needs]], np.array([r["needed"] for r in needs]), np.array([r["close"] for r in needs]), rerank / n)
    shared = spark.sparkContext.broadcast(index)  # MOST_PIVOTS vectors and SAMPLED * MOST_PIVOTS prefixes at most
    kind = points.schema["v"].dataType.simpleString()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = shared.value.order(unit(matrix(b.column(1), dim)))[:, :POSTED].astype(np.int32) if b.num_rows else np.zeros((0, 1), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(files), pa.list_(pa.int32()))], ["h", "v", "ids", "files"])

    posted = materialise(points.mapInArrow(post, f"h long, v {kind}, ids array<long>, files array<int>"), "nearest-posted")

    def probe(everything: bool):
        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                order = ix.order(unit(matrix(b.column(1), dim)))
                radii = [0 if everything else ix.radius(r) for r in ix.ranks(order)]
                files = order if everything else order[:, : ix.probes]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(radii, pa.int32()), pa.array(list(files.astype(np.int32)), pa.list_(pa.int32()))], ["vec_id", "v", "key", "radius", "files"])

        return visit

    def compare(x: pa.Table, q: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if x.num_rows and q.num_rows:
            pivot = x.column("file")[0].as_py()
            found = meet(shared.value, unit(matrix(x.column("v"), dim)), unit(matrix(q.column("v"), dim)), np.asarray(q.column("radius")), pivot, top + 1)  # its own point may be one of them
        k, at = pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())
        return pa.table({"query_id": q.column("vec_id").take(k), "key": q.column("key").take(k), "ids": x.column("ids").take(at), "score": pa.array([f[2] for f in found], pa.float64())})

    lists = posted.select("h", "v", "ids", F.explode("files").alias("file"))
    long = lists.groupBy("file").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))  # a row a pivot

    def nearest(those: DataFrame, everything: bool) -> DataFrame:
        visits = materialise(those.mapInArrow(probe(everything), f"vec_id long, v {kind}, key long, radius int, files array<int>"), "nearest-visits")
        visits = visits.select("vec_id", "v", "key", "radius", F.explode("files").alias("file"))
        many = visits.groupBy("file").agg(F.ceil(F.count("*") / max(1, HELD // max(1, len(index.pivots)))).cast("int").alias("blocks"))  # a row a pivot
        cut = F.broadcast(long.join(many, "file"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda c, n: F.pmod(F.col(c), F.col(n)).cast("int")
        left = lists.join(cut, "file").select("file", "v", "ids", own("h", "chunks").alias("chunk"), every("blocks").alias("block"))
        right = visits.join(cut, "file").select("file", "vec_id", "v", "key", "radius", own("key", "blocks").alias("block"), every("chunks").alias("chunk"))
        by = ("file", "chunk", "block")
        met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "query_id long, key long, ids array<long>, score double")
        order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
        each = met.select("query_id", "key", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id").distinct()
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    found = materialise(nearest(asked, False), "nearest-found")
    full = found.where(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), "key")
    short = materialise(asked.join(full, ["vec_id", "key"], "left_anti").select("vec_id", "v", "key"), "nearest-short")
    if short.limit(1).count():
        again = nearest(short, True)
        found = found.join(short.select(F.col("vec_id").alias("query_id"), "key"), ["query_id", "key"], "left_anti").select(*again.columns).unionByName(again)
    return found.select("query_id", "rank", "vec_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "score")).alias("score"))


def every_nth(rows: DataFrame, vec_id: str = "vec_id", n: int = EVERY) -> DataFrame:
    return rows.where(F.col(vec_id) % n == 0)
