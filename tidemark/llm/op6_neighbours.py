"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Vectors are scaled to length one. Coarse centroids and the codebooks of the residuals are fitted to a
bounded sample (SAMPLE distinct vectors); every row is indexed. Equal vectors are one entry of the index
with the smallest of their ids, as many as a result can hold. Cells are counted; a cell of more than SHARD
entries is dealt into shards of its own, small cells share one. A query visits all cells whose centroids are
as near as the nearest one's distance and a margin, the smallest that reaches TARGET recall on queries from
the sample; queries far from all centroids have margins of their own and visit many. In a shard tables of its distances to all
codewords give approximate distances of the entries (asymmetric distances). With the known quantisation
error of each entry they bound its distance from both sides, and every entry whose lower bound isn't beyond
the upper bounds of enough others is ranked again by the exact cosine of the original vectors: nothing is
lost within the cells visited, however many entries are alike.

Queries meet the index in blocks within their shards; each shard returns a query's nearest few only.

Defined results: vectors that are null, empty, zero, or hold a null or a value that isn't finite take no
part, nor do those of another length than most; a query with fewer candidates gets all; ties go to the
smaller vec_id; every row but a query's own is found, so equal rows are found as often as they stand there, also by
each other, and each asks by itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder
from .textscan import bounded_batches

#: Neighbours of a query.
NEIGHBOURS = 5
#: Distinct vectors that centroids and codebooks are fitted to; most cells; codebooks and codewords; rounds of k-means.
SAMPLE, CELLS, PARTS, WORDS, ROUNDS = 16_384, 1024, 16, 128, 6
#: Recall aimed at on the sample, the shares of it by distance to their centroid that are told apart, and queries of each that measure it.
TARGET, STRATA, TRIALS = 0.97, (0.0, 0.8, 0.95, 0.99), 80
#: Entries of a shard.
SHARD = 16_384


@dataclass
class Index:
    centroids: np.ndarray
    books: np.ndarray
    #: how much farther than the nearest centroid those of visited cells are, by the least distance at which it holds
    margins: np.ndarray
    edges: np.ndarray
    #: entries of each cell, and the first and the number of its shards
    counts: np.ndarray
    first: np.ndarray
    salts: np.ndarray

    def far(self, x: np.ndarray) -> np.ndarray:
        """Distances to all centroids."""
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * x @ self.centroids.T, 0))

    def visits(self, x: np.ndarray, least: int) -> list[np.ndarray]:
        """The cells that each vector visits: those within the margin, and the next ones until ``least`` entries are met."""
        far = self.far(x)
        order = np.argsort(far, axis=1, kind="stable")
        far = np.take_along_axis(far, order, 1)
        margin = self.margins[np.maximum(np.searchsorted(self.edges, far[:, 0], "right") - 1, 0)]
        near = (far <= far[:, :1] + margin[:, None]).sum(1)
        met = np.cumsum(self.counts[order], axis=1)
        enough = np.minimum((met < least).sum(1) + 1, order.shape[1])
        return [row[: max(n, e)] for row, n, e in zip(order, near.tolist(), enough.tolist(), strict=True)]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codewords of the residuals, and how far what they stand for is from each vector."""
        rest = (x - self.centroids[cell]).reshape(len(x), PARTS, -1)
        out, error = np.empty((len(x), PARTS), np.uint8), np.zeros(len(x))
        for p in range(PARTS):
            out[:, p] = ((self.books[p] ** 2).sum(1) - 2 * rest[:, p] @ self.books[p].T).argmin(1)
            error += ((rest[:, p] - self.books[p][out[:, p]]) ** 2).sum(1)
        return out, np.sqrt(error)

    def deal(self, counts: dict[int, int]) -> None:
        """Gives each cell its shards: cells of more than SHARD entries their own, others together until one is full."""
        self.counts = np.array([counts.get(c, 0) for c in range(len(self.centroids))])
        self.salts = np.maximum(1, -(-self.counts // SHARD))
        shard = filled = 0
        for c, (n, s) in enumerate(zip(self.counts.tolist(), self.salts.tolist(), strict=True)):
            if filled and (s > 1 or filled + n > SHARD):
                shard, filled = shard + 1, 0
            self.first[c] = shard
            shard, filled = (shard + s, 0) if s > 1 else (shard, filled + n)


def _means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((c**2).sum(1) - 2 * b @ c.T).argmin(1) for b in np.array_split(x, max(1, len(x) // 4096))])
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray) -> Index:
    """Centroids and codebooks for distinct vectors of a sample."""
    n, width = sample.shape
    pad = -width % PARTS
    x = np.pad(unit(sample), ((0, 0), (0, pad)))
    k = int(max(1, min(CELLS, np.sqrt(n))))
    index = Index(_means(x, k, ROUNDS, 6), np.zeros((PARTS, 1, x.shape[1] // PARTS)), np.zeros(1), np.zeros(1), np.zeros(k, int), np.zeros(k, int), np.ones(k, int))
    cell = index.far(x).argmin(1)
    rest = (x - index.centroids[cell]).reshape(n, PARTS, -1)
    index.books = np.stack([_means(rest[:, p], min(WORDS, n), ROUNDS, 60 + p) for p in range(PARTS)])
    # the margins that reach the target on the sample itself, for queries near a centroid and farther and farther off
    far = np.concatenate([index.far(part).min(1) for part in np.array_split(x, max(1, n // 4096))])
    index.edges = np.quantile(far, STRATA)
    r, margins = np.random.default_rng(66), []
    for k, lo in enumerate(index.edges):
        hi = index.edges[k + 1] if k + 1 < len(index.edges) else np.inf
        own = np.flatnonzero((far >= lo) & (far < hi))
        q = r.choice(own, min(TRIALS, len(own)), replace=False)
        near = x[q] @ x.T
        near[np.arange(len(q)), q] = -2
        best = np.argpartition(-near, min(NEIGHBOURS, n - 1), axis=1)[:, :NEIGHBOURS]
        gap = np.sort((np.take_along_axis(index.far(x[q]), cell[best], 1) - far[q, None]).ravel())
        margins.append(float(gap[min(len(gap) - 1, int(np.ceil(TARGET * len(gap))))]) + 1e-9 if len(gap) else 0.0)
    index.margins = np.maximum.accumulate(margins)
    return index


def _valid(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    ok = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))


ROWS = "shard long, kind int, entry long, cells array<int>, ids array<array<long>>, vector array<double>"


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of an array column whose arrays have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def nearest(vectors: DataFrame, every: int = 50, count: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows of each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    shared_folder(spark)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    valid = _valid(vectors)
    widths = valid.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return spark.createDataFrame([], schema)
    valid = valid.filter(F.size("embedding") == widths["n"]).select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("vector"))
    # of equal vectors the smallest ids, one more than a result can hold; the limit works before the shuffle too
    same = Window.partitionBy("vector").orderBy("vec_id")
    rows = valid.groupBy("vec_id", "vector").agg(F.count("*").alias("rows"))  # equal rows are one with a number
    few = rows.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= count + 1)
    entries = few.groupBy("vector").agg(F.sort_array(F.collect_list(F.array("vec_id", "rows"))).alias("ids")).select(F.element_at("ids", 1)[0].alias("entry"), "ids", "vector").checkpoint()
    sample = [r[0] for r in entries.orderBy(F.xxhash64("entry"), "entry", "vector").limit(SAMPLE).select("vector").collect()]
    index = fit(np.array(sample, float))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = index.far(_padded(unit(_vectors(b.column("vector"))))).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(cell)), pa.array(np.unique(cell, return_counts=True)[1])], ["cell", "n"])

    index.deal({r.cell: r.n for r in entries.select("vector").mapInArrow(celled, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()})  # CELLS at most
    sent = spark.sparkContext.broadcast(index)  # CELLS centroids and PARTS codebooks at most

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            cell = ix.far(_padded(unit(_vectors(b.column("vector"))))).argmin(1)
            shard = ix.first[cell] + b.column("entry").to_numpy() % ix.salts[cell]
            yield _rows(shard, 0, b.column("entry"), [[int(c)] for c in cell], b.column("ids"), b.column("vector"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _padded(unit(_vectors(b.column("vector"))))
            who, shard, its = [], [], []
            for i, cells in enumerate(ix.visits(x, count + 1)):
                of: dict[int, list[int]] = {}
                for c in cells.tolist():
                    for k in range(ix.salts[c]):
                        of.setdefault(int(ix.first[c]) + k, []).append(c)
                who += [i] * len(of)
                shard += of.keys()
                its += of.values()
            take = pa.array(who, pa.int64())
            yield _rows(np.array(shard), 1, b.column("entry").take(take), its, b.column("ids").take(take), b.column("vector").take(take))

    # a distinct vector asks once, whatever the number of rows that hold it; it goes by a hash, and by itself in the end
    queries = valid.filter(F.col("vec_id") % every == 0).withColumn("entry", F.xxhash64("vector"))
    asking = queries.groupBy("entry", "vector").agg(F.count("*").alias("_n")).select("entry", F.array().cast("array<array<long>>").alias("ids"), "vector")
    dealt = entries.mapInArrow(placed, ROWS).unionByName(asking.mapInArrow(asked, ROWS)).repartition(shuffles, "shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(_search(sent, count + 1), "entry long, vector array<double>, vec_id long, score double, rows long, same boolean")
    best = Window.partitionBy("entry", "vector").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= count + 1).drop("_n")
    asked_rows = queries.groupBy(F.col("vec_id").alias("query_id"), F.col("entry").alias("_e"), F.col("vector").alias("_q")).agg(F.count("*").alias("_times"))
    pairs = asked_rows.join(found, (F.col("_e") == F.col("entry")) & (F.col("_q") == F.col("vector")))
    own = (F.col("vec_id") == F.col("query_id")) & F.col("same")  # one of these rows asks
    others = F.least(F.col("rows") - own.cast("long"), F.lit(count)).cast("int")
    each = pairs.withColumn("_row", F.explode(F.array_repeat(F.lit(0), others)))
    order = Window.partitionBy("query_id", "_q").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)
    return ranked.withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))).select("query_id", "rank", "vec_id", "score")


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS)))


def _rows(shard: np.ndarray, kind: int, entry: pa.Array, cells: list, ids: pa.Array, vector: pa.Array) -> pa.RecordBatch:
    n = len(shard)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(np.full(n, kind, np.int32)), entry, pa.array(cells, pa.list_(pa.int32())), ids, vector], ["shard", "kind", "entry", "cells", "ids", "vector"])


class _Shard:
    """The entries of one shard, by cell."""

    def __init__(self, ix: Index, batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches).combine_chunks()
        cell = t["cells"].combine_chunks().flatten().to_numpy().astype(np.int64)
        order = np.argsort(cell, kind="stable")
        self.vectors = _vectors(t["vector"].combine_chunks())[order]
        self.ids = t["ids"].combine_chunks().take(pa.array(order))
        self.cells, self.begin = np.unique(cell[order], return_index=True)
        self.end = np.append(self.begin[1:], len(cell))
        codes, self.error = ix.encode(_padded(unit(self.vectors)), cell[order])
        self.codes = codes.astype(np.int32) + np.arange(PARTS, dtype=np.int32) * ix.books.shape[1]
        self.norm = np.sqrt((self.vectors**2).sum(1))
        self.ix = ix

    def nearest(self, q: np.ndarray, visit: list[int], count: int) -> list[tuple[float, int, int, bool]]:
        """The nearest rows of one query: asymmetric distances, then exact cosines of all that may be among them."""
        ix = self.ix
        x = _padded(q[None] / np.sqrt((q**2).sum()))[0]
        near, at = [], []
        for c in visit:
            k = int(np.searchsorted(self.cells, c))
            if k == len(self.cells) or self.cells[k] != c:
                continue
            rest = (x - ix.centroids[c]).reshape(PARTS, 1, -1)
            table = ((rest - ix.books) ** 2).sum(2).ravel()
            lo, hi = int(self.begin[k]), int(self.end[k])
            near.append(table[self.codes[lo:hi]].sum(1))
            at.append(np.arange(lo, hi))
        if not near:
            return []
        near, at = np.sqrt(np.maximum(np.concatenate(near), 0)), np.concatenate(at)
        if len(at) > count:
            error = self.error[at]
            most = np.partition(near + error, count - 1)[count - 1] + 1e-9  # so many entries are this near at least
            at = at[near - error <= most]
        cosine = (self.vectors[at] * q).sum(1) / (self.norm[at] * np.sqrt((q**2).sum()))
        if len(at) > count:  # with all ties
            top = cosine >= np.partition(cosine, len(at) - count)[len(at) - count]
            at, cosine = at[top], cosine[top]
        same = (self.vectors[at] == q).all(1)
        rows = [(-s, v, n, e) for s, e, ids in zip(cosine.tolist(), same.tolist(), self.ids.take(pa.array(at)).to_pylist(), strict=True) for v, n in ids]
        return sorted(rows)[:count]


def _search(index, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entries, shard = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("shard").to_numpy() * 2 + b.column("kind").to_numpy()
            cut = np.flatnonzero(np.diff(key)) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                part = b.slice(i, j - i)
                if key[i] // 2 != now:
                    now, entries, shard = key[i] // 2, [], None
                if key[i] % 2 == 0:
                    entries.append(part)
                    continue
                if shard is None and entries:
                    shard = _Shard(index.value, entries)
                    entries = []
                if shard is None:
                    continue
                who, ids, scores, rows, same = [], [], [], [], []
                for i, (q, visit) in enumerate(zip(_vectors(part.column("vector")), part.column("cells").to_pylist(), strict=True)):
                    for s, v, n, e in shard.nearest(q, visit, count):
                        who.append(i)
                        ids.append(v)
                        scores.append(-s)
                        rows.append(n)
                        same.append(e)
                if ids:
                    take = pa.array(who, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("entry").take(take), part.column("vector").take(take), pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(rows, pa.int64()), pa.array(same)], ["entry", "vector", "vec_id", "score", "rows", "same"])

    return run
