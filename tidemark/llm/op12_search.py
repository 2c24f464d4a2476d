"""Ranked lexical search over a clustered index.

Building: one pass over the texts counts each document's terms and sends the document down a short tree of
bisections fitted to a bounded sample. The documents of a leaf are dealt out in blocks of bounded size, and within a
block recursive graph bisection brings documents that share terms next to each other. Runs of CLUSTER documents
in that order are the shards of the index: a row each, with its terms, in how many of its documents each occurs, the
largest impact that each has in the shard, and the postings.

Searching: the largest impacts bound what any document of a shard can score. A task visits shards in order of
their bounds, query by query, and stops when no bound reaches the tenth best score so far (or reaches it and the
shard's smallest doc_id can't win the tie), so what it leaves out can't be in the result. It starts from the tenth
best scores of a few blocks. Each task returns ten documents a query at most.

Queries are searched for in blocks of QUERY_TERMS (query, term) pairs; only a block is ever sent to the tasks.
The index holds whole texts and serves any queries.

Defined results: a null text has no terms; such documents don't count and are never found; a document of several
rows is ranked once for each; a null doc_id comes last among equal scores; equal rows of queries are one query, different
texts of one item_id are queries of their own; terms that no document has add nothing; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import remove, shared_folder
from .bisection import Router, reorder
from .sampling import sample_texts
from .textscan import binary_array, bounded_batches, chunks, encode_words, lower, utf8, words

#: Documents of the sample, its terms (the commonest of those in two documents or more), and least documents of a leaf in it.
SAMPLE, SAMPLE_TERMS, SAMPLE_LEAF = 2048, 16_384, 32
#: Documents of a shard; postings and documents of a block, which one task orders at once.
CLUSTER, BLOCK_POSTINGS, BLOCK_DOCS = 128, 1 << 20, 16_384
#: (query, term) pairs of one block of queries, and cells (queries times terms) of a tile of one.
QUERY_TERMS, TILE_CELLS = 1_000_000, 4_000_000
#: Blocks that give the first thresholds, and shards that a task holds while it visits the best of them.
PILOT, AT_ONCE = 4, 64
#: Cells of unpacked shards that a task keeps.
HELD_CELLS = 8_000_000
#: Results for each query.
BEST = 10
#: fixed values: scale of impacts, and of a document's length beside the mean length
IMPACT, SATURATION, LENGTH, FLAT = 1_000_000_000, 8, 75, 25
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
TERMS = "leaf int, place long, doc_id long, n long, k int, terms binary, sizes binary, tfs binary"
SHARDS = "block long, shard int, least long, doc_ids array<long>, terms binary, sizes binary, dfs binary, most binary, postings binary"
NO_ID = np.iinfo(np.int64).max


def _counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The distinct (document, term) pairs of a batch and their occurrences, the terms, and each document's terms with repeats."""
    raw, offsets = utf8(column)
    raw = lower(raw)
    starts, ends, at = words(raw, offsets, _GAP)
    code, distinct = encode_words(raw, starts, ends, _GAP)
    n = np.diff(at)
    pair, tf = np.unique(np.repeat(np.arange(len(n)), n) * max(1, len(distinct)) + code, return_counts=True)
    return pair // max(1, len(distinct)), pair % max(1, len(distinct)), tf, distinct, n


def _router(docs: DataFrame, sample: int) -> tuple[Router | None, pa.Array]:
    """The upper levels of the bisection and the terms that they know."""
    texts = [t for _, t in sample_texts(docs, sample, 12)]
    doc, code, _, distinct, n = _counts(pa.array(texts, pa.string()))
    often = np.bincount(code, minlength=len(distinct))
    known = np.sort(np.argsort(-often, kind="stable")[: min(SAMPLE_TERMS, int((often > 1).sum()))])
    levels = max(0, int(math.log2(max(1, len(texts) / SAMPLE_LEAF))))
    if not levels or not len(known):
        return None, pa.array([], pa.large_binary())
    at = np.full(len(distinct), -1)
    at[known] = np.arange(len(known))
    use = at[code] >= 0
    return Router(doc[use], at[code[use]], len(n), len(known), levels), distinct.take(pa.array(known))


def _counted(docs: DataFrame, sample: int) -> DataFrame:
    """A row for each document with terms: its leaf, length and terms with their occurrences."""
    router, known = _router(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            doc, code, tf, distinct, n = _counts(b.column("text"))
            leaf = np.zeros(len(n), np.int64)
            if router:
                at = pc.fill_null(pc.index_in(distinct, known), -1).to_numpy()[code]
                leaf = router.leaves(doc[at >= 0], at[at >= 0], len(n))
            has = np.flatnonzero(n)
            each = distinct.take(pa.array(code))
            size = pc.binary_length(each).to_numpy(zero_copy_only=False).astype("<i4")
            cut = np.searchsorted(doc, np.append(has, len(n)))
            text = np.frombuffer(b"".join(each.to_pylist()), np.uint8)
            slices = [(text, np.append(0, np.cumsum(size, dtype=np.int64))[cut]), (size.view(np.uint8), 4 * cut), (tf.astype("<i4").view(np.uint8), 4 * cut)]
            keep = pa.array(has)
            columns = [pa.array(leaf[has], pa.int32()), b.column("place").take(keep), b.column("doc_id").take(keep), pa.array(n[has]), pa.array(np.diff(cut), pa.int32()), *(binary_array(*s).cast(pa.binary()) for s in slices)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in TERMS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    return rows.mapInArrow(run, TERMS)


def impacts(tf: np.ndarray, n: np.ndarray, stats: tuple[int, int]) -> np.ndarray:
    """What each occurrence count is worth in a document of ``n`` terms, without its term's weight."""
    m = FLAT + LENGTH * n.astype(np.int64) * stats[0] // stats[1]
    tf = tf.astype(np.int64)
    return IMPACT * tf // (1000 * tf + SATURATION * m)


def _shards(block: int, rows: list[pa.RecordBatch], stats: tuple[int, int], cluster: int) -> Iterator[pa.RecordBatch]:
    """The shards of one block's documents."""
    part = pa.Table.from_batches(rows)
    ids, n, k = part["doc_id"].combine_chunks(), part["n"].to_numpy(), part["k"].to_numpy()
    raw, size, tf = (np.frombuffer(b"".join(part[c].to_pylist()), t) for c, t in (("terms", np.uint8), ("sizes", "<i4"), ("tfs", "<i4")))
    code = binary_array(raw, np.append(0, np.cumsum(size, dtype=np.int64))).dictionary_encode()
    term, distinct = code.indices.to_numpy().astype(np.int64), code.dictionary
    doc = np.repeat(np.arange(len(n)), k)
    order = reorder(doc, term, len(n), len(distinct), cluster)
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n))
    where = place[doc]
    by = np.lexsort((where, term, where // cluster))
    where, term, tf, worth = where[by], term[by], tf[by], impacts(tf, n[doc], stats)[by]
    cut = np.searchsorted(where // cluster, np.arange(-(-len(n) // cluster) + 1))
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for i, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
        first = np.flatnonzero(np.append(True, term[lo + 1 : hi] != term[lo : hi - 1]))
        own = distinct.take(pa.array(term[lo:hi][first]))
        who = ids.take(pa.array(order[i * cluster : (i + 1) * cluster]))
        least = pc.min(who).as_py()
        cells = [
            block, i, NO_ID if least is None else least, who.to_pylist(), b"".join(own.to_pylist()), pc.binary_length(own).to_numpy(zero_copy_only=False).astype("<i4").tobytes(),
            np.diff(np.append(first, hi - lo)).astype("<i4").tobytes(), np.maximum.reduceat(worth[lo:hi], first).astype("<i4").tobytes(),
            squeeze((where[lo:hi] - i * cluster).astype("<u2").tobytes() + worth[lo:hi].astype("<i4").tobytes()),
        ]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], [c.split()[0] for c in SHARDS.split(", ")])


def build(docs: DataFrame, folder: str, sample: int = SAMPLE, cluster: int = CLUSTER) -> None:
    """Writes the index of all documents to ``folder``: ``shards``, and ``stats`` (documents and terms counted, blocks)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    _counted(docs, sample).write.parquet(f"{folder}/terms")
    counted = spark.read.schema(TERMS).parquet(f"{folder}/terms")
    leaves = counted.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.sum("k").alias("k")).collect()  # a row for each leaf of the sample's tree
    stats = (sum(r.docs for r in leaves), sum(r.n for r in leaves))
    parts = {r.leaf: max(1, -(-r.k // BLOCK_POSTINGS), -(-r.docs // BLOCK_DOCS)) for r in leaves}
    begin, total = [0] * (max(parts, default=0) + 1), 0
    for leaf in sorted(parts):
        begin[leaf], total = total, total + parts[leaf]
    spark.createDataFrame([(*stats, total)], "docs long, terms long, blocks long").coalesce(1).write.parquet(f"{folder}/stats")
    many = [parts.get(i, 1) for i in range(len(begin))]
    block = F.lit(begin)[F.col("leaf")] + F.pmod(F.xxhash64("place"), F.lit(many)[F.col("leaf")].cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            at = b.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi == lo:
                    continue
                if held and now != at[lo]:
                    yield from _shards(int(now), held, stats, cluster)
                    held = []
                now = at[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from _shards(int(now), held, stats, cluster)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(total, 1 << 16))
    dealt = counted.withColumn("block", block).drop("leaf").repartition(n, "block").sortWithinPartitions("block", "place")
    dealt.mapInArrow(run, SHARDS).write.parquet(f"{folder}/shards")
    remove(spark, f"{folder}/terms")


@dataclass
class Tile:
    """Some queries: their numbers, their terms, and each one's weights of these."""

    numbers: np.ndarray
    terms: pa.Array
    weights: np.ndarray


def _tiles(pairs: list, df: dict[bytes, int], docs: int) -> list[Tile]:
    """Tiles of (query, term, times) pairs, ordered by query."""
    weight = {t: math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for t, d in df.items()}
    pairs = [(q, t, c * weight[t]) for q, t, c in pairs if weight.get(t, 0) > 0]
    out, lo = [], 0
    while lo < len(pairs):
        own, terms, hi = {}, {}, lo
        while hi < len(pairs):
            end = hi
            while end < len(pairs) and pairs[end][0] == pairs[hi][0]:
                end += 1
            if own and (len(own) + 1) * (len(terms) + end - hi) > TILE_CELLS:
                break
            own[pairs[hi][0]] = len(own)
            for _, t, _ in pairs[hi:end]:
                terms.setdefault(t, len(terms))
            hi = end
        # sums of impacts below 2**53 are exact in doubles
        exact = max(sum(w for _, _, w in x) for x in _by_query(pairs[lo:hi])) * (IMPACT // 1000) < 1 << 53
        weights = np.zeros((len(own), len(terms)), np.float64 if exact else np.int64)
        for q, t, w in pairs[lo:hi]:
            weights[own[q], terms[t]] += w
        out.append(Tile(np.array(list(own)), pa.array(list(terms), pa.large_binary()), weights))
        lo = hi
    return out


def _by_query(pairs: list) -> list[list]:
    out: dict = {}
    for p in pairs:
        out.setdefault(p[0], []).append(p)
    return list(out.values())


class Visit:
    """The best documents of a tile's queries over the shards that one task sees."""

    def __init__(self, tile: Tile, floor: np.ndarray, best: int):
        self.tile, self.best = tile, best
        many = len(tile.numbers)
        self.score, self.doc = np.zeros((many, 0), np.int64), np.zeros((many, 0), np.int64)
        # what a document must reach: this score, or with this score a smaller doc_id
        self.least_score, self.least_doc = floor.copy(), np.full(many, NO_ID)
        self.visited = 0

    def shards(self, rows: list[dict]) -> None:
        """Visits each query's shards, the highest bound first, until none can add a document."""
        w, held, bounds = self.tile.weights, [], np.zeros((len(rows), len(self.tile.numbers)), np.int64)
        for i, r in enumerate(rows):
            terms = binary_array(np.frombuffer(r["terms"], np.uint8), np.append(0, np.cumsum(np.frombuffer(r["sizes"], "<i4"), dtype=np.int64)))
            at = pc.fill_null(pc.index_in(terms, self.tile.terms), -1).to_numpy()
            here = np.flatnonzero(at >= 0)
            bounds[i] = w[:, at[here]] @ np.frombuffer(r["most"], "<i4")[here].astype(w.dtype)
            held.append((here, at[here]))
        order, ready = np.argsort(-bounds, axis=0, kind="stable"), {}
        lowest, every = np.array([r["least"] for r in rows]), np.arange(len(self.tile.numbers))
        for k in range(len(rows)):
            shard = order[k]
            bound = bounds[shard, every]
            alive = (bound > 0) & (bound >= self.least_score)
            if not alive.any():
                break  # bounds only fall from here
            alive &= (bound > self.least_score) | (lowest[shard] <= self.least_doc)
            for s in np.unique(shard[alive]).tolist():
                if s not in ready:
                    if sum(x[0].size for x in ready.values()) > HELD_CELLS:
                        ready.clear()
                    ready[s] = self.matrix(rows[s], *held[s])
                self.one(ready[s], held[s][1], np.flatnonzero(alive & (shard == s)))

    def matrix(self, r: dict, here: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The impacts of a shard's documents in the tile's terms, and the documents' ids."""
        df = np.frombuffer(r["dfs"], "<i4").astype(np.int64)
        end = np.cumsum(df)
        packed = zstandard.ZstdDecompressor().decompress(r["postings"])
        doc, worth = np.frombuffer(packed, "<u2", int(end[-1])), np.frombuffer(packed, "<i4", int(end[-1]), 2 * int(end[-1]))
        size = df[here]
        take = np.repeat(end[here] - size - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())
        out = np.zeros((len(r["doc_ids"]), len(here)), self.tile.weights.dtype)
        out[doc[take], np.repeat(np.arange(len(here)), size)] = worth[take]
        return out, np.array([NO_ID if i is None else i for i in r["doc_ids"]], np.int64)

    def one(self, ready: tuple, at: np.ndarray, queries: np.ndarray) -> None:
        self.visited += len(queries)
        worth, ids = ready
        score = (self.tile.weights[np.ix_(queries, at)] @ worth.T).astype(np.int64)
        score = np.concatenate([self.score[queries], score], axis=1)
        doc = np.concatenate([self.doc[queries], np.broadcast_to(ids, (len(queries), len(ids)))], axis=1)
        top = np.lexsort((doc, -score), axis=1)[:, : self.best]
        score, doc = np.take_along_axis(score, top, 1), np.take_along_axis(doc, top, 1)
        if (wide := score.shape[1]) > self.score.shape[1]:
            pad = ((0, 0), (0, wide - self.score.shape[1]))
            self.score, self.doc = np.pad(self.score, pad), np.pad(self.doc, pad, constant_values=NO_ID)
        short = self.score.shape[1] - wide
        self.score[queries], self.doc[queries] = np.pad(score, ((0, 0), (0, short))), np.pad(doc, ((0, 0), (0, short)), constant_values=NO_ID)
        if self.score.shape[1] == self.best:
            full = (self.score[queries, -1] > 0) & (self.score[queries, -1] >= self.least_score[queries])
            who = queries[full]
            self.least_score[who], self.least_doc[who] = self.score[who, -1], self.doc[who, -1]

    def found(self) -> pa.RecordBatch:
        row, column = np.nonzero((self.score > 0) & (self.score >= self.least_score[:, None]))
        doc = self.doc[row, column]
        return pa.RecordBatch.from_arrays([pa.array(self.tile.numbers[row], pa.int64()), pa.array(doc, mask=doc == NO_ID), pa.array(self.score[row, column])], ["number", "doc_id", "score"])


def _visited(shards: DataFrame, tiles: list[Tile], floor: dict[int, int], best: int) -> DataFrame:
    """(number, doc_id, score): each task's best documents of each query."""
    floors = [np.array([floor.get(int(q), 0) for q in t.numbers], np.int64) for t in tiles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visits = [Visit(t, f, best) for t, f in zip(tiles, floors, strict=True)]
        for b in batches:
            for lo in range(0, b.num_rows, AT_ONCE):
                rows = b.slice(lo, AT_ONCE).to_pylist()
                for v in visits:
                    v.shards(rows)
        for v in visits:
            yield v.found()

    return shards.mapInArrow(run, "number long, doc_id long, score long")


def _frequencies(shards: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """The number of documents that hold each of a block's terms."""
    own = pa.array(wanted, pa.large_binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted) + 1, np.int64)
        for b in batches:
            raw, size, df = (np.frombuffer(b"".join(b.column(c).to_pylist()), t) for c, t in (("terms", np.uint8), ("sizes", "<i4"), ("dfs", "<i4")))
            at = pc.fill_null(pc.index_in(binary_array(raw, np.append(0, np.cumsum(size, dtype=np.int64))), own), len(wanted)).to_numpy()
            total += np.bincount(at, df, len(wanted) + 1).astype(np.int64)
        some = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    counted = shards.select("terms", "sizes", "dfs").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {wanted[r.term]: r.df for r in counted.collect()}


def _queries(items: DataFrame) -> DataFrame:
    """(number, item_id, term, times): the terms of each query, at most one row for each of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            doc, code, tf, distinct, _ = _counts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("number").take(pa.array(doc)), distinct.take(pa.array(code)).cast(pa.binary()), pa.array(tf)], ["number", "term", "times"])

    return items.select("number", "text").mapInArrow(run, "number long, term binary, times long")


def search(spark: SparkSession, folder: str, items: DataFrame, best: int = BEST) -> DataFrame:
    """Per item the ``best`` documents of the index with a score above 0: item_id, rank, doc_id, score."""
    bounded_batches(spark)
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/shards")
    docs, _, total = spark.read.schema("docs long, terms long, blocks long").parquet(f"{folder}/stats").first()
    some = sorted({i * total // PILOT for i in range(PILOT)})  # blocks of leaves that are far apart
    passing = f"{folder}/queries-{uuid.uuid4().hex}"
    # a query's number is its row's, once written
    items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("number", F.monotonically_increasing_id()).write.parquet(f"{passing}/items")
    named = spark.read.parquet(f"{passing}/items")
    _queries(named).write.parquet(f"{passing}/terms")
    asked = spark.read.schema("number long, term binary, times long").parquet(f"{passing}/terms")
    blocks = max(1, -(-asked.count() // QUERY_TERMS))
    found = None
    for i in range(blocks):
        pairs = sorted((r.number, bytes(r.term), r.times) for r in asked.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == i).collect())  # one block
        tiles = _tiles(pairs, _frequencies(shards, sorted({t for _, t, _ in pairs})), docs)
        first = _visited(shards.filter(F.col("block").isin(some)), tiles, {}, best).groupBy("number").agg(F.sort_array(F.collect_list("score"), False).alias("scores"))
        floor = {r.number: r.scores[best - 1] for r in first.filter(F.size("scores") >= best).collect()}
        one = _visited(shards, tiles, floor, best)
        found = one if found is None else found.unionByName(one)
    place = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= best)
    return ranked.join(named.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
