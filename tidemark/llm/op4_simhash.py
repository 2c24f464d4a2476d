"""SimHash near-duplicates: pairs of fingerprints are discarded by tables of distances to pivots.

The Hamming distances of every fingerprint to a set of reference fingerprints (the pivots) are precomputed.
By the triangle inequality two fingerprints at distance two differ by at most two in every such coordinate:
pairs with a larger coordinate difference are discarded, and only survivors are compared bit by bit. Equal
fingerprints are one.

Tables are compared bucket by bucket, or there would be all pairs. Fingerprints that differ in at most two
bits agree in one of three blocks of bits, so each goes to three buckets, each named by the leading bits of a
block: as many as make a bucket of about BUCKET members, so that what the pivots meet grows with the input and
not with its square. A bucket of more than LARGE members is dealt out again by three parts of its other bits, and a
task divides what still has more than DIVIDE in the same way; neither loses a link. A bucket returns a
spanning forest of its links, never all pairs.

Defined results: null and empty texts have fingerprint zero and are linked like any other; texts of
fewer words than a shingle have one shingle; a component's name is its smallest doc_id, nulls aside;
repeated rows are listed each; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .components import components
from .textscan import bounded_batches, chunks, encode_words, hash_words, joined_words, lower, mix, utf8, window_hashes, words

#: Bits in which linked fingerprints may differ; words in a shingle; the hash's seed.
DISTANCE, SHINGLE, SEED = 2, 3, 42
#: Pivots; members of a bucket as it is named, from which a task divides it, and from which it is dealt out again.
PIVOTS, BUCKET, DIVIDE, LARGE = 16, 256, 512, 100_000
#: First bit and width of the blocks of which two linked fingerprints share one; bits of a bucket's name at most.
BLOCKS, NAME_BITS = ((0, 21), (21, 21), (42, 22)), 21
#: Names of large buckets that are broadcast; more are joined by a shuffle.
MOST_LARGE = 100_000
#: Wide fingerprints, of shingles of five words: bits, bits of a band, first bits that are compared, of these those that may differ, members compared all.
WIDE_SHINGLE, WIDE_BITS, WIDE_BAND, COMPARED, WIDE_RADIUS, NEAR = 5, 1152, 18, 512, 115, 32
#: Similarity of sets of shingles that links, as a fraction; shingles of a part of a group: two parts are verified at once.
SIMILAR, PART = (4, 5), 2_000_000


def fingerprint_batch(raw: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprints of a batch's texts: a bit is set if it is set in over half the shingles' hashes."""
    raw = lower(raw)
    starts, ends, of = words(raw, offsets)
    n = len(of) - 1
    out = np.zeros(n, np.uint64)
    if not len(starts):
        return out
    text, at = joined_words(raw, starts, ends)
    size = np.diff(of)
    count = np.where(size > 0, np.maximum(size - shingle + 1, 1), 0)
    to = np.cumsum(count)
    doc = np.repeat(np.arange(n), count)
    first = of[:-1][doc] + np.arange(to[-1]) - (to - count)[doc]
    last = np.minimum(first + shingle, of[1:][doc])
    data, digest = text.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[i:j], SEED) for i, j in zip(at[first].tolist(), (at[last] - 1).tolist(), strict=True)), np.uint64, len(first))
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    has = np.flatnonzero(count)
    ones = np.add.reduceat(bits, (to - count)[has], axis=0, dtype=np.int32)
    out[has] = np.packbits(ones * 2 > count[has][:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint long) for each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprint_batch(*utf8(b.column("text"))).view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot."""
    pivots = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.bitwise_count(prints[:, None] ^ pivots).astype(np.int16)


def linked_pairs(prints: np.ndarray) -> np.ndarray:
    """Pairs of places of distinct fingerprints that enough links join: all survivors of the pivot tables that verify."""
    m = len(prints)
    if m < 2:
        return np.zeros((0, 2), np.int64)
    if m > DIVIDE:
        differ = int(np.bitwise_or.reduce(prints ^ prints[0]))
        vary = [k for k in range(64) if differ >> k & 1]
        found = []
        for part in range(DISTANCE + 1):
            mask = np.uint64(sum(1 << k for k in vary[part :: DISTANCE + 1]))
            order = np.argsort(prints & mask, kind="stable")
            cut = np.flatnonzero(np.diff(prints[order] & mask)) + 1
            for group in np.split(order, cut):
                if len(group) > 1:
                    found.append(group[linked_pairs(prints[group])])
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    table = pivot_table(prints)
    near = np.abs(table[:, None, 0] - table[None, :, 0]) <= DISTANCE
    i, j = np.nonzero(np.triu(near, 1))
    for k in range(1, PIVOTS):
        stay = np.abs(table[i, k] - table[j, k]) <= DISTANCE
        i, j = i[stay], j[stay]
    stay = np.bitwise_count(prints[i] ^ prints[j]) <= DISTANCE
    return np.stack([i[stay], j[stay]], 1)


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    up = list(range(len(prints)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j in linked_pairs(prints).tolist():
        i, j = root(i), root(j)
        if i != j:
            up[max(i, j)] = min(i, j)
            out.append((i, j))
    return out


def _roots(n: int, pairs: list) -> list[int]:
    """The smallest member of each one's class."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in pairs:
        i, j = root(i), root(j)
        up[max(i, j)] = min(i, j)
    return [root(i) for i in range(n)]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of whole groups, some at a time; rows come sorted by their first ``keys`` columns."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        edge = np.zeros(len(now[0]), bool)
        for c in now[:keys]:
            edge |= c != c[-1]
        end = int(edge.nonzero()[0][-1]) + 1 if edge.any() else 0
        if held and any(h[-1] != c[0] for h, c in zip(held[-1][:keys], now[:keys], strict=True)):
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        if end:  # the last group may go on in the next batch
            yield [np.concatenate(x) for x in zip(*held, [c[:end] for c in now], strict=True)]
            held = []
        held.append([c[end:] for c in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each bucket; rows (two keys, fingerprint) come sorted by bucket."""
    for band, key, prints in _grouped(batches, 2):
        prints = prints.view(np.uint64)
        at = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (key[1:] != key[:-1])))
        size = np.diff(np.append(at, len(band)))
        pairs = []
        for i in np.flatnonzero(size > 1).tolist():
            group = prints[at[i] : at[i] + size[i]]
            pairs += [(group[a], group[b]) for a, b in forest(group)]
        if pairs:
            a, b = np.array(pairs, np.uint64).view(np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], ["a", "b"])


def _buckets(distinct: DataFrame, count: int) -> DataFrame:
    """(band, key, fingerprint): three rows for each fingerprint, nine where a bucket is large."""
    bits = max(0, min(NAME_BITS, math.ceil(math.log2(max(count, 1) / BUCKET))))
    cut = lambda lo, width: F.shiftrightunsigned("fingerprint", lo).bitwiseAND(F.lit((1 << width) - 1))
    name = lambda lo, width: cut(lo + width - bits, bits) if bits else F.lit(0).cast("long")
    keys = F.array(*(F.struct(F.lit(n).cast("long").alias("band"), name(*block).alias("key")) for n, block in enumerate(BLOCKS)))
    named = distinct.select("fingerprint", F.explode(keys).alias("at")).select("at.band", "at.key", "fingerprint")
    large = named.groupBy("band", "key").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE).select("band", "key", F.lit(True).alias("large"))
    few = large.count()
    if not few:
        return named
    # a bucket's other bits, in three parts of which a linked pair shares one again
    marked = named.join(F.broadcast(large) if few <= MOST_LARGE else large, ["band", "key"], "left")
    part = F.explode(F.when(F.col("large"), F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(3)))).alias("part")
    rest = [F.lit(0).cast("long")] * 3
    for n, (lo, width) in enumerate(BLOCKS):
        others = [k for k in range(64) if not lo + width - bits <= k < lo + width]
        own = [sum(1 << k for k in others[p::3]) for p in range(3)]
        rest = [F.when(F.col("band") == n, F.col("fingerprint").bitwiseAND(F.lit(m - (m >> 63 << 64)))).otherwise(r) for m, r in zip(own, rest, strict=True)]
    of_part = F.element_at(F.array(*rest, F.lit(0).cast("long")), F.col("part") + 1)
    marked = marked.select("band", "key", "fingerprint", part).withColumn("rest", of_part)
    # the name of a bucket of a bucket is a hash: two that share it are compared together, which loses nothing
    return marked.select((F.col("band") * 4 + F.col("part")).alias("band"), F.when(F.col("part") == 3, F.col("key")).otherwise(F.xxhash64("key", "rest")).alias("key"), "fingerprint")


def _named(every: DataFrame, distinct: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """``every`` with component_id, the smallest doc_id that its node reaches; ``distinct`` has each node's smallest."""
    roots = components(links).toDF("_at", "root")
    of = distinct.join(roots, distinct[node] == roots["_at"], "left").select(node, "doc_id", F.coalesce("root", node).alias("root"))
    least = of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = of.join(least, "root").select(F.col(node).alias("_node"), "component_id", "root")
    return every.join(named, every[node] == named["_node"]).drop("_node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row."""
    shared_folder(docs.sparkSession)
    every = fingerprints(docs).checkpoint()
    distinct = every.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    count = every.agg(F.approx_count_distinct("fingerprint")).first()[0]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = _buckets(distinct, count).repartition(n, "band", "key").sortWithinPartitions("band", "key").mapInArrow(_bucket_links, "a long, b long")
    return _named(every, distinct, links, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _planes() -> np.ndarray:
    """For each byte of a shingle's hash, its values' directions: a part of the wide fingerprint's bits."""
    return np.random.default_rng(4).choice(np.array([-1, 1], np.float32), (8, 256, WIDE_BITS // 8))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, shingle: int = WIDE_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text a hash of its words and its number of different shingles; the hashes of these, in order within a text."""
    raw = lower(raw)
    starts, ends, of = words(raw, offsets)
    n = len(of) - 1
    text, at = joined_words(raw, starts, ends)
    data = memoryview(text)
    name = np.fromiter((xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(at[of[:-1]], at[of[1:]], strict=True)), np.uint64, n)
    count = np.maximum(np.diff(of) - shingle + 1, 0)
    if not count.any():
        return name, count, np.zeros(0, np.uint64)
    code, distinct = encode_words(raw, starts, ends)
    h = window_hashes(hash_words(distinct)[code], shingle)
    doc = np.repeat(np.arange(n), count)
    h = h[of[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)]
    order = np.lexsort((h, doc))
    h = h[order]  # doc is in order already
    own = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
    return name, np.bincount(doc[own], minlength=n), h[own]


def wide_fingerprints(raw: np.ndarray, offsets: np.ndarray, shingle: int = WIDE_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text a hash of its words, its number of different shingles, and WIDE_BITS bits (rows of bytes).

    A text's different shingles are counted by each byte of their hashes; each bit is the side of a random plane on
    which the counts lie, less their mean.
    """
    name, count, h = shingle_sets(raw, offsets, shingle)
    n = len(name)
    bits = np.zeros((n, WIDE_BITS // 8), np.uint8)
    if len(h):
        doc = np.repeat(np.arange(n), count)
        byte = h.view(np.uint8).reshape(-1, 8)
        planes = _planes()
        for lo in range(0, n, 512):
            i, j = np.searchsorted(doc, lo), np.searchsorted(doc, lo + 512)
            m = min(512, n - lo)
            sums = []
            for k in range(8):
                seen = np.bincount((doc[i:j] - lo) * 256 + byte[i:j, k], minlength=m * 256).reshape(m, 256).astype(np.float32)
                sums.append((seen - seen.mean(1, keepdims=True)) @ planes[k])
            # each byte of the hash has its share of the bits that are compared, which come first
            split = COMPARED // 8
            bits[lo : lo + m] = np.packbits(np.concatenate([x[:, :split] for x in sums] + [x[:, split:] for x in sums], 1) > 0, axis=1)
    return name, count, bits


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        name, count, bits = wide_fingerprints(*utf8(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(name.view(np.int64)), pa.array(count.astype(np.int64)), pa.array([x.tobytes() for x in bits], pa.binary())], ["doc_id", "digest", "node", "shingles", "bits"])


def _wide_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of each fingerprint: WIDE_BAND of its bits name a bucket."""
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint8).reshape(part.num_rows, -1)
            flat = np.unpackbits(bits, axis=1)
            bands = flat[:, : flat.shape[1] // WIDE_BAND * WIDE_BAND].reshape(part.num_rows, -1, WIDE_BAND).astype(np.int64)
            key = (bands << np.arange(WIDE_BAND)).sum(2) + (np.arange(bands.shape[1]) << WIDE_BAND)
            who = pa.array(np.repeat(np.arange(part.num_rows), bands.shape[1]))
            compared = pa.array([x.tobytes() for x in bits[:, : COMPARED // 8]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), part.column("node").take(who), compared.take(who)], ["key", "node", "bits"])


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1)


def _large_bucket(bits: np.ndarray) -> np.ndarray:
    """Pairs of places that join whatever a comparison of all rows with all would join.

    A member goes to the ball of the nearest leader within the radius, or leads a ball of its own. Whoever is near a
    member of a ball is within two radii of its leader, by the triangle inequality: other balls are discarded, and
    those left are compared member by member unless they are joined already.
    """
    m = len(bits)
    up, found = list(range(m)), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            found.append((j, i))

    leaders, heads, balls = [], np.empty_like(bits), []
    for i in range(m):
        far = _far(heads[: len(leaders)], bits[i])
        around = np.flatnonzero(far <= 2 * WIDE_RADIUS)
        inside = around[far[around] <= WIDE_RADIUS]
        for k in inside.tolist():
            join(i, leaders[k])
        for k in around.tolist():
            if far[k] > WIDE_RADIUS and root(leaders[k]) != root(i):
                ball = np.array(balls[k])
                near = np.flatnonzero(_far(bits[ball], bits[i]) <= WIDE_RADIUS)
                if len(near):
                    join(i, int(ball[near[0]]))
        if len(inside):
            balls[inside[far[inside].argmin()]].append(i)
        else:
            heads[len(leaders)] = bits[i]
            leaders.append(i)
            balls.append([i])
    return np.array(found, np.int64).reshape(-1, 2)


def _wide_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within buckets of wide fingerprints; rows come sorted by bucket.

    Members of a bucket of up to NEAR are compared all, side by side for all buckets of a batch; a larger one is
    joined by _large_bucket. Both join the same members.
    """

    def links(key: np.ndarray, node: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = []
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(at, len(key)))
        own = np.repeat(size, size)
        for step in range(1, NEAR):
            i = np.flatnonzero((own[:-step] <= NEAR) & (key[:-step] == key[step:])) if step < len(key) else []
            if not len(i):
                break
            i = i[_far(bits[i], bits[i + step]) <= WIDE_RADIUS]
            found.append(np.stack([node[i], node[i + step]], 1))
        for g in np.flatnonzero(size > NEAR).tolist():
            lo, hi = int(at[g]), int(at[g] + size[g])
            found.append(node[lo + _large_bucket(bits[lo:hi])])
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        if len(pairs):
            # a star for each class: its members and the smallest of them, never all pairs
            nodes, at = np.unique(pairs, return_inverse=True)
            root = np.array(_roots(len(nodes), np.unique(at.reshape(-1, 2), axis=0).tolist()))
            rest = np.flatnonzero(root != np.arange(len(nodes)))
            if len(rest):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[root[rest]]), pa.array(nodes[rest])], ["a", "b"])

    for key, node, bits in _grouped(batches, 1):
        yield from links(key, node, np.frombuffer(b"".join(bits.tolist()), np.uint64).reshape(len(bits), -1))


def exact_links(sets: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Pairs of places of sets (``sets[of[i] : of[i + 1]]``, hashes) that join whatever all pairs with a Jaccard similarity of SIMILAR or more join.

    One minus the similarity is a distance, so balls around leaders are discarded as in _large_bucket. Leaders come in
    steps; those that a step before joined with the set at hand, and what they lead, need no comparison.
    """
    m = len(of) - 1
    size = np.diff(of)
    num, den = SIMILAR
    code = np.unique(sets, return_inverse=True)[1].astype(np.int32)
    mark = np.zeros(int(code.max(initial=0)) + 1, bool)
    found = []
    group = np.arange(m)  # the class of each set, and below that of each leader
    members = [[i] for i in range(m)]
    leaders, heads, balls = np.zeros(m, np.int64), np.zeros(m, np.int64), []

    def join(i: int, j: int) -> None:
        a, b = int(group[i]), int(group[j])
        if a != b:
            a, b = (a, b) if len(members[a]) >= len(members[b]) else (b, a)
            group[members[b]] = a
            members[a] += members[b]
            members[b] = []
            heads[:n] = np.where(heads[:n] == b, a, heads[:n])
            found.append((j, i))

    def shared(others: np.ndarray) -> np.ndarray:
        """How many elements each of these sets has in common with the marked one."""
        of_each = size[others]
        to = np.cumsum(of_each)
        at = np.arange(to[-1]) + np.repeat(of[others] - (to - of_each), of_each)
        return np.add.reduceat(mark[code[at]], to - of_each, dtype=np.int64)

    n = 0
    for i in range(m):
        mark[code[of[i] : of[i + 1]]] = True
        ball, lo, step = -1, 0, 32
        while lo < n:
            at = lo + np.flatnonzero(heads[lo : min(lo + step, n)] != group[i])
            lo, step = lo + step, 4 * step
            # a member of a ball that is near has a leader within twice the distance
            at = at[np.minimum(size[leaders[at]], size[i]) * den >= (2 * num - den) * np.maximum(size[leaders[at]], size[i])]
            if not len(at):
                continue
            both = shared(leaders[at])
            either = size[leaders[at]] + size[i] - both
            inside = both * den >= num * either
            for k in at[inside].tolist():
                join(i, leaders[k])
                ball = k if ball < 0 else ball
            near = at[~inside & (both * den >= (2 * num - den) * either)]
            near = near[heads[near] != group[i]]
            if len(near):
                its = np.concatenate([np.array(balls[k]) for k in near.tolist()])
                its = its[np.minimum(size[its], size[i]) * den >= num * np.maximum(size[its], size[i])]
                if len(its):
                    both = shared(its)
                    for j in its[both * den >= num * (size[its] + size[i] - both)].tolist():
                        join(i, j)
        mark[code[of[i] : of[i + 1]]] = False
        if ball >= 0:
            balls[ball].append(i)
        else:
            leaders[n], heads[n] = i, group[i]
            balls.append([i])
            n += 1
    return np.array(found, np.int64).reshape(-1, 2)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of texts that are similar as sets; rows come sorted by group and block."""
    now, nodes, sets, count = None, [], [], []

    def links() -> Iterator[pa.RecordBatch]:
        node, size = np.concatenate(nodes), np.concatenate(count)
        pairs = node[exact_links(np.concatenate(sets), np.append(0, np.cumsum(size)))]
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pairs.T], ["a", "b"])

    for batch in batches:
        for b in chunks([batch]):
            _, size, h = shingle_sets(*utf8(b.column("text")))
            to = np.append(0, np.cumsum(size))
            group, block, node = (b.column(c).to_numpy() for c in ("group", "block", "node"))
            cut = np.flatnonzero((group[1:] != group[:-1]) | (block[1:] != block[:-1])) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(group)], strict=True):
                if now != (group[i], block[i]):
                    if now is not None:
                        yield from links()
                    now, nodes, sets, count = (group[i], block[i]), [], [], []
                nodes.append(node[i:j])
                count.append(size[i:j])
                sets.append(h[to[i] : to[j]])
    if now is not None:
        yield from links()


def _node_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node of each text, once a batch, and the text."""
    for b in chunks(batches):
        node, at = np.unique(nodes_of(b.column("text")), return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(node), b.column("text").take(pa.array(at))], ["node", "text"])


def nodes_of(column: pa.Array) -> np.ndarray:
    """A hash of each text's words."""
    raw, offsets = utf8(column)
    raw = lower(raw)
    starts, ends, of = words(raw, offsets)
    text, at = joined_words(raw, starts, ends)
    data = memoryview(text)
    return np.fromiter((xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(at[of[:-1]], at[of[1:]], strict=True)), np.uint64, len(of) - 1).view(np.int64)


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), node, component_id and root (a node) of each row: documents whose sets of five-word shingles have a similarity of 0.8 or more.

    Wide fingerprints find groups: at 0.8 they differ in about 15 % of their bits, unrelated ones in half.
    WIDE_BITS // WIDE_BAND bands of WIDE_BAND bits name buckets; a pair at 0.8 shares one with a probability of
    0.97, a pair at 0.85 and above with over 0.99; within a bucket up to WIDE_RADIUS of the COMPARED bits may differ,
    to which similarities of about 0.6 correspond. What these candidates join is a group, and in each group the sets
    themselves decide: every pair of it at 0.8 or more is joined, no other. A group of more than PART shingles is cut
    into parts, and each pair of parts is a block of its own. Texts with the same words are one node; those of fewer
    words than a shingle have no links.
    """
    shared_folder(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text").mapInArrow(_wide, "doc_id long, digest long, node long, shingles long, bits binary").checkpoint()
    distinct = every.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    asked = every.filter("shingles > 0").select("node", "bits").distinct()
    buckets = asked.mapInArrow(_wide_buckets, "key long, node long, bits binary").repartition(n, "key").sortWithinPartitions("key", "node")
    roots = components(buckets.mapInArrow(_wide_links, "a long, b long"))
    members = roots.select("node", F.col("root").alias("group")).union(roots.select(F.col("root").alias("node"), F.col("root").alias("group"))).distinct()
    sizes = every.groupBy("node").agg(F.max("shingles").alias("shingles"))
    members = members.join(sizes, "node")
    parts = members.groupBy("group").agg(F.ceil(F.sum("shingles") / PART).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    block = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    # one part is one block; of several, a part meets each other one, and itself in all of these
    placed = members.join(parts, "group").withColumn("part", part).withColumn("other", other).filter("parts = 1 OR part <> other").select("node", "group", block.alias("block"))
    texts = docs.select("text").mapInArrow(_node_texts, "node long, text string").dropDuplicates(["node"])
    blocks = placed.join(texts, "node").select("group", "block", "node", "text")
    links = blocks.repartition(n, "group", "block").sortWithinPartitions("group", "block", "node").mapInArrow(_verified, "a long, b long")
    return _named(every.select("doc_id", "digest", "node"), distinct, links, "node")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of which each is the one with the smallest doc_id of its component; columns as they were.

    A doc_id with several texts is a document for each of them; if one component has them all, the text of the
    smallest hash stays. Repeated rows are one document. Rows without a doc_id can't be named by a component and stay all.
    """
    found = similar(docs)
    first = found.filter("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("r")).select(F.col("r.doc_id").alias("_first"), F.col("r.digest").alias("_digest")).distinct()
    named = docs.withColumns({"_of_first": F.col("doc_id").cast("long"), "_of_digest": F.xxhash64("text")})
    kept = named.join(first, (F.col("_of_first") == F.col("_first")) & (F.col("_of_digest") == F.col("_digest")), "left_semi").dropDuplicates(["_of_first", "_of_digest"])
    return kept.drop("_of_first", "_of_digest").unionByName(docs.filter(F.col("doc_id").isNull()))
