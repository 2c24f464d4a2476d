"""Token ids as binary files: frequency ranks in byte-aligned codes of variable length.

Ids are counted over all documents and replaced by their ranks, so that the commonest 256 ids take one byte and all
others of a usual vocabulary two. A code has no flag bits: the lengths of four codes stand in one control byte
in a stream of their own, and the data bytes follow each other in another. Decoding looks the lengths of four
codes up by their control byte and puts all bytes of a block in place at once.

A folder holds ``ranks`` (id, rank) and ``blocks``, both Parquet, so that Spark's readers, writers and commits
serve any store. A row of ``blocks`` is a run of documents: the shard, where the run starts within it, the documents'
ids and token counts, and the two streams. Shards are ranges of (doc_id, place in the input), so equal
doc_ids are spread too, and what stands before a shard is a sum over the shards' totals.

The tokenizer sees each different word of a batch once. Words are cut at ASCII white space and between a letter or
digit and a stop, which neither its normaliser nor its pattern looks across, and A-Z is lowered before
(``separable`` tries a vocabulary for both); each worker remembers words of bounded bytes.

Defined results: a null text is an empty one and has the end id only; rows without a doc_id come first; rows that
share a doc_id follow each other in the order in which the table is read; an empty table gives files
without blocks; other columns are left alone.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import remove, shared_folder
from .textscan import binary_array, bounded_batches, chunks, encode_words, lower, utf8, words

#: Id that ends each document.
END = 2
#: Ids of a block (or one document), and ids of a shard.
BLOCK_IDS, SHARD_IDS = 1 << 20, 16 << 20
#: Bytes of words and ids that a worker remembers before it starts anew.
CACHE_BYTES = 32 << 20
#: Words encoded in one call of the library, and the word that stands between them.
TOGETHER, MARK = 500, "\x01"
#: Characters that words are cut at.
CUTS = "\t\n\x0b\x0c\r "
_STOP, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
BLOCKS = "shard int, block int, start long, doc_ids array<long>, counts_control binary, counts binary, control binary, data binary"
#: For each control byte the lengths of its four codes, and which of their 16 bytes are there.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
PRESENT = (np.arange(4) < LENGTHS[:, :, None]).reshape(256, 16)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """The control bytes and the data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[: len(v)] = code
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of two streams."""
    there = PRESENT[np.frombuffer(control, np.uint8)].reshape(-1)
    there[4 * n :] = False
    out = np.zeros(len(there), np.uint8)
    out[there] = np.frombuffer(data, np.uint8)
    return out.view("<u4")[:n]


class Words:
    """The library's tokenizer with a cache of words, bounded in bytes."""

    def __init__(self, path: str, special: bool, end_id: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        mark = self.plain([MARK])[0]
        #: Width of an id before it has a rank.
        self.kind = "<u2" if max(end_id, *self.tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4"
        #: The id that stands between words that are encoded together, if the vocabulary has one for it.
        self.mark = mark[0] if len(mark) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at, self.ids, self.bytes = np.zeros(1, np.int64), np.zeros(0, np.uint32), 0

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has: many at once, with a mark between."""
        got = [np.array(x, np.uint32) for x in self.plain([f" {MARK} ".join(texts[i : i + TOGETHER]) for i in range(0, len(texts), TOGETHER)])]
        ids = np.concatenate([np.append(x, np.uint32(self.mark)) for x in got]) if got else np.zeros(0, np.uint32)
        ends = np.flatnonzero(ids == self.mark)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def learn(self, new: list[bytes]) -> None:
        """Encodes words that the cache lacks."""
        odd = [w for w in new if self.mark is None or MARK.encode() in w]
        usual = [w for w in new if w not in set(odd)] if odd else new
        ids, size = self.apart([w.decode(errors="replace") for w in usual])
        one_by_one = self.plain([w.decode(errors="replace") for w in odd])
        self.known.update(zip([*usual, *odd], range(len(self.at) - 1, len(self.at) - 1 + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, ids, *(np.array(x, np.uint32) for x in one_by_one)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([*size, *map(len, one_by_one)], dtype=np.int64)])
        self.bytes += sum(map(len, new))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a batch, one after another, and each document's range."""
        raw = shared_case(raw)
        cut = np.flatnonzero(_STOP[raw[1:]] & _PLAIN[raw[:-1]]) + 1  # a stop after a letter or digit is in no token with it
        starts, ends, _ = words(raw, np.concatenate([offsets, cut]))
        which, distinct = encode_words(raw, starts, ends)
        if self.bytes + 4 * len(self.ids) > CACHE_BYTES:
            self.forget()
        keys = distinct.to_pylist()
        if new := [w for w in keys if w not in self.known]:
            self.learn(new)
        place = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[which]
        length = (self.at[1:] - self.at[:-1])[place]
        end = np.append(0, np.cumsum(length))
        ids = self.ids[np.repeat(self.at[place] - end[:-1], length) + np.arange(end[-1])]
        return ids, end[np.searchsorted(starts, offsets)]


def shared_case(raw: np.ndarray) -> np.ndarray:
    """A-Z lowered, as the normaliser does, so that words meet in the cache.

    Not where a code point beyond ASCII follows, which may compose with the letter, and not in a batch that may spell a special token.
    """
    if len(raw) < 2 or (np.flatnonzero(raw[:-1] == 60).size and (raw[np.flatnonzero(raw[:-1] == 60) + 1] == 124).any()):
        return raw
    out = lower(raw)
    before = np.append(raw[1:] >= 128, False)
    out[before] = raw[before]
    return out


@lru_cache(2)
def load(path: str, special: bool, end_id: int = END) -> Words:
    return Words(path, special, end_id)


def separable(path: str, sample: list[str] = ("a", "Z", "é", "1", "!", "'s", "'", "́", "<|endoftext|>")) -> bool:
    """Whether no pair of these is encoded otherwise across a cut than apart."""
    one = load(path, True)
    apart = dict(zip(sample, one.plain(list(sample)), strict=True))
    pairs = [(a, c, b) for a in sample for b in sample for c in CUTS]
    whole = all(got == apart[a] + apart[b] for got, (a, _, b) in zip(one.plain(["".join(p) for p in pairs]), pairs, strict=True))
    stops = all(one.plain([a + b, a, b])[0] == sum(one.plain([a, b]), []) for a in "aZ1" for b in (".", ",'", "!!", "?a", ":'s", ";1"))
    return whole and stops and one.plain(["ABC"]) == one.plain(["abc"])


def _encoded(docs: DataFrame, path: str, end_id: int, special: bool) -> DataFrame:
    """(doc_id, place, n, ids): each document's ids as unsigned integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = load(path, special, end_id)
        for b in chunks(batches):
            ids, at = one.encode(*utf8(b.column("text")))
            ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))  # an end after each document
            ids = np.ascontiguousarray(ids, one.kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("place"), pa.array(np.diff(at)), binary_array(ids.view(np.uint8), ids.itemsize * at).cast(pa.binary())], ["doc_id", "place", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    return rows.mapInArrow(run, "doc_id long, place long, n long, ids binary")


def _ranks(encoded: DataFrame, kind: str) -> list[tuple[int, int]]:
    """(id, rank) of all ids that occur, the commonest first; at most as many as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in chunks(batches, "ids"):
            got = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), kind), minlength=len(total))
            got[: len(total)] += total
            total = got
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    counted = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [(i, k) for k, (i, _) in enumerate(sorted(((r.id, r.n) for r in counted.collect()), key=lambda x: (-x[1], x[0])))]


def _row(block: int, start: int, docs: list, counts: np.ndarray, ranks: np.ndarray) -> pa.RecordBatch:
    cells = [TaskContext.get().partitionId(), block, start, docs, *pack(counts), *pack(ranks)]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])


def write(docs: DataFrame, path: str, folder: str, end_id: int = END, special: bool = True) -> None:
    """Writes the ids of all texts, documents in ascending doc_id order, each with the end id after it.

    ``special``: special tokens that a text spells out become their ids, as the library does unless told otherwise.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if not separable(path):
        raise ValueError(f"{path} encodes words otherwise when white space stands beside them")
    passing = f"{folder}/encoded"
    _encoded(docs, path, end_id, special).write.option("compression", "zstd").parquet(passing)
    encoded = spark.read.schema("doc_id long, place long, n long, ids binary").parquet(passing)
    kind = load(path, special, end_id).kind
    table = _ranks(encoded, kind)
    spark.createDataFrame(table, "id long, rank long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(max([i for i, _ in table], default=0) + 1, "<u4")
    for i, k in table:
        rank_of[i] = k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, held, parts, start, block = [], [], 0, [], 0, 0
        for b in chunks(batches, "ids", 4 * BLOCK_IDS):
            if held and held + sum(b.column("n").to_pylist()) > BLOCK_IDS:
                yield _row(block, start, ids, np.array(counts), np.concatenate(parts))
                start, block, ids, counts, held, parts = start + held, block + 1, [], [], 0, []
            ids += b.column("doc_id").to_pylist()
            counts += b.column("n").to_pylist()
            parts.append(rank_of[np.frombuffer(b"".join(b.column("ids").to_pylist()), kind)])
            held += len(parts[-1])
        if held:
            yield _row(block, start, ids, np.array(counts), np.concatenate(parts))

    total = encoded.agg(F.sum("n")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_IDS))
    order = [F.col("doc_id").asc_nulls_first(), "place"]
    encoded.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    remove(spark, passing)


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with ``before``, the ids of all shards before theirs."""
    every = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    counts = lambda b: pa.array([int(unpack(c, d, len(i)).sum()) for i, c, d in zip(*(b.column(k).to_pylist() for k in ("doc_ids", "counts_control", "counts")), strict=True)], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("shard"), counts(b)], ["shard", "n"])

    totals = every.select("shard", "doc_ids", "counts_control", "counts").mapInArrow(run, "shard int, n long").groupBy(F.col("shard").alias("_shard")).agg(F.sum("n").alias("n"))
    # a row for each shard, so one task can add them and a broadcast holds them
    earlier = Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return every.join(F.broadcast(totals), F.col("shard") == F.col("_shard")).drop("_shard")


def _each(spark: SparkSession, folder: str, column: str, kind: str, what) -> DataFrame:
    bounded_batches(spark)
    ids = np.array([r.id for r in spark.read.schema("id long, rank long").parquet(f"{folder}/ranks").orderBy("rank").collect()], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                counts = unpack(r["counts_control"], r["counts"], len(r["doc_ids"])).astype(np.int64)
                end = np.append(0, np.cumsum(counts))
                own = ids[unpack(r["control"], r["data"], int(end[-1]))]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(r["before"] + r["start"] + end[:-1]), pa.array(counts), what(own, end)], ["doc_id", "start", "n_tokens", column])

    return blocks(spark, folder).mapInArrow(run, f"doc_id long, start long, n_tokens long, {column} {kind}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a folder: doc_id, start, n_tokens and ids."""
    return _each(spark, folder, "ids", "array<long>", lambda own, end: pa.ListArray.from_arrays(pa.array(end.astype(np.int32)), pa.array(own.astype(np.int64))))


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a folder: doc_id, start, n_tokens and ids_crc32."""
    return _each(spark, folder, "ids_crc32", "long", lambda own, end: pa.array([zlib.crc32(memoryview(own[i:j]).cast("B")) for i, j in zip(end, end[1:], strict=False)], pa.int64()))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
