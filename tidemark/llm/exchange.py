"""Exchanges of packed arrays between Python stages.

Rows are (bucket, kind, doc_id, n, sha, payload). A stage packs what belongs to one bucket into one
binary payload, Spark deals the rows out by bucket and sorts them, and the next stage streams one
bucket after another. The number of buckets grows with the input, so one bucket fits a worker's memory
at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SCHEMA = "bucket int, kind int, doc_id long, n long, sha string, payload binary"
NAMES = ["bucket", "kind", "doc_id", "n", "sha", "payload"]
TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
#: kinds: packed arrays, a document's text, a finished row; arrays come first within a bucket
ARRAYS, TEXT, DONE = range(3)
#: Bytes of input, as the optimiser estimates them, for each bucket.
BUCKET_BYTES = 1 << 20


def bucket_count(df: DataFrame) -> int:
    """Buckets for an input of this size; where the size is unknown, four to a shuffle partition."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(1 << 30, max(1, size // BUCKET_BYTES))


def dealt(df: DataFrame) -> DataFrame:
    """Each bucket in one partition, its rows together and ordered by kind."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")


def rows(**columns) -> pa.RecordBatch:
    """A batch of the exchange's schema; columns that aren't given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(NAMES, TYPES, strict=True)], NAMES)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Runs of rows of one bucket and kind, in order."""
    for b in batches:
        if not b.num_rows:
            continue
        bucket, kind = (b.column(i).to_numpy() for i in (0, 1))
        cut = np.flatnonzero(np.diff(bucket) | np.diff(kind)) + 1
        for i, j in zip([0, *cut], [*cut, b.num_rows], strict=True):
            yield int(bucket[i]), int(kind[i]), b.slice(i, j - i)


def pack(bucket: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Entries grouped by bucket: for each bucket the bytes of all columns, one after another."""
    if not len(bucket):
        return bucket, []
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    cut = np.flatnonzero(np.diff(sorted_bucket)) + 1
    edges = [0, *cut.tolist(), len(order)]
    columns = [np.ascontiguousarray(c[order]) for c in columns]
    return sorted_bucket[edges[:-1]], [b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(edges, edges[1:], strict=False)]


def unpack(payloads: list[bytes], *types: np.dtype) -> list[np.ndarray]:
    """The columns of all payloads, joined."""
    width = sum(np.dtype(t).itemsize for t in types)
    out: list[list[np.ndarray]] = [[] for _ in types]
    for p in payloads:
        n, at = len(p) // width, 0
        for k, t in enumerate(types):
            out[k].append(np.frombuffer(p, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, types, strict=True)]


def pack_texts(bucket: np.ndarray, doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Texts with their ids, those of one bucket in one compressed payload."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    squeeze = zstandard.ZstdCompressor(level=5).compress
    ids, data = doc_ids.to_pylist(), texts.cast(pa.binary()).to_pylist()
    home, payload = [], []
    for group in np.split(order, cut) if len(order) else []:
        none = np.array([ids[i] is None for i in group], np.uint8)
        number = np.array([ids[i] or 0 for i in group], np.int64)
        size = np.array([len(data[i]) for i in group], np.int64)
        home.append(int(bucket[group[0]]))
        payload.append(squeeze(b"".join([np.int64(len(group)).tobytes(), none.tobytes(), number.tobytes(), size.tobytes(), *(data[i] for i in group)])))
    return rows(bucket=np.array(home, np.int32), kind=np.full(len(home), TEXT, np.int32), payload=payload)


def unpack_texts(part: pa.RecordBatch) -> pa.RecordBatch:
    """(doc_id, text) of all payloads of a run of TEXT rows."""
    ids, texts = [], []
    for x in part.column("payload").to_pylist():
        x = zstandard.ZstdDecompressor().decompress(x)
        n = int(np.frombuffer(x, np.int64, 1)[0])
        none, at = np.frombuffer(x, np.uint8, n, 8), 8 + n
        ids += [None if a else b for a, b in zip(none.tolist(), np.frombuffer(x, np.int64, n, at).tolist(), strict=True)]
        at += 8 * n
        end = np.cumsum(np.frombuffer(x, np.int64, n, at)) + at + 8 * n
        texts += [x[i:j] for i, j in zip([at + 8 * n, *end[:-1].tolist()], end.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])
