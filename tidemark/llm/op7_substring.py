"""Removal of repeated passages, found by difference-cover anchors.

A window is 35 consecutive words. {3, 6, 7, 12, 14} is a difference cover modulo 21: for any two
places i and j there is a shift below 21 after which both are cover positions. So if two windows hold
the same words, an anchor of 15 words at a cover position of either document lies in both at the same
shift, and it is enough to hash anchors at 5 of 21 positions. An anchor that occurs more than once is
extended: the windows that contain it are hashed whole (64 bits and, by its bucket, those of a second
hash), and those that occur more than once are removed, each after a look at its own text. No pairs are
made: both steps count keys. Of the equal keys that a task meets only the first two are dealt out by their
key; the others are known to repeat and go anywhere, so a passage that fills a third of all rows puts about
two rows for each task into a bucket. Of equal rows (doc_id and text) a task sends on two as well: the others are
repeated whole, so they are done at once.

Defined results: null and empty texts have no words and the hash of nothing; rows with equal doc_id
and text count as two occurrences; a null doc_id is kept as a document of its own; empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ARRAYS, DONE, SCHEMA, bucket_count, dealt, pack, pack_texts, rows, runs, unpack, unpack_texts
from .textscan import bounded_batches, chunks, encode_words, hash_words, joined_words, mix, utf8, window_hashes, words

#: fixed values: a difference cover modulo 21
COVER, PERIOD = (3, 6, 7, 12, 14), 21
#: Words in a window.
WINDOW = 35
ANCHOR = WINDOW - PERIOD + 1
KNOWN = np.uint32(1 << 31)
#: Keys that a task remembers of each kind: those met once, and those met again.
REMEMBERED = 1 << 20
LOW40 = np.uint64((1 << 40) - 1)
#: Columns of the packed arrays: key, document, place; the first step needs fewer bits, as its errors only cost time.
ANCHOR_TYPES = ("<u4", "u1", "<u4", "u1", "<u4")
WINDOW_TYPES = ("<u8", "<u4", "<u2", "<u4")
FLAG_TYPES = {False: ("<u4", "u1", "<u4"), True: ("<u4", "<u2", "<u4", "<u4")}


def _documents(batch: pa.RecordBatch) -> np.ndarray:
    """A key for each row, from doc_id and text: its low 48 bits name it, of which 40 in the first step."""
    out = np.empty(batch.num_rows, np.uint64)
    raw, at = utf8(batch.column("text"))
    data = memoryview(raw)
    for i, doc in enumerate(batch.column("doc_id").to_pylist()):
        out[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i + 1]], 0 if doc is None else doc & 0xFFFFFFFFFFFFFFFF) ^ (doc is None)
    return out


def _home(doc: np.ndarray, buckets: int) -> np.ndarray:
    return ((doc & LOW40) % np.uint64(buckets)).astype(np.int32)


def _split40(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32) & np.uint64(0xFF)).astype(np.uint8)


def _join40(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) | b.astype(np.uint64) << np.uint64(32)


class _Seen:
    """The keys that a task has met, so that those of a passage in all of its chunks are dealt out twice and not once a chunk.

    What it remembers is bounded; a key that was forgotten is dealt out once more, which changes no result.
    """

    def __init__(self):
        self.once = self.often = np.zeros(0, np.uint64)
        task = TaskContext.get()
        self.count = (task.partitionId() if task else 0) << 40  # tells the copies of tasks and chunks apart

    def spread(self, key: np.ndarray, other: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and places in which each key that isn't known to repeat stands once; further copies are marked as known and get keys and buckets of their own.

        The second time a key is met it is dealt out with a mark, so that the first one is found to repeat; after that
        all of its copies go anywhere. The low 32 bits of a key stay, so that a place can be checked against its text
        in the end.
        """
        name, first, of, count = np.unique(key ^ mix(other + np.uint64(1)), return_index=True, return_inverse=True, return_counts=True)
        once, often = _among(name, self.once), _among(name, self.often)
        repeats = once | often | (count > 1)
        key, other, place = key.copy(), other.copy(), place.copy()
        place[repeats[of]] |= KNOWN
        extra = np.ones(len(key), bool)
        extra[first[~often]] = False
        extra = np.flatnonzero(extra)
        own = mix(key[extra] + mix(extra.astype(np.uint64) + np.uint64(self.count + 0x51ED270B)))
        self.count += len(key)
        key[extra] = (key[extra] & np.uint64(0xFFFFFFFF)) | (own << np.uint64(32))
        other[extra] = mix(own)
        self.once = _with(self.once, name[~repeats])
        self.often = _with(self.often, name[repeats & ~often])
        return key, other, place


class _Copies:
    """Tells the equal rows that a task has met twice: they are repeated whole, whatever else there is.

    What it remembers is bounded; a row that was forgotten goes the usual way twice more, which changes no result.
    """

    def __init__(self):
        self.met: dict[int, int] = {}

    def more(self, documents: np.ndarray) -> np.ndarray:
        """Which rows are the third or a later of their kind."""
        if len(self.met) > REMEMBERED:
            self.met.clear()
        out = np.zeros(len(documents), bool)
        for i, key in enumerate(documents.tolist()):
            self.met[key] = n = self.met.get(key, 0) + 1
            out[i] = n > 2
        return out


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _with(known: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Both in order; only the new ones if there would be too many."""
    return np.sort(np.concatenate([known, more]), kind="stable") if len(known) + len(more) <= REMEMBERED else more


def _anchors(buckets: int):
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, copies = _Seen(), _Copies()
        for b in chunks(batches):
            b = b.filter(pa.array(~copies.more(_documents(b))))
            raw, at = utf8(b.column("text"))
            starts, ends, of = words(raw, at)
            size = np.diff(of)
            if not len(starts) or size.max() < WINDOW:
                continue
            code, distinct = encode_words(raw, starts, ends)
            key = window_hashes(hash_words(distinct)[code], ANCHOR)
            place = np.arange(len(code)) - np.repeat(of[:-1], size)
            long = np.repeat(size, size)
            at_cover = np.flatnonzero((cover[place % PERIOD] & (place + ANCHOR <= long) & (long >= WINDOW))[: len(key)])
            key, place, doc = key[at_cover], place[at_cover].astype(np.uint32), np.repeat(_documents(b), size)[at_cover] & LOW40
            # the bits that choose the bucket are not among the 40 that are kept
            key, other, place = seen.spread(key, mix(key), place)
            bucket, payload = pack((other % np.uint64(buckets)).astype(np.int32), *_split40(key & LOW40), *_split40(doc), place)
            for i in range(0, len(bucket), 256):
                part = bucket[i : i + 256]
                yield rows(bucket=part, kind=np.full(len(part), ARRAYS, np.int32), payload=payload[i : i + 256])

    return run


def _repeated(buckets: int, exact: bool):
    """Of each bucket's keys, the documents and places of those that occur more than once."""

    def flags(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        if exact:
            key, doc, doc_high, place = unpack(payloads, *WINDOW_TYPES)
        else:
            a, b, doc, doc_high, place = unpack(payloads, *ANCHOR_TYPES)
            key = _join40(a, b)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        group = np.append(0, np.cumsum(~same))
        many = np.bincount(group)[group] > 1
        many |= np.bincount(group, (place[order] & KNOWN) != 0)[group] > 0
        hit = order[many]
        if not len(hit):
            return
        check = ((key[hit] & np.uint64(0xFFFFFFFF)).astype(np.uint32),) if exact else ()
        bucket, payload = pack(_home(_join40(doc[hit], doc_high[hit]), buckets), doc[hit], doc_high[hit], place[hit] & ~KNOWN, *check)
        for i in range(0, len(bucket), 1024):
            part = bucket[i : i + 1024]
            yield rows(bucket=part, kind=np.full(len(part), ARRAYS, np.int32), payload=payload[i : i + 1024])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, payloads = None, []
        for bucket, kind, part in runs(batches):
            if bucket != now:
                if payloads:
                    yield from flags(payloads)
                now, payloads = bucket, []
            if kind == ARRAYS:
                payloads += part.column("payload").to_pylist()
            else:
                yield part
        if payloads:
            yield from flags(payloads)

    return run


class _Flags:
    """The flagged places of one bucket's documents."""

    def __init__(self, payloads: list[bytes], exact: bool):
        low, high, place, *check = unpack(payloads, *FLAG_TYPES[exact])
        doc = _join40(low, high)
        # equal rows flag the same places: each counts once, or m rows would bring m times m
        order = np.lexsort((*(check if exact else ()), place, doc))
        same = [x[order][1:] == x[order][:-1] for x in (doc, place, *(check if exact else ()))]
        order = order[np.append(True, ~np.logical_and.reduce(same))] if len(order) else order
        self.mask = np.uint64((1 << 48) - 1) if exact else LOW40
        self.doc, self.place, self.check = doc[order], place[order].astype(np.int64), check[0][order] if exact else None

    def of(self, docs: np.ndarray, begin: np.ndarray, size: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
        """Places in a chunk whose documents have these keys, first words and numbers of words; of those, the ones with the right hash."""
        key = docs & self.mask
        i, j = np.searchsorted(self.doc, key), np.searchsorted(self.doc, key, "right")
        n = j - i
        who = np.repeat(np.arange(len(key)), n)
        at = np.repeat(i - (np.cumsum(n) - n), n) + np.arange(len(who))
        place = self.place[at]
        fits = place < size[who] - (0 if hashes is None else WINDOW - 1)
        place, at = (begin[who] + place)[fits], at[fits]
        return place if hashes is None else place[(hashes[place] & np.uint64(0xFFFFFFFF)) == self.check[at]]


def _marked(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges [first, last)."""
    edge = np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _finished(doc_ids: pa.Array, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray, drop: np.ndarray) -> dict:
    """doc_id, numbers of words and removed words, and the hash of the kept ones."""
    kept = ~drop
    text, at = joined_words(raw, starts[kept], ends[kept])
    cut = at[np.append(0, np.cumsum(kept))[of]]
    data = memoryview(text)
    removed = np.append(0, np.cumsum(drop))[of]
    return {"doc_id": doc_ids, "n_words": np.diff(of), "n_removed": np.diff(removed), "kept_sha256": [hashlib.sha256(data[i : max(i, j - 1)]).hexdigest() for i, j in zip(cut, cut[1:], strict=False)]}


def _extend(buckets: int):
    """Hashes the windows that contain a flagged anchor; documents without one are finished here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, payloads, flags, seen = None, [], None, _Seen()
        for bucket, kind, part in runs(batches):
            if bucket != now:
                now, payloads, flags = bucket, [], None
            if kind == ARRAYS:
                payloads += part.column("payload").to_pylist()
                continue
            if kind == DONE:
                yield part
                continue
            if flags is None:
                flags, payloads = _Flags(payloads, False), []
            for b in chunks([unpack_texts(part)]):
                raw, at = utf8(b.column("text"))
                starts, ends, of = words(raw, at)
                size = np.diff(of)
                key_of = _documents(b)
                place = flags.of(key_of, of[:-1], size)
                doc = np.searchsorted(of, place, "right") - 1
                has = np.bincount(doc, minlength=len(size)) > 0
                clean = np.flatnonzero(~has)
                home = _home(key_of, buckets)
                done = _finished(b.column("doc_id"), raw, starts, ends, of, np.zeros(len(starts), bool))
                take = lambda x, i: x.take(pa.array(i)) if isinstance(x, pa.Array) else np.asarray(x)[i]
                yield rows(bucket=home[clean], kind=np.full(len(clean), DONE, np.int32), doc_id=take(done["doc_id"], clean), n=done["n_words"][clean], sha=[done["kept_sha256"][i] for i in clean])
                if not len(place):
                    continue
                dirty = np.flatnonzero(has)
                yield pack_texts(home[dirty], take(b.column("doc_id"), dirty), take(b.column("text"), dirty))
                last = of[1:][doc] - WINDOW
                first = np.maximum(of[:-1][doc], place + ANCHOR - WINDOW)
                last = np.minimum(place, last)
                at = np.flatnonzero(_marked(len(starts), first, np.maximum(first, last + 1)))
                code, distinct = encode_words(raw, starts, ends)
                h = hash_words(distinct)[code]
                key, other = window_hashes(h, WINDOW)[at], window_hashes(mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), WINDOW, 0xC2B2AE3D27D4EB4F)[at]
                owner = np.searchsorted(of, at, "right") - 1
                where = (at - of[owner]).astype(np.uint32)
                key, other, where = seen.spread(key, other, where)
                who = key_of[owner]
                bucket_of, payload = pack((other % np.uint64(buckets)).astype(np.int32), key, who.astype(np.uint32), (who >> np.uint64(32)).astype(np.uint16), where)
                for i in range(0, len(bucket_of), 256):
                    ids = bucket_of[i : i + 256]
                    yield rows(bucket=ids, kind=np.full(len(ids), ARRAYS, np.int32), payload=payload[i : i + 256])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    now, payloads, flags = None, [], None
    for bucket, kind, part in runs(batches):
        if bucket != now:
            now, payloads, flags = bucket, [], None
        if kind == ARRAYS:
            payloads += part.column("payload").to_pylist()
        elif kind == DONE:
            whole = pc.if_else(pc.is_valid(part.column("payload")), part.column("n"), pa.scalar(0, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n"), whole, part.column("sha")], names)
        else:
            if flags is None:
                flags, payloads = _Flags(payloads, True), []
            for b in chunks([unpack_texts(part)]):
                raw, at = utf8(b.column("text"))
                starts, ends, of = words(raw, at)
                code, distinct = encode_words(raw, starts, ends)
                place = flags.of(_documents(b), of[:-1], np.diff(of), window_hashes(hash_words(distinct)[code], WINDOW))
                drop = _marked(len(starts), place, place + WINDOW) if len(place) else np.zeros(len(starts), bool)
                done = _finished(b.column("doc_id"), raw, starts, ends, of, drop)
                yield pa.RecordBatch.from_arrays([done["doc_id"], *(pa.array(done[c]) for c in names[1:3]), pa.array(done["kept_sha256"], pa.string())], names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the hash of the words that are kept."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = bucket_count(docs)
    flagged = dealt(docs.mapInArrow(_anchors(n), SCHEMA)).mapInArrow(_repeated(n, False), SCHEMA)
    texts = docs.mapInArrow(_homes(n), SCHEMA)
    windows = dealt(flagged.unionByName(texts)).mapInArrow(_extend(n), SCHEMA)
    repeated = dealt(windows).mapInArrow(_repeated(n, True), SCHEMA)
    return dealt(repeated).mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _homes(buckets: int):
    """Each text to the bucket of its document; what a task has met twice already is finished here, and goes anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, empty = _Copies(), hashlib.sha256(b"").hexdigest()
        for b in chunks(batches):
            key = _documents(b)
            more = copies.more(key)
            if more.any():
                part = b.filter(pa.array(more))
                raw, at = utf8(part.column("text"))
                starts, ends, of = words(raw, at)
                size = np.diff(of)
                gone = size >= WINDOW  # every word is in a window, and every window starts elsewhere too
                kept = _finished(part.column("doc_id"), raw, starts, ends, of, np.zeros(len(starts), bool))["kept_sha256"]
                home = (mix(key[more] + np.arange(more.sum(), dtype=np.uint64)) % np.uint64(buckets)).astype(np.int32)
                yield rows(bucket=home, kind=np.full(len(home), DONE, np.int32), doc_id=part.column("doc_id"), n=size, sha=[empty if g else k for g, k in zip(gone, kept, strict=True)], payload=[b"" if g else None for g in gone])
                b, key = b.filter(pa.array(~more)), key[~more]
            yield pack_texts(_home(key, buckets), b.column("doc_id"), b.column("text"))

    return run
