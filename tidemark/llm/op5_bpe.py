"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Text is cut into pieces without a regular expression. Each code point gets a class (letter, number,
other, white space) and, from its neighbours, a symbol. A small automaton over these symbols knows
whether a piece starts at a code point. Its transition functions form a finite monoid, so runs of
symbols are composed by a blocked scan over whole batches: the functions are small integers, and
composing them is one table lookup. The resulting slices feed a cache of merged pieces, bounded in bytes.
Long texts are encoded in slices cut where no piece can span the cut, so memory grows with a text's ids only.

Defined results: a null text is an empty one; an empty text has no tokens; empty tables give empty
results; other columns are left alone; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .textscan import binary_array, bounded_batches, chunks, utf8

#: Bytes of pieces and ids that a worker remembers before it starts anew, and of the longest piece remembered.
CACHE_BYTES, CACHE_PIECE = 2 << 20, 64
#: Bytes of the longest piece that is merged side by side with others, and pieces merged at once.
SIDE_BY_SIDE, SIDE_ROWS = 40, 8192
#: Text bytes encoded at once; a longer text is cut where no piece can span the cut.
SLICE_BYTES = 1 << 20
NO_RANK = 1 << 60
SLOT_BITS, EMPTY = 20, np.uint64((1 << 64) - 1)

L, N, O, WS = range(4)
# symbols: letter, number, other, white space inside a run, a run's last space, a run's last other white space,
# an apostrophe before one letter of a contraction, or before two
SYM_L, SYM_N, SYM_O, SYM_IN, SYM_SPACE, SYM_LAST, SYM_C1, SYM_C2 = range(8)
# generators of the monoid: the eight symbols, the identity, the eight symbols at a document's start
IDENTITY, FRESH = 8, 9
# states: nothing open, in letters, in numbers, in others, in white space, after a joining space, contraction letters left
ST_NONE, ST_L, ST_N, ST_O, ST_W, ST_J, ST_1, ST_2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at this code point."""
    if symbol == SYM_L:
        if state == ST_2:
            return ST_1, False
        if state == ST_1:
            return ST_NONE, False
        return ST_L, state not in (ST_L, ST_J)
    if symbol == SYM_N:
        return ST_N, state not in (ST_N, ST_J)
    if symbol in (SYM_C1, SYM_C2) and state not in (ST_O, ST_J):
        return (ST_1 if symbol == SYM_C1 else ST_2), True
    if symbol in (SYM_O, SYM_C1, SYM_C2):
        return ST_O, state not in (ST_O, ST_J)
    if symbol == SYM_IN:
        return ST_W, state != ST_W
    return (ST_J if symbol == SYM_SPACE else ST_NONE), True


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(sys.maxunicode + 1, O, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = L
        elif kind == "N":
            table[c] = N
    # fixed values: the code points with the property White_Space
    table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WS
    return table


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transition function of each symbol, the table that composes functions, and each function's state from the start.

    A symbol plus FRESH is the same symbol at a document's first code point: it forgets the state before.
    """
    generators = [tuple(_step(state, symbol)[0] for state in range(8)) for symbol in range(8)]
    generators += [tuple(range(8))] + [tuple([_step(ST_NONE, symbol)[0]] * 8) for symbol in range(8)]
    known = {f: i for i, f in enumerate(dict.fromkeys(generators))}
    queue = list(known)
    while queue:
        f = queue.pop()
        for g in dict.fromkeys(generators):
            h = tuple(g[f[s]] for s in range(8))
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    fs = list(known)
    compose = np.array([[known[tuple(g[f[s]] for s in range(8))] for g in fs] for f in fs], np.uint8 if len(fs) < 256 else np.uint16)
    return np.array([known[g] for g in generators], compose.dtype), compose, np.array([f[ST_NONE] for f in fs], np.uint8)


def _scan(functions: np.ndarray, compose: np.ndarray, identity: int, width: int = 128) -> np.ndarray:
    """All prefix compositions: within blocks side by side, then over the blocks, then both together."""
    n = len(functions)
    if n <= width:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], functions[i]]
        return out
    rows = -(-n // width)
    block = np.full(rows * width, identity, functions.dtype)
    block[:n] = functions
    block = np.ascontiguousarray(block.reshape(rows, width).T)
    flat, m = compose.ravel(), compose.shape[1]
    for k in range(1, width):
        block[k] = flat.take(block[k - 1].astype(np.intp) * m + block[k])
    before = np.empty(rows, functions.dtype)
    before[0] = identity
    before[1:] = _scan(block[-1], compose, identity, width)[:-1]
    return np.ascontiguousarray(flat.take(before.astype(np.intp)[None, :] * m + block).T).reshape(-1)[:n]


_STARTS = np.array([[_step(st, s)[1] for s in range(8)] for st in range(8)])


def piece_offsets(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets of the pieces of all documents, the end included."""
    if not len(raw):
        return np.zeros(1, np.int64)
    code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    n = len(code)
    doc = np.zeros(n + 1, bool)
    doc[np.searchsorted(at, offsets)] = True
    doc[n] = True
    kind = _classes()[code]
    symbol = kind.copy()
    white = kind == WS
    if white.any():
        w = np.flatnonzero(white)
        following = np.append(white, False)[w + 1] & ~doc[w + 1]
        last = ~following & ~doc[w + 1]  # white space at a document's end is not cut off its run
        symbol[w] = np.where(last, np.where(code[w] == 32, SYM_SPACE, SYM_LAST), SYM_IN)
    q = np.flatnonzero(code == 39)
    if len(q):
        near = np.append(code, np.zeros(2, np.uint32))
        one, two = near[q + 1], near[q + 2]
        short = ~doc[q + 1] & np.isin(one, [ord(x) for x in "stmd"])
        pair = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        long = pair & ~doc[q + 1] & ~doc[np.minimum(q + 2, n)]
        symbol[q] = np.where(short, SYM_C1, np.where(long, SYM_C2, SYM_O))
    functions, compose, state = _monoid()
    fresh = doc[:n]
    after = state[_scan(functions[symbol + FRESH * fresh], compose, int(functions[IDENTITY]))]
    before = np.empty(n, np.uint8)
    before[0] = ST_NONE
    before[1:] = after[:-1]
    before[fresh] = ST_NONE
    return np.append(at[_STARTS[before, symbol]], len(raw))


def slices(raw: np.ndarray, offsets: np.ndarray, limit: int) -> np.ndarray:
    """The documents' offsets, and in documents longer than ``limit`` more, so that slices are no longer where that can be.

    A text may be cut before a single space between two visible ASCII characters: the space begins a piece there,
    and no piece looks beyond it.
    """
    cuts = [offsets]
    for d in np.flatnonzero(np.diff(offsets) > limit).tolist():
        own = raw[offsets[d] : offsets[d + 1]]
        seen = (own > 32) & (own < 127)
        free = np.flatnonzero((own[1:-1] == 32) & seen[:-2] & seen[2:]) + 1
        at = 0
        while len(own) - at > limit:
            k = int(np.searchsorted(free, at + limit, "right")) - 1
            if k < 0 or free[k] <= at:  # none near enough: the next one
                k = int(np.searchsorted(free, at, "right"))
            if k == len(free):
                break
            at = int(free[k])
            cuts.append(np.array([offsets[d] + at]))
    return np.unique(np.concatenate(cuts))


def _slot(key: np.ndarray) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Bpe:
    """Ranks of a vocabulary with a cache of encoded pieces.

    The cache is one array of pieces and one of ids, so it takes little more than their bytes.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            bytes_of[i] = token
        self.tokens = pa.array(bytes_of, pa.large_binary())
        self.sizes = np.fromiter(map(len, bytes_of), np.int32, len(bytes_of))
        self.forget()
        keys, joined = array("Q"), array("i")
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    keys.append(a << 20 | b)
                    joined.append(i)
        key, rank = np.array(keys, np.uint64), np.array(joined, np.int32)
        self.slots = np.full((1 << SLOT_BITS) + 64, EMPTY, np.uint64)
        self.slot_rank = np.zeros(len(self.slots), np.int32)
        at = _slot(key)
        while len(key):  # open addressing: who finds its slot taken goes on to the next
            free = self.slots[at] == EMPTY
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.slots[at[first]], self.slot_rank[at[first]] = key[first], rank[first]
            left = np.ones(len(key), bool)
            left[first] = False
            key, rank, at = key[left], rank[left], at[left] + 1
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.byte_pair = self.rank_of(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256))

    def forget(self) -> None:
        """Empties the cache: pieces, where each one's ids begin and the last one's end, ids."""
        self.known, self.known_at, self.known_ids = pa.array([], pa.large_binary()), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of joined tokens, NO_RANK where the vocabulary lacks them."""
        key = (a << 20 | b).view(np.uint64)
        at = _slot(key)
        out = np.full(len(key), NO_RANK, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            got = self.slots[at]
            hit = got == key
            out[todo[hit]] = self.slot_rank[at[hit]]
            more = ~hit & (got != EMPTY)
            todo, key, at = todo[more], key[more], at[more] + 1
        return out

    def merge_many(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and how many each has; pieces of one length are merged side by side."""
        raw, at = _buffers(pieces)
        length = np.diff(at)
        whole = pc.fill_null(pc.index_in(pieces, self.tokens), -1).to_numpy()
        done = whole >= 0
        parts = [(np.flatnonzero(done), whole[done][:, None])]
        for i in np.flatnonzero(~done & (length > SIDE_BY_SIDE)).tolist():
            parts.append((np.array([i]), np.array([self.merge(raw[at[i] : at[i + 1]].tobytes())], np.int32)))
        for n in range(1, SIDE_BY_SIDE + 1):
            group = np.flatnonzero(~done & (length == n))
            for lo in range(0, len(group), SIDE_ROWS):
                who = group[lo : lo + SIDE_ROWS]
                parts += self._merge_rows(who, raw[at[who][:, None] + np.arange(n)])
        size = np.zeros(len(pieces), np.int64)
        for who, ids in parts:
            size[who] = ids.shape[1]
        begin = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.int32)
        for who, ids in parts:
            flat[begin[who][:, None] + np.arange(ids.shape[1])] = ids
        return flat, size

    def _merge_rows(self, who: np.ndarray, byte: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each row's ids, the rows that end up with as many together; one round joins one pair in each row."""
        out = []
        tok = self.byte_id[byte]
        rank = self.byte_pair[byte[:, :-1].astype(np.int64) << 8 | byte[:, 1:]]
        while True:
            m = tok.shape[1]
            row = np.arange(len(who))
            j = rank.argmin(1) if m > 1 else np.zeros(len(who), np.int64)
            low = rank[row, j] if m > 1 else np.full(len(who), NO_RANK)
            go = low != NO_RANK
            out.append((who[~go], tok[~go].astype(np.int32)))
            if not go.any():
                return out
            who, tok, rank, j, low = who[go], tok[go], rank[go], j[go], low[go]
            row, col = np.arange(len(who)), np.arange(m - 1)
            tok[row, j] = low
            tok = np.take_along_axis(tok, col + (col > j[:, None]), 1)
            rank = np.take_along_axis(rank, col[:-1] + (col[:-1] >= j[:, None]), 1)
            for side in (j - 1, j):
                r = row[(side >= 0) & (side < m - 2)]
                c = side[r]
                rank[r, c] = self.rank_of(tok[r, c], tok[r, c + 1])

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Joins the adjoining pair of lowest rank, the leftmost first, until none is known."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > 200:
            return self._merge_long(piece)
        cut = list(range(len(piece) + 1))
        rank = [ranks.get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
        while rank:
            low = min(rank)
            if low == NO_RANK:
                break
            i = rank.index(low)
            del cut[i + 1], rank[i]
            if i < len(rank):
                rank[i] = ranks.get(piece[cut[i] : cut[i + 2]], NO_RANK)
            if i:
                rank[i - 1] = ranks.get(piece[cut[i - 1] : cut[i + 1]], NO_RANK)
        return tuple(ranks[piece[a:b]] for a, b in zip(cut, cut[1:], strict=False))

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap and linked positions: long pieces take n log n steps."""
        import heapq

        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            if gone[i] or after[i] != mid or mid >= n or gone[mid] or after[mid] != end:
                continue
            gone[mid], after[i] = True, end
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, end, after[end]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, i, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode_batch(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all documents, and each document's range of them; slices of SLICE_BYTES are encoded apart."""
        cuts = slices(raw, offsets, SLICE_BYTES)
        ids, to, lo = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        while lo < len(cuts) - 1:
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + SLICE_BYTES, "right")) - 1)
            own, ends = self._encode(raw[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo])
            ids.append(own)
            to.append(to[-1][-1] + ends[1:])
            lo = hi
        return np.concatenate(ids), np.concatenate(to)[np.searchsorted(cuts, offsets)]

    def _encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = piece_offsets(raw, offsets)
        code = binary_array(raw, at).dictionary_encode()
        pieces = code.dictionary
        if self.known.nbytes + self.known_ids.nbytes > CACHE_BYTES:
            self.forget()
        place = pc.fill_null(pc.index_in(pieces, self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        short = pc.binary_length(pieces).to_numpy()[new] <= CACHE_PIECE
        new = np.concatenate([new[short], new[~short]])  # long ones last: they aren't remembered
        fresh = pieces.take(pa.array(new))
        ids, size = self.merge_many(fresh)
        place[new] = len(self.known) + np.arange(len(new))
        every, begin = np.concatenate([self.known_ids, ids]), np.append(self.known_at, self.known_at[-1] + np.cumsum(size))
        if count := int(short.sum()):
            self.known = pa.concat_arrays([self.known, fresh.slice(0, count)])
            self.known_at = begin[: len(self.known) + 1].copy()
            self.known_ids = every[: self.known_at[-1]].copy()
        piece = place[code.indices.to_numpy()]
        long = begin[piece + 1] - begin[piece]
        to = np.cumsum(long)
        ids = every[np.repeat(begin[piece] - (to - long), long) + np.arange(to[-1])]
        return ids, np.append(0, to)[np.searchsorted(at[:-1], offsets)]

    def decode_batch(self, ids: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents, and each document's byte offsets."""
        taken = self.tokens.take(pa.array(ids))
        raw, at = _buffers(taken)
        return raw, at[ranges]


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


@lru_cache(4)
def load(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(1)
def _decimals(n: int) -> pa.Array:
    return pa.array([b"%d," % i for i in range(n)], pa.large_binary())


def tokenize(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """Adds ``ids`` and ``token_ends`` (each token's end in bytes of the text, for decoding spans) to the columns named.

    Columns of these two names, in any case, give way to the new ones.
    """
    bounded_batches(docs.sparkSession)
    keep = [c for c in keep if c.lower() not in ("ids", "token_ends")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in chunks(batches, limit=SLICE_BYTES):
            ids, to = bpe.encode_batch(*utf8(b.column("text")))
            ends = np.cumsum(bpe.sizes[ids], dtype=np.int64)
            ends -= np.repeat(np.append(0, ends)[to[:-1]], np.diff(to))
            lists = [pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, ends)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *lists], [*keep, "ids", "token_ends"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{fields}, ids array<int>, token_ends array<int>")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and the hashes of its ids and of the bytes that the ids decode to."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        sha = hashlib.sha256
        for b in chunks(batches, limit=SLICE_BYTES):
            ids, to = bpe.encode_batch(*utf8(b.column("text")))
            text, at = _buffers(_decimals(len(bpe.tokens)).take(pa.array(ids)))
            cut = at[to]
            back, ends = bpe.decode_batch(ids, to)
            text, back = memoryview(text), memoryview(back)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(np.diff(to)),
                    pa.array([sha(text[i : max(i, j - 1)]).hexdigest() for i, j in zip(cut, cut[1:], strict=False)], pa.string()),
                    pa.array([sha(back[i:j]).hexdigest() for i, j in zip(ends, ends[1:], strict=False)], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
