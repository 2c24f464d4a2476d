"""Language-model scoring with a gated recurrent network.

Tokens are words and one end for each document. The network reads the tokens' symbols and predicts the
next one in two steps: a class, then a member of the class. Frequent words (HEAD of them and the end) have
classes of their own, cut by frequency, with a softmax over each class's members. All other words belong to
classes by length, in which a word's share is its smoothed count in the whole training corpus, so that
every text has a probability, whatever its words. Training is truncated backpropagation through time in
numpy. Scoring lays many documents side by side and carries the state from window to window, so a document
is scored as a whole.

The network learns from every training document, whole and once: documents are dealt into SHARE parts by a hash, each of
the first ROUNDS rounds takes one part, and the last takes all others; every task trains on from
the same weights over its own documents, and the weights are averaged by their tokens, in two steps and in the order of
the tasks' numbers, so that the driver gets SLOTS sums at most. Scores depend on how the input is cut into tasks; with equal cuts they are equal. Counts cover every training document: they are added up in Spark, the HOT most frequent words
(a fixed bound) are sent to the workers, and all others are joined by a shuffle with the rarer words of
each document; texts are read once for both.

Defined results: null and empty texts are one end; without training documents all counts are zero and
the network is untrained; a null doc_id is not held out; rows with equal doc_id and text are scored
alike; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from heapq import heapify, heapreplace
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .textscan import bounded_batches, chunks, encode_words, lower, utf8, words

#: Frequent words with an output of their own; classes that they are cut into; words whose counts workers get.
HEAD, CLASSES, HOT = 2500, 48, 200_000
#: Upper byte lengths of the classes of other words; the last has none.
TAIL_LENGTHS = (4, 8, 12)
#: Hidden units, steps of a window, documents side by side.
HIDDEN, STEPS, LANES = 24, 32, 512
#: Text bytes read at once for scores; tokens from which a text waits for others as long, and tokens from which those that wait are scored.
SCORE_BYTES, LONG, WAITING = 4 << 20, 2000, 1_000_000
#: Passes over texts, lanes and steps of backpropagation.
PASSES, TRAIN_LANES, TRAIN_STEPS = 2, 32, 20
#: First rounds of learning, of how many parts of the documents they take one each, text bytes at once; sums that the driver gets.
ROUNDS, SHARE, REFINE_BYTES, SLOTS = 2, 20, 1 << 20, 4
#: Rate and lanes of each round, and of all others: few lanes make many steps of few documents, many lanes cost less.
REFINE = ((0.01, 48), (0.006, 96), (0.008, 256))
#: Weights that the optimiser moves at once.
RUN = 1 << 15
LOG10 = np.log(10.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


@dataclass
class Symbols:
    """What the network reads: 0 is the end, then the head words, then a symbol for each class of other words."""

    head: list[bytes]
    #: class of each head symbol, and each class's range of head symbols
    class_of: np.ndarray
    ranges: np.ndarray

    @property
    def count(self) -> int:
        return 1 + len(self.head) + len(TAIL_LENGTHS) + 1

    @property
    def classes(self) -> int:
        return len(self.ranges) - 1 + len(TAIL_LENGTHS) + 1


def symbols(head: list[tuple[bytes, int]], ends: int) -> Symbols:
    """Cuts the end and the head words, by falling frequency, into classes whose sizes grow evenly.

    A word of rank r has a weight of about 1/r, and a token costs as many outputs as its class has members: their mean
    is least if the class of rank r has about as many members as the square root of r says.
    """
    rank = np.arange(1 + len(head))
    class_of = (CLASSES * np.sqrt(rank / len(rank))).astype(np.int64)
    _, class_of = np.unique(class_of, return_inverse=True)
    return Symbols([w for w, _ in head], class_of, np.searchsorted(class_of, np.arange(class_of.max() + 2)))


class Moments:
    """What Adam remembers of the gradients."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.first, self.second = (np.zeros(sum(v.size for v in w.values()), np.float32) for _ in range(2))
        self.steps = 0

    def move(self, w: np.ndarray, grad: np.ndarray, rate: float) -> None:
        """One step of all weights at once, in runs that stay in the processor's cache; the gradients are used up."""
        self.steps += 1
        # both moments are kept without their factors 0.1 and 0.001, which go into the step
        second = np.sqrt(0.001 / (1 - 0.999**self.steps))
        rate = np.float32(rate * 0.1 / (1 - 0.9**self.steps) / second)
        least = np.float32(1e-8 / second)
        for lo in range(0, len(w), RUN):
            at = slice(lo, lo + RUN)
            g, m, v = grad[at], self.first[at], self.second[at]
            m *= np.float32(0.9)
            m += g
            g *= g
            v *= np.float32(0.999)
            v += g
            np.sqrt(v, out=g)
            g += least
            np.divide(m, g, out=g)
            g *= rate
            w[at] += g


def _views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The named weights as parts of one array."""
    ends = np.cumsum([v.size for v in like.values()])
    return {k: x.reshape(v.shape) for (k, v), x in zip(like.items(), np.split(flat, ends[:-1]), strict=True)}


def _ones(h: np.ndarray) -> np.ndarray:
    """States with a last column of ones, for the outputs' own weights."""
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    return out


def _add_rows(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds values to rows that may repeat: those that repeat often are summed first."""
    order = np.argsort(rows.astype(np.min_scalar_type(len(to))), kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    times = np.diff(first, append=len(rows))
    often = times > 8
    for k, n in zip(first[often].tolist(), times[often].tolist(), strict=True):
        to[rows[k]] += np.ones(n, values.dtype) @ values[order[k : k + n]]
    first, times = first[~often], times[~often]
    for k in range(int(times.max(initial=0))):  # each time adds to different rows
        at = first[times > k] + k
        to[rows[at]] += values[order[at]]


class Network:
    """A gated recurrent unit with a class-factored softmax."""

    def __init__(self, s: Symbols, seed: int = 10):
        r = np.random.default_rng(seed)
        h, f = HIDDEN, np.float32
        self.symbols = s
        # row count is the start of a text
        self.w = {
            "x": r.normal(0, 0.1, (s.count + 1, 3 * h)).astype(f), "u": (r.normal(0, 1, (h, 3 * h)) / np.sqrt(h)).astype(f), "b": np.zeros(h, f),
            "c": r.normal(0, 0.1, (h, s.classes)).astype(f), "cb": np.zeros(s.classes, f), "m": r.normal(0, 0.1, (h, 1 + len(s.head))).astype(f), "mb": np.zeros(1 + len(s.head), f),
        }

    def by_gate(self) -> tuple[np.ndarray, np.ndarray]:
        """Input and state weights of the gates (both signs turned) and the new state, one after another."""
        sign = np.array([-1, -1, 1], self.w["x"].dtype)[:, None, None]
        apart = lambda k: self.w[k].reshape(-1, 3, HIDDEN).transpose(1, 0, 2) * sign
        return apart("x"), apart("u")

    def step(self, x: list[np.ndarray], u: np.ndarray, h: np.ndarray, gate: np.ndarray, q: np.ndarray, new: np.ndarray, after: np.ndarray) -> None:
        """The states after inputs ``x`` (of both gates and the new state) with the state weights ``u``, into ``after``; what leads to them is left in the arrays before."""
        np.matmul(h, u[:2], out=gate)
        gate[0] += x[0]
        gate[1] += x[1]
        np.exp(gate, out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        np.matmul(h, u[2], out=q)
        q += self.w["b"]
        np.multiply(gate[1], q, out=new)
        new += x[2]
        np.tanh(new, out=new)
        np.subtract(h, new, out=after)
        after *= gate[0]
        after += new

    def classes_of(self, target: np.ndarray) -> np.ndarray:
        s = self.symbols
        heads = 1 + len(s.head)
        return np.where(target < heads, s.class_of[np.minimum(target, heads - 1)], len(s.ranges) - 1 + target - heads)

    def log_probability(self, h: np.ndarray, target: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each target after each state; with ``grad``, adds gradients there and returns the states'."""
        w, s, n = self.w, self.symbols, len(target)
        # states lie between -1 and 1, so weights bound the logits: mostly none is too large for exp
        safe = lambda v: float(np.abs(v).sum(0).max(initial=0)) < 60
        cls = self.classes_of(target).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        cls = cls[order].astype(np.int64)
        h, target = _ones(h[order]), target[order]
        cut = np.searchsorted(cls, np.arange(len(s.ranges))).tolist()
        weights = np.vstack([w["c"], w["cb"]])
        logit = h @ weights
        if not safe(weights):
            logit -= logit.max(1, keepdims=True)
        pick = np.arange(n) * logit.shape[1] + cls
        got = logit.ravel()[pick]
        np.exp(logit, out=logit)
        total = logit @ np.ones(logit.shape[1], logit.dtype)
        got -= np.log(total)
        back = None
        if grad is not None:
            logit *= (-1 / total)[:, None]
            logit.ravel()[pick] += 1
            g = h.T @ logit
            grad["c"] += g[:-1]
            grad["cb"] += g[-1]
            back = logit @ w["c"].T
        # the members of all classes' outputs lie in one array, a class after another
        size = np.diff(s.ranges)
        parts = [(a, b, lo, hi) for a, b, lo, hi in zip(cut, cut[1:], s.ranges.tolist(), s.ranges[1:].tolist(), strict=False) if hi - lo > 1 and b > a]
        if parts:
            weights = np.vstack([w["m"], w["mb"]])
            plain = safe(weights)
            weights = weights.T.copy()  # a class's weights adjoin
            head = np.concatenate([np.arange(a, b) for a, b, *_ in parts])
            wide = size[cls[head]]
            starts = np.cumsum(wide) - wide
            flat = np.empty(int(wide.sum()), logit.dtype)
            outs, at = [], 0
            for a, b, lo, hi in parts:
                outs.append(flat[at : (at := at + (b - a) * (hi - lo))].reshape(b - a, hi - lo))
                np.matmul(h[a:b], weights[lo:hi].T, out=outs[-1])
                if not plain:
                    outs[-1] -= outs[-1].max(1, keepdims=True)
            pick = starts + target[head] - s.ranges[cls[head]]
            own = flat[pick]
            np.exp(flat, out=flat)
            total = np.add.reduceat(flat, starts)
            got[head] += own - np.log(total)
            if grad is not None:
                flat *= np.repeat(-1 / total, wide)
                flat[pick] += 1
                g, own = np.zeros_like(weights), np.zeros_like(h)
                for o, (a, b, lo, hi) in zip(outs, parts, strict=True):
                    np.matmul(o.T, h[a:b], out=g[lo:hi])
                    np.matmul(o, weights[lo:hi], out=own[a:b])
                grad["m"] += g[:, :-1].T
                grad["mb"] += g[:, -1]
                back += own[:, :-1]
        out = np.empty_like(got)
        out[order] = got
        if back is not None:
            apart = np.empty_like(back)
            apart[order] = back
            back = apart
        return out, back

    def train(self, texts: list[np.ndarray], passes: int = PASSES, rate: float = 0.01, moments: Moments | None = None, lanes: int = TRAIN_LANES) -> None:
        """Truncated backpropagation over the symbols of texts laid end to end in lanes; Adam, which goes on from ``moments`` if given."""
        texts = [t for t in texts if len(t)]
        if not texts:
            return
        start = self.symbols.count
        flow_in = np.concatenate([np.append(start, t[:-1]) for t in texts])
        flow_out = np.concatenate(texts)
        fresh = np.concatenate([np.arange(len(t)) == 0 for t in texts])
        lanes = min(lanes, max(1, len(flow_in) // TRAIN_STEPS))
        steps = len(flow_in) // lanes
        if not steps:
            return
        moments = moments or Moments(self.w)
        flat = np.concatenate([v.ravel() for v in self.w.values()])
        self.w = _views(flat, self.w)
        ins, outs, new = (x[: steps * lanes].reshape(lanes, steps).T for x in (flow_in, flow_out, fresh))
        n, kind = HIDDEN, flat.dtype
        most = min(TRAIN_STEPS, steps)
        begins, going = new.any(1).tolist(), (~new).astype(kind)[:, :, None]
        gate, q, hat, state = (np.empty((most, *s), kind) for s in ((2, lanes, n), (lanes, n), (lanes, n), (lanes, n)))
        before, ways = np.empty((most, lanes, n), kind), np.empty((most, lanes, 4, n), kind)
        for _ in range(passes):
            h = np.zeros((lanes, n), kind)
            for lo in range(0, steps, TRAIN_STEPS):
                size = min(TRAIN_STEPS, steps - lo)
                x, u = self.by_gate()
                x = [g.take(ins[lo : lo + size], 0) for g in x]
                for k in range(size):
                    np.multiply(h, going[lo + k], out=before[k])
                    h = state[k]
                    self.step([g[k] for g in x], u, before[k], gate[k], q[k], hat[k], h)
                h = h.copy()
                slope = np.zeros_like(flat)
                grad = _views(slope, self.w)
                count = size * lanes
                _, back = self.log_probability(state[:size].reshape(count, n), outs[lo : lo + size].ravel(), grad)
                back = back.reshape(size, lanes, n)
                # what a state's slope is multiplied by on its four ways: to the old state's part of the new one, both gates, and the new one
                z, r, f = gate[:size, 0], gate[:size, 1], ways[:size]
                to_new = (1 - z) * (1 - hat[:size] * hat[:size])
                np.multiply(to_new, r, out=f[:, :, 0])
                np.multiply((before[:size] - hat[:size]) * z, 1 - z, out=f[:, :, 1])
                np.multiply(f[:, :, 0] * q[:size], 1 - r, out=f[:, :, 2])
                f[:, :, 3] = to_new
                back_u = np.concatenate([self.w["u"][:, 2 * n :], self.w["u"][:, : 2 * n]], 1).T.copy()
                carry = np.zeros((lanes, n), kind)
                for k in range(size - 1, -1, -1):
                    d = back[k]
                    d += carry
                    f[k] *= d[:, None]
                    np.matmul(f[k].reshape(lanes, 4 * n)[:, : 3 * n], back_u, out=carry)
                    d *= z[k]
                    carry += d
                    if begins[lo + k]:
                        carry *= going[lo + k]
                f = f.reshape(count, 4 * n)
                g = before[:size].reshape(count, n).T @ f[:, : 3 * n]
                grad["u"][:, : 2 * n] += g[:, n:]
                grad["u"][:, 2 * n :] += g[:, :n]
                grad["b"] += f[:, :n].sum(0)
                _add_rows(grad["x"], ins[lo : lo + size].ravel(), f[:, n:])
                norm = np.sqrt(float(slope @ slope)) / count
                slope *= np.float32(1 / count * min(1, 0.5 / max(norm, 1e-9)))
                moments.move(flat, slope, rate)

    def score(self, flow: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Log probability of the symbols of each text, all texts side by side in lanes, windows carrying the state."""
        size = np.diff(of)
        count = len(size)
        total = np.zeros(count)
        lanes = min(LANES, count)
        order = np.argsort(-size, kind="stable")
        heap = [(0, k) for k in range(lanes)]
        heapify(heap)
        lane_of, at = np.empty(count, np.int64), np.empty(count, np.int64)
        for d in order.tolist():  # the longest text left goes to the shortest lane
            filled, k = heap[0]
            lane_of[d], at[d] = k, filled
            heapreplace(heap, (filled + int(size[d]), k))
        length = np.zeros(lanes, np.int64)
        np.maximum.at(length, lane_of, at + size)
        rank = np.empty(lanes, np.int64)
        by_length = np.argsort(-length, kind="stable")
        rank[by_length] = np.arange(lanes)
        length = length[by_length]
        place = np.repeat((at - of[:-1]) * lanes + rank[lane_of], size) + np.arange(len(flow)) * lanes
        start = self.symbols.count
        previous = np.append(np.int32(start), flow[:-1].astype(np.int32))
        previous[of[:-1]] = start
        grids = np.zeros((3, int(length[0]) * lanes), np.int32)
        for grid, x in zip(grids, (previous, flow, np.repeat(np.arange(count, dtype=np.int32), size)), strict=True):
            grid[place] = x
        grid_in, grid_out, grid_doc = grids.reshape(3, -1, lanes)
        del place, previous
        inputs, u = self.by_gate()
        h = np.zeros((lanes, HIDDEN), np.float32)
        for lo in range(0, len(grid_in), STEPS):
            live = int(np.searchsorted(-length, -lo, "left"))
            hi = min(lo + STEPS, len(grid_in))
            h = h[:live]
            ins = grid_in[lo:hi, :live]
            gate, q, new = (np.empty(s, np.float32) for s in ((2, live, HIDDEN), (live, HIDDEN), (live, HIDDEN)))
            states = np.empty((hi - lo, live, HIDDEN), np.float32)
            begin = ins == start
            begins = begin.any(1).tolist()
            x = [g.take(ins, 0) for g in inputs]
            for k in range(hi - lo):
                if begins[k]:
                    h = np.where(begin[k][:, None], np.float32(0), h)
                self.step([g[k] for g in x], u, h, gate, q, new, states[k])
                h = states[k]
            real = (np.arange(lo, hi)[:, None] < length[None, :live]).ravel()
            got, _ = self.log_probability(states.reshape(-1, HIDDEN)[real], grid_out[lo:hi, :live].ravel()[real])
            total += np.bincount(grid_doc[lo:hi, :live].ravel()[real], got, count)
        return total


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, count) over whole texts; each partition adds up before the shuffle."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held).group_by("word").aggregate([("count", "sum")])
            t = pa.table({"word": t["word"].cast(pa.binary()), "count": t["count_sum"]})
            yield from t.to_batches(max_chunksize=100_000)

        for b in chunks(batches):
            raw, offsets = utf8(b.column("text"))
            code, distinct = encode_words(lower(raw), *words(raw, offsets)[:2])
            if len(distinct):
                held.append(pa.table({"word": distinct, "count": np.bincount(code, minlength=len(distinct))}))
                rows += len(distinct)
            if rows > 1_500_000:
                yield from flush()
                held, rows = [], 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(run, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


@dataclass
class Model:
    network: Network
    #: places of the most frequent words, and their counts
    hot: dict[bytes, int]
    counts: np.ndarray
    #: all tokens and distinct tokens of the training documents, and their documents
    tokens: int
    distinct: int
    documents: int
    #: counts and distinct words of each class of words outside the head
    tail_tokens: np.ndarray
    tail_distinct: np.ndarray
    #: rounds in which the network has seen documents
    learned: int = 0

    def base(self, count):
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def tail(self, count, cls):
        return np.log10((count + 0.5) / (self.tail_tokens[cls] + 0.5 * (self.tail_distinct[cls] + 1)))


def _tail_class(length: Column) -> Column:
    out = F.lit(len(TAIL_LENGTHS))
    for k in reversed(range(len(TAIL_LENGTHS))):
        out = F.when(length <= TAIL_LENGTHS[k], k).otherwise(out)
    return out


def _most_frequent(counts: DataFrame, head: dict[bytes, int]) -> dict[bytes, int]:
    """The head words, first, and all words above the count at which there are HOT at most.

    Counts are looked at by eighths of powers of two, so what reaches the driver is bounded at any size.
    """
    step = F.floor(F.log2("count") * 8).cast("int")
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("s")).agg(F.count("*")).collect()), reverse=True)
    total, least = 0, None
    for s, n in sizes:
        if (total := total + n) > HOT:
            break
        least = s
    if least is None:
        return head
    t = counts.filter(step >= least).toArrow()
    return head | dict(zip(t["word"].to_pylist(), t["count"].to_pylist(), strict=True))


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the documents that aren't held out, and the counts of all their words."""
    spark = docs.sparkSession
    shared_folder(spark)
    known = docs.filter(~held_out(F.col("doc_id")))
    counts = word_counts(known).checkpoint()
    documents = known.count()
    head = [(bytes(r[0]), r[1]) for r in counts.orderBy(F.desc("count"), "word").limit(HEAD).collect()]
    hot = _most_frequent(counts, dict(head))
    sums = {r[0]: (r[1], r[2]) for r in counts.groupBy(_tail_class(F.octet_length("word")).alias("k")).agg(F.sum("count"), F.count("*")).collect()}
    kinds = len(TAIL_LENGTHS) + 1
    tokens, distinct = (np.array([sums.get(k, (0, 0))[i] for k in range(kinds)], float) for i in range(2))
    all_tokens, all_distinct = int(tokens.sum()) + documents, int(distinct.sum()) + (documents > 0)
    for w, c in head:
        k = int(np.searchsorted(TAIL_LENGTHS, len(w)))
        tokens[k] -= c
        distinct[k] -= 1
    network = Network(symbols(head, documents))
    model = Model(network, {w: i for i, w in enumerate(hot)}, np.fromiter(hot.values(), np.int64, len(hot)), all_tokens, all_distinct, documents, tokens, distinct)
    part = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(SHARE))
    for k in range(ROUNDS):
        refine(model, known.filter(part == k))
    if SHARE > ROUNDS:
        refine(model, known.filter(part >= ROUNDS))
    return model, counts


def refine(model: Model, docs: DataFrame) -> None:
    """Trains the model's network on whole documents where they are, and takes the mean of what the tasks made of it."""
    spark, w = docs.sparkSession, model.network.w
    names, shapes = list(w), [v.shape for v in w.values()]
    ends = np.cumsum([v.size for v in w.values()])
    rate, lanes = REFINE[min(model.learned, len(REFINE) - 1)]
    # symbols need the head words alone, which are the first at hand
    known = len(model.network.symbols.head)
    sent = spark.sparkContext.broadcast(replace(model, hot=dict(islice(model.hot.items(), known)), counts=model.counts[:known]))
    schema = "slot int, part int, tokens long, weights binary"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        network = Network(sent.value.network.symbols)
        network.w = {k: v.copy() for k, v in sent.value.network.w.items()}
        moments, tokens = Moments(network.w), 0
        for b in chunks(batches, limit=REFINE_BYTES):
            flow, of, *_ = reader.read(*utf8(b.column("text")))
            network.train([flow[i:j] for i, j in zip(of, of[1:], strict=False)], 1, rate, moments, lanes)
            tokens += len(flow)
        if moments.steps:
            flat = np.concatenate([network.w[k].ravel() for k in names])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([tokens]), pa.array([flat.tobytes()], pa.binary())], ["slot", "part", "tokens", "weights"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = None, 0
        for b in batches:
            for n, data in zip(b.column("tokens").to_pylist(), b.column("weights"), strict=True):
                own = np.frombuffer(data.as_buffer(), np.float32).astype(np.float64) * n
                total, tokens = own if total is None else total + own, tokens + n
        if total is not None:
            slot = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays([slot, slot, pa.array([tokens]), pa.array([total.tobytes()], pa.binary())], ["slot", "part", "tokens", "weights"])

    got = docs.select("text").mapInArrow(learn, schema).repartition(SLOTS, "slot").sortWithinPartitions("part").mapInArrow(add, schema).collect()
    got.sort(key=lambda r: r.slot)  # sums in the order of the tasks' numbers, so a run can be repeated
    sent.unpersist()
    if got:
        model.learned += 1
        flat = sum(np.frombuffer(r.weights, np.float64) for r in got) / sum(r.tokens for r in got)
        model.network.w = {k: x.reshape(shape).astype(np.float32) for k, shape, x in zip(names, shapes, np.split(flat, ends[:-1]), strict=True)}


class Reader:
    """Turns texts into the network's symbols and the counts that are known at hand."""

    def __init__(self, model: Model):
        self.model = model
        self.heads = 1 + len(model.network.symbols.head)
        # head words stand first among those at hand
        self.at_hand = pa.array(list(model.hot), pa.large_binary())

    def read(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Symbols with ends and each document's range of them; each document's range of words; each word's distinct word; of these the symbol, the count (-1: not at hand) and the text."""
        raw = lower(raw)
        starts, ends, of = words(raw, offsets)
        code, distinct = encode_words(raw, starts, ends)
        size = len(distinct)
        at = pc.fill_null(pc.index_in(distinct, self.at_hand), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        length = pc.binary_length(distinct).to_numpy(zero_copy_only=False) if size else np.zeros(0, np.int64)
        symbol = np.where((at >= 0) & (at < self.heads - 1), at + 1, self.heads + np.searchsorted(TAIL_LENGTHS, length))
        count = np.where(at >= 0, np.append(self.model.counts, 0)[at], -1)
        n = len(of) - 1
        flow = np.zeros(len(code) + n, np.int64)
        if size:
            flow[np.arange(len(code)) + np.repeat(np.arange(n), np.diff(of))] = symbol[code]
        return flow, of + np.arange(n + 1), of, code, symbol, count, distinct


def _key(b: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    data = memoryview(raw)
    return np.array([xxhash.xxh3_64_intdigest(data[i:j], 0 if d is None else d & 0xFFFFFFFFFFFFFFFF) for d, i, j in zip(b.column("doc_id").to_pylist(), offsets, offsets[1:], strict=False)], np.uint64).view(np.int64)


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, counts = fit(docs)
    sent = spark.sparkContext.broadcast(model)  # HOT words at most
    heads = 1 + len(model.network.symbols.head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Reader(sent.value)
        m = r.model
        names = ["word", "doc_id", "key", "times", "n_tokens", "known", "base", "lm"]
        # short and long texts wait apart
        waiting: tuple[list[tuple[pa.RecordBatch, np.ndarray]], ...] = ([], [])
        tokens = [0, 0]

        def scored(part: pa.RecordBatch, flow: np.ndarray) -> pa.RecordBatch:
            of = np.append(0, np.cumsum(part.column("n_tokens").to_numpy()))
            lm = part.column("lm").to_numpy() + m.network.score(flow, of) / LOG10
            return pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lm)], names)

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            """Texts of like length side by side: alone each would take as many steps as it has tokens."""
            if waiting[kind]:
                part = pa.Table.from_batches([b for b, _ in waiting[kind]]).combine_chunks().to_batches()[0]
                yield scored(part, np.concatenate([f for _, f in waiting[kind]]))
                waiting[kind].clear()
                tokens[kind] = 0

        for b in chunks(batches, limit=SCORE_BYTES):
            raw, offsets = utf8(b.column("text"))
            flow, flow_of, of, code, symbol, count, distinct = r.read(raw, offsets)
            n = b.num_rows
            doc = np.repeat(np.arange(n), np.diff(of))
            c, s = count[code], symbol[code]
            at_hand = c >= 0
            base = np.bincount(doc[at_hand], m.base(c[at_hand]), n) + m.base(m.documents)
            own = at_hand & (s >= heads)
            lm = np.bincount(doc[own], m.tail(c[own], s[own] - heads), n).astype(float)
            known = np.bincount(doc[c > 0], minlength=n) + (m.documents > 0)
            key, ids = _key(b, raw, offsets), b.column("doc_id")
            # a document's own row: its "word" holds a space, so it is none, and is spread like words
            own_word = pa.array([b" " + k.tobytes() for k in key], pa.binary())
            mine = pa.RecordBatch.from_arrays([own_word, ids, pa.array(key), pa.nulls(n, pa.int64()), *(pa.array(x) for x in (np.diff(flow_of), known.astype(np.int64), base, lm))], names)
            length = np.diff(flow_of)
            for kind, some in enumerate((length <= LONG, length > LONG)):
                if some.any():
                    waiting[kind].append((mine.take(pa.array(np.flatnonzero(some))), flow[np.repeat(some, length)].astype(np.int32)))
                    tokens[kind] += len(waiting[kind][-1][1])
                if tokens[kind] > WAITING:
                    yield from flush(kind)
            rare = np.flatnonzero(~at_hand)
            if not len(rare):
                continue
            pair, times = np.unique(doc[rare] * np.int64(len(distinct)) + code[rare], return_counts=True)
            for i in range(0, len(pair), 50_000):
                part, k = pair[i : i + 50_000], len(pair[i : i + 50_000])
                who = part // len(distinct)
                yield pa.RecordBatch.from_arrays([distinct.take(pa.array(part % len(distinct))).cast(pa.binary()), ids.take(pa.array(who)), pa.array(key[who]), pa.array(times[i : i + k]), *(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names)
        for kind in range(2):
            yield from flush(kind)

    rows = docs.mapInArrow(run, "word binary, doc_id long, key long, times long, n_tokens long, known long, base double, lm double")
    joined = rows.join(counts, "word", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    k = _tail_class(F.octet_length("word"))
    room = F.element_at(F.array(*(F.lit(float(t + 0.5 * (d + 1))) for t, d in zip(model.tail_tokens, model.tail_distinct, strict=True))), k + 1)
    rare = F.col("times").isNotNull()
    copies = F.count_if(~rare)  # rows with equal doc_id and text share a key
    of_rare = lambda x: F.coalesce(F.sum(F.when(rare, x)), F.lit(0.0)) / copies
    found = joined.groupBy("doc_id", "key").agg(
        copies.alias("copies"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + of_rare(F.when(F.col("count") > 0, F.col("times").cast("double"))).cast("long")).alias("n_known"),
        (F.max("base") + of_rare(F.col("times") * F.log10((F.col("count") + 0.5) / F.lit(float(model.tokens + 0.5 * (model.distinct + 1)))))).alias("base_score"),
        (F.max("lm") + of_rare(F.col("times") * F.log10((F.col("count") + 0.5) / room))).alias("score"),
    )
    each = found.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return each.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
