"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Statistics of all texts of a batch are counted side by side. Trees grow level by level on histograms of
binned statistics, with the logistic loss, and are flattened into arrays: scoring walks all trees of all
documents at once, one level a step. Labels, language, source and id are never inputs.

Training sees at most TRAIN_ROWS labelled documents (of those that may be learned from, the ones with the
lowest hash of doc_id); everything else covers all rows. Defined results: null and empty texts have
statistics zero and get a score like any other; contradictory labels of one doc_id count by majority, ties
as 1; without labels, or with one class only, every score is that class's smoothed share; a null doc_id is
not held out; repeated rows are scored alike; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textscan import binary_array, bounded_batches, chunks, encode_words, utf8, words

#: Most labelled documents that training sees.
TRAIN_ROWS = 12_000
#: Trees, their depth, the learning rate, bins of a statistic, least weight of a leaf, and its penalty.
TREES, DEPTH, RATE, BINS, LEAF_WEIGHT, PENALTY = 80, 4, 0.15, 64, 2.0, 1.0

STATISTICS = (
    "bytes words lines characters_a_word words_a_line digit upper high space symbol comma stop bar exclaim quote "
    "upper_words capital_words digit_words symbol_words short_words long_words symbol_ends distinct_words top_word "
    "distinct_lines longest_line ended_lines empty_lines repeated_pairs distinct_pairs"
).split()


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_DIGIT, _UPPER, _LOWER = _table("0123456789"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")
_HIGH, _SPACE = np.arange(256) >= 128, _table(" \t\n\r\x0b\x0c")
_COMMA, _STOP, _BAR, _EXCLAIM, _QUOTE = _table(","), _table("."), _table("|"), _table("!"), _table("\"'")
_SYMBOL = ~(_DIGIT | _UPPER | _LOWER | _HIGH | _SPACE | _COMMA | _STOP | _QUOTE)
_END = _table(".!?")


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    at = {name: k for k, name in enumerate(STATISTICS)}
    size = np.diff(offsets)
    out[:, at["bytes"]] = np.log1p(size)
    if not len(raw):
        return out

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask, dtype=np.int64))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    share = np.maximum(size, 1)
    for name, table in zip("digit upper high space symbol comma stop bar exclaim quote".split(), (_DIGIT, _UPPER, _HIGH, _SPACE, _SYMBOL, _COMMA, _STOP, _BAR, _EXCLAIM, _QUOTE), strict=True):
        out[:, at[name]] = per_doc(table[raw]) / share
    starts, ends, of = words(raw, offsets)
    count = np.diff(of)
    doc = np.repeat(np.arange(n), count)
    each = np.maximum(count, 1)
    out[:, at["words"]] = np.log1p(count)
    if len(starts):
        length = ends - starts
        edge = np.empty(2 * len(starts), np.int64)
        edge[::2], edge[1::2] = starts, ends
        padded = np.append(raw, np.uint8(0))
        inside = lambda table: np.add.reduceat(table[padded], edge, dtype=np.int32)[::2]
        upper, digit, symbol, low = inside(_UPPER), inside(_DIGIT), inside(_SYMBOL), inside(_LOWER)
        mean = lambda x: np.bincount(doc, x, n) / each
        out[:, at["characters_a_word"]] = mean(length)
        out[:, at["upper_words"]] = mean((upper >= 2) & (low == 0))
        out[:, at["capital_words"]] = mean(_UPPER[raw[starts]])
        out[:, at["digit_words"]] = mean(digit > 0)
        out[:, at["symbol_words"]] = mean(symbol > 0)
        out[:, at["short_words"]] = mean(length <= 3)
        out[:, at["long_words"]] = mean(length >= 14)
        out[:, at["symbol_ends"]] = mean(_SYMBOL[raw[ends - 1]])
        code, distinct = encode_words(raw, starts, ends)
        pair = np.sort(doc * (len(distinct) + 1) + code)
        cut = np.flatnonzero(np.append(True, np.diff(pair) != 0))
        owner = pair[cut] // (len(distinct) + 1)
        times = np.diff(np.append(cut, len(pair)))
        top = np.zeros(n)
        np.maximum.at(top, owner, times)
        out[:, at["distinct_words"]] = np.bincount(owner, minlength=n) / each
        out[:, at["top_word"]] = top / each
        same = np.append(False, (code[1:] == code[:-1]) & (doc[1:] == doc[:-1]))
        out[:, at["repeated_pairs"]] = mean(same)
        two = (code[:-1] * np.int64(0x9E3779B1) + code[1:])[doc[1:] == doc[:-1]]
        pair_doc = doc[1:][doc[1:] == doc[:-1]]
        order = np.lexsort((two, pair_doc))
        fresh = np.append(True, (np.diff(two[order]) != 0) | (np.diff(pair_doc[order]) != 0))[: len(order)]
        out[:, at["distinct_pairs"]] = np.bincount(pair_doc[order][fresh], minlength=n) / np.maximum(count - 1, 1)
    # lines end at a line feed or with their text
    stops = np.unique(np.append(np.flatnonzero(raw == 10) + 1, offsets[1:]))
    stops = stops[stops > 0]
    begin = np.append(0, stops[:-1])
    line_doc = np.searchsorted(offsets, begin, "right") - 1
    lines = np.bincount(line_doc, minlength=n).astype(float)
    some = np.maximum(lines, 1)
    wide = stops - begin
    out[:, at["lines"]] = np.log1p(lines)
    out[:, at["words_a_line"]] = count / some
    longest = np.zeros(n)
    np.maximum.at(longest, line_doc, wide)
    out[:, at["longest_line"]] = longest / share
    last = np.maximum(stops - 1 - (raw[stops - 1] == 10), begin)
    out[:, at["ended_lines"]] = np.bincount(line_doc, _END[raw[last]], n) / some
    out[:, at["empty_lines"]] = np.bincount(line_doc, wide <= 1, n) / some
    key = binary_array(raw, np.append(begin, stops[-1:])).dictionary_encode().indices.to_numpy()
    order = np.lexsort((key, line_doc))
    fresh = np.append(True, (np.diff(key[order]) != 0) | (np.diff(line_doc[order]) != 0))[: len(order)]
    out[:, at["distinct_lines"]] = np.bincount(line_doc[order][fresh], minlength=n) / some
    return out


@dataclass
class Trees:
    """Complete binary trees in arrays: statistic and threshold of each inner node, value of each leaf."""

    base: float
    statistic: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        count, inner = self.statistic.shape
        total = np.full(len(x), self.base)
        if count and len(x):
            node = np.zeros((len(x), count), np.int64)
            tree, row = np.arange(count), np.arange(len(x))[:, None]
            for _ in range(int(np.log2(inner + 1))):
                right = x[row, self.statistic[tree, node]] > self.threshold[tree, node]
                node = 2 * node + 1 + right
            total += self.value[tree, node - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosts trees on the logistic loss."""
    n, width = x.shape
    rate = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate / (1 - rate)))
    inner = (1 << depth) - 1
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if n < 20 or y.min(initial=1) == y.max(initial=0):
        return none
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    cell = binned + np.arange(width) * BINS
    score = np.full(n, base)
    statistic, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            at = (((node - first) * width * BINS)[:, None] + cell).ravel()
            hist = [np.bincount(at, np.repeat(v, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(2) for v in (g, h)]
            left_g, left_h = hist
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + PENALTY) + (all_g - left_g) ** 2 / (all_h - left_h + PENALTY) - all_g**2 / (all_h + PENALTY)
            gain[(left_h < LEAF_WEIGHT) | (all_h - left_h < LEAF_WEIGHT)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for i in range(nodes):
                k, b = divmod(int(best[i]), BINS)
                if gain[i, k, b] > 1e-9 and b < len(edges[k]):
                    statistic[t, first + i], threshold[t, first + i] = k, edges[k][b]
            node = 2 * node + 1 + (x[np.arange(n), statistic[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + PENALTY)
        score += value[t, leaf]
    return Trees(base, statistic, threshold, value)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees trained on labelled documents that aren't held out."""
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(rows)
    chosen = F.broadcast(docs.sparkSession.createDataFrame(chosen.collect() or [], "doc_id long, y double"))  # at most ``rows`` pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            x = statistics(*utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = docs.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(run, "doc_id long, y double, x array<double>").collect()
    got.sort(key=lambda r: (r[0], r[2]))
    return train(np.array([r[2] for r in got]).reshape(len(got), len(STATISTICS)), np.array([r[1] for r in got]))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(statistics(*utf8(b.column("text")))))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Trees) -> DataFrame:
    """The documents that the classifier doesn't reject, columns as they were."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield b.filter(pa.array(model.scores(statistics(*utf8(b.column("text")))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
