"""Secret scans with a linear-chain conditional random field.

Three fixed patterns give the base findings. A conditional random field over the tokens of a text
adds more: its features are a token's shape, the shapes of the tokens beside it, signatures of the
neighbouring words and figures of the whole text. It is trained by its log likelihood on a bounded
sample of documents. No rows are labelled, so the base findings are the labels, and as the field is to
find what the patterns miss, it also learns from texts without findings into which values of other alphabets
and lengths are put, in other contexts, and things that look alike and are no secrets: addresses, numbers,
versions, names of files. Which tokens are
secret is decided by Viterbi alone; nothing filters what it finds. Decoding is exact: a token whose score
for "outside" leads by more than all transitions can make up is outside in the best sequence, and
the stretches between such tokens are decoded one by one.

Spans are of whole matches, in code points, the end excluded. Spans of the field that overlap base
ones are dropped. Defined results: null and empty texts have no spans; rows with the same doc_id are
scanned each; a sample without secrets gives a field that adds nothing; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder
from .textscan import bounded_batches, chunks, utf8

#: Documents in the training sample, characters of a window of a longer one, and steps of training.
TRAIN_ROWS, TRAIN_CHARS, TRAIN_STEPS = 1000, 1_500, 80
#: Least number of texts with moved secrets that the field learns from.
MOVED = 300
#: Text bytes whose features are held at once.
SCAN_BYTES = 1 << 19
#: Signatures of words, and the neighbours that have one: places before and after a token.
SIGNATURES, NEIGHBOURS = 512, (-2, -1, 1)
# fixed values: the base patterns and the lengths that their matches need
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "field")

B, I, O = range(3)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


DIGIT, LOWER, UPPER = _table("0123456789"), _table("abcdefghijklmnopqrstuvwxyz"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX, VOWEL = _table("0123456789abcdef"), _table("aeiouAEIOU")
HIGH = np.arange(256) >= 128
TOKEN = DIGIT | LOWER | UPPER | HIGH
JOINT, ASSIGNS, QUOTE = _table("+/_.-"), _table(":="), _table("\"'")


def long_hex(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the longest runs of hex digits that reach MIN_HEX."""
    starts, ends = _runs(HEX[raw], offsets)
    long = ends - starts >= MIN_HEX
    return starts[long], ends[long]


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= cut[1:n] | ~inside[:-1]
    last[:-1] &= cut[1:n] | ~inside[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _lines_of(data: bytes, needles: tuple[bytes, ...], offsets: np.ndarray) -> np.ndarray:
    """Documents in which any of the needles occurs."""
    at = []
    for needle in needles:
        i = data.find(needle)
        while i >= 0:
            at.append(i)
            i = data.find(needle, i + 1)
    return np.unique(np.searchsorted(offsets, np.array(at, np.int64), "right") - 1)


def base_spans(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, start, kind, end) in bytes of the batch, in this order."""
    data, out = raw.tobytes(), []
    for d in _lines_of(data.lower(), KEYWORDS, offsets).tolist():
        for m in ASSIGN.finditer(data[offsets[d] : offsets[d + 1]]):
            if m.end(2) - m.start(2) >= MIN_ASSIGN:
                out.append((d, int(offsets[d]) + m.start(), 0, int(offsets[d]) + m.end()))
    for d in _lines_of(data, (b"AKIA",), offsets).tolist():
        for m in ACCESS.finditer(data[offsets[d] : offsets[d + 1]]):
            if m.end() - m.start() >= MIN_ACCESS:
                out.append((d, int(offsets[d]) + m.start(), 1, int(offsets[d]) + m.end()))
    starts, ends = long_hex(raw, offsets)
    docs = np.searchsorted(offsets, starts, "right") - 1
    out += [(d, s, 2, e) for d, s, e in zip(docs.tolist(), starts.tolist(), ends.tolist(), strict=True)]
    return sorted(out)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the tokens, and each document's range of them."""
    starts, ends = _runs(TOKEN[raw], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


SHAPES = 24
WIDTH = 3 * SHAPES + 4
_SMALL = np.arange(256, dtype=np.uint64)
_SMALL[65:91] += np.uint64(32)


def signatures(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each token those of its neighbours, by their letters in lower case; SIGNATURES where there is none."""
    out = np.full((len(starts), len(NEIGHBOURS)), SIGNATURES, np.int32)
    if not len(starts):
        return out
    h = (ends - starts).astype(np.uint64)
    for k in range(8):  # the first letters and the length tell words apart well enough
        h = h * np.uint64(0x100000001B3) + np.where(starts + k < ends, _SMALL[raw[np.minimum(starts + k, ends - 1)]], np.uint64(0))
    own = ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(55)).astype(np.int32) % SIGNATURES
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    for i, place in enumerate(NEIGHBOURS):
        a, b = (slice(-place, None), slice(None, place)) if place < 0 else (slice(None, -place), slice(place, None))
        same = doc[a] == doc[b]
        out[a, i][same] = own[b][same]
    return out


def features(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Shape of each token, of the one before, of the one after, and figures of the document; one row per token."""
    n = len(starts)
    out = np.zeros((n, WIDTH), np.float32)
    if not n:
        return out
    size = ends - starts
    edge = np.empty(2 * n, np.int64)
    edge[::2], edge[1::2] = starts, ends
    padded = np.append(raw, np.uint8(0))
    count = lambda table: np.add.reduceat(table[padded], edge, dtype=np.int32)[::2]
    kind = (DIGIT * 1 + LOWER * 2 + UPPER * 3 + HIGH * 4).astype(np.int8)[padded]
    change = np.append(kind[1:] != kind[:-1], False)
    turns = np.add.reduceat(change, edge, dtype=np.int32)[::2] - 1
    digit, low, up, high, vowel, hexa = (count(t) for t in (DIGIT, LOWER, UPPER, HIGH, VOWEL, HEX))
    before = np.where(starts > 0, raw[starts - 1], 32)
    after = padded[ends]
    s = out[:, :SHAPES]
    s[:, 0] = 1
    for k, (lo, hi) in enumerate(((1, 4), (5, 8), (9, 15), (16, 19), (20, 31), (32, 63), (64, 1 << 40))):
        s[:, 1 + k] = (size >= lo) & (size <= hi)
    mixed = (digit > 0) & (low + up > 0)
    s[:, 8] = mixed
    s[:, 9] = mixed & (size >= 16)
    s[:, 10] = digit == size
    s[:, 11] = (up == size) & (size > 1)
    s[:, 12] = high > 0
    s[:, 13] = (turns >= 4) & (size >= 12)
    s[:, 14] = (hexa == size) & (size >= 16)
    s[:, 15] = (vowel * 6 < size) & (size >= 12)
    s[:, 16] = (up > 1) & (low > 0) & (digit > 0)
    s[:, 17] = ASSIGNS[after]
    s[:, 18] = QUOTE[before]
    s[:, 19] = JOINT[before] & (np.append(-1, ends[:-1]) == starts - 1)
    s[:, 20] = digit > 0
    s[:, 21] = size >= 16
    s[:, 22] = JOINT[after]
    s[:, 23] = (digit * 4 > size) & (low + up > 0) & (turns >= 3)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    filled = of[:-1] < of[1:]
    first[of[:-1][filled]] = last[of[1:][filled] - 1] = True
    out[1:, SHAPES : 2 * SHAPES] = s[:-1]
    out[first, SHAPES : 2 * SHAPES] = 0
    out[:-1, 2 * SHAPES : 3 * SHAPES] = s[1:]
    out[last, 2 * SHAPES : 3 * SHAPES] = 0
    per = np.diff(of)
    doc = np.repeat(np.arange(len(per)), per)
    whole = lambda x: (np.bincount(doc, x, len(per)) / np.maximum(np.bincount(doc, size, len(per)), 1))[doc]
    out[:, -4] = whole(digit)
    out[:, -3] = whole(up)
    out[:, -2] = whole(s[:, 17] * 10)
    out[:, -1] = (per < 50)[doc]
    return out


@dataclass
class Field:
    """Weights of the features and of neighbours' signatures for each state, and scores of transitions; inside never follows outside."""

    weights: np.ndarray
    words: np.ndarray
    transitions: np.ndarray

    def scores(self, raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> np.ndarray:
        """What each state of each token scores by itself."""
        out = features(raw, offsets, starts, ends, of) @ self.weights
        beside = signatures(raw, starts, ends, of)
        for i in range(len(NEIGHBOURS)):
            out += self.words[i][beside[:, i]]
        return out

    def margin(self) -> float:
        """What transitions can make up at most for one token."""
        t = self.transitions[np.isfinite(self.transitions)]
        return float(2 * (t.max() - t.min()) + 1e-3)

    def decode(self, score: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The best sequence of states of all documents."""
        n = len(score)
        state = np.full(n, O, np.int8)
        open_ = score[:, O] - score[:, :O].max(1, initial=-np.inf) <= self.margin()
        at = np.flatnonzero(open_)
        if not len(at):
            return state
        begins = np.zeros(n + 1, bool)
        begins[of] = True
        cut = np.flatnonzero((np.diff(at) > 1) | begins[at[1:]]) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
            lo, hi = int(at[i]), int(at[j - 1]) + 1
            left, right = not begins[lo], not begins[hi]
            state[lo:hi] = self._viterbi(score[lo:hi], left, right)
        return state

    def _viterbi(self, score: np.ndarray, left: bool, right: bool) -> np.ndarray:
        """The best states of a stretch; left and right: whether an outside token stands there."""
        t = self.transitions
        best = score[0] + (t[O] if left else np.array([0, -np.inf, 0]))
        back = np.zeros((len(score), 3), np.int8)
        for k in range(1, len(score)):
            every = best[:, None] + t
            back[k] = every.argmax(0)
            best = every.max(0) + score[k]
        s = int((best + (t[:, O] if right else 0)).argmax())
        out = np.empty(len(score), np.int8)
        for k in range(len(score) - 1, -1, -1):
            out[k] = s
            s = back[k, s]
        return out


def _labels(starts: np.ndarray, ends: np.ndarray, of: np.ndarray, secrets: list[tuple[int, int, int]]) -> np.ndarray:
    """States of the tokens, from the byte ranges (document, start, end) of secrets."""
    y = np.full(len(starts), O)
    for d, s, e in secrets:
        i, j = np.searchsorted(starts, s), np.searchsorted(ends, e, "right")
        i, j = max(i, of[d]), min(j, of[d + 1])
        if i < j:
            y[i:j] = I
            y[i] = B
    return y


# alphabets of secrets, contexts that they are moved to, and what looks alike and is none
_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789")
_CONTEXTS = ("{}", "{}", "bearer {}", "Authorization: Basic {}", "key {}", "({})", '"{}"', "use {} to sign in", "credentials {},", "--auth {}", "pwd {}", "x-auth: {}", "sk_live_{}", "signed with {}.", "{}\n")


def _alike(r: random.Random) -> str:
    """Something that is no secret."""
    n = lambda k: "".join(r.choices("0123456789", k=k))
    w = lambda k: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    kinds = (
        lambda: f"{w(5)}.{n(2)}@{w(6)}.example.com", lambda: f"{n(3)}.{n(3)}.{n(2)}.{n(3)}", lambda: n(r.randint(6, 20)), lambda: n(16), lambda: f"https://www.{w(9)}.org/{w(7)}/{n(6)}/{w(12)}-{w(8)}.html", lambda: f"{n(4)}-{n(2)}-{n(2)}T{n(2)}:{n(2)}:{n(2)}Z",
        lambda: f"v{n(1)}.{n(2)}.{n(1)}-rc{n(1)}", lambda: f"+{n(2)} {n(3)} {n(7)}", lambda: f"{w(8)}_{w(6)}_{n(2)}.tar.gz", lambda: w(r.randint(16, 30)), lambda: w(r.randint(16, 24)).capitalize(), lambda: w(20).upper(), lambda: f"{n(8)}-{n(4)}-{n(4)}-{n(4)}-{n(12)}", lambda: f"{w(3).upper()}-{n(5)}", lambda: f"${n(3)},{n(3)}.{n(2)}", lambda: f"{w(10)}{n(4)}", lambda: "=" * r.randint(5, 40), lambda: f"{w(4)}{w(5).capitalize()}{w(6).capitalize()}", lambda: f"ISBN 978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", lambda: f"{n(2)}{w(2)} {n(3)}{w(2)}",
    )
    return r.choice(kinds)()


_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
_TURN = re.compile(rb"(?<=[0-9])[A-Za-z]|(?<=[a-z])[0-9A-Z]|(?<=[A-Z])[0-9a-z]")


def _unknown(data: bytes) -> bool:
    """Whether a text without findings holds a run that looks random: it may be a secret, and no label says it is none."""
    return any(len(_TURN.findall(m[0])) >= 6 and any(48 <= c < 58 for c in m[0]) for m in _RUN.finditer(data))


def examples(texts: list[str], seed: int = 8) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Texts with the byte ranges of their secrets: those with findings, others with lookalikes, and others that get secrets.

    As many others get secrets as have findings, MOVED at least, so that few findings in few places don't tie the
    field to the words that happen to stand there. Texts without findings of which it is unknown whether they hold
    secrets are left out.
    """
    r = random.Random(seed)
    out, rest = [], []
    for data in (t.encode() for t in texts):
        found = base_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        if found:
            out.append((data, [(s + (ASSIGN.match(data[s:e]).start(2) if kind == 0 else 0), e) for _, s, kind, e in found]))
        elif not _unknown(data):
            rest.append(data)
    if not out:
        return []
    hosts = rest or [b""]
    for k in range(max(len(out), MOVED)):
        parts, moved, secrets = hosts[k % len(hosts)].split(b" "), b"", []
        at = set(r.choices(range(len(parts)), k=r.randint(1, 3)))
        for i, part in enumerate(parts):
            moved += part + b" "
            if i in at:
                before, after = (x.encode() for x in r.choice(_CONTEXTS).split("{}"))
                value = "".join(r.choices(r.choice(_ALPHABETS), k=r.randint(16, 64))).encode()
                secrets.append((len(moved) + len(before), len(moved) + len(before) + len(value)))
                moved += before + value + after + b" "
        out.append((moved, secrets))
    for data in rest:
        parts = data.split(b" ")
        for _ in range(r.randint(0, 6)):
            parts.insert(r.randint(0, len(parts)), _alike(r).encode())
        out.append((b" ".join(parts), []))
    return out


def train(texts: list[str], steps: int = TRAIN_STEPS, penalty: float = 1e-4) -> Field | None:
    """Maximises the log likelihood of the examples with Adam; None if no text has a finding."""
    known = examples(texts)
    if not known:
        return None
    raw = np.frombuffer(b"".join(d for d, _ in known), np.uint8)
    offsets = np.append(0, np.cumsum([len(d) for d, _ in known]))
    starts, ends, of = tokens(raw, offsets)
    y = _labels(starts, ends, of, [(d, int(offsets[d]) + s, int(offsets[d]) + e) for d, (_, own) in enumerate(known) for s, e in own])
    x = features(raw, offsets, starts, ends, of)
    beside = signatures(raw, starts, ends, of)
    v = np.zeros((len(NEIGHBOURS), SIGNATURES + 1, 3))
    w, t = np.zeros((WIDTH, 3)), np.zeros((3, 3))
    t[O, I] = -np.inf
    free = np.isfinite(t)
    # tokens of the same step of all documents stand side by side
    size = np.diff(of)
    order = np.argsort(-size, kind="stable")
    begin, size = of[:-1][order], size[order]
    steps_of = [begin[: np.searchsorted(-size, -k, "left")] + k for k in range(int(size.max(initial=0)))]
    steps_of = [s for s in steps_of if len(s)]
    moments = [np.zeros_like(x) for x in (w, w, t, t, v, v)]
    first = np.zeros(len(y), bool)
    first[begin[size > 0]] = True
    pairs = np.zeros((3, 3))
    inner = np.flatnonzero(~first)
    np.add.at(pairs, (y[inner - 1], y[inner]), 1)
    onehot = np.eye(3)[y]
    for step in range(1, steps + 1):
        score = (x @ w.astype(np.float32)).astype(np.float64)
        for i in range(len(NEIGHBOURS)):
            score += v[i][beside[:, i]]
        score[first, I] = -np.inf
        e = np.exp(score - score.max(1, keepdims=True))
        a = np.zeros_like(e)
        move = np.exp(t)
        for k, s in enumerate(steps_of):
            f = e[s] if k == 0 else (a[s - 1] @ move) * e[s]
            a[s] = f / f.sum(1, keepdims=True)
        b = np.ones_like(e)
        expected = np.zeros((3, 3))
        for k in range(len(steps_of) - 1, 0, -1):
            s = steps_of[k]
            g = e[s] * b[s]
            back = g @ move.T
            joint = np.einsum("ni,nj->nij", a[s - 1], g) * move
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b[s - 1] = back / back.sum(1, keepdims=True)
        p = a * b
        p /= p.sum(1, keepdims=True)
        n = len(known)
        off = onehot - p
        gw = x.T @ off.astype(np.float32) / n - penalty * w
        gt = np.where(free, (pairs - expected) / n, 0) - penalty * np.where(free, t, 0)
        # words are many and seen seldom: a stronger penalty keeps those of one context from deciding alone
        gv = np.stack([np.stack([np.bincount(beside[:, i], off[:, c], SIGNATURES + 1) for c in range(3)], 1) for i in range(len(NEIGHBOURS))]) / n - 10 * penalty * v
        for value, g, i in ((w, gw, 0), (t, gt, 2), (v, gv, 4)):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            moments[i + 1] = 0.99 * moments[i + 1] + 0.01 * g * g
            value += (0.2 if i < 4 else 0.04) * (moments[i] / (1 - 0.9**step)) / (np.sqrt(moments[i + 1] / (1 - 0.99**step)) + 1e-8)
        t[~free] = -np.inf
    return Field(w.astype(np.float32), v.astype(np.float32), t)


def field_spans(field: Field, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Spans that the field tags, in the form of base_spans."""
    starts, ends, of = tokens(raw, offsets)
    if not len(starts):
        return []
    state = field.decode(field.scores(raw, offsets, starts, ends, of), of)
    inside = np.flatnonzero(state != O)
    out: list[list[int]] = []
    for i in inside.tolist():
        s, e = int(starts[i]), int(ends[i])
        d = int(np.searchsorted(of, i, "right")) - 1
        if state[i] == I and out and out[-1][0] == d and s - out[-1][3] == 1 and JOINT[raw[s - 1]]:
            out[-1][3] = e
        else:
            out.append([d, s, 3, e])
    return [tuple(x) for x in out]


def all_spans(field: Field | None, raw: np.ndarray, offsets: np.ndarray) -> tuple[list, list]:
    """Base spans, and base spans with those that the field adds, both in order."""
    base = base_spans(raw, offsets)
    if field is None:
        return base, base
    taken: dict[int, list[tuple[int, int]]] = {}
    for d, s, _, e in base:
        taken.setdefault(d, []).append((s, e))
    added = [x for x in field_spans(field, raw, offsets) if not any(x[1] < e and s < x[3] for s, e in taken.get(x[0], ()))]
    return base, sorted(base + added)


def _in_code_points(raw: np.ndarray, offsets: np.ndarray, spans: list) -> list[tuple[int, int, int, int]]:
    if not spans:
        return []
    lead = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    return [(d, int(lead[s] - lead[offsets[d]]), k, int(lead[e] - lead[offsets[d]])) for d, s, k, e in spans]


def fit(docs: DataFrame) -> Field | None:
    """The field of at most TRAIN_ROWS documents: half with base findings, those of the lowest hashes among all such, half without."""
    return train(_sample(docs))


def _sample(docs: DataFrame) -> list[str]:
    """Texts for training; of a long one TRAIN_CHARS characters around its first finding or any place, cut at white space."""
    bounded_batches(docs.sparkSession)
    shared_folder(docs.sparkSession)
    each = TRAIN_ROWS // 2
    named = docs.filter(F.length("text") > 0).select(F.xxhash64("doc_id", "text", F.lit(8)).alias("at"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each kind only the lowest hashes of a partition are kept: (hash, first finding)
        kept: list[dict[int, int]] = [{}, {}]
        for b in chunks(batches):
            raw, offsets = utf8(b.column("text"))
            first: dict[int, int] = {}
            for d, s, _, _ in _in_code_points(raw, offsets, base_spans(raw, offsets)):
                first[d] = min(s, first.get(d, s))
            length = pc.utf8_length(b.column("text")).to_pylist()
            for d, at in enumerate(b.column("at").to_pylist()):
                kept[d in first][at] = first.get(d, at % length[d])  # without a finding the window is anywhere
            kept = [dict(sorted(k.items())[:each]) for k in kept]
        rows = [(found, at, start) for found, k in enumerate(kept) for at, start in k.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["found", "at", "start"])

    # the lowest of each partition, then of many groups side by side, then of all: no task sees more than a few of them
    groups = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = Window.partitionBy("found", "group").orderBy("at", "start")
    low = named.mapInArrow(run, "found long, at long, start long").distinct().withColumn("group", F.pmod("at", F.lit(groups)))
    low = low.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= each).checkpoint()
    chosen = [(r.at, r.start) for k in (0, 1) for r in low.filter(F.col("found") == k).orderBy("at", "start").limit(each).collect()]
    if not chosen:
        return []
    chosen_df = F.broadcast(docs.sparkSession.createDataFrame(chosen, "at long, start long"))  # TRAIN_ROWS at most
    begin = F.greatest(F.lit(0), F.least(F.col("start") - TRAIN_CHARS // 2, F.length("text") - TRAIN_CHARS)).cast("int")
    cut = named.join(chosen_df, "at").select("at", begin.alias("begin"), F.length("text").alias("length"), F.col("text").substr(begin + 1, F.lit(TRAIN_CHARS)).alias("text"))
    out = []
    for r in sorted(cut.groupBy("at").agg(F.min(F.struct("text", "begin", "length")).alias("r")).collect(), key=lambda r: r.at):
        text = r.r.text
        if r.r.begin + len(text) < r.r.length and (m := re.search(r"\s\S*\Z", text)) and m.start() > 3 * TRAIN_CHARS // 4:
            text = text[: m.start()]
        if r.r.begin and (m := re.search(r"\s", text)) and m.end() < TRAIN_CHARS // 4:
            text = text[m.end() :]
        out.append(text)
    return out


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, the base spans' hash and all spans."""
    bounded_batches(docs.sparkSession)
    field = field or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, limit=SCAN_BYTES):
            raw, offsets = utf8(b.column("text"))
            base, spans = (_in_code_points(raw, offsets, x) for x in all_spans(field, raw, offsets))
            count = np.zeros((4, b.num_rows), np.int64)
            text: list[list[str]] = [[] for _ in range(b.num_rows)]
            base_text: list[list[str]] = [[] for _ in range(b.num_rows)]
            for d, s, k, e in base:
                count[k, d] += 1
                base_text[d].append(f"{KINDS[k]}:{s}:{e}")
            for d, s, k, e in spans:
                text[d].append(f"{KINDS[k]}:{s}:{e}")
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in base_text]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(count[k]) for k in range(3)), pa.array(sha, pa.string()), pa.array([",".join(x) for x in text], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field | None = None, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span in ``text`` replaced by a mark; a null text stays null."""
    bounded_batches(docs.sparkSession)
    field = field or fit(docs)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, limit=SCAN_BYTES):
            raw, offsets = utf8(b.column("text"))
            spans: dict[int, list[tuple[int, int]]] = {}
            for d, s, _, e in all_spans(field, raw, offsets)[1]:
                if spans.get(d) and s < spans[d][-1][1]:
                    spans[d][-1] = (spans[d][-1][0], max(e, spans[d][-1][1]))
                else:
                    spans.setdefault(d, []).append((s, e))
            if spans:
                text = b.column("text").to_pylist()
                for d, parts in spans.items():
                    out, last = [], offsets[d]
                    for s, e in parts:
                        out += [raw[last:s].tobytes(), mark.encode()]
                        last = e
                    text[d] = b"".join([*out, raw[last : offsets[d + 1]].tobytes()]).decode()
                b = pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names)
            yield b

    return docs.mapInArrow(run, docs.schema)
