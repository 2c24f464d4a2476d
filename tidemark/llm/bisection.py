"""Recursive graph bisection of documents by the terms they share."""

from __future__ import annotations

import numpy as np

#: Exchanges of documents between the halves of a node, at most.
ROUNDS = 10


def _cost(degree: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits of a term's gaps in a half: its documents there times the logarithm of their mean distance."""
    return degree * (np.log2(np.maximum(size, 1)) - np.log2(degree + 1))


def _rank_in(group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Each entry's place within its group, groups being runs of ``group[order]``."""
    out, sorted_group = np.empty(len(group), np.int64), group[order]
    first = np.append(True, sorted_group[1:] != sorted_group[:-1])
    begin = np.flatnonzero(first)
    out[order] = np.arange(len(group)) - begin[np.cumsum(first) - 1]
    return out


def split(doc: np.ndarray, term: np.ndarray, node: np.ndarray, terms: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts every node in two halves of equal size (to one) whose terms are spread as little as possible.

    ``doc`` and ``term`` are the edges, ``node`` the node of each document. Each round moves, in pairs and from both
    halves, the documents whose moves save most bits. Returns each document's half, and per (node, term) that
    occurs its key ``node * terms + term`` and its documents in the left and the right half.
    """
    key, edge = np.unique(node[doc] * terms + term, return_inverse=True)
    nodes = int(node.max()) + 1 if len(node) else 0
    size = np.bincount(node, minlength=nodes)
    left_size = -(-size // 2)
    by_place = np.argsort(node, kind="stable")
    half = (_rank_in(node, by_place) >= left_size[node]).astype(np.int64)
    n_left, n_right = left_size[key // terms], (size - left_size)[key // terms]
    total = np.bincount(edge, minlength=len(key))
    for k in range(rounds + 1):
        right = np.bincount(edge, half[doc], len(key)).astype(np.int64)
        left = total - right
        if k == rounds:
            break
        now = _cost(left, n_left) + _cost(right, n_right)
        to_right = now - _cost(np.maximum(left - 1, 0), n_left) - _cost(right + 1, n_right)
        to_left = now - _cost(left + 1, n_left) - _cost(np.maximum(right - 1, 0), n_right)
        gain = np.bincount(doc, np.where(half[doc] == 0, to_right[edge], to_left[edge]), len(node))
        side = 2 * node + half
        rank = _rank_in(side, np.lexsort((-gain, side)))
        # the documents of equal rank in both halves are a pair
        slot = np.full((nodes, 2, int(size.max(initial=0)) // 2 + 1), -1, np.int64)
        slot[node, half, rank] = np.arange(len(node))
        a, b = slot[:, 0].ravel(), slot[:, 1].ravel()
        paired = (a >= 0) & (b >= 0)
        a, b = a[paired], b[paired]
        swap = gain[a] + gain[b] > 1e-9
        if not swap.any():
            break
        half[a[swap]], half[b[swap]] = 1, 0
    return half, key, left, right


def reorder(doc: np.ndarray, term: np.ndarray, docs: int, terms: int, leaf: int, rounds: int = ROUNDS) -> np.ndarray:
    """An order of the documents in which neighbours share terms: nodes are cut until they hold ``leaf`` documents at most."""
    order = np.arange(docs)
    often = np.bincount(term, minlength=terms)
    use = (often > 1)[term]  # a term of one document draws it nowhere
    doc, term = doc[use], term[use]
    node, most = np.zeros(docs, np.int64), docs
    while most > leaf:
        half = split(doc, term, node, terms, rounds)[0]
        node, most = 2 * node + half, -(-most // 2)
        _, node = np.unique(node, return_inverse=True)
    return order[np.argsort(node, kind="stable")]


class Router:
    """The upper levels of the bisection, fitted to a sample: every document goes down them by its terms."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, docs: int, terms: int, levels: int):
        node = np.zeros(docs, np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(levels):
            _, key, left, right = split(doc, term, node, terms)
            size = np.bincount(node, minlength=1 << k)
            n_left, n_right = (-(-size // 2))[key // terms], (size // 2)[key // terms]
            weight = np.zeros((1 << k, terms), np.float32)
            weight.ravel()[key] = np.log2((right + 1) / (n_right + 1)) - np.log2((left + 1) / (n_left + 1))
            lean = np.bincount(doc, weight[node[doc], term], docs)
            middle = np.array([np.median(lean[node == i]) if (node == i).any() else 0 for i in range(1 << k)])
            self.levels.append((weight, middle))
            node = 2 * node + (lean > middle[node])

    def leaves(self, doc: np.ndarray, term: np.ndarray, docs: int) -> np.ndarray:
        """The leaf of each document, from the edges to the sample's terms."""
        node = np.zeros(docs, np.int64)
        for weight, middle in self.levels:
            node = 2 * node + (np.bincount(doc, weight[node[doc], term], docs) > middle[node])
        return node
