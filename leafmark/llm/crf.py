"""Linear-chain conditional random fields over the words of texts, many texts at a time.

Scores of a word depend on the word alone (and, shifted, on its neighbours), so a
worker keeps them by word. A text is one chain, whatever its length. Forward-backward
cuts a long chain into segments that are stepped through together with all others:
first the product of each segment's transfer matrices, then the vectors that enter it
from both sides, carried from segment to segment, then its own words. That is the same
sum over paths in another order of multiplication, so nothing changes at a border.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words of a segment. Only speed hangs on it.
SEGMENT = 192
#: Labels up to which products of transfer matrices are worth it; with more, a chain is one segment.
FEW_LABELS = 12
#: Words of a block of texts, from which on it is worked off.
BLOCK_WORDS = 150_000
#: Word types a worker keeps scores of, and types scored at a time.
CACHE_TYPES, TYPES_AT_ONCE = 300_000, 8192


class _Steps:
    """Words of chains laid out step by step: all first words, then all second ones, longest chains first."""

    def __init__(self, sizes: np.ndarray, starts: np.ndarray) -> None:
        """sizes must not rise; starts: each chain's first row."""
        self.n = int(sizes[0])
        self.alive = np.searchsorted(-sizes, -np.arange(self.n), side="left").tolist()  # chains longer than t
        self.first = np.concatenate([[0], np.cumsum(self.alive)])
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.rows = np.repeat(starts, sizes) + within
        self.flat = self.first[within] + np.repeat(np.arange(len(sizes)), sizes)

    def laid(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[self.flat] = x[self.rows]
        return out

    def back(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[self.rows] = x[self.flat]
        return out

    def at(self, t: int, n: int | None = None) -> slice:
        """The places of the words of step t, of the first n chains."""
        first = int(self.first[t])
        return slice(first, first + (self.alive[t] if n is None else n))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (x.sum(-1, keepdims=True) + 1e-30)


def _following(chain: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The segment after each one in its chain, -1 after the last."""
    order = np.lexsort((nth, chain))
    out = np.full(len(chain), -1)
    same = chain[order[1:]] == chain[order[:-1]]
    out[order[:-1][same]] = order[1:][same]
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, with_pairs: bool = True, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray | None, float]:
    """Marginals of each word, expected counts of label pairs if asked for, and the sum of log Z.

    scores: [words, labels] of all chains end to end. trans: [labels, labels].
    """
    k = len(trans)
    if not len(scores):
        return np.zeros((0, k)), np.zeros((k, k)) if with_pairs else None, 0.0
    lengths = lengths[lengths > 0]
    if k > FEW_LABELS:
        segment = int(lengths.max())
    counts = -(-lengths // segment)
    chain = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(counts) - counts, counts)
    sizes = np.minimum(segment, lengths[chain] - nth * segment)
    order = np.argsort(-sizes, kind="stable")
    starts = (np.repeat(np.cumsum(lengths) - lengths, counts) + nth * segment)[order]
    chain, nth, sizes = chain[order], nth[order], sizes[order]
    steps = _Steps(sizes, starts)
    top = scores.max(1, keepdims=True)
    emit, move = steps.laid(np.exp(scores - top)), np.exp(trans - trans.max()).astype(scores.dtype)
    n, last = len(sizes), steps.first[sizes - 1] + np.arange(len(sizes))
    ahead, behind = np.full((n, k), 1.0 / k, scores.dtype), np.ones((n, k), scores.dtype)
    following = _following(chain, nth) if len(counts) < n else np.full(n, -1)
    several = np.flatnonzero(counts[chain] > 1)
    if len(several):
        products = np.empty((n, k, k), scores.dtype)
        products[several] = emit[several][:, :, None] * np.eye(k, dtype=scores.dtype)
        for t in range(1, steps.n):
            on = several[: np.searchsorted(several, steps.alive[t])]
            if not len(on):
                break
            now = (products[on].reshape(-1, k) @ move).reshape(-1, k, k) * emit[steps.first[t] + on][:, None, :]
            products[on] = now / now.sum((1, 2), keepdims=True)
        levels = [np.flatnonzero((nth == i) & (following >= 0)) for i in range(int(nth.max()))]
        for own in levels:
            ahead[following[own]] = _unit(np.einsum("si,sij->sj", ahead[own], products[own])) @ move
        for own in reversed(levels):
            after = following[own]
            behind[own] = _unit(_unit(np.einsum("sij,sj->si", products[after], behind[after])) @ move.T)
    alpha, beta, log_z = np.empty_like(emit), np.empty_like(emit), 0.0
    for t in range(steps.n):
        here = steps.at(t)
        now = (alpha[steps.at(t - 1, steps.alive[t])] @ move if t else ahead) * emit[here]
        s = now.sum(1, keepdims=True)
        log_z += float(np.log(s).sum(dtype=np.float64))
        alpha[here] = now / s
    beta[last] = behind
    pairs = np.zeros((k, k)) if with_pairs else None
    for t in range(steps.n - 2, -1, -1):
        onward = emit[steps.at(t + 1)] * beta[steps.at(t + 1)]
        here = steps.at(t, steps.alive[t + 1])
        beta[here] = _unit(onward @ move.T)
        if with_pairs:
            pairs += _pairs(alpha[here], onward, move)
    if with_pairs and len(several):
        on = np.flatnonzero(following >= 0)
        pairs += _pairs(alpha[last[on]], emit[following[on]] * beta[following[on]], move)
    log_z += float(top.sum(dtype=np.float64)) + float(trans.max()) * float((lengths - 1).sum()) + np.log(k) * len(lengths)
    return steps.back(_unit(alpha * beta)), pairs, log_z


def _pairs(alpha: np.ndarray, onward: np.ndarray, move: np.ndarray) -> np.ndarray:
    total = np.einsum("si,ij,sj->s", alpha, move, onward, optimize=True)
    return (alpha.T @ (onward / (total[:, None] + 1e-30))) * move


def viterbi(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best label of each word, one chain for each of lengths."""
    if not len(scores):
        return np.zeros(0, np.int64)
    lengths = lengths[lengths > 0]
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    steps = _Steps(sizes, (np.cumsum(lengths) - lengths)[order])
    laid, k = steps.laid(scores), scores.shape[1]
    best, back, final = laid[steps.at(0)], np.zeros((len(scores), k), np.int8), np.zeros(len(sizes), np.int64)
    for t in range(steps.n):
        if t:
            tries = best[: steps.alive[t], :, None] + trans
            back[steps.at(t)] = tries.argmax(1)
            best = tries.max(1) + laid[steps.at(t)]
        ends = steps.alive[t + 1] if t + 1 < steps.n else 0
        final[ends : steps.alive[t]] = best[ends:].argmax(1)
    labels = np.zeros(len(scores), np.int64)
    for t in range(steps.n - 1, -1, -1):
        n = steps.alive[t]
        labels[steps.at(t)] = final[:n]
        if t:
            final[:n] = back[steps.at(t)][np.arange(n), final[:n]]
    return steps.back(labels)


def train(features: np.ndarray, types: np.ndarray, gold: np.ndarray, lengths: np.ndarray, labels: int, n_features: int, rounds: int = 40, rate: float = 0.3, decay: float = 1e-3, shifts: tuple[int, ...] = (0,)) -> tuple[np.ndarray, np.ndarray]:
    """Weights [shift * n_features, labels] and transitions, by full-batch Adam.

    features: [types, m] feature numbers of each word type, 0 for none. types: the
    type of each word. shifts: which neighbours a word's score takes features from
    (-1: the word before), within its chain.
    """
    n, m = len(types), features.shape[1]
    weights, trans = np.zeros((len(shifts) * n_features, labels), np.float64), np.zeros((labels, labels))
    starts = np.cumsum(lengths) - lengths
    chain = np.repeat(np.arange(len(lengths)), lengths)
    views = []
    for s in shifts:
        at = np.clip(np.arange(n) + s, 0, n - 1)
        views.append((at, (chain[at] == chain) & (np.arange(n) + s == at)))
    hits = np.zeros((n, labels))
    hits[np.arange(n), gold] = 1
    gold_pairs = np.zeros((labels, labels))
    inner = np.ones(n, bool)
    inner[starts] = False
    np.add.at(gold_pairs, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    moment = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(trans)]
    for step in range(1, rounds + 1):
        scores = np.zeros((n, labels))
        for k, (at, ok) in enumerate(views):
            by_type = weights[k * n_features : (k + 1) * n_features][features].sum(1)
            scores += by_type[types[at]] * ok[:, None]
        marginal, pairs, _ = forward_backward(scores, lengths, trans)
        slope = (hits - marginal) / n
        grad = np.zeros_like(weights)
        for k, (at, ok) in enumerate(views):
            for y in range(labels):
                of_type = np.bincount(types[at], slope[:, y] * ok, minlength=len(features))
                grad[k * n_features : (k + 1) * n_features, y] = np.bincount(features.ravel(), np.repeat(of_type, m), minlength=n_features)
            grad[k * n_features] = 0
        grads = (grad - decay * weights / n, (gold_pairs - pairs) / n - decay * trans / n)
        for i, (value, g) in enumerate(zip((weights, trans), grads, strict=True)):
            a, b = moment[2 * i], moment[2 * i + 1]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            value += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    return weights.astype(np.float32), trans.astype(np.float32)


class TypeScores:
    """Rows of scores by word, computed once a worker and forgotten when there are too many."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int, most: int = CACHE_TYPES) -> None:
        self.compute, self.most, self.places = compute, most, {}
        self.rows, self.used = np.zeros((1024, width), np.float32), 0

    def of(self, words: list[str]) -> np.ndarray:
        get = self.places.get
        found = list(map(get, words))
        if None in found:
            new = list({w for w, f in zip(words, found, strict=True) if f is None})
            if self.used + len(new) > self.most and self.used:
                self.places.clear()
                self.used = 0
                new = list(set(words))
            need = self.used + len(new)
            if need > len(self.rows):
                grown = np.zeros((max(need, min(2 * len(self.rows), self.most)), self.rows.shape[1]), np.float32)
                grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            for at in range(0, len(new), TYPES_AT_ONCE):
                self.rows[self.used + at : self.used + min(len(new), at + TYPES_AT_ONCE)] = self.compute(new[at : at + TYPES_AT_ONCE])
            self.places.update(zip(new, range(self.used, need), strict=True))
            self.used = need
            found = list(map(get, words))
        return self.rows[np.array(found, np.int64)]
