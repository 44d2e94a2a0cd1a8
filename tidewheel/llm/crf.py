"""A linear-chain conditional random field in numpy, for batches of sequences.

Sequences of a batch are laid out time-major without padding: sorted by falling length, the tokens
at time ``t`` of all sequences that reach it stand together. Forward, backward and Viterbi passes then
take one numpy step for each time, whatever the number of sequences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: Feature numbers of tokens one after another, and how many each token has (at least one).
Features = tuple[np.ndarray, np.ndarray]


def listed(rows: list) -> Features:
    """Features of tokens from a list of feature numbers for each; a token without any has number 0."""
    n = np.array([max(1, len(r)) for r in rows], np.int64)
    return np.fromiter((f for r in rows for f in (r or (0,))), np.int64, int(n.sum())), n


@dataclass
class Crf:
    """weights: a row of label scores for each feature (row 0: unknown, all zero)."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, features: Features) -> np.ndarray:
        """Features of tokens -> (tokens, labels)."""
        flat, n = features
        if not len(n):
            return np.zeros((0, len(self.labels)), self.weights.dtype)
        return np.add.reduceat(self.weights[flat], np.cumsum(n) - n, axis=0)


class Layout:
    """Where the tokens of sequences, given one after another, stand in time-major order."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        sorted_lengths = lengths[self.order]
        longest = int(sorted_lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-sorted_lengths, -np.arange(1, longest + 1), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        n = int(lengths.sum())
        starts = np.cumsum(lengths) - lengths
        time = np.arange(n) - np.repeat(starts, lengths)
        self.where = self.at[time] + np.repeat(rank, lengths) if n else np.zeros(0, np.int64)

    def spread(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[self.where] = x
        return out

    def gather(self, x: np.ndarray) -> np.ndarray:
        return x[self.where]


def forward_backward(crf: Crf, emissions: np.ndarray, lengths: np.ndarray, pairs: bool = False):
    """Label probabilities of each token, in the order given; with ``pairs`` also the expected number
    of each transition, those of the first labels and the log likelihood's normalisers."""
    lay = Layout(lengths)
    top = emissions.max(axis=1, keepdims=True) if len(emissions) else emissions
    e = lay.spread(np.exp(emissions - top))
    a, at, act = np.exp(crf.transitions), lay.at, lay.active
    alpha, beta = np.empty_like(e), np.ones_like(e)
    scale = np.empty(len(e), e.dtype)
    for t, n in enumerate(act):
        here = slice(at[t], at[t] + n)
        x = e[here] * (np.exp(crf.start) if t == 0 else alpha[at[t - 1] : at[t - 1] + n] @ a)
        s = x.sum(axis=1)
        scale[here] = s
        alpha[here] = x / s[:, None]
    counts = np.zeros_like(crf.transitions)
    for t in range(len(act) - 1, 0, -1):
        n = act[t]
        here, before = slice(at[t], at[t] + n), slice(at[t - 1], at[t - 1] + n)
        back = e[here] * beta[here] / scale[here][:, None]
        beta[before] = back @ a.T
        if pairs:
            counts += a * (alpha[before].T @ back)
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    if not pairs:
        return lay.gather(p)
    n0 = act[0] if len(act) else 0
    log_z = np.log(scale).sum() + top.sum()
    return lay.gather(p), counts, p[:n0].sum(axis=0), log_z


def viterbi(crf: Crf, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label numbers of each sequence, one after another; ties go to the first label."""
    lay = Layout(lengths)
    e, at, act = lay.spread(emissions), lay.at, lay.active
    back = np.zeros(e.shape, np.int16)
    score = np.empty_like(e)
    for t, n in enumerate(act):
        here = slice(at[t], at[t] + n)
        if t == 0:
            score[here] = e[here] + crf.start
        else:
            step = score[at[t - 1] : at[t - 1] + n][:, :, None] + crf.transitions
            back[here] = step.argmax(axis=1)
            score[here] = e[here] + step.max(axis=1)
    best = np.zeros(len(e), np.int16)
    for t in range(len(act) - 1, -1, -1):
        n, more = act[t], act[t + 1] if t + 1 < len(act) else 0
        here = np.arange(at[t], at[t] + n)
        best[here[more:]] = score[here[more:]].argmax(axis=1)
        if more:
            after = slice(at[t + 1], at[t + 1] + more)
            best[here[:more]] = back[after][np.arange(more), best[after]]
    return lay.gather(best)


def viterbi_around(crf: Crf, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same as ``viterbi``, for sequences of which most tokens have label 0 whatever their neighbours have.

    Such a token's score for label 0 beats every other label's by more than transitions can give back. Labels
    between two of them depend on nothing else, so only the stretches of other tokens are decoded.
    """
    n, t = len(emissions), crf.transitions
    if not n:
        return np.zeros(0, np.int16)
    into, out = np.vstack([t, crf.start]), np.hstack([t, np.zeros((len(t), 1), t.dtype)])
    gain = (into - into[:, :1]).max(axis=0) + (out - out[:1]).max(axis=1)
    free = (emissions[:, 1:] + gain[1:] >= emissions[:, :1]).any(axis=1)
    first = np.zeros(n, bool)
    first[np.cumsum(lengths) - lengths] = True
    last = np.append(first[1:], True)
    at = np.flatnonzero(free)
    best = np.zeros(n, np.int16)
    if not len(at):
        return best
    opens = first[at] | ~np.append(False, free[:-1])[at]
    closes = last[at] | ~np.append(free[1:], False)[at]
    own = emissions[at].copy()
    own[opens & ~first[at]] += t[0] - crf.start
    own[closes & ~last[at]] += t[:, 0]
    best[at] = viterbi(crf, own, np.diff(np.append(np.flatnonzero(opens), len(at))))
    return best


def train(
    labels: list[str], n_features: int, features: list[Features], gold: list[np.ndarray], epochs: int = 20, batch: int = 32, rate: float = 0.1, l2: float = 1e-4, seed: int = 0
) -> Crf:
    """Maximum likelihood by Adagrad. ``features``: those of the tokens of each sequence."""
    k = len(labels)
    crf = Crf(labels, np.zeros((n_features, k)), np.zeros((k, k)), np.zeros(k))
    sums = [np.full(x.shape, 1e-8) for x in (crf.weights, crf.transitions, crf.start)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(features))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            f = tuple(np.concatenate([features[j][side] for j in pick]) for side in (0, 1))
            y = np.concatenate([gold[j] for j in pick])
            lengths = np.array([len(gold[j]) for j in pick])
            p, counts, first, _ = forward_backward(crf, crf.emissions(f), lengths, pairs=True)
            p[np.arange(len(y)), y] -= 1
            g_w = np.zeros_like(crf.weights)
            np.add.at(g_w, f[0], np.repeat(p, f[1], axis=0))
            inner = np.ones(len(y), bool)
            starts = np.cumsum(lengths) - lengths
            inner[starts] = False
            b = np.flatnonzero(inner)
            np.add.at(counts, (y[b - 1], y[b]), -1)
            np.add.at(first, y[starts], -1)
            for x, g, s in zip((crf.weights, crf.transitions, crf.start), (g_w, counts, first), sums, strict=True):
                g = g / len(pick) + l2 * x
                s += g * g
                x -= rate * g / np.sqrt(s)
            crf.weights[0] = 0
    return Crf(labels, crf.weights.astype(np.float32), crf.transitions.astype(np.float32), crf.start.astype(np.float32))
