"""A linear-chain conditional random field with two labels, for many sequences at once.

Sequences lie one after the other. A step is a 2x2 matrix that takes the forward
message over one token; the first token of a sequence has a matrix of rank one,
which forgets what came before. So one scan over all tokens serves all sequences:
tokens are laid out in equal chunks, the matrices of all chunks are multiplied in
step, the few chunk products are chained, and a second sweep fills in the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CHUNK = 128


@dataclass
class Chain:
    """Log potentials: ``start`` of two labels, ``step`` from label to label."""

    start: np.ndarray
    step: np.ndarray


def steps(scores: np.ndarray, first: np.ndarray, chain: Chain) -> np.ndarray:
    """Matrices (2, 2, chunks, CHUNK); ``scores``: log potential of label 1 against 0; ``first``: marks first tokens."""
    n = len(scores)
    size = max(1, -(-n // CHUNK)) * CHUNK
    hot = np.ones(size)
    hot[:n] = np.exp(np.clip(scores, -30, 30))
    begins = np.ones(size, dtype=bool)
    begins[:n] = first
    t, s = np.exp(chain.step), np.exp(chain.start)
    out = np.empty((2, 2, size))
    for i in range(2):
        out[i, 0] = np.where(begins, s[0], t[i, 0])
        out[i, 1] = np.where(begins, s[1], t[i, 1]) * hot
    return out.reshape(2, 2, -1, CHUNK)


def messages(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward messages after each token and backward messages before the next, each (2, chunks, CHUNK), scaled."""
    chunks = m.shape[2]
    product = np.zeros((2, 2, chunks))
    product[0, 0] = product[1, 1] = 1
    for at in range(CHUNK):
        x = m[:, :, :, at]
        product = np.stack([np.stack([product[i, 0] * x[0, j] + product[i, 1] * x[1, j] for j in range(2)]) for i in range(2)])
        product /= product.sum(axis=(0, 1))
    ahead, behind = np.empty((2, chunks)), np.empty((2, chunks))
    p = product.transpose(2, 0, 1).tolist()
    a, b = 0.5, 0.5
    for k in range(chunks):
        ahead[0, k], ahead[1, k] = a, b
        (p00, p01), (p10, p11) = p[k]
        a, b = a * p00 + b * p10, a * p01 + b * p11
        a, b = a / (a + b), b / (a + b)
    a, b = 0.5, 0.5
    for k in range(chunks - 1, -1, -1):
        behind[0, k], behind[1, k] = a, b
        (p00, p01), (p10, p11) = p[k]
        a, b = p00 * a + p01 * b, p10 * a + p11 * b
        a, b = a / (a + b), b / (a + b)
    forward, backward = np.empty((2, chunks, CHUNK)), np.empty((2, chunks, CHUNK))
    for at in range(CHUNK):
        x = m[:, :, :, at]
        ahead = np.stack([ahead[0] * x[0, j] + ahead[1] * x[1, j] for j in range(2)])
        ahead /= ahead.sum(axis=0)
        forward[:, :, at] = ahead
    for at in range(CHUNK - 1, -1, -1):
        backward[:, :, at] = behind
        x = m[:, :, :, at]
        behind = np.stack([x[i, 0] * behind[0] + x[i, 1] * behind[1] for i in range(2)])
        behind /= behind.sum(axis=0)
    return forward, backward


def marginals(scores: np.ndarray, first: np.ndarray, chain: Chain) -> np.ndarray:
    """The probability of label 1 for each token."""
    forward, backward = messages(steps(scores, first, chain))
    hot = (forward[1] * backward[1]).ravel()[: len(scores)]
    return hot / (hot + (forward[0] * backward[0]).ravel()[: len(scores)])


def pair_sums(scores: np.ndarray, first: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of label 1, and the expected counts of steps (2, 2) and of first labels (2)."""
    m = steps(scores, first, chain)
    forward, backward = messages(m)
    n = len(scores)
    f, b, m = forward.reshape(2, -1)[:, :n], backward.reshape(2, -1)[:, :n], m.reshape(2, 2, -1)[:, :, :n]
    hot = f[1] * b[1]
    hot = hot / (hot + f[0] * b[0])
    go = np.flatnonzero(~first)
    joint = f[:, None, go - 1] * m[:, :, go] * b[None, :, go]
    joint /= joint.sum(axis=(0, 1))
    begin = hot[first].sum()
    return hot, joint.sum(axis=2), np.array([first.sum() - begin, begin])


def fit(features: np.ndarray, labels: np.ndarray, first: np.ndarray, buckets: int, *, rounds: int = 30, rate: float = 0.5, decay: float = 1e-6, seed: int = 7) -> tuple[np.ndarray, Chain]:
    """Adagrad on the log likelihood. ``features``: (kinds, tokens) of weight numbers. Returns the weights and the chain."""
    weights, chain = np.zeros(buckets), Chain(np.zeros(2), np.zeros((2, 2)))
    seen_w, seen_s, seen_t = np.full(buckets, 1e-6), np.full(2, 1e-6), np.full((2, 2), 1e-6)
    begins = np.flatnonzero(first)
    parts = np.array_split(np.random.default_rng(seed).permutation(len(begins)), max(1, min(8, len(begins))))
    ends = np.append(begins[1:], len(labels))
    for number in range(rounds):
        part = parts[number % len(parts)]
        at = np.concatenate([np.arange(begins[i], ends[i]) for i in part])
        x, y, f = features[:, at], labels[at], first[at]
        hot, joint, begin = pair_sums(sum(weights[kind] for kind in x), f, chain)
        go = np.flatnonzero(~f)
        real = np.zeros((2, 2))
        np.add.at(real, (y[go - 1], y[go]), 1)
        real_begin = np.bincount(y[f], minlength=2)
        slope = sum(np.bincount(kind, weights=y - hot, minlength=buckets) for kind in x) / len(part) - decay * weights
        seen_w += slope**2
        weights += rate * slope / np.sqrt(seen_w)
        slope = (real - joint) / len(part)
        seen_t += slope**2
        chain.step += rate * slope / np.sqrt(seen_t)
        slope = (real_begin - begin) / len(part)
        seen_s += slope**2
        chain.start += rate * slope / np.sqrt(seen_s)
    return weights, chain
