"""Linear-chain conditional random fields over many chains at once.

Chains are stored end to end; `first` holds each chain's first item and, last, the number of items. One step handles
the t-th item of all chains that are longer than t, so the loop is as long as the longest chain, not the data.
"""

from __future__ import annotations

import numpy as np


def _steps(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First items of the chains, longest first, and how many chains have a t-th item."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    longest = int(size[0]) if len(size) else 0
    return first[:-1][order], np.searchsorted(-size, -np.arange(longest), "left")


def marginals(scores: np.ndarray, first: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Forward-backward marginals of every item; with pairs=True also the expected transition counts and log Z's sum."""
    n, k = scores.shape
    kind = scores.dtype
    top = scores.max(axis=1, keepdims=True) if n else scores
    local = np.exp(np.maximum(scores - top, -60))
    move = np.exp(trans - trans.max()).astype(kind)
    alpha = np.empty((n, k), kind)
    log_z = float(top.sum()) if pairs else 0.0
    start, alive = _steps(first)
    for t, m in enumerate(alive.tolist()):
        at = start[:m] + t
        a = local[at] if t == 0 else (alpha[at - 1] @ move) * local[at]
        z = a.sum(axis=1, keepdims=True)
        alpha[at] = a / z
        if pairs:
            log_z += float(np.log(z).sum()) + (m * float(trans.max()) if t else 0.0)
    beta = np.ones((n, k), kind)
    counts = np.zeros((k, k))
    for t in range(len(alive) - 1, 0, -1):
        at = start[: alive[t]] + t
        right = local[at] * beta[at]
        back = right @ move.T
        if pairs:
            joint = alpha[at - 1][:, :, None] * move[None] * right[:, None, :]
            counts += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[at - 1] = back / back.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    return (p, counts, log_z) if pairs else p


def observed_pairs(labels: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    inside = np.ones(len(labels), bool)
    inside[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inside)
    return np.bincount(labels[at - 1] * k + labels[at], minlength=k * k).reshape(k, k).astype(float)


class Adam:
    """Steps uphill for a list of arrays."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m, self.v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for a, m, v, g in zip(self.arrays, self.m, self.v, gradients, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a += self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)
