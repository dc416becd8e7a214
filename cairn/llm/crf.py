"""Conditional random field inference over many sequences at once, in numpy.

Sequences are laid out one after another. Forward and backward sums are products of L x L
matrices; where a sequence begins the matrix doesn't depend on the state before it, so that all
sequences are one chain. The chain is cut into blocks that are multiplied side by side, the blocks'
products are chained in turn, and the vectors inside the blocks follow: the number of numpy steps
grows with the logarithm of the tokens, not with the longest sequence.
"""

from __future__ import annotations

import numpy as np

BLOCK = 32


def _scan(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """v @ m[0], v @ m[0] @ m[1], ...; each scaled to sum 1. m: (n, L, L), not negative."""
    n, labels = m.shape[0], m.shape[1]
    if n <= 4 * BLOCK:
        out = np.empty((n, labels))
        for i in range(n):
            v = v @ m[i]
            v = v / v.sum()
            out[i] = v
        return out
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks * BLOCK, labels, labels))
    padded[:n] = m
    padded[n:] = np.eye(labels)
    # step, label, label, block: blocks lie side by side in memory
    steps = np.ascontiguousarray(padded.reshape(blocks, BLOCK, labels, labels).transpose(1, 2, 3, 0))
    total = steps[0]
    for s in range(1, BLOCK):
        new = np.zeros_like(total)
        for i in range(labels):
            for j in range(labels):
                for k in range(labels):
                    new[i, j] += total[i, k] * steps[s, k, j]
        total = new / new.sum(axis=(0, 1))
    ends = _scan(np.ascontiguousarray(total.transpose(2, 0, 1)), v)
    now = np.concatenate([(v / v.sum())[None], ends[:-1]]).T
    out = np.empty((BLOCK, labels, blocks))
    for s in range(BLOCK):
        new = np.zeros_like(now)
        for j in range(labels):
            for k in range(labels):
                new[j] += now[k] * steps[s, k, j]
        now = new / new.sum(axis=0)
        out[s] = now
    return out.transpose(2, 0, 1).reshape(-1, labels)[:n]


def marginals(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """P(label) of every token. emit: (n, L) log potentials; first: True where a sequence begins."""
    n, labels = emit.shape
    if not n:
        return np.zeros((0, labels))
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    t = np.exp(trans - trans.max())
    s = np.exp(start - start.max())
    into = np.where(first[:, None, None], s[None, None, :], t[None]) * e[:, None, :]
    alpha = _scan(into, np.ones(labels))
    # Backward: from the right, the vector before token i + 1 is trans @ (e * beta); ends restart at ones.
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    back = np.ones((n, labels, labels))
    back[:-1] = (t[None] * e[1:, None, :]).transpose(0, 2, 1)
    back[last] = 1.0
    beta = _scan(back[::-1], np.ones(labels))[::-1]
    beta = np.where(last[:, None], 1.0, beta)
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True)


def pair_marginals(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(label) of each token, sum over neighbouring tokens of P(label, next label))."""
    n, labels = emit.shape
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    t = np.exp(trans - trans.max())
    s = np.exp(start - start.max())
    into = np.where(first[:, None, None], s[None, None, :], t[None]) * e[:, None, :]
    alpha = _scan(into, np.ones(labels))
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    back = np.ones((n, labels, labels))
    back[:-1] = (t[None] * e[1:, None, :]).transpose(0, 2, 1)
    back[last] = 1.0
    beta = np.where(last[:, None], 1.0, _scan(back[::-1], np.ones(labels))[::-1])
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    inner = np.flatnonzero(~first)
    pair = alpha[inner - 1][:, :, None] * t[None] * (e[inner] * beta[inner])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return p, pair.sum(axis=0)


def log_likelihood(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, labels: np.ndarray) -> float:
    """Log probability of one sequence's labels, by the plain forward recursion (for tests)."""
    score = start[labels[0]] + emit[0, labels[0]]
    a = start + emit[0]
    for i in range(1, len(labels)):
        score += trans[labels[i - 1], labels[i]] + emit[i, labels[i]]
        a = np.logaddexp.reduce(a[:, None] + trans, axis=0) + emit[i]
    return float(score - np.logaddexp.reduce(a))
