"""Linear-chain conditional random fields in numpy: many sequences at once, step by step along the longest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Sequence cells (sequences x longest) that are padded together.
CELLS = 1 << 17


def batches(lengths: np.ndarray, cells: int = CELLS) -> Iterator[np.ndarray]:
    """Indices of sequences, longest first, in groups whose padded size is bounded (a longer sequence stands alone)."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    k = 0
    while k < len(order):
        take = max(1, cells // int(lengths[order[k]]))
        yield order[k : k + take]
        k += take


def padded(start: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (time, sequence) into the flat rows, and which of them are real; the group is longest first."""
    n = lengths[group]
    steps = np.arange(n[0])[:, None]
    real = steps < n[None, :]
    return np.where(real, start[group][None, :] + steps, 0), real


def forward_backward(score: np.ndarray, real: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of every label, expected number of each move, log-likelihood normaliser.

    score is (time, sequence, label) in logarithms, move (label, label). Probabilities are rescaled at every step.
    """
    steps, _, labels = score.shape
    top = score.max(axis=2, keepdims=True)
    emit = np.exp(score - top)
    trans = np.exp(move)
    alive = real.sum(axis=1)
    ahead, scale = np.zeros_like(emit), np.ones(real.shape)
    for t in range(steps):
        m = alive[t]
        x = emit[t, :m] if t == 0 else (ahead[t - 1, :m] @ trans) * emit[t, :m]
        scale[t, :m] = x.sum(axis=1)
        ahead[t, :m] = x / scale[t, :m, None]
    norm = float((np.log(scale) + top[..., 0])[real].sum())
    post, pair = np.zeros_like(emit), np.zeros((labels, labels))
    back = np.ones(emit.shape[1:])
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        post[t, :m] = ahead[t, :m] * back[:m]
        if t:
            right = emit[t, :m] * back[:m] / scale[t, :m, None]
            pair += (ahead[t - 1, :m].T @ right) * trans
            back[:m] = right @ trans.T
    return post, pair, norm


def viterbi(score: np.ndarray, real: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best label of every (time, sequence); ties go to the smaller label."""
    steps, width, _ = score.shape
    alive = real.sum(axis=1)
    came = np.zeros(score.shape, np.int16)
    best = np.zeros(score.shape)
    for t in range(steps):
        m = alive[t]
        if t == 0:
            best[0] = score[0]
            continue
        via = best[t - 1, :m, :, None] + move[None]
        came[t, :m] = via.argmax(axis=1)
        best[t, :m] = via.max(axis=1) + score[t, :m]
    out = np.zeros((steps, width), np.int64)
    n = real.sum(axis=0)
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        last = n[:m] == t + 1
        follow = out[t + 1, :m] if t + 1 < steps else np.zeros(m, np.int64)
        after = came[t + 1, np.arange(m), follow] if t + 1 < steps else np.zeros(m, np.int64)
        out[t, :m] = np.where(last, best[t, :m].argmax(axis=1), after)
    return out


class Adam:
    def __init__(self, *shapes: tuple[int, ...], rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]

    def step(self, params: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)
