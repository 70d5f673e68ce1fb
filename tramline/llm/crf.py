"""A linear-chain conditional random field with two labels, in numpy."""

from __future__ import annotations

import dataclasses

import numpy as np


@dataclasses.dataclass
class Chain:
    """Weights for label 1 by feature, and for each pair of labels, by kind of step."""

    weights: np.ndarray       # by feature
    steps: np.ndarray         # kind of step, label before, label

    def best(self, features: list[list[int]], kinds: list[int]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        score = [float(self.weights[f].sum()) for f in features]
        steps = self.steps.tolist()
        back: list[tuple[int, int]] = []
        zero, one = 0.0, score[0] if score else 0.0
        for s, kind in zip(score[1:], kinds[1:]):
            (a, b), (c, d) = steps[kind]
            to_zero, to_one = (zero + a, one + c), (zero + b, one + d)
            back.append((int(to_zero[1] > to_zero[0]), int(to_one[1] > to_one[0])))
            zero, one = max(to_zero), max(to_one) + s
        labels = [int(one > zero)] if score else []
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def fit(pages: list[tuple[list[list[int]], list[int], list[int]]], size: int, kinds: int,
        rounds: int = 80, rate: float = 0.1, ridge: float = 0.002) -> Chain:
    """Maximum likelihood by Adam over all pages (features, kinds of step, labels) at once."""
    pages = [p for p in pages if p[0]]
    rows, longest = len(pages), max((len(p[0]) for p in pages), default=1)
    there = np.zeros((rows, longest), dtype=bool)
    kind = np.zeros((rows, longest), dtype=np.int64)
    truth = np.zeros((rows, longest))
    flat, cell = [], []
    for i, (features, k, labels) in enumerate(pages):
        n = len(features)
        there[i, :n], kind[i, :n], truth[i, :n] = True, k, labels
        for j, f in enumerate(features):
            flat += f
            cell += [i * longest + j] * len(f)
    flat, cell = np.array(flat, dtype=np.int64), np.array(cell, dtype=np.int64)
    both = there[:, 1:] & there[:, :-1]
    seen_steps = np.zeros((kinds, 2, 2))
    np.add.at(seen_steps, (kind[:, 1:][both], truth[:, :-1][both].astype(int), truth[:, 1:][both].astype(int)), 1)
    weights, steps = np.zeros(size), np.zeros((kinds, 2, 2))
    moments = [np.zeros(size + kinds * 4) for _ in range(2)]
    total = max(1, there.sum())
    for t in range(1, rounds + 1):
        score = np.bincount(cell, weights[flat], rows * longest).reshape(rows, longest)
        forward, backward = np.zeros((rows, longest, 2)), np.zeros((rows, longest, 2))
        forward[:, 0, 1] = score[:, 0]
        for j in range(1, longest):
            step = forward[:, j - 1, :, None] + steps[kind[:, j]]
            new = np.logaddexp(step[:, 0], step[:, 1])
            new[:, 1] += score[:, j]
            forward[:, j] = np.where(there[:, j, None], new, forward[:, j - 1])
        for j in range(longest - 2, -1, -1):
            step = steps[kind[:, j + 1]] + backward[:, j + 1, None, :]
            step[:, :, 1] += score[:, j + 1, None]
            new = np.logaddexp(step[:, :, 0], step[:, :, 1])
            backward[:, j] = np.where(there[:, j + 1, None], new, 0)
        norm = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - norm[:, None])
        gap = np.where(there, chance - truth, 0).ravel()
        g_weights = np.bincount(flat, gap[cell], size) / total + ridge * weights / 10
        pair = (forward[:, :-1, :, None] + steps[kind[:, 1:]] + backward[:, 1:, None, :])
        pair[:, :, :, 1] += score[:, 1:, None]
        pair = np.exp(pair - norm[:, None, None, None]) * both[:, :, None, None]
        expected = np.zeros((kinds, 2, 2))
        np.add.at(expected, kind[:, 1:].ravel(), pair.reshape(-1, 2, 2))
        g = np.concatenate([g_weights, ((expected - seen_steps) / total + ridge * steps / 10).ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = rate * (moments[0] / (1 - 0.9 ** t)) / (np.sqrt(moments[1] / (1 - 0.99 ** t)) + 1e-9)
        weights = weights - move[:size]
        steps = steps - move[size:].reshape(kinds, 2, 2)
    return Chain(weights, steps)
