"""A generative model of voters that may be wrong and may copy each other, and a linear classifier.

Both work on small matrices of a bounded sample, in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FLOOR = 1e-4
ROUNDS = 500
TOLERANCE = 1e-8
REPEATS = 0.5
START_ROWS = 20


@dataclass(frozen=True)
class LabelModel:
    """P(vote | class) of each voter, the share of class 1, and how far a voter counts as independent."""

    hit: np.ndarray  # P(vote = 1 | class 1)
    false: np.ndarray  # P(vote = 1 | class 0)
    prior: float
    correlation: np.ndarray  # between voters, given the class
    weight: np.ndarray

    @property
    def accuracy(self) -> np.ndarray:
        return self.prior * self.hit + (1 - self.prior) * (1 - self.false)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return _posterior(votes, self.hit, self.false, self.prior, self.weight)


def _posterior(votes, hit, false, prior, weight):
    fired = weight * (np.log(hit) - np.log(false))
    silent = weight * (np.log1p(-hit) - np.log1p(-false))
    z = np.log(prior / (1 - prior)) + votes @ fired + (1 - votes) @ silent
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _rates(votes, p, often, like=(0.5, 0.5), rows=1):
    """P(vote | class) for soft labels p, smoothed by as many ``rows`` that vote ``like`` this."""
    hit = ((often * p) @ votes + rows * like[0]) / (often @ p + rows)
    false = ((often * (1 - p)) @ votes + rows * like[1]) / (often @ (1 - p) + rows)
    return np.clip(hit, FLOOR, 1 - FLOOR), np.clip(false, FLOOR, 1 - FLOOR)


def fit_label_model(votes: np.ndarray, start: np.ndarray, often: np.ndarray) -> LabelModel:
    """Expectation maximisation from the soft labels ``start``; row k stands for ``often[k]`` equal rows.

    They settle which class is which and how large it is, which votes alone cannot, and they weigh as much
    as ``START_ROWS`` rows of either class in the voters' rates.

    Between its passes the correlation of voters given the class is estimated from what the class leaves
    unexplained. Voters whose correlation passes ``REPEATS`` repeat each other and share a vote: one that k
    others repeat counts 1 / (1 + k), so copies add up to one voter.
    """
    votes = votes.astype(float)
    weight = np.ones(votes.shape[1])
    p = start.astype(float)
    last = -1.0
    correlation = np.eye(votes.shape[1])
    total = often.sum()
    prior = float(np.clip(often @ p / total, FLOOR, 1 - FLOOR))
    began = _rates(votes, p, often)
    for n in range(ROUNDS):
        hit, false = _rates(votes, p, often, began, START_ROWS)
        if n % 10 == 0:
            rest = votes - p[:, None] * hit - (1 - p)[:, None] * false
            scale = np.sqrt(often @ (rest * rest) / total) + 1e-9
            correlation = ((often[:, None] * rest).T @ rest) / total / np.outer(scale, scale)
            weight = 1 / np.maximum(np.where(correlation > REPEATS, correlation, 0).sum(axis=1), 1)
        p = _posterior(votes, hit, false, prior, weight)
        now = float(often @ p / total)
        if n % 10 and abs(now - last) < TOLERANCE:
            break
        last = now
    return LabelModel(hit, false, prior, correlation, weight)


def fit_linear(x: np.ndarray, target: np.ndarray, often: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft targets, by Newton steps until the gradient vanishes.

    Row k stands for ``often[k]`` equal rows.
    """
    x = np.column_stack([x.astype(float), np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return float(often @ (np.logaddexp(0, z) - target * z) + 0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        g = x.T @ (often * (p - target)) + penalty * w
        if np.abs(g).max() < 1e-6 * often.sum():
            break
        h = (x * (often * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        now = loss(w)
    return w[:-1], float(w[-1])
