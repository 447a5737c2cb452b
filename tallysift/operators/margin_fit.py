"""Maximum-margin separator on random features, by Newton passes with a certified duality gap.

Minimised over (w, b), for y in {-1, 1} and random features z of a row:
    |w|^2 / 2 + sum of max(0, 1 - y (w.z + b)),
with a ridge of 1e-6 on b, for its curvature. The hinge of t is smoothed to (t + sqrt(t^2 + 4 h^2)) / 2. Its slope at a row is
a point of the dual problem once both classes' slopes are scaled to the same sum, so one pass over the rows gives the loss, its
gradient, its second derivative (a matrix of the features' number) and both objectives. A second pass compares step lengths
along the Newton direction. h is narrowed as long as the smoothing is what keeps the two objectives apart.

The rows carry no dual variables: nothing per row is kept, written or lost between passes, and no row is ever wider than it
came. What a task sends has the size of that matrix.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame

from tallysift.operators.blocks import add_up

RIDGE = 1e-6
WIDEST, NARROWING = 1.0, 0.1
#: The direction is done when it promises less than this share of what the smoothing costs.
DONE = 0.3
#: Rows whose random features are held at once.
PIECE_ROWS = 1024
STEPS = np.array([1.0, 0.7, 0.5, 0.35, 0.25, 0.17, 0.1, 0.05, 0.02, 1.4, 2.0])


@dataclass(frozen=True)
class MarginFit:
    weights: np.ndarray
    bias: float
    objective: float
    gap: float  # primal less dual objective, as a share of the primal
    passes: int


def fit_margin(blocks: DataFrame | RDD, features: int, width: int, lift: Callable[..., np.ndarray], tol: float,
               max_passes: int) -> MarginFit:
    """``blocks``: packed features and a label of 0 or 1; ``lift``: features to ``width`` random features,
    written to ``out``."""
    n = width + 1
    upper = np.triu_indices(n)

    def rows_of(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held = np.empty((PIECE_ROWS, n))
        for part in pieces(values):
            z = held[:len(part)]
            lift(part[:, :features], out=z[:, :width])
            z[:, width] = 1
            yield z, np.where(part[:, features] == 1, 1.0, -1.0)

    def evaluate(v: np.ndarray, h: float) -> tuple:
        def step(values: np.ndarray) -> np.ndarray:
            losses, slopes, second = np.zeros(2), np.zeros((2, n)), np.zeros((n, n))
            for z, y in rows_of(values):
                t = 1 - y * (z @ v)
                root = np.sqrt(t * t + 4 * h * h)
                alpha = (1 + t / root) / 2
                hinge = np.maximum(t, 0)
                losses += hinge.sum(), (hinge - alpha * t).sum()
                slopes += np.where([y > 0, y < 0], alpha, 0.0) @ z
                z *= np.sqrt(2 * h * h / root ** 3)[:, None]
                second += z.T @ z
            return np.concatenate([losses, *slopes, second[upper]])

        total = add_up(blocks, features + 1, 2 + 2 * n + len(upper[0]), step)
        (hinge, loose), up, down = total[:2], total[2:2 + n], total[2 + n:2 + 2 * n]
        second = np.zeros((n, n))
        second[upper] = total[2 + 2 * n:]
        second = second + np.triu(second, 1).T + np.diag(penalty)
        # slopes of equal sums are a point of the dual problem, and so is any share of them
        level = min(up[-1], down[-1])
        pull = sum(sign * part[:-1] * (level / part[-1]) for sign, part in ((1, up), (-1, down)) if part[-1] > 0)
        square = float(np.dot(pull, pull))
        share = min(1.0, 2 * level / square) if square > 0 else 1.0
        dual = 2 * share * level - share * share * square / 2
        return (v * penalty) @ v / 2 + hinge, dual, loose, penalty * v - (up - down), second

    def step_length(v: np.ndarray, move: np.ndarray, h: float) -> float:
        def step(values: np.ndarray) -> np.ndarray:
            t, along = np.hstack([np.stack([1 - y * (z @ v), -y * (z @ move)]) for z, y in rows_of(values)])
            out = np.empty(len(STEPS))
            for k, size in enumerate(STEPS):
                at = t + size * along
                out[k] = (at + np.sqrt(at * at + 4 * h * h)).sum() / 2
            return out

        smooth = add_up(blocks, features + 1, len(STEPS), step)
        points = v + STEPS[:, None] * move
        return float(STEPS[np.argmin(smooth + (points * points) @ penalty / 2)])

    penalty = np.append(np.ones(width), RIDGE)
    v, h, passes, best, lower = np.zeros(n), WIDEST, 0, None, -np.inf
    while True:
        passes += 1
        primal, dual, loose, gradient, second = evaluate(v, h)
        lower = max(lower, dual)
        if best is None or primal < best[0]:
            best = (primal, v)
        if best[0] - lower <= tol * best[0] or passes + 2 > max_passes:
            break
        second[-1, -1] = max(second[-1, -1], 1.0)  # rows far from the kink say nothing about the bias
        move = -np.linalg.solve(second, gradient)
        if -float(gradient @ move) < DONE * loose and loose > 0.3 * tol * primal:
            h *= NARROWING
        passes += 1
        v = v + step_length(v, move, h) * move
    primal, v = best
    return MarginFit(v[:-1], float(v[-1]), float(primal), float((primal - lower) / primal) if primal > 0 else 0.0, passes)


def pieces(values: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(values), PIECE_ROWS):
        yield values[at:at + PIECE_ROWS]


def decisions(rows: np.ndarray, lift: Callable[..., np.ndarray], fit: MarginFit) -> np.ndarray:
    """The fit's decision values for rows of features."""
    return np.concatenate([np.zeros(0), *(lift(part) @ fit.weights + fit.bias for part in pieces(rows))])


def fit_calibration(blocks: DataFrame | RDD, features: int, margin: Callable[[np.ndarray], np.ndarray], max_passes: int = 30) -> tuple[float, float]:
    """Slope and shift of a logistic fit on the margins (Platt 1999, with its targets of (n + 1) / (n + 2))."""
    def counts(values: np.ndarray) -> np.ndarray:
        ones = float((values[:, features] == 1).sum())
        return np.array([ones, len(values) - ones])

    ones, zeros = add_up(blocks, features + 1, 2, counts)
    high, low = (ones + 1) / (ones + 2), 1 / (zeros + 2)

    def evaluate(v: np.ndarray) -> np.ndarray:
        def step(values: np.ndarray) -> np.ndarray:
            m = margin(values[:, :features])
            target = np.where(values[:, features] == 1, high, low)
            t = m * v[0] + v[1]
            p = 1 / (1 + np.exp(-np.clip(t, -700, 700)))
            miss, weight = p - target, p * (1 - p)
            return np.array([(np.logaddexp(0, t) - target * t).sum(), miss @ m, miss.sum(), (weight * m) @ m, weight @ m, weight.sum()])

        return add_up(blocks, features + 1, 6, step)

    v, state, size, move = np.array([0.0, np.log((ones + 1) / (zeros + 1))]), None, 1.0, np.zeros(2)
    for _ in range(max_passes):
        loss, g0, g1, a, b, c = evaluate(v)
        if state is not None and loss > state[0] + 1e-12 * abs(state[0]):
            size /= 4
            if size < 1e-6:
                return float(state[1][0]), float(state[1][1])
            v = state[1] + size * move
            continue
        state, size = (loss, v), 1.0
        move = -np.linalg.solve(np.array([[a, b], [b, c]]) + 1e-12 * np.eye(2) * max(1.0, a, c), np.array([g0, g1]))
        if abs(g0 * move[0] + g1 * move[1]) <= 1e-12 * max(1.0, abs(loss)):
            break
        v = v + move
    return float(state[1][0]), float(state[1][1])
