"""Proven least-energy subsets of many features, by branch and bound over prefixes of the subset.

Features are decided one after another, those with the largest coefficients first. A prefix's bound is its energy plus
what the undecided features can still take off: each undecided feature's gain, given what is chosen, is shared out among
its pairs with the other undecided ones, and every pair takes the best of its four cases. Couplings must not be negative;
redundancies never are.

Prefixes are rows. A round takes all open prefixes a few features further in parallel, drops those whose bound is above
the best subset known so far, and writes the rest to the shared folder; the driver sees the best subset and a count.
Nothing is sampled or capped: when no prefix is open, the best subset is the minimum.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysift.session import scratch_dir

MAX_FEATURES = 62
ROUND_FEATURES = 5
#: Prefixes that are expanded side by side in a task.
STEP_ROWS = 1 << 14


@dataclass(frozen=True)
class BoundedMinimum:
    """``mask``: bit i = feature i; ``rounds`` passes looked at ``prefixes`` prefixes. The minimum is proven."""

    mask: int
    energy: float
    rounds: int
    prefixes: int


class Problem:
    """Coefficients in the order in which features are decided."""

    def __init__(self, linear: list[float], pairs: dict[tuple[int, int], float]):
        if min(pairs.values(), default=0.0) < 0:
            raise ValueError("branch and bound needs couplings of at least 0")
        n = len(linear)
        if n > MAX_FEATURES:
            raise ValueError(f"at most {MAX_FEATURES} features, got {n}")
        coupling = np.zeros((n, n))
        for (i, j), v in pairs.items():
            coupling[i, j] = coupling[j, i] = v
        self.order = np.argsort(-(np.abs(linear) + coupling.sum(axis=1)), kind="stable")
        self.linear, self.coupling = np.array(linear, float)[self.order], coupling[np.ix_(self.order, self.order)]
        self.n, self.near = n, 1e-12 * max(1.0, float(np.abs(linear).sum()))

    def bits(self, masks: np.ndarray) -> np.ndarray:
        return (masks[:, None] >> np.arange(self.n) & 1).astype(float)

    def energies(self, masks: np.ndarray) -> np.ndarray:
        bits = self.bits(masks)
        return bits @ self.linear + ((bits @ self.coupling) * bits).sum(axis=1) / 2

    def bounds(self, masks: np.ndarray, energies: np.ndarray, depth: int) -> np.ndarray:
        """Least energies that subsets with these first ``depth`` decisions can have, or less."""
        left = self.n - depth
        if not left:
            return energies
        gains = self.linear[depth:] + self.bits(masks) @ self.coupling[:, depth:]
        if left == 1:
            return energies + np.minimum(gains[:, 0], 0)
        shared, total = gains / (left - 1), energies.copy()
        for i in range(left - 1):
            a, b = shared[:, i, None], shared[:, i + 1:]
            both = a + b + self.coupling[depth + i, depth + i + 1:]
            total += np.minimum(np.minimum(np.minimum(a, b), both), 0).sum(axis=1)
        return total

    def descend(self, mask: int) -> int:
        """Flip single features, or swap two, while that lowers the energy."""
        energy = float(self.energies(np.array([mask]))[0])
        while True:
            singles = mask ^ (1 << np.arange(self.n, dtype=np.int64))
            i, j = np.triu_indices(self.n, 1)
            near = np.concatenate([singles, mask ^ (1 << i.astype(np.int64)) ^ (1 << j.astype(np.int64))])
            values = self.energies(near)
            k = int(np.argmin(values))
            if values[k] >= energy - self.near:
                return mask
            mask, energy = int(near[k]), float(values[k])

    def original(self, mask: int) -> int:
        return sum(1 << int(self.order[i]) for i in range(self.n) if mask >> i & 1)

    def ordered(self, mask: int) -> int:
        return sum(1 << i for i in range(self.n) if mask >> int(self.order[i]) & 1)


PREFIXES = "mask long, energy double, bound double"


def _further(open_: DataFrame, problem: Problem, depth: int, stop: int, best: float) -> DataFrame:
    """Prefixes of ``depth`` decisions to those of ``stop`` that may still beat ``best`` or tie with it."""
    def expand(masks: np.ndarray, energies: np.ndarray, at: int) -> Iterator[tuple]:
        if at == stop:
            yield masks, energies, problem.bounds(masks, energies, at)
            return
        gain = problem.linear[at] + problem.bits(masks) @ problem.coupling[:, at]
        masks, energies = np.concatenate([masks, masks | 1 << at]), np.concatenate([energies, energies + gain])
        good = problem.bounds(masks, energies, at + 1) <= best + problem.near
        masks, energies = masks[good], energies[good]
        # in steps, so that what a task holds doesn't double with every feature
        for k in range(0, len(masks), STEP_ROWS):
            yield from expand(masks[k:k + STEP_ROWS], energies[k:k + STEP_ROWS], at + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, energies = (batch.column(i).to_numpy() for i in range(2))
            for k in range(0, len(masks), STEP_ROWS):
                for found in expand(masks[k:k + STEP_ROWS], energies[k:k + STEP_ROWS], depth):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["mask", "energy", "bound"])

    return open_.mapInArrow(run, PREFIXES)


def fit_bounded_minimum(spark: SparkSession, linear: list[float], pairs: dict[tuple[int, int], float],
                        starts: list[int] = ()) -> BoundedMinimum:
    """The subset of least energy, proven; ties go to the smallest mask. ``starts``: subsets to begin the search with."""
    problem = Problem(linear, pairs)
    n = problem.n
    if not n:
        return BoundedMinimum(0, 0.0, 0, 0)
    rng = np.random.default_rng(0)
    tries = [0, (1 << n) - 1, *(problem.ordered(m) for m in starts), *(int(m) for m in rng.integers(0, 1 << n, 32))]
    best = min(float(problem.energies(np.array([problem.descend(m)]))[0]) for m in tries)
    # the first decisions fill the cores
    depth = min(n, 8)
    masks = np.arange(1 << depth, dtype=np.int64)
    open_ = spark.range(1 << depth, numPartitions=spark.sparkContext.defaultParallelism).select(
        F.col("id").alias("mask"), F.lit(0.0).alias("energy"), F.lit(0.0).alias("bound"))
    energies = problem.energies(masks)
    seed = dict(zip(masks.tolist(), energies.tolist()))
    rounds = seen = 0

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([seed[m] for m in own]), batch.column(2)], names=batch.schema.names)

    open_ = open_.mapInArrow(seeded, PREFIXES)
    while True:
        stop = min(n, depth + ROUND_FEATURES)
        path = scratch_dir(spark, "prefixes")
        _further(open_, problem, depth, stop, best).write.parquet(path)
        found = spark.read.schema(PREFIXES).parquet(path)
        rounds, depth = rounds + 1, stop
        # a prefix is a subset too, that which takes nothing further
        least = found.agg(F.count("*").alias("n"), F.min("energy").alias("energy")).first()
        seen += least["n"]
        best = min(best, least["energy"]) if least["n"] else best
        if depth == n:
            ties = found.where(F.col("energy") <= best + problem.near)
            order = [int(i) for i in problem.order]
            mask = sum((F.shiftright("mask", i).bitwiseAND(F.lit(1)) * F.lit(1 << order[i]) for i in range(n)), F.lit(0).cast("long"))
            return BoundedMinimum(int(ties.agg(F.min(mask)).first()[0]), best, rounds, seen)
        cores = spark.sparkContext.defaultParallelism
        open_ = found.where(F.col("bound") <= best + problem.near).repartition(max(cores, -(-least["n"] // STEP_ROWS)))
