"""Population search over parameter vectors: particle swarm and differential evolution.

All runs advance together; one generation is one scoring pass over the samples with the swarms of
every run in it. For named scores the samples are packed as matrices once and stored on disk like that. The driver holds the swarms only (runs x population vectors).
Update rules: Kennedy and Eberhart 1995 with the inertia weight of Shi and Eberhart 1998;
Storn and Price 1997 (rand/1/bin).
"""

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tallysift.operators.blocks import persist_blocks
from tallysift.operators.scoring import Score, packed_samples
from tallysift.operators.scoring import fit_candidate_scores as candidate_scores
from tallysift.session import persist_evenly
from tallysift.sources.schemas import HISTORY

BOUND = math.pi  # fixed value: parameters start in, and stay within, [-pi, pi]
METHODS = ("PSO", "DE")
RESUME = "Run int, Epoch int, state string"


@dataclass(frozen=True)
class SearchResult:
    """Best parameters and fitness per run, the history table, the per-generation states, and ``resume``: all
    that a later call needs to go on with each run from its last state (Run, Epoch, state), to be stored as a table."""

    best: dict[int, list[float]]
    fitness: dict[int, float]
    history: DataFrame
    states: DataFrame
    resume: DataFrame


def fit_population(
    samples: DataFrame, features: list[str], label: str, *, method: str = "PSO", runs: int = 1,
    base_seed: int = 0, generations: int = 100, population: int = 10, dimensions: int | None = None,
    tolerance: float = 0.0, score: str | Score = "logistic", state_every: int = 10,
    resume: DataFrame | None = None,
) -> SearchResult:
    """Maximise the mean log-likelihood; each run is seeded base_seed + run.

    A run stops early once its best and mean personal-best fitness differ by less than
    ``tolerance``. History rows are ``fitness`` (best so far) and ``mean_best`` (mean of the
    personal bests) per generation.

    With ``resume``, the ``resume`` table of an earlier call, its runs go on from their last epoch up to
    ``generations``, as if they had never stopped; history and states are those of the new epochs. Runs that
    the table doesn't have begin anew.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
    if method == "DE" and population < 4:
        raise ValueError("differential evolution needs a population of at least 4")
    size = dimensions or len(features)
    wanted = samples.select(*features, label)
    if callable(score):
        cached, _ = persist_evenly(wanted)
    else:
        cached = persist_blocks(wanted, lambda df: packed_samples(df, features, label))
    swarm = _Swarm if method == "PSO" else _Evolution
    searches = {r: swarm(np.random.default_rng(base_seed + r - 1), population, size)
                for r in range(1, runs + 1)}
    history, states, reached = [], [], dict.fromkeys(searches, 0)
    for r in resume.collect() if resume is not None else []:
        if r["Run"] in searches:
            reached[r["Run"]] = r["Epoch"]
            searches[r["Run"]].restore(r["state"])
    active = {r for r, epoch in reached.items() if epoch < generations}
    for r in {r for r in active if reached[r]}:
        best, mean = searches[r].summary()
        if abs(best - mean) < tolerance:
            active.discard(r)
    for epoch in range(min(reached.values()) + 1, generations + 1):
        # runs that were resumed further on wait for the others
        order = sorted(r for r in active if reached[r] < epoch)
        if not order:
            continue
        flat = [list(map(float, v)) for r in order for v in searches[r].proposals()]
        scored = np.array(candidate_scores(cached, features, label, flat, score), float)
        for at, r in enumerate(order):
            searches[r].accept(scored[at * population:(at + 1) * population])
            reached[r] = epoch
            best, mean = searches[r].summary()
            history += [(r, epoch, "fitness", best), (r, epoch, "mean_best", mean)]
            done = abs(best - mean) < tolerance
            if done or epoch == generations or epoch % state_every == 0:
                states.append((r, epoch, searches[r].best()))
            if done:
                active.discard(r)
        if not active:
            break
    cached.unpersist()
    spark = samples.sparkSession
    return SearchResult(
        {r: s.best() for r, s in searches.items()}, {r: s.summary()[0] for r, s in searches.items()},
        spark.createDataFrame(history, HISTORY),
        spark.createDataFrame(states, "Run int, Epoch int, params array<double>"),
        spark.createDataFrame([(r, reached[r], s.state()) for r, s in searches.items()], RESUME),
    )


class _Population:
    """Personal bests of one run."""

    ARRAYS = ("points", "kept", "values")

    def __init__(self, rng, population, size):
        self.rng = rng
        self.points = rng.uniform(-BOUND, BOUND, (population, size))
        self.kept = self.points.copy()
        self.values = np.full(population, -np.inf)

    def summary(self):
        return float(self.values.max()), float(self.values.mean())

    def best(self):
        return [float(v) for v in self.kept[self.values.argmax()]]

    def state(self) -> str:
        """Positions and the generator's state; numbers are written so that they read back as they were."""
        arrays = {name: getattr(self, name).tolist() for name in self.ARRAYS}
        return json.dumps({"method": type(self).__name__, "arrays": arrays, "generator": self.rng.bit_generator.state})

    def restore(self, state: str) -> None:
        found = json.loads(state)
        shape = np.array(found["arrays"]["points"]).shape
        if found["method"] != type(self).__name__ or shape != self.points.shape:
            raise ValueError(f"the stored state is of another search: {found['method']} of {shape}")
        for name in self.ARRAYS:
            setattr(self, name, np.array(found["arrays"][name], float))
        self.rng.bit_generator.state = found["generator"]

    def accept(self, fitness):
        better = fitness > self.values
        self.values = np.where(better, fitness, self.values)
        self.kept[better] = self.points[better]


class _Swarm(_Population):
    ARRAYS = (*_Population.ARRAYS, "speed")
    INERTIA, PULL = 0.729, 1.49445

    def __init__(self, rng, population, size):
        super().__init__(rng, population, size)
        self.speed = np.zeros_like(self.points)

    def proposals(self):
        if np.isfinite(self.values).all():
            own, joint = self.rng.random(self.points.shape), self.rng.random(self.points.shape)
            leader = self.kept[self.values.argmax()]
            self.speed = (self.INERTIA * self.speed + self.PULL * own * (self.kept - self.points)
                          + self.PULL * joint * (leader - self.points))
            self.points = np.clip(self.points + self.speed, -BOUND, BOUND)
        return self.points


class _Evolution(_Population):
    WEIGHT, CROSSOVER = 0.8, 0.9

    def proposals(self):
        if np.isfinite(self.values).all():
            count, size = self.kept.shape
            trials = np.empty_like(self.kept)
            for i in range(count):
                others = [j for j in range(count) if j != i]
                a, b, c = self.kept[self.rng.choice(others, 3, replace=False)]
                mutant = np.clip(a + self.WEIGHT * (b - c), -BOUND, BOUND)
                cross = self.rng.random(size) < self.CROSSOVER
                cross[self.rng.integers(size)] = True
                trials[i] = np.where(cross, mutant, self.kept[i])
            self.points = trials
        return self.points
