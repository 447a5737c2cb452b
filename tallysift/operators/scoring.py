"""Scoring many candidate parameter vectors on all samples in one pass.

Named scores are matrix products: a block of samples meets all candidates at once and a task sends one sum per candidate.
A score given as a column expression unfolds the candidates in every row instead.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysift.functions.readout import log_likelihood, log_likelihood_sums
from tallysift.functions.scores import MATRIX_SCORES, SCORES
from tallysift.operators.blocks import add_up, is_packed, matrices, pack

Score = Callable[[list[Column], list[Column]], Column]
MAX_PARAMETERS = 1_000_000
#: Scores, and candidates, that a step of a task forms at once: as many as stay in a core's cache.
STEP_SCORES, STEP_CANDIDATES = 1 << 14, 128


def score_builder(score: str | Score) -> Score:
    """A named score, or the user's own builder (feature columns, parameter columns) -> column."""
    if callable(score):
        return score
    if score not in SCORES:
        raise ValueError(f"unknown score {score!r}, expected one of {sorted(SCORES)}")
    return SCORES[score]


def candidate_scores(
    samples: DataFrame, features: list[str], label: str, candidates: list[list[float]],
    score: str | Score = "logistic",
) -> DataFrame:
    """Mean log-likelihood of each candidate over all samples: (cand, fitness, samples).

    Samples with a null feature or label count as samples but not in the mean.
    """
    if not callable(score) and len({len(c) for c in candidates}) == 1:
        score_builder(score)
        _check_size(candidates)
        return _matrix_scores(packed_samples(samples, features, label), len(features), np.array(candidates, float), score)
    unfolded = _with_candidates(samples.select(*features, label), candidates)
    prob = score_builder(score)([F.col(c) for c in features], _parameters(candidates))
    return unfolded.groupBy("cand").agg(
        F.avg(log_likelihood(F.col(label), prob)).alias("fitness"),
        F.count(F.lit(1)).alias("samples"),
    )


def fit_candidate_scores(
    samples: DataFrame | RDD, features: list[str], label: str, candidates: list[list[float]],
    score: str | Score = "logistic",
) -> list[float]:
    """The fitness of each candidate, at once. ``samples`` may be ``packed_samples``, stored or not, if the score has a name: a pass
    over them is one stage, whose tasks send a sum per candidate."""
    if not is_packed(samples):
        rows = candidate_scores(samples, features, label, candidates, score).collect()
        return [r["fitness"] for r in sorted(rows, key=lambda r: r["cand"])]
    _check_size(candidates)
    count, columns = len(candidates), len(features) + 1
    points, matrix = np.array(candidates, float), MATRIX_SCORES[score]

    def step(values: np.ndarray) -> np.ndarray:
        return np.append(_likelihoods(values, points, matrix), len(values))

    total = add_up(samples, columns, count + 1, step)
    return [float(v) / total[-1] if total[-1] else float("nan") for v in total[:-1]]


def packed_samples(samples: DataFrame, features: list[str], label: str) -> DataFrame:
    """Samples as matrices for ``candidate_scores``; a null label counts as 0, as it does in ``log_likelihood``."""
    known = F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias(label)
    return pack(samples.select(*features, known), [*features, label])


def _likelihoods(values: np.ndarray, candidates: np.ndarray, matrix: Callable) -> np.ndarray:
    """Sums per candidate over the rows of ``values`` (features, then the label), some thousand scores at a time."""
    total = np.zeros(len(candidates))
    for at in range(0, len(candidates), STEP_CANDIDATES):
        some = candidates[at:at + STEP_CANDIDATES]
        rows = STEP_SCORES // len(some)
        for k in range(0, len(values), rows):
            part = values[k:k + rows]
            total[at:at + STEP_CANDIDATES] += log_likelihood_sums(part[:, -1], matrix(part[:, :-1], some))
    return total


def _matrix_scores(blocks: DataFrame, features: int, candidates: np.ndarray, score: str) -> DataFrame:
    count, matrix = len(candidates), MATRIX_SCORES[score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, nulls = np.zeros(count), 0, 0
        for batch in batches:
            for values in matrices(batch, features + 1):
                rows += len(values)
                total += _likelihoods(values, candidates, matrix)
            nulls += sum(batch.column(1).to_pylist())
        if rows + nulls:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(count, dtype=np.int32)), pa.array(total), *(pa.array(np.full(count, n)) for n in (rows, nulls))],
                names=["cand", "total", "known", "nulls"])

    sums = blocks.mapInArrow(run, "cand int, total double, known long, nulls long").groupBy("cand").agg(
        *(F.sum(c).alias(c) for c in ("total", "known", "nulls")))
    return sums.select("cand", F.try_divide("total", "known").alias("fitness"), (F.col("known") + F.col("nulls")).alias("samples"))


def best_candidate(scores: DataFrame) -> DataFrame:
    """The candidate of highest fitness; ties go to the smallest number."""
    return scores.agg(F.max(F.struct("fitness", (-F.col("cand")).alias("rank"))).alias("b")).select(
        (-F.col("b.rank")).alias("cand"), F.col("b.fitness").alias("fitness"))


def run_table(samples: DataFrame, runs: int, base_seed: int) -> DataFrame:
    """Repeat the samples for each run; run g is seeded base_seed + g and numbered from 1."""
    run = F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")
    return samples.select("*", run).withColumn("seed", F.lit(base_seed - 1) + F.col("run"))


def predict(
    samples: DataFrame, features: list[str], parameters: dict[int, list[float]],
    score: str | Score = "logistic", keep: tuple[str, ...] = ("label",),
) -> DataFrame:
    """P(1) of every sample under the parameters of every run: (run, keep..., prob)."""
    runs = sorted(parameters)
    vectors = [parameters[r] for r in runs]
    wanted = samples.select(*dict.fromkeys([*features, *keep]))
    prob = score_builder(score)([F.col(c) for c in features], _parameters(vectors))
    return _with_candidates(wanted, vectors).select(
        F.get(F.lit(runs), "cand").alias("run"), *keep, prob.alias("prob"))


def _check_size(candidates: list[list[float]]) -> None:
    size = sum(len(c) for c in candidates)
    if size > MAX_PARAMETERS:
        raise ValueError(f"{size} candidate parameters exceed the literal bound of {MAX_PARAMETERS}")


def _with_candidates(df: DataFrame, candidates: list[list[float]]) -> DataFrame:
    _check_size(candidates)
    rows = ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in c) + ")" for c in candidates)
    return df.select("*", F.posexplode(F.expr(f"array({rows})")).alias("cand", "params"))


def _parameters(candidates: list[list[float]]) -> list[Column]:
    return [F.get("params", F.lit(i)) for i in range(len(candidates[0]))]
