"""Classical baselines: logistic regression and an RBF-kernel classifier."""

import math
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysift.operators.blocks import add_up, mapped, pack, persist_blocks, stored
from tallysift.operators.margin_fit import decisions, fit_calibration, fit_margin
from tallysift.session import persist_evenly

NAMES = ("LogReg", "SVM-RBF")  # fixed values: model names in comparison tables
LIFTED_ROWS = 128
#: Of sin(2 pi t) / t in t * t up to a quarter turn, off by 1e-16 at most between the points of interpolation.
SINE = np.polynomial.Chebyshev.interpolate(
    lambda s: 2 * math.pi * np.sinc(2 * np.sqrt(s)), 9, [0, 1 / 16]).convert(kind=np.polynomial.Polynomial).coef


def fit_logistic(train: DataFrame, features: list[str], label: str = "label", max_iter: int = 1000,
                 tol: float = 1e-8):
    """L2-penalised logistic regression with C = 1.

    Spark averages the loss over rows, so the penalty is divided by the row count to keep the
    objective of the summed form.
    """
    vectors = _assembled(train, features).select("vector", F.col(label).cast("double").alias("label"))
    cached, rows = persist_evenly(vectors)
    model = LogisticRegression(
        featuresCol="vector", labelCol="label", regParam=1.0 / rows, elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=tol,
    ).fit(cached)
    cached.unpersist()
    return model


def logistic_predictions(model, df: DataFrame, features: list[str], keep: tuple[str, ...]) -> DataFrame:
    """P(1) and the predicted label next to ``keep``."""
    scored = model.transform(_assembled(df, features))
    return scored.select(
        *keep, vector_to_array("probability")[1].alias("prob"), F.col("prediction").cast("int").alias("predicted"))


@dataclass(frozen=True)
class Separator:
    coefficients: DenseVector
    intercept: float


@dataclass(frozen=True)
class KernelModel:
    """Random Fourier features, the linear separator on them and its probability calibration.

    ``gap`` is the share of the objective by which the separator may miss the optimum.
    """

    frequencies: tuple[tuple[float, ...], ...]
    phases: tuple[float, ...]
    separator: Separator
    calibration: tuple[float, float]
    converged: bool
    objective: float = float("nan")
    gap: float = float("nan")
    passes: int = 0


def fit_kernel(train: DataFrame, features: list[str], label: str = "label", width: int = 128,
               seed: int = 0, max_iter: int = 30, tol: float = 3e-4) -> KernelModel:
    """RBF support-vector classifier by random Fourier features (Rahimi and Recht 2007).

    gamma = 1 / (number of features x variance of all feature values). Neither the kernel matrix, which
    grows with the square of the rows, nor a row's random features are ever stored: each pass forms them
    block by block; only the decision values are, for the calibration. ``converged`` tells whether the duality gap came below ``tol`` of the objective within
    ``max_iter`` passes. Probabilities come from a logistic fit on the decision value (Platt 1999).
    Rows with a null feature are left out.
    """
    known = train.select(*features, F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias(label))
    blocks = persist_blocks(known, lambda df: pack(df, [*features, label]))
    count = len(features)
    rows, total, squares = add_up(blocks, count + 1, 3, lambda x: np.array(
        [len(x), x[:, :count].sum(), (x[:, :count] ** 2).sum()]))
    values = max(1.0, rows * count)
    variance = squares / values - (total / values) ** 2
    gamma = 1.0 / (count * variance) if variance > 0 else 1.0
    rng = np.random.default_rng(seed)
    frequencies = rng.normal(0.0, math.sqrt(2 * gamma), (width, count))
    phases = rng.uniform(0.0, 2 * math.pi, width)
    lift = partial(fourier_features, frequencies=frequencies, phases=phases)
    fit = fit_margin(blocks, count, width, lift, tol, max_iter)
    decided = stored(mapped(blocks, count + 1, lambda x: np.column_stack([decisions(x[:, :count], lift, fit), x[:, count]])))
    blocks.unpersist()
    calibration = fit_calibration(decided, 1, lambda x: x[:, 0])
    decided.unpersist()
    return KernelModel(
        tuple(map(tuple, frequencies.tolist())), tuple(phases.tolist()),
        Separator(DenseVector(fit.weights), fit.bias), calibration, fit.gap <= tol, fit.objective, fit.gap, fit.passes)


def fourier_features(x: np.ndarray, frequencies: np.ndarray, phases: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """cos(w.x + b) * sqrt(2 / width) for every random frequency, written to ``out`` if there is one.

    The cosine of t turns is the sine of what is left to a quarter turn, here by a polynomial over a few rows that stay in
    the cache: as exact as the library's, and some times faster.
    """
    width = len(phases)
    out = np.empty((len(x), width)) if out is None else out
    waves, shifts = (frequencies / (2 * math.pi)).T, phases / (2 * math.pi)
    sine, (turns, squares, sums) = SINE * math.sqrt(2.0 / width), np.empty((3, LIFTED_ROWS, width))
    for at in range(0, len(x), LIFTED_ROWS):
        rows = x[at:at + LIFTED_ROWS]
        left, square, total = turns[:len(rows)], squares[:len(rows)], sums[:len(rows)]
        np.matmul(rows, waves, out=left)
        left += shifts
        left -= np.rint(left, out=square)
        np.abs(left, out=left)
        np.subtract(0.25, left, out=left)
        np.multiply(left, left, out=square)
        np.multiply(square, sine[-1], out=total)
        for c in sine[-2:0:-1]:
            total += c
            total *= square
        total += sine[0]
        np.multiply(total, left, out=out[at:at + LIFTED_ROWS])
    return out


def kernel_margins(model: KernelModel, df: DataFrame, features: list[str], name: str = "margin") -> DataFrame:
    """Add the decision value; null where a feature is."""
    frequencies, phases = np.array(model.frequencies), np.array(model.phases)
    weights, bias = model.separator.coefficients.toArray(), model.separator.intercept

    @F.arrow_udf("double")
    def decision(*columns: pa.Array) -> pa.Array:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
        return pa.array(fourier_features(x, frequencies, phases) @ weights + bias)

    inputs = [F.col(c).cast("double") for c in features]
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in features))
    return df.withColumn(name, F.when(known, decision(*inputs)))


def kernel_predictions(model: KernelModel, df: DataFrame, features: list[str],
                       keep: tuple[str, ...]) -> DataFrame:
    """P(1) and the predicted label (sign of the decision value) next to ``keep``."""
    slope, shift = model.calibration
    margin = F.col("_margin")
    return kernel_margins(model, df, features, "_margin").select(
        *keep, (1.0 / (1.0 + F.exp(-(margin * slope + shift)))).alias("prob"),
        (margin > 0).cast("int").alias("predicted"),
    )


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="vector").transform(df)
