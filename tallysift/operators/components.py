"""Principal components fitted on the training rows.

The driver never holds a matrix of features x features. A pass multiplies the centred rows with a few directions and
back, block by block, and sums up features x directions; the directions of all passes span a space (block Krylov) in which
the leading components are found, to machine precision where the space has as many dimensions as there are features, and
until the ratios stand still where it has fewer.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysift.operators.blocks import add_up, pack, pack_arrays, persist_blocks

#: Directions beyond the wanted components, and passes at most.
SPARE, MAX_PASSES = 8, 40
SETTLED = 1e-12


@dataclass(frozen=True)
class ComponentModel:
    """Column means, loadings (component x feature) and the explained variance ratios."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    loadings: tuple[tuple[float, ...], ...]
    explained: tuple[float, ...]

    @property
    def names(self) -> list[str]:
        return [f"PC{i + 1}" for i in range(len(self.loadings))]

    @property
    def explained_total(self) -> float:
        return sum(self.explained)


def fit_components(train: DataFrame, features: list[str], k: int) -> ComponentModel:
    """Learn k components. Rows with a null feature are left out.

    A component is signed so that its loading of largest absolute value is positive.
    """
    return _fitted(train.select(*features), lambda df: pack(df, features), features, k)


def fit_array_components(train: DataFrame, column: str, k: int) -> ComponentModel:
    """The same for features held in one fixed-length array column; the longest array sets the length."""
    size = train.agg(F.max(F.size(column))).first()[0] or 0
    return _fitted(train.select(column), lambda df: pack_arrays(df, column, size), [f"v{i}" for i in range(size)], k)


def to_components(df: DataFrame, model: ComponentModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """Centre with the training means and project: columns PC1..PCk next to ``keep``; null where a feature is null."""
    values = F.array(*(F.col(c).cast("double") for c in model.features))
    return df.select(*keep, *_projected(values, model))


def array_to_components(df: DataFrame, column: str, model: ComponentModel,
                        keep: tuple[str, ...] = ()) -> DataFrame:
    """The same for an array column; null where the array has another length."""
    return df.select(*keep, *_projected(F.col(column).cast("array<double>"), model))


def _projected(values: Column, model: ComponentModel) -> list[Column]:
    means, loadings = np.array(model.means), np.array(model.loadings).T

    @F.arrow_udf("array<double>")
    def project(rows: pa.Array) -> pa.Array:
        known = rows.drop_null()
        x = known.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(means))
        out = (x - means) @ loadings
        lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), out.ravel())
        place = np.cumsum(rows.is_valid().to_numpy(zero_copy_only=False)) - 1
        return lists.take(pa.array(place, mask=~rows.is_valid().to_numpy(zero_copy_only=False)))

    good = (F.size(values) == len(means)) & ~F.exists(values, lambda v: v.isNull())
    found = project(F.when(good, values))
    return [F.get(found, F.lit(i)).alias(name) for i, name in enumerate(model.names)]


def _fitted(rows: DataFrame, pack_up: Callable[[DataFrame], DataFrame], features: list[str], k: int) -> ComponentModel:
    n = len(features)
    if not 0 < k <= n:
        raise ValueError(f"{k} components of {n} features")
    blocks = persist_blocks(rows, pack_up)
    sums = add_up(blocks, n, n + 1, lambda x: np.append(x.sum(axis=0), len(x)))
    count = sums[-1]
    means = sums[:-1] / max(count, 1)
    variances = add_up(blocks, n, n, lambda x: ((x - means) ** 2).sum(axis=0))
    loadings, values = _leading(blocks, means, k)
    blocks.unpersist()
    total = float(variances.sum())
    loadings = [v * (np.sign(v[np.abs(v).argmax()]) or 1.0) for v in loadings]
    return ComponentModel(
        tuple(features), tuple(float(m) for m in means),
        tuple(tuple(float(v) for v in load) for load in loadings),
        tuple(float(v) / total if total > 0 else 0.0 for v in values))


def _leading(blocks: RDD, means: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvectors (as rows) of the centred rows' product with themselves, and their eigenvalues."""
    n = len(means)
    width = min(n, k + SPARE)
    new = np.linalg.qr(np.random.default_rng(0).normal(size=(n, width)))[0]
    basis, image, before = np.zeros((n, 0)), np.zeros((n, 0)), None
    for _ in range(MAX_PASSES):
        def step(x: np.ndarray, directions=new) -> np.ndarray:
            centred = x - means
            return (centred.T @ (centred @ directions)).ravel()

        product = add_up(blocks, n, n * new.shape[1], step).reshape(n, -1)
        basis, image = np.hstack([basis, new]), np.hstack([image, product])
        inner = basis.T @ image
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        if basis.shape[1] == n or before is not None and np.abs(values - before).max() <= SETTLED * max(values[0], 1e-300):
            break
        before = values
        # what the last directions were mapped to, less what is spanned already; small remainders are mostly rounding,
        # so directions are made orthogonal once more after they have been scaled up
        rest = product - basis @ (basis.T @ product)
        q, r = np.linalg.qr(rest)
        q = q[:, np.abs(np.diag(r)) > 1e-12 * max(1e-300, float(np.abs(product).max()))][:, :n - basis.shape[1]]
        for _ in range(2):
            q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
        new = q
        if not new.shape[1]:
            break
    return (basis @ vectors).T, np.maximum(values, 0)
