"""Closed-form scores P(1) of a feature vector under a parameter vector, as columns and for whole matrices."""

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(x: list[Column], w: list[Column]) -> Column:
    """1 / (1 + exp(-w.x)); the last parameter is a bias when there is one more than features."""
    terms = [a * b for a, b in zip(x, w)] + list(w[len(x):])
    return 1.0 / (1.0 + F.exp(-reduce(lambda a, b: a + b, terms)))


def product_form(x: list[Column], w: list[Column]) -> Column:
    """Product over features of sin^2((x + w) / 2)."""
    parts = [F.pow(F.sin((a + b) / 2), F.lit(2.0)) for a, b in zip(x, w)]
    return reduce(lambda a, b: a * b, parts)


def logistic_matrix(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``logistic`` of every row of x under every row of w."""
    out = x @ -w[:, :x.shape[1]].T
    out -= w[:, x.shape[1]:].sum(axis=1)
    with np.errstate(over="ignore"):
        np.exp(out, out=out)
    out += 1.0
    return np.divide(1.0, out, out=out)


def product_matrix(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``product_form`` of every row of x under every row of w."""
    out = np.ones((len(x), len(w)))
    for k in range(min(x.shape[1], w.shape[1])):
        part = x[:, k, None] + w[None, :, k]
        part /= 2
        np.sin(part, out=part)
        part *= part
        out *= part
    return out


SCORES = {"logistic": logistic, "product": product_form}
MATRIX_SCORES = {"logistic": logistic_matrix, "product": product_matrix}
