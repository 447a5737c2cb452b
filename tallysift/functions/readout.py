"""From bitstring counts to P(1), and from P(1) to log-likelihood."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

READOUTS = ("single_qubit", "parity")
FLOOR = 1e-10  # fixed value: added to a probability before its logarithm
FACTORS = 16  # as many powers of FLOOR are far from underflow


def is_hit(bitstring: Column, readout: str = "single_qubit") -> Column:
    """Whether a measured bitstring counts as label 1; blanks in it are ignored."""
    if readout == "parity":
        ones = F.length(bitstring) - F.length(F.replace(bitstring, F.lit("1"), F.lit("")))
        return ones % 2 == 1
    if readout == "single_qubit":
        return F.right(F.replace(bitstring, F.lit(" "), F.lit("")), F.lit(1)) == "1"
    raise ValueError(f"unknown readout {readout!r}, expected one of {READOUTS}")


def prob_from_map(counts: Column, readout: str = "single_qubit") -> Column:
    """P(1) of a histogram held as a map, within its row; 0.0 when it is empty."""
    add = lambda total, count: total + count.cast("double")
    hits = F.map_values(F.map_filter(counts, lambda bits, count: is_hit(bits, readout)))
    shots = F.aggregate(F.map_values(counts), F.lit(0.0), add)
    share = F.try_divide(F.aggregate(hits, F.lit(0.0), add), shots)
    return F.when(shots > 0, share).otherwise(0.0)


def log_likelihood(label: Column, prob: Column) -> Column:
    """Natural log of the probability given to the true label."""
    return F.log(F.when(label == 1, prob).otherwise(1 - prob) + F.lit(FLOOR))


def log_likelihood_matrix(label: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """``log_likelihood`` of a column of probabilities per candidate."""
    sign = np.where(label == 1, 1.0, -1.0)[:, None]
    # prob for label 1, 1 - prob otherwise, without a second matrix to choose from
    return np.log((sign < 0) + sign * prob + FLOOR)


def log_likelihood_sums(label: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """The sum of ``log_likelihood_matrix`` per candidate; ``prob`` is overwritten.

    A logarithm costs more than all else, so ``FACTORS`` likelihoods, none below ``FLOOR``, are multiplied first.
    """
    other = label != 1
    prob *= np.where(other, -1.0, 1.0)[:, None]
    prob += other[:, None]
    prob += FLOOR
    whole = len(prob) // FACTORS
    factors = prob[:whole * FACTORS].reshape(FACTORS, whole, prob.shape[1]).prod(axis=0)
    return np.log(factors).sum(axis=0) + np.log(prob[whole * FACTORS:]).sum(axis=0)
