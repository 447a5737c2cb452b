"""Measurement histograms: merging, P(1) per sample, losses."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysift.functions.readout import is_hit, log_likelihood

SAMPLE = ("run", "sample_id")


def explode_counts(histograms: DataFrame, counts: str = "counts") -> DataFrame:
    """Histograms held as one map per row become one row per bitstring."""
    rest = [c for c in histograms.columns if c != counts]
    return histograms.select(*rest, F.explode(counts).alias("bitstring", "cnt"))


def merge_counts(counts: DataFrame, keys: tuple[str, ...] = SAMPLE) -> DataFrame:
    """Sum the counts of equal bitstrings of one sample."""
    return counts.groupBy(*keys, "bitstring").agg(F.sum("cnt").alias("cnt"))


def measured_probs(
    counts: DataFrame, readout: str = "single_qubit", keys: tuple[str, ...] = SAMPLE
) -> DataFrame:
    """P(1) of each sample that has a histogram; 0.0 when its shots sum to nothing.

    Works on unmerged counts: summing hits and shots already merges them.
    """
    sums = counts.groupBy(*keys).agg(
        F.sum(F.when(is_hit(F.col("bitstring"), readout), F.col("cnt")).otherwise(0)).alias("hits"),
        F.sum("cnt").alias("shots"),
    )
    share = F.when(F.col("shots") > 0, F.try_divide(F.col("hits"), F.col("shots")))
    return sums.select(*keys, F.coalesce(share, F.lit(0.0)).alias("prob"))


def per_run(labels: DataFrame, runs: int, first: int = 1) -> DataFrame:
    """Repeat a label table for consecutively numbered runs measured on the same samples."""
    numbers = F.sequence(F.lit(first), F.lit(first + runs - 1))
    return labels.withColumn("run", F.explode(numbers))


def label_probs(
    counts: DataFrame, samples: DataFrame, readout: str = "single_qubit", keys: tuple[str, ...] = SAMPLE
) -> DataFrame:
    """P(1) next to the label for every listed sample; 0.0 for samples without a histogram."""
    probs = measured_probs(counts, readout, keys)
    return samples.join(probs, list(keys), "left").withColumn(
        "prob", F.coalesce("prob", F.lit(0.0)))


def cross_entropy(scored: DataFrame, keys: tuple[str, ...] = ("run",), label: str = "label") -> DataFrame:
    """Mean cross-entropy of labelled probabilities."""
    return scored.groupBy(*keys).agg(
        F.avg(-log_likelihood(F.col(label), F.col("prob"))).alias("loss"),
        F.count(F.lit(1)).alias("samples"),
    )


def batch_log_likelihood(
    counts: DataFrame, labels: DataFrame, size: int, readout: str = "single_qubit"
) -> DataFrame:
    """Log-likelihood of histograms numbered by ``pos`` in a stream of batches.

    Batches walk through the ``size`` labels again and again: position p belongs to label
    number p modulo ``size`` (column ``idx`` of ``labels``). A label that the table lacks is an error.
    """
    probs = measured_probs(counts, readout, ("pos",)).withColumn("idx", F.pmod("pos", F.lit(size)))
    found = probs.join(labels.select("idx", "label"), "idx", "left").withColumn("label", F.coalesce(
        "label", F.raise_error(F.concat(F.lit("no label number "), F.col("idx").cast("string"))).cast("int")))
    return found.select("pos", "idx", "prob", log_likelihood(F.col("label"), F.col("prob")).alias("loglik"))
