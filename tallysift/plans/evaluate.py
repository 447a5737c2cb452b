"""From measurement counts to evaluation records, one per run."""

from pyspark.sql import DataFrame

from tallysift.operators import counts as C
from tallysift.operators import reports, roc


def evaluate_counts(
    counts: DataFrame, samples: DataFrame, readout: str = "single_qubit",
    thresholds: DataFrame | float | None = None,
) -> DataFrame:
    """Evaluation record of every run in ``samples`` (run, sample_id, label).

    Without ``thresholds`` each run calibrates its own (training data); with a table
    (run, threshold), or one number for all runs, the given ones are applied without refitting
    (held-out data).
    """
    return evaluate_predictions(C.label_probs(counts, samples, readout), thresholds)


def evaluate_predictions(predictions: DataFrame, thresholds: DataFrame | float | None = None) -> DataFrame:
    """The same from labelled probabilities (run, label, prob)."""
    ranked = roc.fit_ranked_scores(predictions)
    if thresholds is None:
        return reports.evaluation_record(roc.calibrated(ranked))
    return reports.evaluation_record(roc.at_threshold(ranked, thresholds), source="pre_calibrated")


def calibrate_and_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Calibrate on training predictions, evaluate held-out predictions at those thresholds."""
    return evaluate_predictions(test, roc.youden_threshold(roc.fit_ranked_scores(train)))


def predicted_labels(predictions: DataFrame, thresholds: DataFrame, source: str = "youden_calibrated") -> DataFrame:
    """Row-level predictions (the label, probability and predicted label of every sample)."""
    return roc.apply_threshold(predictions, thresholds, source=source)
