"""Baselines, stored runs and any other model's metrics side by side."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysift.operators import baselines, comparison, records, reports


def fit_baseline_metrics(
    train: DataFrame, test: DataFrame, features: list[str], label: str = "label", seed: int = 0
) -> DataFrame:
    """Metrics of the two classical baselines on the test rows, one run each."""
    linear, kernel = baselines.NAMES
    scored = [
        (linear, baselines.logistic_predictions(
            baselines.fit_logistic(train, features, label), test, features, (label,))),
        (kernel, baselines.kernel_predictions(
            baselines.fit_kernel(train, features, label, seed=seed), test, features, (label,))),
    ]
    tagged = [df.withColumns({"model": F.lit(name), "run": F.lit(1)}) for name, df in scored]
    return reports.fit_binary_metrics(tagged[0].unionByName(tagged[1]), label=label, score="prob")


def compare_models(run_records: DataFrame, *others: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Aggregate and per-run tables over other models' metrics and the stored runs."""
    return comparison.build_comparison(*others, records.record_metrics(run_records, model))
