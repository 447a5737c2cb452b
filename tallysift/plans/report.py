"""Post-processing of finished experiments as tables."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallysift.operators import curves, records, reports, roc
from tallysift.sources import results
from tallysift.sources.schemas import HISTORY_FILE, PREDICTIONS_FILE


@dataclass(frozen=True)
class ExperimentTables:
    """The tables behind the figures of one experiment."""

    learning_curves: DataFrame
    final_loss: DataFrame
    confusion: DataFrame
    run_auc: DataFrame
    mean_roc: DataFrame
    pooled_auc: DataFrame


def summarise_experiments(spark: SparkSession, root: str, layout: str = "array") -> DataFrame:
    """Cross-run report statistics of every experiment at or below ``root``."""
    found = results.discover_experiments(spark, root, layout)
    return records.summarise_reports(found, by=("experiment",))


def experiment_tables(history: DataFrame, predictions: DataFrame) -> ExperimentTables:
    """Curves, losses, confusion and ROC tables from history and prediction rows."""
    keys = ("Run",)
    counts = reports.confusion(predictions, keys, "True_Label", "Predicted_Label")
    ranked = roc.fit_ranked_scores(predictions, keys, "True_Label", "Prob_1")
    return ExperimentTables(
        curves.learning_curve(history, ["fitness", "mean_best"]),
        curves.final_loss_distribution(history),
        reports.confusion_summary(counts, keys),
        roc.roc_auc(ranked, keys),
        roc.mean_roc(ranked, keys),
        roc.fit_pooled_auc(predictions, "True_Label", "Prob_1"),
    )


def read_experiment(spark: SparkSession, folder: str) -> ExperimentTables:
    """The same from a folder holding the merged history and prediction files."""
    from tallysift.sources.schemas import HISTORY, PREDICTIONS

    read = lambda name, schema: spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}")
    return experiment_tables(read(HISTORY_FILE, HISTORY), read(PREDICTIONS_FILE, PREDICTIONS))


def merge_tasks(spark: SparkSession, experiment_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """History, predictions and run records of all tasks of one experiment, merged."""
    return (
        curves.merge_history(results.scan_history(spark, experiment_dir).drop("task")),
        curves.merge_predictions(results.scan_predictions(spark, experiment_dir).drop("task")),
        results.scan_run_records(spark, experiment_dir),
    )
