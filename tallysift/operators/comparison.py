"""Comparison of models over runs: aggregate, per-run and matrix forms."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysift.operators.roc import NAN
from tallysift.sources.schemas import METRIC_ORDER


def aggregate_metrics(metrics: DataFrame) -> DataFrame:
    """Mean and population deviation per model and metric over runs, NaN left out.

    Every model gets all five metrics in their fixed order; without values the mean is NaN and
    the deviation 0.
    """
    stats = metrics.groupBy(F.col("model").alias("Model")).agg(*[
        a for i, m in enumerate(METRIC_ORDER) for a in (
            F.avg(_valid(m)).alias(f"m{i}"), F.stddev_pop(_valid(m)).alias(f"s{i}"))
    ])
    lines = [
        F.struct(F.lit(m).alias("Metric"), F.coalesce(f"m{i}", F.lit(NAN)).alias("Mean"),
                 F.coalesce(f"s{i}", F.lit(0.0)).alias("Std"))
        for i, m in enumerate(METRIC_ORDER)
    ]
    return stats.select("Model", F.inline(F.array(*lines)))


def metric_rows(metrics: DataFrame) -> DataFrame:
    """One row per model, run and metric, without NaN."""
    long = metrics.unpivot(["model", "run"], list(METRIC_ORDER), "Metric", "Value")
    return long.filter(~F.isnan("Value")).select(
        F.col("model").alias("Model"), F.col("run").alias("Run"), "Metric", "Value")


def build_comparison(*tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stack the metric tables of any number of models: (aggregate table, per-run table)."""
    stacked = reduce(lambda a, b: a.unionByName(b), tables)
    return aggregate_metrics(stacked), metric_rows(stacked)


def comparison_matrix(aggregate: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Models as rows, metrics as columns; ``models`` fixes the row order."""
    matrix = aggregate.groupBy("Model").pivot("Metric", list(METRIC_ORDER)).agg(F.first("Mean"))
    if models is None:
        return matrix
    return matrix.filter(F.col("Model").isin(models)).orderBy(F.array_position(F.lit(models), F.col("Model")))


def repeated_points(per_run: DataFrame) -> DataFrame:
    """The per-run values of those model and metric pairs that have more than one."""
    several = per_run.groupBy("Model", "Metric").agg(F.count(F.lit(1)).alias("points")).filter("points > 1")
    return per_run.join(several, ["Model", "Metric"])


def _valid(metric: str) -> Column:
    return F.when(~F.isnan(metric), F.col(metric))
