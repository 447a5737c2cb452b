"""Training history: long form, learning curves, loss distribution, summaries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINAL_LOSS = "final_loss"  # fixed value: metric name of the closing row
VALIDATION_PREFIX = "val_"  # fixed value: marks validation metrics in a history map


def merge_history(histories: DataFrame) -> DataFrame:
    """Task histories in run and epoch order."""
    return histories.orderBy("Run", "Epoch")


def merge_predictions(predictions: DataFrame) -> DataFrame:
    """Task predictions in run order; the other columns follow, so that a large run can be split between ranges."""
    return predictions.orderBy("Run", *[c for c in predictions.columns if c != "Run"])


def history_rows(histories: DataFrame, metrics: list[str]) -> DataFrame:
    """Unfold a map metric -> values per run index into rows, training and validation marked.

    Runs and epochs count from 1; metrics not asked for are left out.
    """
    name = F.col("name")
    validation = name.startswith(VALIDATION_PREFIX)
    base = F.when(validation, F.expr(f"substring(name, {len(VALIDATION_PREFIX) + 1})")).otherwise(name)
    entries = histories.select("run_idx", F.explode("history").alias("name", "values"))
    return (
        entries.select("run_idx", base.alias("Metric"), validation.alias("validation"), "values")
        .filter(F.col("Metric").isin(metrics))
        .select("*", F.posexplode("values").alias("at", "Value"))
        .select(
            (F.col("run_idx") + 1).cast("int").alias("Run"), (F.col("at") + 1).alias("Epoch"), "Metric",
            F.col("Value").cast("double").alias("Value"),
            F.when(F.col("validation"), "validation").otherwise("training").alias("part"),
        )
    )


def learning_curve(history: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric by epoch; 0 where a single run is left."""
    return history.filter(F.col("Metric").isin(metrics)).groupBy("Metric", "Epoch").agg(
        F.avg("Value").alias("mean"), F.coalesce(F.stddev_samp("Value"), F.lit(0.0)).alias("std"))


def largest_run(history: DataFrame, metrics: list[str]) -> DataFrame:
    """The highest run number of each metric."""
    return history.filter(F.col("Metric").isin(metrics)).groupBy("Metric").agg(F.max("Run").alias("runs"))


def final_losses(history: DataFrame) -> DataFrame:
    """The closing loss of each run."""
    return history.filter(F.col("Metric") == FINAL_LOSS).select("Run", F.col("Value").alias("loss"))


def final_loss_distribution(history: DataFrame) -> DataFrame:
    """Quartiles and whiskers (extreme values within 1.5 interquartile ranges) of the closing losses."""
    losses = final_losses(history)
    cuts = losses.agg(F.percentile("loss", [0.25, 0.5, 0.75]).alias("q")).scalar()
    marked = losses.withColumn("q", cuts).select(
        "loss", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.when(F.col("loss").between(F.col("q1") - reach, F.col("q3") + reach), F.col("loss"))
    boxes = marked.groupBy("q1", "median", "q3").agg(
        F.min(inside).alias("low"), F.max(inside).alias("high"), F.count("loss").alias("points"))
    return boxes.select(
        "q1", "median", "q3", F.least("low", "q1").alias("whisker_low"),
        F.greatest("high", "q3").alias("whisker_high"), "points")


def training_summary(history: DataFrame, metric: str = "fitness") -> DataFrame:
    """First value, last value, change and number of generations per run."""
    return history.filter(F.col("Metric") == metric).groupBy("Run").agg(
        F.min_by("Value", "Epoch").alias("first"), F.max_by("Value", "Epoch").alias("last"),
        F.count(F.lit(1)).alias("generations"),
    ).withColumn("change", F.col("last") - F.col("first"))


def final_loss_rows(history: DataFrame, losses: DataFrame) -> DataFrame:
    """The closing rows: each run's loss one epoch after its last generation."""
    ends = history.filter(F.col("Metric") != FINAL_LOSS).groupBy("Run").agg(
        (F.max("Epoch") + 1).alias("Epoch"))
    return ends.join(losses, "Run").select(
        "Run", "Epoch", F.lit(FINAL_LOSS).alias("Metric"), F.col("loss").alias("Value"))


def with_final_loss(history: DataFrame, losses: DataFrame) -> DataFrame:
    """History followed by its closing rows."""
    return history.unionByName(final_loss_rows(history, losses))
