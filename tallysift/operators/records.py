"""Run records: nested reports to tables and back, cross-run summaries, saved states."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysift.operators.roc import NAN
from tallysift.sources.schemas import AVERAGE_KEYS, CLASS_KEYS, METRIC_ORDER, REPORT_METRICS

MAX_LIST_ROWS = 1_000_000


def with_report(records: DataFrame) -> DataFrame:
    """Settle on one ``report`` column: ``report_dict`` where present, else ``report``."""
    if "report_dict" not in records.columns:
        return records
    return records.withColumn("report", F.coalesce("report_dict", "report")).drop("report_dict")


def report_lines(records: DataFrame, keys: tuple[str, ...] = ("Run",)) -> DataFrame:
    """Nested reports as rows (keys, key, metric, value); records without a report give none."""
    rows = [
        _line(key, metric, F.col("report")[key][metric])
        for key in CLASS_KEYS + AVERAGE_KEYS for metric in REPORT_METRICS
    ]
    rows.append(_line("accuracy", "accuracy", F.col("report")["accuracy"]))
    return with_report(records).select(*keys, F.inline(F.array(*rows))).filter(F.col("value").isNotNull())


def summarise_reports(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation of every report value over runs, per ``by`` group."""
    return report_lines(records, by).groupBy(*by, "key", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def record_metrics(records: DataFrame, model: str | Column) -> DataFrame:
    """The five comparison metrics of each run record; what is missing becomes NaN."""
    macro = F.col("report")["macro avg"]
    values = [
        F.col("accuracy"), macro["precision"], macro["recall"],
        F.coalesce("macro_f1", macro["f1-score"]), F.col("roc_auc"),
    ]
    name = F.lit(model) if isinstance(model, str) else model
    return records.select(
        name.alias("model"), F.col("Run").alias("run"),
        *[F.coalesce(v, F.lit(NAN)).alias(m) for v, m in zip(values, METRIC_ORDER)],
    )


def rounded(records: DataFrame, threshold: str = "threshold_youden") -> DataFrame:
    """Round the record's metrics to 4 places; an undefined AUC is stored as null."""
    out = {c: F.round(c, 4) for c in ("accuracy", "macro_f1", threshold)}
    out["roc_auc"] = F.when(~F.isnan("roc_auc"), F.round("roc_auc", 4))
    return records.withColumns(out)


def to_run_records(
    evaluations: DataFrame, *, label: str, n_features: int, epochs: int, infrastructure: str, backend: str
) -> DataFrame:
    """Stored run records from ``evaluation_record`` rows keyed by ``run``."""
    support = F.col("report")[AVERAGE_KEYS[0]]["support"]
    return rounded(evaluations.select(
        F.col("run").alias("Run"), F.lit(label).alias("label"), F.lit(n_features).alias("n_features"),
        support.cast("int").alias("n_test"), "accuracy", "macro_f1", "roc_auc",
        F.col("threshold_used").alias("threshold_youden"), F.lit(epochs).alias("epochs_ran"),
        F.lit(infrastructure).alias("train_infrastructure"), F.lit(backend).alias("eval_backend"), "report",
    ))


def attach_lists(records: DataFrame, predictions: DataFrame, max_rows: int = MAX_LIST_ROWS) -> DataFrame:
    """Add ``y_true`` and ``y_prob`` arrays per run, ordered by sample, as stored records hold them.

    Only for runs small enough to be one record: a run above ``max_rows`` samples is refused
    before anything is gathered; its predictions table already holds the same values.
    """
    largest = predictions.groupBy("run").count().agg(F.max("count")).first()[0] or 0
    if largest > max_rows:
        raise ValueError(f"a run has {largest} predictions, too many for one record; keep the table")
    packed = predictions.groupBy(F.col("run").alias("Run")).agg(
        F.sort_array(F.collect_list(F.struct("sample_id", "label", "prob"))).alias("rows"))
    return records.join(packed.select("Run", F.col("rows.label").alias("y_true"),
                                      F.col("rows.prob").alias("y_prob")), "Run")


def latest_state(states: DataFrame) -> DataFrame:
    """The last saved parameters of each run in an append-only state table."""
    return states.groupBy("Run").agg(
        F.max("Epoch").alias("Epoch"), F.max_by("params", "Epoch").alias("params"))


def _line(key: str, metric: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.lit(metric).alias("metric"), value.alias("value"))
