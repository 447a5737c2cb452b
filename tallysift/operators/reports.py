"""Accuracy, per-class reports and macro metrics, all read off the four confusion counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysift.operators.roc import NAN, RUN, fit_ranked_scores, roc_auc
from tallysift.sources.schemas import AVERAGE_KEYS, CLASS_KEYS, METRIC_ORDER

CELLS = ("tn", "fp", "fn", "tp")


def confusion(
    predictions: DataFrame, keys: tuple[str, ...] = RUN, label: str = "label", predicted: str = "predicted"
) -> DataFrame:
    """The four counts per key group, zeros kept; one map-side aggregate over the rows."""
    y, yhat = F.col(label) == 1, F.col(predicted) == 1
    return predictions.groupBy(*keys).agg(
        F.count_if(~y & ~yhat).alias("tn"), F.count_if(~y & yhat).alias("fp"),
        F.count_if(y & ~yhat).alias("fn"), F.count_if(y & yhat).alias("tp"),
    )


def accuracy(counts: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """Share of correct predictions."""
    return counts.select(*keys, _accuracy().alias("accuracy"))


def class_report(counts: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """Precision, recall, F1 and support of both classes; a zero denominator gives 0."""
    return _lines(counts, keys, list(zip(CLASS_KEYS, _class_lines())))


def report_averages(counts: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """Plain and support-weighted mean of the two class lines."""
    return _lines(counts, keys, list(zip(AVERAGE_KEYS, _average_lines())))


def full_report(counts: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """Class lines and averages together."""
    return _lines(counts, keys, list(zip(CLASS_KEYS + AVERAGE_KEYS, _class_lines() + _average_lines())))


def nested_report() -> Column:
    """The report as one nested struct built from the four counts of a row."""
    names = ("precision", "recall", "f1-score", "support")
    lines = zip(CLASS_KEYS + AVERAGE_KEYS, _class_lines() + _average_lines())
    return F.struct(
        *[F.struct(*[v.alias(n) for n, v in zip(names, line)]).alias(key) for key, line in lines],
        _accuracy().alias("accuracy"),
    )


def evaluation_record(counts: DataFrame, keys: tuple[str, ...] = RUN,
                      source: str = "youden_calibrated") -> DataFrame:
    """Accuracy, macro F1, AUC, threshold, its source and the nested report per key group.

    Takes the output of ``calibrated`` or ``at_threshold``. Row-level labels and predictions stay
    a table (``apply_threshold``): gathering them into one row per run would not scale.
    """
    return counts.select(
        *keys, _accuracy().alias("accuracy"), _macro(2).alias("macro_f1"), "roc_auc",
        F.col("threshold").alias("threshold_used"), F.lit(source).alias("threshold_source"),
        nested_report().alias("report"),
    )


def fit_binary_metrics(
    predictions: DataFrame, keys: tuple[str, ...] = ("model", "run"), label: str = "label",
    predicted: str = "predicted", score: str | None = None,
) -> DataFrame:
    """Accuracy, macro precision, recall, F1 and AUC per key group; AUC is NaN without a score.

    Macro means run over the classes that occur among labels or predictions.
    """
    counts = confusion(predictions, keys, label, predicted)
    if score is None:
        scored = counts.withColumn("roc_auc", F.lit(NAN))
    else:
        area = roc_auc(fit_ranked_scores(predictions, keys, label, score), keys)
        scored = counts.join(area, list(keys))
    return macro_metrics(scored, keys)


def macro_metrics(counts: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """The five metrics in wide form from confusion counts and a ``roc_auc`` column."""
    values = [_accuracy(), _macro(0), _macro(1), _macro(2), F.col("roc_auc")]
    return counts.select(*keys, *[v.alias(m) for v, m in zip(values, METRIC_ORDER)])


def confusion_cells(counts: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """One row per cell (true, predicted), zero cells included."""
    cells = [
        F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("predicted_label"), F.col(c).alias("n"))
        for c, (t, p) in zip(CELLS, [(0, 0), (0, 1), (1, 0), (1, 1)])
    ]
    return counts.select(*keys, F.inline(F.array(*cells)))


def confusion_summary(counts: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """Mean and population deviation of each cell over key groups."""
    return confusion_cells(counts, keys).groupBy("true_label", "predicted_label").agg(
        F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.count(F.lit(1)).alias("runs"))


def _accuracy() -> Column:
    return _ratio(F.col("tp") + F.col("tn"), _total())


def _total() -> Column:
    return F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")


def _class_lines() -> list[tuple[Column, ...]]:
    """(precision, recall, F1, support) of class 0 and of class 1."""
    def line(hit, false_alarm, missed):
        return (
            _ratio(hit, hit + false_alarm), _ratio(hit, hit + missed),
            _ratio(2 * hit, 2 * hit + false_alarm + missed), (hit + missed).cast("double"),
        )
    tn, fp, fn, tp = (F.col(c) for c in CELLS)
    return [line(tn, fn, fp), line(tp, fp, fn)]


def _average_lines() -> list[tuple[Column, ...]]:
    zero, one = _class_lines()
    total = zero[3] + one[3]
    plain = tuple((a + b) / 2 for a, b in zip(zero[:3], one[:3]))
    weighted = tuple(_ratio(a * zero[3] + b * one[3], total) for a, b in zip(zero[:3], one[:3]))
    return [(*plain, total), (*weighted, total)]


def _macro(which: int) -> Column:
    zero, one = (line[which] for line in _class_lines())
    has_zero = (F.col("tn") + F.col("fp") + F.col("fn") > 0).cast("int")
    has_one = (F.col("tp") + F.col("fp") + F.col("fn") > 0).cast("int")
    return _ratio(zero * has_zero + one * has_one, has_zero + has_one)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _lines(counts, keys, named_lines) -> DataFrame:
    rows = [
        F.struct(F.lit(key).alias("key"),
                 *[v.alias(n) for v, n in zip(line, ("precision", "recall", "f1", "support"))])
        for key, line in named_lines
    ]
    return counts.select(*keys, F.inline(F.array(*rows)))
