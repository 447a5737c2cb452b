"""ROC points, calibrated thresholds, AUC and mean ROC curves, per key group.

Everything here starts from one aggregation by distinct score, so raw prediction rows are
shuffled once, already collapsed. Score groups carry how many positives and negatives share a
score; decisions between points compare exact integers.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysift.operators.running import fit_cuts, running_totals

RUN = ("run",)
NAN = float("nan")
NO_CALIBRATION = 0.5  # fixed value: threshold when only one class is present
GRID_POINTS = 200  # fixed value: points of the mean ROC curve


def score_groups(
    predictions: DataFrame, keys: tuple[str, ...] = RUN, label: str = "label", score: str = "prob"
) -> DataFrame:
    """Positives and negatives per distinct score."""
    positive = F.col(label) == 1
    return predictions.groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def fit_ranked_scores(
    predictions: DataFrame, keys: tuple[str, ...] = RUN, label: str = "label", score: str = "prob",
    **cut_args,
) -> DataFrame:
    """Score groups with the counts at or above each score (``tp``, ``fp``) and the class totals.

    The collapsed groups are persisted and counted; cut points, range sums and every result derived
    from this table read them without another pass over the predictions.
    """
    groups = score_groups(predictions, keys, label, score).persist()
    cuts = fit_cuts(groups, "threshold", **cut_args)
    ranked = running_totals(groups, keys, "threshold", ("pos", "neg"), cuts)
    return ranked.select(
        *keys, "threshold", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        F.col("all_pos").alias("positives"), F.col("all_neg").alias("negatives"),
    )


def roc_points(ranked: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """One point per distinct score, led by (infinity, 0, 0); rates are NaN for an absent class."""
    zero = F.lit(0).cast("long")
    here = F.struct("threshold", "tp", "fp")
    lead = F.struct(F.lit(float("inf")).alias("threshold"), zero.alias("tp"), zero.alias("fp"))
    is_first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    points = ranked.select(
        *keys, "positives", "negatives",
        F.inline(F.when(is_first, F.array(lead, here)).otherwise(F.array(here))),
    )
    return points.select(
        *keys, "threshold", "tp", "fp",
        _rate("tp", "positives").alias("tpr"), _rate("fp", "negatives").alias("fpr"),
    )


def calibrated(ranked: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """Per key group: Youden threshold, the confusion counts it gives, and the AUC.

    The threshold maximises TPR - FPR, ties go to the highest one. Starting from "nothing is
    positive" (infinity), which wins when no score does better; 0.5 if a class is absent. The
    gain is compared as tp * negatives - fp * positives in exact decimals.
    """
    wide = "decimal(18,0)"
    gain = (F.col("tp").cast(wide) * F.col("negatives").cast(wide)
            - F.col("fp").cast(wide) * F.col("positives").cast(wide))
    above_default = F.col("threshold") >= NO_CALIBRATION
    best = ranked.groupBy(*keys).agg(
        F.max("positives").alias("positives"), F.max("negatives").alias("negatives"),
        F.max(F.struct(gain.alias("gain"), "threshold", "tp", "fp")).alias("best"),
        F.sum(F.when(above_default, F.col("pos")).otherwise(0)).alias("tp_default"),
        F.sum(F.when(above_default, F.col("neg")).otherwise(0)).alias("fp_default"),
        _pair_wins().alias("wins"),
    )
    one_class = (F.col("positives") == 0) | (F.col("negatives") == 0)
    none_better = F.col("best.gain") <= 0
    pick = lambda default, start, found: (
        F.when(one_class, default).when(none_better, start).otherwise(found))
    return best.select(
        *keys,
        pick(F.lit(NO_CALIBRATION), F.lit(float("inf")), F.col("best.threshold")).alias("threshold"),
        pick(F.col("tp_default"), F.lit(0), F.col("best.tp")).alias("tp"),
        pick(F.col("fp_default"), F.lit(0), F.col("best.fp")).alias("fp"),
        "positives", "negatives", _auc().alias("roc_auc"),
    ).select(*keys, "threshold", *_confusion_from_totals(), "roc_auc")


def at_threshold(ranked: DataFrame, thresholds: DataFrame | float, keys: tuple[str, ...] = RUN) -> DataFrame:
    """Confusion counts and AUC when each key group uses a threshold fitted elsewhere.

    ``thresholds`` has one row per key group, or is one number for all; a group without one is an
    error.
    """
    above = F.col("threshold") >= F.col("fixed")
    return _with_threshold(ranked, thresholds, keys, "fixed").groupBy(*keys).agg(
        F.max("fixed").alias("threshold"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.max("positives").alias("positives"), F.max("negatives").alias("negatives"),
        _pair_wins().alias("wins"),
    ).select(*keys, "threshold", *_confusion_from_totals(), _auc().alias("roc_auc"))


def youden_threshold(ranked: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """The calibrated threshold of each key group."""
    return calibrated(ranked, keys).select(*keys, "threshold")


def roc_auc(ranked: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """Area under the ROC curve, ties at half weight; NaN when a class is absent."""
    return ranked.groupBy(*keys).agg(
        F.max("positives").alias("positives"), F.max("negatives").alias("negatives"),
        _pair_wins().alias("wins"),
    ).select(*keys, _auc().alias("roc_auc"))


def fit_pooled_auc(predictions: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """One AUC over the predictions of all runs together."""
    return roc_auc(fit_ranked_scores(predictions, (), label, score), ()).withColumnRenamed(
        "roc_auc", "pooled_auc")


def apply_threshold(
    predictions: DataFrame, thresholds: DataFrame | float, keys: tuple[str, ...] = RUN, score: str = "prob",
    source: str = "youden_calibrated",
) -> DataFrame:
    """Predicted label per row (score >= threshold) and where the threshold came from.

    A row whose key group has no threshold is an error.
    """
    return _with_threshold(predictions, thresholds, keys, "threshold").withColumns({
        "predicted": (F.col(score) >= F.col("threshold")).cast("int"),
        "threshold_source": F.lit(source),
    })


def interpolated_roc(ranked: DataFrame, keys: tuple[str, ...] = RUN, points: int = GRID_POINTS) -> DataFrame:
    """True-positive rate of each key group at evenly spaced false-positive rates.

    A score group is a segment of its curve, from its predecessor's counts to its own, and
    lists the grid points it covers itself: no join with the grid, exactly ``points`` rows per
    key group. A grid point on a vertical step takes the step's upper end.
    """
    last = points - 1
    start_fp, start_tp = F.col("fp") - F.col("neg"), F.col("tp") - F.col("pos")
    n, p = F.col("negatives"), F.col("positives")
    at_or_after = lambda count: F.expr(f"(({count}) * {last} + negatives - 1) div negatives")
    is_last = (F.col("tp") == p) & (F.col("fp") == n)
    segments = ranked.filter((n > 0) & (p > 0)).withColumns({
        "from_g": at_or_after("fp - neg"),
        "to_g": F.when(is_last, F.lit(last).cast("long")).otherwise(at_or_after("fp") - 1),
    }).filter("from_g <= to_g")
    g = F.col("g")
    share = F.try_divide(g * n - last * start_fp, F.lit(float(last)) * F.col("neg"))
    height = F.when(g == last, p.cast("double")).otherwise(start_tp + F.col("pos") * share)
    return segments.withColumn("g", F.explode(F.sequence("from_g", "to_g"))).select(
        *keys, F.col("g").cast("int").alias("g"), (g / float(last)).alias("fpr"), (height / p).alias("tpr"))


def mean_roc(ranked: DataFrame, keys: tuple[str, ...] = RUN, points: int = GRID_POINTS) -> DataFrame:
    """Mean and population deviation of the curves over key groups, per grid point."""
    return interpolated_roc(ranked, keys, points).groupBy("g", "fpr").agg(
        F.avg("tpr").alias("mean_tpr"), F.stddev_pop("tpr").alias("std_tpr"),
        F.count(F.lit(1)).alias("curves"),
    )


def _with_threshold(df: DataFrame, thresholds: DataFrame | float, keys: tuple[str, ...], name: str) -> DataFrame:
    if not isinstance(thresholds, DataFrame):
        return df.withColumn(name, F.lit(float(thresholds)))
    fixed = thresholds.select(*keys, F.col("threshold").cast("double").alias(name))
    who = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("all rows")
    missing = F.raise_error(F.concat(F.lit("no threshold for "), who)).cast("double")
    return df.join(fixed, list(keys), "left").withColumn(name, F.coalesce(name, missing))


def _rate(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(NAN))


def _pair_wins() -> Column:
    """Twice the number of (positive, negative) pairs ranked right, ties counted once."""
    wide = "decimal(18,0)"
    below = (2 * (F.col("negatives") - F.col("fp")) + F.col("neg")).cast(wide)
    return F.sum((F.col("pos").cast(wide) * below).cast("decimal(38,0)"))


def _auc() -> Column:
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return F.when(pairs == 0, F.lit(NAN)).otherwise(
        F.try_divide(F.col("wins").cast("double"), 2 * pairs))


def _confusion_from_totals() -> list[Column]:
    return [
        (F.col("negatives") - F.col("fp")).alias("tn"), F.col("fp"),
        (F.col("positives") - F.col("tp")).alias("fn"), F.col("tp"),
    ]
