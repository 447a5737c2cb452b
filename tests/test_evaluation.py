"""Thresholds, curves and reports on cases worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallysift.functions.readout import is_hit, prob_from_map
from tallysift.operators import counts, reports, roc
from tallysift.operators.running import fit_cuts, running_totals
from tallysift.plans import evaluate


def scored(spark, *runs):
    rows = [(r, i, y, float(p)) for r, pairs in enumerate(runs, 1) for i, (y, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "run int, sample_id long, label int, prob double")


def calibrated(spark, *runs):
    return {r["run"]: r for r in roc.calibrated(roc.fit_ranked_scores(scored(spark, *runs))).collect()}


def test_one_class_keeps_the_default_threshold(spark):
    got = calibrated(spark, [(1, .2), (1, .6), (1, .9)], [(0, .2), (0, .6)])
    assert got[1]["threshold"] == 0.5 and got[2]["threshold"] == 0.5
    assert (got[1]["tp"], got[1]["fn"], got[2]["fp"], got[2]["tn"]) == (2, 1, 1, 1)
    assert math.isnan(got[1]["roc_auc"]) and math.isnan(got[2]["roc_auc"])


def test_anticorrelated_scores_predict_nothing(spark):
    got = calibrated(spark, [(1, .1), (0, .9)])[1]
    assert got["threshold"] == math.inf and got["tp"] == got["fp"] == 0 and got["roc_auc"] == 0


def test_all_tied_scores(spark):
    got = calibrated(spark, [(0, .5), (1, .5), (0, .5), (1, .5)])[1]
    assert got["roc_auc"] == 0.5 and got["threshold"] == math.inf


def test_equal_gains_take_the_highest_threshold(spark):
    assert calibrated(spark, [(1, .9), (0, .8), (1, .7), (0, .1)])[1]["threshold"] == 0.9


def test_separable_data_is_perfect(spark):
    rows = spark.range(100).select(
        F.lit(1).alias("run"), F.col("id").alias("sample_id"), (1 - F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 2 == 0, 3.14).otherwise(0.0).alias("prob"))
    record = evaluate.evaluate_predictions(rows).first()
    assert record["accuracy"] == record["roc_auc"] == record["macro_f1"] == 1.0


def test_auc_of_mirrored_scores(spark, near):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(500)]
    got = calibrated(spark, pairs, [(y, round(1 - p, 2)) for y, p in pairs])
    assert got[1]["roc_auc"] == near(1 - got[2]["roc_auc"])


@pytest.mark.parametrize("keys", [("run",), ()])
def test_running_totals_do_not_depend_on_buckets(spark, keys):
    rng = random.Random(5)
    # one run holds most rows, and scores crowd in a narrow range
    rows = {(1 if rng.random() < .9 else rng.randint(2, 5), .5 + rng.random() ** 9 / 1e6) for _ in range(4000)}
    rows = list({p: r for r, p in rows}.items())
    groups = spark.createDataFrame([(r, p, rng.randint(0, 9)) for p, r in rows], "run int, s double, v long")
    got = [
        sorted(map(tuple, running_totals(
            groups.repartition(n), keys, "s", ("v",), fit_cuts(groups, "s", size)).collect()))
        for n, size in ((1, 64), (7, 15), (3, 2000))
    ] + [sorted(map(tuple, running_totals(groups, keys, "s", ("v",), []).collect()))]
    assert got[0] == got[1] == got[2] == got[3]
    expected, total = {}, {}
    for r, s, v in sorted(groups.collect(), key=lambda x: -x[1]):
        k = r if keys else 0
        total[k] = total.get(k, 0) + v
        expected[r, s] = total[k]
    assert all(row[3] == expected[row[0], row[1]] and row[4] == total[row[0] if keys else 0] for row in got[0])


def test_many_scores_of_one_run_take_the_cut_path(spark):
    rows = spark.range(5000).select(
        F.lit(1).alias("run"), (F.hash("id") % 2 == 0).cast("int").alias("label"),
        (F.pmod(F.hash("id"), F.lit(4000)) / 4000).alias("prob"))
    plain = roc.fit_ranked_scores(rows)
    parted = roc.fit_ranked_scores(rows, rows_per_range=150)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, parted.collect()))
    assert roc.calibrated(plain).first() == roc.calibrated(parted).first()
    assert roc.mean_roc(parted).count() == 200


def test_roc_starts_at_infinity_and_ends_at_one(spark):
    points = roc.roc_points(roc.fit_ranked_scores(scored(spark, [(1, .9), (0, .4), (1, .4), (0, .1)]))).orderBy(
        F.desc("threshold")).collect()
    assert [(p["threshold"], p["tp"], p["fp"]) for p in points] == [
        (math.inf, 0, 0), (.9, 1, 0), (.4, 2, 1), (.1, 2, 2)]


def test_mean_roc_equals_interpolation(spark, near):
    import numpy as np
    rng = np.random.default_rng(0)
    pairs = [(int(rng.integers(2)), float(round(rng.random(), 1))) for _ in range(300)]
    ranked = roc.fit_ranked_scores(scored(spark, pairs))
    points = roc.roc_points(ranked).orderBy(F.desc("threshold")).collect()
    want = np.interp(np.linspace(0, 1, 200), [p["fpr"] for p in points], [p["tpr"] for p in points])
    got = roc.mean_roc(ranked).orderBy("g").collect()
    assert [r["mean_tpr"] for r in got] == pytest.approx(list(want), abs=1e-9)
    assert all(r["std_tpr"] == 0 for r in got)


def test_curves_of_one_class_are_left_out(spark):
    assert roc.mean_roc(roc.fit_ranked_scores(scored(spark, [(1, .3), (1, .4)]))).count() == 0


def test_report_of_an_absent_prediction(spark, near):
    rows = spark.createDataFrame([(1, y, 0) for y in (0, 0, 0, 1)], "run int, label int, predicted int")
    lines = {r["key"]: r for r in reports.full_report(reports.confusion(rows)).collect()}
    assert lines["Positive (1)"]["precision"] == lines["Positive (1)"]["f1"] == 0
    assert lines["Negative (0)"]["precision"] == near(.75) and lines["weighted avg"]["recall"] == near(.75)
    assert lines["macro avg"]["support"] == 4


def test_macro_metrics_skip_a_class_that_never_occurs(spark):
    rows = spark.createDataFrame([("m", 1, 1, 1)] * 3, "model string, run int, label int, predicted int")
    got = reports.fit_binary_metrics(rows).first()
    assert got["Precision"] == got["F1"] == 1.0 and math.isnan(got["ROC-AUC"])


def test_readouts(spark):
    bits = spark.createDataFrame([("0 1",), ("1 10",), ("11",), ("1 1 1",)], "b string")
    got = bits.select(is_hit(F.col("b")), is_hit(F.col("b"), "parity")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (True, False), (True, True)]
    with pytest.raises(ValueError):
        is_hit(F.col("b"), "majority")


def test_empty_histograms_give_zero(spark):
    maps = spark.sql("SELECT map('01', 3L, '10', 1L) AS c UNION ALL SELECT map('1', 0L) "
                     "UNION ALL SELECT CAST(map() AS map<string,bigint>)")
    assert sorted(r[0] for r in maps.select(prob_from_map(F.col("c"))).collect()) == [0.0, 0.0, 0.75]
    long = counts.explode_counts(maps.withColumns({"run": F.lit(1), "sample_id": F.monotonically_increasing_id()}), "c")
    assert {r["prob"] for r in counts.measured_probs(long).collect()} == {0.0, 0.75}


def test_loss_is_bounded_by_the_floor(spark, near):
    got = counts.cross_entropy(scored(spark, [(1, 0.0), (0, 1.0)])).first()
    assert got["loss"] == near(-math.log(1e-10)) and got["samples"] == 2


def test_thresholds_fitted_elsewhere(spark):
    train, test = scored(spark, [(1, .8), (0, .2)]), scored(spark, [(1, .7), (0, .9), (1, .8)])
    record = evaluate.calibrate_and_test(train, test).first()
    assert record["threshold_used"] == .8 and record["threshold_source"] == "pre_calibrated"
    assert record["accuracy"] == pytest.approx(1 / 3)


def test_a_run_without_a_threshold_is_an_error(spark):
    rows = scored(spark, [(1, .9), (0, .2)], [(1, .8), (0, .1)])
    given = spark.createDataFrame([(1, .5)], "run int, threshold double")
    for df in (roc.apply_threshold(rows, given), evaluate.evaluate_predictions(rows, given)):
        with pytest.raises(Exception, match="no threshold for 2"):
            df.collect()


def test_one_number_is_a_threshold_for_all_runs(spark):
    rows = scored(spark, [(1, .9), (0, .2)], [(1, .3), (0, .1)])
    assert {r["run"]: r["threshold_used"] for r in evaluate.evaluate_predictions(rows, 0.4).collect()} == {1: .4, 2: .4}
    assert [r["predicted"] for r in roc.apply_threshold(rows, 0.4).orderBy("run", "prob").collect()] == [0, 1, 0, 0]


def test_a_pooled_curve_is_cut_into_ranges(spark):
    rows = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("label"), (F.hash("id") / 2 ** 32).alias("prob"))
    pooled = roc.fit_pooled_auc(rows).first()["pooled_auc"]
    ranked = roc.fit_ranked_scores(rows, (), rows_per_range=100)
    assert roc.roc_auc(ranked, ()).first()["roc_auc"] == pooled
