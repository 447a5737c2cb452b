"""Consolidation, comparison and cross-run reports."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.evaluating import ACCURACY, AVERAGES, LINES, predicted
from catalog.registry import query, r9, rounded
from tallysift.operators import comparison, curves, records, reports, roc
from tallysift.plans import evaluate
from tallysift.sources.schemas import METRIC_ORDER

ACC, PREC, REC, F1, AUC = METRIC_ORDER
EVALUATED = f"{AVERAGES}, {X.auc_sql('predictions')}"


def event_records(spark, sf):
    """Stored run records of the five event runs."""
    found = evaluate.evaluate_predictions(X.predictions(spark, sf))
    return records.to_run_records(found, label="trained", n_features=2, epochs=30, infrastructure="local", backend="local")


def event_metrics(spark, sf, model, offset=0):
    rows = predicted(spark, sf).withColumn("model", F.lit(model))
    if offset:
        rows = rows.filter(F.col("run") > offset)
    return reports.fit_binary_metrics(rows, score="prob")


@query("i1_merge_history", f"WITH {X.HISTORY} SELECT * FROM history ORDER BY Run, Epoch")
def i1(spark, sf):
    return curves.merge_history(X.history(spark, sf))


@query("i2_merge_predictions", f"""WITH {LINES} SELECT run AS "Run", label AS "True_Label",
  CAST(predicted AS INT) AS "Predicted_Label", prob AS "Prob_1" FROM predicted ORDER BY run""")
def i2(spark, sf):
    return curves.merge_predictions(predicted(spark, sf).select(
        F.col("run").alias("Run"), F.col("label").alias("True_Label"),
        F.col("predicted").alias("Predicted_Label"), F.col("prob").alias("Prob_1")))


RECORD_METRICS = f"""metrics AS (SELECT 'trained' AS model, c.run, ROUND({ACCURACY}, 4) AS "{ACC}", m.precision AS "{PREC}",
  m.recall AS "{REC}", ROUND(m.f1, 4) AS "{F1}", ROUND(a.roc_auc, 4) AS "{AUC}" FROM confusion c
  JOIN averages m ON c.run = m.run AND m.key = 'macro avg' JOIN auc a ON c.run = a.run)"""


@query("i4_record_metrics", f"""WITH {EVALUATED}, {RECORD_METRICS}
SELECT model, run, """ + ", ".join(f'{r9(chr(34) + m + chr(34))} AS "{m}"' for m in METRIC_ORDER) + " FROM metrics")
def i4(spark, sf):
    return rounded(records.record_metrics(event_records(spark, sf), "trained"), *METRIC_ORDER)


TWO_MODELS = f"""base AS (SELECT c.run, {ACCURACY} AS "{ACC}", m.precision AS "{PREC}", m.recall AS "{REC}", m.f1 AS "{F1}",
  a.roc_auc AS "{AUC}" FROM confusion c JOIN averages m ON c.run = m.run AND m.key = 'macro avg' JOIN auc a ON c.run = a.run),
metrics AS (SELECT 'first' AS model, * FROM base UNION ALL SELECT 'second', * FROM base WHERE run > 3
  UNION ALL SELECT 'single', run, "{ACC}", "{PREC}", "{REC}", "{F1}", CAST('nan' AS DOUBLE) FROM base WHERE run = 5)"""
AGGREGATE = f"""{EVALUATED}, {TWO_MODELS}, long AS (""" + " UNION ALL ".join(
    f"""SELECT model, run, '{m}' AS metric, "{m}" AS v FROM metrics""" for m in METRIC_ORDER) + f"""),
aggregate AS (SELECT model AS "Model", metric AS "Metric",
  COALESCE(AVG(v) FILTER (WHERE NOT isnan(v)), CAST('nan' AS DOUBLE)) AS "Mean",
  COALESCE(STDDEV_POP(v) FILTER (WHERE NOT isnan(v)), 0) AS "Std" FROM long GROUP BY model, metric)"""


def compared(spark, sf):
    """Two models with several runs and one with a single run and no AUC."""
    single = event_metrics(spark, sf, "single", 4).withColumn(AUC, F.lit(float("nan")))
    return comparison.build_comparison(
        event_metrics(spark, sf, "first"), event_metrics(spark, sf, "second", 3), single)


@query("i5_aggregate_metrics", f"""WITH {AGGREGATE} SELECT "Model", "Metric", {r9('"Mean"')} AS "Mean", {r9('"Std"')} AS "Std" FROM aggregate""")
def i5(spark, sf):
    return rounded(compared(spark, sf)[0], "Mean", "Std")


@query("i6_metric_rows", f"""WITH {AGGREGATE} SELECT model AS "Model", run AS "Run", metric AS "Metric", {r9('v')} AS "Value"
FROM long WHERE NOT isnan(v)""")
def i6(spark, sf):
    return rounded(compared(spark, sf)[1], "Value")


@query("i7_model_comparison", f"""WITH {EVALUATED}, {RECORD_METRICS}, long AS (""" + " UNION ALL ".join(
    f"""SELECT model, '{m}' AS metric, "{m}" AS v FROM metrics""" for m in METRIC_ORDER) + f""" UNION ALL """ + " UNION ALL ".join(
    f"""SELECT 'other', '{m}', "{m}" FROM metrics WHERE run > 3""" for m in METRIC_ORDER) + f""")
SELECT model AS "Model", metric AS "Metric", {r9('AVG(v)')} AS "Mean", {r9('STDDEV_POP(v)')} AS "Std" FROM long GROUP BY model, metric""")
def i7(spark, sf):
    from tallysift.plans.compare import compare_models
    stored = event_records(spark, sf)
    other = records.record_metrics(stored.filter("Run > 3"), "other")
    return rounded(compare_models(stored, other, model="trained")[0], "Mean", "Std")


@query("i8_comparison_matrix", f"""WITH {AGGREGATE} SELECT "Model", """ + ", ".join(
    f"""{r9(f'MAX("Mean") FILTER (WHERE "Metric" = {chr(39)}{m}{chr(39)})')} AS "{m}" """ for m in METRIC_ORDER)
    + """ FROM aggregate GROUP BY "Model" """)
def i8(spark, sf):
    matrix = comparison.comparison_matrix(compared(spark, sf)[0], ["first", "second", "single"])
    return rounded(matrix, *METRIC_ORDER)


@query("i9_repeated_points", f"""WITH {AGGREGATE}, rows AS (SELECT *, COUNT(*) OVER (PARTITION BY model, metric) AS points
  FROM long WHERE NOT isnan(v)) SELECT model AS "Model", run AS "Run", metric AS "Metric", {r9('v')} AS "Value", points
FROM rows WHERE points > 1""")
def i9(spark, sf):
    return rounded(comparison.repeated_points(compared(spark, sf)[1]), "Value")


@query("i10_learning_curve", f"""WITH {X.HISTORY} SELECT Metric, Epoch, {r9('AVG(Value)')} AS mean,
  {r9('COALESCE(STDDEV_SAMP(Value), 0)')} AS std FROM history WHERE Metric IN ('fitness', 'mean_best') GROUP BY Metric, Epoch""")
def i10(spark, sf):
    return rounded(curves.learning_curve(X.history(spark, sf), ["fitness", "mean_best"]), "mean", "std")


@query("i10_largest_run", f"""WITH {X.HISTORY} SELECT Metric, MAX(Run) AS runs FROM history
WHERE Metric IN ('fitness', 'mean_best') GROUP BY Metric""")
def i10_runs(spark, sf):
    return curves.largest_run(X.history(spark, sf), ["fitness", "mean_best"])


@query("i11_final_loss_distribution", f"""WITH {X.HISTORY}, loss AS (SELECT Value AS v FROM history WHERE Metric = 'final_loss'),
q AS (SELECT quantile_cont(v, CAST(0.25 AS DOUBLE)) AS q1, quantile_cont(v, CAST(0.5 AS DOUBLE)) AS median,
  quantile_cont(v, CAST(0.75 AS DOUBLE)) AS q3, COUNT(*) AS points FROM loss)
SELECT {r9('q1')} AS q1, {r9('median')} AS median, {r9('q3')} AS q3,
  {r9('LEAST(q1, (SELECT MIN(v) FROM loss WHERE v >= q1 - 1.5 * (q3 - q1)))')} AS whisker_low,
  {r9('GREATEST(q3, (SELECT MAX(v) FROM loss WHERE v <= q3 + 1.5 * (q3 - q1)))')} AS whisker_high, points FROM q""")
def i11(spark, sf):
    found = curves.final_loss_distribution(X.history(spark, sf))
    return rounded(found, "q1", "median", "q3", "whisker_low", "whisker_high")


REPORT_LONG = f"""all_lines AS (SELECT * FROM lines UNION ALL SELECT * FROM averages),
report AS (SELECT run, key, 'precision' AS metric, precision AS value FROM all_lines
  UNION ALL SELECT run, key, 'recall', recall FROM all_lines UNION ALL SELECT run, key, 'f1-score', f1 FROM all_lines
  UNION ALL SELECT run, key, 'support', support FROM all_lines
  UNION ALL SELECT run, 'accuracy', 'accuracy', {ACCURACY} FROM confusion)"""


@query("i12_report_summary", f"""WITH {AVERAGES}, {REPORT_LONG} SELECT key, metric, {r9('AVG(value)')} AS mean,
  {r9('STDDEV_POP(value)')} AS std FROM report GROUP BY key, metric""")
def i12(spark, sf):
    return rounded(records.summarise_reports(event_records(spark, sf)), "mean", "std")


@query("i13_combined_summary", f"""WITH {AVERAGES}, {REPORT_LONG} SELECT CASE WHEN run > 2 THEN 'late' ELSE 'early' END AS experiment,
  key, metric, {r9('AVG(value)')} AS mean, {r9('STDDEV_POP(value)')} AS std FROM report GROUP BY 1, 2, 3""")
def i13(spark, sf):
    stored = event_records(spark, sf).withColumn(
        "experiment", F.when(F.col("Run") > 2, "late").otherwise("early"))
    return rounded(records.summarise_reports(stored, by=("experiment",)), "mean", "std")


@query("i14_history_rows", f"""WITH {X.HISTORY} SELECT Run AS "Run",
  CAST(ROW_NUMBER() OVER (PARTITION BY Run, Metric ORDER BY Epoch) AS INT) AS "Epoch", 'fitness' AS "Metric", Value AS "Value",
  CASE WHEN Metric = 'mean_best' THEN 'validation' ELSE 'training' END AS part FROM history WHERE Metric <> 'final_loss'""")
def i14(spark, sf):
    """One history map per run: mean_best plays the validation series, final_loss is not asked for."""
    name = F.when(F.col("Metric") == "mean_best", "val_fitness").otherwise(
        F.when(F.col("Metric") == "fitness", "fitness").otherwise("closing"))
    # epochs are days of a month: a series holds 31 values at most
    series = X.history(spark, sf).groupBy("Run", name.alias("name")).agg(
        F.sort_array(F.collect_list(F.struct("Epoch", "Value"))).alias("points"))
    maps = series.groupBy("Run").agg(F.map_from_entries(F.collect_list(
        F.struct("name", F.col("points.Value").alias("values")))).alias("history"))
    return curves.history_rows(maps.select((F.col("Run") - 1).alias("run_idx"), "history"), ["fitness"])


@query("i15_training_summary", f"""WITH {X.HISTORY} SELECT Run, arg_min(Value, Epoch) AS first, arg_max(Value, Epoch) AS last,
  COUNT(*) AS generations, arg_max(Value, Epoch) - arg_min(Value, Epoch) AS change FROM history WHERE Metric = 'fitness' GROUP BY Run""")
def i15(spark, sf):
    return curves.training_summary(X.history(spark, sf))


@query("i16_final_loss_rows", f"""WITH {X.HISTORY}, ends AS (SELECT Run, MAX(Epoch) + 1 AS Epoch FROM history
  WHERE Metric <> 'final_loss' GROUP BY Run)
SELECT Run, Epoch, Metric, Value FROM history WHERE Metric <> 'final_loss' UNION ALL
SELECT e.Run, e.Epoch, 'final_loss', h.Value FROM ends e JOIN history h ON e.Run = h.Run AND h.Metric = 'final_loss'""")
def i16(spark, sf):
    rows = X.history(spark, sf)
    return curves.with_final_loss(rows.filter("Metric != 'final_loss'"), curves.final_losses(rows))


@query("i17_rounded_record", f"""WITH {EVALUATED} SELECT c.run AS "Run", ROUND({ACCURACY}, 4) AS accuracy, ROUND(m.f1, 4) AS macro_f1,
  CASE WHEN NOT isnan(a.roc_auc) THEN ROUND(a.roc_auc, 4) END AS roc_auc, ROUND(y.threshold, 4) AS threshold_youden,
  CAST(m.support AS INT) AS n_test FROM confusion c JOIN averages m ON c.run = m.run AND m.key = 'macro avg'
  JOIN auc a ON c.run = a.run JOIN youden y ON c.run = y.run""")
def i17(spark, sf):
    return event_records(spark, sf).select(
        "Run", "accuracy", "macro_f1", "roc_auc", "threshold_youden", "n_test")


@query("i18_latest_state", f"""WITH {X.HISTORY}, pairs AS (SELECT f.Run, f.Epoch, f.Value AS a, m.Value AS b FROM history f
  JOIN history m ON f.Run = m.Run AND f.Epoch = m.Epoch AND f.Metric = 'fitness' AND m.Metric = 'mean_best')
SELECT Run, MAX(Epoch) AS Epoch, arg_max(a, Epoch) AS first_parameter, arg_max(b, Epoch) AS second_parameter FROM pairs GROUP BY Run""")
def i18(spark, sf):
    wide = X.history(spark, sf).groupBy("Run", "Epoch").pivot("Metric", ["fitness", "mean_best"]).agg(F.first("Value"))
    states = wide.dropna().select("Run", "Epoch", F.array("fitness", "mean_best").alias("params"))
    return records.latest_state(states).select(
        "Run", "Epoch", F.col("params")[0].alias("first_parameter"), F.col("params")[1].alias("second_parameter"))
