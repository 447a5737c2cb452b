"""ROC, thresholds, reports and confusion matrices."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.measuring import scored, scored_sql
from catalog.registry import query, r9, rounded
from tallysift.operators import arriving, reports, roc
from tallysift.plans import evaluate
from tallysift.session import scratch_dir

RANKED = f"{X.PREDICTIONS}, {X.ranked_sql('predictions')}"
YOUDEN = f"{RANKED}, {X.youden_sql()}"
PREDICTED = f"""{YOUDEN}, predicted AS (SELECT p.run, event_id, label, prob, threshold,
  CASE WHEN prob >= threshold THEN 1 ELSE 0 END AS predicted FROM predictions p JOIN youden y ON p.run = y.run)"""
CONFUSION = f"{PREDICTED}, {X.confusion_sql('predicted')}"
LINES = f"{CONFUSION}, {X.class_lines_sql()}"
AVERAGES = f"{LINES}, {X.average_lines_sql()}"
LINE_COLUMNS = f"run, key, {r9('precision')} AS precision, {r9('recall')} AS recall, {r9('f1')} AS f1, support"
ACCURACY = "CAST(tn + tp AS DOUBLE) / (tn + fp + fn + tp)"


def ranked(spark, sf):
    return roc.fit_ranked_scores(X.predictions(spark, sf))


def predicted(spark, sf):
    thresholds = roc.youden_threshold(ranked(spark, sf))
    return evaluate.predicted_labels(X.predictions(spark, sf), thresholds)


@query("g1_roc_points", f"""WITH {RANKED}, points AS (
  SELECT run, threshold, tp, fp, positives, negatives FROM ranked
  UNION ALL SELECT run, CAST('inf' AS DOUBLE), 0, 0, max(positives), max(negatives) FROM ranked GROUP BY run)
SELECT run, threshold, tp, fp, {r9('CAST(tp AS DOUBLE) / positives')} AS tpr,
  {r9('CAST(fp AS DOUBLE) / negatives')} AS fpr FROM points""")
def g1(spark, sf):
    return rounded(roc.roc_points(ranked(spark, sf)), "tpr", "fpr")


@query("g2_youden_threshold", f"WITH {YOUDEN} SELECT run, threshold FROM youden")
def g2(spark, sf):
    return roc.youden_threshold(ranked(spark, sf))


@query("g3_apply_threshold", f"""WITH {PREDICTED} SELECT run, event_id, label, prob, threshold,
  CAST(predicted AS INT) AS predicted, 'youden_calibrated' AS threshold_source FROM predicted""")
def g3(spark, sf):
    return predicted(spark, sf)


@query("g4_accuracy", f"WITH {CONFUSION} SELECT run, {r9(ACCURACY)} AS accuracy FROM confusion")
def g4(spark, sf):
    return rounded(reports.accuracy(reports.confusion(predicted(spark, sf))), "accuracy")


@query("g5_class_report", f"WITH {LINES} SELECT {LINE_COLUMNS} FROM lines")
def g5(spark, sf):
    lines = reports.class_report(reports.confusion(predicted(spark, sf)))
    return rounded(lines, "precision", "recall", "f1")


@query("g6_report_averages", f"WITH {AVERAGES} SELECT {LINE_COLUMNS} FROM averages")
def g6(spark, sf):
    lines = reports.report_averages(reports.confusion(predicted(spark, sf)))
    return rounded(lines, "precision", "recall", "f1")


@query("g7_roc_auc", f"WITH {X.PREDICTIONS}, {X.auc_sql('predictions')} SELECT run, {r9('roc_auc')} AS roc_auc FROM auc")
def g7(spark, sf):
    return rounded(roc.roc_auc(ranked(spark, sf)), "roc_auc")


def record_sql(prefix: str, source: str) -> str:
    """Flat evaluation record from CTEs ``confusion``, ``lines``, ``averages``, ``auc`` and ``youden``."""
    return f"""WITH {prefix} SELECT c.run, {r9(ACCURACY)} AS accuracy, {r9('m.f1')} AS macro_f1,
  {r9('a.roc_auc')} AS roc_auc, y.threshold AS threshold_used, '{source}' AS threshold_source,
  {r9('n.precision')} AS negative_precision, {r9('p.recall')} AS positive_recall,
  {r9('w.f1')} AS weighted_f1, w.support AS support
FROM confusion c JOIN youden y ON c.run = y.run JOIN auc a ON c.run = a.run
JOIN averages m ON c.run = m.run AND m.key = 'macro avg' JOIN averages w ON c.run = w.run AND w.key = 'weighted avg'
JOIN lines n ON c.run = n.run AND n.key = 'Negative (0)' JOIN lines p ON c.run = p.run AND p.key = 'Positive (1)'"""


def flat_record(record):
    report = F.col("report")
    return rounded(record.select(
        "run", "accuracy", "macro_f1", "roc_auc", "threshold_used", "threshold_source",
        report["Negative (0)"]["precision"].alias("negative_precision"),
        report["Positive (1)"]["recall"].alias("positive_recall"),
        report["weighted avg"]["f1-score"].alias("weighted_f1"),
        report["weighted avg"]["support"].alias("support"),
    ), "accuracy", "macro_f1", "roc_auc", "negative_precision", "positive_recall", "weighted_f1")


COUNT_EVALUATION = f"""{scored_sql()}, {X.ranked_sql('scored')}, {X.youden_sql()},
predicted AS (SELECT s.run, label, CASE WHEN prob >= threshold THEN 1 ELSE 0 END AS predicted
  FROM scored s JOIN youden y ON s.run = y.run),
{X.confusion_sql('predicted')}, {X.class_lines_sql()}, {X.average_lines_sql()}, {X.auc_sql('scored')}"""


@query("g8_evaluation_record", record_sql(COUNT_EVALUATION, "youden_calibrated"))
def g8(spark, sf):
    from catalog.measuring import labelled
    return flat_record(evaluate.evaluate_counts(X.counts(spark, sf), labelled(spark, sf)))


@query("g8_prediction_record", record_sql(
    f"{AVERAGES}, {X.auc_sql('predictions')}", "youden_calibrated"))
def g8_predictions(spark, sf):
    return flat_record(evaluate.evaluate_predictions(X.predictions(spark, sf)))


METRICS = f"""{r9(ACCURACY)} AS "Accuracy", {r9('m.precision')} AS "Precision", {r9('m.recall')} AS "Recall",
  {r9('m.f1')} AS "F1\""""


@query("g9_binary_metrics", f"""WITH {AVERAGES}, {X.auc_sql('predictions')}
SELECT 'events' AS model, c.run, {METRICS}, {r9('a.roc_auc')} AS "ROC-AUC" FROM confusion c
JOIN averages m ON c.run = m.run AND m.key = 'macro avg' JOIN auc a ON c.run = a.run""")
def g9(spark, sf):
    rows = predicted(spark, sf).withColumn("model", F.lit("events"))
    return rounded(reports.fit_binary_metrics(rows, score="prob"), "Accuracy", "Precision", "Recall", "F1", "ROC-AUC")


@query("g9_metrics_without_score", f"""WITH {AVERAGES}
SELECT 'events' AS model, c.run, {METRICS}, CAST('nan' AS DOUBLE) AS "ROC-AUC" FROM confusion c
JOIN averages m ON c.run = m.run AND m.key = 'macro avg'""")
def g9_plain(spark, sf):
    rows = predicted(spark, sf).withColumn("model", F.lit("events"))
    return rounded(reports.fit_binary_metrics(rows), "Accuracy", "Precision", "Recall", "F1")


CELLS = f"""{PREDICTED}, grid AS (SELECT r.run, t.v AS true_label, q.v AS predicted_label
  FROM (SELECT DISTINCT run FROM predicted) r, (VALUES (0), (1)) t(v), (VALUES (0), (1)) q(v)),
cells AS (SELECT g.run, g.true_label, g.predicted_label, COUNT(p.run) AS n FROM grid g LEFT JOIN predicted p
  ON g.run = p.run AND g.true_label = p.label AND g.predicted_label = p.predicted GROUP BY 1, 2, 3)"""


@query("g10_confusion_cells", f"WITH {CELLS} SELECT * FROM cells")
def g10(spark, sf):
    return reports.confusion_cells(reports.confusion(predicted(spark, sf)))


@query("g10_confusion_summary", f"""WITH {CELLS} SELECT true_label, predicted_label, {r9('AVG(n)')} AS mean,
  {r9('STDDEV_POP(n)')} AS std, COUNT(*) AS runs FROM cells GROUP BY 1, 2""")
def g10_summary(spark, sf):
    return rounded(reports.confusion_summary(reports.confusion(predicted(spark, sf))), "mean", "std")


# a range join: the grid point g lies in the segment from one point of the curve to the next
MEAN_CURVE = f"""WITH {RANKED}, points AS (
  SELECT run, tp, fp, positives, negatives FROM ranked
  UNION ALL SELECT run, 0, 0, max(positives), max(negatives) FROM ranked GROUP BY run),
segments AS (SELECT *, LEAD(fp) OVER w AS next_fp, LEAD(tp) OVER w AS next_tp FROM points
  WINDOW w AS (PARTITION BY run ORDER BY fp, tp)),
curves AS (SELECT run, g, (tp + (next_tp - tp) * ((g * negatives / CAST(199 AS DOUBLE)) - fp) / CAST(next_fp - fp AS DOUBLE)) / positives AS tpr
  FROM segments, (SELECT UNNEST(range(0, 200)) AS g) grid
  WHERE next_fp > fp AND fp * 199 <= g * negatives AND g * negatives < next_fp * 199
  UNION ALL SELECT DISTINCT run, 199, CAST(1 AS DOUBLE) FROM points)
SELECT CAST(g AS INT) AS g, {r9('g / CAST(199 AS DOUBLE)')} AS fpr, {r9('AVG(tpr)')} AS mean_tpr,
  {r9('STDDEV_POP(tpr)')} AS std_tpr, COUNT(*) AS curves FROM curves GROUP BY g"""


@query("g11_mean_roc", MEAN_CURVE)
def g11(spark, sf):
    return rounded(roc.mean_roc(ranked(spark, sf)), "fpr", "mean_tpr", "std_tpr")


POOLED = f"""WITH {X.PREDICTIONS}, {X.auc_sql('predictions', keys='')}
SELECT {r9('roc_auc')} AS pooled_auc FROM auc"""


@query("g12_pooled_auc", POOLED)
def g12(spark, sf):
    return rounded(roc.fit_pooled_auc(X.predictions(spark, sf)), "pooled_auc")


def arrive(spark, sf) -> str:
    """Five runs in three batches, one of them written twice; two batches are then merged."""
    root, rows = scratch_dir(spark, "curves"), X.predictions(spark, sf)
    for name, part in (("a", "run = 1"), ("b", "run IN (2, 4)"), ("c", "run IN (3, 5)"), ("b", "run IN (2, 4)")):
        arriving.add_runs(rows.filter(part), root, name)
    arriving.merge_batches(spark, root, "ab", ["a", "b"])
    return root


@query("g11_arriving_runs", MEAN_CURVE)
def g11_arriving(spark, sf):
    return rounded(arriving.stored_mean_roc(spark, arrive(spark, sf)), "fpr", "mean_tpr", "std_tpr")


@query("g12_arriving_runs", POOLED)
def g12_arriving(spark, sf):
    return rounded(arriving.fit_stored_auc(spark, arrive(spark, sf)), "pooled_auc")


SPLIT = "CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END"


@query("g13_calibrate_then_test", record_sql(f"""{X.PREDICTIONS},
train AS (SELECT * FROM predictions WHERE event_id % 5 <> 0), test AS (SELECT * FROM predictions WHERE event_id % 5 = 0),
{X.ranked_sql('train')}, {X.youden_sql()},
predicted AS (SELECT t.run, label, CASE WHEN prob >= threshold THEN 1 ELSE 0 END AS predicted
  FROM test t JOIN youden y ON t.run = y.run),
{X.confusion_sql('predicted')}, {X.class_lines_sql()}, {X.average_lines_sql()}, {X.auc_sql('test')}""", "pre_calibrated"))
def g13(spark, sf):
    rows = X.predictions(spark, sf)
    held_out = F.col("event_id") % 5 == 0
    return flat_record(evaluate.calibrate_and_test(rows.filter(~held_out), rows.filter(held_out)))
