"""Sources and sinks: every query writes derived tables and reads them back."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.evaluating import ACCURACY, AVERAGES, PREDICTED, predicted
from catalog.registry import query, r9, rounded
from catalog.reporting import AGGREGATE, EVALUATED, REPORT_LONG, compared, event_records
from tallysift.plans import report
from tallysift.session import scratch_dir
from tallysift.sources import results, schemas, tables

COLUMNS = ["row_id", "label", "f_price", "f_bal", "f_nation", "f_prio", "f_seg", "f_name"]
CASTS = {"label": "CAST(label AS BIGINT) AS label", "f_nation": "CAST(f_nation AS BIGINT) AS f_nation"}
SELECT = ", ".join(CASTS.get(c, c) for c in COLUMNS)


def write_csv(df, path):
    df.write.option("header", True).csv(path)
    return path


@query("a1_read_table", f"WITH {X.SAMPLES} SELECT {SELECT} FROM samples")
def a1(spark, sf):
    path = write_csv(X.samples(spark, sf).select(*COLUMNS), scratch_dir(spark, "table"))
    return tables.read_labelled(spark, data_path=path)


@query("a1_read_parquet", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def a1_parquet(spark, sf):
    return tables.read_labelled(spark, data_path=f"{sf}/orders.parquet", fmt="parquet").select(
        "o_orderkey", "o_totalprice", "o_orderpriority")


@query("a2_read_pair", f"""WITH {X.SAMPLES} SELECT {SELECT.replace('f_seg', "CASE WHEN split = 'train' THEN f_seg END AS f_seg")}, split
FROM samples""")
def a2(spark, sf):
    """The test file lacks one column of the training file."""
    rows = X.samples(spark, sf)
    train = write_csv(rows.filter("split = 'train'").select(*COLUMNS), scratch_dir(spark, "train"))
    test = write_csv(rows.filter("split = 'test'").select(*COLUMNS).drop("f_seg"), scratch_dir(spark, "test"))
    return tables.read_labelled(spark, train_path=train, test_path=test)


def write_tasks(spark, sf) -> str:
    """Task folders of one experiment: runs 1-3 in the first, runs 4-5 in the second."""
    root = scratch_dir(spark, "experiment")
    history, stored = X.history(spark, sf), event_records(spark, sf)
    scored = predicted(spark, sf).select(
        F.col("run").alias("Run"), F.col("label").alias("True_Label"),
        F.col("predicted").alias("Predicted_Label"), F.col("prob").alias("Prob_1"))
    for task, part in (("task_0000", "Run <= 3"), ("task_0003", "Run > 3")):
        write_csv(history.filter(part), f"{root}/tasks/{task}/{schemas.HISTORY_FILE}")
        write_csv(scored.filter(part), f"{root}/tasks/{task}/{schemas.PREDICTIONS_FILE}")
        write_array(stored.filter(part), f"{root}/tasks/{task}/{schemas.RUN_RECORDS_FILE}")
    return root


def write_array(stored, path):
    """One JSON array per file, the form in which run records are exchanged."""
    packed = stored.select(F.struct("Run", F.struct(*[c for c in stored.columns if c != "Run"]).alias("r")).alias("s"))
    packed.agg(F.sort_array(F.collect_list("s")).alias("rows")).select(F.to_json("rows.r")).write.text(path)


TASK = "CASE WHEN Run <= 3 THEN 'task_0000' ELSE 'task_0003' END AS task"


@query("a3_scan_history", f"WITH {X.HISTORY} SELECT *, {TASK} FROM history")
def a3(spark, sf):
    return results.scan_history(spark, write_tasks(spark, sf))


@query("a3_scan_predictions", f"""WITH {PREDICTED} SELECT run AS "Run", label AS "True_Label", CAST(predicted AS INT) AS "Predicted_Label",
  prob AS "Prob_1", {TASK} FROM predicted""")
def a3_predictions(spark, sf):
    return results.scan_predictions(spark, write_tasks(spark, sf))


RECORDS = f"""WITH {EVALUATED} SELECT c.run AS "Run", 'trained' AS label, ROUND({ACCURACY}, 4) AS accuracy, ROUND(m.f1, 4) AS macro_f1,
  ROUND(a.roc_auc, 4) AS roc_auc, {r9('m.recall')} AS macro_recall FROM confusion c
  JOIN averages m ON c.run = m.run AND m.key = 'macro avg' JOIN auc a ON c.run = a.run"""


def record_columns(found):
    return rounded(found.select(
        "Run", "label", "accuracy", "macro_f1", "roc_auc",
        F.col("report")["macro avg"]["recall"].alias("macro_recall")), "macro_recall")


@query("a4_read_run_records", RECORDS)
def a4(spark, sf):
    path = scratch_dir(spark, "records")
    write_array(event_records(spark, sf), path)
    return record_columns(results.read_run_records(spark, path))


@query("i3_merge_run_records", RECORDS)
def i3(spark, sf):
    return record_columns(results.scan_run_records(spark, write_tasks(spark, sf)))


def write_experiments(spark, sf) -> str:
    root = scratch_dir(spark, "root")
    stored = event_records(spark, sf)
    for name, part in (("exp_a", "Run <= 2"), ("exp_b", "Run > 2")):
        write_array(stored.filter(part), f"{root}/{name}/{schemas.RUN_RECORDS_FILE}")
    return root


EXPERIMENT = "CASE WHEN run <= 2 THEN 'exp_a' ELSE 'exp_b' END AS experiment"


@query("a5_discover_experiments", f"""WITH {EVALUATED} SELECT {EXPERIMENT.replace('run', 'c.run')}, CAST(CASE WHEN c.run <= 2 THEN c.run ELSE c.run - 2 END AS INT) AS "Run",
  ROUND({ACCURACY}, 4) AS accuracy FROM confusion c""")
def a5(spark, sf):
    return results.discover_experiments(spark, write_experiments(spark, sf)).select("experiment", "Run", "accuracy")


@query("a6_append_history", f"WITH {X.HISTORY} SELECT * FROM history")
def a6(spark, sf):
    path, rows = scratch_dir(spark, "history"), X.history(spark, sf)
    results.append_history(rows.filter("Metric != 'final_loss'"), path)
    results.append_history(rows.filter("Metric = 'final_loss'"), path)
    return spark.read.parquet(path)


@query("a6_commit_history", f"WITH {X.HISTORY} SELECT * FROM history")
def a6_commits(spark, sf):
    """Batches by run, all of them written twice: each row is there once."""
    path, rows = scratch_dir(spark, "history"), X.history(spark, sf).persist()
    for part in ("Run <= 2", "Run > 2", "Run <= 2", "Run > 2"):
        results.append_history(rows.filter(part), path, batch=part)
    return results.read_history(spark, path)


@query("a7_commit_predictions", f"""WITH {PREDICTED} SELECT run AS "Run", label AS "True_Label", CAST(predicted AS INT) AS "Predicted_Label",
  prob AS "Prob_1" FROM predicted""")
def a7_commits(spark, sf):
    """A batch that was written wrongly first is replaced by the one that follows under its name."""
    path = scratch_dir(spark, "predictions")
    rows = predicted(spark, sf).select(
        F.col("run").alias("Run"), F.col("label").alias("True_Label"),
        F.col("predicted").alias("Predicted_Label"), F.col("prob").alias("Prob_1"))
    results.append_predictions(rows.filter("Run = 1"), path, "low")
    results.append_predictions(rows.filter("Run <= 3"), path, "low")
    results.append_predictions(rows.filter("Run > 3"), path, "high")
    return results.read_predictions(spark, path)


@query("a4_split_run_records", RECORDS)
def a4_split(spark, sf):
    """The array in pieces of 700 bytes, so that records and strings are cut anywhere."""
    path = scratch_dir(spark, "records")
    write_array(event_records(spark, sf), path)
    return record_columns(results.read_run_records(spark, path, piece_bytes=700))


@query("a7_write_predictions", f"""WITH {PREDICTED} SELECT run AS "Run", label AS "True_Label", CAST(predicted AS INT) AS "Predicted_Label",
  prob AS "Prob_1" FROM predicted""")
def a7(spark, sf):
    """Writing a run again replaces its rows."""
    path = scratch_dir(spark, "predictions")
    rows = predicted(spark, sf).select(
        F.col("run").alias("Run"), F.col("label").alias("True_Label"),
        F.col("predicted").alias("Predicted_Label"), F.col("prob").alias("Prob_1"))
    results.write_predictions(rows, path)
    results.write_predictions(rows.filter("Run = 5"), path)
    return spark.read.parquet(path)


@query("a8_write_run_records", RECORDS)
def a8(spark, sf):
    path = scratch_dir(spark, "records")
    losses = X.history(spark, sf).filter("Metric = 'fitness'").groupBy("Run").agg(
        F.sort_array(F.collect_list("Value")).alias("loss_history"))
    results.write_run_records(event_records(spark, sf).join(losses, "Run"), path)
    return record_columns(results.read_run_records(spark, path, layout="lines"))


@query("a9_write_comparison", f"""WITH {AGGREGATE} SELECT "Model", "Metric", {r9('"Mean"')} AS "Mean", {r9('"Std"')} AS "Std" FROM aggregate""")
def a9(spark, sf):
    folder = scratch_dir(spark, "comparison")
    results.write_comparison(*compared(spark, sf), folder)
    found = spark.read.schema(schemas.COMPARISON).option("header", True).csv(f"{folder}/{schemas.COMPARISON_FILE}")
    return rounded(found, "Mean", "Std")


@query("a9_write_comparison_runs", f"""WITH {AGGREGATE} SELECT model AS "Model", run AS "Run", metric AS "Metric", {r9('v')} AS "Value"
FROM long WHERE NOT isnan(v)""")
def a9_runs(spark, sf):
    folder = scratch_dir(spark, "comparison")
    results.write_comparison(*compared(spark, sf), folder)
    found = spark.read.schema(schemas.COMPARISON_RUNS).option("header", True).csv(
        f"{folder}/{schemas.COMPARISON_RUNS_FILE}")
    return rounded(found, "Value")


@query("a10_write_summary", f"""WITH {AVERAGES}, {REPORT_LONG} SELECT {EXPERIMENT}, key, metric, {r9('AVG(value)')} AS mean,
  {r9('STDDEV_POP(value)')} AS std FROM report GROUP BY 1, 2, 3""")
def a10(spark, sf):
    root = write_experiments(spark, sf)
    results.write_summary(report.summarise_experiments(spark, root), root)
    shape = "experiment string, key string, metric string, mean double, std double"
    return rounded(spark.read.schema(shape).json(f"{root}/{schemas.COMBINED_SUMMARY_FILE}"), "mean", "std")
