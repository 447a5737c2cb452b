"""Result files of runs: scans over task folders, experiment discovery, writers."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallysift.sources import schemas as S
from tallysift.sources.commits import commit_rows, read_committed
from tallysift.sources.json_arrays import PIECE_BYTES, read_array_records


def scan_history(spark: SparkSession, experiment_dir: str) -> DataFrame:
    """Training history of all tasks of one experiment, with the task folder's name."""
    return _scan_tasks(spark, experiment_dir, S.HISTORY_FILE, S.HISTORY)


def scan_predictions(spark: SparkSession, experiment_dir: str) -> DataFrame:
    """Test predictions of all tasks of one experiment, with the task folder's name."""
    return _scan_tasks(spark, experiment_dir, S.PREDICTIONS_FILE, S.PREDICTIONS)


def scan_run_records(spark: SparkSession, experiment_dir: str) -> DataFrame:
    """Run records of all tasks of one experiment; a task folder's number offsets its runs."""
    found = read_run_records(spark, f"{experiment_dir}/tasks/task_*/{S.RUN_RECORDS_FILE}")
    offset = F.regexp_extract("path", "/tasks/task_(\\d+)/", 1).cast("int")
    return found.withColumn("Run", offset + F.col("Run"))


def read_run_records(spark: SparkSession, *paths: str, layout: str = "array", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Nested run records with their ``Run`` number and file path.

    Layout ``array``: each file is one JSON array and the position in it numbers the runs from 1; large files
    are read by many tasks each.
    Layout ``lines``: one record per line carrying its own ``Run``, as ``write_run_records`` writes.
    A file that is not valid JSON is an error.
    """
    if layout not in ("array", "lines"):
        raise ValueError(f"unknown layout {layout!r}")
    numbered = StructType([StructField("Run", IntegerType())] + S.RUN_RECORD.fields)
    out = spark.createDataFrame([], numbered).withColumn("path", F.lit(None).cast("string"))
    path_col = _file_path().alias("path")
    for path in paths:
        try:
            if layout == "lines":
                part = spark.read.schema(numbered).option("mode", "FAILFAST").json(path).select("*", path_col)
            else:
                found = read_array_records(spark, path, piece_bytes)
                record = F.from_json("value", S.RUN_RECORD, {"mode": "FAILFAST"}).alias("r")
                part = found.select("path", "pos", record).select(
                    (F.col("pos") + 1).cast("int").alias("Run"), "r.*", "path")
            out = out.unionByName(part)
        except AnalysisException as missing:
            if not _is_missing(missing):
                raise
    return out


def discover_experiments(spark: SparkSession, root: str, layout: str = "array") -> DataFrame:
    """Run records of every experiment at ``root`` or one level below, tagged by folder name."""
    found = read_run_records(
        spark, f"{root}/{S.RUN_RECORDS_FILE}", f"{root}/*/{S.RUN_RECORDS_FILE}", layout=layout
    )
    pattern = "([^/]+)/" + S.RUN_RECORDS_FILE.replace(".", "\\.") + "(/[^/]+)?$"
    return found.withColumn("experiment", F.regexp_extract("path", pattern, 1)).drop("path")


def append_history(history: DataFrame, path: str, batch: str | None = None) -> None:
    """Append history rows; one folder per run keeps later reads of a run pruned.

    With ``batch``, such as a task's name, the rows are a commit: appending the batch again, after a crash or
    by mistake, replaces it instead of doubling its rows. ``read_history`` reads commits.
    """
    if batch is None:
        history.write.mode("append").partitionBy("Run").parquet(path)
    else:
        commit_rows(history.select(S.HISTORY.names), path, batch, ("Run",))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """History rows of all batches appended to ``path``."""
    return read_committed(spark, path, S.HISTORY)


def append_predictions(predictions: DataFrame, path: str, batch: str) -> None:
    """Predictions as a commit of their own, as ``append_history`` does with a batch."""
    commit_rows(predictions.select(S.PREDICTIONS.names), path, batch, ("Run",))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of all batches appended to ``path``."""
    return read_committed(spark, path, S.PREDICTIONS)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Replace the predictions of the runs present in the frame, keep those of other runs."""
    (predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("Run").parquet(path))


def write_run_records(records: DataFrame, path: str) -> None:
    """Write run records as JSON lines without the dense loss history."""
    records.drop("loss_history").write.mode("overwrite").json(path)


def write_comparison(aggregate: DataFrame, per_run: DataFrame, folder: str) -> None:
    """Write the aggregate and the per-run comparison tables as CSV with a header."""
    aggregate.write.mode("overwrite").option("header", True).csv(f"{folder}/{S.COMPARISON_FILE}")
    per_run.write.mode("overwrite").option("header", True).csv(f"{folder}/{S.COMPARISON_RUNS_FILE}")


def write_summary(summary: DataFrame, root: str) -> None:
    """Write one summary per experiment, and the combined one if there are several."""
    summary.write.mode("overwrite").partitionBy("experiment").json(f"{root}/{S.SUMMARY_FILE}")
    if summary.select("experiment").distinct().limit(2).count() > 1:
        summary.write.mode("overwrite").json(f"{root}/{S.COMBINED_SUMMARY_FILE}")


def _scan_tasks(spark, experiment_dir, file_name, schema):
    task = F.regexp_extract(_file_path(), "/tasks/([^/]+)/", 1)
    try:
        return (
            spark.read.schema(schema).option("header", True)
            .csv(f"{experiment_dir}/tasks/task_*/{file_name}").withColumn("task", task)
        )
    except AnalysisException as missing:
        if not _is_missing(missing):
            raise
        return spark.createDataFrame([], schema).withColumn("task", F.lit(None).cast("string"))


def _file_path():
    """The file's path as it is on disk: Spark reports it percent-encoded, with a plus left as it is."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _is_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"
