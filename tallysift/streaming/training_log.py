"""Live training logs: lines to history rows, incremental append, running state."""

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallysift.streaming.growing_log import read_growing

# Fixed value: a generation line of the training log.
GENERATION_LINE = r"Generation\s+(\d+):.*BestFitness:\s+([-\d.eE+]+),\s*MeanBest:\s+([-\d.eE+]+)"
RUN_FOLDER = r"/Run=(\d+)/"
STATE = "Run int, best double, last_epoch int, last_fitness double, generations long"
COMPACT_EVERY = 20


def read_log(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """Log lines of ``path/Run=<n>/*`` with their run number; a stream also sees what files grow by."""
    if stream:
        found = read_growing(spark, path)
    else:
        found = spark.read.text(f"{path}/Run=*/").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return found.select(F.regexp_extract("file", RUN_FOLDER, 1).cast("int").alias("Run"), "line")


def parse_generations(lines: DataFrame) -> DataFrame:
    """One row per generation line: Run, Epoch, fitness, mean_best; other lines are ignored."""
    part = lambda i: F.regexp_extract("line", GENERATION_LINE, i)
    return lines.filter(F.col("line").rlike(GENERATION_LINE)).select(
        "Run", part(1).cast("int").alias("Epoch"),
        part(2).try_cast("double").alias("fitness"), part(3).try_cast("double").alias("mean_best"),
    )


def generation_history(generations: DataFrame) -> DataFrame:
    """Generation rows in history form: a fitness row and a mean_best row each."""
    rows = [F.struct(F.lit(m).alias("Metric"), F.col(m).alias("Value")) for m in ("fitness", "mean_best")]
    return generations.select("Run", "Epoch", F.inline(F.array(*rows)))


def append_generations(
    spark: SparkSession, log_path: str, history_path: str, state_path: str,
    every: str | None = None,
) -> StreamingQuery:
    """Append history rows of new log lines exactly once.

    With ``every`` (such as "30 seconds") the query keeps running; without it, everything
    present is flushed and the query ends. A restart with the same ``state_path`` continues
    after the last committed batch.
    """
    history = generation_history(parse_generations(read_log(spark, log_path)))
    writer = (
        history.writeStream.format("parquet").partitionBy("Run").outputMode("append")
        .option("path", history_path).option("checkpointLocation", state_path)
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def running_state(generations: DataFrame) -> DataFrame:
    """Best fitness so far, last epoch, fitness at it, and generations seen, per run."""
    return generations.groupBy("Run").agg(
        F.max("fitness").alias("best"), F.max("Epoch").alias("last_epoch"),
        F.max_by("fitness", "Epoch").alias("last_fitness"), F.count(F.lit(1)).alias("generations"),
    )


def track_state(
    spark: SparkSession, log_path: str, table_path: str, state_path: str,
    every: str | None = None,
) -> StreamingQuery:
    """Keep a table with the running state of every run, to be read with ``read_state``."""
    return keep_state(parse_generations(read_log(spark, log_path)), table_path, state_path, every)


def keep_state(generations: DataFrame, table_path: str, state_path: str, every: str | None = None,
               compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keep the running state of a stream of generation rows below ``table_path``.

    The state of each run is in Spark's state store, and a batch writes only the runs it has changed, as a folder
    of its own; a batch that is run again replaces its folder. Every ``compact_every`` batches the latest row of
    each run is written as a snapshot; folders that the snapshot before the last has made needless are deleted, so there
    is always a whole state to read.
    """
    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table_path}/batch-{number:012d}")
        if (number + 1) % compact_every == 0:
            read_state(spark, table_path).write.mode("overwrite").parquet(f"{table_path}/state-{number:012d}")
            snapshots = [n for kind, n in _versions(table_path) if kind == "state"]
            store, path = fs.FileSystem.from_uri(table_path)
            for kind, n in _versions(table_path) if len(snapshots) > 1 else []:
                if n < snapshots[-2] or kind == "batch" and n == snapshots[-2]:
                    store.delete_dir(f"{path}/{kind}-{n:012d}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        running_state(generations).writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", state_path).trigger(**trigger).start()
    )


def read_state(spark: SparkSession, table_path: str) -> DataFrame:
    """The latest state of every run: the last snapshot and the batches since."""
    found = _versions(table_path)
    last = max((n for kind, n in found if kind == "state"), default=-1)
    read = [(kind, n) for kind, n in found if n > last or (kind, n) == ("state", last)]
    out = spark.createDataFrame([], f"{STATE}, version long")
    for kind, n in read:
        part = spark.read.schema(STATE).parquet(f"{table_path}/{kind}-{n:012d}")
        out = out.union(part.withColumn("version", F.lit(n).cast("long")))
    names = [c for c in out.columns if c not in ("Run", "version")]
    newest = out.groupBy("Run").agg(F.max_by(F.struct(*names), "version").alias("s"))
    return newest.select("Run", "s.*")


def _versions(table_path: str) -> list[tuple[str, int]]:
    """Kind and number of the finished folders, oldest first."""
    store, path = fs.FileSystem.from_uri(table_path)
    found = sorted((f.base_name for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True))
                    if f.base_name.startswith(("batch-", "state-"))), key=lambda name: name[6:])
    done = store.get_file_info([f"{path}/{name}/_SUCCESS" for name in found])
    return [(name[:5], int(name[6:])) for name, d in zip(found, done) if d.is_file]
