"""Training logs as streams; the log files are rendered from the event history first."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import query
from tallysift.session import scratch_dir
from tallysift.streaming import training_log as T

PAIRS = f"""{X.HISTORY}, pairs AS (SELECT f.Run, f.Epoch, f.Value AS fitness, m.Value AS mean_best FROM history f
  JOIN history m ON f.Run = m.Run AND f.Epoch = m.Epoch AND f.Metric = 'fitness' AND m.Metric = 'mean_best')"""
LONG = """SELECT Run, Epoch, 'fitness' AS Metric, fitness AS Value FROM pairs
UNION ALL SELECT Run, Epoch, 'mean_best', mean_best FROM pairs"""


def write_logs(spark, sf) -> str:
    """Log folders per run: a generation line and a line of chatter for each epoch."""
    path = scratch_dir(spark, "logs")
    wide = X.history(spark, sf).groupBy("Run", "Epoch").pivot("Metric", ["fitness", "mean_best"]).agg(
        F.first("Value")).dropna()
    line = F.concat(F.lit("Generation "), "Epoch", F.lit(": swarm moved, BestFitness: "), "fitness",
                    F.lit(", MeanBest: "), "mean_best")
    chatter = F.concat(F.lit("checkpoint saved after "), "Epoch")
    (wide.select("Run", F.explode(F.array(line, chatter)).alias("value"))
     .repartition(2).write.partitionBy("Run").text(path))
    return path


@query("j1_parse_log", f"WITH {PAIRS} {LONG}")
def j1(spark, sf):
    lines = T.read_log(spark, write_logs(spark, sf), stream=False)
    return T.generation_history(T.parse_generations(lines))


@query("j2_append_stream", f"WITH {PAIRS} {LONG}")
def j2(spark, sf):
    """Two runs of the query on one state: the second finds nothing new and appends nothing."""
    logs, out, state = write_logs(spark, sf), scratch_dir(spark, "history"), scratch_dir(spark, "state")
    for _ in range(2):
        T.append_generations(spark, logs, out, state).awaitTermination()
    return spark.read.parquet(out).select("Run", "Epoch", "Metric", "Value")


@query("j3_running_state", f"""WITH {PAIRS} SELECT Run, MAX(fitness) AS best, MAX(Epoch) AS last_epoch,
  arg_max(fitness, Epoch) AS last_fitness, COUNT(*) AS generations FROM pairs GROUP BY Run""")
def j3(spark, sf):
    logs, table = write_logs(spark, sf), scratch_dir(spark, "running")
    T.track_state(spark, logs, table, scratch_dir(spark, "state")).awaitTermination()
    return T.read_state(spark, table)
