"""Pooled AUC and mean ROC curve over runs that arrive batch by batch.

What is stored adds up: positives and negatives per distinct score, and per grid point the number, sum and squared
deviations of the runs' curves. A batch of runs is read once, reduced to these two tables and committed under its name; the curves and
the AUC over all runs are then sums over what is stored, without a look at earlier predictions. Committing a batch again
replaces it. ``merge_batches`` replaces many batches by their sum.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallysift.operators import roc
from tallysift.operators.running import fit_cuts, running_totals
from tallysift.sources.commits import commit_rows, committed, drop_commit, read_committed

#: Both tables in one, so that a commit has both or none: x is a score or a false-positive rate.
STORED = T.StructType([
    T.StructField("x", T.DoubleType()), T.StructField("g", T.IntegerType()), T.StructField("pos", T.LongType()),
    T.StructField("neg", T.LongType()), T.StructField("curves", T.LongType()), T.StructField("total", T.DoubleType()),
    T.StructField("squares", T.DoubleType()), T.StructField("part", T.StringType())])
SUMS = ("pos", "neg", "curves", "total", "squares")


def add_runs(predictions: DataFrame, root: str, batch: str, keys: tuple[str, ...] = roc.RUN, label: str = "label",
             score: str = "prob", points: int = roc.GRID_POINTS) -> None:
    """Commit the runs of ``predictions`` as ``batch``; a run's rows must all be in one batch."""
    ranked = roc.fit_ranked_scores(predictions, keys, label, score)
    tpr = F.col("tpr")
    curves = roc.interpolated_roc(ranked, keys, points).groupBy("g", F.col("fpr").alias("x")).agg(
        F.count(F.lit(1)).alias("curves"), F.sum(tpr).alias("total"),
        (F.var_pop(tpr) * F.count(F.lit(1))).alias("squares"))
    pooled = ranked.groupBy(F.col("threshold").alias("x")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    _commit([pooled.withColumn("part", F.lit("scores")), curves.withColumn("part", F.lit("curves"))], root, batch)


def stored_scores(spark: SparkSession, root: str) -> DataFrame:
    """Positives and negatives per distinct score of all batches."""
    found = read_committed(spark, root, STORED).where("part = 'scores'")
    return found.groupBy(F.col("x").alias("threshold")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit_stored_auc(spark: SparkSession, root: str) -> DataFrame:
    """One AUC over the predictions of all runs together."""
    groups = stored_scores(spark, root).persist()
    ranked = running_totals(groups, (), "threshold", ("pos", "neg"), fit_cuts(groups, "threshold"))
    ranked = ranked.select("threshold", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                           F.col("all_pos").alias("positives"), F.col("all_neg").alias("negatives"))
    return roc.roc_auc(ranked, ()).withColumnRenamed("roc_auc", "pooled_auc")


def stored_mean_roc(spark: SparkSession, root: str) -> DataFrame:
    """Mean and population deviation of all runs' curves, per grid point."""
    sums = _added_up(read_committed(spark, root, STORED).where("part = 'curves'"))
    return sums.select("g", F.col("x").alias("fpr"), (F.col("total") / F.col("curves")).alias("mean_tpr"),
                       F.sqrt(F.col("squares") / F.col("curves")).alias("std_tpr"), "curves")


def merge_batches(spark: SparkSession, root: str, name: str, batches: list[str]) -> None:
    """Replace ``batches`` by one batch ``name`` that holds their sum; not while others add or read."""
    there = set(committed(spark, root))
    missing = sorted(set(batches) - there)
    if missing or name in there - set(batches):
        raise ValueError(f"no such batches: {missing}" if missing else f"batch {name} is there and not among those merged")
    rows = read_committed(spark, root, STORED, batches)
    _commit([_added_up(rows)], root, name)
    for old in set(batches) - {name}:
        drop_commit(spark, root, old)


def _added_up(rows: DataFrame) -> DataFrame:
    """Batches added up; squared deviations are moved to the mean of all (Chan, Golub and LeVeque 1979)."""
    place = Window.partitionBy("part", "x", "g")
    mean = F.sum("total").over(place) / F.sum("curves").over(place)
    own = F.col("total") / F.col("curves") - F.col("mean")
    moved = rows.withColumn("mean", mean).withColumn("squares", F.col("squares") + F.col("curves") * own * own)
    return moved.groupBy("part", "x", "g").agg(*(F.sum(c).alias(c) for c in SUMS))


def _commit(parts: list[DataFrame], root: str, batch: str) -> None:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    columns = [F.col(f.name).cast(f.dataType) if f.name in whole.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STORED]
    commit_rows(whole.select(*columns), root, batch, ("part",))
