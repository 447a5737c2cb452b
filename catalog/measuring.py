"""Measurement histograms."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import query, r9, rounded
from tallysift.functions.readout import prob_from_map
from tallysift.operators import counts as C

RUNS = 7
LABELLED = f"""labelled AS (SELECT CAST(r.run AS INT) AS run, sample_id, label
  FROM sample_labels, (SELECT UNNEST(range(1, {RUNS + 1})) AS run) r)"""
HIT = {
    "single_qubit": "right(replace(bitstring, ' ', ''), 1) = '1'",
    "parity": "length(regexp_replace(bitstring, '[^1]', '', 'g')) % 2 = 1",
}


def probs_sql(readout: str, name: str = "probs") -> str:
    return f"""{name} AS (SELECT run, sample_id,
    CAST(SUM(CASE WHEN {HIT[readout]} THEN cnt ELSE 0 END) AS DOUBLE) / CAST(SUM(cnt) AS DOUBLE) AS prob
  FROM counts GROUP BY run, sample_id)"""


def scored_sql(readout: str = "single_qubit") -> str:
    return f"""{X.COUNTS}, {X.SAMPLE_LABELS}, {LABELLED}, {probs_sql(readout)},
scored AS (SELECT l.run, l.sample_id, l.label, COALESCE(p.prob, 0) AS prob
  FROM labelled l LEFT JOIN probs p ON l.run = p.run AND l.sample_id = p.sample_id)"""


def labelled(spark, sf):
    return C.per_run(X.sample_labels(spark, sf), RUNS)


def scored(spark, sf, readout="single_qubit"):
    return C.label_probs(X.counts(spark, sf), labelled(spark, sf), readout)


@query("f1_merge_counts",
       f"WITH {X.COUNTS} SELECT run, sample_id, bitstring, CAST(cnt AS BIGINT) AS cnt FROM counts")
def f1(spark, sf):
    return C.merge_counts(X.counts(spark, sf))


@query("f2_parity_prob",
       f"WITH {X.COUNTS}, {probs_sql('parity')} SELECT run, sample_id, {r9('prob')} AS prob FROM probs")
def f2(spark, sf):
    return rounded(C.measured_probs(X.counts(spark, sf), "parity"), "prob")


@query("f3_single_qubit_prob",
       f"WITH {X.COUNTS}, {probs_sql('single_qubit')} SELECT run, sample_id, {r9('prob')} AS prob FROM probs")
def f3(spark, sf):
    return rounded(C.measured_probs(X.counts(spark, sf)), "prob")


@query("f3_prob_from_map",
       f"WITH {X.COUNTS}, {probs_sql('single_qubit')} SELECT run, sample_id, {r9('prob')} AS prob FROM probs")
def f3_map(spark, sf):
    merged = C.merge_counts(X.counts(spark, sf))
    maps = merged.groupBy("run", "sample_id").agg(
        F.map_from_entries(F.collect_list(F.struct("bitstring", "cnt"))).alias("counts"))
    return rounded(maps.select("run", "sample_id", prob_from_map(F.col("counts")).alias("prob")), "prob")


@query("f4_unmeasured_samples",
       f"WITH {scored_sql('parity')} SELECT run, sample_id, label, {r9('prob')} AS prob FROM scored")
def f4(spark, sf):
    return rounded(scored(spark, sf, "parity"), "prob")


LOSS = "-LN(CASE WHEN label = 1 THEN prob ELSE 1 - prob END + CAST(1e-10 AS DOUBLE))"


@query("f5_cross_entropy",
       f"WITH {scored_sql()} SELECT run, {r9(f'AVG({LOSS})')} AS loss, COUNT(*) AS samples FROM scored GROUP BY run")
def f5(spark, sf):
    return rounded(C.cross_entropy(scored(spark, sf)), "loss")


@query("f6_batch_log_likelihood", f"""WITH {X.COUNTS}, {probs_sql('single_qubit')},
sizes AS (SELECT COUNT(*) AS n FROM supplier),
placed AS (SELECT (run - 1) * n + sample_id AS pos, sample_id % n AS idx, prob, sample_id FROM probs, sizes)
SELECT CAST(pos AS BIGINT) AS pos, CAST(idx AS BIGINT) AS idx, {r9('prob')} AS prob,
  {r9("LN(CASE WHEN s_acctbal > 5000 THEN prob ELSE 1 - prob END + CAST(1e-10 AS DOUBLE))")} AS loglik
FROM placed JOIN supplier ON s_suppkey = sample_id""")
def f6(spark, sf):
    labels = X.sample_labels(spark, sf).filter("sample_id >= 0").select(
        F.col("sample_id").alias("idx"), "label")
    n = labels.count()
    stream = X.counts(spark, sf).withColumn("pos", (F.col("run") - 1) * F.lit(n) + F.col("sample_id"))
    return rounded(C.batch_log_likelihood(stream, labels, n), "prob", "loglik")
