"""Row and column pruning, encoding, alignment."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import query, r9, rounded
from tallysift.operators import prune, records
from tallysift.sources import tables

PASSIVE = ("row_id", "split")


def labelled(spark, sf):
    return prune.drop_null_target(X.samples(spark, sf), "label")


def train_model(spark, sf):
    train = labelled(spark, sf).filter("split = 'train'")
    return prune.fit_prune(prune.drop_identifiers(train, ["id_cust"]), "label", PASSIVE)


@query("b1_null_target_counts", f"""WITH {X.SAMPLES} SELECT split, COUNT(*) FILTER (WHERE label IS NULL) AS dropped,
  COUNT(label) AS kept FROM samples GROUP BY split""")
def b1_counts(spark, sf):
    return prune.null_target_counts(X.samples(spark, sf), "label", "split")


@query("b1_drop_null_target", f"WITH {X.SAMPLES} SELECT row_id, label FROM samples WHERE label IS NOT NULL")
def b1(spark, sf):
    return labelled(spark, sf).select("row_id", "label")


@query("b2_drop_identifiers",
       f"WITH {X.SAMPLES} SELECT row_id, label, f_price, f_bal, f_nation, f_prio, f_seg, f_const, split FROM samples")
def b2(spark, sf):
    return prune.drop_identifiers(X.samples(spark, sf), ["id_cust", "f_name", "not_there"])


@query("b3_constant_columns", f"WITH {X.SAMPLES}, kept AS (SELECT * FROM samples WHERE label IS NOT NULL) "
       + " UNION ALL ".join(
           f"SELECT '{c}' AS feature, COUNT({c}) AS non_null, COUNT(DISTINCT {c}) = 1 AS constant FROM kept"
           for c in [*X.FEATURES, "f_name", "f_const"]))
def b3(spark, sf):
    return prune.column_profile(labelled(spark, sf), [*X.FEATURES, "f_name", "f_const"])


@query("b4_cardinality", f"WITH {X.SAMPLES}, kept AS (SELECT * FROM samples WHERE label IS NOT NULL AND split = 'train') "
       + " UNION ALL ".join(
           f"SELECT '{c}' AS feature, COUNT(DISTINCT {c}) > 30 AS high_cardinality, "
           f"CAST(CASE WHEN COUNT(DISTINCT {c}) <= 30 THEN COUNT(DISTINCT {c}) END AS INT) AS classes FROM kept"
           for c in ["f_prio", "f_seg", "f_name"]))
def b4(spark, sf):
    return prune.cardinality_report(spark, train_model(spark, sf))


DICTIONARY = f"""{X.SAMPLES}, train AS (SELECT * FROM samples WHERE label IS NOT NULL AND split = 'train'),
classes AS (SELECT DISTINCT 'f_prio' AS feature, COALESCE(f_prio, 'nan') AS cls FROM train
  UNION SELECT DISTINCT 'f_seg', COALESCE(f_seg, 'nan') FROM train),
dictionary AS (SELECT feature, cls, CAST(ROW_NUMBER() OVER (PARTITION BY feature ORDER BY cls) - 1 AS INT) AS idx FROM classes)"""


@query("b5_encoder", f"WITH {DICTIONARY} SELECT * FROM dictionary")
def b5(spark, sf):
    return prune.encoder_table(spark, train_model(spark, sf))


@query("b6_encode", f"""WITH {DICTIONARY} SELECT row_id, split,
  COALESCE(p.idx, -1) AS f_prio, COALESCE(s.idx, -1) AS f_seg FROM samples
  LEFT JOIN dictionary p ON p.feature = 'f_prio' AND p.cls = COALESCE(f_prio, 'nan')
  LEFT JOIN dictionary s ON s.feature = 'f_seg' AND s.cls = COALESCE(f_seg, 'nan') WHERE label IS NOT NULL""")
def b6(spark, sf):
    encoded = prune.encode(labelled(spark, sf), train_model(spark, sf))
    return encoded.select("row_id", "split", "f_prio", "f_seg")


@query("b7_align", f"""WITH {X.SAMPLES} SELECT row_id, f_price, f_bal, CAST(0 AS INT) AS f_absent FROM samples
WHERE split = 'test'""")
def b7(spark, sf):
    test = X.samples(spark, sf).filter("split = 'test'")
    return prune.align(test, ["f_price", "f_bal", "f_absent"], keep=("row_id",))


@query("b8_label_as_float",
       f"WITH {X.SAMPLES} SELECT row_id, CAST(label AS FLOAT) AS target FROM samples WHERE label IS NOT NULL")
def b8(spark, sf):
    return prune.label_as_float(labelled(spark, sf).select("row_id", "label"), "label", "target")


@query("b9_project", f"WITH {X.SAMPLES} SELECT row_id, label, f_bal, f_nation FROM samples WHERE label IS NOT NULL")
def b9(spark, sf):
    return prune.project(labelled(spark, sf), ["f_bal", "f_nation"], ("row_id", "label"))


@query("b10_report_field", f"""WITH {X.COUNTS}, shots AS (SELECT run, SUM(cnt) AS shots, COUNT(*) AS kinds FROM counts GROUP BY run)
SELECT run, 'accuracy' AS key, 'accuracy' AS metric, {r9('CAST(kinds AS DOUBLE) / shots')} AS value FROM shots
UNION ALL SELECT run, 'macro avg', 'recall', {r9('CAST(shots AS DOUBLE) / kinds')} FROM shots""")
def b10(spark, sf):
    """Odd runs keep their report under one name, even runs under the other."""
    from tallysift.operators.counts import merge_counts
    from tallysift.sources.schemas import REPORT
    sums = merge_counts(X.counts(spark, sf)).groupBy("run").agg(
        F.sum("cnt").alias("shots"), F.count(F.lit(1)).alias("kinds"))
    report = F.from_json(F.to_json(F.struct(
        F.struct((F.col("shots") / F.col("kinds")).alias("recall")).alias("macro avg"),
        (F.col("kinds") / F.col("shots")).alias("accuracy"))), REPORT)
    odd = F.col("run") % 2 == 1
    stored = sums.select("run", F.when(odd, report).alias("report"), F.when(~odd, report).alias("report_dict"))
    return rounded(records.report_lines(stored, ("run",)), "value")


@query("a11_separable_dataset", """WITH n AS (SELECT UNNEST(range(0, (SELECT COUNT(*) FROM orders))) AS i)
SELECT i AS row_id, CASE WHEN i % 2 = 0 THEN pi() ELSE CAST(0 AS DOUBLE) END AS x0,
  CASE WHEN i % 2 = 0 THEN pi() ELSE CAST(0 AS DOUBLE) END AS x1, CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END AS label FROM n""")
def a11(spark, sf):
    return tables.separable_dataset(spark, 2, X.table(spark, sf, "orders").count())
