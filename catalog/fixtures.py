"""Inputs derived from the given tables, as DataFrames and as SQL common table expressions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["f_price", "f_bal", "f_nation", "f_prio", "f_seg"]
LINE_FEATURES = ["quantity", "price", "discount", "tax", "line", "part", "supplier", "ship"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with missing labels and values, a constant, an identifier and a ready split."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    high = F.col("o_totalprice") * (1 + F.col("c_nationkey") / F.lit(50.0)) > 300000
    return rows.select(
        key.alias("row_id"),
        F.when(key % 97 == 0, None).when(high | F.col("o_orderpriority").startswith("1"), 1)
        .otherwise(0).alias("label"),
        F.when(key % 13 != 0, F.col("o_totalprice")).alias("f_price"),
        F.col("c_acctbal").alias("f_bal"),
        F.col("c_nationkey").alias("f_nation"),
        F.when(key % 11 != 0, F.col("o_orderpriority")).alias("f_prio"),
        F.when(key % 35 == 0, "UNSEEN").otherwise(F.col("c_mktsegment")).alias("f_seg"),
        F.col("c_name").alias("f_name"),
        F.lit("SYS").alias("f_const"),
        F.col("o_custkey").alias("id_cust"),
        F.when(key % 5 == 0, "test").otherwise("train").alias("split"),
    )


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmerged measurement counts: equal bitstrings of a sample come in several rows."""
    item = table(spark, sf_dir, "lineitem")
    bits = F.concat(
        F.when(F.col("l_discount") > 0.055, "1").otherwise("0"),
        F.when(F.col("l_partkey") % 2 == 0, " ").otherwise(""),
        F.when(F.col("l_tax") > 0.045, "1").otherwise("0"),
        F.when(F.col("l_quantity") > 25, "1").otherwise("0"),
    )
    return item.groupBy(
        F.col("l_linenumber").alias("run"), F.col("l_suppkey").alias("sample_id"),
        bits.alias("bitstring"), "l_returnflag",
    ).agg(F.count(F.lit(1)).alias("cnt")).drop("l_returnflag")


def sample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label per sample; sample -1 was never measured."""
    measured = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("sample_id"), F.when(F.col("s_acctbal") > 5000, 1).otherwise(0).alias("label"))
    extra = spark.sql("SELECT CAST(-1 AS BIGINT) AS sample_id, 1 AS label")
    return measured.unionByName(extra)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows of five runs; scores are cut to two places, so ties abound."""
    event = table(spark, sf_dir, "events")
    positive = F.col("event_type").isin("purchase", "signup") | (
        (F.col("value") > 40) & (F.col("event_id") % 2 == 0))
    return event.select(
        (F.col("user_id") % 5 + 1).cast("int").alias("run"), "event_id",
        F.when(positive, 1).otherwise(0).alias("label"),
        (F.floor(F.col("value") / (F.col("value") + 20) * 100) / 100).alias("prob"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training history of five runs with a closing loss each."""
    event = table(spark, sf_dir, "events").withColumn("Run", (F.col("user_id") % 5 + 1).cast("int"))
    rows = event.filter(F.col("event_type") != "error").groupBy(
        "Run", F.dayofmonth("ts").alias("Epoch"),
        F.when(F.col("event_type").isin("view", "click"), "fitness").otherwise("mean_best").alias("Metric"),
    ).agg(F.min("value").alias("Value"))
    closing = event.filter(F.col("event_type") == "error").groupBy("Run").agg(
        F.min("value").alias("Value")).select(
        "Run", F.lit(31).alias("Epoch"), F.lit("final_loss").alias("Metric"), "Value")
    return rows.unionByName(closing)


def documents_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small imbalanced table."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("quality").alias("label"), F.col("lang").alias("f_lang"),
        F.col("source").alias("f_source"), F.col("n_chars").alias("f_chars"), F.col("toxic").alias("f_toxic"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide numeric rows held as arrays."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), "embedding",
        F.when(F.col("label") < 5, 0).otherwise(1).alias("label"))


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest table as labelled numeric samples."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_extendedprice") / 100000).alias("price"),
        (F.col("l_discount") * 10).alias("discount"), (F.col("l_tax") * 10).alias("tax"),
        F.col("l_linenumber").cast("double").alias("line"), F.col("l_partkey").cast("double").alias("part"),
        F.col("l_suppkey").cast("double").alias("supplier"),
        F.month("l_shipdate").cast("double").alias("ship"),
        F.when((F.col("l_returnflag") == "R") | (F.col("l_quantity") > 40), 1).otherwise(0).alias("label"))


SAMPLES = """samples AS (SELECT o_orderkey AS row_id,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL
       WHEN o_totalprice * (1 + c_nationkey / CAST(50 AS DOUBLE)) > 300000 OR o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS label,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS f_price,
  c_acctbal AS f_bal, c_nationkey AS f_nation,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS f_prio,
  CASE WHEN o_orderkey % 35 = 0 THEN 'UNSEEN' ELSE c_mktsegment END AS f_seg,
  c_name AS f_name, 'SYS' AS f_const, o_custkey AS id_cust,
  CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split
FROM orders JOIN customer ON o_custkey = c_custkey)"""

COUNTS = """counts AS (SELECT CAST(l_linenumber AS INT) AS run, l_suppkey AS sample_id,
  concat(CASE WHEN l_discount > 0.055 THEN '1' ELSE '0' END, CASE WHEN l_partkey % 2 = 0 THEN ' ' ELSE '' END,
         CASE WHEN l_tax > 0.045 THEN '1' ELSE '0' END, CASE WHEN l_quantity > 25 THEN '1' ELSE '0' END) AS bitstring,
  count(*) AS cnt FROM lineitem GROUP BY 1, 2, 3)"""

SAMPLE_LABELS = """sample_labels AS (
  SELECT s_suppkey AS sample_id, CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END AS label FROM supplier
  UNION ALL SELECT -1 AS sample_id, 1 AS label)"""

PREDICTIONS = """predictions AS (SELECT CAST(user_id % 5 + 1 AS INT) AS run, event_id,
  CASE WHEN event_type IN ('purchase', 'signup') OR (value > 40 AND event_id % 2 = 0) THEN 1 ELSE 0 END AS label,
  floor(value / (value + 20) * 100) / 100 AS prob FROM events)"""

HISTORY = """history AS (
  SELECT CAST(user_id % 5 + 1 AS INT) AS Run, CAST(day(ts) AS INT) AS Epoch,
    CASE WHEN event_type IN ('view', 'click') THEN 'fitness' ELSE 'mean_best' END AS Metric, min(value) AS Value
  FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3
  UNION ALL SELECT CAST(user_id % 5 + 1 AS INT) AS Run, 31 AS Epoch, 'final_loss' AS Metric, min(value) AS Value
  FROM events WHERE event_type = 'error' GROUP BY 1)"""

LINE_SAMPLES = """line_samples AS (SELECT l_quantity / 50 AS quantity, l_extendedprice / 100000 AS price,
  l_discount * 10 AS discount, l_tax * 10 AS tax, CAST(l_linenumber AS DOUBLE) AS line,
  CAST(l_partkey AS DOUBLE) AS part, CAST(l_suppkey AS DOUBLE) AS supplier,
  CAST(month(l_shipdate) AS DOUBLE) AS ship,
  CASE WHEN l_returnflag = 'R' OR l_quantity > 40 THEN 1 ELSE 0 END AS label FROM lineitem)"""


def ranked_sql(source: str, name: str = "ranked", keys: str = "run") -> str:
    """Score groups of ``source`` (keys, label, prob) with running counts; name of the last CTE given."""
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""{name}_groups AS (SELECT {lead}prob AS threshold,
    COUNT(*) FILTER (WHERE label = 1) AS pos, COUNT(*) FILTER (WHERE label <> 1) AS neg
  FROM {source} GROUP BY {lead}prob),
{name} AS (SELECT *, CAST(SUM(pos) OVER ({part} ORDER BY threshold DESC) AS BIGINT) AS tp,
    CAST(SUM(neg) OVER ({part} ORDER BY threshold DESC) AS BIGINT) AS fp,
    CAST(SUM(pos) OVER ({part}) AS BIGINT) AS positives, CAST(SUM(neg) OVER ({part}) AS BIGINT) AS negatives
  FROM {name}_groups)"""


def youden_sql(ranked: str = "ranked", name: str = "youden") -> str:
    """Threshold per run: first of the best points of the curve that starts at (infinity, 0, 0)."""
    return f"""{name}_curve AS (
  SELECT run, threshold, CAST(tp AS HUGEINT) * negatives - CAST(fp AS HUGEINT) * positives AS gain, positives, negatives
  FROM {ranked} UNION ALL
  SELECT run, CAST('inf' AS DOUBLE), 0, max(positives), max(negatives) FROM {ranked} GROUP BY run),
{name}_first AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY gain DESC, threshold DESC) AS place FROM {name}_curve),
{name} AS (SELECT run, CASE WHEN positives = 0 OR negatives = 0 THEN CAST(0.5 AS DOUBLE) ELSE threshold END AS threshold
  FROM {name}_first WHERE place = 1)"""


def confusion_sql(predicted: str, name: str = "confusion", keys: str = "run") -> str:
    return f"""{name} AS (SELECT {keys},
    COUNT(*) FILTER (WHERE label = 0 AND predicted = 0) AS tn, COUNT(*) FILTER (WHERE label = 0 AND predicted = 1) AS fp,
    COUNT(*) FILTER (WHERE label = 1 AND predicted = 0) AS fn, COUNT(*) FILTER (WHERE label = 1 AND predicted = 1) AS tp
  FROM {predicted} GROUP BY {keys})"""


def ratio(part: str, whole: str) -> str:
    return f"COALESCE(CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0), 0)"


def class_lines_sql(counts: str = "confusion", name: str = "lines", keys: str = "run") -> str:
    return f"""{name} AS (
  SELECT {keys}, 'Negative (0)' AS key, {ratio('tn', 'tn + fn')} AS precision, {ratio('tn', 'tn + fp')} AS recall,
    {ratio('2 * tn', '2 * tn + fp + fn')} AS f1, CAST(tn + fp AS DOUBLE) AS support FROM {counts}
  UNION ALL
  SELECT {keys}, 'Positive (1)', {ratio('tp', 'tp + fp')}, {ratio('tp', 'tp + fn')},
    {ratio('2 * tp', '2 * tp + fp + fn')}, CAST(tp + fn AS DOUBLE) FROM {counts})"""


def average_lines_sql(lines: str = "lines", name: str = "averages", keys: str = "run") -> str:
    return f"""{name} AS (
  SELECT {keys}, 'macro avg' AS key, AVG(precision) AS precision, AVG(recall) AS recall, AVG(f1) AS f1, SUM(support) AS support
  FROM {lines} GROUP BY {keys} UNION ALL
  SELECT {keys}, 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
    SUM(f1 * support) / SUM(support), SUM(support) FROM {lines} GROUP BY {keys})"""


def auc_sql(source: str, name: str = "auc", keys: str = "run") -> str:
    """AUC from average ranks (Mann-Whitney)."""
    part = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""{name}_ranks AS (SELECT *, RANK() OVER ({part}ORDER BY prob) AS low,
    COUNT(*) OVER ({part}ORDER BY prob RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high FROM {source}),
{name} AS (SELECT {lead}CASE WHEN COUNT(*) FILTER (WHERE label = 1) = 0 OR COUNT(*) FILTER (WHERE label = 0) = 0
    THEN CAST('nan' AS DOUBLE) ELSE
    (SUM((low + high) / CAST(2 AS DOUBLE)) FILTER (WHERE label = 1)
      - COUNT(*) FILTER (WHERE label = 1) * (COUNT(*) FILTER (WHERE label = 1) + 1) / CAST(2 AS DOUBLE))
    / (CAST(COUNT(*) FILTER (WHERE label = 1) AS DOUBLE) * COUNT(*) FILTER (WHERE label = 0)) END AS roc_auc
  FROM {name}_ranks {group})"""
