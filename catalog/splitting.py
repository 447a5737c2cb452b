"""Exact sampling and splitting, imputation, scaling, components."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.pruning import labelled
from catalog.registry import query, r9, rounded
from tallysift.operators import components, scale, split
from tallysift.plans import preprocess

SEED = 42
CAP = 900
NUMERIC = ["f_price", "f_bal", "f_nation"]


def quota_sql(source: str, take: str, name: str) -> str:
    """Row ids of ``source`` inside the stratified quota: what the other part leaves to each class."""
    return f"""{name}_sizes AS (SELECT label, COUNT(*) AS n FROM {source} GROUP BY label),
{name}_total AS (SELECT CAST(SUM(n) AS BIGINT) AS total, CAST({take} AS BIGINT) AS take FROM {name}_sizes),
{name}_shares AS (SELECT label, n, total - take AS others, CAST(n AS DOUBLE) * (total - take) / total AS exact FROM {name}_sizes, {name}_total),
{name}_ranks AS (SELECT *, ROW_NUMBER() OVER (ORDER BY FLOOR(exact) - exact, label) AS place,
  others - SUM(CAST(FLOOR(exact) AS BIGINT)) OVER () AS spare FROM {name}_shares),
{name}_quota AS (SELECT label, n - CAST(FLOOR(exact) AS BIGINT) - CASE WHEN place <= spare THEN 1 ELSE 0 END AS quota FROM {name}_ranks),
{name}_order AS (SELECT row_id, label, ROW_NUMBER() OVER (PARTITION BY label
  ORDER BY md5(concat('{SEED}|', CAST(row_id AS VARCHAR))), CAST(row_id AS VARCHAR)) AS place FROM {source}),
{name} AS (SELECT o.row_id, o.label, o.place <= q.quota AS inside FROM {name}_order o JOIN {name}_quota q ON o.label = q.label)"""


KEPT = f"{X.SAMPLES}, kept AS (SELECT * FROM samples WHERE label IS NOT NULL)"


@query("c1_cap_rows", f"WITH {KEPT}, {quota_sql('kept', str(CAP), 'cap')} SELECT row_id, label FROM cap WHERE inside")
def c1(spark, sf):
    rows = labelled(spark, sf).select("row_id", "label")
    return split.cap_rows(rows, split.fit_strata(rows, "label", ("row_id",), SEED, rows=CAP))


SPLIT = f"{KEPT}, {quota_sql('kept', 'CEIL(SUM(n) * CAST(0.2 AS DOUBLE))', 'cut')}"


@query("c2_stratified_split",
       f"WITH {SPLIT} SELECT row_id, label, CASE WHEN inside THEN 'test' ELSE 'train' END AS split FROM cut")
def c2(spark, sf):
    rows = labelled(spark, sf).select("row_id", "label")
    return split.assign_split(rows, split.fit_strata(rows, "label", ("row_id",), SEED, fraction=0.2))


DOCUMENTS = """docs AS (SELECT d.doc_id AS row_id, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


@query("c2_imbalanced_split", f"""WITH {DOCUMENTS}, {quota_sql('docs', 'CEIL(SUM(n) * CAST(0.3 AS DOUBLE))', 'cut')}
SELECT row_id, label, CASE WHEN inside THEN 'test' ELSE 'train' END AS split FROM cut""")
def c2_documents(spark, sf):
    rows = X.documents_labelled(spark, sf).select("row_id", "label")
    return split.assign_split(rows, split.fit_strata(rows, "label", ("row_id",), SEED, fraction=0.3))


@query("c3_class_balance", f"""WITH {SPLIT}, parts AS (SELECT CASE WHEN inside THEN 'test' ELSE 'train' END AS split, label FROM cut)
SELECT split, label, COUNT(*) AS n, ROUND(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY split), 3) AS share
FROM parts GROUP BY split, label""")
def c3(spark, sf):
    return split.class_balance(c2(spark, sf), "label")


TRAIN = f"{KEPT}, train AS (SELECT * FROM kept WHERE split = 'train')"
BOUNDS = f"{TRAIN}, bounds AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(MEDIAN(CAST({c} AS DOUBLE)) AS DOUBLE) AS median, "
    f"CAST(MIN({c}) AS DOUBLE) AS lo, CAST(MAX({c}) AS DOUBLE) AS hi FROM train" for c in NUMERIC) + ")"


def scaling(spark, sf):
    return scale.fit_scale(labelled(spark, sf).filter("split = 'train'"), NUMERIC)


@query("d1_medians", f"WITH {BOUNDS} SELECT feature, {r9('median')} AS median, lo, hi FROM bounds")
def d1_fit(spark, sf):
    return rounded(scale.scale_table(spark, scaling(spark, sf)), "median")


def filled_sql(c: str) -> str:
    return f"COALESCE(CAST({c} AS DOUBLE), (SELECT median FROM bounds WHERE feature = '{c}'))"


@query("d1_impute", f"WITH {BOUNDS} SELECT row_id, split, "
       + ", ".join(f"{r9(filled_sql(c))} AS {c}" for c in NUMERIC) + " FROM kept")
def d1(spark, sf):
    rows = labelled(spark, sf).select("row_id", "split", *NUMERIC)
    return rounded(scale.impute(rows, scaling(spark, sf)), *NUMERIC)


def scaled_sql(c: str) -> str:
    bound = lambda b: f"(SELECT {b} FROM bounds WHERE feature = '{c}')"
    return (f"({filled_sql(c)} - {bound('lo')}) * pi() / "
            f"CASE WHEN {bound('hi')} = {bound('lo')} THEN 1 ELSE {bound('hi')} - {bound('lo')} END")


@query("d2_scale", f"WITH {BOUNDS} SELECT row_id, split, "
       + ", ".join(f"{r9(scaled_sql(c))} AS {c}" for c in NUMERIC) + " FROM kept")
def d2(spark, sf):
    rows = labelled(spark, sf).select("row_id", "split", *NUMERIC)
    return rounded(scale.impute_and_scale(rows, scaling(spark, sf)), *NUMERIC)


CLASSES = """classes AS (SELECT DISTINCT 'f_prio' AS feature, COALESCE(f_prio, 'nan') AS cls FROM {0}
  UNION SELECT DISTINCT 'f_seg', COALESCE(f_seg, 'nan') FROM {0}),
dictionary AS (SELECT feature, cls, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY cls) - 1 AS idx FROM classes),
encoded AS (SELECT k.row_id, k.label, k.split, f_price, f_bal, CAST(f_nation AS DOUBLE) AS f_nation,
  CAST(COALESCE(p.idx, -1) AS DOUBLE) AS f_prio, CAST(COALESCE(s.idx, -1) AS DOUBLE) AS f_seg FROM kept k
  LEFT JOIN dictionary p ON p.feature = 'f_prio' AND p.cls = COALESCE(f_prio, 'nan')
  LEFT JOIN dictionary s ON s.feature = 'f_seg' AND s.cls = COALESCE(f_seg, 'nan'))"""


def prepared_sql(train: str, rows: str) -> str:
    """Scaled features of ``rows`` with parameters from ``train`` (both with a split column)."""
    bound = ", ".join(
        f"MEDIAN({c}) AS {c}_m, MIN({c}) AS {c}_a, MAX({c}) AS {c}_b" for c in X.FEATURES)
    cols = ", ".join(
        f"{r9(f'(COALESCE({c}, {c}_m) - {c}_a) * pi() / CASE WHEN {c}_a = {c}_b THEN 1 ELSE {c}_b - {c}_a END')} AS {c}"
        for c in X.FEATURES)
    return f"""fitted AS (SELECT {bound} FROM {train}), prepared AS (
  SELECT row_id, split, CAST(label AS FLOAT) AS label, {cols} FROM {rows}, fitted)"""


@query("d2_prepare_pair", f"WITH {TRAIN}, {CLASSES.format('train')}, "
       f"encoded_train AS (SELECT * FROM encoded WHERE split = 'train'), "
       f"{prepared_sql('encoded_train', 'encoded')} SELECT * FROM prepared")
def d2_pair(spark, sf):
    done = preprocess.prepare(X.samples(spark, sf), "label", ("row_id",), SEED, ("id_cust",), split_col="split")
    return rounded(done.table.select("row_id", "split", "label", *X.FEATURES), *X.FEATURES)


@query("d2_prepare_single", f"WITH {SPLIT}, {CLASSES.format('kept')}, "
       "placed AS (SELECT e.* EXCLUDE (split), CASE WHEN inside THEN 'test' ELSE 'train' END AS split "
       "FROM encoded e JOIN cut c ON e.row_id = c.row_id), "
       "placed_train AS (SELECT * FROM placed WHERE split = 'train'), "
       f"{prepared_sql('placed_train', 'placed')} SELECT * FROM prepared")
def d2_single(spark, sf):
    done = preprocess.prepare(X.samples(spark, sf).drop("split"), "label", ("row_id",), SEED, ("id_cust",))
    return rounded(done.table.select("row_id", "split", "label", *X.FEATURES), *X.FEATURES)


COMPONENTS = 4


@query("d3_components")
def d3(spark, sf):
    rows = X.vectors(spark, sf)
    model = components.fit_array_components(rows.filter(F.col("row_id") % 5 != 0), "embedding", COMPONENTS)
    return components.array_to_components(rows, "embedding", model, ("row_id", "label"))


@query("d4_explained_variance")
def d4(spark, sf):
    rows = X.vectors(spark, sf)
    model = components.fit_array_components(rows.filter(F.col("row_id") % 5 != 0), "embedding", COMPONENTS)
    lines = [(n, v) for n, v in zip(model.names, model.explained)] + [("total", model.explained_total)]
    return spark.createDataFrame(lines, "component string, explained double")


MOMENTS = f"""{X.LINE_SAMPLES}, m AS (SELECT AVG(quantity) AS mq, AVG(price) AS mp FROM line_samples),
s AS (SELECT SUM((quantity - mq) * (quantity - mq)) AS a, SUM((quantity - mq) * (price - mp)) AS b,
  SUM((price - mp) * (price - mp)) AS c FROM line_samples, m),
ev AS (SELECT *, (a + c) / 2 + SQRT((a - c) * (a - c) / 4 + b * b) AS l1, (a + c) / 2 - SQRT((a - c) * (a - c) / 4 + b * b) AS l2 FROM s)"""


@query("d4_two_columns", f"""WITH {MOMENTS} SELECT 'PC1' AS component, {r9('l1 / (l1 + l2)')} AS explained FROM ev
UNION ALL SELECT 'PC2', {r9('l2 / (l1 + l2)')} FROM ev""")
def d4_two(spark, sf):
    """Two columns have their eigenvalues in closed form."""
    model = components.fit_components(X.line_samples(spark, sf), ["quantity", "price"], 2)
    return rounded(spark.createDataFrame(list(zip(model.names, model.explained)), "component string, explained double"), "explained")


# the first eigenvector is (b, l1 - a), signed by its larger coordinate
@query("d3_two_columns", f"""WITH {MOMENTS}, v AS (SELECT mq, mp, SIGN(CASE WHEN ABS(b) >= ABS(l1 - a) THEN b ELSE l1 - a END)
  / SQRT(b * b + (l1 - a) * (l1 - a)) AS f, b, l1 - a AS d FROM ev, m),
p AS (SELECT label, f * (b * (quantity - mq) + d * (price - mp)) AS pc1 FROM line_samples, v)
SELECT label, COUNT(*) AS samples, {r9('AVG(pc1)')} AS mean, {r9('VAR_POP(pc1)')} AS spread, {r9('MIN(pc1)')} AS least,
  {r9('MAX(pc1)')} AS most FROM p GROUP BY label""")
def d3_two(spark, sf):
    rows = X.line_samples(spark, sf)
    model = components.fit_components(rows, ["quantity", "price"], 2)
    out = components.to_components(rows, model, ("label",)).groupBy("label").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("PC1").alias("mean"), F.var_pop("PC1").alias("spread"),
        F.min("PC1").alias("least"), F.max("PC1").alias("most"))
    return rounded(out, "mean", "spread", "least", "most")
