"""Baselines, candidate scoring and population search."""

from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import query, r9, rounded
from tallysift.operators import baselines, reports, scoring, search
from tallysift.plans import preprocess
from tallysift.session import scratch_dir

COLUMNS = ["quantity", "price", "discount", "tax"]
# a fixed grid of candidate vectors, four weights and a bias each
CANDIDATES = [[(i % 5 - 2) / 2.0, (i % 3 - 1) / 1.0, (i % 7 - 3) / 4.0, (i % 2) / 2.0, -0.5] for i in range(24)]
ANGLES = [[c[0], c[1], c[2], c[3]] for c in CANDIDATES]
LOSS = "LN(CASE WHEN label = 1 THEN p ELSE 1 - p END + CAST(1e-10 AS DOUBLE))"


def vectors_sql(vectors, name: str = "cands", first: int = 0) -> str:
    rows = ", ".join(f"({first + i}, " + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in c) + ")"
                     for i, c in enumerate(vectors))
    cols = ", ".join(f"w{i}" for i in range(len(vectors[0])))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) v(cand, {cols}))"


LOGISTIC = "1 / (1 + EXP(-(" + " + ".join(f"{c} * w{i}" for i, c in enumerate(COLUMNS)) + " + w4)))"
PRODUCT = " * ".join(f"POWER(SIN(({c} + w{i}) / 2), 2)" for i, c in enumerate(COLUMNS))


def fitness_sql(score: str, vectors) -> str:
    return f"""WITH {X.LINE_SAMPLES}, {vectors_sql(vectors)},
scored AS (SELECT cand, label, {score} AS p FROM line_samples, cands)
SELECT cand, {r9(f'AVG({LOSS})')} AS fitness, COUNT(*) AS samples FROM scored GROUP BY cand"""


@query("h1_logistic_baseline")
def h1(spark, sf):
    done = preprocess.prepare(X.samples(spark, sf), "label", ("row_id",), 42, ("id_cust",), split_col="split")
    model = baselines.fit_logistic(done.train, done.features)
    return baselines.logistic_predictions(model, done.test, done.features, ("row_id", "label"))


@query("h2_kernel_baseline")
def h2(spark, sf):
    done = preprocess.prepare(X.samples(spark, sf), "label", ("row_id",), 42, ("id_cust",), split_col="split")
    model = baselines.fit_kernel(done.train, done.features)
    return baselines.kernel_predictions(model, done.test, done.features, ("row_id", "label"))


# a fixed kernel model of five random features on two columns
WAVES = [(1.5, -0.5, 0.25), (0.5, 2.0, -1.0), (-1.0, 0.75, 2.0), (2.5, 1.0, 0.5), (-0.25, -1.75, 1.25)]  # frequency, frequency, phase
PULLS, SHIFT = [0.8, -1.1, 0.6, 1.4, -0.3], 0.15
WAVES_SQL = " + ".join(
    f"CAST({w!r} AS DOUBLE) * SQRT(CAST(2 AS DOUBLE) / {len(WAVES)}) * COS(quantity * {a!r} + price * {b!r} + {p!r})"
    for w, (a, b, p) in zip(PULLS, WAVES))


@query("h2_kernel_margins", f"""WITH {X.LINE_SAMPLES}, margins AS (SELECT label, {WAVES_SQL} + {SHIFT!r} AS margin FROM line_samples)
SELECT label, COUNT(*) AS samples, {r9('AVG(margin)')} AS mean, {r9('MIN(margin)')} AS least, {r9('MAX(margin)')} AS most,
  COUNT(*) FILTER (WHERE margin > 0) AS positive FROM margins GROUP BY label""")
def h2_margins(spark, sf):
    """Decision values of a fixed model; the fit itself is held to its duality gap."""
    model = baselines.KernelModel(
        tuple((a, b) for a, b, _ in WAVES), tuple(p for *_, p in WAVES),
        baselines.Separator(DenseVector(PULLS), SHIFT), (1.0, 0.0), True)
    rows = baselines.kernel_margins(model, X.line_samples(spark, sf), ["quantity", "price"])
    return rounded(rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("margin").alias("mean"), F.min("margin").alias("least"),
        F.max("margin").alias("most"), F.count_if(F.col("margin") > 0).alias("positive")), "mean", "least", "most")


@query("h2_kernel_fit")
def h2_fit(spark, sf):
    """What the kernel fit reports of itself: objective, duality gap and passes."""
    model = baselines.fit_kernel(X.line_samples(spark, sf), COLUMNS)
    return spark.createDataFrame([(model.objective, model.gap, model.passes, model.converged)],
                                 "objective double, gap double, passes int, converged boolean")


@query("h3_candidate_scores", fitness_sql(LOGISTIC, CANDIDATES))
def h3(spark, sf):
    return rounded(scoring.candidate_scores(X.line_samples(spark, sf), COLUMNS, "label", CANDIDATES), "fitness")


@query("h3_product_scores", fitness_sql(PRODUCT, ANGLES))
def h3_product(spark, sf):
    rows = X.line_samples(spark, sf)
    return rounded(scoring.candidate_scores(rows, COLUMNS, "label", ANGLES, "product"), "fitness")


@query("h3_best_candidate", f"""WITH scores AS ({fitness_sql(LOGISTIC, CANDIDATES)})
SELECT cand, fitness FROM scores ORDER BY fitness DESC, cand LIMIT 1""")
def h3_best(spark, sf):
    scores = scoring.candidate_scores(X.line_samples(spark, sf), COLUMNS, "label", CANDIDATES)
    return scoring.best_candidate(rounded(scores, "fitness"))


def population(spark, sf, method):
    return search.fit_population(
        X.line_samples(spark, sf), COLUMNS, "label", method=method, runs=2, base_seed=42, dimensions=5)


@query("h4_particle_swarm")
def h4_swarm(spark, sf):
    return population(spark, sf, "PSO").history


@query("h4_differential_evolution")
def h4_evolution(spark, sf):
    return population(spark, sf, "DE").history


@query("h4_resumed_swarm")
def h4_resumed(spark, sf):
    """Ten generations, their state stored and read again, and ten more."""
    rows, path = X.line_samples(spark, sf), scratch_dir(spark, "search")
    args = dict(method="PSO", runs=2, base_seed=42, dimensions=5)
    first = search.fit_population(rows, COLUMNS, "label", generations=10, **args)
    first.resume.write.parquet(path)
    rest = search.fit_population(rows, COLUMNS, "label", generations=20, resume=spark.read.parquet(path), **args)
    return first.history.unionByName(rest.history)


RUN_VECTORS = {r + 1: v for r, v in enumerate(CANDIDATES[5:8])}


@query("h5_independent_runs", f"""WITH {X.LINE_SAMPLES}, {vectors_sql(list(RUN_VECTORS.values()), first=1)},
scored AS (SELECT cand AS run, label, CASE WHEN {LOGISTIC} >= 0.5 THEN 1 ELSE 0 END AS predicted FROM line_samples, cands),
{X.confusion_sql('scored')} SELECT run, tn, fp, fn, tp FROM confusion""")
def h5(spark, sf):
    rows = scoring.predict(X.line_samples(spark, sf), COLUMNS, RUN_VECTORS)
    return reports.confusion(rows.withColumn("predicted", (F.col("prob") >= 0.5).cast("int")))


@query("h5_run_seeds", """SELECT CAST(r AS INT) AS run, CAST(41 + r AS INT) AS seed, COUNT(*) AS rows
FROM lineitem, (SELECT UNNEST(range(1, 6)) AS r) GROUP BY r""")
def h5_seeds(spark, sf):
    runs = scoring.run_table(X.line_samples(spark, sf), 5, 42)
    return runs.groupBy("run", "seed").agg(F.count(F.lit(1)).alias("rows"))
