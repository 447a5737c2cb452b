"""Binning, mutual information and least-energy subsets."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.pruning import labelled
from catalog.registry import query, r9, rounded
from tallysift.operators import mutual_info as M
from tallysift.operators import branch_bound, subset
from tallysift.plans import reduce

ALPHAS = [0.25, 0.5, 0.75, 0.95]
NUMERIC = ["f_price", "f_bal", "f_nation"]
KEPT = f"{X.SAMPLES}, kept AS (SELECT * FROM samples WHERE label IS NOT NULL)"


def edges_sql(columns, source: str, method: str = "quantile") -> str:
    """One-row CTE ``edges`` with a list of distinct edges per column."""
    if method == "quantile":
        probs = "[" + ", ".join(f"{i}/CAST(20 AS DOUBLE)" for i in range(21)) + "]"
        cols = [f"list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), {probs}))) AS {c}" for c in columns]
    else:
        width = "(CAST(MAX({c}) AS DOUBLE) - MIN({c}))"
        cols = [
            (f"list_transform(range(0, 21), lambda i: CASE WHEN i = 20 THEN CAST(MAX({c}) AS DOUBLE) "
             f"ELSE i * ({width} / 20) + MIN({c}) END) AS {c}").format(c=c)
            for c in columns
        ]
    return f"edges AS (SELECT {', '.join(cols)} FROM {source})"


def bin_sql(c: str) -> str:
    value = f"CAST(k.{c} AS DOUBLE)"
    below = f"len(list_filter(e.{c}, lambda v: v < {value}))"
    return f"CAST(CASE WHEN k.{c} IS NULL THEN -1 ELSE GREATEST(0, {below} - 1) END AS INT) AS {c}"


def binned_sql(columns, source: str, keep: str, method: str = "quantile") -> str:
    bins = ", ".join(bin_sql(c) for c in columns)
    return f"{edges_sql(columns, source, method)}, binned AS (SELECT {keep}, {bins} FROM {source} k, edges e)"


def pair_mi_sql(a: str, b: str) -> str:
    """Mutual information of two columns of ``binned`` from joint and marginal shares."""
    return f"""(SELECT GREATEST(0, SUM(n / t * LN(n * t / (na * nb)))) FROM (
      SELECT CAST(n AS DOUBLE) AS n, CAST(SUM(n) OVER () AS DOUBLE) AS t,
        CAST(SUM(n) OVER (PARTITION BY a) AS DOUBLE) AS na, CAST(SUM(n) OVER (PARTITION BY b) AS DOUBLE) AS nb
      FROM (SELECT {a} AS a, {b} AS b, COUNT(*) AS n FROM binned GROUP BY 1, 2)))"""


def importance_sql(columns, label: str = "label") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {pair_mi_sql(c, label)} AS mi" for c in columns)


def redundancy_sql(columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS f1, '{b}' AS f2, {pair_mi_sql(a, b)} AS mi"
        for i, a in enumerate(columns) for b in columns[i + 1:])


SAMPLE_BINS = f"{KEPT}, {binned_sql(NUMERIC, 'kept', 'row_id, label')}"
LINE_BINS = f"{X.LINE_SAMPLES}, {binned_sql(X.LINE_FEATURES, 'line_samples', 'label')}"


def line_bins(spark, sf):
    rows = X.line_samples(spark, sf)
    return M.bin_columns(rows, M.fit_bin_edges(rows, X.LINE_FEATURES))


def line_tables(spark, sf):
    mi = M.relevance_and_redundancy(line_bins(spark, sf), X.LINE_FEATURES, "label")
    return subset.fit_mi_tables(mi, X.LINE_FEATURES, "label")


@query("e1_quantile_bins", f"WITH {KEPT}, {binned_sql(['f_bal', 'f_nation'], 'kept', 'row_id')} SELECT * FROM binned")
def e1(spark, sf):
    rows = labelled(spark, sf).select("row_id", "f_bal", "f_nation")
    return M.bin_columns(rows, M.fit_bin_edges(rows, ["f_bal", "f_nation"]))


@query("e2_equal_width_bins", f"WITH {KEPT}, {binned_sql(['f_bal', 'f_nation'], 'kept', 'row_id', 'width')} SELECT * FROM binned")
def e2(spark, sf):
    rows = labelled(spark, sf).select("row_id", "f_bal", "f_nation")
    return M.bin_columns(rows, M.fit_bin_edges(rows, ["f_bal", "f_nation"], method="width"))


@query("e3_missing_bin", f"""WITH {SAMPLE_BINS} SELECT f_price AS bin, COUNT(*) AS n FROM binned GROUP BY 1
UNION ALL SELECT -2, COUNT(*) FROM kept""")
def e3(spark, sf):
    rows = labelled(spark, sf).select("row_id", "f_price", F.lit(None).cast("double").alias("f_none"))
    binned = M.bin_columns(rows, M.fit_bin_edges(rows, ["f_price", "f_none"]))
    price = binned.groupBy(F.col("f_price").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    none = binned.groupBy((F.col("f_none") - 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return price.unionByName(none)


@query("e4_importance", f"WITH {LINE_BINS}, mi AS ({importance_sql(X.LINE_FEATURES)}) SELECT feature, {r9('mi')} AS mi FROM mi")
def e4(spark, sf):
    return rounded(M.importance(line_bins(spark, sf), X.LINE_FEATURES, "label"), "mi")


DOCS = """docs AS (SELECT CAST(n_chars AS DOUBLE) AS f_chars, CAST(toxic AS DOUBLE) AS f_toxic, quality AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


@query("e4_importance_imbalanced", f"WITH {DOCS}, {binned_sql(['f_chars', 'f_toxic'], 'docs', 'label')}, "
       f"mi AS ({importance_sql(['f_chars', 'f_toxic'])}) SELECT feature, {r9('mi')} AS mi FROM mi")
def e4_documents(spark, sf):
    rows = X.documents_labelled(spark, sf)
    binned = M.bin_columns(rows, M.fit_bin_edges(rows, ["f_chars", "f_toxic"]))
    return rounded(M.importance(binned, ["f_chars", "f_toxic"], "label"), "mi")


@query("e5_redundancy", f"WITH {LINE_BINS}, mi AS ({redundancy_sql(X.LINE_FEATURES)}) SELECT f1, f2, {r9('mi')} AS mi FROM mi")
def e5(spark, sf):
    return rounded(M.redundancy(line_bins(spark, sf), X.LINE_FEATURES), "mi")


@query("e5_relevance_and_redundancy", f"""WITH {LINE_BINS}, mi AS ({redundancy_sql([*X.LINE_FEATURES, 'label'])})
SELECT f1, f2, {r9('mi')} AS mi FROM mi""")
def e5_joint(spark, sf):
    return rounded(M.relevance_and_redundancy(line_bins(spark, sf), X.LINE_FEATURES, "label"), "mi")


ALPHA_LIST = ", ".join(f"({a})" for a in ALPHAS)
QUBO = f"""{LINE_BINS}, single AS ({importance_sql(X.LINE_FEATURES)}), paired AS ({redundancy_sql(X.LINE_FEATURES)}),
alphas AS (SELECT CAST(a AS DOUBLE) AS alpha FROM (VALUES {ALPHA_LIST}) v(a)),
raw AS (SELECT alpha, feature AS f1, feature AS f2, mi, -alpha * mi AS raw FROM single, alphas
  UNION ALL SELECT alpha, f1, f2, mi, 2 * (1 - alpha) * mi FROM paired, alphas),
mu AS (SELECT alpha, CASE WHEN MAX(raw) > 0 THEN MAX(raw) ELSE 1 END AS mu FROM raw GROUP BY alpha),
qubo AS (SELECT raw.alpha, f1, f2,
  CASE WHEN f1 = f2 AND raw.alpha * mi < CAST(1e-8 AS DOUBLE) THEN mu ELSE raw END AS coef FROM raw JOIN mu ON raw.alpha = mu.alpha)"""


@query("e6_qubo_coefficients", f"WITH {QUBO} SELECT alpha, f1, f2, {r9('coef')} AS coef FROM qubo")
def e6(spark, sf):
    mi = M.relevance_and_redundancy(line_bins(spark, sf), X.LINE_FEATURES, "label")
    return rounded(subset.qubo_coefficients(mi, "label", ALPHAS), "coef")


PLACES = " UNION ALL ".join(f"SELECT '{c}' AS f, {i} AS i" for i, c in enumerate(X.LINE_FEATURES))
ENERGIES = f"""{QUBO}, place AS ({PLACES}),
terms AS (SELECT alpha, a.i AS i, b.i AS j, coef FROM qubo JOIN place a ON f1 = a.f JOIN place b ON f2 = b.f),
masks AS (SELECT UNNEST(range(0, {2 ** len(X.LINE_FEATURES)})) AS mask),
energies AS (SELECT alpha, mask, SUM(CASE WHEN (mask >> i) & 1 = 1 AND (mask >> j) & 1 = 1 THEN coef ELSE 0 END) AS energy
  FROM masks, terms GROUP BY alpha, mask),
best AS (SELECT alpha, mask, energy, ROW_NUMBER() OVER (PARTITION BY alpha ORDER BY ROUND(energy, 12), mask) AS place FROM energies)"""


@query("e7_exact_subset", f"""WITH {ENERGIES} SELECT alpha, CAST(mask AS BIGINT) AS mask, CAST(bit_count(mask) AS INT) AS size,
  {r9('energy')} AS energy FROM best WHERE place = 1""")
def e7(spark, sf):
    tables = line_tables(spark, sf)
    return rounded(subset.exact_minimum(subset.subset_table(spark, tables), tables, ALPHAS), "energy")


@query("e7_bounded_subset", f"""WITH {ENERGIES} SELECT alpha, CAST(mask AS BIGINT) AS mask, CAST(bit_count(mask) AS INT) AS size,
  {r9('energy')} AS energy FROM best WHERE place = 1""")
def e7_bounded(spark, sf):
    """The same minima, proven by branch and bound."""
    tables = line_tables(spark, sf)
    found = [(a, branch_bound.fit_bounded_minimum(spark, *subset.qubo(tables, a))) for a in ALPHAS]
    return rounded(spark.createDataFrame([(a, m.mask, m.mask.bit_count(), m.energy) for a, m in found],
                                         "alpha double, mask long, size int, energy double"), "energy")


WIDE = 30


@query("e7_wide_subset")
def e7_wide(spark, sf):
    """Minima of 30 embedding dimensions, out of reach of enumeration, with the work that the proof took."""
    names = [f"d{i:02d}" for i in range(WIDE)]
    rows = X.vectors(spark, sf).select("label", *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)))
    binned = M.bin_columns(rows, M.fit_bin_edges(rows, names))
    tables = subset.fit_mi_tables(M.relevance_and_redundancy(binned, names, "label"), names, "label")
    lines = []
    for alpha in (0.97, 0.99, 0.995):
        m = branch_bound.fit_bounded_minimum(spark, *subset.qubo(tables, alpha))
        lines.append((alpha, ",".join(c for i, c in enumerate(names) if m.mask >> i & 1), m.energy, m.rounds, m.prefixes))
    return spark.createDataFrame(lines, "alpha double, features string, energy double, rounds int, prefixes long")


@query("e8_annealed_subset", f"""WITH {ENERGIES} SELECT {r9('energy')} AS energy,
  array_to_string(list_transform(range(0, {len(X.LINE_FEATURES)}), lambda i: (mask >> i) & 1), '') AS bits
FROM best WHERE place = 1 AND alpha = 0.75""")
def e8(spark, sf):
    reads = subset.annealed_reads(spark, line_tables(spark, sf), 0.75, num_reads=1000, seed=7)
    return rounded(subset.annealed_minimum(reads), "energy")


WANTED = 3
MU = "GREATEST(-s.alpha * least, 2 * (1 - s.alpha) * most)"
LOWER = f"CASE WHEN bit_count(best) < {WANTED} THEN alpha ELSE lower END"
UPPER = f"CASE WHEN bit_count(best) > {WANTED} THEN alpha ELSE upper END"
# the search as a recursion: each step takes the mask of least energy at the current alpha
SEARCH = f"""{LINE_BINS}, single AS ({importance_sql(X.LINE_FEATURES)}), paired AS ({redundancy_sql(X.LINE_FEATURES)}),
place AS ({PLACES}),
lin AS MATERIALIZED (SELECT i, mi FROM single JOIN place ON feature = f),
quad AS MATERIALIZED (SELECT a.i AS i, b.i AS j, mi FROM paired JOIN place a ON f1 = a.f JOIN place b ON f2 = b.f),
peaks AS MATERIALIZED (SELECT (SELECT MIN(mi) FROM lin) AS least, (SELECT MAX(mi) FROM quad) AS most),
masks AS MATERIALIZED (SELECT mask, (SELECT list(mi) FROM lin WHERE (mask >> i) & 1 = 1) AS gains,
    (SELECT COALESCE(SUM(mi), 0) FROM quad WHERE (mask >> i) & 1 = 1 AND (mask >> j) & 1 = 1) AS shared
  FROM (SELECT UNNEST(range(0, {2 ** len(X.LINE_FEATURES)})) AS mask)),
search AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS lower, CAST(1 AS DOUBLE) AS upper, CAST(0.5 AS DOUBLE) AS alpha,
    CAST(NULL AS DOUBLE) AS used, CAST(NULL AS BIGINT) AS mask, false AS done
  UNION ALL
  SELECT step + 1, {LOWER}, {UPPER}, (({LOWER}) + ({UPPER})) / 2, alpha, best,
    bit_count(best) = {WANTED} OR ({UPPER}) - ({LOWER}) < CAST(1e-6 AS DOUBLE)
  FROM (SELECT s.*, b.best FROM search s, LATERAL (SELECT arg_min(mask, 2 * (1 - s.alpha) * shared
      + COALESCE(list_sum(list_transform(gains, lambda g: CASE WHEN s.alpha * g >= CAST(1e-8 AS DOUBLE) THEN -s.alpha * g
          WHEN {MU} > 0 THEN {MU} ELSE 1 END)), 0)) AS best FROM masks, peaks) b WHERE NOT s.done))"""


@query("e9_alpha_search", f"""WITH RECURSIVE {SEARCH} SELECT f AS feature, used AS alpha, bit_count(mask) = {WANTED} AS reached_k, step AS steps
FROM search JOIN place ON (mask >> i) & 1 = 1 WHERE done""")
def e9(spark, sf):
    rows = X.line_samples(spark, sf)
    choice = reduce.fit_selection(rows, X.LINE_FEATURES, WANTED, "exact")
    return spark.createDataFrame(
        [(f, choice.alpha, choice.reached_k, len(choice.trail)) for f in choice.features],
        "feature string, alpha double, reached_k boolean, steps int")
