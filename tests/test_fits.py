"""Kernel separator, matrix scoring, subset envelope, branch and bound, components."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysift.functions.readout import log_likelihood
from tallysift.functions.scores import SCORES
from tallysift.operators import baselines, blocks, branch_bound, components, scoring, search, subset
from test_models import brute, replay, tables_of


def ring(n, seed=7):
    x = np.random.default_rng(seed).normal(size=(n, 2))
    return x, (np.hypot(*x.T) > 1.2).astype(int)


def frame(spark, x, y):
    names = "abcdefgh"[:x.shape[1]]
    rows = [(*map(float, r), int(v)) for r, v in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", label int"), list(names)


def kept_bytes(spark, but=()):
    """Bytes in memory and on disk of each table that is persisted now, by its number."""
    found = spark.sparkContext._jsc.sc().getRDDStorageInfo()
    return {r.id(): (r.memSize(), r.diskSize()) for r in found if r.id() not in but}


# -- passes over packed rows

def test_passes_add_up_on_any_partitioning(spark, monkeypatch):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") % 7 > 0, 1.0).alias("b"))
    known = [(i, 1) for i in range(20_000) if i % 7]
    want = [sum(i for i, _ in known), len(known), len(known)]
    step = lambda x: np.array([x[:, 0].sum(), x[:, 1].sum(), len(x)])
    for parts in (1, 5, 70):
        packed = blocks.pack(df.repartition(parts), ["a", "b"])
        assert blocks.add_up(packed, 2, 3, step).tolist() == want
        assert packed.agg(F.sum("nulls")).first()[0] == 20_000 - len(known)
    assert blocks.add_up(blocks.pack(df.limit(0), ["a", "b"]), 2, 3, step).tolist() == [0, 0, 0]


def test_stored_blocks_hold_every_row_on_all_cores(spark):
    """Fewer parts than cores are dealt out, more stay; blocks of wide rows are cut by bytes."""
    df = spark.range(50_000).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") % 7 > 0, 1.0).alias("b"))
    known = [i for i in range(50_000) if i % 7]
    step = lambda x: np.array([x[:, 0].sum(), x[:, 1].sum(), len(x), 1])
    for parts in (1, 8, 70):
        held = blocks.persist_blocks(df.coalesce(1) if parts == 1 else df.repartition(parts), lambda df: blocks.pack(df, ["a", "b"]))
        assert held.getNumPartitions() == max(parts, 8)
        assert blocks.add_up(held, 2, 4, step).tolist()[:3] == [sum(known), len(known), len(known)]
        if parts == 1:
            sizes = held.mapPartitions(lambda raws: [sum(len(raw) for raw in raws)]).collect()
            assert min(sizes) > 0 and sum(sizes) == 16 * len(known)
        halves = blocks.mapped(held, 2, lambda x: x[:, :1] / 2)
        assert blocks.add_up(halves, 1, 1, lambda x: x.sum(axis=0)).tolist() == [sum(known) / 2]
        held.unpersist()
    wide = df.limit(3000).select(F.array_repeat("a", 300).alias("v"))
    held = blocks.persist_blocks(wide, lambda df: blocks.pack_arrays(df, "v", 300))
    assert max(held.map(len).collect()) <= blocks.BLOCK_BYTES
    assert blocks.add_up(held, 300, 2, lambda x: np.array([len(x), x.sum()])).tolist() == [3000, 300 * sum(range(3000))]
    held.unpersist()
    assert blocks.persist_blocks(df.limit(0), lambda df: blocks.pack(df, ["a", "b"])).map(len).sum() == 0


# -- kernel separator

def exact_kernel_machine(x, y, gamma, rounds=3000):
    """Decision values of the kernel machine itself: dual coordinate descent with the bias as a large constant feature."""
    sign = 2.0 * y - 1
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2)) + 100.0
    alpha, f = np.zeros(len(x)), np.zeros(len(x))
    for _ in range(rounds):
        worst = 0.0
        for i in range(len(x)):
            new = min(1.0, max(0.0, alpha[i] + (1 - sign[i] * f[i]) / kernel[i, i]))
            if new != alpha[i]:
                f += (new - alpha[i]) * sign[i] * kernel[:, i]
                worst, alpha[i] = max(worst, abs(new - alpha[i])), new
        if worst < 1e-4:
            break
    return f


def test_kernel_fit_agrees_with_the_exact_machine(spark):
    """500 rows: the random features err by about 1 / sqrt(width) in the kernel; decisions differ on few rows only."""
    x, y = ring(500)
    df, names = frame(spark, x, y)
    want = exact_kernel_machine(x, y, 1 / (2 * x.var()))
    for width, share, close in ((128, 0.97, 0.97), (1024, 0.985, 0.99)):
        model = baselines.fit_kernel(df, names, width=width)
        got = np.array([r["margin"] for r in baselines.kernel_margins(model, df, names).collect()])
        assert ((got > 0) == (want > 0)).mean() >= share and np.corrcoef(got, want)[0, 1] >= close
        assert model.converged and model.gap <= 1e-3 and model.passes <= 30


def test_kernel_fit_holds_no_rows_in_memory(spark, monkeypatch):
    """Neither the packed rows nor the decision values, as the search."""
    df, names = frame(spark, *ring(3000))
    before, seen = set(kept_bytes(spark)), {}
    for name in ("fit_margin", "fit_calibration"):
        def looked(*args, name=name, fit=getattr(baselines, name)):
            seen[name] = kept_bytes(spark, before)
            return fit(*args)
        monkeypatch.setattr(baselines, name, looked)
    baselines.fit_kernel(df, names, max_iter=3)
    assert set(seen) == {"fit_margin", "fit_calibration"} and all(seen.values())
    assert all(memory == 0 and disk > 0 for kept in seen.values() for memory, disk in kept.values())


def test_kernel_gap_bounds_the_optimum(spark):
    """No other separator on the same features is better by more than the gap."""
    x, y = ring(800, 3)
    df, names = frame(spark, x, y)
    model = baselines.fit_kernel(df.repartition(3), names, width=64, tol=1e-3)
    z = baselines.fourier_features(x, np.array(model.frequencies), np.array(model.phases))
    w, b = model.separator.coefficients.toArray(), model.separator.intercept
    loss = lambda v, c: v @ v / 2 + np.maximum(0, 1 - (2 * y - 1) * (z @ v + c)).sum()
    assert loss(w, b) == pytest.approx(model.objective, rel=1e-6) and 0 <= model.gap <= 1e-3
    rng = np.random.default_rng(0)
    assert all(loss(w + rng.normal(size=64) * s, b + rng.normal() * s) >= loss(w, b) * (1 - 1e-3) for s in (1e-3, 1e-2, .1) for _ in range(50))


def test_kernel_odd_tables(spark):
    x, y = ring(60)
    df, names = frame(spark, x, y)
    odd = df.union(spark.createDataFrame([(None, 1.0, 1), (0.0, None, 0), (0.1, 0.1, None)], df.schema))
    model = baselines.fit_kernel(odd, names)
    got = baselines.kernel_predictions(model, odd, names, ("label",)).collect()
    assert len(got) == 63 and sum(r["prob"] is None for r in got) == sum(r["predicted"] is None for r in got) == 2
    for label in (0, 1):
        alone = baselines.fit_kernel(df.where(F.col("label") == label), names)
        assert {r["predicted"] for r in baselines.kernel_predictions(alone, df, names, ()).collect()} == {label}
    same = df.withColumns({"a": F.lit(1.0), "b": F.lit(1.0)})
    assert baselines.fit_kernel(same, names).passes <= 30
    copies = frame(spark, np.repeat(x, 40, axis=0), np.repeat(y, 40))[0]
    hard = baselines.fit_kernel(copies, names, max_iter=60)  # 60 points that weigh 40 times as much: hardly any slack
    assert hard.gap <= 2e-2 and hard.converged == (hard.gap <= 3e-4)


# -- matrix scores

@pytest.mark.parametrize("score", ["logistic", "product"])
def test_matrix_scores_equal_column_scores(spark, score, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3)) * 3
    df, names = frame(spark, x, rng.integers(0, 2, 3000))
    df = df.union(spark.createDataFrame([(None, 1.0, 1.0, 1), (1.0, 2.0, 3.0, None), (800.0, 900.0, 1.0, 1)], df.schema))
    cands = rng.uniform(-3, 3, (37, 4 if score == "logistic" else 3)).tolist() + [[0.0] * (4 if score == "logistic" else 3)]
    monkeypatch.setattr(scoring, "STEP_SCORES", 5000)
    want = {r["cand"]: tuple(r) for r in scoring.candidate_scores(df, names, "label", cands, SCORES[score]).collect()}
    got = {r["cand"]: tuple(r) for r in scoring.candidate_scores(df.repartition(6), names, "label", cands, score).collect()}
    assert set(got) == set(want) == set(range(38))
    for k in want:
        assert got[k][1] == pytest.approx(want[k][1], rel=1e-12) and got[k][2] == want[k][2] == 3003
    plan = scoring.candidate_scores(df, names, "label", cands, score)
    assert plan.dtypes == scoring.candidate_scores(df, names, "label", cands, SCORES[score]).dtypes
    assert scoring.candidate_scores(df.limit(0), names, "label", cands, score).count() == 0
    blank = df.where("a IS NULL")
    assert {(r["fitness"], r["samples"]) for r in scoring.candidate_scores(blank, names, "label", cands, score).collect()} == {(None, 1)}
    with pytest.raises(ValueError):
        scoring.candidate_scores(df, names, "label", cands, "unknown")


def test_searches_agree_between_matrix_and_column_scores(spark):
    rng = np.random.default_rng(4)
    df, names = frame(spark, rng.normal(size=(400, 2)), rng.integers(0, 2, 400))
    args = dict(method="PSO", runs=2, base_seed=3, generations=5, population=5)
    a, b = (search.fit_population(df, names, "label", score=s, **args) for s in ("logistic", SCORES["logistic"]))
    for r in (1, 2):
        assert a.best[r] == pytest.approx(b.best[r], rel=1e-9) and a.fitness[r] == pytest.approx(b.fitness[r], rel=1e-12)


@pytest.mark.parametrize("method", search.METHODS)
def test_a_search_holds_no_rows_in_memory(spark, monkeypatch, method):
    """Rows kept on the heap stop an executor once there are more than it has room for."""
    rng = np.random.default_rng(4)
    df, names = frame(spark, rng.normal(size=(3000, 2)), rng.integers(0, 2, 3000))
    before, seen, score = set(kept_bytes(spark)), [], search.candidate_scores
    monkeypatch.setattr(search, "candidate_scores", lambda *args: seen.append(kept_bytes(spark, before)) or score(*args))
    search.fit_population(df, names, "label", method=method, generations=3, population=5)
    assert len(seen) == 3 and all(seen)
    assert all(memory == 0 and disk > 0 for kept in seen for memory, disk in kept.values())


@pytest.mark.parametrize("method", search.METHODS)
def test_a_resumed_search_goes_on_as_if_it_had_not_stopped(spark, tmp_path, method):
    rng = np.random.default_rng(4)
    df, names = frame(spark, rng.normal(size=(300, 2)), rng.integers(0, 2, 300))
    args = dict(method=method, base_seed=3, population=5)
    whole = search.fit_population(df, names, "label", runs=2, generations=6, **args)
    # one run stops after four generations, is stored, and goes on beside one that begins
    search.fit_population(df, names, "label", runs=1, generations=4, **args).resume.write.parquet(str(tmp_path / "state"))
    rest = search.fit_population(df, names, "label", runs=2, generations=6, resume=spark.read.parquet(str(tmp_path / "state")), **args)
    assert rest.best == whole.best and rest.fitness == pytest.approx(whole.fitness, rel=1e-12)
    values = lambda found: {(r["Run"], r["Epoch"], r["Metric"]): r["Value"] for r in found.history.collect()}
    got, want = values(rest), values(whole)
    assert set(want) - set(got) == {(1, e, m) for e in range(1, 5) for m in ("fitness", "mean_best")}
    assert got == pytest.approx({k: want[k] for k in got}, rel=1e-12)
    done = search.fit_population(df, names, "label", runs=2, generations=6, resume=whole.resume, **args)
    assert done.best == whole.best and done.history.count() == 0
    with pytest.raises(ValueError):
        search.fit_population(df, names, "label", runs=1, generations=9, resume=whole.resume, method=method, base_seed=3, population=6)


def test_log_likelihood_forms_agree(spark):
    from tallysift.functions.readout import log_likelihood_matrix
    labels, probs = [1, 0, 1, 0], [0.0, 0.0, 1.0, 0.25]
    df = spark.createDataFrame(list(zip(labels, probs)), "label int, p double")
    want = [r[0] for r in df.select(log_likelihood(F.col("label"), F.col("p"))).collect()]
    got = log_likelihood_matrix(np.array(labels), np.array(probs)[:, None])[:, 0]
    assert got.tolist() == pytest.approx(want, rel=1e-14) and math.isfinite(min(want))


@pytest.mark.parametrize("rows", [0, 5, 16, 50, 4096])
def test_sums_of_likelihoods_take_few_logarithms(monkeypatch, rows):
    """All-wrong certainties, too, whose products must not underflow."""
    from tallysift.functions import readout
    rng = np.random.default_rng(rows)
    labels, probs = rng.integers(0, 2, rows), rng.random((rows, 3))
    probs[:, 1] = 1 - labels
    want = readout.log_likelihood_matrix(labels, probs).sum(axis=0)
    taken, log = [], np.log
    monkeypatch.setattr(np, "log", lambda x: taken.append(x.size) or log(x))
    assert readout.log_likelihood_sums(labels, probs).tolist() == pytest.approx(want.tolist(), rel=1e-12)
    assert sum(taken) <= 3 * (rows // 16 + 15)


def test_random_features_are_cosines_of_any_size():
    rng = np.random.default_rng(2)
    x, waves, phases = rng.normal(0, 40, (1000, 3)), rng.normal(size=(7, 3)), rng.uniform(0, 2 * math.pi, 7)
    want = math.sqrt(2 / 7) * np.cos(x @ waves.T + phases)
    held = np.zeros((1000, 9))
    assert np.abs(baselines.fourier_features(x, waves, phases) - want).max() < 1e-12
    baselines.fourier_features(x, waves, phases, out=held[:, 1:8])
    assert np.abs(held[:, 1:8] - want).max() < 1e-12 and not held[:, [0, 8]].any()


def test_calibration_reads_stored_decisions(spark):
    """Decision values are formed once; blocks of (decision, label) calibrate as the features do."""
    from tallysift.operators import margin_fit
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(a + b + c > 0)) for a, b, c in rng.normal(size=(3000, 3))] + [(None, 1.0, 0.0)]
    packed = blocks.pack(spark.createDataFrame(rows, "a double, b double, y double").repartition(3), ["a", "b", "y"])
    fit = margin_fit.MarginFit(np.array([1.0, 0.5]), 0.25, 0.0, 0.0, 0)
    decided = blocks.mapped(packed, 3, lambda x: np.column_stack([margin_fit.decisions(x[:, :2], lambda z: z, fit), x[:, 2]]))
    assert decided.agg(F.sum("nulls")).first()[0] == 1
    want = margin_fit.fit_calibration(packed, 2, lambda x: x @ fit.weights + fit.bias)
    assert margin_fit.fit_calibration(decided, 1, lambda x: x[:, 0]) == pytest.approx(want, rel=1e-9)


# -- subsets

@pytest.mark.parametrize("seed", range(3))
def test_envelope_has_every_minimum(spark, seed):
    tables = tables_of(9, seed=seed, low=(1,) if seed else ())
    lines = subset.fit_envelope(spark, tables)
    rng = np.random.default_rng(seed)
    for alpha in [*(j / 2 ** 20 for j in (1, 2, 3, 2 ** 20 - 1)), *(rng.integers(1, 2 ** 20, 40) / 2 ** 20)]:
        assert lines.minimum(float(alpha)) == brute(tables, float(alpha))[1]
    assert sum(map(len, lines.masks.values())) < 100


def test_envelope_crosses_penalties(spark):
    """Relevances so small that they count as none for small alphas only."""
    tables = subset.MiTables(("a", "b", "c", "d"), (3e-8, 5e-7, 0.4, 0.0), {(0, 1): 0.01, (1, 2): 0.2, (2, 3): 0.3, (0, 2): 0.0})
    lines = subset.fit_envelope(spark, tables)
    assert len(lines.masks) >= 3
    for alpha in [2.0 ** -k for k in range(1, 21)] + [1 - 2.0 ** -k for k in range(2, 21)] + [0.33, 0.34, 0.02, 0.021]:
        assert lines.minimum(alpha) == brute(tables, alpha)[1], alpha


def test_envelope_scans_once(spark, monkeypatch):
    scans, scan = [], subset.fit_envelope
    monkeypatch.setattr(subset, "fit_envelope", lambda *a: scans.append(1) or scan(*a))
    choice = subset.fit_subset(spark, tables_of(6, seed=8), 9, "exact")
    assert len(choice.trail) == 20 and scans == [1]


@pytest.mark.parametrize("alpha", [.3, .8, .95])
def test_branch_and_bound_equals_enumeration(spark, alpha):
    tables = tables_of(16, seed=4, low=(3,))
    want = subset.exact_minimum(subset.subset_table(spark, tables), tables, [alpha]).first()
    got = branch_bound.fit_bounded_minimum(spark, *subset.qubo(tables, alpha))
    assert got.mask == want["mask"] and got.energy == pytest.approx(want["energy"])


def test_branch_and_bound_of_thirty_features(spark):
    """30 features: the proof visits a small part of the 2^30 subsets, and no other search finds a better one."""
    rng = np.random.default_rng(0)
    relevance = rng.random(30)
    pairs = {(i, j): float(0.4 * rng.random() * min(relevance[i], relevance[j])) for i in range(30) for j in range(i + 1, 30)}
    tables = subset.MiTables(tuple(f"f{i}" for i in range(30)), tuple(map(float, relevance)), pairs)
    for alpha in (0.5, 0.9):
        got = branch_bound.fit_bounded_minimum(spark, *subset.qubo(tables, alpha))
        reads = subset.annealed_minimum(subset.annealed_reads(spark, tables, alpha, 32, seed=1, sweeps=300)).first()
        assert got.energy <= reads["energy"] + 1e-9 and got.prefixes < 2 ** 26
        problem = branch_bound.Problem(*subset.qubo(tables, alpha))
        assert problem.descend(problem.ordered(got.mask)) == problem.ordered(got.mask)
        assert problem.energies(np.array([problem.ordered(got.mask)]))[0] == pytest.approx(got.energy)


def test_bounds_are_below_every_completion():
    rng = np.random.default_rng(2)
    problem = branch_bound.Problem(rng.normal(size=10).tolist(), {(i, j): float(rng.random()) for i in range(10) for j in range(i + 1, 10)})
    everything = np.arange(1 << 10)
    energies = problem.energies(everything)
    for depth in range(11):
        prefixes = np.arange(1 << depth)
        bounds = problem.bounds(prefixes, problem.energies(prefixes), depth)
        for p in prefixes:
            assert bounds[p] <= energies[(everything & (1 << depth) - 1) == p].min() + 1e-9


def test_branch_and_bound_odd_problems(spark):
    assert branch_bound.fit_bounded_minimum(spark, [], {}).mask == 0
    assert branch_bound.fit_bounded_minimum(spark, [-1.0], {}).mask == 1
    # equal energies: the smallest mask
    assert branch_bound.fit_bounded_minimum(spark, [-1.0, -1.0, -1.0], {(0, 1): 5.0, (0, 2): 5.0, (1, 2): 5.0}).mask == 1
    with pytest.raises(ValueError):
        branch_bound.fit_bounded_minimum(spark, [1.0, 1.0], {(0, 1): -1.0})
    with pytest.raises(ValueError):
        branch_bound.fit_bounded_minimum(spark, [1.0] * 63, {})


def test_bounded_alpha_search(spark):
    tables = tables_of(7, seed=1)
    choice = subset.fit_subset(spark, tables, 3, "bounded")
    mask, reached = replay(tables, 3)
    assert choice.features == [f for i, f in enumerate(tables.features) if mask >> i & 1] and choice.reached_k == reached


# -- components

@pytest.mark.parametrize("n, k, rows", [(5, 2, 300), (40, 3, 500), (120, 4, 90)])
def test_components_equal_the_covariance_route(spark, n, k, rows):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(rows, n)) * np.geomspace(3, 0.5, n) + rng.normal(size=n) * 10
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "v array<double>").repartition(4)
    model = components.fit_array_components(df, "v", k)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.abs(np.array(model.explained) - values[::-1][:k] / values.sum()).max() < 1e-8
    loads = vectors[:, ::-1][:, :k].T
    assert all(abs(abs(a @ np.array(b)) - 1) < 1e-8 for a, b in zip(loads, model.loadings))
    got = np.array([list(r) for r in components.array_to_components(df.coalesce(1), "v", model).collect()])
    assert np.cov(got.T).diagonal() == pytest.approx(values[::-1][:k])


def test_components_odd_rows(spark):
    rows = [([1.0, 2.0, 3.0],), ([2.0, 1.0, 0.0],), ([0.0, 0.5, 9.0],), (None,), ([1.0, None, 2.0],), ([1.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    model = components.fit_array_components(df, "v", 2)
    got = components.array_to_components(df, "v", model).collect()
    assert [r["PC1"] is None for r in got] == [False] * 3 + [True] * 3 and model.explained_total == pytest.approx(1)
    flat = spark.createDataFrame([(1.0, 1.0)] * 5 + [(None, 1.0)], "a double, b double")
    still = components.fit_components(flat, ["a", "b"], 1)
    assert still.explained == (0.0,) and components.to_components(flat, still).first()["PC1"] == 0
    with pytest.raises(ValueError):
        components.fit_components(flat, ["a", "b"], 3)
