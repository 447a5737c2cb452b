"""Sources, pruning, encoding, splitting, quantiles and scaling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysift.operators import components, mutual_info, prune, quantiles, rank_sketch, scale, split
from tallysift.plans import preprocess, reduce
from tallysift.sources import results, tables
from tallysift.sources import schemas as S


def test_types_and_missing_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text("i,d,b,s,e\n1,1.5,True,x,\n,NA,false,nan,\n3,2,,12a,null\n")
    got = tables.read_table(spark, str(tmp_path / "t.csv"))
    assert got.dtypes == [("i", "bigint"), ("d", "double"), ("b", "boolean"), ("s", "string"), ("e", "double")]
    assert [tuple(r) for r in got.collect()] == [
        (1, 1.5, True, "x", None), (None, None, False, None, None), (3, 2.0, None, "12a", None)]


@pytest.mark.parametrize("paths", [{}, {"train_path": "a"}, {"data_path": "a", "train_path": "b", "test_path": "c"}])
def test_input_mode_is_unambiguous(spark, paths):
    with pytest.raises(ValueError):
        tables.read_labelled(spark, **paths)


def test_missing_task_folders_give_empty_tables(spark, tmp_path):
    assert results.scan_history(spark, str(tmp_path)).count() == 0
    assert results.scan_run_records(spark, str(tmp_path)).count() == 0
    assert results.discover_experiments(spark, str(tmp_path)).count() == 0


def test_pruning_and_encoding(spark):
    rows = [(i, i % 2, 5, None, f"v{i}", "ab"[i % 2] if i % 5 else None, float(i)) for i in range(100)]
    df = spark.createDataFrame(
        rows, "k int, y int, same int, none double, many string, few string, num double")
    model = prune.fit_prune(df, "y", ("k",))
    assert model.constant == ("same",) and model.empty == ("none",) and model.high_cardinality == ("many",)
    assert model.classes == {"few": ["a", "b", "nan"]} and model.features == ("few", "num")
    test = spark.createDataFrame([("a",), ("c",), (None,)], "few string")
    assert [r[0] for r in prune.encode(test, model).collect()] == [0, -1, 2]


def test_labels_and_booleans_as_stored(spark):
    rows = [(1.0, True), (0.0, None), (float("nan"), False), (None, False), (1.0, False)]
    df = spark.createDataFrame(rows, "y double, b boolean")
    kept = prune.drop_null_target(df, "y")
    assert kept.count() == 3
    assert prune.null_target_counts(df, "y").first().asDict() == {"split": "full", "dropped": 2, "kept": 3}
    model = prune.fit_prune(kept, "y")
    assert model.classes == {"b": ["False", "True", "nan"]}
    assert [r["b"] for r in prune.encode(kept, model).collect()] == [1, 2, 0]


def test_cardinality_limit_is_exact(spark):
    for distinct, dropped in ((30, False), (31, True), (5000, True)):
        df = spark.range(10_000).select((F.col("id") % 2).alias("y"), F.concat(F.lit("v"), F.col("id") % distinct).alias("s"))
        assert ("s" in prune.fit_prune(df, "y").high_cardinality) is dropped


def test_unseen_class_without_missing_training_values(spark):
    train = spark.createDataFrame([(0, "a"), (1, "b")], "y int, s string")
    model = prune.fit_prune(train, "y")
    test = spark.createDataFrame([(0, "c"), (1, None)], "y int, s string")
    assert [r["s"] for r in prune.encode(test, model).collect()] == [-1, -1]


def keyed(spark, sizes, partitions=3):
    rows = [(i, y) for i, y in enumerate(y for y, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "k long, y int").repartition(partitions)


@pytest.mark.parametrize("sizes,take,quota", [
    ({0: 60, 1: 40}, 10, {0: 6, 1: 4}), ({0: 99, 1: 4}, 50, {0: 48, 1: 2}), ({0: 7, 1: 5, 2: 3}, 8, {0: 4, 1: 3, 2: 1})])
def test_quotas(spark, sizes, take, quota):
    cut = split.fit_strata(keyed(spark, sizes), "y", ("k",), 1, rows=take)
    got = split.cap_rows(keyed(spark, sizes), cut).groupBy("y").count().collect()
    assert sum(quota.values()) == take and {r["y"]: r["count"] for r in got} == cut.quotas
    assert sum(cut.quotas.values()) == take
    assert all(abs(cut.quotas[k] - sizes[k] * take / sum(sizes.values())) < 1 for k in sizes)


def test_split_is_the_global_order_whatever_the_partitioning(spark):
    sizes = {0: 9000, 1: 3000}
    parts = []
    for partitions, boundary in ((1, 100_000), (7, 1)):
        df = keyed(spark, sizes, partitions)
        cut = split.fit_strata(df, "y", ("k",), 9, fraction=.25, boundary_rows=boundary)
        parts.append({r["k"] for r in split.cap_rows(df, cut).collect()})
    ranked = keyed(spark, sizes).select("k", "y", split.order_code(("k",), 9).alias("c")).collect()
    want = set()
    for y, n in sizes.items():
        want |= {r["k"] for r in sorted((r for r in ranked if r["y"] == y), key=lambda r: r["c"])[:n // 4]}
    assert parts[0] == parts[1] == want


def test_cap_beyond_the_table_keeps_it(spark):
    assert split.fit_strata(keyed(spark, {0: 3, 1: 3}), "y", ("k",), 1, rows=6) is None


def test_repeated_keys_are_refused(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") % 2).alias("y"))
    with pytest.raises(ValueError):
        split.fit_strata(df, "y", ("k",), 1, rows=100)


@pytest.mark.parametrize("bins", [64, 4096])
def test_quantiles_are_exact(spark, bins):
    rng = np.random.default_rng(1)
    data = {
        "hot": np.where(rng.random(3000) < .4, 7.0, rng.normal(size=3000)),
        "wide": np.exp(rng.normal(0, 8, 3000)) * rng.choice([-1, 1], 3000),
        "few": rng.integers(0, 3, 3000).astype(float), "same": np.full(3000, 2.5),
    }
    df = spark.createDataFrame(list(zip(*[[float(v) for v in c] for c in data.values()])), list(data)).repartition(5)
    probs = [i / 20 for i in range(21)]
    got = quantiles.fit_quantiles(df, list(data), probs, bins=bins)
    for c, values in data.items():
        assert got[c].quantiles == pytest.approx(tuple(np.quantile(values, probs)), rel=1e-12), c


@pytest.mark.parametrize("between", [4_000_000, 10])
def test_quantiles_take_two_passes(spark, monkeypatch, between):
    """A sketch and one count; only where too many rows lie between the bounds, bins. Ties, hot values, any order of rows."""
    rng = np.random.default_rng(3)
    data = {"order": np.arange(20_000.0), "hot": np.where(rng.random(20_000) < .4, 7.0, rng.normal(size=20_000)),
            "wide": np.exp(rng.normal(0, 8, 20_000)) * rng.choice([-1, 1], 20_000), "few": rng.integers(0, 3, 20_000).astype(float)}
    df = spark.createDataFrame(list(zip(*[[float(v) for v in c] for c in data.values()])), list(data)).repartition(70)
    passes = []
    for name in ("_sketched", "_counted_between", "_count_bins"):
        run = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda *a, run=run, name=name: passes.append(name) or run(*a))
    monkeypatch.setattr(quantiles, "MAX_BETWEEN", between)
    probs = [i / 20 for i in range(21)] + [.001, .4999]
    got = quantiles.fit_quantiles(df, list(data), probs, level_values=64)
    for c, values in data.items():
        assert got[c].quantiles == pytest.approx(tuple(np.quantile(values, probs)), rel=1e-12), c
        assert (got[c].rows, got[c].low, got[c].high) == (20_000, values.min(), values.max())
    assert passes[0] == "_sketched"
    assert passes[1:] == ["_counted_between"] if between > 10 else set(passes[1:]) == {"_count_bins"}
    passes.clear()
    quantiles.fit_quantiles(df, list(data), probs)
    assert passes == ["_sketched"]


@pytest.mark.parametrize("between", [30_000, 10])
def test_quantiles_of_values_with_many_rows(spark, monkeypatch, between):
    """Ranks that fall on the least value, and values of many rows, which need no bins however many rows they have."""
    rng = np.random.default_rng(5)
    data = {"line": rng.integers(1, 8, 40_000).astype(float), "least": np.where(rng.random(40_000) < .6, 1.0, 1 + rng.random(40_000)),
            "tiny": rng.integers(0, 3, 40_000) * 5e-324}
    df = spark.createDataFrame(list(zip(*[[float(v) for v in c] for c in data.values()])), list(data)).repartition(4)
    passes = []
    for name in ("_counted_between", "_count_bins"):
        run = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda *a, run=run, name=name: passes.append(name) or run(*a))
    monkeypatch.setattr(quantiles, "MAX_BETWEEN", between)
    probs = [i / 20 for i in range(21)]
    for c in data if between == 10 else ["line", "tiny"]:
        got = quantiles.fit_quantiles(df, [c], probs, level_values=512)
        assert got[c].quantiles == pytest.approx(tuple(np.quantile(data[c], probs)), rel=1e-12, abs=0), c
    assert "_count_bins" in passes if between == 10 else set(passes) == {"_counted_between"}


def test_a_sketch_knows_its_error():
    rng = np.random.default_rng(0)
    for values in (np.arange(5000.0), rng.normal(size=5000), rng.integers(0, 9, 5000).astype(float), np.arange(5000.0)[::-1]):
        parts = []
        for part in np.array_split(values, 7):
            parts.append(rank_sketch.RankSketch(50))
            for batch in np.array_split(part, 11):
                parts[-1].add(batch)
        whole = rank_sketch.RankSketch.loads(parts[0].dumps())
        for p in parts[1:]:
            whole.merge(p)
        assert sum(len(v) << k for k, v in enumerate(whole.levels)) == whole.rows == 5000
        assert sum(map(len, whole.levels)) <= 50 * len(whole.levels) and 0 < whole.error < 2500
        ranks, ordered = list(range(0, 5000, 37)), np.sort(values)
        for r, (low, high) in zip(ranks, whole.brackets(ranks)):
            assert low < ordered[r] <= high
            assert (values <= high).sum() - (values <= low).sum() <= 8 * whole.error + (values == high).sum() + 2
            assert len(np.unique(values[(values > low) & (values <= high)])) <= whole.most_values([(low, high)])


def test_quantiles_ignore_missing_values(spark):
    df = spark.createDataFrame([(None, None), (float("nan"), None), (1.0, None), (4.0, None)], "a double, b double")
    got = quantiles.fit_quantiles(df, ["a", "b"], [.5])
    assert got["a"].quantiles == (2.5,) and got["a"].rows == 2 and got["b"].rows == 0 and got["b"].quantiles == ()


def test_quantiles_span_the_whole_double_range(spark):
    df = spark.createDataFrame([(-1.7e308,), (0.0,), (1.0,), (1.7e308,)], "a double")
    assert quantiles.fit_quantiles(df, ["a"], [.5])["a"].quantiles == (.5,)


def test_scaling_is_fitted_on_training_rows(spark, near):
    train = spark.createDataFrame([(0.0, 3.0), (10.0, 3.0), (None, 3.0)], "a double, b double")
    model = scale.fit_scale(train, ["a", "b"])
    got = scale.impute_and_scale(spark.createDataFrame([(20.0, 5.0), (None, 3.0)], "a double, b double"), model).collect()
    assert got[0]["a"] == near(2 * math.pi) and got[1]["a"] == near(math.pi / 2)
    assert got[0]["b"] == near(2 * math.pi) and got[1]["b"] == 0


def test_features_without_values_are_dropped(spark):
    train = spark.createDataFrame([(1.0, None)], "a double, b double")
    model = scale.fit_scale(train, ["a", "b"])
    assert model.empty == ("b",) and scale.impute(train, model).columns == ["a"]


def test_alignment(spark):
    test = spark.createDataFrame([(1, 9)], "a int, extra int")
    assert prune.align(test, ["a", "b"]).collect()[0].asDict() == {"a": 1, "b": 0}


def test_bins_match_right_closed_quantile_bins(spark):
    import pandas as pd
    rng = np.random.default_rng(4)
    data = {"ties": rng.integers(0, 9, 900) / 10, "smooth": rng.normal(size=900), "two": rng.integers(0, 2, 900) * 1.0}
    df = spark.createDataFrame(list(zip(range(900), *[[float(v) for v in c] for c in data.values()])), ["i", *data])
    edges = mutual_info.fit_bin_edges(df, list(data))
    got = mutual_info.bin_columns(df, edges).orderBy("i").toPandas()
    for c, values in data.items():
        want = pd.qcut(pd.Series(values), q=20, labels=False, duplicates="drop")
        assert list(got[c]) == list(want), c
    wide = mutual_info.fit_bin_edges(df, list(data), method="width")
    got = mutual_info.bin_columns(df, wide).orderBy("i").toPandas()
    for c, values in data.items():
        assert list(got[c]) == list(pd.cut(pd.Series(values), bins=20, labels=False)), c


def test_components_keep_variance_and_sign(spark, near):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + 5
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ["a", "b", "c", "d"])
    model = components.fit_components(df, ["a", "b", "c", "d"], 2)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert model.explained == pytest.approx(tuple(values[:2] / values.sum()))
    assert all(max(load, key=abs) > 0 for load in model.loadings)
    got = components.to_components(df, model).agg(F.avg("PC1"), F.var_samp("PC1"), F.corr("PC1", "PC2")).first()
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] == pytest.approx(values[0]) and abs(got[2]) < 1e-9


def test_preparing_without_leaks(spark):
    rows = [(i, i % 2, float(i), "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, y int, x double, s string")
    for scope in ("train", "all"):
        done = preprocess.prepare(df, "y", ("k",), fit_scope=scope, max_samples=200)
        assert done.table.count() == 200 and done.test.count() == 40
        low, high = done.train.agg(F.min("x"), F.max("x")).first()
        assert low == 0 and high == pytest.approx(math.pi)
    table, names = reduce.reduce_features(done.table, done.train, done.features, "pca", 1)
    assert names == ["PC1"] and table.columns == ["label", "split", "PC1"]


def test_row_keys_survive_recomputation(spark):
    keyed_rows = tables.with_row_key(spark.range(50).select((F.col("id") % 3).alias("v")))
    assert keyed_rows.select("row_id").distinct().count() == 50
    assert sorted(keyed_rows.collect()) == sorted(keyed_rows.collect())


def csv(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_types_of_a_pair_come_from_both_files(spark, tmp_path):
    train, test = csv(tmp_path, "a.csv", "a,b,y\n1,10,0\n"), csv(tmp_path, "b.csv", "a,b,y\n3.5,x,1\n4,40,1.0\n")
    got = tables.read_labelled(spark, train_path=train, test_path=test)
    assert dict(got.dtypes) == {"a": "double", "b": "string", "y": "double", "split": "string"}
    assert sorted((r.a, r.b, r.y) for r in got.collect()) == [(1.0, "10", 0.0), (3.5, "x", 1.0), (4.0, "40", 1.0)]


def test_a_schema_is_applied_by_header(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("y", T.IntegerType())])
    train, test = csv(tmp_path, "a.csv", "a,b,y\n1,u,0\n"), csv(tmp_path, "b.csv", "y,b\n1,NA\n")
    got = tables.read_labelled(spark, train_path=train, test_path=test, schema=schema)
    assert {(r.a, r.b, r.y, r.split) for r in got.collect()} == {(1, "u", 0, "train"), (None, None, 1, "test")}
    with pytest.raises(Exception, match="column y: no int: 2.5x"):
        tables.read_table(spark, csv(tmp_path, "c.csv", "a,b,y\n1,u,2.5x\n"), schema).collect()


def test_codes_and_dotted_names(spark, tmp_path):
    got = tables.read_table(spark, csv(tmp_path, "d.csv", "seat,n.x,e\n12D,1,1e3\n14F,2,-.5\n"))
    assert dict(got.dtypes) == {"seat": "string", "n.x": "bigint", "e": "double"}
    assert [r.seat for r in got.collect()] == ["12D", "14F"]


def test_record_files_keep_their_names_and_must_be_whole(spark, tmp_path):
    for folder in ("my exp", "a+b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / S.RUN_RECORDS_FILE).write_text("[{}]")
    assert {r.experiment for r in results.discover_experiments(spark, str(tmp_path)).collect()} == {"my exp", "a+b"}
    (tmp_path / "a+b" / S.RUN_RECORDS_FILE).write_text('[{"final_loss": 1.0}, {')
    with pytest.raises(Exception):
        results.discover_experiments(spark, str(tmp_path)).collect()
