"""Commits, split JSON arrays, keyed running state, curves over arriving runs."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tallysift.operators import arriving, roc
from tallysift.session import scratch_dir
from tallysift.sources import commits, json_arrays, results
from tallysift.sources import schemas as S
from tallysift.streaming import training_log


# -- commits

def history(spark, *rows):
    return spark.createDataFrame([(r, e, "fitness", float(r)) for r, e in rows], S.HISTORY)


def test_a_batch_that_is_written_again_counts_once(spark, tmp_path):
    path = str(tmp_path / "history")
    assert results.read_history(spark, path).count() == 0
    for batch, rows in (("a", [(1, 1), (1, 2)]), ("b/c %41", [(1, 3), (2, 1)]), ("a", [(1, 1), (1, 2)]), ("a", [(1, 1), (1, 2), (4, 1)])):
        results.append_history(history(spark, *rows), path, batch)
    found = results.read_history(spark, path)
    assert found.schema == S.HISTORY
    assert sorted((r["Run"], r["Epoch"]) for r in found.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (4, 1)]
    assert commits.committed(spark, path).keys() == {"a", "b/c %41"}
    assert commits.remove_leftovers(spark, path) == 2 and results.read_history(spark, path).count() == 5
    results.append_history(history(spark), path, "empty")
    assert results.read_history(spark, path).count() == 5
    commits.drop_commit(spark, path, "a")
    assert results.read_history(spark, path).count() == 2
    for name in ("", "."):
        with pytest.raises(ValueError):
            commits.commit_rows(history(spark), path, name)


def test_an_attempt_that_breaks_off_leaves_nothing(spark, tmp_path, monkeypatch):
    """Killed after the rows are staged and before they count, and killed while they are being staged."""
    path, rows = str(tmp_path / "history"), history(spark, (1, 1), (2, 1))
    results.append_history(rows, path, "a")
    monkeypatch.setattr(commits, "_store", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        results.append_history(history(spark, (3, 3)), path, "b")
    monkeypatch.undo()
    broken = rows.withColumn("Value", F.when(F.col("Run") == 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(1.0))
    with pytest.raises(Exception, match="lost"):
        results.append_history(broken, path, "a")
    assert sorted(r["Run"] for r in results.read_history(spark, path).collect()) == [1, 2]
    results.append_history(history(spark, (3, 3)), path, "b")
    assert sorted(r["Run"] for r in results.read_history(spark, path).collect()) == [1, 2, 3]
    assert commits.remove_leftovers(spark, path) >= 1


def test_many_commits(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([(k, 1, 0, 0.5) for k in range(9)], S.PREDICTIONS)
    for k in range(9):
        results.append_predictions(rows.where(F.col("Run") == k), path, f"task {k}")
    assert sorted(r["Run"] for r in results.read_predictions(spark, path).collect()) == list(range(9))


# -- JSON arrays

def nasty(n, seed=0):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "x", "\n", "\\\\"]) for _ in range(rng.randrange(12)))
    return [{"label": text(), text(): [1, {"a": text()}], "n": {"m": [[], {}, text()]}, "k": k} for k in range(n)]


@pytest.mark.parametrize("piece", [1, 2, 7, 64, 1000, 10 ** 6])
def test_records_are_found_from_any_cut(spark, tmp_path, piece, monkeypatch):
    monkeypatch.setattr(json_arrays, "READ_BYTES", 50)
    want = nasty(25 if piece < 60 else 200)
    (tmp_path / "a b+c.json").write_text(json.dumps(want, indent=piece % 3 or None, ensure_ascii=piece % 2 == 0))
    raw = (tmp_path / "a b+c.json").read_bytes()
    # the pieces' own way, without Spark
    notes = [(a, min(a + piece, len(raw)), json_arrays.note_piece(str(tmp_path / "a b+c.json"), a, min(a + piece, len(raw))))
             for a in range(0, len(raw), piece)]
    depth, inside, found = 0, False, []
    for a, z, pair in notes:
        found += json_arrays.piece_records(str(tmp_path / "a b+c.json"), a, z, len(raw), depth, inside)
        depth, inside = depth + pair[inside].change, pair[inside].inside
    assert [json.loads(r) for r in found] == want and (depth, inside) == (0, False)


def test_array_files(spark, tmp_path):
    want = nasty(300, 1)
    (tmp_path / "one.json").write_text(json.dumps(want))
    (tmp_path / "two.json").write_text(" [ ] \n")
    (tmp_path / "none.json").write_text("")
    for piece in (333, 1 << 20):
        rows = json_arrays.read_array_records(spark, f"{tmp_path}/*.json", piece).collect()
        assert [json.loads(r["value"]) for r in sorted(rows, key=lambda r: r["pos"])] == want
        assert [r["pos"] for r in sorted(rows, key=lambda r: r["pos"])] == list(range(300))
        assert {r["path"].rsplit("/", 1)[-1] for r in rows} == {"one.json"}
    wide = json_arrays.read_array_records(spark, f"{tmp_path}/one.json", 500)
    assert wide.rdd.glom().map(len).filter(lambda n: n > 0).count() > 3  # read by several tasks


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a"', '[{"a": 1}', '[{"a": 1} {"a": 2}]', '[{"a": 1},, {"a": 2}]', '[{"a": 1}] x', '[{"a": 1}]]',
                                  '{"a": 1}', "[1, 2]", '["{}"]', '[{"a": "}]', "x"])
@pytest.mark.parametrize("piece", [5, 1 << 20])
def test_broken_arrays_are_errors(spark, tmp_path, text, piece):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(PythonException):
        json_arrays.read_array_records(spark, f"{tmp_path}/a.json", piece).collect()


def test_run_records_in_pieces(spark, tmp_path):
    records = [{"label": f'"{{{k}', "n_test": k, "accuracy": k / 100, "y_prob": [0.5] * 20} for k in range(100)]
    (tmp_path / "r.json").write_text(json.dumps(records))
    whole, cut = (results.read_run_records(spark, f"{tmp_path}/r.json", piece_bytes=b) for b in (1 << 20, 100))
    assert whole.schema == cut.schema and sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))
    assert sorted((r["Run"], r["n_test"]) for r in cut.collect()) == [(k + 1, k) for k in range(100)]
    assert results.read_run_records(spark, f"{tmp_path}/missing.json").count() == 0


# -- running state

GENERATIONS = "Run int, Epoch int, fitness double, mean_best double"


def test_a_batch_writes_only_the_runs_it_changes(spark, tmp_path):
    """10,000 runs, then one of them again: one row is written, and a restart goes on from the stored state."""
    feed, table, kept = str(tmp_path / "feed"), str(tmp_path / "table"), str(tmp_path / "kept")
    first = spark.range(10_000).select(F.col("id").cast("int").alias("Run"), F.lit(1).alias("Epoch"), F.lit(-2.0).alias("fitness"),
                                       F.lit(-3.0).alias("mean_best"))
    first.write.parquet(feed)
    stream = spark.readStream.schema(GENERATIONS).parquet(feed)
    training_log.keep_state(stream, table, kept).awaitTermination()
    spark.createDataFrame([(77, 2, -1.0, -2.0)], GENERATIONS).write.mode("append").parquet(feed)
    training_log.keep_state(stream, table, kept).awaitTermination()
    sizes = [spark.read.parquet(f"{table}/batch-{n:012d}").count() for _, n in training_log._versions(table)]
    assert sizes[0] == 10_000 and sizes[-1] == 1
    state = training_log.read_state(spark, table)
    assert state.count() == 10_000
    assert state.where("Run = 77").first().asDict() == {"Run": 77, "best": -1.0, "last_epoch": 2, "last_fitness": -1.0, "generations": 2}
    training_log.keep_state(stream, table, kept).awaitTermination()
    assert training_log.read_state(spark, table).agg(F.sum("generations")).first()[0] == 10_001


def test_snapshots_replace_batches(spark, tmp_path):
    feed, table, kept = str(tmp_path / "feed"), str(tmp_path / "table"), str(tmp_path / "kept")
    spark.createDataFrame([], GENERATIONS).write.parquet(feed)
    stream = spark.readStream.schema(GENERATIONS).parquet(feed)
    for k in range(7):
        spark.createDataFrame([(k % 3, k, float(-k), 0.0)], GENERATIONS).write.mode("append").parquet(feed)
        training_log.keep_state(stream, table, kept, compact_every=2).awaitTermination()
        got = {r["Run"]: r["last_epoch"] for r in training_log.read_state(spark, table).collect()}
        assert got == {r: max(j for j in range(k + 1) if j % 3 == r) for r in range(min(3, k + 1))}
    found = training_log._versions(table)
    assert len(found) <= 5 and sum(kind == "state" for kind, _ in found) <= 2
    assert training_log.read_state(spark, str(tmp_path / "nothing")).count() == 0


# -- curves over arriving runs

def scored(spark, runs, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(r, int(y), float(round(p, 2))) for r in runs for y, p in zip(rng.integers(0, 2, 80), rng.random(80))]
    return spark.createDataFrame(rows, "run int, label int, prob double")


def test_arriving_runs_equal_all_runs(spark, tmp_path):
    root, rows = str(tmp_path / "root"), scored(spark, range(6)).persist()
    for batch in ((0,), (1, 2), (3, 4, 5), (1, 2)):
        arriving.add_runs(rows.where(F.col("run").isin(*batch)), root, str(batch))

    def same():
        want = roc.mean_roc(roc.fit_ranked_scores(rows)).orderBy("g").collect()
        got = arriving.stored_mean_roc(spark, root).orderBy("g").collect()
        assert [(r["g"], r["curves"]) for r in got] == [(r["g"], r["curves"]) for r in want]
        for c in ("fpr", "mean_tpr", "std_tpr"):
            assert [r[c] for r in got] == pytest.approx([r[c] for r in want], abs=1e-12)
        pooled = arriving.fit_stored_auc(spark, root).first()["pooled_auc"]
        assert pooled == pytest.approx(roc.fit_pooled_auc(rows).first()["pooled_auc"], rel=1e-12)

    same()
    arriving.merge_batches(spark, root, "early", ["(0,)", "(1, 2)"])
    same()
    with pytest.raises(ValueError):
        arriving.merge_batches(spark, root, "x", ["gone"])
    with pytest.raises(ValueError):
        arriving.merge_batches(spark, root, "early", ["(3, 4, 5)"])
    # a further run reads only its own rows
    arriving.add_runs(scored(spark, [9], 1), root, "late")
    assert arriving.stored_mean_roc(spark, root).agg(F.max("curves")).first()[0] == 7


def test_runs_of_one_class_have_no_curve(spark, tmp_path):
    root = str(tmp_path / "root")
    assert arriving.stored_mean_roc(spark, root).count() == 0
    one = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.7)], "run int, label int, prob double")
    arriving.add_runs(one, root, "a")
    assert arriving.stored_mean_roc(spark, root).count() == 0
    assert math.isnan(arriving.fit_stored_auc(spark, root).first()["pooled_auc"])
