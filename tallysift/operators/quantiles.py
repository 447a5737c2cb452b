"""Exact quantiles of many columns at any table size."""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallysift.operators.blocks import DIRECT
from tallysift.operators.rank_sketch import LEVEL_VALUES, RankSketch

BINS = 4096
#: Distinct values between the bounds of all wanted ranks that are counted one by one.
MAX_BETWEEN = 4_000_000


@dataclass(frozen=True)
class ColumnStats:
    """Non-null rows, extremes and the requested quantiles of one column."""

    rows: int
    low: float | None
    high: float | None
    quantiles: tuple[float, ...]


def as_number(name: str) -> Column:
    """The column as a double whose NaN counts as missing."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def fit_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], approx: bool = False,
    bins: int = BINS, accuracy: int = 100_000, level_values: int = LEVEL_VALUES,
) -> dict[str, ColumnStats]:
    """Quantiles with linear interpolation between neighbours.

    Spark's ``percentile`` keeps every distinct value of a column in one buffer. Here a first pass sketches
    the columns' order; a sketch of fewer than ``level_values`` rows is exact. The sketch names for every wanted rank two
    values that the ranked one lies between for certain, and a second pass counts the values between them,
    and only the number of those below. So two passes are exact, whatever the values look like. Where more
    than ``MAX_BETWEEN`` values may lie between (tables of 10**8 rows and more), these are counted in bins and
    the bins that hold a rank are counted again. ``approx`` trades exactness for a single sketch pass of Spark's.
    """
    sketch = approx and bool(probs)
    if probs and not approx:
        return _exact(df, columns, probs, bins, level_values)
    head = df.agg(*[
        agg for i, c in enumerate(columns) for agg in (
            F.count(as_number(c)).alias(f"n{i}"),
            F.min(as_number(c)).alias(f"a{i}"),
            F.max(as_number(c)).alias(f"b{i}"),
            *([F.percentile_approx(as_number(c), probs, accuracy).alias(f"q{i}")] if sketch else []),
        )
    ]).first()
    basics = {c: (head[f"n{i}"], head[f"a{i}"], head[f"b{i}"]) for i, c in enumerate(columns)}
    for c, (n, low, high) in basics.items():
        if n and (math.isinf(low) or math.isinf(high)):
            raise ValueError(f"column {c!r} holds infinite values")
    values = {c: tuple(head[f"q{i}"]) for i, c in enumerate(columns) if sketch and basics[c][0]}
    return {c: ColumnStats(*basics[c], values.get(c, ())) for c in columns}


def _exact(df: DataFrame, columns: list[str], probs: list[float], bins: int, level_values: int) -> dict[str, ColumnStats]:
    sketches = _sketched(df, columns, level_values)
    known: dict[tuple[str, int], float] = {}
    between: dict[str, list[tuple[float, float, list[int]]]] = {}
    for c in columns:
        s = sketches[c]
        if s.rows and (math.isinf(s.low) or math.isinf(s.high)):
            raise ValueError(f"column {c!r} holds infinite values")
        ranks = sorted({r for p in probs for r in _neighbours(p, s.rows)}) if s.rows else []
        known.update({(c, r): s.low for r in ranks if r == 0 or s.low == s.high})
        known.update({(c, r): s.high for r in ranks if r == s.rows - 1})
        rest = [r for r in ranks if (c, r) not in known]
        for r, (low, high) in zip(rest, s.brackets(rest)):
            if not s.error:
                known[c, r] = high
            elif between.get(c) and low < between[c][-1][1]:
                before = between[c].pop()
                between[c].append((min(before[0], low), max(before[1], high), [*before[2], r]))
            else:
                between.setdefault(c, []).append((low, high, [r]))
    most = sum(sketches[c].most_values([(low, high) for low, high, _ in parts]) for c, parts in between.items())
    if between and most <= MAX_BETWEEN:
        known.update(_counted_between(df, between))
    elif between:
        below = df.agg(*[F.count_if(as_number(c) <= low).alias(f"b{i}_{j}")
                         for i, (c, parts) in enumerate(between.items()) for j, (low, _, _) in enumerate(parts)]).first()
        spans: dict[str, list[tuple[float, float, int, list[int]]]] = {}
        for i, (c, parts) in enumerate(between.items()):
            for j, (low, high, ranks) in enumerate(parts):
                low = max(math.nextafter(low, math.inf), sketches[c].low)
                if low < high:
                    spans.setdefault(c, []).append((low, high, below[f"b{i}_{j}"], ranks))
                else:  # no room for another value
                    known.update({(c, r): high for r in ranks})
        known.update(_by_counting(df, spans, bins))
    out = {}
    for c in columns:
        n, low, high = sketches[c].rows, sketches[c].low, sketches[c].high
        out[c] = ColumnStats(n, low, high, tuple(_between(known, c, p, n) for p in probs)) if n else ColumnStats(0, None, None, ())
    return out


def _sketched(df: DataFrame, columns: list[str], level_values: int) -> dict[str, RankSketch]:
    """A sketch per column; tasks send theirs, and where there are many tasks, groups of them are merged first."""
    def run(batches):
        held = [RankSketch(level_values) for _ in columns]
        for batch in batches:
            for column, s in zip(batch.columns, held):
                s.add(column.drop_null().to_numpy(zero_copy_only=False))
        yield _rows(enumerate(held))

    def merged(batches):
        held = {}
        for batch in batches:
            _merge(held, zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        yield _rows(held.items())

    numbers = df.select(*[as_number(c).alias(f"c{i}") for i, c in enumerate(columns)])
    parts, tasks = numbers.mapInArrow(run, "c int, sketch binary"), numbers.rdd.getNumPartitions()
    while tasks > DIRECT:
        tasks = max(DIRECT, int(tasks ** 0.5))
        parts = parts.repartition(tasks).mapInArrow(merged, "c int, sketch binary")
    held: dict[int, RankSketch] = {}
    _merge(held, ((r["c"], bytes(r["sketch"])) for r in parts.collect()))
    return {c: held.get(i, RankSketch()) for i, c in enumerate(columns)}


def _merge(held: dict[int, RankSketch], found) -> None:
    for c, raw in found:
        if c in held:
            held[c].merge(RankSketch.loads(raw))
        else:
            held[c] = RankSketch.loads(raw)


def _rows(sketches) -> pa.RecordBatch:
    pairs = [(c, s.dumps()) for c, s in sketches]
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in pairs], pa.int32()), pa.array([raw for _, raw in pairs], pa.binary())],
                                      names=["c", "sketch"])


def _counted_between(df: DataFrame, between: dict[str, list[tuple[float, float, list[int]]]]) -> dict[tuple[str, int], float]:
    """The values of the wanted ranks, by counting each value between the bounds and the number of those at or below."""
    def count(batches):
        held = [{} for parts in between.values() for _ in parts]
        below = np.zeros(len(held), np.int64)
        for batch in batches:
            first = 0
            for column, parts in zip(batch.columns, between.values()):
                values = column.drop_null().to_numpy(zero_copy_only=False)
                for k, (low, high, _) in enumerate(parts, first):
                    under = values <= low
                    below[k] += int(under.sum())
                    for v, n in zip(*(x.tolist() for x in np.unique(values[~under & (values <= high)], return_counts=True))):
                        held[k][v] = held[k].get(v, 0) + n
                first += len(parts)
        for k, found in enumerate(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * (len(found) + 1), pa.int32()), pa.array([None, *found], pa.float64()),
                 pa.array([int(below[k]), *found.values()], pa.int64())], names=["span", "value", "n"])

    numbers = df.select(*[as_number(c).alias(f"c{i}") for i, c in enumerate(between)])
    counted = numbers.mapInArrow(count, "span int, value double, n long").groupBy("span", "value").agg(F.sum("n").alias("n"))
    # the row without a value comes first and holds those at or below the bounds
    upto = Window.partitionBy("span").orderBy(F.col("value").asc_nulls_first())
    wanted = [(k, r) for k, (_, _, ranks) in enumerate(p for parts in between.values() for p in parts) for r in ranks]
    ranks = df.sparkSession.createDataFrame(wanted, "span int, rank long")
    hits = (counted.withColumn("end", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
            .join(F.broadcast(ranks), "span").where("value IS NOT NULL AND end > rank AND end - n <= rank").collect())
    names = [c for c, parts in between.items() for _ in parts]
    return {(names[r["span"]], r["rank"]): r["value"] for r in hits}


def _by_counting(df, spans, bins):
    """Order statistics by repeated counting; ``spans`` are the bins still holding a wanted rank: by column the
    extremes, the number of rows below, and the ranks."""
    known: dict[tuple[str, int], float] = {}
    while spans:
        flat = [(c, *span) for c, parts in spans.items() for span in parts]
        counted = _count_bins(df, {c: [(lo, hi) for lo, hi, *_ in parts] for c, parts in spans.items()}, bins)
        upto = Window.partitionBy("span").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        wanted = df.sparkSession.createDataFrame(
            [(i, r - below) for i, (_, _, _, below, ranks) in enumerate(flat) for r in ranks],
            "span int, offset long",
        )
        hits = (
            counted.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
            .join(F.broadcast(wanted), "span")
            .filter("before <= offset and offset < before + n").collect()
        )
        spans = {}
        for hit in hits:
            c, _, _, below, _ = flat[hit["span"]]
            rank, start = below + hit["offset"], below + hit["before"]
            if hit["lo"] == hit["hi"] or rank == start:
                known[c, rank] = hit["lo"]
            elif rank == start + hit["n"] - 1:
                known[c, rank] = hit["hi"]
            else:
                parts = spans.setdefault(c, [])
                same = [p for p in parts if p[0] == hit["lo"]]
                if same:
                    same[0][3].append(rank)
                else:
                    parts.append((hit["lo"], hit["hi"], start, [rank]))
        for parts in spans.values():
            parts.sort()
    return known


def _count_bins(df: DataFrame, spans: dict[str, list[tuple[float, float]]], bins: int) -> DataFrame:
    """Rows, minimum and maximum per bin of each span; spans are numbered in order of columns.

    Each task counts its Arrow batches into one array per column and emits the filled bins;
    Spark adds them up. The spans of a column are disjoint and sorted.
    """
    def count(batches):
        import numpy as np
        import pyarrow as pa

        tallies, first = [], 0
        for parts in spans.values():
            low, high = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
            size = len(parts) * bins
            # halves where the distance between extremes would overflow
            scale = np.where(high / 2 - low / 2 > np.finfo(float).max / 2, 0.5, 1.0)
            tallies.append((first, low, high, scale, np.zeros(size, np.int64), np.full(size, np.inf), np.full(size, -np.inf)))
            first += len(parts)
        for batch in batches:
            for column, (_, low, high, scale, n, least, most) in zip(batch.columns, tallies):
                values = column.drop_null().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(high, values), len(high) - 1)
                inside = (values >= low[at]) & (values <= high[at])
                values, at = values[inside], at[inside]
                share = (values * scale[at] - low[at] * scale[at]) / (high[at] * scale[at] - low[at] * scale[at])
                place = at * bins + np.minimum((share * bins).astype(np.int64), bins - 1)
                n += np.bincount(place, minlength=len(n))
                np.minimum.at(least, place, values)
                np.maximum.at(most, place, values)
        for first, _, _, _, n, least, most in tallies:
            filled = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array((first + filled // bins).astype(np.int32)), pa.array((filled % bins).astype(np.int32)),
                 pa.array(n[filled]), pa.array(least[filled]), pa.array(most[filled])],
                names=["span", "bin", "n", "lo", "hi"])

    numbers = df.select(*[as_number(c).alias(f"c{i}") for i, c in enumerate(spans)])
    return numbers.mapInArrow(count, "span int, bin int, n long, lo double, hi double").groupBy("span", "bin").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _neighbours(p: float, n: int) -> tuple[int, int]:
    position = p * (n - 1)
    return math.floor(position), math.ceil(position)


def _between(known, column, p, n):
    left, right = _neighbours(p, n)
    a, b = known[column, left], known[column, right]
    return a if a == b else a + (b - a) * (p * (n - 1) - left)
