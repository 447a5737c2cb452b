"""Quantile binning and mutual information between columns."""

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallysift.operators.quantiles import as_number, fit_quantiles

NO_BIN = -1  # fixed value: bin of missing values
MAX_TASK_CELLS = 32_000_000
MAX_VALUE = 2048


def fit_bin_edges(
    df: DataFrame, features: list[str], bins: int = 20, method: str = "quantile", **quantile_args
) -> dict[str, list[float]]:
    """Bin edges per feature: distinct quantiles, or equal widths between the extremes.

    ``quantile`` falls back to ``width`` for a feature whose quantiles cannot be formed; a
    feature without values gets no edges, so all its rows share one bin.
    """
    if method not in ("quantile", "width"):
        raise ValueError(f"unknown binning method {method!r}")
    probs = [i / bins for i in range(bins + 1)] if method == "quantile" else []
    edges = {}
    for c, stats in fit_quantiles(df, features, probs, **quantile_args).items():
        if not stats.rows:
            edges[c] = []
        elif stats.quantiles:
            edges[c] = sorted(set(stats.quantiles))
        else:
            edges[c] = _equal_widths(stats.low, stats.high, bins)
    return edges


def bin_columns(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Replace each feature by its bin number: right-closed bins, the lowest edge in bin 0.

    Missing values, and all values of a feature with fewer than two edges, get bin -1.
    """
    binned = df.withColumns({c: as_number(c) for c in edges})
    several = {c: e for c, e in edges.items() if len(e) > 2}
    if several:
        # Bucketizer closes buckets on the left; on negated values that is the right
        negated = binned.withColumns({f"-{c}": -F.col(c) for c in several})
        binned = Bucketizer(
            splitsArray=[[-math.inf, *[-v for v in reversed(e[1:-1])], math.inf] for e in several.values()],
            inputCols=[f"-{c}" for c in several], outputCols=[f"bin {c}" for c in several],
            handleInvalid="keep",
        ).transform(negated)
    place = {
        c: F.lit(len(e) - 2) - F.col(f"bin {c}").cast("int") if c in several
        else F.lit(0 if len(e) == 2 else NO_BIN)
        for c, e in edges.items()
    }
    return binned.select([
        F.when(F.col(c).isNull(), NO_BIN).otherwise(place[c]).alias(c) if c in edges else F.col(c)
        for c in df.columns
    ])


def pair_cells(binned: DataFrame, columns: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """Rows per cell of each pair of integer columns, named by position: (i, j, a, b, n).

    Unfolding every row into its pairs would cost rows x columns^2 rows before aggregation. Each
    task counts whole Arrow batches into arrays instead and emits the filled cells, at most
    (bins + 1)^2 per pair; Spark adds them up. When the arrays would outgrow
    ``MAX_TASK_CELLS`` a task emits after every batch and holds one column's pairs at a time.
    """
    limit, highest = MAX_TASK_CELLS, MAX_VALUE
    partners: dict[int, list[int]] = {}
    for i, j in pairs:
        partners.setdefault(i, []).append(j)

    def count(batches):
        import numpy as np
        import pyarrow as pa

        def emit(i, base, tallies):
            for j, cells in tallies.items():
                filled = np.flatnonzero(cells)
                a, b = filled // base, filled % base
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(filled), v, np.int32)) for v in (i, j)]
                    + [pa.array((v - 1).astype(np.int32)) for v in (a, b)] + [pa.array(cells[filled])],
                    names=["i", "j", "a", "b", "n"])

        kept, base = {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [c.to_numpy(zero_copy_only=False).astype(np.int64) + 1 for c in batch.columns]
            needed = int(max(v.max() for v in values)) + 1
            if needed > highest + 2 or min(v.min() for v in values) < 0:
                raise ValueError(f"columns must hold integers from -1 to {highest}; bin them first")
            if needed > base:
                for i, tallies in kept.items():
                    yield from emit(i, base, tallies)
                kept, base = {}, needed
            for i, others in partners.items():
                tallies = kept.pop(i, {})
                for j in others:
                    cells = np.bincount(values[i] * base + values[j], minlength=base * base)
                    tallies[j] = tallies[j] + cells if j in tallies else cells
                if len(pairs) * base * base > limit:
                    yield from emit(i, base, tallies)
                else:
                    kept[i] = tallies
        for i, tallies in kept.items():
            yield from emit(i, base, tallies)

    return binned.select([F.col(c).cast("int").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(
        count, "i int, j int, a int, b int, n long").groupBy("i", "j", "a", "b").agg(F.sum("n").alias("n"))


def mutual_information(
    binned: DataFrame, columns: list[str], pairs: list[tuple[int, int]] | None = None
) -> DataFrame:
    """Mutual information (natural log) of pairs of integer columns from -1 up; default: all pairs.

    With entropies written over plain counts, I(a,b) = ln N + (S_ab - S_a - S_b) / N where
    S = sum n ln n. A column paired with itself has its own histogram as cells, so no marginal
    is joined back to the cells and one scan serves all pairs.
    """
    width = range(len(columns))
    wanted = pairs if pairs is not None else [(i, j) for i in width for j in width if i < j]
    alone = [(i, i) for i in sorted({i for pair in wanted for i in pair})]
    sums = pair_cells(binned, columns, [*wanted, *alone]).groupBy("i", "j").agg(
        F.sum(F.col("n") * F.log("n")).alias("s"), F.sum("n").alias("rows"))
    own = F.max(F.when(F.col("i") == F.col("j"), F.col("s")))
    joint = sums.select(
        "*", own.over(Window.partitionBy("i")).alias("s_i"), own.over(Window.partitionBy("j")).alias("s_j"),
    ).filter("i != j")
    value = F.log("rows") + (F.col("s") - F.col("s_i") - F.col("s_j")) / F.col("rows")
    name = F.lit(columns)
    return joint.select(
        F.get(name, "i").alias("f1"), F.get(name, "j").alias("f2"),
        F.greatest(F.lit(0.0), value).alias("mi"),
    )


def importance(binned: DataFrame, features: list[str], label: str) -> DataFrame:
    """Mutual information of each binned feature with the label."""
    last = len(features)
    found = mutual_information(binned, [*features, label], [(i, last) for i in range(last)])
    return found.select(F.col("f1").alias("feature"), "mi")


def redundancy(binned: DataFrame, features: list[str]) -> DataFrame:
    """Mutual information of every unordered feature pair; each pair appears once."""
    return mutual_information(binned, features)


def relevance_and_redundancy(binned: DataFrame, features: list[str], label: str) -> DataFrame:
    """Both in one pass over the rows: pairs whose second column is the label carry the relevance."""
    return mutual_information(binned, [*features, label])


def _equal_widths(low: float, high: float, bins: int) -> list[float]:
    if low == high:
        pad = 0.001 * abs(low) if low else 0.001
        low, high = low - pad, high + pad
        shift = 0.0
    else:
        shift = (high - low) * 0.001
    step = (high - low) / bins
    edges = [i * step + low for i in range(bins)] + [high]
    edges[0] -= shift
    return edges
