"""Feature subsets of least energy: coefficients, exact and annealed minimum, alpha search.

The inputs are the mutual-information tables, whose size depends on the number of features
only. Energy of a subset S for a weight alpha:
    sum over S of -alpha * I_i, plus sum over pairs in S of 2 * (1 - alpha) * R_ij,
where a feature whose alpha * I_i falls below epsilon pays the penalty mu instead.
"""

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPSILON = 1e-8  # fixed value: relevance below this counts as none
ALPHA_WIDTH = 1e-6  # fixed value: the alpha search stops below this interval width
EXACT_FEATURES = 22


@dataclass(frozen=True)
class MiTables:
    """Relevance per feature and redundancy per pair, in feature order."""

    features: tuple[str, ...]
    relevance: tuple[float, ...]
    redundancy: dict[tuple[int, int], float]


@dataclass(frozen=True)
class SubsetChoice:
    features: list[str]
    alpha: float
    reached_k: bool
    trail: list[tuple[float, int]] = field(default_factory=list)


def fit_mi_tables(mi: DataFrame, features: list[str], label: str) -> MiTables:
    """Bring the mutual-information table of ``relevance_and_redundancy`` into feature order."""
    place = {c: i for i, c in enumerate(features)}
    relevance, pairs = [0.0] * len(features), {}
    for r in mi.collect():
        if r["f2"] == label:
            relevance[place[r["f1"]]] = r["mi"]
        else:
            i, j = sorted((place[r["f1"]], place[r["f2"]]))
            pairs[i, j] = r["mi"]
    return MiTables(tuple(features), tuple(relevance), pairs)


def qubo_coefficients(mi: DataFrame, label: str, alphas: list[float], epsilon: float = EPSILON) -> DataFrame:
    """Coefficient table (alpha, f1, f2, coef) for each alpha; f1 = f2 on the diagonal.

    ``mi`` comes from ``relevance_and_redundancy``: one counting pass over the rows.
    """
    single, weight = F.col("f2") == label, F.col("alpha")
    rows = mi.withColumn("alpha", F.explode(F.lit([float(a) for a in alphas]))).select(
        "alpha", "f1", F.when(single, F.col("f1")).otherwise(F.col("f2")).alias("f2"), "mi",
        F.when(single, -weight * F.col("mi")).otherwise(2 * (1 - weight) * F.col("mi")).alias("raw"))
    peak = F.max("raw").over(Window.partitionBy("alpha"))
    penalised = (F.col("f1") == F.col("f2")) & (weight * F.col("mi") < epsilon)
    return rows.select(
        "alpha", "f1", "f2",
        F.when(penalised, F.when(peak > 0, peak).otherwise(1.0)).otherwise(F.col("raw")).alias("coef"))


def subset_table(spark: SparkSession, tables: MiTables) -> DataFrame:
    """All 2^n subsets (bit i = feature i) with their summed relevance and redundancy."""
    n = len(tables.features)
    if n > EXACT_FEATURES:
        raise ValueError(f"exact search covers at most {EXACT_FEATURES} features, got {n}")
    bits = [F.shiftright("mask", i).bitwiseAND(F.lit(1)) == 1 for i in range(n)]
    gained = _total([F.when(bits[i], tables.relevance[i]).otherwise(0.0) for i in range(n)])
    rows = []
    for i in range(n):
        partners = [
            F.when(bits[j], tables.redundancy[i, j]).otherwise(0.0) for j in range(i + 1, n)
            if tables.redundancy.get((i, j))
        ]
        if partners:
            rows.append(F.when(bits[i], _total(partners)).otherwise(0.0))
    return spark.range(2 ** n).select(F.col("id").alias("mask")).select(
        "mask", F.bit_count("mask").alias("size"),
        gained.alias("relevance"), _total(rows).alias("redundancy"),
    )


def subset_energy(tables: MiTables, alpha: float, epsilon: float = EPSILON) -> Column:
    """Energy of a ``subset_table`` row at one alpha."""
    low = [i for i, v in enumerate(tables.relevance) if alpha * v < epsilon]
    energy = F.lit(-alpha) * F.col("relevance") + F.lit(2 * (1 - alpha)) * F.col("redundancy")
    if low:
        mask = F.col("mask").bitwiseAND(F.lit(sum(1 << i for i in low)))
        waived = _total([
            F.when(F.shiftright("mask", i).bitwiseAND(F.lit(1)) == 1, tables.relevance[i]).otherwise(0.0)
            for i in low
        ])
        energy = energy + F.lit(alpha) * waived + F.lit(_penalty(tables, alpha)) * F.bit_count(mask)
    return energy


def exact_minimum(
    subsets: DataFrame, tables: MiTables, alphas: list[float], epsilon: float = EPSILON
) -> DataFrame:
    """Least-energy subset per alpha, all alphas in one scan; ties go to the smallest mask."""
    best = subsets.agg(F.array(*[
        F.min(F.struct(subset_energy(tables, a, epsilon).alias("energy"), "mask", "size")) for a in alphas
    ]).alias("best"))
    lines = best.select(F.posexplode("best").alias("i", "b"))
    return lines.select(
        F.get(F.lit([float(a) for a in alphas]), "i").alias("alpha"),
        F.col("b.mask").alias("mask"), F.col("b.size").alias("size"), F.col("b.energy").alias("energy"),
    )


@dataclass(frozen=True)
class Envelope:
    """Subsets that are of least energy at some alpha, for every set of penalised features."""

    tables: MiTables
    epsilon: float
    masks: dict[int, list[int]]  # penalised features (bit i = feature i) -> subsets

    def minimum(self, alpha: float) -> int:
        """The least-energy subset at ``alpha``; ties go to the smallest mask."""
        linear, pairs = _coefficients(self.tables, alpha, self.epsilon)
        low = sum(1 << i for i, v in enumerate(self.tables.relevance) if alpha * v < self.epsilon)

        def energy(mask: int) -> float:
            own = [i for i in range(len(linear)) if mask >> i & 1]
            return sum(linear[i] for i in own) + sum(pairs.get((i, j), 0.0) for a, i in enumerate(own) for j in own[a + 1:])

        return min((energy(m), m) for m in self.masks[low])[1]


def fit_envelope(spark: SparkSession, tables: MiTables, epsilon: float = EPSILON) -> Envelope:
    """One scan of all subsets for every alpha of the search at once.

    For a fixed set of penalised features the energy of a subset is a line in alpha, so only subsets on the
    lower envelope of these lines can ever be the minimum. Each task keeps its envelopes' lines, and the
    envelope of these few is that of all.
    """
    n = len(tables.features)
    if n > EXACT_FEATURES:
        raise ValueError(f"exact search covers at most {EXACT_FEATURES} features, got {n}")
    spans = _penalty_spans(tables, epsilon)
    linear = {low: [_coefficients(tables, t, epsilon, low) for t in ends] for low, ends in spans.items()}

    def scan(batches):
        import pyarrow as pa

        kept = {low: np.zeros(0, np.int64) for low in spans}
        for batch in batches:
            masks = batch.column(0).to_numpy()
            for low, ends in linear.items():
                found = _lower_envelope(masks, *(_energies(masks, *c) for c in ends))
                kept[low] = np.concatenate([kept[low], found])
        for low, masks in kept.items():
            masks = _lower_envelope(masks, *(_energies(masks, *c) for c in linear[low]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(masks), low)), pa.array(masks)], names=["low", "mask"])

    found: dict[int, list[int]] = {low: [] for low in spans}
    for r in spark.range(2 ** n).mapInArrow(scan, "low long, mask long").collect():
        found[r["low"]].append(r["mask"])
    return Envelope(tables, epsilon, found)


def qubo(tables: MiTables, alpha: float, epsilon: float = EPSILON) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Linear and pair coefficients at one alpha, in feature order."""
    return _coefficients(tables, alpha, epsilon)


def _penalty_spans(tables: MiTables, epsilon: float) -> dict[int, tuple[float, float]]:
    """Sets of penalised features that some alpha of the search has, with the least and greatest such alpha."""
    least = 0.5
    while least >= ALPHA_WIDTH:
        least /= 2
    edges = sorted({epsilon / v for v in tables.relevance if v > 0 and least <= epsilon / v < 1} | {least, 1.0})
    spans = {}
    for a, b in zip(edges, edges[1:]):
        middle = (a + b) / 2
        low = sum(1 << i for i, v in enumerate(tables.relevance) if middle * v < epsilon)
        spans[low] = (min(spans.get(low, (a, b))[0], a), b)
    return spans


def _energies(masks: np.ndarray, linear: list[float], pairs: dict[tuple[int, int], float]) -> np.ndarray:
    bits = (masks[:, None] >> np.arange(len(linear)) & 1).astype(float)
    coupling = np.zeros((len(linear), len(linear)))
    for (i, j), v in pairs.items():
        coupling[i, j] = v
    return bits @ np.array(linear) + ((bits @ coupling) * bits).sum(axis=1)


def _lower_envelope(masks: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Masks of the lines on the lower envelope between two ends, given the lines' values there.

    Between two lines of the envelope lies another one if something is below where they cross. Lines that only
    touch the envelope are kept too: rounding must not decide between them here.
    """
    if not len(masks):
        return masks
    scale = max(1.0, float(np.abs(left).max()), float(np.abs(right).max()))
    near, found, open_ = 1e-12 * scale, set(), []

    def lowest(t: float) -> int:
        values = (1 - t) * left + t * right
        ties = np.flatnonzero(values <= values.min() + near)
        found.update(ties[np.argsort(masks[ties])][:64].tolist())
        return int(ties[np.argmin(masks[ties])])

    open_.append((0.0, lowest(0.0), 1.0, lowest(1.0)))
    while open_:
        a, i, b, j = open_.pop()
        if i == j or b - a < 1e-15:
            continue
        gap_a, gap_b = ((1 - t) * (left[i] - left[j]) + t * (right[i] - right[j]) for t in (a, b))
        if gap_a >= 0 or gap_b <= 0:
            continue
        t = a + (b - a) * gap_a / (gap_a - gap_b)
        k = lowest(t)
        value = (1 - t) * left[k] + t * right[k]
        if value < (1 - t) * left[i] + t * right[i] - near:
            open_ += [(a, i, t, k), (t, k, b, j)]
    return masks[sorted(found)]


def annealed_reads(
    spark: SparkSession, tables: MiTables, alpha: float, num_reads: int, seed: int,
    epsilon: float = EPSILON, sweeps: int = 1000,
) -> DataFrame:
    """Independent annealing reads, one row each: (read, energy, bits).

    Read r draws from its own generator seeded ``seed + r``, so the table does not depend on
    how reads are spread over tasks.
    """
    linear, pairs = _coefficients(tables, alpha, epsilon)
    n = len(linear)

    def anneal(batches):
        import numpy as np
        import pandas as pd

        coupling = np.zeros((n, n))
        for (i, j), v in pairs.items():
            coupling[i, j] = coupling[j, i] = v
        bias = np.array(linear)
        steps = np.abs(bias) + np.abs(coupling).sum(axis=1)
        parts = np.abs(np.concatenate([bias, coupling.ravel()]))
        smallest = parts[parts > 0].min() if (parts > 0).any() else 1.0
        betas = np.geomspace(np.log(2) / max(steps.max(), 1e-300), np.log(100) / smallest, sweeps)
        for batch in batches:
            reads = batch["id"].to_numpy()
            draws = [np.random.default_rng(seed + int(r)) for r in reads]
            state = np.array([d.integers(0, 2, n) for d in draws], dtype=float)
            for beta in betas:
                chance = np.array([d.random(n) for d in draws])
                for i in range(n):
                    change = (1 - 2 * state[:, i]) * (bias[i] + state @ coupling[i])
                    flip = chance[:, i] < np.exp(-beta * np.maximum(change, 0.0))
                    state[flip, i] = 1 - state[flip, i]
            energy = state @ bias + ((state @ coupling) * state).sum(axis=1) / 2
            bits = ["".join("1" if b else "0" for b in row) for row in state]
            yield pd.DataFrame({"read": reads, "energy": energy, "bits": bits})

    workers = min(num_reads, spark.sparkContext.defaultParallelism)
    return spark.range(num_reads, numPartitions=workers).mapInPandas(
        anneal, "read long, energy double, bits string")


def annealed_minimum(reads: DataFrame) -> DataFrame:
    """The best read; ties go to the smallest bit string."""
    return reads.agg(F.min(F.struct("energy", "bits")).alias("b")).select("b.energy", "b.bits")


def fit_subset(
    spark: SparkSession, tables: MiTables, k: int, method: str, num_reads: int = 1000, seed: int = 0,
    epsilon: float = EPSILON, sweeps: int = 1000,
) -> SubsetChoice:
    """Halve the alpha interval from 0.5 until the best subset has exactly ``k`` features.

    More than k lowers the upper end, fewer raise the lower end. Once the interval is narrower
    than 1e-6 the last subset is returned with ``reached_k=False``. Method ``exact`` looks at every
    subset once, whatever the number of alphas, and refuses more than ``EXACT_FEATURES`` features;
    ``bounded`` proves the minimum of more features by branch and bound; ``annealed`` searches.
    """
    if method not in ("exact", "bounded", "annealed"):
        raise ValueError(f"unknown method {method!r}")
    if method == "annealed":
        def solve(alpha, lower, upper):
            reads = annealed_reads(spark, tables, alpha, num_reads, seed, epsilon, sweeps)
            bits = annealed_minimum(reads).first()["bits"]
            return [f for f, b in zip(tables.features, bits) if b == "1"]

        return _search(solve, k)
    if method == "bounded":
        from tallysift.operators.branch_bound import fit_bounded_minimum

        known: list[int] = []

        def solve(alpha, lower, upper):
            found = fit_bounded_minimum(spark, *_coefficients(tables, alpha, epsilon), starts=known)
            known.append(found.mask)
            return [f for i, f in enumerate(tables.features) if found.mask >> i & 1]

        return _search(solve, k)
    lines = fit_envelope(spark, tables, epsilon)

    def solve(alpha, lower, upper):
        mask = lines.minimum(alpha)
        return [f for i, f in enumerate(tables.features) if mask >> i & 1]

    return _search(solve, k)


def _search(solve, k: int) -> SubsetChoice:
    lower, upper, trail = 0.0, 1.0, []
    while True:
        alpha = (lower + upper) / 2
        chosen = solve(alpha, lower, upper)
        trail.append((alpha, len(chosen)))
        if len(chosen) == k:
            return SubsetChoice(chosen, alpha, True, trail)
        if len(chosen) > k:
            upper = alpha
        else:
            lower = alpha
        if upper - lower < ALPHA_WIDTH:
            return SubsetChoice(chosen, alpha, False, trail)


def _penalty(tables: MiTables, alpha: float) -> float:
    raw = [-alpha * v for v in tables.relevance]
    raw += [2 * (1 - alpha) * v for v in tables.redundancy.values()]
    peak = max(raw)
    return peak if peak > 0 else 1.0


def _coefficients(tables: MiTables, alpha: float, epsilon: float, low: int | None = None):
    """Linear and pair coefficients; ``low``: the penalised features, if they don't follow from ``alpha``."""
    mu = _penalty(tables, alpha)
    waived = [alpha * v < epsilon if low is None else low >> i & 1 for i, v in enumerate(tables.relevance)]
    linear = [mu if w else -alpha * v for v, w in zip(tables.relevance, waived)]
    pairs = {ij: 2 * (1 - alpha) * v for ij, v in tables.redundancy.items()}
    return linear, pairs


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))
