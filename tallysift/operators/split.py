"""Exact stratified sampling and splitting that never sorts or moves the table.

Rows are ordered by md5(seed | row key). The fit finds, per class, the one key that closes the
quota; applying it is a comparison on each row.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_LABELS = 1000
DIGITS = 3  # hex digits refined per pass: 4096 groups per class


@dataclass(frozen=True)
class StrataCut:
    """Quota per class and the last (code, key) inside it; None when a class is all in or all out."""

    label: str
    keys: tuple[str, ...]
    seed: int
    sizes: dict
    quotas: dict
    last: dict


def order_code(keys: tuple[str, ...], seed: int) -> Column:
    """The sampling order of a row: deterministic, seedable, independent of partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}|"), _key_text(keys)))


def quotas_by_largest_remainder(sizes: dict, draw: int) -> dict:
    """Share ``draw`` rows among classes in proportion; remainders go to the largest fractions."""
    total = sum(sizes.values())
    exact = {k: n * draw / total for k, n in sizes.items()}
    out = {k: math.floor(v) for k, v in exact.items()}
    spare = draw - sum(out.values())
    for k in sorted(sizes, key=lambda k: (out[k] - exact[k], k))[:spare]:
        out[k] += 1
    return out


def fit_strata(
    df: DataFrame,
    label: str,
    keys: tuple[str, ...],
    seed: int,
    rows: int | None = None,
    fraction: float | None = None,
    boundary_rows: int = 100_000,
) -> StrataCut | None:
    """Find the cut that takes exactly ``rows`` (or ceil(n * fraction)) rows, stratified by label.

    Each pass counts rows per class and code prefix inside the classes' boundary groups; the
    boundary group shrinks 4096-fold per pass, and only once it holds at most
    ``boundary_rows`` rows are they ranked. Returns None when ``rows`` covers the table.
    """
    if (rows is None) == (fraction is None):
        raise ValueError("give either rows or fraction")
    keyed = df.select(
        F.col(label).alias("label"), order_code(keys, seed).alias("code"), _key_text(keys).alias("key")
    )
    groups = _prefix_counts(keyed, DIGITS).persist()
    sizes = {r["label"]: r["n"] for r in
             groups.groupBy("label").agg(F.sum("n").alias("n")).limit(MAX_LABELS + 1).collect()}
    if len(sizes) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} classes to stratify by")
    total = sum(sizes.values())
    take = rows if rows is not None else math.ceil(total * fraction)
    if rows is not None and rows >= total:
        groups.unpersist()
        return None
    if sizes and min(sizes.values()) < 2:
        raise ValueError("every class needs at least two rows to be split")
    if min(take, total - take) < len(sizes):
        raise ValueError("each part needs at least one row per class")
    others = quotas_by_largest_remainder(sizes, total - take)
    quotas = {k: n - others[k] for k, n in sizes.items()}
    inner = {k: q for k, q in quotas.items() if 0 < q < sizes[k]}
    bounds = _boundaries(groups, inner)
    groups.unpersist()
    digits = DIGITS
    while any(b["n"] > boundary_rows for b in bounds.values()) and digits < 32:
        digits += DIGITS
        left = {k: inner[k] - bounds[k]["before"] for k in inner}
        inside = keyed.filter(_any_of([
            (F.col("label") == F.lit(k)) & F.col("code").startswith(b["prefix"]) for k, b in bounds.items()
        ]))
        deeper = _boundaries(_prefix_counts(inside, digits), left)
        bounds = {
            k: {**d, "before": d["before"] + bounds[k]["before"]} for k, d in deeper.items()
        }
    return StrataCut(label, tuple(keys), seed, sizes, quotas, _last_keys(keyed, inner, bounds, boundary_rows))


def in_cut(cut: StrataCut) -> Column:
    """True for the rows the cut selects."""
    chosen = F.lit(False)
    code, key = order_code(cut.keys, cut.seed), _key_text(cut.keys)
    for k, quota in cut.quotas.items():
        if quota == 0:
            continue
        here = F.col(cut.label) == F.lit(k)
        if k in cut.last:
            last_code, last_key = cut.last[k]
            here = here & ((code < last_code) | ((code == last_code) & (key <= last_key)))
        chosen = chosen | here
    return chosen


def cap_rows(df: DataFrame, cut: StrataCut | None) -> DataFrame:
    """Keep the rows inside the cut; all of them without a cut."""
    return df if cut is None else df.filter(in_cut(cut))


def assign_split(df: DataFrame, cut: StrataCut, split_col: str = "split") -> DataFrame:
    """Mark the rows inside the cut as ``test``, the others as ``train``."""
    return df.withColumn(split_col, F.when(in_cut(cut), "test").otherwise("train"))


def class_balance(df: DataFrame, label: str, split_col: str = "split") -> DataFrame:
    """Rows and share of each class per split, share rounded to 3 places."""
    counted = df.groupBy(split_col, label).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(split_col))
    return counted.withColumn("share", F.round(F.col("n") / whole, 3))


def _key_text(keys: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys])


def _prefix_counts(keyed: DataFrame, digits: int) -> DataFrame:
    return keyed.groupBy("label", F.substring("code", 1, digits).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"))


def _boundaries(groups: DataFrame, quotas: dict) -> dict:
    """Per class the group in which its quota is used up; at most 4096 rows per class are sorted."""
    if not quotas:
        return {}
    upto = Window.partitionBy("label").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    quota = _by_label(quotas)
    found = (
        groups.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        .filter((F.col("before") < quota) & (quota <= F.col("before") + F.col("n"))).collect()
    )
    return {r["label"]: {"prefix": r["prefix"], "before": r["before"], "n": r["n"]} for r in found}


def _last_keys(keyed: DataFrame, quotas: dict, bounds: dict, boundary_rows: int) -> dict:
    if not bounds:
        return {}
    if any(b["n"] > boundary_rows for b in bounds.values()):
        raise ValueError("the key columns do not identify a row: too many rows share one key")
    inside = keyed.filter(_any_of([
        (F.col("label") == F.lit(k)) & F.col("code").startswith(b["prefix"]) for k, b in bounds.items()
    ]))
    order = Window.partitionBy("label").orderBy("code", "key")
    wanted = _by_label({k: quotas[k] - b["before"] for k, b in bounds.items()})
    ranked = inside.withColumn("place", F.row_number().over(order)).withColumn(
        "after", F.lead(F.struct("code", "key")).over(order))
    last = ranked.filter(F.col("place") == wanted).collect()
    for r in last:
        if r["after"] is not None and tuple(r["after"]) == (r["code"], r["key"]):
            raise ValueError("the key columns do not identify a row: a key repeats at the cut")
    return {r["label"]: (r["code"], r["key"]) for r in last}


def _by_label(values: dict) -> Column:
    out = None
    for k, v in values.items():
        case = (F.col("label") == F.lit(k), F.lit(v))
        out = F.when(*case) if out is None else out.when(*case)
    return out


def _any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
