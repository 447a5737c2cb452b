"""Running sums over an ordered column without gathering a large group in one task."""

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_PER_RANGE = 1_000_000


def fit_cuts(groups: DataFrame, order: str, rows_per_range: int = ROWS_PER_RANGE) -> list[float]:
    """Cut points that part ``groups`` into ranges of ``order`` of about ``rows_per_range`` rows each.

    ``groups`` should be persisted: it is counted and, if there is more than one range, sketched.
    """
    ranges = -(-groups.count() // rows_per_range)
    if ranges <= 1:
        return []
    shares = ", ".join(f"{i / ranges}D" for i in range(1, ranges))
    return sorted(set(groups.agg(F.expr(f"percentile_approx(`{order}`, array({shares}), {10 * ranges})")).first()[0]))


def running_totals(
    groups: DataFrame, keys: tuple[str, ...], order: str, values: tuple[str, ...], cuts: list[float]
) -> DataFrame:
    """Add ``cum_<v>`` (running sum, ``order`` descending) and ``all_<v>`` (total) per key group.

    The ranges between the cuts are summed and offset against each other on a table of one row per
    key and range, and only rows of one key and range are sorted together. The cuts decide the
    balance, never the result.
    """
    bucketed = Bucketizer(
        splits=[-math.inf, *(cuts or [0.0]), math.inf], inputCol=order, outputCol="bucket").transform(groups)
    parts = [*keys, "bucket"]
    above = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*parts).agg(*[F.sum(v).alias(v) for v in values])
        .select(
            *parts,
            *[F.coalesce(F.sum(v).over(above), F.lit(0)).alias(f"before_{v}") for v in values],
            *[F.sum(v).over(Window.partitionBy(*keys)).alias(f"all_{v}") for v in values],
        )
    )
    inside = (Window.partitionBy(*parts).orderBy(F.desc(order))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return bucketed.join(offsets, parts).select(
        *groups.columns,
        *[(F.col(f"before_{v}") + F.sum(v).over(inside)).alias(f"cum_{v}") for v in values],
        *[F.col(f"all_{v}") for v in values],
    )
