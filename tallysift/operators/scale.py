"""Median imputation and min-max scaling to [0, pi], fitted on the training rows."""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysift.operators.quantiles import as_number, fit_quantiles


@dataclass(frozen=True)
class ScaleModel:
    """Per feature (median, low, high); features without any training value are in ``empty``."""

    bounds: dict[str, tuple[float, float, float]]
    empty: tuple[str, ...]

    @property
    def features(self) -> list[str]:
        return list(self.bounds)


def fit_scale(train: DataFrame, features: list[str], approx: bool = False, **quantile_args) -> ScaleModel:
    """Learn median, minimum and maximum of each feature.

    A median lies between the extremes, so imputing first would not move them: one fit
    serves both steps.
    """
    stats = fit_quantiles(train, features, [0.5], approx=approx, **quantile_args)
    bounds = {c: (s.quantiles[0], s.low, s.high) for c, s in stats.items() if s.rows}
    return ScaleModel(bounds, tuple(c for c in features if c not in bounds))


def scale_table(spark: SparkSession, model: ScaleModel) -> DataFrame:
    """The fitted parameters as a table."""
    rows = [(c, *map(float, b)) for c, b in model.bounds.items()]
    return spark.createDataFrame(rows, "feature string, median double, lo double, hi double")


def impute(df: DataFrame, model: ScaleModel) -> DataFrame:
    """Fill missing values with the training median; drop features that have none."""
    return df.drop(*model.empty).withColumns({c: _filled(c, b) for c, b in model.bounds.items()})


def scale(df: DataFrame, model: ScaleModel) -> DataFrame:
    """Map the training range of each feature to [0, pi]; other rows are not clipped."""
    return df.withColumns({c: _scaled(F.col(c), b) for c, b in model.bounds.items()})


def impute_and_scale(df: DataFrame, model: ScaleModel) -> DataFrame:
    """Both steps as one projection."""
    return df.drop(*model.empty).withColumns({
        c: _scaled(_filled(c, b), b) for c, b in model.bounds.items()
    })


def _filled(name: str, bounds) -> Column:
    return F.coalesce(as_number(name), F.lit(float(bounds[0])))


def _scaled(value: Column, bounds) -> Column:
    _, low, high = bounds
    factor = math.pi / ((high - low) or 1.0)
    return value * F.lit(factor) - F.lit(low * factor)
