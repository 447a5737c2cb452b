"""Labelled input tables: one file, or a ready train/test pair."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallysift.session import scratch_dir

# The texts a CSV field may hold for "missing".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# What counts as a number: digits with a point and an exponent, or infinity; no type letters at the end.
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$|^\s*[+-]?inf(inity)?\s*$"


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, fmt: str = "csv") -> DataFrame:
    """Read a table with a header row.

    With ``schema`` nothing is inferred (the way to read large CSV data); columns are found by
    their header, absent ones are null. Without one, the column types integer, double, boolean or
    text come from one extra aggregate over the file. ``MISSING_TOKENS`` are null on both paths, and
    a value that does not fit its column's type is an error.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt != "csv":
        raise ValueError(f"unknown table format {fmt!r}")
    raw = _as_text(spark, path)
    if schema is not None:
        present = [f for f in schema.fields if f.name in raw.columns]
        cast = _cast(raw, {f.name: f.dataType.simpleString() for f in present}, [f.name for f in present])
        return cast.select([
            _quoted(f.name) if f in present else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    return _cast(raw, fit_column_types(raw))


def read_labelled(
    spark: SparkSession,
    data_path: str | None = None,
    train_path: str | None = None,
    test_path: str | None = None,
    schema: StructType | None = None,
    fmt: str = "csv",
    split_col: str = "split",
) -> DataFrame:
    """Read a single table, or a train/test pair stacked under a ``split`` column."""
    pair = train_path is not None and test_path is not None
    single = data_path is not None
    if pair and single:
        raise ValueError("give data_path or train_path + test_path, not both")
    if not pair and not single:
        raise ValueError("give data_path, or both train_path and test_path")
    if single:
        return read_table(spark, data_path, schema, fmt)
    if fmt == "csv" and schema is None:
        train_raw, test_raw = _as_text(spark, train_path), _as_text(spark, test_path)
        types = fit_column_types(train_raw.unionByName(test_raw, allowMissingColumns=True))
        train, test = _cast(train_raw, types), _cast(test_raw, types)
    else:
        train = read_table(spark, train_path, schema, fmt)
        test = read_table(spark, test_path, schema, fmt)
    return stack_splits(train, test, split_col)


def stack_splits(train: DataFrame, test: DataFrame, split_col: str = "split") -> DataFrame:
    """Stack two frames by name; columns one side lacks become null."""
    return train.withColumn(split_col, F.lit("train")).unionByName(
        test.withColumn(split_col, F.lit("test")), allowMissingColumns=True
    )


def with_row_key(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Give every row an identity by writing the table once to the shared folder.

    Splitting needs a stable key; numbering rows inside a plan is not stable under task
    retries, reading numbers back from a written table is.
    """
    path = scratch_dir(df.sparkSession, "row-key")
    df.withColumn(key, F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def separable_dataset(spark: SparkSession, features: int, rows: int = 100) -> DataFrame:
    """Even rows sit at pi with label 1, odd rows at 0 with label 0."""
    even = F.col("id") % 2 == 0
    value = F.when(even, F.lit(math.pi)).otherwise(F.lit(0.0))
    return spark.range(rows).select(
        F.col("id").alias("row_id"),
        *[value.alias(f"x{i}") for i in range(features)],
        F.when(even, 1).otherwise(0).alias("label"),
    )


def fit_column_types(raw: DataFrame) -> dict[str, str]:
    """Narrowest type each text column parses as, decided in one aggregate."""
    flag = lambda c: F.lower(c).isin("true", "false")
    checks = []
    for i, name in enumerate(raw.columns):
        c = _quoted(name)
        checks += [
            F.count(c).alias(f"n{i}"),
            F.count_if(c.isNotNull() & c.try_cast("bigint").isNull()).alias(f"l{i}"),
            F.count_if(c.isNotNull() & (~c.rlike(NUMBER) | c.try_cast("double").isNull())).alias(f"d{i}"),
            F.count_if(c.isNotNull() & ~flag(c)).alias(f"b{i}"),
        ]
    row = raw.agg(*checks).first()
    types = {}
    for i, name in enumerate(raw.columns):
        if row[f"n{i}"] == 0:
            types[name] = "double"
        elif row[f"l{i}"] == 0:
            types[name] = "bigint"
        elif row[f"d{i}"] == 0:
            types[name] = "double"
        elif row[f"b{i}"] == 0:
            types[name] = "boolean"
        else:
            types[name] = "string"
    return types


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _as_text(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select([
        F.when(~_quoted(c).isin(*MISSING_TOKENS), _quoted(c)).alias(c) for c in raw.columns
    ])


def _cast(raw: DataFrame, types: dict[str, str], names: list[str] | None = None) -> DataFrame:
    return raw.select([_fitted(c, types.get(c, "string")) for c in (raw.columns if names is None else names)])


def _fitted(name: str, kind: str) -> Column:
    """The column in its type; a value that does not fit stops the job instead of becoming null."""
    c = _quoted(name)
    if kind == "string":
        return c
    misfit = F.concat(F.lit(f"column {name}: no {kind}: "), c)
    return F.coalesce(c.try_cast(kind), F.when(c.isNotNull(), F.raise_error(misfit).cast(kind))).alias(name)
