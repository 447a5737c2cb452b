"""Row and column pruning, label encoding and column alignment."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysift.operators.quantiles import as_number

MISSING_CLASS = "nan"  # fixed value: how a missing category is spelled before ranking
MAX_CLASSES = 30  # fixed value: text columns with more distinct values are dropped


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """Keep the rows that have a label; NaN is none."""
    return df.filter(_present(df, target))


def null_target_counts(df: DataFrame, target: str, split_col: str | None = None) -> DataFrame:
    """How many rows a missing label removes, per split."""
    split = F.col(split_col) if split_col else F.lit("full")
    return df.groupBy(split.alias("split")).agg(
        F.count_if(~_present(df, target)).alias("dropped"),
        F.count_if(_present(df, target)).alias("kept"),
    )


def drop_identifiers(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """Drop identifier columns; absent names are ignored."""
    return df.drop(*id_cols)


@dataclass(frozen=True)
class PruneModel:
    """What pruning learned from the reference rows; all of it bounded by the column count."""

    features: tuple[str, ...]
    constant: tuple[str, ...]
    empty: tuple[str, ...]
    high_cardinality: tuple[str, ...]
    classes: dict[str, list[str]] = field(default_factory=dict)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: non-null rows and whether one single value fills them (min equals max)."""
    wide = df.agg(*_profile_aggregates(df, columns))
    lines = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"n{i}").alias("non_null"),
            F.coalesce(F.col(f"k{i}"), F.lit(False)).alias("constant"),
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*lines)))


def fit_prune(
    df: DataFrame, target: str, exclude: tuple[str, ...] = (), max_classes: int = MAX_CLASSES
) -> PruneModel:
    """Find constant, empty and high-cardinality columns and the classes of the rest.

    One aggregate profiles every column; one small distinct reads the classes of the text
    columns (see ``_fit_classes`` for how it stays small on near-unique columns).
    """
    columns = [c for c in df.columns if c != target and c not in exclude]
    text = [c for c in columns if _is_categorical(df, c)]
    estimates = [F.approx_count_distinct(_text(df, c)).alias(f"d{c}") for c in text]
    row = df.agg(*_profile_aggregates(df, columns), *estimates).first()
    empty = [c for i, c in enumerate(columns) if row[f"n{i}"] == 0]
    constant = [c for i, c in enumerate(columns) if row[f"k{i}"]]
    gone = set(empty) | set(constant)
    open_text = {c: row[f"d{c}"] for c in text if c not in gone}
    classes = _fit_classes(df, open_text, max_classes)
    high = [c for c in open_text if c not in classes]
    for i, c in enumerate(columns):
        if c in classes and row["rows"] > row[f"n{i}"]:
            classes[c] = sorted(set(classes[c]) | {MISSING_CLASS})
    gone |= set(high)
    return PruneModel(
        tuple(c for c in columns if c not in gone), tuple(constant), tuple(empty), tuple(high), classes
    )


def cardinality_report(spark: SparkSession, model: PruneModel) -> DataFrame:
    """Text columns with the verdict of the cardinality rule; classes are counted for kept ones."""
    rows = [(c, True, None) for c in model.high_cardinality]
    rows += [(c, False, len([v for v in k if v != MISSING_CLASS])) for c, k in model.classes.items()]
    return spark.createDataFrame(rows, "feature string, high_cardinality boolean, classes int")


def drop_pruned(df: DataFrame, model: PruneModel) -> DataFrame:
    """Drop what ``fit_prune`` rejected."""
    return df.drop(*model.constant, *model.empty, *model.high_cardinality)


def encoder_table(spark: SparkSession, model: PruneModel) -> DataFrame:
    """The encoder as a table: feature, class, index by sorted class text."""
    rows = [(f, v, i) for f, values in model.classes.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "feature string, cls string, idx int")


def encode(df: DataFrame, model: PruneModel) -> DataFrame:
    """Replace classes by their index, classes the fit never saw by -1, without a join."""
    return df.withColumns({
        c: (F.array_position(F.lit(values), F.coalesce(_text(df, c), F.lit(MISSING_CLASS))) - 1).cast("int")
        for c, values in model.classes.items() if c in df.columns
    })


def align(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Give ``df`` exactly the feature columns asked for; absent ones are filled with 0."""
    present = set(df.columns)
    return df.select(
        *[F.col(c) for c in keep],
        *[F.col(c) if c in present else F.lit(0).alias(c) for c in columns],
    )


def label_as_float(df: DataFrame, target: str, name: str = "label") -> DataFrame:
    """The label as a 32-bit float column next to the features of the same row."""
    label = F.col(target).cast("float")
    if name == target:
        return df.withColumn(name, label)
    return df.withColumn(name, label).drop(target)


def project(df: DataFrame, features: list[str], keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """Keep the chosen features and the columns named in ``keep``."""
    return df.select(*keep, *features)


def _profile_aggregates(df: DataFrame, columns: list[str]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        v = _text(df, c) if _is_categorical(df, c) else as_number(c)
        out += [F.count(v).alias(f"n{i}"), (F.min(v) == F.max(v)).alias(f"k{i}")]
    return out


def _fit_classes(df: DataFrame, estimates: dict[str, int], max_classes: int) -> dict[str, list[str]]:
    """Exact classes of the columns with at most ``max_classes`` of them.

    A column whose sketch says "many" is first counted on the values of one hash residue
    only: more than ``max_classes`` distinct there proves more in total, and no shuffle of a
    near-unique column takes place. Where the proof fails the column is counted in full.
    """
    found: dict[str, list[str]] = {}
    residues = {c: max(1, n // (16 * max_classes)) for c, n in estimates.items()}
    while residues:
        per_row = F.array(*[
            F.when(
                F.pmod(F.xxhash64(_text(df, c)), F.lit(m)) == 0 if m > 1 else F.lit(True),
                F.struct(F.lit(c).alias("feature"), _text(df, c).alias("cls")),
            )
            for c, m in residues.items()
        ])
        values = (
            df.select(F.explode(per_row).alias("v")).select("v.feature", "v.cls")
            .filter(F.col("cls").isNotNull()).distinct().persist()
        )
        counted = values.groupBy("feature").agg(F.count("cls").alias("n")).collect()
        small = [r["feature"] for r in counted if r["n"] <= max_classes and residues[r["feature"]] == 1]
        many = [r["feature"] for r in counted if r["n"] > max_classes]
        if small:
            for r in values.filter(F.col("feature").isin(small)).collect():
                found.setdefault(r["feature"], []).append(r["cls"])
        values.unpersist()
        residues = {
            c: 1 for c in residues if c not in small and c not in many and residues[c] > 1
        }
    return {c: sorted(found[c]) for c in estimates if c in found}


def _is_categorical(df: DataFrame, name: str) -> bool:
    kind = df.schema[name].dataType
    return not isinstance(kind, T.NumericType)


def _present(df: DataFrame, name: str) -> Column:
    present = F.col(name).isNotNull()
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        present = present & ~F.isnan(name)
    return present


def _text(df: DataFrame, name: str) -> Column:
    text = F.col(name).cast("string")
    # spelled True and False, which decides their rank beside a missing class
    return F.initcap(text) if isinstance(df.schema[name].dataType, T.BooleanType) else text
