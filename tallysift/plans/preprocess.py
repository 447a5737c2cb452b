"""From a raw labelled table to scaled training and test rows."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysift.operators import prune, scale, split


@dataclass(frozen=True)
class Prepared:
    """Scaled rows with ``split`` and ``label``, the feature names and what was learned."""

    table: DataFrame
    features: list[str]
    pruning: prune.PruneModel
    scaling: scale.ScaleModel
    cut: split.StrataCut | None
    persisted: DataFrame | None = None

    def release(self) -> None:
        """Drop the cached rows behind ``table``; they are recomputed if it is read again."""
        if self.persisted is not None:
            self.persisted.unpersist()

    @property
    def train(self) -> DataFrame:
        return self.table.filter(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.table.filter(F.col("split") == "test")


def prepare(
    df: DataFrame,
    target: str,
    keys: tuple[str, ...],
    seed: int = 42,
    id_cols: tuple[str, ...] = (),
    split_col: str | None = None,
    test_size: float = 0.2,
    max_samples: int | None = None,
    fit_scope: str | None = None,
    approx: bool = False,
    persist: bool = True,
) -> Prepared:
    """Prune, encode, split, impute and scale.

    With ``split_col`` the table comes split; otherwise it is capped and split by class, with the
    row ``keys`` deciding membership. ``fit_scope`` says which rows pruning and encoding learn
    from: by default ``train`` for a table that comes split and ``all`` for one that does not.
    Medians and extremes are learned from training rows in either case.

    The pruned and encoded rows (numbers only) are persisted unless ``persist`` is off: splitting,
    scaling and everything fitted on the result scan them again, which would otherwise reread and
    reparse the source each time.
    """
    scope = fit_scope or ("train" if split_col else "all")
    if scope not in ("train", "all"):
        raise ValueError(f"unknown fit_scope {scope!r}")
    labelled = prune.drop_null_target(df, target)
    kept = [c for c in id_cols if c not in keys]
    labelled = prune.drop_identifiers(labelled, kept)
    cut = None
    if split_col:
        labelled = labelled.withColumn("split", F.col(split_col))
    elif scope == "train":
        labelled, cut = _split(labelled, target, keys, seed, test_size, max_samples)
    passive = tuple(dict.fromkeys([*keys, "split", *([split_col] if split_col else [])]))
    reference = labelled.filter(F.col("split") == "train") if scope == "train" else labelled
    pruning = prune.fit_prune(reference, target, exclude=passive)
    encoded = prune.encode(prune.drop_pruned(labelled, pruning), pruning)
    encoded = encoded.select(*[c for c in dict.fromkeys([*passive, target, *pruning.features]) if c in encoded.columns])
    if persist:
        encoded = encoded.persist()
    persisted = encoded if persist else None
    if not split_col and scope == "all":
        encoded, cut = _split(encoded, target, keys, seed, test_size, max_samples)
    aligned = prune.align(encoded, list(pruning.features), keep=(*keys, "split", target))
    scaling = scale.fit_scale(
        aligned.filter(F.col("split") == "train"), list(pruning.features), approx=approx)
    scaled = prune.label_as_float(scale.impute_and_scale(aligned, scaling), target)
    return Prepared(scaled, scaling.features, pruning, scaling, cut, persisted)


def _split(df, target, keys, seed, test_size, max_samples):
    if max_samples is not None:
        df = split.cap_rows(df, split.fit_strata(df, target, keys, seed, rows=max_samples))
    cut = split.fit_strata(df, target, keys, seed, fraction=test_size)
    return split.assign_split(df, cut), cut
