"""Dimensionality reduction: all features, principal components or a least-energy subset."""

from pyspark.sql import DataFrame

from tallysift.operators import components, mutual_info, prune, subset


def fit_selection(
    train: DataFrame, features: list[str], k: int, method: str, label: str = "label", bins: int = 20,
    num_reads: int = 1000, seed: int = 0, epsilon: float = subset.EPSILON,
    **quantile_args,
) -> subset.SubsetChoice:
    """Bin, measure mutual information in one pass over the rows and search for k features."""
    edges = mutual_info.fit_bin_edges(train, features, bins, **quantile_args)
    binned = mutual_info.bin_columns(train.select(*features, label), edges)
    tables = subset.fit_mi_tables(
        mutual_info.relevance_and_redundancy(binned, features, label), features, label)
    return subset.fit_subset(
        train.sparkSession, tables, k, method, num_reads=num_reads, seed=seed, epsilon=epsilon)


def reduce_features(
    table: DataFrame, train: DataFrame, features: list[str], mode: str = "all", k: int | None = None,
    keep: tuple[str, ...] = ("label", "split"), **selection_args,
) -> tuple[DataFrame, list[str]]:
    """The reduced table and its feature names; everything is learned from ``train``.

    Mode ``subset`` needs the search ``method``, ``exact`` or ``annealed``.
    """
    if mode == "all":
        return prune.project(table, features, keep), list(features)
    if mode == "pca":
        model = components.fit_components(train, features, k)
        return components.to_components(table, model, keep), model.names
    if mode == "subset":
        chosen = fit_selection(train, features, k, **selection_args).features
        return prune.project(table, chosen, keep), chosen
    raise ValueError(f"unknown reduction {mode!r}")
