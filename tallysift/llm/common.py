"""What the operators share: tables, scratch tables on the shared folder, joins with checked sizes."""

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysift.session import scratch_dir

#: Tables of at most so many rows may be broadcast, once they have been counted.
SMALL_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lists that take down the scratch tables written meanwhile, the innermost last.
_noting: list[list[str]] = []


@contextmanager
def noted(paths: list[str]):
    """Add to ``paths`` the folder of every scratch table that is written inside."""
    _noting.append(paths)
    try:
        yield
    finally:
        _noting.pop()


def free(spark: SparkSession, paths: list[str], unless_read_by: DataFrame | None = None) -> None:
    """Delete the scratch tables ``paths``, and take them off the list, but for those that a table still reads."""
    read = unless_read_by.inputFiles() if unless_read_by is not None and paths else []
    for path in list(paths):
        name = path.rsplit("/", 1)[-1]
        if not any(f"/{name}/" in f for f in read):
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            paths.remove(path)


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage: later jobs and lost executors read the files instead of computing them again.
    """
    path = scratch_dir(df.sparkSession, label)
    if _noting:
        _noting[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame) -> DataFrame:
    """Hint a broadcast if the counted table is small; else Spark's shuffle join stays. ``df``: stored."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def hashed_sample(df: DataFrame, rows: int, *by: Column) -> DataFrame:
    """At most ``rows`` rows, those with the least hash of ``by``, for fits on a bounded sample.

    Of a large table a fixed share by hash, about four times the rows wanted, is let through first, so that what tasks
    send for the choice doesn't grow with their number.
    """
    h, n = F.xxhash64(*by), df.count()
    if n > 4 * rows:
        df = df.where(h.bitwiseAND((1 << 40) - 1) < int(4 * rows / n * (1 << 40)))
    return df.orderBy(h, *by).limit(rows)


def id_crc(doc_id: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def own_columns(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """The table's columns (or the named ones), whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in (df.columns if names is None else names)]


def numbered(df: DataFrame, names: list[str]) -> list[Column]:
    """The named columns as c0, c1, ...: Arrow functions don't take every name."""
    return [c.alias(f"c{k}") for k, c in enumerate(own_columns(df, names))]


def numbered_fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(f"c{k}", df.schema[c].dataType) for k, c in enumerate(names)]


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
