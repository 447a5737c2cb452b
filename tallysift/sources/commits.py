"""Tables that grow by named commits: whoever writes a commit again replaces it.

    root/data/<folder>      the rows of one attempt, staged
    root/commits/<name>     a file that names the folder that counts

A commit's rows count once its file is there; the file is put in place by one rename. An attempt that was cut off leaves a
folder that no file names, and a rerun leaves each row once. Readers see whole commits only.
"""

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def commit_rows(rows: DataFrame, root: str, name: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write ``rows`` as commit ``name``, in the place of an earlier commit of that name."""
    spark, label = rows.sparkSession, quote(name, safe="")
    if not label.strip("."):
        raise ValueError("a commit needs a name")
    folder = f"{label}-{uuid.uuid4().hex}"
    rows.write.partitionBy(*partition_by).parquet(f"{root}/data/{folder}")
    store, path = _store(spark, f"{root}/commits/.{folder}")
    out = store.create(path, True)
    out.write(folder.encode())
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    replace = spark.sparkContext._gateway.new_array(rename, 1)
    replace[0] = rename.OVERWRITE
    context.rename(store.makeQualified(path), store.makeQualified(_path(spark, f"{root}/commits/{label}")), replace)


def committed(spark: SparkSession, root: str) -> dict[str, str]:
    """Commit names and the folders of their rows."""
    store, path = _store(spark, f"{root}/commits")
    if not store.exists(path):
        return {}
    out = {}
    for f in store.listStatus(path):
        name = f.getPath().getName()
        if not name.startswith("."):
            source = store.open(f.getPath())
            raw = bytes(source.readAllBytes())
            source.close()
            out[unquote(name)] = f"{root}/data/{raw.decode()}"
    return out


def read_committed(spark: SparkSession, root: str, schema: T.StructType, names: list[str] | None = None) -> DataFrame:
    """The rows of all commits, or of those named; a commit that isn't there has none."""
    found = committed(spark, root)
    folders = sorted(f for n, f in found.items() if names is None or n in names)
    if not folders:
        return spark.createDataFrame([], schema)
    # by folder, so that the partition columns of each are found below it
    parts = [spark.read.schema(schema).parquet(f).select(schema.names) for f in folders]
    while len(parts) > 1:
        parts = [a.union(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2:]
    return parts[0]


def drop_commit(spark: SparkSession, root: str, name: str) -> None:
    """The commit counts no longer; its rows go with ``remove_leftovers``."""
    store, path = _store(spark, f"{root}/commits/{quote(name, safe='')}")
    store.delete(path, False)


def remove_leftovers(spark: SparkSession, root: str) -> int:
    """Delete folders of replaced or broken-off commits, and return how many; only while nobody writes or reads."""
    kept = {f.rsplit("/", 1)[-1] for f in committed(spark, root).values()}
    store, path = _store(spark, f"{root}/data")
    old = [f.getPath() for f in store.listStatus(path) if f.getPath().getName() not in kept] if store.exists(path) else []
    for p in old:
        store.delete(p, True)
    return len(old)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    found = _path(spark, path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found
