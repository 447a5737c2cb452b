"""Connected components of an undirected link table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; its result is stored on the shared folder, so a lost executor costs one
step. Nothing is held on the driver but a count and a checksum of the links.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysift.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the least node among u and its neighbours."""
    both = links.union(links.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Of links that point down from u, all lower neighbours and u are linked to the least."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link that isn't the least of its component. ``links``: two columns."""
    links = stored(links.toDF("u", "v").where("u <> v").distinct(), "links")
    seen = None
    while True:
        links = stored(_small_star(_large_star(links)), "stars")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.toDF("node", "root")
        seen = now
