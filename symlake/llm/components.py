"""Connected components of a graph given as a table of links, by alternating large and small stars."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.llm.common import drop_dir, table


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links with u > v: each node's neighbours move to its smallest one."""
    if large:
        both = links.select("u", "v").union(links.select(F.col("v"), F.col("u"))).toDF("u", "v")
    else:
        both = links
    low = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(low, both["u"] == low["w"])
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u != v").distinct()
    own = low.select(F.col("w").alias("u"), F.col("m").alias("v"))
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(own).where("u != v").distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """(u, v) for every node u of links (u, v: long) that isn't its component's smallest node v.

    The steps end when one changes nothing, which is compared link by link.
    """
    spark = links.sparkSession
    links = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = table(spark, links, f"{folder}/links-0", small=True)
    for i in count(1):
        before, links = links, table(spark, _star(_star(links, True), False), f"{folder}/links-{i}", small=i % 4 > 0)
        if links.count() == before.count() and not links.join(before, ["u", "v"], "left_anti").take(1):
            return links
        drop_dir(spark, f"{folder}/links-{i - 1}")
