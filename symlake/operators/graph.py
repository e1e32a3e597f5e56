"""Reachability over edge tables by a frontier that is joined hop by hop.

SQL recursion enumerates paths; a frontier with an anti-join on what was visited handles cycles and gives
the least depth. Edges are written once, sorted by their source, and every hop once, to the folder in
spark.checkpoint.dir; that cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a frontier that are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share; one of this machine only where Spark runs on it alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "symlake-checkpoints")
    return f"{base}/closure-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, depth) of all nodes reachable over edges (src, dst) from seeds (id), seeds included at depth 0."""
    folder = _folder(edges.sparkSession)
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    if max_depth is None or max_depth > 1:
        edges = _written(edges.sortWithinPartitions("src"), f"{folder}/edges")  # row groups that a hop doesn't need are skipped
    frontier = _written(seeds.select("id").where("id IS NOT NULL").distinct().withColumn("depth", F.lit(0)), f"{folder}/0")
    visited, depth, size = frontier, 0, frontier.count()
    while size and (max_depth is None or depth < max_depth):
        depth += 1
        front = F.broadcast(frontier) if size <= BROADCAST_ROWS else frontier
        step = edges.join(front, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = _written(step.join(visited.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), f"{folder}/{depth}")
        size = frontier.count()
        if size:
            visited = visited.union(frontier)
    return visited
