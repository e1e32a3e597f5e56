"""Inheritance and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.functions import top_per
from symlake.operators.graph import closure


def _down(type_edges: DataFrame, kinds: list[str] | None) -> DataFrame:
    e = type_edges if kinds is None else type_edges.where(F.col("kind").isin(kinds))
    return e.select(F.col("parent_id").alias("src"), F.col("child_id").alias("dst"))


def _seed(df: DataFrame, node) -> DataFrame:
    return df.sparkSession.range(1).select(F.lit(node).alias("id"))


def derived_types(type_edges: DataFrame, node, transitive: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """(id, depth) of the types below node; direct ones unless transitive."""
    reach = closure(_down(type_edges, kinds), _seed(type_edges, node), None if transitive else 1)
    return reach.where("depth > 0")


def find_implementations(type_edges: DataFrame, symbols: DataFrame, node, leaf_kinds: list[str] | None = None, member_links: DataFrame | None = None) -> DataFrame:
    """The symbols that implement node, directly or through others; with member_links members that implement or override it too."""
    down = _down(type_edges, None)
    if member_links is not None:
        down = down.union(member_links.select("linked_id", "member_id"))
    below = closure(down, _seed(type_edges, node)).where("depth > 0").select(F.col("id").alias("symbol_id"))
    hit = symbols.join(below, "symbol_id", "left_semi")
    return hit if leaf_kinds is None else hit.where(F.col("kind").isin(leaf_kinds))


def implementation_sites(implementations: DataFrame) -> DataFrame:
    """The distinct places in source at which implementations are declared."""
    return implementations.select(F.inline("locations")).where("file_path IS NOT NULL").distinct()


def find_callers(call_edges: DataFrame, callee, max_depth: int | None = 1) -> DataFrame:
    """Call sites into callee and, beyond depth 1, into what calls it; each site once."""
    if max_depth == 1:
        return call_edges.where(F.col("callee_id") == F.lit(callee))
    reach = callers_closure(call_edges, callee, None if max_depth is None else max_depth - 1).select("id")
    return call_edges.join(reach, call_edges["callee_id"] == reach["id"], "left_semi")


def callers_closure(call_edges: DataFrame, callee, max_depth: int | None = None) -> DataFrame:
    """(id, depth): callee at depth 0 and all that reach it by calls."""
    up = call_edges.select(F.col("callee_id").alias("src"), F.col("caller_id").alias("dst"))
    return closure(up, _seed(call_edges, callee), max_depth)


def find_callees(call_edges: DataFrame, caller, max_results: int = 50) -> DataFrame:
    """The first site of each distinct callee, in source order."""
    mine = call_edges.where(F.col("caller_id") == F.lit(caller))
    first = top_per(mine, ["callee_display"], [F.col("file_path"), F.col("ordinal")], 1)
    return first.orderBy("file_path", "ordinal", "callee_display").limit(max_results)
