"""Search by kind:target over inverted keys, and the base-and-delta overlay that keeps them fresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.result import INVALID_PATTERN, OpError

KINDS = {"has-attribute": "attribute", "returns": "returns", "parameter-type": "parameter"}


def split_pattern(pattern: str) -> tuple[str, str]:
    kind, colon, target = pattern.partition(":")
    if not colon or not kind:
        raise OpError(INVALID_PATTERN, f"Pattern must be of form 'kind:target': {pattern}")
    if kind not in (*KINDS, "derives-from", "implements"):
        raise OpError(INVALID_PATTERN, f"Unknown pattern kind: {kind}")
    return kind, target


def keys_of(facts: DataFrame, index_kind: str, display, metadata) -> DataFrame:
    """symbol_keys rows of facts (symbol_id and two forms of a type)."""
    from symlake.functions import type_keys

    return facts.select(F.lit(index_kind).alias("index_kind"), F.explode(type_keys(display, metadata)).alias("key"), "symbol_id").distinct()


def key_search(symbol_keys: DataFrame, symbols: DataFrame, index_kind: str, key: str) -> DataFrame:
    hit = symbol_keys.where((F.col("index_kind") == index_kind) & (F.col("key") == key)).select("symbol_id").distinct()
    return symbols.join(hit, "symbol_id", "left_semi")


def overlay(base: DataFrame, fresh: DataFrame, dirty: DataFrame) -> DataFrame:
    """base without rows that any dirty document declares, and fresh rows; of equal ids the base row stays.

    base, fresh: symbol_id, declaring_docs, ...; dirty: doc_id.
    """
    stale = stale_symbols(base, dirty)
    kept = base.join(stale, "symbol_id", "left_anti")
    added = fresh.join(kept.select("symbol_id"), "symbol_id", "left_anti").dropDuplicates(["symbol_id"])
    return kept.unionByName(added)


def stale_symbols(base: DataFrame, dirty: DataFrame) -> DataFrame:
    """symbol_id of the symbols that any dirty document declares."""
    return base.select("symbol_id", F.explode("declaring_docs").alias("doc_id")).join(dirty, "doc_id", "left_semi").select("symbol_id").distinct()


def rewalk(base: DataFrame, fresh: DataFrame, dirty: DataFrame, column: str) -> DataFrame:
    """base without the rows of dirty documents, which its column names, and the fresh rows."""
    kept = base.join(dirty.select(F.col("doc_id").alias("__dirty")), F.col(column) == F.col("__dirty"), "left_anti")
    return kept.unionByName(fresh)


def reextract(symbols: DataFrame, dirty: DataFrame) -> DataFrame:
    """Documents to extract again: the dirty ones and all that declare a symbol together with them."""
    places = symbols.select("symbol_id", F.explode("declaring_docs").alias("doc_id"))
    shared = places.join(dirty, "doc_id", "left_semi").select("symbol_id").distinct()
    return places.join(shared, "symbol_id", "left_semi").select("doc_id").union(dirty.select("doc_id")).distinct()
