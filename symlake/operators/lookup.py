"""Point look-ups: references, definitions, hover, symbol search and outlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.functions import doc_summary, match_tier
from symlake.operators.graph import closure
from symlake.schema import SPAN_COLUMNS


NOT_IN_OUTLINE = ("Delegate", "Indexer", "EnumMember", "LocalFunction")


def cascade(member_links: DataFrame, target_id) -> DataFrame:
    """The ids that a search for target_id covers: it and all members linked with it either way."""
    both = member_links.select(F.col("member_id").alias("src"), F.col("linked_id").alias("dst"))
    both = both.union(both.select("dst", "src"))
    seed = member_links.sparkSession.range(1).select(F.lit(target_id).alias("id"))
    return closure(both, seed).select("id")


def find_references(refs: DataFrame, target_id, member_links: DataFrame | None = None) -> DataFrame:
    """The distinct in-source sites that refer to target_id."""
    if member_links is None:
        hit = refs.where(F.col("target_id") == F.lit(target_id))  # reaches the scan
    else:
        hit = refs.join(cascade(member_links, target_id), F.col("target_id") == F.col("id"), "left_semi")
    return hit.where("file_path IS NOT NULL").select(*SPAN_COLUMNS).distinct()


def reference_summary(refs: DataFrame) -> DataFrame:
    """target_id, references, files over distinct sites, for every target at once."""
    sites = refs.where("file_path IS NOT NULL").select("target_id", *SPAN_COLUMNS).distinct()
    return sites.groupBy("target_id").agg(F.count("*").alias("references"), F.count_distinct("file_path").alias("files"))


def symbol_at(tokens: DataFrame, file_path, line: int, col: int) -> DataFrame:
    """symbol_id of the narrowest token at a position; a token may span lines."""
    begun = (F.col("line") < line) | ((F.col("line") == line) & (F.col("col") <= col))
    open_ = (F.col("end_line") > line) | ((F.col("end_line") == line) & (F.col("end_col") > col))
    at = tokens.where(in_file(F.col("file_path"), file_path) & begun & open_)
    return at.orderBy(F.col("end_line") - F.col("line"), F.col("end_col") - F.col("col"), "symbol_id").limit(1).select("symbol_id")


def goto_definition(tokens: DataFrame, symbols: DataFrame, file_path, line: int, col: int) -> DataFrame:
    """Every in-source declaration of the symbol at a position."""
    hit = symbols.join(symbol_at(tokens, file_path, line, col), "symbol_id", "left_semi")
    return hit.select("symbol_id", F.inline("locations")).where("file_path IS NOT NULL")


def hover(tokens: DataFrame, symbols: DataFrame, file_path, line: int, col: int) -> DataFrame:
    """The symbol at a position with its signature and the summary of its documentation."""
    return describe(symbols.join(symbol_at(tokens, file_path, line, col), "symbol_id", "left_semi"))


def describe(symbols: DataFrame) -> DataFrame:
    """symbol_id, name, kind, signature and doc: the first summary, null if there is none or the XML is malformed."""
    return symbols.select("symbol_id", "name", "kind", "signature", doc_summary(F.col("xml_doc")).alias("doc"))


def workspace_symbol(symbols: DataFrame, query: str, kinds: Sequence[str] | None = None, max_results: int = 100) -> DataFrame:
    """Symbols whose name matches, best tier first, capped after a total order."""
    hit = symbols.withColumn("tier", match_tier(F.col("name"), query)).where("tier IS NOT NULL")
    if kinds is not None:
        hit = hit.where(F.lower("kind").isin([k.lower() for k in kinds]))
    hit = hit.dropDuplicates(["symbol_id"])
    return hit.orderBy("tier", F.length("name"), "name", "symbol_id").limit(max_results)


def document_outline(outline: DataFrame, symbols: DataFrame, file_path) -> DataFrame:
    """The declarations of one document in order, but for kinds that an outline leaves out."""
    mine = outline.where(in_file(F.col("file_path"), file_path)).select("ordinal", "symbol_id")
    out = mine.join(symbols, "symbol_id")
    if "kind" in symbols.columns:
        out = out.where(~F.coalesce(F.col("kind").isin(list(NOT_IN_OUTLINE)), F.lit(False)))
    return out.orderBy("ordinal")


def in_file(path: Column, wanted) -> Column:
    """Whether path is the wanted document, whatever the case; documents may go by numbers too."""
    return F.lower(path) == wanted.lower() if isinstance(wanted, str) else path == F.lit(wanted)
