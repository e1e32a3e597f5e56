"""Composite reports: project overview, symbol analysis, test map, dead code, reachability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.functions import file_stem, top_per
from symlake.operators.graph import closure

# Members and attributes that keep a symbol from being reported as dead.
DENIED_MEMBERS = ("Dispose", "DisposeAsync", "ToString", "Equals", "GetHashCode")
DENIED_ATTRIBUTES = (
    "FactAttribute", "TheoryAttribute", "TestAttribute", "TestMethodAttribute", "BenchmarkAttribute", "JsonConstructorAttribute", "OnDeserializedAttribute",
    "OnDeserializingAttribute", "ModuleInitializerAttribute", "UnmanagedCallersOnlyAttribute", "DllImportAttribute",
)
TEST_SUFFIXES = ("tests", "test", "spec", "integrationtests")
TEST_PACKAGES = ("xunit", "nunit", "mstest")


def project_overview(projects: DataFrame, documents: DataFrame, members: DataFrame, max_projects: int = 25, max_members: int = 8) -> DataFrame:
    """For each project the number of documents and its first members (project_id, member), joined by a comma.

    Both sides are aggregated before they meet, so a large project is counted where its rows lie.
    """
    n = documents.groupBy("project_id").agg(F.count("*").alias("documents"))
    first = top_per(members.select("project_id", "member").distinct(), ["project_id"], [F.col("member")], max_members)
    listed = first.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_list("member")), ",").alias("members"))
    out = projects.join(n, "project_id", "left").join(listed, "project_id", "left")
    return out.select("project_id", "name", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("members", F.lit("")).alias("members")).orderBy("name", "project_id").limit(max_projects)


def is_test_project(name: Column, metadata_refs: Column) -> Column:
    low = F.lower(name)
    by_name = low.endswith(TEST_SUFFIXES[0])
    for s in TEST_SUFFIXES[1:]:
        by_name = by_name | low.endswith(s)
    by_ref = F.exists(F.coalesce(metadata_refs, F.array().cast("array<string>")), lambda r: F.lower(r).rlike("|".join(TEST_PACKAGES)))
    return by_name | by_ref


def reaching_projects(project_refs: DataFrame, target) -> DataFrame:
    """(id, depth) of the projects from which target is reached, itself included."""
    up = project_refs.select(F.col("ref_project_id").alias("src"), F.col("project_id").alias("dst"))
    return closure(up, project_refs.sparkSession.range(1).select(F.lit(target).alias("id")))


def test_map(refs: DataFrame, types: DataFrame, test_projects: DataFrame, name: str, max_results: int = 10) -> DataFrame:
    """Candidates that test a symbol: references in test projects (high) and types named after it (medium).

    refs: project_id, file_path, line; types: project_id, symbol_id, name; test_projects: project_id.
    """
    high = refs.join(test_projects, "project_id", "left_semi").select("project_id", "file_path", "line").distinct()
    high = high.select(F.concat_ws(".", "project_id", file_stem(F.col("file_path"))).alias("test_symbol"), F.lit(0).alias("rank"), F.lit("high").alias("confidence"), F.lit("reference").alias("via"), "file_path", "line")
    names = [f"{name}Tests", f"{name}Spec", f"Test{name}", f"Tests{name}"]
    medium = types.where(F.col("name").isin(names)).join(test_projects, "project_id", "left_semi").dropDuplicates(["symbol_id"])
    medium = medium.select(F.col("name").alias("test_symbol"), F.lit(1).alias("rank"), F.lit("medium").alias("confidence"), F.lit("name-match").alias("via"), "file_path", "line")
    return high.unionByName(medium).orderBy("rank", "test_symbol", "file_path", "line").limit(max_results).drop("rank")


def dead_code_status(
    symbols: DataFrame,
    test_projects: DataFrame | None = None,
    denied: Column | None = None,
    exclude_paths: Sequence[str] = (),
    include_private: bool = True,
    include_internal: bool = True,
    include_tests: bool = False,
    symbol_keys: DataFrame | None = None,
) -> DataFrame:
    """symbols with status: the first rule that takes a symbol out, or eligible.

    denied takes the place of the member names. Attributes come from symbol_keys and go by their class's own name.
    """
    s = symbols
    deny = F.coalesce(F.col("name").isin(list(DENIED_MEMBERS)) if denied is None else denied, F.lit(False))
    if symbol_keys is not None:
        by_name = F.regexp_extract("key", r"([^.+]*)$", 1).isin(list(DENIED_ATTRIBUTES))
        attributed = symbol_keys.where((F.col("index_kind") == "attribute") & by_name).select("symbol_id", F.lit(True).alias("__attributed")).distinct()
        s = s.join(attributed, "symbol_id", "left")
        deny = deny | F.coalesce("__attributed", F.lit(False))
    in_test = F.lit(False)
    if test_projects is not None and not include_tests:
        s = s.join(test_projects.select("project_id", F.lit(True).alias("__test")).distinct(), "project_id", "left")
        in_test = F.coalesce("__test", F.lit(False))
    excluded = F.lit(False)
    for p in exclude_paths:
        excluded = excluded | F.lower(F.col("file_path").cast("string")).contains(p.lower())
    access = F.lower("accessibility")
    gated = F.lit(False)
    if not include_private:
        gated = gated | (access == "private")
    if not include_internal:
        gated = gated | access.isin("internal", "private protected")
    status = (
        F.when(F.col("file_path").isNull(), "no_location")
        .when(excluded, "excluded")
        .when(in_test, "test")
        .when(access.isin("public", "protected", "protected internal"), "public")
        .when(gated, "gated")
        .when(deny, "deny")
        .otherwise("eligible")
    )
    return s.withColumn("status", status).drop("__attributed")


def dead_code_candidates(status: DataFrame, refs: DataFrame, friend: Column, max_results: int | None = None) -> DataFrame:
    """Eligible symbols without any reference; confidence is medium for internal ones whose assembly has friends."""
    dead = status.where("status = 'eligible'").join(refs.select(F.col("target_id").alias("symbol_id")), "symbol_id", "left_anti")
    dead = dead.withColumn("confidence", F.when((F.lower("accessibility") == "internal") & friend, "medium").otherwise("high"))
    return dead if max_results is None else dead.orderBy("file_path", "symbol_id").limit(max_results)


def dead_code_skipped(status: DataFrame) -> DataFrame:
    """Over all symbols, whatever the cap of the candidates."""
    return status.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("public", "public_members"), ("test", "tests"), ("deny", "denylisted"))])
