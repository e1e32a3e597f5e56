"""Composite operators: sections of several plain operators, each counted in full and listed up to a cap.

A section is one row: its name, the count of all its rows, whether the cap cuts it, and the first rows in a
total order, each as JSON. Counts and lists are separate plans over the same rows, so nothing but the first
rows is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.functions import top_per
from symlake.operators import invocations, lookup, relations, reports
from symlake.schema import SPAN_COLUMNS

SECTION = "section string, count long, truncated boolean, items array<string>"


def section(df: DataFrame, name: str, order: Sequence[str], cap: int) -> DataFrame:
    """One row: section, count, truncated and items."""
    first = df.orderBy(*order).limit(cap)
    keyed = F.struct(*[F.col(c) for c in order], F.to_json(F.struct(*df.columns)).alias("__json"))
    items = first.agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["__json"]).alias("items"))
    total = df.agg(F.count("*").alias("count"))
    one = F.lit(name).alias("section")
    return total.select(one, "count", (F.col("count") > cap).alias("truncated")).join(items.select(one, "items"), "section")


def union(sections: Sequence[DataFrame]) -> DataFrame:
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out


def analyze_symbol(
    symbols: DataFrame,
    refs: DataFrame,
    type_edges: DataFrame,
    call_edges: DataFrame,
    symbol_id,
    member_links: DataFrame | None = None,
    is_type: bool = True,
    is_interface: bool = False,
    include: Sequence[str] = ("hover", "references", "implementations", "derived", "callers"),
    cap: int = 20,
) -> DataFrame:
    """The sections that are included, in the order hover, references, implementations, derived, callers.

    References are not made distinct here; implementations and derived types (one step) are missing for what
    isn't a type.
    """
    out = []
    if "hover" in include:
        out.append(section(lookup.describe(symbols.where(F.col("symbol_id") == F.lit(symbol_id))).limit(1), "hover", ["symbol_id"], 1))
    if "references" in include:
        hit = refs.where(F.col("target_id") == F.lit(symbol_id)) if member_links is None else refs.join(lookup.cascade(member_links, symbol_id), F.col("target_id") == F.col("id"), "left_semi")
        out.append(section(hit.where("file_path IS NOT NULL").select(*SPAN_COLUMNS), "references", SPAN_COLUMNS, cap))
    if is_type and "implementations" in include:
        out.append(section(relations.find_implementations(type_edges, symbols, symbol_id).select("symbol_id", "name", "kind"), "implementations", ["symbol_id"], cap))
    if is_type and "derived" in include:
        kinds = ["derives_interface"] if is_interface else ["derives"]
        out.append(section(relations.derived_types(type_edges, symbol_id, kinds=kinds).select("id"), "derived", ["id"], cap))
    if "callers" in include:
        sites = relations.find_callers(call_edges, symbol_id).select("caller_id", "file_path", "ordinal")
        out.append(section(sites, "callers", ["file_path", "ordinal", "caller_id"], cap))
    return union(out)


def find_entrypoints(
    classified: DataFrame, subclasses: DataFrame, include: Sequence[str] = ("routes", "middleware", "hostedServices"), cap: int = 20, place: Sequence[str] = ("file_path", "line", "col")
) -> DataFrame:
    """Sections of routes, middleware calls and hosted services; classified: ``invocations.classify`` of the calls."""
    out = []
    if "routes" in include:
        out.append(section(classified.where("bucket = 'route'").select("verb", "template", "handler", *place), "routes", [*place, "verb"], cap))
    if "middleware" in include:
        out.append(section(classified.where("bucket = 'middleware'").select("method_name", *place), "middleware", [*place, "method_name"], cap))
    if "hostedServices" in include:
        out.append(section(invocations.hosted_services(classified, subclasses), "hostedServices", ["via", "type"], cap))
    return union(out)


def consumers(parameters: DataFrame) -> DataFrame:
    """service, consumers: for each parameter type the types with a method that takes it, one of each type, with its first place.

    parameters: key, containing_type, file_path, line.
    """
    first = parameters.where("containing_type IS NOT NULL").groupBy("key", "containing_type").agg(F.min(F.struct("file_path", "line")).alias("at"))
    each = F.struct("containing_type", F.col("at.file_path").alias("file_path"), F.col("at.line").alias("line"))
    return first.groupBy(F.col("key").alias("service")).agg(F.array_sort(F.collect_list(each)).alias("consumers"))


def registrations(classified: DataFrame, parameters: DataFrame | None, query: str | None = None, cap: int = 20, place: Sequence[str] = ("file_path", "line", "col")) -> DataFrame:
    """section (registrations, unclassified), count and truncated of the section, and its first rows with their consumers.

    Consumers are looked up only for the rows that are listed. A service also meets consumers by its simple name.
    """
    hit = invocations.find_registrations(classified, query)
    listed = []
    for bucket, name in (("di", "registrations"), ("unclassified", "unclassified")):
        mine = hit.where(F.col("bucket") == bucket)
        total = mine.agg(F.count("*").alias("count")).select(F.lit(name).alias("section"), "count", (F.col("count") > cap).alias("truncated"))
        first = mine.orderBy(*place, "raw_call").limit(cap).select(F.lit(name).alias("section"), "service", "implementation", "lifetime", "raw_call", *place)
        listed.append(total.join(first, "section", "left"))
    out = union(listed)
    empty = F.array().cast("array<struct<containing_type: string, file_path: string, line: int>>")
    if parameters is None:
        return out.withColumn("consumers", empty)
    names = out.where("service IS NOT NULL").select("service", F.explode(F.array_distinct(F.array(F.col("service"), F.regexp_extract("service", r"([^.]*)$", 1)))).alias("key")).distinct()
    found = consumers(parameters.join(names, "key").select(F.col("service").alias("key"), "containing_type", "file_path", "line"))
    return out.join(found, "service", "left").withColumn("consumers", F.coalesce("consumers", empty))


def lifetimes(listed: DataFrame) -> DataFrame:
    """One row, text: the numbers of listed registrations by lifetime, as ``2 Singleton, 1 Scoped``, or none."""
    n = listed.where("lifetime IS NOT NULL").groupBy("lifetime").agg(F.count("*").alias("n"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("lifetime", "n"))), lambda x: F.concat_ws(" ", x["n"].cast("string"), x["lifetime"]))
    return n.agg(F.coalesce(F.nullif(F.array_join(each, ", "), F.lit("")), F.lit("none")).alias("text"))


def test_projects(projects: DataFrame, project_refs: DataFrame, production) -> DataFrame:
    """project_id of the test projects that reach the production project."""
    reach = reports.reaching_projects(project_refs, production).select(F.col("id").alias("project_id"))
    return projects.where(reports.is_test_project(F.col("name"), F.col("metadata_refs"))).select("project_id").join(reach, "project_id", "left_semi")


def test_map(projects: DataFrame, project_refs: DataFrame, symbols: DataFrame, refs: DataFrame, symbol_id, max_results: int = 10) -> DataFrame:
    """Candidate tests of a symbol; none for a symbol without a project."""
    me = symbols.where(F.col("symbol_id") == F.lit(symbol_id)).select("project_id", "name").first()
    types = symbols.where(F.col("kind").isin("Class", "Struct", "Interface", "Record", "Enum")).select("project_id", "symbol_id", "name", "file_path", "line")
    sites = refs.where((F.col("target_id") == F.lit(symbol_id)) & F.col("file_path").isNotNull())
    if me is None or me["project_id"] is None:
        none = projects.where("false").select("project_id")
        return reports.test_map(sites, types, none, "", max_results)
    tests = test_projects(projects, project_refs, me["project_id"])
    return reports.test_map(sites.select("project_id", "file_path", "line"), types, tests, me["name"], max_results)


def project_overview(projects: DataFrame, documents: DataFrame, project_refs: DataFrame, package_refs: DataFrame, max_projects: int = 25, max_packages: int = 8, max_refs: int = 8) -> DataFrame:
    """project_id, name, documents, project_refs (names, in the order of ids) and package_refs (name, version), both capped."""
    n = documents.groupBy("project_id").agg(F.count("*").alias("documents"))
    names = projects.select(F.col("project_id").alias("ref_project_id"), F.col("name").alias("ref_name"))
    refs = top_per(project_refs.join(names, "ref_project_id").distinct(), ["project_id"], [F.col("ref_project_id")], max_refs)
    refs = refs.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_project_id", "ref_name"))), lambda x: x["ref_name"]).alias("project_refs"))
    packages = top_per(package_refs.where("trim(name) != ''"), ["project_id"], [F.col("ordinal"), F.col("name"), F.col("version")], max_packages)
    packages = packages.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name", "version"))), lambda x: F.struct(x["name"].alias("name"), x["version"].alias("version"))).alias("package_refs"))
    out = projects.select("project_id", "name").join(n, "project_id", "left").join(refs, "project_id", "left").join(packages, "project_id", "left")
    none, no_package = F.array().cast("array<string>"), F.array().cast("array<struct<name: string, version: string>>")
    return out.select("project_id", "name", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("project_refs", none).alias("project_refs"), F.coalesce("package_refs", no_package).alias("package_refs")).orderBy("name", "project_id").limit(max_projects)


