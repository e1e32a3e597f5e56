"""The operators over the driver's tables, each with the SQL that an independent engine runs.

Parts are symbols, orders files and line items references; lines of one order that follow each other are
calls from part to part; regions, nations, customers and suppliers form the containment tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from symlake import sources
from symlake.functions import top_per
from symlake.operators import analysis, diagnostics, graph, invocations, lookup, relations, rename, reports, semantic

PART = 84
CALLEE = 0
ORDER, LINE = 3763, 4
REGION = 1


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- the bound fact tables -----------------------------------------------------------------------


def refs(spark: SparkSession, d: str) -> DataFrame:
    one = F.lit(1)
    return _t(spark, d, "lineitem").select(F.col("l_partkey").alias("target_id"), F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("line"), one.alias("col"), F.col("l_linenumber").alias("end_line"), F.lit(2).alias("end_col"))


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    line = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    nxt = line.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("callee_id"))
    return line.join(nxt, (line["l_orderkey"] == nxt["o"]) & (line["l_linenumber"] == nxt["n"])).select(
        F.col("l_partkey").alias("caller_id"), "callee_id", F.col("callee_id").cast("string").alias("callee_display"), F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("ordinal")
    )


def entities(spark: SparkSession, d: str) -> DataFrame:
    r, n, c, s, p = (_t(spark, d, x) for x in ("region", "nation", "customer", "supplier", "part"))
    tag = lambda k, c: F.concat(F.lit(k + ":"), c.cast("string"))
    rows = [
        r.select(tag("R", F.col("r_regionkey")).alias("symbol_id"), F.col("r_name").alias("name"), F.lit("Namespace").alias("kind")),
        n.select(tag("N", F.col("n_nationkey")), "n_name", F.lit("Interface")),
        c.select(tag("C", F.col("c_custkey")), "c_name", F.lit("Class")),
        s.select(tag("S", F.col("s_suppkey")), "s_name", F.lit("Class")),
        p.select(tag("P", F.col("p_partkey")), "p_name", F.lit("Method")),
    ]
    out = rows[0]
    for x in rows[1:]:
        out = out.union(x)
    return out


def type_edges(spark: SparkSession, d: str) -> DataFrame:
    n, c, s = (_t(spark, d, x) for x in ("nation", "customer", "supplier"))
    tag = lambda k, c: F.concat(F.lit(k + ":"), F.col(c).cast("string"))
    nation = n.select(tag("N", "n_nationkey").alias("child_id"), tag("R", "n_regionkey").alias("parent_id"), F.lit("derives").alias("kind"))
    return nation.union(c.select(tag("C", "c_custkey"), tag("N", "c_nationkey"), F.lit("implements"))).union(s.select(tag("S", "s_suppkey"), tag("N", "s_nationkey"), F.lit("implements")))


def event_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    severity = F.when(kind == "error", "Error").when(kind == "purchase", "Warning").when(kind == "click", "Info").otherwise("Hidden")
    return _t(spark, d, "events").select("event_id", severity.alias("severity"), F.get_json_object("props", "$.k").alias("code"), F.col("user_id").alias("file_path"), kind.alias("project_id"))


def _type_facts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_type").alias("display"), F.concat(F.lit("TPCH."), "p_type").alias("metadata"))


# --- queries -------------------------------------------------------------------------------------


def echo(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.concat(F.lit("Echo: "), F.lit("hello")).alias("message"))


def find_references(spark: SparkSession, d: str) -> DataFrame:
    return lookup.find_references(refs(spark, d), PART).select("file_path", "line")


def reference_summary(spark: SparkSession, d: str) -> DataFrame:
    return lookup.reference_summary(refs(spark, d))


def goto_definition(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    span = F.struct(F.col("p_brand").alias("file_path"), F.col("p_size").alias("line"), F.lit(1).alias("col"), F.col("p_size").alias("end_line"), F.lit(2).alias("end_col"))
    symbols = p.select(F.col("p_partkey").alias("symbol_id"), F.array(span).alias("locations"))
    return lookup.goto_definition(refs(spark, d).withColumnRenamed("target_id", "symbol_id"), symbols, ORDER, LINE, 1).select("symbol_id", "file_path", "line")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns as symbols: the first line, as XML, is their documentation."""
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        line = F.replace(line, F.lit(a), F.lit(b))
    xml = F.concat(F.lit("<doc><summary>"), F.coalesce(line, F.lit("")), F.lit("</summary></doc>"))
    return _t(spark, d, "conversations").select(
        "conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("symbol_id"), F.lit("turn").alias("name"), F.lit("Method").alias("kind"), F.col("role").alias("signature"), xml.alias("xml_doc")
    )


def hover(spark: SparkSession, d: str) -> DataFrame:
    part = lambda n: F.split_part("symbol_id", F.lit("/"), F.lit(n))
    return lookup.describe(_turns(spark, d)).select(part(1).cast("long").alias("conv_id"), part(2).cast("long").alias("turn"), "signature", "doc")


def hover_at(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    tokens = turns.select("symbol_id", F.col("conv_id").alias("file_path"), F.col("turn").alias("line"), F.lit(1).alias("col"), F.col("turn").alias("end_line"), F.lit(9).alias("end_col"))
    return lookup.hover(tokens, turns, 3, 1, 4).select("symbol_id", "signature", "doc")


def workspace_symbol(spark: SparkSession, d: str) -> DataFrame:
    return lookup.workspace_symbol(entities(spark, d), "bolt", ["method", "class"], 100).select("symbol_id", "name", F.col("tier").cast("int").alias("tier"))


def find_implementations(spark: SparkSession, d: str) -> DataFrame:
    return relations.find_implementations(type_edges(spark, d), entities(spark, d), f"R:{REGION}", ["Class"]).select("symbol_id", "name")


def derived_types_direct(spark: SparkSession, d: str) -> DataFrame:
    return relations.derived_types(type_edges(spark, d), f"R:{REGION}").select("id")


def derived_types_transitive(spark: SparkSession, d: str) -> DataFrame:
    return relations.derived_types(type_edges(spark, d), f"R:{REGION}", transitive=True).select("id", "depth")


def list_document_symbols(spark: SparkSession, d: str) -> DataFrame:
    outline = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("symbol_id"))
    symbols = _t(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"))
    return lookup.document_outline(outline, symbols, ORDER).select("ordinal", "symbol_id", "name")


def find_callers_direct(spark: SparkSession, d: str) -> DataFrame:
    return relations.find_callers(call_edges(spark, d), CALLEE).select("caller_id", "file_path", "ordinal")


def find_callers_transitive(spark: SparkSession, d: str) -> DataFrame:
    return relations.callers_closure(call_edges(spark, d), CALLEE, 3).select("id", "depth")


def find_callers_sites(spark: SparkSession, d: str) -> DataFrame:
    return relations.find_callers(call_edges(spark, d), CALLEE, 2).select("caller_id", "callee_id", "file_path", "ordinal")


def find_callers_all(spark: SparkSession, d: str) -> DataFrame:
    return relations.find_callers(call_edges(spark, d), CALLEE, None).groupBy("callee_id").agg(F.count("*").alias("sites"))


def find_callees(spark: SparkSession, d: str) -> DataFrame:
    return relations.find_callees(call_edges(spark, d), CALLEE, 50).select("callee_id", "file_path", "ordinal")


def compilation_errors(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.compilation_errors(event_diagnostics(spark, d), exclude_codes=["7", "13"]).select("event_id", "severity", "code", "file_path")


def compilation_errors_summary(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.severity_summary(diagnostics.compilation_errors(event_diagnostics(spark, d)), ["project_id"])


def document_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.compilation_errors(event_diagnostics(spark, d), file_path=8, minimum="Info").select("event_id", "severity", "code")


def compilation_errors_written(spark: SparkSession, d: str) -> DataFrame:
    """Without generated files; some diagnostics have no file."""
    user = F.col("file_path")
    path = F.when(user % 5 == 0, F.concat(F.lit("src\\obj\\f"), user, F.lit(".cs"))).when(user % 5 == 1, F.concat(F.lit("src/f"), user, F.lit(".G.cs"))).when(user % 5 == 2, F.lit(None).cast("string"))
    found = event_diagnostics(spark, d).withColumn("file_path", path.otherwise(F.concat(F.lit("src/objects/f"), user, F.lit(".cs"))))
    return diagnostics.compilation_errors(found, include_generated=False).select("event_id", "file_path")


def semantic_derives_from(spark: SparkSession, d: str) -> DataFrame:
    below = relations.derived_types(type_edges(spark, d), f"R:{REGION}", True, ["derives"]).select(F.col("id").alias("symbol_id"))
    return entities(spark, d).join(below, "symbol_id", "left_semi").select("symbol_id", "name")


def semantic_implements(spark: SparkSession, d: str) -> DataFrame:
    below = relations.derived_types(type_edges(spark, d), "N:3", True, ["implements"]).select(F.col("id").alias("symbol_id"))
    return entities(spark, d).join(below, "symbol_id", "left_semi").select("symbol_id", "name")


def semantic_has_attribute(spark: SparkSession, d: str) -> DataFrame:
    keys = semantic.keys_of(_type_facts(spark, d), "attribute", F.col("display"), F.col("metadata"))
    return semantic.key_search(keys, _t(spark, d, "part").withColumnRenamed("p_partkey", "symbol_id"), "attribute", "TPCH.ECONOMY").select("symbol_id", F.col("p_name").alias("name"))


def semantic_returns(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("symbol_id"), "o_orderpriority", "o_orderstatus")
    keys = semantic.keys_of(o, "returns", F.col("o_orderpriority"), F.concat(F.lit("P."), "o_orderpriority"))
    return semantic.key_search(keys, o, "returns", "1-URGENT").select("symbol_id", "o_orderstatus")


def _parameters(spark: SparkSession, d: str) -> DataFrame:
    facts = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("symbol_id"), F.col("l_partkey").cast("string").alias("p")).distinct()
    return semantic.keys_of(facts, "parameter", F.col("p"), F.concat(F.lit("P:"), "p"))


def semantic_parameter_type(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("symbol_id"), "o_orderstatus")
    return semantic.key_search(_parameters(spark, d), orders, "parameter", f"P:{PART}").select("symbol_id", "o_orderstatus")


def key_fan_out(spark: SparkSession, d: str) -> DataFrame:
    return _parameters(spark, d).groupBy("key").agg(F.count("*").alias("symbols"))


def overlay_merge(spark: SparkSession, d: str) -> DataFrame:
    line = _t(spark, d, "lineitem")
    base = line.groupBy(F.col("l_partkey").alias("symbol_id")).agg(F.collect_set("l_suppkey").alias("declaring_docs")).withColumn("origin", F.lit("base"))
    dirty = _t(spark, d, "supplier").where("s_nationkey = 20").select(F.col("s_suppkey").alias("doc_id"))
    again = semantic.reextract(base, dirty).join(dirty.withColumn("edited", F.lit(True)), "doc_id", "left")
    # the simulated edit takes lines from dirty documents only
    now = line.join(again, F.col("l_suppkey") == F.col("doc_id")).where(F.col("edited").isNull() | (F.col("l_quantity") > 10))
    fresh = now.groupBy(F.col("l_partkey").alias("symbol_id")).agg(F.collect_set("l_suppkey").alias("declaring_docs")).withColumn("origin", F.lit("fresh"))
    return semantic.overlay(base, fresh, dirty).select("symbol_id", "origin")


def rename_preview(spark: SparkSession, d: str) -> DataFrame:
    return rename.rename_preview(_t(spark, d, "documents"), "the", "der").select("doc_id", F.col("occurrences").cast("long").alias("occurrences"), F.md5("new_text").alias("new_md5"))


def rename_lines(spark: SparkSession, d: str) -> DataFrame:
    return rename.occurrence_lines(_t(spark, d, "documents"), "the").select("doc_id", F.col("line").cast("long").alias("line"), F.col("occurrences").cast("long").alias("occurrences"))


def project_overview(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))
    docs = _t(spark, d, "customer").select(F.col("c_nationkey").alias("project_id"))
    members = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("project_id"), F.col("s_name").alias("member"))
    return reports.project_overview(n, docs, members).select("project_id", "name", F.col("documents").cast("long").alias("documents"), "members")


def project_overview_refs(spark: SparkSession, d: str) -> DataFrame:
    """Nations as projects that refer to the nations with the next keys in their region; suppliers are packages."""
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"), "n_regionkey")
    other = n.select(F.col("project_id").alias("ref_project_id"), F.col("n_regionkey").alias("r"))
    links = n.join(other, (F.col("n_regionkey") == F.col("r")) & (F.col("project_id") < F.col("ref_project_id"))).select("project_id", "ref_project_id")
    packages = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("project_id"), F.col("s_name").alias("name"), F.lit("1").alias("version"), F.col("s_suppkey").cast("int").alias("ordinal"))
    docs = _t(spark, d, "customer").select(F.col("c_nationkey").alias("project_id"))
    out = analysis.project_overview(n, docs, links, packages, max_projects=20, max_packages=3, max_refs=2)
    return out.select("project_id", F.col("documents").cast("long").alias("documents"), F.array_join("project_refs", ",").alias("project_refs"), F.array_join(F.transform("package_refs", lambda x: x["name"]), ",").alias("packages"))


def _page_calls(spark: SparkSession, d: str, found: Column, name: Column, receiver: Column) -> DataFrame:
    """Calls as the pages hold them: page_id, ordinal and what ``classify`` reads."""
    hits = _t(spark, d, "pages").select("page_id", F.posexplode(found).alias("ordinal", "arg0_value"))
    none, no_texts = F.lit(None).cast("string"), F.array().cast("array<string>")
    return hits.select(
        "page_id", F.col("ordinal").cast("long").alias("ordinal"), "arg0_value", name.alias("method_name"), F.array(F.col("arg0_value"), F.lit("handler")).alias("arg_texts"), no_texts.alias("type_args"),
        receiver.alias("receiver_type"), no_texts.alias("receiver_interfaces"), none.alias("reduced_first_param"), none.alias("containing_type"), none.alias("raw_call"),
    )


def _routes(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in ("MapGet", "MapPost", "UseX")]), (F.length("arg0_value") % 3 + 1).cast("int"))
    return _page_calls(spark, d, F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), name, F.lit(None).cast("string"))


def _middleware(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(r"track\((\d+)\)"), F.lit(1)))
    return _page_calls(spark, d, found, F.lit("UseTracking"), F.lit(invocations.BUILDER))


def find_entrypoints_routes(spark: SparkSession, d: str) -> DataFrame:
    return invocations.classify(_routes(spark, d)).where("bucket = 'route'").select("page_id", "ordinal", "verb", "template", "handler")


def find_entrypoints_middleware(spark: SparkSession, d: str) -> DataFrame:
    return invocations.classify(_middleware(spark, d)).where("bucket = 'middleware'").select("page_id", F.col("arg0_value").cast("long").alias("argument"))


def _host() -> Column:
    return F.regexp_extract("url", "^https?://([^/]*)", 1)


def _hosts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Registered types, as classified calls, and subclasses, by the prefix of the pages' hosts."""
    p = _t(spark, d, "pages").select(_host().alias("type"))
    registered = p.where("type LIKE 'www.%'").select(F.lit("hosted").alias("bucket"), F.regexp_replace("type", r"^(www|blog|m)\.", "").alias("hosted_type"))
    return registered, p.where("type LIKE 'blog.%'").select(F.regexp_replace("type", r"^(www|blog|m)\.", "").alias("type"))


def find_entrypoints_hosted(spark: SparkSession, d: str) -> DataFrame:
    return invocations.hosted_services(*_hosts(spark, d))


def find_entrypoints(spark: SparkSession, d: str) -> DataFrame:
    registered, subclasses = _hosts(spark, d)
    calls = invocations.classify(_routes(spark, d).union(_middleware(spark, d))).unionByName(registered, allowMissingColumns=True)
    out = analysis.find_entrypoints(calls, subclasses, cap=20, place=["page_id", "ordinal"])
    return out.select("section", "count", "truncated", F.size("items").cast("long").alias("listed"), F.md5(F.coalesce(F.get_json_object(F.get("items", F.lit(0)), "$.template"), F.get_json_object(F.get("items", F.lit(0)), "$.type"), F.lit(""))).alias("first_md5"))


def _registered(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("p_type")
    lifetime = F.when(kind == "ECONOMY", "Singleton").when(kind == "STANDARD", "Scoped").when(kind == "PROMO", "Transient")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("service"), "p_name", lifetime.alias("lifetime"), F.when(lifetime.isNull(), "unclassified").otherwise("di").alias("bucket"), F.col("p_name").alias("implementation"), F.col("p_brand").alias("raw_call"), F.col("p_partkey").alias("service_key"))


def find_registrations(spark: SparkSession, d: str) -> DataFrame:
    params = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("containing_type"))
    hit = invocations.find_registrations(_registered(spark, d).withColumn("service", F.col("service").cast("string")), "BOLT")
    return invocations.with_consumers(hit.withColumn("service", F.col("service_key")), params).select("service", "p_name", "bucket", F.col("consumers").cast("long").alias("consumers"))


def registration_lifetimes(spark: SparkSession, d: str) -> DataFrame:
    return invocations.lifetime_counts(_registered(spark, d))


def registrations_listed(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 of each section and their consumers' number."""
    found = _registered(spark, d).withColumn("service", F.concat(F.lit("N."), F.col("service").cast("string")))
    params = _t(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("key"), F.col("l_suppkey").cast("string").alias("containing_type"), F.col("l_orderkey").cast("string").alias("file_path"), F.col("l_linenumber").cast("int").alias("line"))
    out = analysis.registrations(found, params, "bolt", 20, ["p_name", "service_key"])
    return out.select("section", "count", "truncated", "service_key", F.size("consumers").cast("long").alias("consumers"))


def analyze_symbol(spark: SparkSession, d: str) -> DataFrame:
    """The report of one part; parts are methods here, so the sections of types are missing."""
    symbols = _t(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.lit("Method").alias("kind"), F.col("p_type").alias("signature"), F.lit(None).cast("string").alias("xml_doc"))
    out = analysis.analyze_symbol(symbols, refs(spark, d), type_edges(spark, d), call_edges(spark, d), CALLEE, is_type=False)
    return out.select("section", "count", "truncated", F.size("items").cast("long").alias("listed"))


def analyze_type(spark: SparkSession, d: str) -> DataFrame:
    """The report of one region, a type without references or callers."""
    e, tag = entities(spark, d), F.concat(F.lit("P:"), F.col("target_id").cast("string"))
    symbols = e.select("*", F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("xml_doc"))
    calls = call_edges(spark, d).withColumn("callee_id", F.concat(F.lit("P:"), F.col("callee_id").cast("string")))
    out = analysis.analyze_symbol(symbols, refs(spark, d).withColumn("target_id", tag), type_edges(spark, d), calls, f"R:{REGION}", include=("references", "implementations", "derived", "callers"))
    return out.select("section", "count", "truncated", F.size("items").cast("long").alias("listed"), F.get_json_object(F.get("items", F.lit(0)), "$.symbol_id").alias("first"))


def test_map(spark: SparkSession, d: str) -> DataFrame:
    line, orders, cust = (_t(spark, d, x) for x in ("lineitem", "orders", "customer"))
    sites = line.where(F.col("l_partkey") == CALLEE).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    sites = sites.select(F.col("c_mktsegment").alias("project_id"), F.col("o_orderkey").cast("string").alias("file_path"), F.col("l_linenumber").alias("line"))
    types = _t(spark, d, "part").select(F.lit("BUILDING").alias("project_id"), F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("line"))
    tests = spark.range(1).select(F.lit("BUILDING").alias("project_id"))
    return reports.test_map(sites, types, tests, "ring", 10)


def test_projects(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one segment refer to a test framework; those below region 1 reach it."""
    tag = lambda k, c: F.concat(F.lit(k + ":"), F.col(c).cast("string"))
    framework = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("/lib/XUnit.core.dll"))).otherwise(F.array(F.lit("/lib/System.dll")))
    projects = _t(spark, d, "customer").select(tag("C", "c_custkey").alias("project_id"), F.col("c_name").alias("name"), framework.alias("metadata_refs"))
    projects = projects.union(_t(spark, d, "nation").select(tag("N", "n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("_IntegrationTests"))).otherwise(F.col("n_name")), F.lit(None).cast("array<string>")))
    links = type_edges(spark, d).select(F.col("child_id").alias("project_id"), F.col("parent_id").alias("ref_project_id"))
    return analysis.test_projects(projects, links, f"R:{REGION}")


def _dead(spark: SparkSession, d: str) -> DataFrame:
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    status = F.col("o_orderstatus")
    access = F.when(status == "O", "Public").when(status == "P", "Internal").otherwise("Private")
    s = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("symbol_id"), F.col("o_orderkey").alias("file_path"), access.alias("accessibility"), F.col("o_orderpriority").alias("name"), F.col("c_mktsegment").alias("segment"))
    return reports.dead_code_status(s, denied=F.col("name") == "5-LOW")


def dead_code_candidates(spark: SparkSession, d: str) -> DataFrame:
    used = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("target_id"))
    return reports.dead_code_candidates(_dead(spark, d), used, F.col("segment") == "BUILDING").select("symbol_id", "accessibility", "confidence")


def dead_code_skipped(spark: SparkSession, d: str) -> DataFrame:
    return reports.dead_code_skipped(_dead(spark, d)).select("public_members", "denylisted")


def dead_code_defaults(spark: SparkSession, d: str) -> DataFrame:
    """The statuses under the lists of names and attributes that are the default."""
    o = _t(spark, d, "orders")
    names = F.create_map(*[F.lit(x) for x in ("1-URGENT", "Equals", "2-HIGH", "Main", "3-MEDIUM", "DisposeAsync", "4-NOT SPECIFIED", "Run", "5-LOW", "ToString2")])
    s = o.select(F.col("o_orderkey").alias("symbol_id"), F.col("o_orderkey").alias("file_path"), F.when(F.col("o_orderstatus") == "O", "Public").otherwise("Private").alias("accessibility"), names[F.col("o_orderpriority")].alias("name"))
    k = F.col("o_orderkey") % 6
    attribute = F.when(k == 0, "Xunit.FactAttribute").when(k == 1, "DllImportAttribute").when(k == 2, "My.NotAFactAttribute").otherwise("System.ObsoleteAttribute")
    keys = o.select(F.lit("attribute").alias("index_kind"), attribute.alias("key"), F.col("o_orderkey").alias("symbol_id"))
    return reports.dead_code_status(s, symbol_keys=keys).groupBy("status").agg(F.count("*").alias("n"))


def project_reachability(spark: SparkSession, d: str) -> DataFrame:
    e = type_edges(spark, d).select(F.col("child_id").alias("src"), F.col("parent_id").alias("dst"))
    return graph.closure(e, spark.range(1).select(F.lit("C:5").alias("id"))).select("id", "depth")


def fresh_documents(spark: SparkSession, d: str) -> DataFrame:
    newest = top_per(_t(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("mtime"), "event_id"), ["doc_id"], [F.desc("mtime"), F.desc("event_id")], 1)
    known = newest.select("doc_id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("mtime"))
    return newest.join(sources.changed_documents(newest, known), "doc_id").select(F.col("doc_id").alias("user_id"), "event_id")


def invocation_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every branch of the ordered classification, by event type as the call's name."""
    kind = F.col("event_type")
    names = F.when(kind == "click", "MapGet").when(kind == "purchase", "UseAuth").when(kind == "error", "AddHostedService").when(kind == "view", "AddScoped").otherwise("TryAddX")
    builder = F.when(F.col("user_id") % 2 == 0, F.lit(invocations.BUILDER)).otherwise(F.lit(invocations.COLLECTION))
    n = (F.col("event_id") % 3).cast("int")
    calls = _t(spark, d, "events").select("event_id", names.alias("method_name"), F.array_repeat(F.lit("T"), n).alias("type_args"), F.array(F.lit("a"), F.lit("h")).alias("arg_texts"), F.lit("a").alias("arg0_value"), builder.alias("receiver_type"), F.array().cast("array<string>").alias("receiver_interfaces"), F.lit(None).cast("string").alias("reduced_first_param"), F.lit(None).cast("string").alias("containing_type"))
    return invocations.classify(calls).groupBy(F.coalesce("bucket", F.lit("none")).alias("bucket")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        echo, find_references, reference_summary, goto_definition, hover, hover_at, workspace_symbol, find_implementations, derived_types_direct,
        derived_types_transitive, list_document_symbols, find_callers_direct, find_callers_transitive, find_callers_sites, find_callers_all, find_callees, compilation_errors,
        compilation_errors_written, key_fan_out, rename_lines, project_overview_refs, find_entrypoints, registrations_listed, analyze_type, test_projects, dead_code_defaults,
        compilation_errors_summary, document_diagnostics, semantic_derives_from, semantic_implements, semantic_has_attribute, semantic_returns,
        semantic_parameter_type, overlay_merge, rename_preview, project_overview, find_entrypoints_routes, find_entrypoints_middleware,
        find_entrypoints_hosted, find_registrations, registration_lifetimes, analyze_symbol, test_map, dead_code_candidates, dead_code_skipped,
        project_reachability, fresh_documents, invocation_classes,
    )
}

_CALLS = """WITH RECURSIVE line AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem),
calls AS (SELECT a.l_partkey AS caller_id, b.l_partkey AS callee_id, a.l_orderkey AS file_path, a.l_linenumber AS ordinal
  FROM line a JOIN line b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""
_DIAG = """WITH diag AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Warning' WHEN 'click' THEN 'Info' ELSE 'Hidden' END AS severity,
  json_extract_string(props, '$.k') AS code, user_id AS file_path, event_type AS project_id FROM events)"""
_TREE = """WITH RECURSIVE ent AS (
  SELECT 'R:' || r_regionkey AS symbol_id, r_name AS name, 'Namespace' AS kind FROM region UNION ALL SELECT 'N:' || n_nationkey, n_name, 'Interface' FROM nation
  UNION ALL SELECT 'C:' || c_custkey, c_name, 'Class' FROM customer UNION ALL SELECT 'S:' || s_suppkey, s_name, 'Class' FROM supplier
  UNION ALL SELECT 'P:' || p_partkey, p_name, 'Method' FROM part),
edge AS (SELECT 'N:' || n_nationkey AS child, 'R:' || n_regionkey AS parent FROM nation UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey FROM customer
  UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier),
below AS (SELECT child AS id, 1 AS depth FROM edge WHERE parent = 'R:1' UNION SELECT e.child, b.depth + 1 FROM below b JOIN edge e ON e.parent = b.id),
above AS (SELECT 'C:5' AS id, 0 AS depth UNION SELECT e.parent, a.depth + 1 FROM above a JOIN edge e ON e.child = a.id)"""
_DEAD = """WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Public' WHEN 'P' THEN 'Internal' ELSE 'Private' END AS accessibility, o_orderpriority, c_mktsegment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""

ORACLE = {
    "echo": "SELECT 'Echo: hello' AS message",
    "find_references": "SELECT DISTINCT l_orderkey AS file_path, l_linenumber AS line FROM lineitem WHERE l_partkey = 84",
    "reference_summary": "SELECT l_partkey AS target_id, count(*) AS \"references\", count(DISTINCT l_orderkey) AS files FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem) GROUP BY l_partkey",
    "goto_definition": "SELECT p_partkey AS symbol_id, p_brand AS file_path, p_size AS line FROM part WHERE p_partkey = (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = 3763 AND l_linenumber = 4)",
    "hover": "SELECT conv_id, turn, role AS signature, nullif(trim(split_part(text, chr(10), 1), ' '), '') AS doc FROM conversations",
    "hover_at": "SELECT conv_id || '/' || turn AS symbol_id, role AS signature, nullif(trim(split_part(text, chr(10), 1), ' '), '') AS doc FROM conversations WHERE conv_id = 3 AND turn = 1",
    "workspace_symbol": _TREE + """ SELECT symbol_id, name, tier FROM (SELECT *, CASE WHEN name = 'bolt' THEN 0 WHEN lower(name) = 'bolt' THEN 1 WHEN starts_with(lower(name), 'bolt') THEN 2
  WHEN len(regexp_replace(name, '[^A-Z0-9]', '', 'g')) > 1 AND starts_with(regexp_replace(name, '[^A-Z0-9]', '', 'g'), 'bolt') THEN 3 WHEN contains(lower(name), 'bolt') THEN 4 END AS tier
  FROM ent WHERE kind IN ('Method', 'Class')) WHERE tier IS NOT NULL ORDER BY tier, len(name), name, symbol_id LIMIT 100""",
    "find_implementations": _TREE + " SELECT symbol_id, name FROM ent WHERE kind = 'Class' AND symbol_id IN (SELECT id FROM below)",
    "derived_types_direct": _TREE + " SELECT child AS id FROM edge WHERE parent = 'R:1'",
    "derived_types_transitive": _TREE + " SELECT id, min(depth)::INT AS depth FROM below GROUP BY id",
    "list_document_symbols": "SELECT l_linenumber AS ordinal, l_partkey AS symbol_id, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = 3763",
    "find_callers_direct": _CALLS + " SELECT caller_id, file_path, ordinal FROM calls WHERE callee_id = 0",
    "find_callers_transitive": _CALLS + """, reach AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT c.caller_id, r.depth + 1 FROM reach r JOIN calls c ON c.callee_id = r.id WHERE r.depth < 3)
  SELECT id, min(depth)::INT AS depth FROM reach GROUP BY id""",
    "find_callers_sites": _CALLS + """, reach AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT c.caller_id, r.depth + 1 FROM reach r JOIN calls c ON c.callee_id = r.id WHERE r.depth < 1)
  SELECT caller_id, callee_id, file_path, ordinal FROM calls WHERE callee_id IN (SELECT id FROM reach)""",
    "find_callers_all": _CALLS + """, pairs AS (SELECT DISTINCT callee_id, caller_id FROM calls), reach AS (SELECT 0::BIGINT AS id UNION SELECT c.caller_id FROM reach r JOIN pairs c ON c.callee_id = r.id)
  SELECT callee_id, count(*) AS sites FROM calls WHERE callee_id IN (SELECT id FROM reach) GROUP BY callee_id""",
    "find_callees": _CALLS + """ SELECT callee_id, file_path, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY callee_id ORDER BY file_path, ordinal) AS k FROM calls WHERE caller_id = 0)
  WHERE k = 1 ORDER BY file_path, ordinal, callee_id::VARCHAR LIMIT 50""",
    "compilation_errors": _DIAG + " SELECT event_id, severity, code, file_path FROM diag WHERE severity IN ('Error', 'Warning') AND code NOT IN ('7', '13')",
    "compilation_errors_summary": _DIAG + " SELECT project_id, count_if(severity = 'Error')::BIGINT AS errors, count_if(severity = 'Warning')::BIGINT AS warnings FROM diag WHERE severity IN ('Error', 'Warning') GROUP BY project_id",
    "compilation_errors_written": _DIAG + """ SELECT event_id, CASE WHEN file_path % 5 = 2 THEN NULL ELSE 'src/objects/f' || file_path || '.cs' END AS file_path FROM diag WHERE severity IN ('Error', 'Warning') AND file_path % 5 NOT IN (0, 1)""",
    "document_diagnostics": _DIAG + " SELECT event_id, severity, code FROM diag WHERE file_path = 8 AND severity != 'Hidden'",
    "semantic_derives_from": _TREE + " SELECT symbol_id, name FROM ent WHERE symbol_id IN (SELECT child FROM edge WHERE parent = 'R:1')",
    "semantic_implements": _TREE + " SELECT symbol_id, name FROM ent WHERE symbol_id IN (SELECT child FROM edge WHERE parent = 'N:3')",
    "semantic_has_attribute": "SELECT p_partkey AS symbol_id, p_name AS name FROM part WHERE p_type = 'ECONOMY' OR 'TPCH.' || p_type = 'ECONOMY'",
    "semantic_returns": "SELECT o_orderkey AS symbol_id, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'",
    "semantic_parameter_type": "SELECT o_orderkey AS symbol_id, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 84)",
    "key_fan_out": "SELECT key, count(*) AS symbols FROM (SELECT DISTINCT l_orderkey, unnest([l_partkey::VARCHAR, 'P:' || l_partkey]) AS key FROM lineitem) GROUP BY key",
    "overlay_merge": """WITH dirty AS (SELECT s_suppkey FROM supplier WHERE s_nationkey = 20), stale AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM dirty)),
  again AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM stale) UNION SELECT s_suppkey FROM dirty)
  SELECT DISTINCT l_partkey AS symbol_id, 'base' AS origin FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM stale)
  UNION ALL SELECT DISTINCT l_partkey, 'fresh' FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM stale) AND l_suppkey IN (SELECT l_suppkey FROM again)
    AND (l_quantity > 10 OR l_suppkey NOT IN (SELECT s_suppkey FROM dirty))""",
    "rename_preview": """WITH m AS (SELECT doc_id, array_to_string(list_transform(string_split_regex(regexp_replace(text, '([A-Za-z0-9_]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: CASE WHEN x = 'the' THEN 'der' ELSE x END), '') AS t,
  len(list_filter(string_split_regex(regexp_replace(text, '([A-Za-z0-9_]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x = 'the'))::BIGINT AS n FROM documents)
  SELECT doc_id, n AS occurrences, md5(t) AS new_md5 FROM m WHERE n > 0""",
    "rename_lines": """WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS t FROM documents),
  n AS (SELECT doc_id, line, len(list_filter(regexp_extract_all(t, '[A-Za-z0-9_]+'), lambda x: x = 'the'))::BIGINT AS occurrences FROM l) SELECT * FROM n WHERE occurrences > 0""",
    "project_overview": """SELECT n_nationkey AS project_id, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS documents,
  coalesce((SELECT string_agg(s_name, ',' ORDER BY s_name) FROM (SELECT s_name, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS k FROM (SELECT DISTINCT s_name, s_nationkey FROM supplier)) WHERE k <= 8 AND s_nationkey = n_nationkey), '') AS members
  FROM nation ORDER BY n_name, n_nationkey LIMIT 25""",
    "project_overview_refs": """WITH links AS (SELECT a.n_nationkey AS k, b.n_nationkey AS r, b.n_name AS name, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_nationkey) AS i FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey),
  packs AS (SELECT s_nationkey AS k, s_name, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier)
  SELECT n_nationkey AS project_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS documents, coalesce((SELECT string_agg(name, ',' ORDER BY r) FROM links WHERE k = n_nationkey AND i <= 2), '') AS project_refs,
    coalesce((SELECT string_agg(s_name, ',' ORDER BY s_suppkey) FROM packs WHERE k = n_nationkey AND i <= 3), '') AS packages FROM nation ORDER BY n_name, n_nationkey LIMIT 20""",
    "find_entrypoints_routes": """SELECT page_id, ordinal, CASE len(h) % 3 WHEN 0 THEN 'GET' ELSE 'POST' END AS verb, h AS template, 'handler' AS handler FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS ordinal FROM pages) WHERE len(h) % 3 != 2""",
    "find_entrypoints": """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS ordinal FROM pages),
  r AS (SELECT * FROM h WHERE len(h) % 3 != 2), m AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'track\\((\\d+)\\)', 1)) AS a FROM pages),
  q AS (SELECT u, regexp_replace(u, '^(www|blog|m)\\.', '') AS t FROM (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS u FROM pages)), g AS (SELECT DISTINCT t FROM q WHERE u LIKE 'www.%'),
  s AS (SELECT t, 'registration' AS via FROM g UNION ALL SELECT DISTINCT t, 'subclass' FROM q WHERE u LIKE 'blog.%' AND t NOT IN (SELECT t FROM g))
  SELECT 'routes' AS section, count(*) AS count, count(*) > 20 AS truncated, least(count(*), 20) AS listed, md5(coalesce(arg_min(h, (page_id, ordinal)), '')) AS first_md5 FROM r
  UNION ALL SELECT 'middleware', count(*), count(*) > 20, least(count(*), 20), md5('') FROM m
  UNION ALL SELECT 'hostedServices', count(*), count(*) > 20, least(count(*), 20), md5(coalesce(arg_min(t, (via, t)), '')) FROM s""",
    "find_entrypoints_middleware": "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'track\\((\\d+)\\)', 1))::BIGINT AS argument FROM pages",
    "find_entrypoints_hosted": """WITH p AS (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS h FROM pages), q AS (SELECT h, regexp_replace(h, '^(www|blog|m)\\.', '') AS t FROM p),
  r AS (SELECT DISTINCT t FROM q WHERE h LIKE 'www.%') SELECT t AS type, 'registration' AS via FROM r UNION ALL SELECT DISTINCT t, 'subclass' FROM q WHERE h LIKE 'blog.%' AND t NOT IN (SELECT t FROM r)""",
    "find_registrations": """SELECT p_partkey AS service, p_name, CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'di' ELSE 'unclassified' END AS bucket,
  (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = p_partkey) AS consumers FROM part
  WHERE CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'PROMO') THEN contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt') OR contains(p_partkey::VARCHAR, 'bolt') ELSE contains(lower(p_brand), 'bolt') END""",
    "registrations_listed": """WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'registrations' ELSE 'unclassified' END AS section FROM part
    WHERE CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'PROMO') THEN contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt') OR contains('n.' || p_partkey, 'bolt') ELSE contains(lower(p_brand), 'bolt') END),
  k AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY p_name, p_partkey) AS i FROM p),
  n AS (SELECT s.section, (SELECT count(*) FROM p WHERE p.section = s.section) AS count FROM (VALUES ('registrations'), ('unclassified')) s(section))
  SELECT n.section, n.count, n.count > 20 AS truncated, k.p_partkey AS service_key, coalesce((SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = k.p_partkey), 0) AS consumers FROM n LEFT JOIN k ON k.section = n.section AND k.i <= 20""",
    "registration_lifetimes": "SELECT CASE p_type WHEN 'ECONOMY' THEN 'Singleton' WHEN 'STANDARD' THEN 'Scoped' WHEN 'PROMO' THEN 'Transient' ELSE 'unclassified' END AS lifetime, count(*) AS n FROM part GROUP BY 1",
    "analyze_symbol": _CALLS + """, n AS (SELECT 'hover' AS section, (SELECT count(*) FROM part WHERE p_partkey = 0) AS count, 1 AS cap UNION ALL SELECT 'references', (SELECT count(*) FROM lineitem WHERE l_partkey = 0), 20
  UNION ALL SELECT 'callers', (SELECT count(*) FROM calls WHERE callee_id = 0), 20) SELECT section, count, count > cap AS truncated, least(count, cap) AS listed FROM n""",
    "analyze_type": _TREE + """, n AS (SELECT 'references' AS section, 0::BIGINT AS count, NULL AS first UNION ALL SELECT 'implementations', (SELECT count(DISTINCT id) FROM below), (SELECT min(id) FROM below)
  UNION ALL SELECT 'derived', (SELECT count(*) FROM edge WHERE parent = 'R:1'), NULL UNION ALL SELECT 'callers', 0, NULL) SELECT section, count, count > 20 AS truncated, least(count, 20) AS listed, first FROM n""",
    "test_map": """SELECT test_symbol, confidence, via, file_path, line FROM (
  SELECT DISTINCT 'BUILDING.' || o_orderkey AS test_symbol, 0 AS rank, 'high' AS confidence, 'reference' AS via, o_orderkey::VARCHAR AS file_path, l_linenumber AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_partkey = 0 AND c_mktsegment = 'BUILDING'
  UNION ALL SELECT p_name, 1, 'medium', 'name-match', p_brand, p_size FROM part WHERE p_name IN ('ringTests', 'ringSpec', 'Testring', 'Testsring')) ORDER BY rank, test_symbol, file_path, line LIMIT 10""",
    "test_projects": "SELECT 'C:' || c_custkey AS project_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_mktsegment = 'BUILDING' UNION ALL SELECT 'N:' || n_nationkey FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 0",
    "dead_code_candidates": _DEAD + """ SELECT o_orderkey AS symbol_id, accessibility, CASE WHEN accessibility = 'Internal' AND c_mktsegment = 'BUILDING' THEN 'medium' ELSE 'high' END AS confidence
  FROM s WHERE accessibility != 'Public' AND o_orderpriority != '5-LOW' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "dead_code_defaults": """SELECT CASE WHEN o_orderstatus = 'O' THEN 'public' WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') OR o_orderkey % 6 IN (0, 1) THEN 'deny' ELSE 'eligible' END AS status, count(*) AS n FROM orders GROUP BY 1""",
    "dead_code_skipped": _DEAD + " SELECT count_if(accessibility = 'Public')::BIGINT AS public_members, count_if(accessibility != 'Public' AND o_orderpriority = '5-LOW')::BIGINT AS denylisted FROM s",
    "project_reachability": _TREE + " SELECT id, min(depth)::INT AS depth FROM above GROUP BY id",
    "fresh_documents": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND ts > TIMESTAMP '2024-01-01 00:00:00'",
    "invocation_classes": """SELECT bucket, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'route' WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'middleware' ELSE 'unclassified' END
  WHEN 'error' THEN CASE WHEN event_id % 3 = 1 THEN 'hosted' ELSE 'none' END WHEN 'view' THEN CASE WHEN user_id % 2 = 1 THEN 'di' ELSE 'none' END
  ELSE CASE WHEN user_id % 2 = 1 THEN 'unclassified' ELSE 'none' END END AS bucket FROM events) GROUP BY bucket""",
}
