"""Fact tables from a folder of C# sources: documents are read one by one, names are bound by joins.

What a name means is settled by rank: a type of that qualified name, of the same or an enclosing namespace, of an
imported one, else the only one so called. Types of frameworks keep the name that KNOWN gives them or the one
written. A call goes to the method of that name and a fitting number of arguments in the receiver's type, in a type
above it, or that extends it; a receiver's type is known from parameters, fields, local variables and ``new``.
Limits: no overloads by type, no inference beyond that, generic arguments aren't part of a type's identity, references
are to types and called methods, diagnostics come from no compiler. Ids name parameter types as they are written,
predefined types in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake import sources
from symlake.functions import top_per
from symlake.schema import FACTS
from symlake.sources.csharp import ALIASES, Document

#: Namespaces of framework types that operators know by their full names.
KNOWN = {
    "BackgroundService": "Microsoft.Extensions.Hosting", "IHostedService": "Microsoft.Extensions.Hosting", "IServiceCollection": "Microsoft.Extensions.DependencyInjection",
    "IApplicationBuilder": "Microsoft.AspNetCore.Builder", "WebApplication": "Microsoft.AspNetCore.Builder", "WebApplicationBuilder": "Microsoft.AspNetCore.Builder", "Attribute": "System",
    "Exception": "System", "IDisposable": "System", "Task": "System.Threading.Tasks", "FactAttribute": "Xunit", "TheoryAttribute": "Xunit",
}
TYPES = ["Class", "Interface", "Struct", "Enum"]
_SPAN = "line: int, col: int, end_line: int, end_col: int"
_DECLARED = (
    "symbol_id: string, name: string, kind: string, namespace: string, containing_type: string, accessibility: string, signature: string, display: string, xml_doc: string, returns: string, "
    f"parameters: array<string>, attributes: array<string>, bases: array<string>, extends: string, required: int, {_SPAN}"
)
_CALL = (
    "caller: string, caller_type: string, method_name: string, name: string, type_args: array<string>, arg_texts: array<string>, arg0_value: string, raw_call: string, receiver: string, bare: boolean, "
    f"{_SPAN}"
)
READ = (
    "doc_id string, project_id string, file_path string, namespace string, usings array<string>, "
    f"declared array<struct<{_DECLARED}>>, uses array<struct<name: string, qualifier: string, attribute: boolean, {_SPAN}>>, calls array<struct<{_CALL}>>, error string"
)
#: Steps from a type to one above it that a call's method is looked for.
ABOVE = 4


def _read(doc_id: str, project_id: str, file_path: str, text: str) -> tuple:
    try:
        d = Document(text or "")
    except (RecursionError, IndexError, KeyError) as e:
        return doc_id, project_id, file_path, "", [], [], [], [], f"{type(e).__name__}: {e}"
    span = lambda at, n: dict(zip(("line", "col", "end_line", "end_col"), d.span(at, n), strict=True))
    keep = [x.split(": ")[0] for x in _DECLARED.split(", ")][:15]
    declared = [{k: getattr(x, k) for k in keep} | span(x.name_at, len(x.name) if not x.name.startswith((".", "op_")) else 1) for x in d.declared]
    uses = [{"name": n, "qualifier": q, "attribute": a} | span(at, len(n)) for n, q, at, a in d.uses]
    calls = [{k: v for k, v in c.items() if k != "at"} | span(c["at"], len(c["name"])) for c in sorted(d.calls, key=lambda c: c["at"])]
    return doc_id, project_id, file_path, next((x.namespace for x in d.declared), ""), d.usings, declared, uses, calls, None


def read(documents: DataFrame) -> DataFrame:
    """One row per document (doc_id, project_id, file_path, text): what it declares, uses and calls, or an error."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in ("doc_id", "project_id", "file_path", "namespace", "usings", "declared", "uses", "calls", "error")]
        for p in parts:
            yield pd.DataFrame([_read(*r) for r in p[["doc_id", "project_id", "file_path", "text"]].itertuples(index=False)], columns=names)

    return documents.select("doc_id", "project_id", "file_path", "text").mapInPandas(work, READ)


def _simple(written: Column) -> Column:
    """The last name of a written type, without generic arguments and suffixes."""
    return F.regexp_extract(F.regexp_replace(written, r"<.*$|[?\[\],*]+$", ""), r"(\w*)$", 1)


def _plain(written: Column) -> Column:
    return F.regexp_replace(written, r"<.*$|[?\[\],*]+$", "")


def types_of(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin(TYPES)).select(F.col("name").alias("t_name"), F.col("display").alias("t_full"), F.col("namespace").alias("t_space"), F.col("symbol_id").alias("t_id"), F.col("kind").alias("t_kind"))


def bind(asked: DataFrame, types: DataFrame, written: str = "written") -> DataFrame:
    """asked (written, namespace, usings, ...) with t_id, t_full and t_kind of the type meant; t_id is null for one of no document.

    Each distinct question is answered once.
    """
    key = [written, "namespace", "usings"]
    q = asked.select(*key).distinct().withColumn("t_name", _simple(F.col(written)))
    q = q.withColumn("key", F.xxhash64(*key))
    inside = lambda inner, outer: (inner == outer) | inner.startswith(F.concat(outer, F.lit(".")))
    rank = (
        F.when(F.col("t_full") == _plain(F.col(written)), 0)
        .when(inside(F.col("namespace"), F.col("t_space")) | (F.col("t_space") == ""), 1)
        .when(F.array_contains("usings", F.col("t_space")), 2)
        .otherwise(3)
    )
    hit = q.join(types, "t_name").withColumn("rank", rank).where((F.col("rank") < 3) | ~_plain(F.col(written)).contains("."))
    best = top_per(hit, key, [F.col("rank"), -F.length("t_space"), F.col("t_full")], 1).select(*key, "t_id", "t_full", "t_kind")
    known = F.create_map(*[F.lit(x) for n, s in KNOWN.items() for x in (n, f"{s}.{n}")])
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    best = best.select(*[F.col(c).alias(f"__{c}") for c in key], "t_id", "t_full", "t_kind")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    out = asked.join(best, same[0] & same[1] & same[2], "left").drop(*[f"__{c}" for c in key])
    plain = _plain(F.col(written))
    return out.withColumn("t_full", F.coalesce("t_full", aliases[plain], known[_simple(F.col(written))], plain))


def _symbols(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declarations as they stand in documents, and one row for each symbol."""
    each = rows.select("doc_id", "project_id", "file_path", "usings", F.posexplode("declared").alias("ordinal", "x")).select("doc_id", "project_id", "file_path", "usings", "ordinal", "x.*")
    first = F.struct("file_path", "line", "col")
    at = F.struct("file_path", "line", "col", "end_line", "end_col")
    scalar = [c for c in ("project_id", "name", "kind", "namespace", "containing_type", "accessibility", "signature", "display", "xml_doc", "returns", "parameters", "extends", "required", "usings", "line", "col", "end_line", "end_col")]
    one = each.groupBy("symbol_id").agg(*[F.min_by(c, first).alias(c) for c in scalar], F.min("file_path").alias("file_path"), F.array_sort(F.collect_set("doc_id")).alias("declaring_docs"), F.array_sort(F.collect_set(at)).alias("locations"))
    return each, one


def facts(documents: DataFrame, folder: str | None = None) -> dict[str, DataFrame]:
    """The fact tables that the texts of documents give; with a folder the texts are read once and what was found is kept there."""
    rows = read(documents)
    if folder is not None:
        rows.write.mode("overwrite").parquet(f"{folder}/read")
        rows = documents.sparkSession.read.schema(rows.schema).parquet(f"{folder}/read")
    each, symbols = _symbols(rows)
    types = types_of(symbols)
    one = lambda c, **k: each.select("symbol_id", "namespace", "usings", "kind", F.explode(c).alias("written"), *[v.alias(n) for n, v in k.items()])

    bases = bind(one("bases").distinct(), types)
    looks_like = F.coalesce(F.col("t_kind") == "Interface", _simple(F.col("written")).rlike("^I[A-Z]"))
    kind = F.when(F.col("kind") == "Interface", "derives_interface").when(looks_like, "implements").otherwise("derives")
    type_edges = bases.select(F.col("symbol_id").alias("child_id"), F.coalesce("t_id", F.concat(F.lit("T:"), "t_full")).alias("parent_id"), kind.alias("kind")).distinct()

    full = types.select("t_id", "t_full")
    method = symbols.where(F.col("kind").isin("Method", "Property", "Indexer", "Event") & ~F.col("name").startswith(".")).select("symbol_id", "name", "containing_type", F.size("parameters").alias("n"))
    child, parent = full.toDF("child_id", "child_type"), full.toDF("parent_id", "parent_type")
    pairs = type_edges.join(child, "child_id").join(parent, "parent_id")
    above = method.select(F.col("symbol_id").alias("linked_id"), F.col("name").alias("l_name"), F.col("containing_type").alias("parent_type"), F.col("n").alias("l_n"))
    linked = method.join(pairs, F.col("containing_type") == F.col("child_type")).join(above, "parent_type").where((F.col("name") == F.col("l_name")) & (F.col("n") == F.col("l_n")))
    member_links = linked.select(F.col("symbol_id").alias("member_id"), "linked_id", F.when(F.col("kind") == "derives", "overrides").otherwise("implements").alias("kind")).distinct()

    # --- keys
    given = symbols.where("kind = 'Method' AND returns IS NOT NULL").select("symbol_id", "namespace", "usings", F.col("returns").alias("written"), F.lit("returns").alias("index_kind"))
    taken = symbols.where("kind = 'Method'").select("symbol_id", "namespace", "usings", F.explode("parameters").alias("written"), F.lit("parameter").alias("index_kind"))
    named = each.select("symbol_id", "namespace", "usings", F.explode("attributes").alias("a")).withColumn("written", F.when(F.col("a").endswith("Attribute"), F.col("a")).otherwise(F.concat("a", F.lit("Attribute"))))
    keyed = bind(given.union(taken).unionByName(named.drop("a").withColumn("index_kind", F.lit("attribute"))), types)
    back = F.create_map(*[F.lit(x) for a, b in ALIASES.items() for x in (b, a)])
    display = F.coalesce(back[F.col("t_full")], F.when(F.col("written").rlike(r"[<\[?]"), F.col("written")).otherwise(F.col("t_full")))
    symbol_keys = keyed.select("index_kind", F.explode(F.array_distinct(F.array(display, "t_full"))).alias("key"), "symbol_id").distinct()

    # --- uses of types
    span = ["file_path", "line", "col", "end_line", "end_col"]
    used = rows.select("project_id", "file_path", "namespace", "usings", F.explode("uses").alias("x")).select("project_id", "file_path", "namespace", "usings", "x.*")
    names = types.select(F.col("t_name").alias("__n")).distinct()
    used = used.withColumn("written", F.when(F.col("attribute") & ~F.col("name").endswith("Attribute"), F.concat("qualifier", F.lit("Attribute"))).otherwise(F.col("qualifier")))
    used = used.join(names, _simple(F.col("written")) == F.col("__n"), "left_semi")
    to_types = bind(used, types).where("t_id IS NOT NULL").select(F.col("t_id").alias("target_id"), "project_id", *span).distinct()

    # --- calls
    calls = rows.select("doc_id", "project_id", "file_path", "namespace", "usings", F.posexplode("calls").alias("ordinal", "x")).select("doc_id", "project_id", "file_path", "namespace", "usings", "ordinal", "x.*")
    calls = bind(calls.withColumn("written", F.when(F.col("bare"), F.col("caller_type")).otherwise(F.col("receiver"))), types).withColumnRenamed("t_full", "on_type").drop("t_id", "t_kind")
    edge = pairs.select(F.col("child_type").alias("lower"), F.col("parent_type").alias("upper")).distinct()
    up = types.select(F.col("t_full").alias("lower"), F.col("t_full").alias("upper"), F.lit(0).alias("steps")).distinct()
    reach = up
    for k in range(1, ABOVE + 1):
        up = up.select("lower", F.col("upper").alias("mid")).join(edge.select(F.col("lower").alias("mid"), "upper"), "mid").select("lower", "upper", F.lit(k).alias("steps")).distinct()
        reach = reach.union(up)
    reach = reach.groupBy("lower", "upper").agg(F.min("steps").alias("steps"))
    can = symbols.where("kind = 'Method'").select(F.col("symbol_id").alias("callee_id"), F.col("name").alias("c_name"), F.col("containing_type").alias("c_type"), F.col("display").alias("c_display"), F.size("parameters").alias("c_n"), F.col("required").alias("c_min"), F.col("extends").alias("c_extends"))
    fits = calls.join(can, F.col("name") == F.col("c_name")).join(reach, (F.col("on_type") == F.col("lower")) & (F.col("c_type") == F.col("upper")), "left")
    args = F.size("arg_texts")
    direct = F.col("steps").isNotNull() & args.between(F.col("c_min"), F.col("c_n"))
    extends = F.col("c_extends").isNotNull() & (args + 1).between(F.col("c_min"), F.col("c_n")) & F.coalesce(_simple(F.col("c_extends")) == _simple(F.col("on_type")), F.lit(True))
    unknown = F.col("written").isNull() & args.between(F.col("c_min"), F.col("c_n"))
    fits = fits.withColumn("rank", F.when(direct, F.col("steps")).when(extends, ABOVE + 1).when(unknown, ABOVE + 2)).where("rank IS NOT NULL")
    best = top_per(fits, ["doc_id", "ordinal"], [F.col("rank"), F.col("callee_id")], 1).select("doc_id", "ordinal", "callee_id", "c_display", "c_extends", "c_type")
    calls = calls.join(best, ["doc_id", "ordinal"], "left")
    outside = F.when(F.col("written").isNotNull() & ~F.col("bare"), F.concat(F.lit("M:"), "on_type", F.lit("."), "name"))
    call_edges = calls.withColumn("callee_id", F.coalesce("callee_id", outside)).where("callee_id IS NOT NULL")
    call_edges = call_edges.select(F.col("caller").alias("caller_id"), "callee_id", F.coalesce("c_display", F.concat_ws(".", "on_type", "name")).alias("callee_display"), "ordinal", *span)
    to_methods = calls.where("c_type IS NOT NULL").select(F.col("callee_id").alias("target_id"), "project_id", *span)
    refs = to_types.union(to_methods).distinct()

    # --- invocations: type arguments are bound one by one
    args_of = bind(calls.select("doc_id", "ordinal", "namespace", "usings", F.posexplode("type_args").alias("k", "written")), types)
    bound = args_of.groupBy("doc_id", "ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "t_full"))), lambda x: x["t_full"]).alias("bound"))
    first = bind(calls.where("c_extends IS NOT NULL").select("doc_id", "ordinal", "namespace", "usings", F.col("c_extends").alias("written")), types).select("doc_id", "ordinal", F.col("t_full").alias("reduced_first_param"))
    inv = calls.where("method_name IS NOT NULL").join(bound, ["doc_id", "ordinal"], "left").join(first, ["doc_id", "ordinal"], "left")
    no_names = F.array().cast("array<string>")
    invocations = inv.select(
        "doc_id", "ordinal", "method_name", F.coalesce("bound", no_names).alias("type_args"), "arg_texts", "arg0_value", "raw_call", F.when(~F.col("bare") & F.col("written").isNotNull(), F.col("on_type")).alias("receiver_type"),
        no_names.alias("receiver_interfaces"), "reduced_first_param", F.col("c_type").alias("containing_type"), *span,
    )

    tokens = each.select("symbol_id", *span).union(refs.select(F.col("target_id").alias("symbol_id"), *span)).distinct()
    doc_outline = each.select("file_path", F.col("ordinal").cast("int").alias("ordinal"), "symbol_id")
    columns = [c.split(" ")[0] for c in ("symbol_id", "project_id", "name", "kind", "containing_type", "accessibility", "signature", "display", "xml_doc", *span, "declaring_docs", "locations")]
    failed = rows.where("error IS NOT NULL").select(F.lit(1).cast("long").alias("load_id"), F.lit("Failure").alias("kind"), F.concat_ws(": ", "file_path", "error").alias("message"))
    return {
        "symbols": symbols.select(*columns), "symbol_keys": symbol_keys, "type_edges": type_edges, "member_links": member_links, "refs": refs, "call_edges": call_edges, "tokens": tokens,
        "doc_outline": doc_outline, "invocations": invocations, "load_diagnostics": failed,
    }


def _folders(path: Column) -> Column:
    """All folders above a path, from the longest."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def load(spark: SparkSession, path: str, folder: str | None = None) -> dict[str, DataFrame]:
    """All fact tables of the sources below a path: project files, documents and what their texts give.

    A document belongs to the project in the nearest folder above it; one without a project has none.
    """
    files = sources.read_projects(spark, path)
    name = F.regexp_extract("file_path", r"([^/]*)\.csproj$", 1)
    files = files.withColumn("project_id", name).withColumn("folder", F.regexp_replace("file_path", r"/[^/]*$", ""))
    documents = sources.read_documents(spark, path).where(~F.col("file_path").rlike(r"/(obj|bin)/"))
    near = documents.select("doc_id", F.posexplode(_folders(F.col("file_path"))).alias("depth", "folder")).join(files.select("folder", "project_id"), "folder")
    near = near.groupBy("doc_id").agg(F.min_by("project_id", F.struct("depth", "project_id")).alias("project_id"))
    documents = documents.join(near, "doc_id", "left").select(*[c.split(" ")[0] for c in FACTS["documents"].split(", ")])
    friends = documents.select("project_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[\s*assembly\s*:\s*([^\]]+)\]"), F.lit(1))).alias("a")).groupBy("project_id").agg(F.array_sort(F.collect_set("a")).alias("assembly_attrs"))
    projects = files.join(friends, "project_id", "left").select("project_id", F.col("project_id").alias("name"), "file_path", F.coalesce("assembly_attrs", F.array().cast("array<string>")).alias("assembly_attrs"), F.transform("package_refs", lambda x: x["name"]).alias("metadata_refs"))
    packages = files.select("project_id", F.posexplode("package_refs").alias("ordinal", "x")).select("project_id", "x.name", "x.version", F.col("ordinal").cast("int").alias("ordinal"))
    refs = files.select("project_id", F.explode("project_refs").alias("p")).select("project_id", F.regexp_extract(F.replace("p", F.lit("\\"), F.lit("/")), r"([^/]*)\.csproj$", 1).alias("ref_project_id"))
    bad = files.where("error IS NOT NULL").select(F.lit(1).cast("long").alias("load_id"), F.lit("Warning").alias("kind"), F.concat_ws(": ", "file_path", "error").alias("message"))
    out = facts(documents, folder)
    out["load_diagnostics"] = out["load_diagnostics"].union(bad)
    return {"projects": projects, "project_refs": refs, "package_refs": packages, "documents": documents} | out
