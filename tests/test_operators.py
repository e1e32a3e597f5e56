import random

import pytest

from symlake.operators import diagnostics, graph, invocations, lookup, relations, rename, reports, semantic
from symlake.result import OpError
from symlake.schema import FACTS
from symlake.sources import parse_project, solution_projects
from symlake.workspace import Workspace

GREETERS = [("T:IGreeter", "IGreeter", "Interface"), ("T:EnglishGreeter", "EnglishGreeter", "Class"), ("T:DutchGreeter", "DutchGreeter", "Class"), ("T:Other", "Other", "Class")]


@pytest.mark.parametrize("seed", range(3))
def test_closure_agrees_with_breadth_first_search(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(18)]
    depth, queue = {0: 0}, [0]
    for x in queue:
        for a, b in edges:
            if a == x and b not in depth:
                depth[b] = depth[x] + 1
                queue.append(b)
    got = graph.closure(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(0,)], "id int")).collect()
    assert {r["id"]: r["depth"] for r in got} == depth and len(got) == len(depth)


def test_references_are_unique_and_cascade(spark):
    refs = spark.createDataFrame([("a", "f", 1, 1, 1, 2), ("a", "f", 1, 1, 1, 2), ("b", "g", 2, 1, 2, 2), ("a", None, 0, 0, 0, 0)], "target_id string, file_path string, line int, col int, end_line int, end_col int")
    assert lookup.find_references(refs, "a").count() == 1
    assert lookup.find_references(refs, "none").count() == 0
    links = spark.createDataFrame([("b", "a", "implements")], "member_id string, linked_id string, kind string")
    assert lookup.find_references(refs, "a", links).count() == 2


def test_search_finds_all_greeters(spark):
    s = spark.createDataFrame(GREETERS, "symbol_id string, name string, kind string")
    assert {r["name"] for r in lookup.workspace_symbol(s, "Greeter").collect()} == {"IGreeter", "EnglishGreeter", "DutchGreeter"}
    assert [r["name"] for r in lookup.workspace_symbol(s, "EG", ["class"]).collect()] == ["EnglishGreeter"]
    assert lookup.workspace_symbol(s, "Greeter", max_results=1).count() == 1


def test_minimum_severity_holds_with_an_exact_one(spark):
    d = spark.createDataFrame([("p", "Info", "C1", "a/obj/x"), ("p", "Error", "C2", "b")], "project_id string, severity string, code string, file_path string")
    assert diagnostics.compilation_errors(d, severity="Info").count() == 0
    assert diagnostics.compilation_errors(d, minimum="nonsense").count() == 2
    assert diagnostics.compilation_errors(d, severity="nonsense", minimum="Hidden", include_generated=False).count() == 1


def test_overlay_drops_stale_rows_and_base_wins(spark):
    ddl = "symbol_id string, declaring_docs array<string>, v int"
    base = spark.createDataFrame([("a", ["1"], 0), ("b", ["2", "3"], 0), ("c", None, 0)], ddl)
    fresh = spark.createDataFrame([("b", ["2"], 1), ("a", ["1"], 1), ("d", ["2"], 1)], ddl)
    dirty = spark.createDataFrame([("2",)], "doc_id string")
    assert sorted((r["symbol_id"], r["v"]) for r in semantic.overlay(base, fresh, dirty).collect()) == [("a", 0), ("b", 1), ("c", 0), ("d", 1)]
    assert {r[0] for r in semantic.reextract(base, dirty).collect()} == {"2", "3"}


def test_patterns():
    assert semantic.split_pattern("has-attribute:A:B") == ("has-attribute", "A:B")
    for bad in ("x", ":x", "what:x"):
        with pytest.raises(OpError):
            semantic.split_pattern(bad)


def test_classification_is_ordered(spark):
    ddl = "method_name string, type_args array<string>, arg_texts array<string>, arg0_value string, receiver_type string, receiver_interfaces array<string>, reduced_first_param string, containing_type string"
    c = invocations.COLLECTION
    rows = [("MapMethods", [], ["a", "b"], "/x", None, None, None, None), ("UseAuth", [], [], None, invocations.APPLICATION, None, None, None), ("UseAuth", [], [], None, None, None, c, None),
            ("AddHostedService", ["A", "B"], [], None, c, None, None, None), ("AddScoped", ["I", "T"], [], None, None, [c], None, None), ("AddScoped", ["I"], [], None, None, None, None, None), ("TryAddX", [], [], None, c, None, None, None)]
    got = invocations.classify(spark.createDataFrame(rows, ddl)).collect()
    assert [r["bucket"] for r in got] == ["route", "middleware", "unclassified", None, "di", None, "unclassified"]
    assert (got[0]["verb"], got[0]["handler"], got[4]["lifetime"], got[4]["service"]) == ("ANY", "b", "Scoped", "I")


def test_callees_take_the_first_site(spark):
    e = spark.createDataFrame([("m", "x", "x", "f", 2), ("m", "x", "x", "f", 1), ("m", "y", "y", "f", 3)], "caller_id string, callee_id string, callee_display string, file_path string, ordinal int")
    assert [(r["callee_id"], r["ordinal"]) for r in relations.find_callees(e, "m").collect()] == [("x", 1), ("y", 3)]
    assert relations.find_callees(e, "m", 1).count() == 1


def test_dead_code_counts_all_rows(spark):
    s = spark.createDataFrame([("a", "f", "Public", "A"), ("b", "f", "Internal", "B"), ("c", "f", "Private", "Dispose"), ("d", None, "Private", "D"), ("e", "f", "Private", "E")], "symbol_id string, file_path string, accessibility string, name string")
    status = reports.dead_code_status(s)
    refs = spark.createDataFrame([("e",)], "target_id string")
    from pyspark.sql import functions as F

    assert [(r["symbol_id"], r["confidence"]) for r in reports.dead_code_candidates(status, refs, F.lit(True)).collect()] == [("b", "medium")]
    assert tuple(reports.dead_code_skipped(status).first()) == (1, 0, 1)


def test_rename_touches_whole_words_only(spark):
    d = spark.createDataFrame([("1", "the then the_x the the"), ("2", "other")], "doc_id string, text string")
    assert [tuple(r) for r in rename.rename_preview(d, "the", "a$1").collect()] == [("1", 3, "a$1 then the_x a$1 a$1")]
    assert list(rename.spans_of("x\nthe the", "the")) == [(2, 1, 2, 4), (2, 5, 2, 8)]


def test_project_files():
    assert parse_project('<Project><ItemGroup><PackageReference Include="A" Version="1"/><PackageReference Include="B"><Version>2</Version></PackageReference><PackageReference Include=" "/></ItemGroup></Project>')[0] == [("A", "1"), ("B", "2")]
    assert parse_project("<Project>")[2]
    assert solution_projects('Project("{X}") = "A", "a\\A.csproj", "{Y}"') == ["a/A.csproj"]


def test_workspace_envelope(spark):
    symbols = spark.createDataFrame([{"symbol_id": "T:A", "name": "A", "kind": "Class", "display": "A"}], FACTS["symbols"])
    ws = Workspace.from_tables(spark, symbols=symbols)
    assert ws.find_references(symbol_id="T:A", format="SUMMARY").summary == "0 references in 0 files"
    assert ws.find_references(symbol_id="T:B").error.code == "SYMBOL_NOT_FOUND"
    assert ws.find_references().error.code == "POSITION_INVALID"
    assert ws.semantic_search("bad").error.code == "INVALID_PATTERN"
    assert ws.find_derived_types(symbol_id="T:A", format="summary").summary == "0 derived types"
    with pytest.raises(OpError):
        _ = Workspace().symbols


def test_overlay_merge_keeps_parts_of_clean_suppliers(spark, tmp_path):
    from symlake.plans import bindings

    # supplier 1 is dirty; part 10 lies in both, 11 and 12 only in 1, 13 only in 2, 14 in both (above and below the cut)
    lines = [(10, 1, 5), (10, 2, 5), (11, 1, 5), (12, 1, 20), (13, 2, 5), (14, 1, 20), (14, 2, 5)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_quantity long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 20), (2, 3)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(map(tuple, bindings.overlay_merge(spark, str(tmp_path)).collect()))
    assert got == [(10, "fresh"), (12, "fresh"), (13, "base"), (14, "fresh")]


def test_dead_code_denies_the_reference_names_and_attributes(spark):
    rows = [("a", "Equals"), ("b", "Main"), ("c", "Works"), ("d", "Native"), ("e", "Odd"), ("f", "Plain")]
    s = spark.createDataFrame([(i, "A.cs", "Private", n) for i, n in rows], "symbol_id string, file_path string, accessibility string, name string")
    keys = [("attribute", "Xunit.FactAttribute", "c"), ("attribute", "System.Runtime.InteropServices.DllImportAttribute", "d"), ("attribute", "FactAttribute", "c"), ("attribute", "My.NotAFactAttribute", "e"), ("returns", "Xunit.FactAttribute", "f")]
    status = reports.dead_code_status(s, symbol_keys=spark.createDataFrame(keys, "index_kind string, key string, symbol_id string"))
    assert status.columns == [*s.columns, "status"]
    assert {r["symbol_id"]: r["status"] for r in status.collect()} == {"a": "deny", "b": "eligible", "c": "deny", "d": "deny", "e": "eligible", "f": "eligible"}
    assert reports.dead_code_skipped(status).first()["denylisted"] == 3


def test_diagnostics_without_code_or_path_stay(spark):
    rows = [("p", "Error", None, "A.cs"), ("p", "Error", "C1", "A.cs"), ("p", "Error", "C2", None), ("p", "Error", "C3", "Form.G.cs"), ("p", "Error", "C4", "a\\obj\\x.cs")]
    d = spark.createDataFrame(rows, "project_id string, severity string, code string, file_path string")
    assert sorted(r["code"] or "" for r in diagnostics.compilation_errors(d, exclude_codes=["c1"]).collect()) == ["", "C2", "C3", "C4"]
    assert sorted(r["code"] or "" for r in diagnostics.compilation_errors(d, include_generated=False).collect()) == ["", "C1", "C2"]
