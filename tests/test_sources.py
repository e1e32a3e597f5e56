"""A small solution from text to every operator of the workspace."""

import logging

import pytest

from symlake import sources
from symlake.sources.csharp import Document
from symlake.workspace import Workspace

FILES = {
    "All.sln": 'Project("{1}") = "Lib", "Lib\\Lib.csproj", "{2}"\nEndProject\nProject("{1}") = "Lib.Tests", "Lib.Tests\\Lib.Tests.csproj", "{3}"\nEndProject\n',
    "Lib/Lib.csproj": '<Project><ItemGroup><PackageReference Include="Small.Pack" Version="1.2"/></ItemGroup></Project>',
    "Web/Web.csproj": '<Project><ItemGroup><ProjectReference Include="..\\Lib\\Lib.csproj"/></ItemGroup></Project>',
    "Lib.Tests/Lib.Tests.csproj": '<Project><ItemGroup><ProjectReference Include="..\\Lib\\Lib.csproj"/><PackageReference Include="xunit" Version="2"/></ItemGroup></Project>',
    "Bad/Bad.csproj": "<Project>",
    "Lib/Speakers.cs": """using System;
[assembly: InternalsVisibleTo("Lib.Tests")]
namespace Lib;

public interface ISpeaker { string Say(string words); }

/// <summary>Speaks <b>loudly</b>.</summary>
[Marker]
public class Loud : ISpeaker
{
    public string Say(string words) => Raise(words.Trim());
    private string Raise(string words) { return words; }
    private int Forgotten() => 1;
    public override string ToString() => "loud";
}

public class Quiet : ISpeaker { public string Say(string words) => words; }
public sealed class MarkerAttribute : Attribute { }
internal class Alone { }
public abstract class Shape { public abstract double Area(); }
public class Disc : Shape { public override double Area() => 1.0; }
public partial class Two { public int One() => 1; }
""",
    "Lib/Two.cs": "namespace Lib;\npublic partial class Two { public int Other(ISpeaker speaker) { var loud = new Loud(); return loud.Say(speaker.Say(\"x\")).Length; } }\n",
    "Lib/obj/Made.cs": "namespace Lib { class Made { } }",
    "Web/Program.cs": """using Lib;
using Microsoft.Extensions.Hosting;

var builder = WebApplication.CreateBuilder(args);
builder.Services.AddSingleton<ISpeaker, Loud>();
builder.Services.AddScoped<Two>();
builder.Services.AddHostedService<Mailer>();
builder.Services.AddOwnThings();
var app = builder.Build();
app.UseRouting();
app.MapGet("/health", () => "ok");
app.MapPost("/speak", Speak.Out);
app.Run();

public class Mailer : BackgroundService { }
public class Poller : BackgroundService { }
public class Speak { public Speak(ISpeaker speaker) { } public static string Out() => ""; }
public static class Extensions { public static IServiceCollection AddOwnThings(this IServiceCollection services) => services; }
""",
    "Lib.Tests/LoudTests.cs": "using Lib;\nnamespace Lib.Tests { public class LoudTests { [Fact] public void Says() { var x = new Loud(); x.Say(\"a\"); } } }\n",
}


@pytest.fixture(scope="module")
def solution(tmp_path_factory):
    top = tmp_path_factory.mktemp("solution")
    for name, text in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    return top


@pytest.fixture(scope="module")
def ws(spark, solution, tmp_path_factory):
    return Workspace.from_source(spark, str(solution), str(tmp_path_factory.mktemp("facts")))


def at(ws, name, text, word, nth=0):
    """file_path, line and col of a word in a file of the solution."""
    path = next(r[0] for r in ws.documents.select("file_path").collect() if r[0].endswith(name))
    lines = text.split("\n")
    found = [(i + 1, line.index(word) + 1) for i, line in enumerate(lines) if word in line][nth]
    return {"file_path": path, "line": found[0], "col": found[1]}


def names(result, column="name"):
    assert result.error is None, result.error
    return sorted(r[column] for r in result.df.collect())


def test_symbols_and_outline(ws):
    got = {r["symbol_id"]: r for r in ws.symbols.collect()}
    assert {"T:Lib.ISpeaker", "M:Lib.Loud.Say(System.String)", "M:Lib.Loud.Raise(System.String)", "T:Lib.Two", "M:Speak.#ctor(ISpeaker)"} <= got.keys() and "T:Lib.Made" not in got
    assert len(got["T:Lib.Two"]["locations"]) == 2 and len(got["T:Lib.Two"]["declaring_docs"]) == 2
    assert (got["M:Lib.Loud.Raise(System.String)"]["accessibility"], got["T:Lib.Alone"]["accessibility"], got["M:Lib.ISpeaker.Say(System.String)"]["accessibility"]) == ("Private", "Internal", "Public")
    where = at(ws, "Speakers.cs", FILES["Lib/Speakers.cs"], "class Loud")
    assert names(ws.list_document_symbols(where["file_path"].upper()))[:3] == ["Alone", "Area", "Area"]
    assert ws.list_document_symbols("nowhere.cs").error.code == "FILE_NOT_IN_WORKSPACE"
    assert ws.workspace_symbol("Speak", ["interface"], format="summary").summary == "1 matching symbols"


def test_positions(ws):
    text = FILES["Lib/Speakers.cs"]
    on = at(ws, "Speakers.cs", text, "Loud :")
    hover = ws.hover(**on).df.first()
    assert (hover["symbol_id"], hover["doc"]) == ("T:Lib.Loud", "Speaks loudly.")
    base = at(ws, "Speakers.cs", text, "ISpeaker\n".strip(), 1)
    assert ws.goto_definition(**base, format="summary").summary.endswith("Speakers.cs:5")
    assert ws.hover(on["file_path"], 2, 1).error.code == "SYMBOL_NOT_FOUND"
    assert ws.hover(on["file_path"].lower(), on["line"], on["col"], format="SUMMARY").summary == "Speaks loudly."


def test_relations(ws):
    assert ws.find_references(symbol_id="T:Lib.ISpeaker").df.count() == 5
    assert ws.find_implementations(symbol_id="T:Lib.ISpeaker", format="summary").summary == "2 implementations"
    assert ws.find_implementations(symbol_id="M:Lib.ISpeaker.Say(System.String)").df.count() == 2
    assert names(ws.find_derived_types(symbol_id="T:Lib.Shape")) == ["Disc"]
    callers = {r["caller_id"] for r in ws.find_callers(symbol_id="M:Lib.Loud.Say(System.String)").df.collect()}
    assert callers == {"M:Lib.Two.Other(ISpeaker)", "M:Lib.Tests.LoudTests.Says"}
    assert {r["callee_display"] for r in ws.find_callees(symbol_id="M:Lib.Loud.Say(System.String)").df.collect()} == {"Lib.Loud.Raise", "System.String.Trim"}
    assert ws.find_callees(symbol_id="T:Lib.Loud").error.code == "SYMBOL_NOT_FOUND"
    assert ws.find_callers(symbol_id="M:Lib.Loud.Raise(System.String)", transitive=True).df.count() == 3


def test_semantic_search(ws):
    search = lambda p: names(ws.semantic_search(p))
    assert search("has-attribute:Lib.MarkerAttribute") == ["Loud"]
    assert search("returns:double") == search("returns:System.Double") == ["Area", "Area"]
    assert search("parameter-type:Lib.ISpeaker") == [".ctor", "Other"]
    assert search("implements:Lib.ISpeaker") == ["Loud", "Quiet"] and search("derives-from:Lib.Shape") == ["Disc"]
    assert ws.semantic_search("derives-from:No.Such").error.code == "SYMBOL_NOT_FOUND"


def test_entry_points_and_registrations(ws):
    assert ws.find_entrypoints(format="summary").summary == "2 routes, 1 middleware, 2 hosted services"
    got = {r["section"]: r for r in ws.find_entrypoints(max_per_section=1).df.collect()}
    assert got["routes"]["count"] == 2 and got["routes"]["truncated"] and '"verb":"GET"' in got["routes"]["items"][0] and not got["middleware"]["truncated"]
    out = ws.find_registrations()
    rows = [r for r in out.df.collect() if r["raw_call"]]
    services = {r["service"]: (r["lifetime"], [c["containing_type"] for c in r["consumers"]]) for r in rows if r["section"] == "registrations"}
    assert services == {"Lib.ISpeaker": ("Singleton", ["Lib.Two", "Speak"]), "Lib.Two": ("Scoped", [])}
    assert any("AddOwnThings" in r["raw_call"] for r in rows if r["section"] == "unclassified")
    assert ws.find_registrations("speaker", format="summary").summary == "1 DI registrations (1 Singleton)"


def test_reports(ws):
    assert ws.analyze_symbol(symbol_id="T:Lib.ISpeaker", format="summary").summary == "ISpeaker: refs=5 impls=2 derived=0 callers=0"
    sections = [r["section"] for r in ws.analyze_symbol(symbol_id="M:Lib.Loud.Say(System.String)").df.collect()]
    assert sections == ["hover", "references", "callers"]
    tests = [(r["test_symbol"], r["confidence"]) for r in ws.test_map(symbol_id="T:Lib.Loud").df.collect()]
    assert tests == [("Lib.Tests.LoudTests", "high"), ("LoudTests", "medium")]
    dead = {r["symbol_id"]: r["confidence"] for r in ws.find_dead_code_candidates().df.collect()}
    assert dead == {"M:Lib.Loud.Forgotten": "high", "T:Lib.Alone": "medium"}
    assert ws.find_dead_code_candidates(include_internal=False, format="summary").summary == "1 candidates (1 high, 0 medium)"
    projects = {r["name"]: r for r in ws.project_overview().df.collect()}
    assert projects["Lib"]["documents"] == 2 and projects["Web"]["project_refs"] == ["Lib"] and projects["Lib"]["package_refs"][0]["name"] == "Small.Pack"
    assert [r["kind"] for r in ws.load_diagnostics.collect()] == ["Warning"]


def test_rename(ws, solution):
    on = at(ws, "Speakers.cs", FILES["Lib/Speakers.cs"], "Loud :")
    assert ws.rename_symbol(**on, new_name="Noisy", format="summary").summary == "preview: 4 occurrences"
    new = {r["file_path"].rpartition("/")[2]: r for r in ws.rename_symbol(**on, new_name="Noisy").df.collect()}
    assert new.keys() == {"Speakers.cs", "Two.cs", "Program.cs", "LoudTests.cs"} and "class Noisy : ISpeaker" in new["Speakers.cs"]["new_text"] and "LoudTests { [Fact]" in new["LoudTests.cs"]["new_text"]
    assert (solution / "Lib/Speakers.cs").read_text() == FILES["Lib/Speakers.cs"]


def test_refresh_and_reload(spark, ws):
    other = Workspace(dict(ws.tables), 1)
    other.path = ws.path
    two = next(r for r in ws.documents.collect() if r["file_path"].endswith("Two.cs"))
    from symlake.operators import semantic
    from symlake.sources import extract

    dirty = spark.createDataFrame([(two["doc_id"],)], "doc_id string")
    again = semantic.reextract(ws.symbols, dirty)
    text = "namespace Lib;\n[Marker] public partial class Two { public int Third() => 3; }\n"
    docs = ws.documents.join(again, "doc_id", "left_semi").collect()
    docs = spark.createDataFrame([(r["doc_id"], r["project_id"], r["file_path"], text if r["doc_id"] == two["doc_id"] else r["text"]) for r in docs], "doc_id string, project_id string, file_path string, text string")
    fresh = extract.facts(docs)
    other.refresh(again, fresh.pop("symbols"), **fresh)
    assert names(other.semantic_search("has-attribute:Lib.MarkerAttribute")) == ["Loud", "Two"]
    assert names(other.workspace_symbol("Other")) == [] and names(other.workspace_symbol("Third")) == ["Third"]
    assert {r["caller_id"] for r in other.find_callers(symbol_id="M:Lib.Loud.Say(System.String)").df.collect()} == {"M:Lib.Tests.LoudTests.Says"}
    out = other.reload()
    assert out.summary == "reloaded 3 projects" or out.summary == "reloaded 4 projects"
    assert names(other.workspace_symbol("Third")) == [] and out.df.first()["load_id"] == 2


def test_stream_of_changes(spark, ws, tmp_path):
    from pyspark.sql import functions as F

    from symlake import streaming

    other = Workspace(dict(ws.tables), 1)
    doc = next(r for r in ws.documents.collect() if r["file_path"].endswith("Two.cs"))
    schema = spark.createDataFrame([], streaming.CHANGE).schema
    row = lambda name, when: (doc["doc_id"], when, [{"symbol_id": f"T:Lib.{name}", "name": name, "kind": "Class", "declaring_docs": [doc["doc_id"]]}], *[[] for _ in streaming.CARRIED[1:]])
    import datetime

    rows = [row("Older", datetime.datetime(2024, 1, 1)), row("Newer", datetime.datetime(2024, 1, 2))]
    spark.createDataFrame(rows, schema).withColumn("doc_id", F.col("doc_id")).write.parquet(f"{tmp_path}/in/0")
    streaming.keep_fresh(streaming.change_feed(spark, f"{tmp_path}/in/*"), other, f"{tmp_path}/state").awaitTermination(120)
    assert names(other.workspace_symbol("Newer")) == ["Newer"] and names(other.workspace_symbol("Older")) == [] and names(other.workspace_symbol("Two")) == []


def test_warm_up(spark, ws, tmp_path):
    other = Workspace(dict(ws.tables), 1)
    other.tables["refs"] = ws.refs.withColumn("line", ws.refs["line"] * 1)
    other.warm(str(tmp_path))
    assert other.find_references(symbol_id="T:Lib.ISpeaker").df.count() == 5 and other.load_diagnostics.count() == 1


def test_solutions_and_log(solution, tmp_path):
    found = sources.find_solution(str(solution / "Lib"))
    assert found == str(solution / "All.sln") and [p.rpartition("/")[2] for p in sources.read_solution(found)] == ["Lib.csproj", "Lib.Tests.csproj"]
    assert sources.find_solution("/") is None
    log = sources.log_to(str(tmp_path / "x" / "log.txt"), "symlake.test")
    log.info("read %d files", 3)
    log.removeHandler(log.handlers[0])
    assert (tmp_path / "x" / "log.txt").read_text().endswith("+00:00 INFO symlake.test - read 3 files\n") and log.level == logging.INFO


def test_reader_survives_broken_text():
    for text in ("class A { void B( { ", "}}}", "class", "namespace X { class Y<T { } ", "public int", "[", "var x = ; foo(", 'class A { string s = "open; }'):
        Document(text)
    d = Document("class A<T> where T : new() { int? x; (int, string) Pair() => (1, f<int>(2)); ~A() { } public static A<T> operator +(A<T> a, A<T> b) => a; void G() { a?.B(); if (x is null) C(); } }")
    assert [(x.name, x.kind) for x in d.declared] == [("A", "Class"), ("x", "Field"), ("Pair", "Method"), ("Finalize", "Method"), ("op_+", "Method"), ("G", "Method")]
    assert [(c["name"], c["method_name"], c["type_args"]) for c in d.calls] == [("f", "f", ["int"]), ("B", None, []), ("C", "C", [])]
