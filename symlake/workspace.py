"""A workspace: one published snapshot of fact tables, with every operator behind one envelope, refresh and reload."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.operators import analysis, diagnostics, invocations, lookup, relations, rename, reports, semantic
from symlake.result import FILE_NOT_IN_WORKSPACE, INTERNAL_ERROR, POSITION_INVALID, SYMBOL_NOT_FOUND, WORKSPACE_NOT_LOADED, OpError, OpResult
from symlake.schema import FACTS

TYPES = ("Class", "Interface", "Struct", "Enum", "Record")
#: The column of each fact table that names the document a row comes from.
DOCUMENT = {
    "refs": "file_path", "call_edges": "file_path", "tokens": "file_path", "doc_outline": "file_path", "invocations": "doc_id", "diagnostics": "file_path",
}
#: The column of each fact table that names the symbol whose declaration a row comes from.
DECLARED = {"symbol_keys": "symbol_id", "type_edges": "child_id", "member_links": "member_id"}


class Workspace:
    def __init__(self, tables: dict[str, DataFrame] | None = None, load_id: int = 0):
        self.tables, self.load_id, self.path = tables or {}, load_id, None

    @classmethod
    def from_tables(cls, spark: SparkSession, **tables: DataFrame) -> Workspace:
        """Tables not given are empty; columns are checked against the schema."""
        full = {}
        for name, ddl in FACTS.items():
            empty = spark.createDataFrame([], ddl)
            if name in tables:
                missing = set(empty.columns) - set(tables[name].columns)
                if missing:
                    raise ValueError(f"{name} lacks {sorted(missing)}")
            full[name] = tables.get(name, empty)
        return cls(full, 1)

    @classmethod
    def from_path(cls, spark: SparkSession, path: str) -> Workspace:
        out = cls.from_tables(spark, **_read(spark, path))
        out.path = path
        return out

    @classmethod
    def from_source(cls, spark: SparkSession, path: str, facts: str) -> Workspace:
        """Read the C# sources below path and write their facts below ``facts``, from where the workspace reads."""
        from symlake.sources import extract

        for name, df in extract.load(spark, path, facts).items():
            df.write.mode("overwrite").parquet(f"{facts}/{name}.parquet")
        return cls.from_path(spark, facts)

    def __getattr__(self, name: str) -> DataFrame:
        if name in FACTS:
            if not self.tables:
                raise OpError(WORKSPACE_NOT_LOADED, "Workspace not loaded.")
            return self.tables[name]
        raise AttributeError(name)

    # --- life of a snapshot ----------------------------------------------------------------------

    def warm(self, path: str) -> None:
        """Write all tables below path, sorted by what they are looked up by, and go on with the written ones.

        Each table is written on its own; one that fails stays as it was and leaves a load diagnostic.
        """
        by = {"refs": "target_id", "symbols": "symbol_id", "symbol_keys": "key", "call_edges": "callee_id", "tokens": "file_path", "doc_outline": "file_path", "diagnostics": "file_path", "type_edges": "parent_id"}
        spark, done, failed = self.symbols.sparkSession, {}, []
        for name, df in self.tables.items():
            try:
                (df.sortWithinPartitions(by[name]) if name in by else df).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
                done[name] = spark.read.schema(df.schema).parquet(f"{path}/{name}.parquet")
            except Exception as e:  # noqa: BLE001  isolated, as the others are of use without it
                failed.append((self.load_id, "Failure", f"{name}: {e}"))
        self.tables = self.tables | done
        if failed:
            self.tables["load_diagnostics"] = self.load_diagnostics.unionByName(spark.createDataFrame(failed, FACTS["load_diagnostics"]))

    def reload(self, path: str | None = None, **tables: DataFrame) -> OpResult:
        """Publish a new snapshot at once, of the path it was loaded from if nothing is given; what was read from the old one stays valid."""

        def run() -> DataFrame:
            began = time.perf_counter()
            spark = self.symbols.sparkSession
            source = path or self.path
            fresh = Workspace.from_tables(spark, **(tables or (_read(spark, source) if source else {})))
            n = fresh.projects.count()
            self.tables, self.load_id, self.path = fresh.tables, self.load_id + 1, source
            problems = self.load_diagnostics.orderBy("kind", "message").limit(100).agg(F.collect_list(F.concat_ws(": ", "kind", "message")).alias("diagnostics"))
            took = F.lit(round((time.perf_counter() - began) * 1000))
            return problems.select(F.lit(self.load_id).alias("load_id"), F.lit(n).alias("projects"), took.alias("duration_ms"), "diagnostics")

        out = self.call(run)
        return out if out.error else OpResult(df=out.df, summary=f"reloaded {out.df.first()['projects']} projects")

    def refresh(self, dirty: DataFrame, fresh_symbols: DataFrame, **fresh: DataFrame) -> None:
        """Overlay what was extracted again from changed documents (dirty: doc_id) and those that co-declare with them.

        fresh: other fact tables of those documents; rows of dirty documents, or of symbols that they declare, go
        from every table, whether or not fresh rows come in their place.
        """
        spark = self.symbols.sparkSession
        stale = semantic.stale_symbols(self.symbols, dirty)
        paths = self.documents.join(dirty, "doc_id", "left_semi").select(F.col("file_path").alias("doc_id"))
        paths = paths.union(dirty.select("doc_id")).distinct()
        tables = dict(self.tables)
        for name, ddl in FACTS.items():
            rows = fresh.get(name, spark.createDataFrame([], ddl))
            if name in DOCUMENT:
                tables[name] = semantic.rewalk(tables[name], rows, paths, DOCUMENT[name])
            elif name in DECLARED:
                gone = stale.select(F.col("symbol_id").alias("doc_id"))
                tables[name] = semantic.rewalk(tables[name], rows, gone, DECLARED[name]).distinct()
            elif name == "documents" and name in fresh:
                tables[name] = semantic.rewalk(tables[name], rows, dirty, "doc_id")
        tables["symbols"] = semantic.overlay(self.symbols, fresh_symbols, dirty)
        self.tables = tables

    # --- selectors and envelope ------------------------------------------------------------------

    def document(self, file_path: str, hint: str | None = None) -> str:
        """The path of a document as the tables spell it."""
        found = self.documents.where(lookup.in_file(F.col("file_path"), file_path)).orderBy("file_path").select("file_path").first()
        if found is None:
            raise OpError(FILE_NOT_IN_WORKSPACE, f"File not in workspace: {file_path}", hint)
        return found[0]

    def resolve(self, symbol_id: str | None = None, file_path: str | None = None, line: int | None = None, col: int | None = None) -> str:
        """A symbol id from itself, which wins, or from a position."""
        if symbol_id and symbol_id.strip():
            if not self.symbols.where(F.col("symbol_id") == symbol_id).take(1):
                raise OpError(SYMBOL_NOT_FOUND, f"Symbol ID '{symbol_id}' did not resolve.")
            return symbol_id
        if file_path is None or line is None or col is None:
            raise OpError(POSITION_INVALID, "Must provide either symbolId OR (filePath, line, column).")
        self.document(file_path)
        hit = lookup.symbol_at(self.tokens, file_path, line, col).take(1)
        if not hit:
            raise OpError(SYMBOL_NOT_FOUND, f"No symbol at {file_path}:{line}:{col}")
        return hit[0][0]

    def call(self, run: Callable[[], DataFrame], format: str = "structured", text: Callable[[DataFrame], str] | None = None) -> OpResult:
        """Run an operator inside the envelope; text makes the summary line of its rows."""
        try:
            df = run()
            return OpResult(summary=text(df)) if format.lower() == "summary" and text else OpResult(df=df)
        except OpError as e:
            return OpResult(error=e)
        except Exception as e:  # noqa: BLE001  the envelope's contract
            return OpResult(error=OpError(INTERNAL_ERROR, str(e)))

    def _symbol(self, symbol_id: str):
        return self.symbols.where(F.col("symbol_id") == symbol_id).first()

    # --- operators -------------------------------------------------------------------------------

    def find_references(self, format: str = "structured", **selector) -> OpResult:
        def text(df: DataFrame) -> str:
            r = df.agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("m")).first()
            return f"{r['n']} references in {r['m']} files"

        return self.call(lambda: lookup.find_references(self.refs, self.resolve(**selector), self.member_links), format, text)

    def goto_definition(self, file_path: str, line: int, col: int, format: str = "structured") -> OpResult:
        def run() -> DataFrame:
            self.document(file_path, "Reload the workspace if the file is new.")
            self.resolve(None, file_path, line, col)
            return lookup.goto_definition(self.tokens, self.symbols, file_path, line, col)

        def text(df: DataFrame) -> str:
            r = df.orderBy("file_path", "line", "col").first()
            return f"definition at {r['file_path']}:{r['line']}" if r else "no definition found"

        return self.call(run, format, text)

    def hover(self, file_path: str, line: int, col: int, format: str = "structured") -> OpResult:
        def run() -> DataFrame:
            return lookup.describe(self.symbols.where(F.col("symbol_id") == self.resolve(None, file_path, line, col)))

        def text(df: DataFrame) -> str:
            r = df.first()
            return r["doc"] or r["signature"] or ""

        return self.call(run, format, text)

    def find_implementations(self, format: str = "structured", **selector) -> OpResult:
        def run() -> DataFrame:
            return relations.implementation_sites(relations.find_implementations(self.type_edges, self.symbols, self.resolve(**selector), member_links=self.member_links))

        return self.call(run, format, lambda df: f"{df.count()} implementations")

    def find_derived_types(self, transitive: bool = False, format: str = "structured", **selector) -> OpResult:
        def run() -> DataFrame:
            node = self.resolve(**selector)
            kind = self._symbol(node)["kind"]
            if kind not in TYPES:
                raise OpError(SYMBOL_NOT_FOUND, "Symbol is not a named type.")
            kinds = ["derives_interface"] if kind == "Interface" else ["derives"]
            below = relations.derived_types(self.type_edges, node, transitive, kinds)
            return self.symbols.join(below, self.symbols["symbol_id"] == below["id"]).drop("id")

        return self.call(run, format, lambda df: f"{df.count()} derived types")

    def list_document_symbols(self, file_path: str, format: str = "structured") -> OpResult:
        def run() -> DataFrame:
            return lookup.document_outline(self.doc_outline, self.symbols, self.document(file_path, "Reload the workspace if the file is new."))

        return self.call(run, format, lambda df: f"{df.count()} symbols in document")

    def find_callers(self, transitive: bool = False, format: str = "structured", **selector) -> OpResult:
        return self.call(lambda: relations.find_callers(self.call_edges, self.resolve(**selector), None if transitive else 1), format, lambda df: f"{df.count()} caller sites")

    def find_callees(self, max_results: int = 50, format: str = "structured", **selector) -> OpResult:
        def run() -> DataFrame:
            me = self._symbol(self.resolve(**selector))
            if me["kind"] not in ("Method", "Constructor"):
                raise OpError(SYMBOL_NOT_FOUND, f"Symbol '{me['display']}' is a {me['kind']}, not a method.", "Give the id or a position of a method.")
            return relations.find_callees(self.call_edges, me["symbol_id"], max_results)

        return self.call(run, format, lambda df: f"{df.count()} callees")

    def workspace_symbol(self, query: str, kinds: Sequence[str] | None = None, max_results: int = 100, format: str = "structured") -> OpResult:
        return self.call(lambda: lookup.workspace_symbol(self.symbols, query, kinds, max_results), format, lambda df: f"{df.count()} matching symbols")

    def semantic_search(self, pattern: str, format: str = "structured") -> OpResult:
        def run() -> DataFrame:
            kind, target = semantic.split_pattern(pattern)
            if kind in semantic.KINDS:
                return semantic.key_search(self.symbol_keys, self.symbols, semantic.KINDS[kind], target)
            hit = self.symbols.where((F.col("display") == target) | (F.col("symbol_id") == f"T:{target}")).orderBy("project_id", "symbol_id").select("symbol_id").first()
            if hit is None:
                raise OpError(SYMBOL_NOT_FOUND, f"Target type not found: {target}")
            kinds = ["derives"] if kind == "derives-from" else None
            below = relations.derived_types(self.type_edges, hit[0], True, kinds).select(F.col("id").alias("symbol_id"))
            return self.symbols.join(below, "symbol_id", "left_semi").dropDuplicates(["symbol_id"])

        return self.call(run, format, lambda df: f"{df.count()} matches")

    def get_compilation_errors(self, format: str = "structured", **filters) -> OpResult:
        return self.call(lambda: diagnostics.compilation_errors(self.diagnostics, **filters), format, _severities)

    def get_document_diagnostics(self, file_path: str, format: str = "structured", **filters) -> OpResult:
        return self.call(lambda: diagnostics.compilation_errors(self.diagnostics, file_path=self.document(file_path), **filters), format, _severities)

    def rename_symbol(self, file_path: str, line: int, col: int, new_name: str, apply_edits: bool = False, format: str = "structured") -> OpResult:
        """file_path, edits and new_text of every document that changes; files are written only with apply_edits."""

        def run() -> DataFrame:
            node = self.resolve(None, file_path, line, col)
            spans = rename.symbol_spans(self.symbols, self.refs, lookup.cascade(self.member_links, node))
            out = rename.rename_symbol(self.documents, spans, self._symbol(node)["name"], new_name)
            if apply_edits:
                rename.write_files(out)
            return out

        def text(df: DataFrame) -> str:
            n = df.agg(F.coalesce(F.sum(F.size("edits")), F.lit(0))).first()[0]
            return f"{'renamed' if apply_edits else 'preview:'} {n} occurrences"

        return self.call(run, format, text)

    def project_overview(self, max_projects: int = 25, max_packages: int = 8, max_refs: int = 8, format: str = "structured") -> OpResult:
        """Load diagnostics are a table of their own, ``load_diagnostics``."""
        return self.call(lambda: analysis.project_overview(self.projects, self.documents, self.project_refs, self.package_refs, max_projects, max_packages, max_refs), format, lambda df: f"{df.count()} projects")

    def _subclasses(self, base: str = "T:Microsoft.Extensions.Hosting.BackgroundService") -> DataFrame:
        """type (display) of what derives from the background service, directly or not."""
        below = relations.derived_types(self.type_edges, base, True, ["derives"]).select(F.col("id").alias("symbol_id"))
        return self.symbols.join(below, "symbol_id", "left_semi").select(F.col("display").alias("type"))

    def find_entrypoints(self, include: Sequence[str] = ("routes", "middleware", "hostedServices"), max_per_section: int = 20, format: str = "structured") -> OpResult:
        def text(df: DataFrame) -> str:
            n = {r["section"]: len(r["items"]) for r in df.collect()}  # a row for each section
            return f"{n.get('routes', 0)} routes, {n.get('middleware', 0)} middleware, {n.get('hostedServices', 0)} hosted services"

        return self.call(lambda: analysis.find_entrypoints(invocations.classify(self.invocations), self._subclasses(), include, max_per_section), format, text)

    def find_registrations(self, query: str | None = None, include_consumers: bool = True, max_results: int = 20, format: str = "structured") -> OpResult:
        def run() -> DataFrame:
            taken = self.symbol_keys.where("index_kind = 'parameter'").join(self.symbols.select("symbol_id", "containing_type", "file_path", "line"), "symbol_id")
            asked = query if query and query.strip() else None
            return analysis.registrations(invocations.classify(self.invocations), taken if include_consumers else None, asked, max_results)

        def text(df: DataFrame) -> str:
            listed = df.where("section = 'registrations' AND raw_call IS NOT NULL")
            return f"{listed.count()} DI registrations ({analysis.lifetimes(listed).first()['text']})"

        return self.call(run, format, text)

    def analyze_symbol(self, include: Sequence[str] = ("hover", "references", "implementations", "derived", "callers"), max_per_section: int = 20, format: str = "structured", **selector) -> OpResult:
        name = []

        def run() -> DataFrame:
            me = self._symbol(self.resolve(**selector))
            name.append(me["name"])
            return analysis.analyze_symbol(self.symbols, self.refs, self.type_edges, self.call_edges, me["symbol_id"], self.member_links, me["kind"] in TYPES, me["kind"] == "Interface", include, max_per_section)

        def text(df: DataFrame) -> str:
            n = {r["section"]: r["count"] for r in df.select("section", "count").collect()}
            return f"{name[0]}: refs={n.get('references', 0)} impls={n.get('implementations', 0)} derived={n.get('derived', 0)} callers={n.get('callers', 0)}"

        return self.call(run, format, text)

    def test_map(self, max_results: int = 10, format: str = "structured", **selector) -> OpResult:
        return self.call(lambda: analysis.test_map(self.projects, self.project_refs, self.symbols, self.refs, self.resolve(**selector), max_results), format, lambda df: f"{df.count()} candidate tests")

    def find_dead_code_candidates(
        self, include_private: bool = True, include_internal: bool = True, include_tests: bool = False, max_results: int = 20, exclude_paths: Sequence[str] = (), format: str = "structured"
    ) -> OpResult:
        """The skipped counters are ``reports.dead_code_skipped`` of the same status."""

        def run() -> DataFrame:
            tests = self.projects.where(reports.is_test_project(F.col("name"), F.col("metadata_refs"))).select("project_id")
            friends = self.projects.select("project_id", F.exists(F.coalesce("assembly_attrs", F.array().cast("array<string>")), lambda a: a.contains("InternalsVisibleTo")).alias("friends"))
            status = reports.dead_code_status(self.symbols, tests, None, exclude_paths, include_private, include_internal, include_tests, self.symbol_keys)
            status = status.join(friends, "project_id", "left")
            return reports.dead_code_candidates(status, self.refs, F.coalesce("friends", F.lit(False)), max_results).drop("friends")

        def text(df: DataFrame) -> str:
            r = df.agg(F.count_if(F.col("confidence") == "high").alias("h"), F.count_if(F.col("confidence") == "medium").alias("m")).first()
            return f"{r['h'] + r['m']} candidates ({r['h']} high, {r['m']} medium)"

        return self.call(run, format, text)


def _read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The fact tables below a path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{path}/{n}") for n in names if n.removesuffix(".parquet") in FACTS}


def _severities(df: DataFrame) -> str:
    r = diagnostics.severity_summary(df).first()
    return f"{r['errors']} errors, {r['warnings']} warnings"
