"""The fact tables: column names and types in DDL."""

SPAN = "file_path STRING, line INT, col INT, end_line INT, end_col INT"
FACTS = {
    "projects": "project_id STRING, name STRING, file_path STRING, assembly_attrs ARRAY<STRING>, metadata_refs ARRAY<STRING>",
    "project_refs": "project_id STRING, ref_project_id STRING",
    "package_refs": "project_id STRING, name STRING, version STRING, ordinal INT",
    "documents": "doc_id STRING, project_id STRING, file_path STRING, text STRING, mtime TIMESTAMP",
    "symbols": "symbol_id STRING, project_id STRING, name STRING, kind STRING, containing_type STRING, accessibility STRING, signature STRING, "
    f"display STRING, xml_doc STRING, {SPAN}, declaring_docs ARRAY<STRING>, locations ARRAY<STRUCT<{SPAN.replace(' STRING', ': STRING').replace(' INT', ': INT')}>>",
    "symbol_keys": "index_kind STRING, key STRING, symbol_id STRING",
    "type_edges": "child_id STRING, parent_id STRING, kind STRING",
    "member_links": "member_id STRING, linked_id STRING, kind STRING",
    "refs": f"target_id STRING, project_id STRING, {SPAN}",
    "call_edges": f"caller_id STRING, callee_id STRING, callee_display STRING, ordinal INT, {SPAN}",
    "tokens": f"symbol_id STRING, {SPAN}",
    "doc_outline": "file_path STRING, ordinal INT, symbol_id STRING",
    "invocations": "doc_id STRING, ordinal INT, method_name STRING, type_args ARRAY<STRING>, arg_texts ARRAY<STRING>, arg0_value STRING, raw_call STRING, "
    f"receiver_type STRING, receiver_interfaces ARRAY<STRING>, reduced_first_param STRING, containing_type STRING, {SPAN}",
    "diagnostics": f"project_id STRING, severity STRING, code STRING, message STRING, {SPAN}",
    "load_diagnostics": "load_id LONG, kind STRING, message STRING",
}
SPAN_COLUMNS = ["file_path", "line", "col", "end_line", "end_col"]
