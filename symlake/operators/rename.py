"""Rename preview: whole-word occurrences, a symbol's places, edits and the text they lead to."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.schema import SPAN_COLUMNS

_NAME = "[A-Za-z0-9_]"


def _whole_word(word: str) -> str:
    return f"(^|[^A-Za-z0-9_])({re.escape(word)})(?=$|[^A-Za-z0-9_])"


def occurrences(text: Column, word: str) -> Column:
    """Whole-word occurrences; only ASCII letters, digits and _ belong to words."""
    return F.regexp_count(text, F.lit(_whole_word(word)))


def renamed(text: Column, word: str, new: str) -> Column:
    return F.regexp_replace(text, _whole_word(word), "$1" + new.replace("\\", "\\\\").replace("$", "\\$"))


def rename_preview(docs: DataFrame, word: str, new: str) -> DataFrame:
    """docs (doc_id, text) that change, with occurrences and the new text.

    Texts are counted once; only those with occurrences are replaced.
    """
    counted = docs.where(F.col("text").contains(word)).select("doc_id", "text", F.explode(F.array(occurrences(F.col("text"), word))).alias("occurrences"))
    return counted.where("occurrences > 0").select("doc_id", "occurrences", renamed(F.col("text"), word, new).alias("new_text"))


def occurrence_lines(docs: DataFrame, word: str) -> DataFrame:
    """doc_id, line (from 1) and occurrences of each line that holds the word."""
    lines = docs.where(F.col("text").contains(word)).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "words"))
    counted = lines.where(F.col("words").contains(word)).select("doc_id", (F.col("at") + 1).alias("line"), occurrences(F.col("words"), word).alias("occurrences"))
    return counted.where("occurrences > 0")


EDIT = "file_path string, line int, col int, end_line int, end_col int, old_text string, new_text string"


def symbol_spans(symbols: DataFrame, refs: DataFrame, symbol_ids: DataFrame) -> DataFrame:
    """The distinct places of the symbols (id): declarations and references."""
    declared = symbols.join(symbol_ids, F.col("symbol_id") == F.col("id"), "left_semi").select(F.inline("locations")).select(*SPAN_COLUMNS)
    used = refs.join(symbol_ids, F.col("target_id") == F.col("id"), "left_semi").select(*SPAN_COLUMNS)
    return declared.union(used).where("file_path IS NOT NULL").distinct()


def _places(text: str, spans: list, word: str) -> list[tuple[int, int, tuple]]:
    """(begin, end, span) of the places in a text, in order; of a span longer than the word its first whole word."""
    begins = [0, *(m.end() for m in re.finditer("\n", text))]
    out = []
    for s in spans:
        if not (1 <= s["line"] <= len(begins) and 1 <= s["end_line"] <= len(begins)):
            continue
        a, z = begins[s["line"] - 1] + s["col"] - 1, begins[s["end_line"] - 1] + s["end_col"] - 1
        m = re.compile(rf"(?<!{_NAME}){re.escape(word)}(?!{_NAME})").search(text, a, z)
        if m:
            out.append((m.start(), m.end(), (s["line"], s["col"] + m.start() - a) if s["line"] == s["end_line"] else (s["line"], s["col"])))
    return sorted(set(out))


def rename_symbol(documents: DataFrame, spans: DataFrame, word: str, new: str) -> DataFrame:
    """file_path, edits (EDIT without the path) and the whole new text of each document (file_path, text) with a place of the symbol."""
    by_doc = spans.groupBy("file_path").agg(F.collect_list(F.struct("line", "col", "end_line", "end_col")).alias("spans"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, text, found in zip(p["file_path"], p["text"], p["spans"], strict=True):
                edits, out, last = [], [], 0
                for a, z, (line, col) in _places(text or "", list(found), word):
                    if a < last:
                        continue
                    edits.append({"line": line, "col": col, "end_line": line, "end_col": col + len(word), "old_text": word, "new_text": new})
                    out += [text[last:a], new]
                    last = z
                if edits:
                    rows.append((path, edits, "".join([*out, text[last:]])))
            yield pd.DataFrame(rows, columns=["file_path", "edits", "new_text"])

    schema = f"file_path string, edits array<struct<{EDIT.split(', ', 1)[1].replace(' ', ': ').replace(',:', ',')}>>, new_text string"
    return documents.select("file_path", "text").join(by_doc, "file_path").mapInPandas(work, schema)


def write_files(changed: DataFrame, most: int = 10_000) -> int:
    """Write each new text over its file, on the driver, one at a time; only when asked for. Refuses more than ``most`` documents."""
    if changed.count() > most:
        raise ValueError(f"more than {most} documents would change")
    n = 0
    for r in changed.select("file_path", "new_text").toLocalIterator():
        with open(r["file_path"].removeprefix("file://"), "w", encoding="utf-8", newline="") as f:
            f.write(r["new_text"])
        n += 1
    return n


def apply_edits(preview: DataFrame, path: str) -> None:
    """Write the changed documents under path; only when asked for."""
    preview.select("doc_id", "new_text").write.mode("error").parquet(path)


def spans_of(text: str, word: str) -> Iterable[tuple[int, int, int, int]]:
    """1-based (line, col, end_line, end_col) of each whole-word occurrence."""
    for n, line in enumerate(text.split("\n"), 1):
        for m in re.finditer(rf"(?<!{_NAME}){re.escape(word)}(?!{_NAME})", line):
            yield n, m.start() + 1, n, m.end() + 1
