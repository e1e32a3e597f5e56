"""Sources: source files, project files and fact tables."""

from __future__ import annotations

import datetime
import logging
import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECT = "file_path STRING, package_refs ARRAY<STRUCT<name: STRING, version: STRING>>, project_refs ARRAY<STRING>, error STRING"


def read_documents(spark: SparkSession, path: str, glob: str = "*.cs") -> DataFrame:
    """doc_id, file_path, text, mtime of all source files below path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("mtime"))


def changed_documents(current: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id of known documents whose file is newer; new and missing files wait for a reload."""
    seen = known.select("doc_id", F.col("mtime").alias("__seen"))
    return current.join(seen, "doc_id").where(F.col("mtime") > F.col("__seen")).select("doc_id")


def parse_project(xml: str) -> tuple[list[tuple[str, str | None]], list[str], str | None]:
    """Package references, project references and the error of a project file that can't be parsed."""
    try:
        root = ET.fromstring(xml.lstrip("﻿"))
    except ET.ParseError as e:
        return [], [], str(e)
    name = lambda e: e.tag.rpartition("}")[2]
    packages, projects = [], []
    for e in root.iter():
        include = (e.get("Include") or "").strip()
        if include and name(e) == "PackageReference":
            version = e.get("Version") or next((c.text for c in e if name(c) == "Version"), None)
            packages.append((include, version))
        elif include and name(e) == "ProjectReference":
            projects.append(include)
    return packages, projects, None


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """One row per project file below path; a bad file has an error and no references."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(f, *parse_project(x)) for f, x in zip(p["file_path"], p["text"], strict=True)]
            yield pd.DataFrame([(f, [{"name": n, "version": v} for n, v in a], b, e) for f, a, b, e in rows], columns=["file_path", "package_refs", "project_refs", "error"])

    return read_documents(spark, path, "*.csproj").select("file_path", "text").mapInPandas(work, PROJECT)


def solution_projects(text: str) -> list[str]:
    """Project paths of a solution file, in order, of either format."""
    found = re.findall(r'^Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+\.csproj)"', text, re.M) or re.findall(r'<Project\s+[^>]*Path="([^"]+\.csproj)"', text)
    return [p.replace("\\", "/") for p in found]


def read_solution(path: str) -> list[str]:
    """Paths of the projects of a solution file, resolved against its folder."""
    with open(path, encoding="utf-8-sig") as f:
        return [os.path.normpath(os.path.join(os.path.dirname(path), p)) for p in solution_projects(f.read())]


def find_solution(start: str) -> str | None:
    """The first solution file from a folder upwards: in each folder .sln before .slnx, then by name."""
    folder = os.path.abspath(start)
    while True:
        for end in (".sln", ".slnx"):
            found = sorted(n for n in os.listdir(folder) if n.lower().endswith(end))
            if found:
                return os.path.join(folder, found[0])
        if folder == (folder := os.path.dirname(folder)):
            return None


class LineFormatter(logging.Formatter):
    """``{UTC time in ISO 8601} {level} {name} - {message}``"""

    def format(self, record: logging.LogRecord) -> str:
        at = datetime.datetime.fromtimestamp(record.created, datetime.UTC).isoformat(timespec="milliseconds")
        return f"{at} {record.levelname} {record.name} - {record.getMessage()}"


def log_to(path: str, name: str = "symlake", level: int = logging.INFO) -> logging.Logger:
    """A logger that appends a line for each record to a file and flushes it."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    log, handler = logging.getLogger(name), logging.FileHandler(path, "a", encoding="utf-8")
    handler.setFormatter(LineFormatter())
    log.addHandler(handler)
    log.setLevel(level)
    return log
