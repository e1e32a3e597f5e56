"""Column expressions that several operators share; all but ``doc_summary`` stay in the JVM."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def match_tier(name: Column, query: str) -> Column:
    """0 exact, 1 exact but for case, 2 prefix, 3 capitals, 4 substring; null: no match."""
    low, q = F.lower(name), query.lower()
    capitals = F.regexp_replace(name, "[^A-Z0-9]", "")
    return (
        F.when(name == query, 0)
        .when(low == q, 1)
        .when(low.startswith(q), 2)
        .when((F.length(capitals) > 1) & capitals.startswith(query), 3)
        .when(low.contains(q), 4)
    )


def severity_rank(severity: Column) -> Column:
    """Error 3, Warning 2, Info 1, everything else 0."""
    s = F.lower(severity)
    return F.when(s == "error", 3).when(s == "warning", 2).when(s == "info", 1).otherwise(0)


def generated_path(path: Column) -> Column:
    """Build output, with either kind of separator, and .g.cs files; false without a path."""
    p = F.concat(F.lit("/"), F.replace(F.lower(path), F.lit("\\"), F.lit("/")))
    return F.coalesce(p.contains("/obj/") | p.contains("/bin/") | p.endswith(".g.cs"), F.lit(False))


def summary_text(xml: str | None) -> str | None:
    """The trimmed text of the first summary element; null for blank or malformed documentation, or without one."""
    if xml is None or not xml.strip():
        return None
    try:
        found = next(ET.fromstring(xml).iter("summary"), None)
    except ET.ParseError:
        return None
    return ("".join(found.itertext()).strip() or None) if found is not None else None


@F.pandas_udf(StringType())
def _summaries(xml: pd.Series) -> pd.Series:
    return xml.map(summary_text)


def doc_summary(xml: Column) -> Column:
    """``summary_text`` in Arrow batches: XPath functions fail on malformed XML and can't tell a missing element."""
    return _summaries(xml)


def kind_label(kind: Column, type_kind: Column) -> Column:
    """A symbol's kind; a named type goes by what type it is, and is a class if that is unknown."""
    named = F.when(F.lower(type_kind).isin("interface", "struct", "enum", "delegate"), F.initcap(type_kind)).otherwise("Class")
    return F.when(F.lower(kind) == "namedtype", named).otherwise(kind)


def location(path: Column, line: Column, col: Column) -> Column:
    """A place counted from 1 from one counted from 0; null outside of source files."""
    return F.when(path.isNotNull(), F.struct(path.alias("file_path"), (line + 1).alias("line"), (col + 1).alias("col")))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1)


def type_keys(display: Column, metadata: Column) -> Column:
    """The keys a type is found by: its display form and, if another, its metadata form."""
    return F.array_distinct(F.array_compact(F.array(display, metadata)))


def top_per(df, keys: list[str], order: list[Column], n: int):
    """The first n rows of each key in a total order."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
