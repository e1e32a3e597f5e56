"""Compiler diagnostics with their filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.functions import generated_path, severity_rank
from symlake.operators.lookup import in_file

_KNOWN = ("error", "warning", "info", "hidden")
_RANK = {"error": 3, "warning": 2, "info": 1}


def compilation_errors(
    diagnostics: DataFrame,
    severity: str | None = None,
    project: str | None = None,
    file_path=None,
    include_generated: bool = True,
    minimum: str = "Warning",
    exclude_codes: Sequence[str] = (),
) -> DataFrame:
    """An unknown exact severity filters nothing; an unknown minimum admits everything; the minimum holds even with an exact severity."""
    d = diagnostics
    if project is not None:
        d = d.where(F.lower("project_id") == project.lower())
    if file_path is not None:
        d = d.where(in_file(F.col("file_path"), file_path))
    if severity is not None and severity.lower() in _KNOWN:
        d = d.where(F.lower("severity") == severity.lower())
    if exclude_codes:
        d = d.where(~F.coalesce(F.lower("code").isin([c.lower() for c in exclude_codes]), F.lit(False)))
    d = d.where(severity_rank(F.col("severity")) >= _RANK.get(minimum.lower(), 0))
    return d if include_generated else d.where(~generated_path(F.col("file_path").cast("string")))


def severity_summary(diagnostics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return diagnostics.groupBy(*by).agg(F.count_if(F.lower("severity") == "error").alias("errors"), F.count_if(F.lower("severity") == "warning").alias("warnings"))
