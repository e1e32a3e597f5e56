"""The envelope of every operator: rows, an error or a one-line summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

SYMBOL_NOT_FOUND = "SYMBOL_NOT_FOUND"
POSITION_INVALID = "POSITION_INVALID"
FILE_NOT_IN_WORKSPACE = "FILE_NOT_IN_WORKSPACE"
INVALID_PATTERN = "INVALID_PATTERN"
WORKSPACE_NOT_LOADED = "WORKSPACE_NOT_LOADED"
INTERNAL_ERROR = "INTERNAL_ERROR"


@dataclass(frozen=True)
class OpError(Exception):
    code: str
    message: str
    hint: str | None = None


@dataclass(frozen=True)
class OpResult:
    """Exactly one of df (lazy), error and summary is set."""

    df: DataFrame | None = None
    error: OpError | None = None
    summary: str | None = None

    @property
    def ok(self) -> bool:
        return self.error is None
