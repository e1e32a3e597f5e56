"""A change feed: what was extracted again from changed documents, as a stream that keeps a workspace fresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symlake.schema import FACTS
from symlake.workspace import Workspace

#: Fact tables that a change carries, each as the rows of one document.
CARRIED = ("symbols", "refs", "symbol_keys", "call_edges", "tokens", "type_edges", "invocations", "diagnostics")


def _struct(ddl: str) -> str:
    """The DDL of a table as a struct's."""
    out, depth = [], 0
    for part in ddl.split(", "):
        if depth == 0:
            name, kind = part.split(" ", 1)
            part = f"{name}: {kind}"
        depth += part.count("<") - part.count(">")
        out.append(part)
    return f"STRUCT<{', '.join(out)}>"


#: One row for each changed document.
CHANGE = "doc_id STRING, mtime TIMESTAMP, " + ", ".join(f"{n} ARRAY<{_struct(FACTS[n])}>" for n in CARRIED)


def change_feed(spark: SparkSession, path: str) -> DataFrame:
    """New files of changes (Parquet, CHANGE) below path as a stream."""
    return spark.readStream.schema(CHANGE).parquet(path)


def apply_changes(changes: DataFrame, workspace: Workspace) -> None:
    """Refresh the workspace from a batch of changes; of several changes of a document the newest counts."""
    newest = changes.groupBy("doc_id").agg(F.max_by(F.struct(*changes.columns), "mtime").alias("x")).select("x.*")
    rows = {n: newest.select(F.inline(n)) for n in CARRIED}
    workspace.refresh(newest.select("doc_id"), rows.pop("symbols"), **rows)


def keep_fresh(feed: DataFrame, workspace: Workspace, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply each batch of changes to the workspace; with ``once`` until all that is there has been applied.

    A batch's changes are written below the checkpoint first, since the tables keep reading them.
    """

    def batch(df: DataFrame, n: int) -> None:
        path = f"{checkpoint}/applied/{n}"
        df.write.mode("overwrite").parquet(path)
        apply_changes(df.sparkSession.read.schema(CHANGE).parquet(path), workspace)

    out = feed.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/offsets")
    return (out.trigger(availableNow=True) if once else out).start()
