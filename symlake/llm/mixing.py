"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 32-bit hash of its id. A source's budget is some whole passes over the source plus a
remainder; the remainder is the rows whose hash lies below the source's threshold, so a larger budget's
rows contain a smaller one's. The thresholds come from sums of sizes by (source, hash bucket): a first
histogram over 1,024 buckets finds the bucket in which the budget ends, a second one, over that bucket's
rows only, splits it again by 1,024. Rows are then filtered by their own hash: nothing is sorted, and
what is gathered for a source is two histograms, whatever its share of the rows.

Defined cases: null or empty text has size 0 and takes 0; a null source is a source of its own, last in
order; rows with one id (null ids too) share a hash, so they are taken together; an empty table gives no
rows; other columns of the input, whatever their names, are kept by ``copies`` and ignored by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symlake.llm.common import free, read, shared_dir, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_PASSES = 2
BITS = 10
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(doc_id: Column) -> Column:
    """32 bits of the id's MD5, so that SQL engines agree."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int], share: float, passes: int) -> list[tuple]:
    """(source, size, target) of each source: share * all sizes by weight, none above passes * its size.

    The excess of capped sources goes to the others by weight: the targets are min(w * level, cap), and
    the level is found by taking caps in ascending order of cap / w.
    """
    named = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    rows = [(s, n, weights[i % len(weights)]) for i, (s, n) in enumerate(named)]
    left = share * sum(n for _, n, _ in rows)
    weight = sum(w for _, _, w in rows)
    level = None
    for i, (_, n, w) in sorted(enumerate(rows), key=lambda x: (passes * x[1][1] / x[1][2], x[0])):
        if left / weight * w <= passes * n:
            level = left / weight
            break
        left -= passes * n
        weight -= w
    return [(s, n, float(passes * n) if level is None else min(w * level, float(passes * n))) for s, n, w in rows]


def thresholds(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """goal with column below: the number of 2**-20 hash cells of the source that get one more pass.

    sized: __source, __size, __hash; goal: __source, __size_all, __target, __full, __rest.
    """
    cells = sized.select("__source", "__size", F.shiftright("__hash", 32 - 2 * BITS).alias("__cell")).where("__size > 0")
    rest = goal.select(F.col("__source").alias("__of"), "__rest")
    running = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)

    first = cells.groupBy("__source", F.shiftright("__cell", BITS).alias("__bucket")).agg(F.sum("__size").alias("__n"))
    edge = (
        first.withColumn("__sum", F.sum("__n").over(running))
        .join(rest, F.col("__source").eqNullSafe(F.col("__of")))
        .where("__sum > __rest")
        .groupBy(F.col("__source").alias("__at"))
        .agg(F.min("__bucket").alias("__edge"), F.min_by(F.col("__sum") - F.col("__n"), "__bucket").alias("__before"))
    )
    near = (
        cells.join(edge, F.col("__source").eqNullSafe(F.col("__at")) & (F.shiftright("__cell", BITS) == F.col("__edge")))
        .groupBy("__source", F.col("__cell").alias("__bucket"), "__before")
        .agg(F.sum("__size").alias("__n"))
        .withColumn("__sum", F.col("__before") + F.sum("__n").over(running))
        .join(rest, F.col("__source").eqNullSafe(F.col("__of")))
        .where("__sum > __rest")
        .groupBy(F.col("__source").alias("__at"))
        .agg(F.min(F.struct("__bucket", "__n", "__sum", "__rest")).alias("__x"))
        .select(
            "__at",
            F.when(F.expr("__x.__rest - (__x.__sum - __x.__n) <= __x.__sum - __x.__rest"), F.col("__x.__bucket"))
            .otherwise(F.col("__x.__bucket") + 1)
            .alias("__cut"),
        )
    )
    whole = F.when(F.col("__rest") > 0, F.lit(1 << 2 * BITS)).otherwise(0)
    return goal.join(near, F.col("__source").eqNullSafe(F.col("__at")), "left").select(goal["*"], F.coalesce("__cut", whole).cast("long").alias("__below"))


def plan(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES
) -> tuple[DataFrame, DataFrame, bool]:
    """The sized rows, the table of sources with targets and thresholds, and whether it is small enough to broadcast."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "mix")
    sized = docs.select(
        F.col("doc_id").alias("__id"), F.col("source").cast("string").alias("__source"), word_count(F.col("text")).alias("__size"), row_hash(F.col("doc_id")).alias("__hash")
    )
    sized = table(spark, sized, f"{folder}/sized")
    sizes = [(r[0], r[1]) for r in sized.groupBy("__source").agg(F.sum("__size")).collect()]  # one row a source
    rows = []
    for source, n, target in targets(sizes, weights, share, passes):
        full = min(passes, int(target // n)) if n else 0
        rows.append((source, n, target, full, target - full * n if full < passes else 0.0))
    goal = spark.createDataFrame(rows, "__source string, __size_all long, __target double, __full int, __rest double")
    cuts = table(spark, thresholds(sized, goal), f"{folder}/cuts")
    return sized, cuts, len(rows) <= BROADCAST_SOURCES


def _passes(cuts: DataFrame, cell: Column) -> Column:
    return cuts["__full"] + F.when(cell < cuts["__below"], 1).otherwise(0)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs (doc_id, text, source)."""
    sized, cuts, small = plan(docs, weights, share, passes)
    cuts = F.broadcast(cuts) if small else cuts
    n = _passes(cuts, F.shiftright(sized["__hash"], 32 - 2 * BITS))
    return sized.join(cuts, sized["__source"].eqNullSafe(cuts["__source"])).select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__size_all").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * n).cast("long").alias("taken")
    )


def copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it, with its own columns."""
    _, cuts, small = plan(docs, weights, share, passes)
    kept = docs.columns
    source, full, below, n, each = (free(c, kept) for c in ("source", "full", "below", "passes", "each"))
    cuts = cuts.select(F.col("__source").alias(source), F.col("__full").alias(full), F.col("__below").alias(below))
    cell = F.shiftright(row_hash(docs["doc_id"]), 32 - 2 * BITS)
    out = docs.join(F.broadcast(cuts) if small else cuts, docs["source"].cast("string").eqNullSafe(cuts[source]))
    out = out.withColumn(n, F.col(full) + F.when(cell < F.col(below), 1).otherwise(0)).where(F.col(n) > 0)
    return out.withColumn(each, F.explode(F.array_repeat(F.lit(0), F.col(n)))).select(*kept)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


QUERIES = {"op2_mix_sources": op2_mix_sources}

ORACLE = {
    "op2_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT >> 12 AS cell
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS n FROM sized GROUP BY source),
weighted AS (
  SELECT source, n, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS i FROM sources),
caps AS (
  SELECT *, 1.5::DOUBLE * (sum(n) OVER ())::BIGINT - 2 * coalesce(sum(n) OVER before, 0)::BIGINT AS rest_budget,
         (sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER before, 0)::BIGINT AS rest_weight
  FROM weighted WINDOW before AS (ORDER BY (2 * n)::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min(rest_budget / rest_weight, ((2 * n)::DOUBLE / w, i)) AS level FROM caps
  WHERE rest_budget / rest_weight * w <= 2 * n),
goal AS (
  SELECT source, n, CASE WHEN level IS NULL THEN (2 * n)::DOUBLE ELSE least(w * level, (2 * n)::DOUBLE) END AS target
  FROM weighted, level),
split AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(2, floor(target / n)) END::BIGINT AS whole FROM goal),
rest AS (
  SELECT *, CASE WHEN whole < 2 THEN target - whole * n ELSE 0 END AS rest FROM split),
cells AS (
  SELECT source, cell, sum(size)::BIGINT AS m FROM sized WHERE size > 0 GROUP BY ALL),
running AS (
  SELECT *, (sum(m) OVER (PARTITION BY source ORDER BY cell))::BIGINT AS upto FROM cells),
edge AS (
  SELECT r.source, min((r.cell, r.m, r.upto, t.rest)) AS x
  FROM running r JOIN rest t ON r.source IS NOT DISTINCT FROM t.source WHERE r.upto > t.rest GROUP BY r.source),
cut AS (
  SELECT source, CASE WHEN x[4] - (x[3] - x[2]) <= x[3] - x[4] THEN x[1] ELSE x[1] + 1 END AS below FROM edge)
SELECT s.doc_id, s.size, t.n AS source_size, t.target,
       (s.size * (t.whole + (s.cell < coalesce(c.below, CASE WHEN t.rest > 0 THEN 1048576 ELSE 0 END))::INT))::BIGINT AS taken
FROM sized s JOIN rest t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN cut c ON s.source IS NOT DISTINCT FROM c.source
"""
}
