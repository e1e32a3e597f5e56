"""What the removal of repeated words and of repeated bytes share: facts travel to documents by joins.

Both work on windows, find each window's anchor (``anchors``) and go through these steps:

1. ``recurring``: anchors' grams are dealt by hash, sorted outside of memory, and those that occur at two places
   or more of the corpus go back to their rows. A gram that recurs within GROUP places of a task is known to
   recur there, so of its rows only one is dealt by the gram: frequent grams make no large partition.
   What travels in these two steps is packed: one row holds the pairs (gram, row) that a task has for a part.
2. ``located``: those rows are read with their recurring grams and cut into segments, runs of neighbouring
   windows with one such anchor. A segment is known by its gram and a hash of its content, 128 bits together,
   and lies at a place of a row.
3. ``contents``: places are counted by content, and contents by gram. A gram whose segments all have one content
   needs no look at windows: every segment but the first repeats, all of it. The segments of other grams are
   compared by the operator itself, each distinct content once, which it reads at its first place
   (``first_places``).
4. ``gone``: what was decided for a content goes to all places that have it, and from there to the rows.

Every step is a shuffle on a hash; nothing is read once per block or task, and no file or broadcast grows with
the corpus. Grams and contents that very many rows share are counted in each task before they travel, and
places are only ever joined with the decision on their content, which Spark splits if skewed. A row is known
by its document and a hash of id and text, so what is gathered for a row is bounded by its text, whatever rows
repeat an id.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.llm.common import U64, drop_dir, free_shuffles, raw, released, table, text_chunks
from symlake.llm.suffixes import merged, work_folder

#: Null ids count as this one.
LAST = (1 << 63) - 1
#: Bits of a place in its row; a place and as many bits of the row as are left make one number.
AT_BITS = 31
PLACE = "gram long, content long, doc long, row long, at int, starts int"

#: Places of anchors that a task looks at together.
GROUP = 1 << 19

#: From a block's bytes and offsets: row and gram of each anchor place.
Places = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: From a block's bytes, offsets and recurring grams: row, gram, content, first window in the row and number of windows of each segment.
Segments = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc (the id that counts) and row."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), "text", F.coalesce(doc_id, F.lit(LAST)).alias("doc"), F.xxhash64(doc_id, "text").alias("row"))


def listed(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a list column, and the elements."""
    n = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), col.flatten()


def dealt(gram: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """gram, row, sure of a group's places: once for each gram and row.

    Of a gram with several places all rows are sure, and are dealt by row; one more goes to where the gram is dealt.
    """
    order = np.argsort(gram)
    gram, row = gram[order], row[order]
    same = gram[1:] == gram[:-1]
    several = np.concatenate((same, [False])) | np.concatenate(([False], same))
    alone = ~several
    g, r = gram[several], row[several]
    order = np.lexsort((r, g))
    g, r = g[order], r[order]
    new = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    once = new | np.concatenate(([True], r[1:] != r[:-1])) if len(g) else new
    return (
        np.concatenate((gram[alone], g[new], g[once])),
        np.concatenate((row[alone], r[new], r[once])),
        np.concatenate((np.zeros(int(alone.sum() + new.sum()), bool), np.ones(int(once.sum()), bool))),
    )


def repeated(pairs: Iterator[tuple[np.ndarray, np.ndarray]], folder: str, **options: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of (gram, row) those whose gram comes twice or more, by an external sort."""
    held: tuple[np.ndarray, np.ndarray] | None = None  # the last entry, and whether it has been passed on
    for block in merged(pairs, folder, **options):
        gram, row = block[:, 0], block[:, 1]
        more = np.zeros(len(gram), bool)
        same = gram[1:] == gram[:-1]
        more[1:] |= same
        more[:-1] |= same
        if held is not None and held[0] == gram[0]:
            more[0] = True
            if not held[2]:
                yield np.array([held[0]]), np.array([held[1]])
        yield gram[more], row[more]
        held = int(gram[-1]), int(row[-1]), bool(more[-1])


def packed(pairs: np.ndarray, part: np.ndarray, name: str, **more: pa.Array) -> pa.RecordBatch:
    """One row for each part: its pairs (rows of two numbers) as bytes."""
    order = np.argsort(part, kind="stable")
    part, data = part[order], pairs[order].tobytes()
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    ends = [*first[1:].tolist(), len(part)]
    cells = [data[16 * x : 16 * y] for x, y in zip(first.tolist(), ends, strict=False)] if len(part) else []
    cols = {name: pa.array(part[first].astype(np.int32)), "pairs": pa.array(cells, pa.binary())} | {k: pa.repeat(v, len(first)) for k, v in more.items()}
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols.values()], names=list(cols))


def unpacked(cells: pa.Array) -> np.ndarray:
    return np.frombuffer(raw(cells)[0], np.int64).reshape(-1, 2)


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return (np.ascontiguousarray(x).view(U64) >> U64(20)) % U64(parts)


def recurring(docs: DataFrame, places: Places, folder: str, limit: int) -> tuple[DataFrame, int]:
    """q, pairs: (gram, row) of the grams in a row that occur at two places or more of the corpus, dealt by row into q of so many parts."""
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = 4 * n

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rows, n = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            gram, row, sure = dealt(np.concatenate(grams), np.concatenate(rows))
            for which, key in ((~sure, gram), (sure, row)):
                if which.any():
                    yield packed(np.stack((gram[which], row[which]), 1), _part(key[which], parts), "part", sure=pa.scalar(bool(sure[which][0])))
            grams.clear()
            rows.clear()

        for part, data, off in text_chunks(batches, limit=limit):
            row, gram = places(data, off)
            grams.append(gram)
            rows.append(part.column("row").to_numpy()[row])
            n += len(row)
            if n >= GROUP:
                yield from flush()
                n = 0
        if grams:
            yield from flush()

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = work_folder()
        try:
            with tempfile.TemporaryFile(dir=work) as f:  # what is sure waits there while the rest is sorted

                def unsure() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                    for b in batches:
                        sure = b.column("sure")
                        f.write(unpacked(b.column("pairs").filter(sure)))
                        yield tuple(unpacked(b.column("pairs").filter(pc.invert(sure))).T)

                def known() -> Iterator[np.ndarray]:
                    for gram, row in repeated(unsure(), work):
                        yield np.stack((gram, row), 1)
                    f.seek(0)
                    while block := f.read(GROUP * 16):
                        yield np.frombuffer(block, np.int64).reshape(-1, 2)

                held: list[np.ndarray] = []
                for pairs in known():
                    held.append(pairs)
                    if sum(map(len, held)) >= GROUP:
                        pairs = np.concatenate(held)
                        yield packed(pairs, _part(pairs[:, 1], parts), "q")
                        held.clear()
                if held:
                    pairs = np.concatenate(held)
                    yield packed(pairs, _part(pairs[:, 1], parts), "q")
        finally:
            shutil.rmtree(work, ignore_errors=True)

    found = docs.select("row", "text").mapInArrow(released(deal), "part int, pairs binary, sure boolean").repartition(n, "part")
    return table(docs.sparkSession, found.mapInArrow(released(twice), "q int, pairs binary"), f"{folder}/known"), parts


def located(docs: DataFrame, known: tuple[DataFrame, int], segments: Segments, folder: str, limit: int) -> DataFrame:
    """The places of segments (PLACE). Rows meet their grams in a task that holds the pairs of one part at a time."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found, parts = known
    q = F.pmod(F.shiftrightunsigned("row", 20), F.lit(parts)).cast("int")
    both = docs.select(q.alias("q"), F.lit(1).alias("kind"), "doc", "row", "text", F.lit(None).cast("binary").alias("pairs"))
    null = lambda kind: F.lit(None).cast(kind)
    both = both.union(found.select("q", F.lit(0), null("long"), null("long"), null("string"), "pairs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        pairs = np.zeros((0, 2), np.int64)  # of part now, by row
        for batch in batches:
            part, kind = (batch.column(c).to_numpy() for c in ("q", "kind"))
            new = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])))) if batch.num_rows else []
            for lo, hi in zip(new, [*new[1:], batch.num_rows], strict=True):
                run = batch.slice(lo, hi - lo)
                if part[lo] != now:
                    now, held, pairs = part[lo], [], pairs[:0]
                if kind[lo] == 0:
                    held.append(unpacked(run.column("pairs")))
                    continue
                if held:
                    pairs = np.concatenate([pairs, *held])
                    pairs, held = pairs[np.argsort(pairs[:, 1])], []
                if not len(pairs):
                    continue
                run = run.filter(pa.array(np.isin(run.column("row").to_numpy(), pairs[:, 1])))
                for docs_, data, off in text_chunks([run], limit=limit):
                    rows = docs_.column("row").to_numpy()
                    first, last = np.searchsorted(pairs[:, 1], rows, "left"), np.searchsorted(pairs[:, 1], rows, "right")
                    mine = np.concatenate([pairs[x:y, 0] for x, y in zip(first.tolist(), last.tolist(), strict=True)])
                    row, gram, content, at, starts = segments(data, off, np.unique(mine))
                    ids = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram), pa.array(content), docs_.column("doc").take(ids), docs_.column("row").take(ids), pa.array(at.astype(np.int32)), pa.array(starts.astype(np.int32))],
                        names=["gram", "content", "doc", "row", "at", "starts"],
                    )

    here = both.repartition(n, "q").sortWithinPartitions("q", "kind")
    out = table(spark, here.mapInArrow(released(cut), PLACE), f"{folder}/places")
    drop_dir(spark, f"{folder}/known")
    return out


def contents(places: DataFrame, folder: str) -> DataFrame:
    """gram, content, low and high (documents), starts, a spot, and single: whether the gram has no other content.

    Without contents that have one place and no other beside them. A spot is one of the content's places: the first
    33 bits of the row, and where in the row.
    """
    spot = F.shiftleft(F.shiftright("row", AT_BITS), AT_BITS).bitwiseOR(F.col("at").cast("long"))
    each = places.groupBy("gram", "content").agg(F.count("*").alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high"), F.max("starts").alias("starts"), F.min(spot).alias("spot"))
    each = table(places.sparkSession, each, f"{folder}/each")
    grams = each.groupBy("gram").agg(F.sum("n").alias("m"), F.min("content").alias("c1"), F.max("content").alias("c2")).where("m > 1").select("gram", (F.col("c1") == F.col("c2")).alias("single"))
    out = table(places.sparkSession, each.drop("n").join(grams.hint("shuffle_hash"), "gram"), f"{folder}/contents")
    drop_dir(places.sparkSession, f"{folder}/each")
    return out


def first_places(places: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """wanted (gram, content, low, ...) with the first place of each content: doc, at, row, starts."""
    at = places.withColumnRenamed("doc", "low").select("gram", "content", "low", F.struct("at", "row", "starts").alias("x"))
    first = wanted.drop("starts").hint("shuffle_hash").join(at, ["gram", "content", "low"]).groupBy("gram", "content", "low").agg(F.min("x").alias("x"), F.first("high").alias("high"), F.first("single").alias("single"))
    return table(places.sparkSession, first.select("gram", "content", F.col("low").alias("doc"), "high", "single", "x.*"), f"{folder}/first")


def at_spots(docs: DataFrame, wanted: DataFrame, fields: list[str]) -> DataFrame:
    """The rows of docs whose first bits some spots have, with a list of those spots (at and fields); a spot may meet more rows than its own."""
    bits = F.shiftright("spot", AT_BITS)
    by_row = wanted.groupBy(bits.alias("bits")).agg(F.collect_list(F.struct(F.col("spot").bitwiseAND((1 << AT_BITS) - 1).alias("at"), *fields)).alias("found"))
    return docs.withColumn("bits", F.shiftright("row", AT_BITS)).join(by_row.hint("shuffle_hash"), "bits").select("text", "found")


def with_first(docs: DataFrame, first: DataFrame, fields: list[str]) -> DataFrame:
    """The rows of docs in which a first place lies, with a list of those places (fields)."""
    by_row = first.groupBy("doc", "row").agg(F.collect_list(F.struct(*fields)).alias("found"))
    return docs.join(by_row.hint("shuffle_hash"), ["doc", "row"]).select("text", "found")


def with_gone(docs: DataFrame, places: DataFrame, decided: DataFrame, later: Column, folder: str) -> DataFrame:
    """docs with column gone: a list of numbers, the first and, in the lower half, one past the last window of runs that are removed.

    decided: gram, content, first, stop (windows of the content) and what ``later`` compares with a place.
    """
    hit = places.join(decided.hint("shuffle_hash"), ["gram", "content"]).where(later)
    hit = hit.groupBy("doc", "row").agg(F.collect_list(F.shiftleft((F.col("at") + F.col("first")).cast("long"), 32).bitwiseOR((F.col("at") + F.col("stop")).cast("long"))).alias("gone"))
    hit = table(docs.sparkSession, hit, f"{folder}/gone")
    drop_dir(docs.sparkSession, f"{folder}/places")
    free_shuffles(docs.sparkSession)
    return docs.join(hit.hint("shuffle_hash"), ["doc", "row"], "left").select("doc_id", "text", "gone")


def marked(part: pa.RecordBatch, base: np.ndarray, size: int, window: int) -> np.ndarray:
    """Which of a block's units (words, bytes) are removed; base: where each row's units begin."""
    delta = np.zeros(size + 1, np.int64)
    row, runs = listed(part.column("gone"))
    if len(row):
        both = runs.to_numpy()
        a, z = both >> 32, both & 0xFFFFFFFF
        np.add.at(delta, base[row] + a, 1)
        np.add.at(delta, base[row] + z - 1 + window, -1)
    return np.cumsum(delta[:-1]) > 0
