"""Substring dedup over bytes by external suffix sorting.

A byte is removed if a string of 50 bytes that covers it also starts in a document with a smaller id. By the
steps of ``repeats``:

1. Recurring anchors: every 50-byte window has an anchor, its smallest 20-byte gram (see ``anchors``); anchor
   grams are counted over the corpus. Only windows whose anchor's gram occurs twice can repeat.
2. Segments: neighbouring windows with one recurring anchor form a segment of at most 80 bytes. Equal strings
   have equal anchors, so a segment's matches are all among its anchor's. An anchor whose segments all have
   one content, by 128 bits, has nothing to compare: the windows repeat at all its places.
3. Sorting: the distinct segments of the other anchors are dealt by their gram into shards of about
   SHARD_BYTES; segments of a gram in more than CROWDED contexts are cut again where the second smallest gram
   of their windows changes, and dealt by both grams. A shard puts its segments, with separators, into a text
   on disk and sorts its suffixes (``suffixes``), whatever its length; suffixes that share 50 bytes are one
   string, whose smallest document is the least of its segments'.
4. Removal: ranges of starts whose string also begins in a smaller document go to all places of the segment's
   content and from there to the documents.

Whole documents travel only to meet what was found for them.

Defined cases: null text is empty; a text of fewer than 50 bytes stays; a null id counts as the largest id
(2^63 - 1); rows that share an id are one document; other columns are ignored; an empty table gives no rows.
What stays of a text is binary, since a cut may fall inside a character.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm.anchors import anchor_of, places, runs
from symlake.llm.common import BYTE_VALUE, U64, drop_dir, free_shuffles, gram_hashes, mix, raw, read, released, shared_dir, span_hashes, table, text_chunks
from symlake.llm.repeats import at_spots, contents, keyed, listed, located, marked, recurring, with_gone
from symlake.llm.suffixes import BLOCK, array, blocks_of, groups, work_folder

WINDOW = 50
GRAM = 20
#: Segments of a gram with more contents are cut once more.
CROWDED = 256
SHARD_BYTES = 2 << 20
#: Bytes of text that are worked on at once, so that arrays of 8 bytes a place stay in a core's cache.
BLOCK_BYTES = 1 << 17
_SECOND = mix(BYTE_VALUE ^ U64(0x2545F4914F6CDD1D))
SEGMENT = "shard long, gram long, content long, first int, segment binary, low long, high long"
RANGE = "gram long, content long, first int, stop int, low long"


class Bytes:
    """The windows and anchors of a block of texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int):
        self.data, self.off, self.window = data, off, window
        rows = len(off) - 1
        self.row = np.repeat(np.arange(rows), np.diff(off))
        n = max(0, len(data) - window + 1)
        self.valid = self.row[:n] == self.row[window - 1 :] if n else np.zeros(0, bool)
        self.grams = gram_hashes(BYTE_VALUE[data], GRAM)
        self.anchor = anchor_of(self.grams, window - GRAM + 1)


def anchor_places(window: int = WINDOW):
    """The anchors of a block: row and gram."""

    def work(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = Bytes(data, off, window)
        at = places(b.anchor, b.valid)
        return b.row[at], b.grams[at].view(np.int64)

    return work


def spans(window: int = WINDOW):
    """The segments of a block around its recurring anchors (known, sorted)."""

    def work(data: np.ndarray, off: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
        b = Bytes(data, off, window)
        place = places(b.anchor, b.valid)
        if not len(known) or not len(place):
            return (np.zeros(0, np.int64),) * 5
        hit = np.zeros(len(b.grams) + 1, bool)
        gram = b.grams[place].view(np.int64)
        hit[place] = known[np.minimum(np.searchsorted(known, gram), len(known) - 1)] == gram
        lo, hi = runs(b.valid & hit[b.anchor], b.anchor)
        content = span_hashes(_SECOND[data], lo, hi + window - 1).view(np.int64)
        return b.row[lo], b.grams[b.anchor[lo]].view(np.int64), content, lo - off[b.row[lo]], hi - lo

    return work


def segments(wanted: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The bytes of each content wanted, in one piece or, if its gram is crowded, in pieces (SEGMENT).

    A spot that meets the row of another text is known by the content's hash.
    """
    names = ["shard", "gram", "content", "first", "segment", "low", "high"]
    crowded = wanted.groupBy("gram").agg(F.count("*").alias("m")).where(F.col("m") > CROWDED).select("gram", F.lit(True).alias("crowded"))
    wanted = wanted.join(crowded, "gram", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_chunks(batches):
            row, found = listed(part.column("found"))
            at, gram, content, low, high, starts = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in found.flatten()[:-1])
            again = found.flatten()[-1].fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            begin, length = off[row] + at, starts + window - 1
            own = begin + length <= off[row + 1]
            own[own] = span_hashes(_SECOND[data], begin[own], (begin + length)[own]).view(np.int64) == content[own]
            gram, content, low, high, again, begin, length = (x[own] for x in (gram, content, low, high, again, begin, length))
            ends = np.cumsum(length)
            text = data[np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
            of, lo, hi, shard = cut_again(text, ends - length, ends, gram, again, window)
            whole = text.tobytes()
            seg = pa.array([whole[x:y] for x, y in zip(lo.tolist(), (hi + window - 1).tolist(), strict=True)], pa.binary())
            cols = (shard, gram[of], content[of], (lo - (ends - length)[of]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), seg, pa.array(low[of]), pa.array(high[of])], names=names)

    return at_spots(docs, wanted, ["gram", "content", "low", "high", "starts", "crowded"]).mapInArrow(released(work), SEGMENT)


def cut_again(text: np.ndarray, begin: np.ndarray, end: np.ndarray, gram: np.ndarray, again: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces of segments text[begin:end]: segment, first and one past the last window in the text, and shard key.

    Those with ``again`` are cut where the smallest gram but the segment's own changes; equal windows fall in
    pieces with equal keys.
    """
    n = len(begin)
    whole = np.flatnonzero(~again)
    of, lo, hi, key = [whole], [begin[whole]], [end[whole] - window + 1], [gram[whole]]
    if again.any():
        row = np.repeat(np.arange(n), end - begin)
        valid = (row[: len(row) - window + 1] == row[window - 1 :]) & again[row[: len(row) - window + 1]]
        grams = gram_hashes(BYTE_VALUE[text], GRAM)
        grams[grams.view(np.int64) == gram[row[: len(grams)]]] = np.iinfo(U64).max
        second = anchor_of(grams, window - GRAM + 1)
        a, z = runs(valid, second)
        r = row[a]
        of.append(r)
        lo.append(a)
        hi.append(z)
        key.append(mix(gram[r].view(U64) ^ mix(grams[second[a]])).view(np.int64))
    return tuple(np.concatenate(x) for x in (of, lo, hi, key))


def shard_ranges(data: np.ndarray, off: np.ndarray, low: np.ndarray, high: np.ndarray, window: int, folder: str, **options: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (segment, first, stop, low) of the starts in segments whose string begins in two documents or more.

    Ends of blocks may cut a range in two, which changes no covered byte.
    """
    k = len(off) - 1
    start, end = array(folder, np.int64, k), 0
    for z in blocks_of(k):
        n = off[z.start + 1 : z.stop + 1] - off[z] + 1  # a separator after each segment
        start[z] = end + np.cumsum(n) - n
        end += int(n.sum())
    t, inside = array(folder, np.uint16, end), array(folder, bool, end)  # inside: where a window starts
    segment = array(folder, np.int32, end)  # of each place
    step = max(1, BLOCK >> 6)
    for a in range(0, k, step):
        z = slice(a, min(k, a + step))
        n = off[z.start + 1 : z.stop + 1] - off[z]
        at = np.repeat(off[z] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        to = np.repeat(start[z] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        t[to] = data[at].astype(np.uint16) + 1
        segment[to] = np.repeat(np.arange(z.start, z.stop), n)
        inside[to] = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) <= np.repeat(n - window, n)
    hit, low_at = array(folder, bool, end), array(folder, np.int64, end)

    def mark(pos: np.ndarray, lo: np.ndarray | int) -> None:
        hit[pos] = True
        low_at[pos] = lo

    with tempfile.SpooledTemporaryFile(BLOCK * 8, dir=folder) as waiting:  # members of the last set so far
        lo_open = hi_open = 0

        def close() -> None:
            waiting.seek(0)
            while lo_open < hi_open and (found := waiting.read(BLOCK * 8)):
                mark(np.frombuffer(found, np.int64), lo_open)
            waiting.seek(0)
            waiting.truncate()

        for pos, fresh in groups(t, window, folder, **options):
            ok = inside[pos]  # alike in all of a set
            pos, fresh = pos[ok], fresh[ok]
            if not len(pos):
                continue
            seg = segment[pos]
            cut = np.flatnonzero(np.concatenate(([True], fresh[1:])))
            lo, hi = np.minimum.reduceat(low[seg], cut), np.maximum.reduceat(high[seg], cut)
            if not fresh[0]:
                lo_open, hi_open = min(lo_open, int(lo[0])), max(hi_open, int(hi[0]))
                lo[0], hi[0] = lo_open, hi_open
            if fresh[0] or len(cut) > 1:
                close()
            of = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(pos))))
            keep = (lo < hi)[of[: cut[-1]]]
            mark(pos[: cut[-1]][keep], lo[of[: cut[-1]]][keep])
            waiting.write(pos[cut[-1] :].astype(np.int64).tobytes())
            lo_open, hi_open = int(lo[-1]), int(hi[-1])
        close()
    for z in blocks_of(end):
        pos = np.flatnonzero(hit[z]) + z.start
        if len(pos):
            lo, seg = low_at[pos], segment[pos]
            at = pos - start[seg]
            new = np.flatnonzero(np.concatenate(([True], (pos[1:] != pos[:-1] + 1) | (lo[1:] != lo[:-1]))))
            last = np.append(new[1:] - 1, len(pos) - 1)
            yield seg[new], at[new].astype(np.int32), (at[last] + 1).astype(np.int32), lo[new]


def repeated(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Ranges of starts with their smallest document, by gram and content, of the segments of found."""
    size = found.agg(F.sum(F.length("segment"))).first()[0] or 0
    n = max(1, -(-size // SHARD_BYTES))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = work_folder()
        try:
            columns = ("gram", "content", "low", "high")
            names, end = ("segments", "ends", "first", *columns), 0
            with contextlib.ExitStack() as stack:
                f = {x: stack.enter_context(open(os.path.join(folder, x), "wb")) for x in names}
                f["ends"].write(np.zeros(1, np.int64).tobytes())
                for b in batches:
                    data, off = raw(b.column("segment"))
                    f["segments"].write(data)
                    f["ends"].write((end + off[1:]).tobytes())
                    end += len(data)
                    f["first"].write(b.column("first").to_numpy().tobytes())
                    for x in columns:
                        f[x].write(b.column(x).to_numpy().tobytes())
            if not end:
                return
            kind = {"segments": np.uint8, "first": np.int32}
            data, off, first, gram, content, low, high = (np.asarray(np.memmap(os.path.join(folder, x), kind.get(x, np.int64), "r")) for x in names)
            for out in shard_ranges(data, off, low, high, window, folder):
                for a in range(0, len(out[0]), 1 << 16):
                    seg, lo, hi, least = (x[a : a + (1 << 16)] for x in out)
                    cols = (gram[seg], content[seg], first[seg] + lo, first[seg] + hi, least)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], names=["gram", "content", "first", "stop", "low"])
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return found.repartition(n, "shard").drop("shard").mapInArrow(released(sort), RANGE)


def decisions(docs: DataFrame, found: DataFrame, folder: str, window: int = WINDOW) -> DataFrame:
    """Ranges of starts in contents that also begin in another document, and the smallest one (RANGE)."""
    spark = docs.sparkSession
    each = contents(found, folder)
    alone = each.where("single AND low < high").select("gram", "content", F.lit(0).alias("first"), F.col("starts").alias("stop"), "low")
    pieces = table(spark, segments(each.where("NOT single"), docs, window), f"{folder}/segments")
    free_shuffles(spark)
    return table(spark, alone.union(repeated(pieces, window)), f"{folder}/decided")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "bytespans")
    docs = keyed(docs)
    known = recurring(docs, anchor_places(window), folder, BLOCK_BYTES)
    found = located(docs, known, spans(window), folder, BLOCK_BYTES)
    decided = decisions(docs, found, folder, window)
    for name in ("segments", "contents"):
        drop_dir(spark, f"{folder}/{name}")
    free_shuffles(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_chunks(batches):
            gone = marked(part, off[:-1], len(data), window)
            rows = part.num_rows
            row = np.repeat(np.arange(rows), np.diff(off))
            lost = np.bincount(row[gone], minlength=rows)
            head = gone.copy()
            head[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
            n_spans = np.bincount(row[head], minlength=rows)
            stay = data[~gone].tobytes()
            at = np.concatenate(([0], np.cumsum(np.diff(off) - lost))).tolist()
            kept = pa.array([stay[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), kept, pa.array(np.diff(off)), pa.array(lost), pa.array(n_spans)], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return with_gone(docs, found, decided, F.col("low") < F.col("doc"), folder).mapInArrow(released(cut), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op9_bytespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_bytespans": op9_bytespans}

ORACLE = {
    "op9_bytespans": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, b, substr(h, 2000 * b + 1, 2098) AS s, octet_length(h::BLOB) // 2 AS n FROM (SELECT doc_id, h, unnest(range(0, greatest(octet_length(h::BLOB) // 2 - 50, -1) // 1000 + 1)) AS b FROM d)),
win AS (SELECT doc_id, 1000 * b + i AS p, md5(substr(s, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, b, s, n, unnest(range(0, least(1000, n - 49 - 1000 * b))) AS i FROM blocks)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS lo FROM win) WHERE lo < doc_id),
runs AS (SELECT doc_id, p, max(p + 50) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM late),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM (SELECT *, sum((e IS NULL OR p > e)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM runs) GROUP BY doc_id, g),
gone AS (SELECT doc_id, count(*)::BIGINT AS n_spans, sum(z - a)::BIGINT AS n_removed FROM spans GROUP BY doc_id),
edges AS (SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM spans UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (SELECT e.doc_id, string_agg(substr(h, 2 * e.a + 1, 2 * (coalesce(e.z, octet_length(h::BLOB) // 2) - e.a)), '' ORDER BY e.a) AS s FROM edges e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, (octet_length(h::BLOB) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(s, h))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
}
