"""Benchmark decontamination by Wu-Manber search over words.

Texts and items are lower-cased (A-Z only) and cut into words. Each item's windows of 13 words (an item
of fewer words is one window) are the test strings. Test strings of one length form a pattern set with

* a shift table: for the hash of a block of two words, how far a window's end may safely move on,
* suffix buckets: the test strings by the hash of their last words,

so a document is read at every 12th word or so: a block in no test string lets the search jump over all
ends that it excludes, shift 0 opens the bucket, and the words are then compared, first by their hashes
and at last byte by byte. Many stretches of text move on at once, in numpy.

The items are dealt into files in the shared folder, each of about FILE_BYTES of text, which the workers read. A
task keeps compiled files of HELD_BYTES together, and goes through GROUP_BYTES of documents for each file before
the next one, so a benchmark of any size takes bounded memory and is compiled once for every group at most.
Documents are not shuffled.

Defined cases: null or empty text has no words and is clean; an item without words has no windows; equal
windows of several items count for each; rows with a null item_id mark words but are in no list of
items; equal item_ids count once; repeated documents each get their row; no items: all are clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm.common import (
    LOWER,
    NOT_ALNUM,
    U64,
    gram_hashes,
    raw,
    read,
    released,
    read_shard,
    shared_dir,
    text_chunks,
    word_hashes,
    words,
    write_shards,
)

WINDOW = 13
BLOCK = 2
SUFFIX = 4
#: Contaminated from this share of hit words: 1 / 20.
SHARE = 20
FILE_BYTES = 1 << 20
#: Text of the items whose compiled patterns a worker keeps.
HELD_BYTES = 4 << 20
#: Text of documents that meets a file of items before the next file is compiled.
GROUP_BYTES = 16 << 20
_BITS = 18
_LANE = 256
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def normal_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = LOWER[data]
    return (data, *words(data, off, NOT_ALNUM))


class Patterns:
    """Test strings of m words: shift table, suffix buckets, words and items."""

    def __init__(self, rows: list[tuple[tuple[bytes, ...], np.ndarray, set]]):
        self.words = [r[0] for r in rows]
        self.items = [sorted(r[2]) for r in rows]
        self.hashes = np.stack([r[1] for r in rows])
        self.m = self.hashes.shape[1]
        self.b = min(BLOCK, self.m)
        self.s = min(SUFFIX, self.m)
        self.most = self.m - self.b + 1
        self.shift = np.full(1 << _BITS, min(self.most, 255), np.uint8)
        for end in range(self.b, self.m + 1):  # blocks that end nearer to the window's end allow less
            h = np.array([gram_hashes(x[end - self.b : end], self.b)[0] for x in self.hashes], U64)
            np.minimum.at(self.shift, (h >> U64(64 - _BITS)).astype(np.int64), min(self.m - end, 255))
        suffix = np.array([gram_hashes(x[self.m - self.s :], self.s)[0] for x in self.hashes], U64)
        self.by = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.by]

    def find(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, pattern) of all windows whose word hashes agree; ends are indexes of last words."""
        n, m = len(h), self.m
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none
        step = self.shift[(gram_hashes(h, self.b) >> U64(64 - _BITS)).astype(np.int64)]  # at a block's first word
        at = np.arange(m - 1, n, _LANE)
        stop = np.minimum(at + _LANE, n)
        hits = []
        while len(at):
            s = step[at - self.b + 1].astype(np.int64)
            hits.append(at[s == 0])
            at = at + np.maximum(s, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        ends = np.concatenate(hits)
        ends = ends[row[ends] == row[ends - m + 1]]
        if not len(ends):
            return none, none
        tail = gram_hashes(h, self.s)[ends - self.s + 1]
        lo, hi = np.searchsorted(self.suffix, tail, "left"), np.searchsorted(self.suffix, tail, "right")
        got_e, got_p = [], []
        while (open_ := lo < hi).any():  # one more candidate of each bucket
            ends, lo, hi = ends[open_], lo[open_], hi[open_]
            p = self.by[lo]
            ok = (h[ends[:, None] - np.arange(m - 1, -1, -1)] == self.hashes[p]).all(1)
            got_e.append(ends[ok])
            got_p.append(p[ok])
            lo = lo + 1
        return (np.concatenate(got_e), np.concatenate(got_p)) if got_e else (none, none)


def compile_items(ids: list, data: np.ndarray, off: np.ndarray, window: int) -> list[Patterns]:
    data, starts, ends, row = normal_words(data, off)
    h = word_hashes(data, starts, ends)
    whole = [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)]
    found: dict[int, dict[tuple, tuple]] = {}
    for r, item in enumerate(ids):
        lo, hi = np.searchsorted(row, [r, r + 1])
        m = min(window, hi - lo)
        for i in range(lo, hi - m + 1) if m else ():
            entry = found.setdefault(m, {}).setdefault(tuple(whole[i : i + m]), (h[i : i + m], set()))
            if item is not None:
                entry[1].add(str(item))
    return [Patterns([(k, *v) for k, v in found[m].items()]) for m in sorted(found)]


class Compiled:
    """The patterns of the files that were last used, up to HELD_BYTES of their items' text."""

    def __init__(self, window: int):
        self.window = window
        self.held: dict[str, tuple[int, list[Patterns]]] = {}

    def __call__(self, uri: str) -> list[Patterns]:
        if uri in self.held:
            self.held[uri] = self.held.pop(uri)
        else:
            t = read_shard(uri)
            data, off = raw(t.column("text"))
            while self.held and sum(n for n, _ in self.held.values()) + len(data) > HELD_BYTES:
                del self.held[next(iter(self.held))]
            self.held[uri] = len(data), compile_items(t.column("item_id").to_pylist(), data, off, self.window)
        return self.held[uri][1]


class Chunk:
    """The words of some documents, which of them are hit, and the items of each document."""

    def __init__(self, part: pa.RecordBatch, data: np.ndarray, off: np.ndarray):
        self.part = part
        self.data, self.starts, self.ends, self.row = normal_words(data, off)
        self.h = word_hashes(self.data, self.starts, self.ends)
        self.delta = np.zeros(len(self.h) + 1, np.int64)
        self.items: list[set] = [set() for _ in range(part.num_rows)]

    def meet(self, patterns: list[Patterns]) -> None:
        for p in patterns:
            for e, k in zip(*(x.tolist() for x in p.find(self.h, self.row)), strict=True):
                b = e - p.m + 1
                if all(bytes(self.data[self.starts[b + i] : self.ends[b + i]]) == w for i, w in enumerate(p.words[k])):
                    self.delta[b] += 1
                    self.delta[e + 1] -= 1
                    self.items[self.row[e]].update(p.items[k])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Words and hit words of each document."""
        hit = np.cumsum(self.delta[:-1]) > 0
        rows = self.part.num_rows
        return np.bincount(self.row, minlength=rows), np.bincount(self.row[hit], minlength=rows)


def scan(batches: Iterator[pa.RecordBatch], files: list[str], window: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[set]]]:
    """Batches of documents with n_words, n_hit and the set of item ids for each row."""
    compiled = Compiled(window)
    group: list[Chunk] = []
    size = 0

    def found() -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[set]]]:
        for uri in files:
            patterns = compiled(uri)
            for c in group:
                c.meet(patterns)
        for c in group:
            yield c.part, *c.counts(), c.items
        group.clear()

    for part, data, off in text_chunks(batches):
        group.append(Chunk(part, data, off))
        size += len(data)
        if len(files) < 2 or size >= GROUP_BYTES:
            yield from found()
            size = 0
    yield from found()


def item_files(items: DataFrame, folder: str, size: int = FILE_BYTES) -> list[str]:
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    n, total = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return write_shards(items.sparkSession, items, ["item_id", "text"], f"{folder}/items", max(1, n * size // max(total, 1)))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    files = item_files(items, shared_dir(docs.sparkSession, "decontam"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, n, hit, items in scan(batches, files, window):
            digest = [hashlib.sha256(",".join(sorted(x, key=str.encode)).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pa.array((hit > 0) & (share * hit >= n))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return docs.select("doc_id", "text").mapInArrow(released(mark), RESULT)


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    files = item_files(items, shared_dir(docs.sparkSession, "decontam"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, n, hit, _ in scan(batches, files, window):
            yield part.filter(pa.array(~((hit > 0) & (share * hit >= n))))

    return docs.mapInArrow(released(keep), docs.schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontaminate": op6_decontaminate}

_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
ORACLE = {
    "op6_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
lens AS (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lens)),
sizes AS (SELECT DISTINCT m FROM pat),
win AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes)),
hits AS (SELECT win.doc_id, win.i, win.m, pat.item_id FROM win JOIN pat ON win.m = pat.m AND win.s = pat.s),
covered AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id::VARCHAR)::BIGINT AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN its USING (doc_id)
"""
}
