"""Substring dedup over words with repeated-phrase automata.

A window is 20 consecutive words. A word is removed if a window that covers it also starts earlier, in a
document with a smaller id or further up in the same one. By the steps of ``repeats``:

1. Recurring phrases: each window's anchor phrase (6 words, see ``anchors``) is looked for over the corpus, by its
   letters (see 2); those that occur twice or more are sent to the documents that have them.
2. Sharded automata: for each shard of documents (a block of text) the phrases that were sent to it are
   compiled into an Aho-Corasick automaton, and the shard is streamed through it, once. Only the automaton says
   where phrases occur. A word is one letter there, 8 bits of its hash, so that no node has more than 256
   children (they are searched one by one); a phrase that is located by a chance agreement of its 48 bits only
   makes a segment that is found to occur once. Windows around a located anchor are cut into segments.
3. Confirmed passages: contents of segments are compared by 128 bits. For phrases in several contexts the
   windows of each distinct content are compared by a 128-bit hash of their words, which gives the first place
   of every window.
4. Removal: windows that have an earlier place are marked at all places, and the words that stay are joined by
   one blank.

Automata grow with a block, not with the corpus, and each is compiled once.

Defined cases: null text has no words; documents with fewer words than a window stay as they are; a null id
counts as the largest id (2^63 - 1); rows that share an id are one document, in which a place further up in its
row is earlier, and equal places in two rows are not; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm.anchors import anchor_of, places, runs
from symlake.llm.common import SPACES, U64, drop_dir, free_shuffles, gram_hashes, mix, read, released, shared_dir, span_hashes, table, text_chunks, word_hashes, words
from symlake.llm.repeats import contents, first_places, keyed, listed, located, marked, recurring, with_first, with_gone

WINDOW = 20
PHRASE = 6
#: Bytes of text (or one document) that share an automaton.
BLOCK_BYTES = 1 << 19
_SECOND = U64(0x5851F42D4C957F2D)


class Words:
    """The words of a block of texts, their windows, anchors and symbols."""

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int):
        self.data, self.off, self.window = data, off, window
        self.starts, self.ends, self.row = words(data, off, SPACES)
        self.base = np.searchsorted(self.row, np.arange(len(off)))  # each row's first word
        self.h = word_hashes(data, self.starts, self.ends)
        self.symbols = (self.h & U64(0xFF)).astype(np.uint8)
        n = len(self.h) - window + 1
        self.valid = self.row[:n] == self.row[window - 1 :] if n > 0 else np.zeros(0, bool)
        self.grams = gram_hashes(self.h, PHRASE)
        self.anchor = anchor_of(self.grams, window - PHRASE + 1)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each window."""
        return gram_hashes(self.h, self.window), gram_hashes(mix(self.h ^ _SECOND), self.window)


def _letters(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The PHRASE letters from each place on, in one number; the first is the lowest byte."""
    return (symbols[at[:, None] + np.arange(PHRASE)].astype(np.int64) << (8 * np.arange(PHRASE))).sum(1)


def automaton(s: np.ndarray) -> ahocorasick.Automaton:
    """Of phrases, each given by its letters in one number."""
    a = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    text = (s[:, None] >> (8 * np.arange(PHRASE)) & 0xFF).astype(np.uint8).tobytes().decode("latin-1")
    for i in range(0, len(text), PHRASE):
        a.add_word(text[i : i + PHRASE])
    if len(s):
        a.make_automaton()
    return a


def phrase_places(window: int = WINDOW):
    """The anchor phrases of a block: row and letters."""

    def work(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = Words(data, off, window)
        at = places(w.anchor, w.valid)
        return w.row[at], _letters(w.symbols, at)

    return work


def passages(window: int = WINDOW):
    """The segments of a block around the phrases (letters) that its automaton locates."""

    def work(data: np.ndarray, off: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
        w = Words(data, off, window)
        if not len(known):
            return (np.zeros(0, np.int64),) * 5
        hit = np.zeros(len(w.h) + 1, bool)
        ends = np.fromiter((end for end, _ in automaton(known).iter(w.symbols.tobytes().decode("latin-1"))), np.int64)
        hit[ends - PHRASE + 1] = True
        lo, hi = runs(w.valid & hit[w.anchor], w.anchor)
        content = span_hashes(mix(w.h ^ _SECOND), lo, hi + window - 1).view(np.int64)
        row = w.row[lo]
        return row, w.grams[w.anchor[lo]].view(np.int64), content, lo - w.base[row], hi - lo

    return work


def windows(first: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """gram, content, first, w1, w2, low, low_at: the windows of each content and the first place of the content."""
    fields = ["gram", "content", "doc", "at", "starts"]
    names = ["gram", "content", "first", "w1", "w2", "low", "low_at"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_chunks(batches, limit=BLOCK_BYTES):
            w = Words(data, off, window)
            w1, w2 = (x.view(np.int64) for x in w.hashes())
            row, found = listed(part.column("found"))
            gram, content, doc, at, starts = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in found.flatten())
            of = np.repeat(np.arange(len(row)), starts)
            step = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)
            spot = w.base[row[of]] + at[of] + step
            cols = (gram[of], content[of], step.astype(np.int32), w1[spot], w2[spot], doc[of], (at[of] + step).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return with_first(docs, first, fields).mapInArrow(released(work), "gram long, content long, first int, w1 long, w2 long, low long, low_at int")


def decisions(docs: DataFrame, found: DataFrame, folder: str, window: int = WINDOW) -> DataFrame:
    """gram, content, first, stop, low, low_at: windows of a content, and where they would begin if they were first."""
    spark = docs.sparkSession
    first = first_places(found, contents(found, folder), folder)
    alone = first.where("single").select("gram", "content", F.lit(0).alias("first"), F.col("starts").alias("stop"), F.col("doc").alias("low"), F.col("at").alias("low_at"))
    each = table(spark, windows(first.where("NOT single"), docs, window), f"{folder}/windows")
    free_shuffles(spark)
    least = each.groupBy("w1", "w2").agg(F.min(F.struct("low", "low_at")).alias("x"))
    several = each.select("gram", "content", "first", "w1", "w2").join(least, ["w1", "w2"])
    several = several.select("gram", "content", "first", (F.col("first") + 1).alias("stop"), F.col("x.low").alias("low"), (F.col("x.low_at") - F.col("first")).alias("low_at"))
    return table(spark, alone.union(several), f"{folder}/decided")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text (the words that stay), n_words, n_removed of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "phrases")
    docs = keyed(docs)
    known = recurring(docs, phrase_places(window), folder, BLOCK_BYTES)
    found = located(docs, known, passages(window), folder, BLOCK_BYTES)
    decided = decisions(docs, found, folder, window)
    for name in ("windows", "first", "contents"):
        drop_dir(spark, f"{folder}/{name}")
    free_shuffles(spark)
    later = (F.col("low") < F.col("doc")) | ((F.col("low") == F.col("doc")) & (F.col("low_at") < F.col("at")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_chunks(batches, limit=BLOCK_BYTES):
            _, _, row = words(data, off, SPACES)
            rows = part.num_rows
            at = np.searchsorted(row, np.arange(rows + 1))
            gone = marked(part, at, len(row), window)
            n, lost = np.diff(at), np.bincount(row[gone], minlength=rows)
            whole, kept = data.tobytes(), []
            for i in range(rows):
                parts = whole[off[i] : off[i + 1]].split()
                if lost[i]:
                    parts = [x for x, g in zip(parts, gone[at[i] : at[i + 1]].tolist(), strict=True) if not g]
                kept.append(b" ".join(parts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n), pa.array(lost)], names=["doc_id", "text", "n_words", "n_removed"])

    return with_gone(docs, found, decided, later, folder).mapInArrow(released(cut), "doc_id long, text string, n_words long, n_removed long")


def op8_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op8_phrases": op8_phrases}

ORACLE = {
    "op8_phrases": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
}
