"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: every slot is a bit mask with one bit per
language, and the AND of an n-gram's slots gives all languages that contain it. A document's n-grams are
looked up, the bits are counted for each language, each count is corrected for the language's rate of
false positives (its share of set slots to the power of the number of probes), and the language with the
largest corrected count wins; the score is its share of all corrected counts.

The filters are fitted on at most FIT_ROWS rows and FIT_BYTES of text of each language (expected; chosen by a hash of the
id; no text of more than FIT_TEXT bytes is learned from), of which the FIT_GRAMS most frequent n-grams enter. Texts are lower-cased (A-Z), other bytes of ASCII than letters become
blanks, and a blank is put at both ends, so every text with a letter has n-grams.

Defined cases: null text and text without a letter: und, score 0; of languages with equal counts the first by name;
repeated rows each get theirs; a text whose n-grams are in no filter
gets the language with most rows, score 1 / languages; rows with a null id or null lang are not learned
from; no row to learn from: all und; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm.common import BYTE_VALUE, LOWER, U64, gram_hashes, raw, read, released, text_chunks

N = 4
PROBES = 3
SLOT_BITS = 18
FIT_ROWS = 400
FIT_GRAMS = 20_000
FIT_BYTES = 8 << 20
FIT_TEXT = 1 << 20
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_CLEAN = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)


def grams(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of the n-grams with a letter; each row is padded with a blank at both ends."""
    rows = len(off) - 1
    if not rows:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(rows), np.diff(off))
    out = np.full(len(data) + 2 * rows, 32, np.uint8)
    out[np.arange(len(data)) + 2 * row + 1] = _CLEAN[LOWER[data]]
    own = np.repeat(np.arange(rows), np.diff(off) + 2)
    h = gram_hashes(BYTE_VALUE[out], n)
    if not len(h):
        return h, np.zeros(0, np.int64)
    letters = np.cumsum(np.concatenate(([0], out != 32)))
    ok = (own[: len(h)] == own[n - 1 :]) & (letters[n:] > letters[:-n])
    return h[ok], own[: len(h)][ok]


class Filters:
    """Bit-sliced Bloom filters of the languages' n-grams, in planes of 8 languages."""

    def __init__(self, langs: list[str], sets: list[np.ndarray], default: int, probes: int = PROBES, bits: int = SLOT_BITS):
        self.langs, self.default, self.probes, self.bits = langs, default, probes, bits
        self.slots = np.zeros((-(-len(langs) // 8) or 1, 1 << bits), np.uint8)
        for i, s in enumerate(sets):
            for p in range(probes):
                self.slots[i // 8, self.slot(s, p)] |= 1 << i % 8
        full = np.stack([(self.slots[i // 8] >> (i % 8) & 1).mean() for i in range(len(langs))]) if langs else np.zeros(0)
        self.false = full**probes

    def slot(self, h: np.ndarray, p: int) -> np.ndarray:
        return ((h >> U64(p * self.bits)) & U64((1 << self.bits) - 1)).astype(np.int64)

    def counts(self, h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Corrected counts, rows x languages."""
        hits = np.zeros((rows, len(self.slots) * 8))
        slot = [self.slot(h, p) for p in range(self.probes)]
        table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)
        for plane, slots in enumerate(self.slots):
            mask = slots[slot[0]]
            for s in slot[1:]:
                mask = mask & slots[s]
            hits[:, plane * 8 : plane * 8 + 8] = np.bincount(row * 256 + mask, minlength=rows * 256).reshape(rows, 256) @ table
        total = np.bincount(row, minlength=rows)[:, None]
        return np.maximum(hits[:, : len(self.langs)] - total * self.false, 0) / np.maximum(1 - self.false, 1e-9)


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, fit_grams: int = FIT_GRAMS) -> Filters:
    """Filters from rows (doc_id, text, lang); nothing but text and lang is learned from."""
    spark = rows.sparkSession
    rows = rows.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    size = F.octet_length("text")
    short = size <= FIT_TEXT
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(short).alias("m"), F.sum(F.when(short, size).otherwise(0)).alias("size")).collect()  # a row for each language
    if not found:
        return Filters([], [], 0)
    per = {r["lang"]: r["n"] for r in found}
    share = {r["lang"]: min(1.0, fit_rows / max(r["m"], 1), FIT_BYTES / max(r["size"], 1)) for r in found}
    rate = F.create_map(*[x for lang, p in share.items() for x in (F.lit(lang), F.lit(p))])
    rows = rows.where(short)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)

    def top(key: tuple, t: pa.Table) -> pa.Table:
        data, off = raw(t.column("text"))
        h, _ = grams(data, off)
        u, c = np.unique(h, return_counts=True)
        best = np.lexsort((u, -c))[:fit_grams]
        return pa.table({"lang": pa.array([key[0].as_py()]), "grams": pa.array([u[best].view(np.int64)], pa.list_(pa.int64()))})

    found = rows.where(draw <= rate[F.col("lang")]).select("lang", "text").groupBy("lang").applyInArrow(top, "lang string, grams array<long>").collect()
    if not found:
        return Filters([], [], 0)
    langs = sorted((r["lang"] for r in found))
    sets = {r["lang"]: np.array(r["grams"], np.int64).view(U64) for r in found}
    most = max(langs, key=lambda x: (per[x], x))
    bits = max(SLOT_BITS, int(np.ceil(np.log2(max(len(s) for s in sets.values()) * 10 + 1))))
    return Filters(langs, [sets[x] for x in langs], langs.index(most), bits=min(bits, 21))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_chunks(batches):
            rows = part.num_rows
            h, row = grams(data, off)
            c = filters.counts(h, row, rows) if filters.langs else np.zeros((rows, 1))
            best, total = c.argmax(1), c.sum(1)
            score = np.where(total > 0, c.max(1) / np.where(total > 0, total, 1), 1 / c.shape[1])
            best = np.where(total > 0, best, filters.default)
            ascii_letters = np.bincount(np.repeat(np.arange(rows), np.diff(off)), weights=((LOWER[data] >= 97) & (LOWER[data] <= 122)), minlength=rows) > 0
            lang = []
            for i in range(rows):
                letter = ascii_letters[i] or any(ch.isalpha() for ch in bytes(data[off[i] : off[i + 1]]).decode("utf-8", "replace"))
                lang.append(filters.langs[best[i]] if letter and filters.langs else UNKNOWN)
            score = np.where([x == UNKNOWN for x in lang], 0.0, score)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(released(work), "doc_id long, lang_pred string, score double")


def fold(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return predict(docs, filters).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language": op5_language}
ORACLE: dict[str, str] = {}
