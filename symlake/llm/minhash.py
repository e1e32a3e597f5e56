"""MinHash near-dedup: fast similarity sketches, banding, exact verification.

A document's set is its distinct shingles of k words. Its sketch has t coordinates, filled in rounds: in
each of the first t rounds every shingle is thrown by a hash into one bin with a value that grows with
the round, and each bin keeps the least; rounds t + j put all shingles into bin j, so every coordinate
fills. Most sets are done after one or two rounds, which is why sketching takes O(n + t log t) instead of
O(n t), and the share of equal coordinates concentrates around the Jaccard similarity.

Documents with equal sets form a class, in which one text stands for all. Sketches are cut into bands of
r coordinates; documents that agree in a band meet in its bucket. Nothing emits all pairs of a bucket:

1. the most popular member of each bucket is compared with the others on full sets, and the components of
   the links found are computed;
2. once more in buckets that still hold several components, with a member outside the first component;
3. what is still apart is compared in all pairs that lie in different components, are of fitting size and
   were not compared before, so that no link is lost that would join components. Members of buckets of more
   than HOT documents, such as those that share a common passage, meet for that by an exact way: the
   shingles are ordered by how often they occur, rarest first, and linked sets have their first common
   shingle so early in both that enough are left for the intersection. The order takes its counts from
   2^SLOTS sums of fixed size; any order that is the same everywhere is exact, a good one makes few pairs.

A pair is compared on full sets if its sketches agree in as many of the t coordinates as sets of the wanted
similarity do but with a chance of 1e-12 (the concentration bound), so that pairs that share a passage and
little else cost 2 t bytes; similarity is then verified on whole sets of 64-bit shingle hashes. A link of
similarity s agrees in no band with probability (1 - s^r)^b: 2e-13 at 0.85, 7e-10 at 0.8. The texts of classes
that share a bucket with another are written once, by class, and only they travel again.

Defined cases: with fewer than k words the whole sequence is the one shingle; without words or text the
set is empty and linked with nothing; rows with a null doc_id are linked with nothing, have a null
component and are kept; rows that share a doc_id are one document for ``near_duplicates``, each with the
links of all its texts (``dedup`` goes by texts, see there); other columns are ignored (``op3``) or kept
(``dedup``); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symlake.llm.common import (
    LOWER,
    SPACES,
    U64,
    free,
    gram_hashes,
    mix,
    raw,
    read,
    released,
    shared_dir,
    span_hashes,
    table,
    text_chunks,
    word_hashes,
    words,
)
from symlake.llm.components import components
from symlake.llm.repeats import keyed

SHINGLE = 5
SIMILARITY = 80  # in hundredths
BANDS = 40
ROWS = 4
#: Members of buckets above HOT meet by their rarest shingles.
HOT = 32
#: Pairs for which a text that is compared with many others travels once.
MATES = 256
#: Bits of the counts that tell rare shingles from frequent ones.
SLOTS = 20
_SEEDS = mix(np.arange(1, 4097, dtype=U64) * U64(0xA24BAED4963EE407))


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data = LOWER[data]
    starts, ends, row = words(data, off, SPACES)
    h = word_hashes(data, starts, ends)
    n = len(off) - 1
    at = np.searchsorted(row, np.arange(n + 1))
    grams = gram_hashes(h, k)
    few = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < k))
    short = dict(zip(few.tolist(), span_hashes(h, at[few], at[few + 1]), strict=True)) if len(few) else {}
    out = []
    for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        out.append(np.unique(grams[lo : hi - k + 1]) if hi - lo >= k else np.array([short[i]] if hi > lo else [], U64))
    return out


def sketch(s: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of a non-empty set: (round << 32 | value), the least in each bin."""
    low = np.full(t, np.iinfo(U64).max, U64)
    i, step = 0, max(1, math.ceil(1.2 * t * math.log(t + 1) / len(s)))
    while i < t:
        rounds = np.arange(i, min(t, i + step), dtype=U64)
        x = mix(s[None, :] ^ _SEEDS[i : i + len(rounds), None])
        bins = ((x >> U64(32)) * U64(t)) >> U64(32)
        np.minimum.at(low, bins.ravel().astype(np.int64), ((x & U64(0xFFFFFFFF)) | (rounds[:, None] << U64(32))).ravel())
        i += len(rounds)
        if (low != np.iinfo(U64).max).all():
            return low
        step = 1
    for j in np.flatnonzero(low == np.iinfo(U64).max):
        low[j] = (mix(s ^ _SEEDS[t + j]) & U64(0xFFFFFFFF)).min() | U64(int(t + j) << 32)
    return low


def band_keys(low: np.ndarray, bands: int) -> np.ndarray:
    rows = low.reshape(bands, -1)
    h = mix(np.arange(bands, dtype=U64) + U64(77))
    for c in range(rows.shape[1]):
        h = mix(h ^ rows[:, c])
    return h.view(np.int64)


def least_agreement(t: int, similarity: int, chance: float = 1e-12) -> int:
    """So many of t coordinates agree in sets of this similarity or more, but with this chance."""
    p, below, k = similarity / 100, 0.0, 0
    while below <= chance and k <= t:
        below += math.comb(t, k) * p**k * (1 - p) ** (t - k)
        k += 1
    return k - 1


def sketches(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, row, n (set size), c1, c2 (128-bit hash of the set), bands (keys) and sig (a byte of each coordinate); both null for an empty set."""
    names = ["doc_id", "row", "n", "c1", "c2", "bands", "sig"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_chunks(batches):
            sets = shingle_sets(data, off, k)
            n = np.array([len(s) for s in sets], np.int64)
            c = np.array([[span_hashes(s, np.array([0]), np.array([len(s)]))[0], mix(s * U64(3) + U64(1)).sum(dtype=U64)] for s in sets], U64).reshape(-1, 2).view(np.int64)
            low = [sketch(s, bands * rows) if len(s) else None for s in sets]
            keys = pa.array([None if x is None else band_keys(x, bands) for x in low], pa.list_(pa.int64()))
            sig = pa.array([None if x is None else (mix(x) & U64(0xFF)).astype(np.uint8).tobytes() for x in low], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(n), pa.array(c[:, 0]), pa.array(c[:, 1]), keys, sig], names=names)

    return docs.select("doc_id", "row", "text").mapInArrow(released(work), "doc_id long, row long, n long, c1 long, c2 long, bands array<long>, sig binary")


def slot_counts(texts: DataFrame, k: int) -> np.ndarray:
    """How many shingles of the texts (in each row: distinct ones) fall in each of 2^SLOTS slots, as uint32 (at most its largest)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SLOTS, np.int64)
        for _, data, off in text_chunks(batches):
            n += np.bincount((np.concatenate(shingle_sets(data, off, k)) >> U64(64 - SLOTS)).astype(np.int64), minlength=1 << SLOTS)
        slot = np.flatnonzero(n)
        for lo in range(0, len(slot), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(slot[lo : lo + (1 << 16)]), pa.array(n[slot[lo : lo + (1 << 16)]])], names=["slot", "n"])

    found = texts.select("text").mapInArrow(released(work), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SLOTS, np.uint32)
    out[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), np.iinfo(np.uint32).max)
    return out


def prefixes(texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """node, n, g, at: of each row of texts (node, text) the shingles that can be the first common one with a linked set, and their places."""
    counts = texts.sparkSession.sparkContext.broadcast(slot_counts(texts, k))  # of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_chunks(batches):
            out = []
            for s in shingle_sets(data, off, k):
                order = np.lexsort((s, counts.value[(s >> U64(64 - SLOTS)).astype(np.int64)]))
                out.append((s[order[: len(s) - -(-similarity * len(s) // 100) + 1]] if len(s) else s, len(s)))
            m = [len(s) for s, _ in out]
            cols = [np.repeat(np.array([n for _, n in out], np.int64), m), np.concatenate([s for s, _ in out]).view(np.int64), np.concatenate([np.arange(x) for x in m])]
            node = part.column("node").take(pa.array(np.repeat(np.arange(len(m)), m)))
            yield pa.RecordBatch.from_arrays([node, *(pa.array(c) for c in cols)], names=["node", "n", "g", "at"])

    return texts.select("node", "text").mapInArrow(released(work), "node long, n long, g long, at long")


def likely(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """Of pairs (a, b) those whose sketches (sigs: node, n, sig) agree in at least so many coordinates."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(raw(b.column(c))[0], np.uint8).reshape(b.num_rows, -1) for c in ("sa", "sb"))
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    sa, sb = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    both = pairs.join(sb.hint("merge"), "b").join(sa.hint("merge"), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(released(work), "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """Of pairs (a, b) those whose sets have 100 * intersection >= similarity * union; texts: node, text.

    A text travels once for each pair in which it is b, and once for every MATES pairs in which it is a.
    Texts are never broadcast, however few.
    """
    count = pairs.groupBy("a").agg(F.count("*").alias("m"))
    deal = F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / MATES)).cast("int")
    right = pairs.join(texts.hint("merge").select(F.col("node").alias("b"), "text"), "b").join(count, "a").select("a", deal.alias("part"), "b", "text")
    left = count.join(texts.hint("merge").select(F.col("node").alias("a"), "text"), "a")
    left = left.select("a", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("m") / MATES) - 1).cast("int"))).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    n = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: list[np.ndarray] = []  # the sets of node
        node = before = None
        for part, data, off in text_chunks(batches):
            good = []
            for i, (s, a, b) in enumerate(zip(shingle_sets(data, off, k), part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)):
                if b is None:
                    mine = [s] if a != node or before is not None else [*mine, s]
                    node = a
                elif any(100 * (same := len(x) + len(s) - len(np.union1d(x, s))) >= similarity * (len(x) + len(s) - same) and same for x in mine):
                    good.append(i)
                before = b
            yield part.select(["a", "b"]).take(pa.array(good, pa.int64()))

    dealt = left.union(right).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(released(work), "a long, b long").distinct()


def classes(docs: DataFrame, folder: str, k: int, similarity: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketch of every row; the classes of equal sets: c1, c2 and node, the class's name; and (u, v): nodes that aren't their component's first, and that."""
    spark = docs.sparkSession
    size_ok = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * similarity
    sk = table(spark, sketches(docs, k, bands, rows), f"{folder}/sketches", small=True)
    reps = sk.where("doc_id IS NOT NULL AND n > 0").groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "row")).alias("x"), *[F.first(c).alias(c) for c in ("n", "bands", "sig")])
    reps = table(spark, reps.withColumn("node", F.xxhash64("c1", "c2")), f"{folder}/classes")
    sizes, sigs = reps.select("node", "n"), reps.select("node", "sig")
    member = reps.select("node", F.explode("bands").alias("key"))
    full = member.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    multi = table(spark, member.join(full, "key"), f"{folder}/buckets")
    near = multi.groupBy("node").agg(F.sum("m").alias("pop"))
    places = reps.join(near, "node").select("node", "n", "pop", "x.*")
    places = table(spark, places, f"{folder}/near", small=True)
    multi = table(spark, multi.join(places.select("node", "n", "pop"), "node"), f"{folder}/popular")
    texts = docs.where("doc_id IS NOT NULL").join(places.hint("merge").select("node", "doc_id", "row"), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]).select("node", "text")
    texts = table(spark, texts, f"{folder}/texts")
    least = least_agreement(bands * rows, similarity)

    tested = found = None
    group = None
    for step in ("first", "second", "all"):
        here = multi
        if group is not None:
            moved = group.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            here = multi.join(moved, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            apart = here.groupBy("key").agg(F.min("comp").alias("c_lo"), F.max("comp").alias("c_hi")).where("c_lo != c_hi")
            here = table(spark, here.join(apart.select("key", "c_lo"), "key"), f"{folder}/apart-{step}", small=True)
            if not here.take(1):
                break
        else:
            here = here.withColumn("comp", F.col("node"))
        if step == "all":
            crowded = here.where(F.col("m") > HOT).select("node", "comp").distinct()
            again = texts.join(crowded.select("node"), "node", "left_semi")
            rare = table(spark, prefixes(again, k, similarity).join(crowded, "node"), f"{folder}/rare", small=True)
            mixed = rare.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("g")
            rare = table(spark, rare.join(mixed, "g"), f"{folder}/rare-mixed")
            small = here.where(F.col("m") <= HOT).select(F.col("key").alias("g"), "node", "n", "comp")

            def apart_pairs(members: DataFrame, fits: Column) -> DataFrame:
                mate = members.select("g", *[F.col(c).alias(f"b_{c}") for c in members.columns if c != "g"])
                both = members.join(mate, "g").where((F.col("node") < F.col("b_node")) & (F.col("comp") != F.col("b_comp")) & size_ok(F.col("n"), F.col("b_n")) & fits)
                return both.select(F.col("node").alias("a"), F.col("b_node").alias("b"))

            # similarity s needs an intersection of s / (1 + s) of both sizes
            enough = F.least(F.col("n") - F.col("at"), F.col("b_n") - F.col("b_at")) * (100 + similarity) >= (F.col("n") + F.col("b_n")) * similarity
            pairs = apart_pairs(small, F.lit(True)).union(apart_pairs(rare, enough))
        else:
            lead = here if group is None else here.where("comp != c_lo")
            lead = lead.groupBy("key").agg(F.max_by(F.struct("node", "n", "comp"), F.struct("pop", "node")).alias("x")).select("key", F.col("x.node").alias("a"), F.col("x.n").alias("an"), F.col("x.comp").alias("ac"))
            pairs = here.join(lead, "key").where((F.col("node") != F.col("a")) & (F.col("comp") != F.col("ac")) & size_ok(F.col("n"), F.col("an")))
            pairs = pairs.select("a", F.col("node").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "b").dropDuplicates(["x", "y"])
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = table(spark, pairs, f"{folder}/pairs-{step}", small=True)
        if not pairs.take(1):
            if step == "first":
                break
            continue
        now = pairs.select("x", "y")
        tested = now if tested is None else tested.union(now)
        close = table(spark, likely(pairs.select("a", "b"), sigs, least), f"{folder}/likely-{step}")
        ok = table(spark, verify(close, texts, k, similarity), f"{folder}/ok-{step}").toDF("u", "v")
        found = ok if found is None else found.union(ok)
        group = components(found, f"{folder}/components-{step}")
    if group is None:
        group = spark.createDataFrame([], "u long, v long")
    return sk, reps.select("c1", "c2", "node"), group


def placed(sk: DataFrame, cls: DataFrame, group: DataFrame) -> DataFrame:
    """doc_id, row, n and comp (null without words or id) of every row."""
    cls = cls.join(group.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left").select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.coalesce("comp", "node").alias("comp"))
    out = sk.join(cls, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "row", "n", "comp")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "minhash")
    sk, cls, group = classes(keyed(docs), folder, k, similarity, bands, rows)
    at = table(spark, placed(sk, cls, group), f"{folder}/placed")
    # rows that share an id are one document: their components are one
    ids = at.where("doc_id IS NOT NULL AND comp IS NOT NULL").groupBy("doc_id").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    shared = ids.where("lo != hi").select("doc_id", "lo")
    links = table(spark, at.join(shared, "doc_id").where("comp != lo").select(F.col("comp").alias("u"), F.col("lo").alias("v")), f"{folder}/shared")
    if links.take(1):
        more = components(links, f"{folder}/components-shared").select(F.col("u").alias("comp"), "v")
        at = at.join(more, "comp", "left").withColumn("comp", F.coalesce("v", "comp"))
    first = at.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = at.join(first, "comp", "left")
    comp = F.coalesce("least", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs, all columns, but for those linked to a row with a smaller id.

    Links are between texts here: of rows that share an id but not a text each goes with its own text's group, in
    which the row with the least id, then the least hash of the text, stays; of rows alike in id and text the one with the
    least hash of all columns.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "minhash-dedup")
    at = placed(*classes(keyed(docs), folder, k, similarity, bands, rows))
    at = table(spark, at.where("doc_id IS NOT NULL AND comp IS NOT NULL").select("doc_id", "row", "comp"), f"{folder}/placed")
    first = at.groupBy("comp").agg(F.min(F.struct("doc_id", "row")).alias("x"))
    i, r, n = (free(c, docs.columns) for c in ("id", "row", "nth"))
    gone = at.join(first, "comp").where((F.col("x.doc_id") != F.col("doc_id")) | (F.col("x.row") != F.col("row")))
    gone = table(spark, gone.select(F.col("doc_id").alias(i), F.col("row").alias(r)).distinct(), f"{folder}/gone")
    kept = docs.columns
    doc_id = docs["doc_id"].cast("long")
    # documents travel once: rows alike in id and text meet where those that are gone are left out
    left = docs.withColumn(i, doc_id).withColumn(r, F.xxhash64(doc_id, docs["text"])).join(gone.hint("merge"), [i, r], "left_anti")
    tie = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    left = left.withColumn(n, F.row_number().over(Window.partitionBy(i, r).orderBy(tie)))
    return left.where(F.col(i).isNull() | (F.col(n) == 1)).select(*kept)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=3, similarity=85)


QUERIES = {"op3_minhash": op3_minhash}

ORACLE = {
    "op3_minhash": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS s FROM d),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
cls AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(s), chr(10)))) AS c FROM (SELECT doc_id, len(s) AS n, s FROM sets WHERE len(s) > 0)),
rep AS (SELECT DISTINCT c, n FROM cls),
shr AS (SELECT sh.doc_id AS c, sh.n, g FROM sh JOIN rep ON sh.doc_id = rep.c),
rare AS (SELECT g FROM shr GROUP BY g HAVING count(*) > 1),
cnt AS (SELECT a.c AS a, b.c AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS x
  FROM shr a JOIN rare USING (g) JOIN shr b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS (SELECT a, b FROM cnt WHERE 100 * x >= 85 * (na + nb - x)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT c, c AS r FROM rep UNION SELECT e2.a, reach.r FROM reach JOIN e2 ON e2.b = reach.c),
comp AS (SELECT c, min(r) AS k FROM reach GROUP BY c)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(comp.k, sets.doc_id) AS component_id, coalesce(comp.k, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN cls USING (doc_id) LEFT JOIN comp ON cls.c = comp.c
"""
}
