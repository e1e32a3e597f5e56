"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Vectors are centred on the mean of all vectors, turned into STRETCH * d dimensions by a fixed random matrix
with orthonormal rows (a random rotation of the vector behind zeros) and kept as their signs, packed into
64-bit words, with two scalars: the length r of the centred vector and the cosine f between its rotated
direction and its code. A query is rotated alike and cut to 4 bits a component, kept as 4 bit planes. The inner
product with a code then is a weighted sum of popcounts of (code and plane); over f it estimates <q, o - c> / r
without bias, with a standard error of at most

    |q| * sqrt((1 - f^2) / f^2) / sqrt(D - 1)        D = STRETCH * d

plus that of the 4 bits. Its error bound is EPSILON times that. A query's floor is the score of its k-th best
vector so far: first among the SAMPLE vectors with the least id hashes, scored exactly, and then whatever has
been reranked. Only vectors whose upper bound reaches the floor are reranked, on the original vectors.

Every row is coded and every code is compared with every query that the contract names, in blocks; there are
no lists to probe, so nothing is missed but by an error bound's failure. On vectors without structure about 3 %
of all pairs are reranked (``search_block`` counts them), on others fewer. Equal vectors are one class, searched
once and compared once; its members with the k + 1 smallest ids stand for it, so copies cost nothing.

Query classes lie in files of bounded size in the shared folder. A task works on CODES codes at a time against
one file after the other and passes on at most k + 1 classes for each query, fewer once the floors are high.

Defined cases: rows with a null id, a null vector, null or non-finite components or only zeros take no part;
a query meets the vectors of its own length, as inner products need equal lengths; a query id that repeats is
searched once, with its least vector; candidate rows that repeat an id are candidates each; ties go to the
smaller id; fewer candidates than k give fewer rows; other columns are ignored; no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symlake.llm.common import U64, mix, read, read_shard, released, shared_dir, table, write_shards

K = 20
EVERY = 20
EPSILON = 3.5
STRETCH = 8
PLANES = 4
QUERY_ROWS = 4096
#: Codes that a task holds at once.
CODES = 1 << 16
#: Vectors whose exact scores give the first floors.
SAMPLE = 4096
_Q, _C = 64, 4096  # queries and codes of a block
CODE = "k1 long, k2 long, vec_id long, vec array<double>, code binary, r double, f double"
FOUND = "q1 long, q2 long, k1 long, k2 long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (doubles) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.where(~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0))


def rotation(d: int, seed: int = 7, stretch: int = STRETCH) -> np.ndarray:
    """d orthonormal rows of a random rotation of at least stretch * d dimensions, a multiple of 64."""
    wide = -(-stretch * d // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, d)))
    return (q * np.sign(np.diag(r))).T


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def keyed(v: DataFrame) -> DataFrame:
    """v with k1, k2: 128 bits of the vector, alike for 0.0 and -0.0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = (_matrix(b.column("vec")) + 0.0).view(U64) if b.num_rows else np.zeros((0, 1), U64)
            place = mix(np.arange(1, x.shape[1] + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
            k1, k2 = (mix(mix(x ^ place) * m + place).sum(1, dtype=U64).view(np.int64) for m in (U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25)))
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), b.column("vec_id"), b.column("vec")], names=["k1", "k2", "vec_id", "vec"])

    return v.mapInArrow(released(work), "k1 long, k2 long, vec_id long, vec array<double>")


def mean(v: DataFrame) -> np.ndarray:
    """The mean over all rows; each task sends one sum."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                s = _matrix(b.column("vec")).sum(0)
                total, n = s if total is None else total + s, n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=["s", "n"])

    sums = v.mapInArrow(part, "s array<double>, n long").collect()
    return np.sum([r["s"] for r in sums], 0) / sum(r["n"] for r in sums)


def codes_of(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed codes of the vectors x, the lengths r and the cosines f."""
    r = np.linalg.norm(x - centre, axis=1)
    y = (x - centre) @ turn
    f = np.abs(y).sum(1) / np.sqrt(turn.shape[1]) / np.where(r > 0, r, 1)
    return np.packbits(y > 0, axis=1, bitorder="little").view("<u8"), r, np.where(r > 0, f, 1.0)


def encode(v: DataFrame, centre: np.ndarray, turn: np.ndarray) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code, r, f = codes_of(_matrix(b.column("vec")), centre, turn)
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("k1", "k2", "vec_id", "vec")] + [pa.array([row.tobytes() for row in code], pa.binary()), pa.array(r), pa.array(f)], names=["k1", "k2", "vec_id", "vec", "code", "r", "f"])

    return v.mapInArrow(released(work), CODE)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added up in order of components as SQL engines do."""
    s = np.zeros(len(q))
    for j in range(q.shape[1]):
        s = s + q[:, j] * x[:, j]
    return s


class Queries:
    """Queries of a file, rotated and cut to bit planes."""

    def __init__(self, q: np.ndarray, floor: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.q, self.floor = q, floor
        y = q @ turn
        low = y.min(1)
        self.step = np.maximum((y.max(1) - low) / ((1 << PLANES) - 1), 1e-300)
        level = np.rint((y - low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = np.stack([np.packbits(level >> j & 1, axis=1, bitorder="little").view("<u8") for j in range(PLANES)])
        self.low, self.sum = low, low * y.shape[1] + self.step * level.sum(1, dtype=np.int64)
        self.base, self.norm = q @ centre, np.linalg.norm(q, axis=1)


def popcounts(planes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The sum over planes j of 2^j * popcount(plane j and code), for each query and code."""
    out = np.zeros((planes.shape[1], len(code)), np.uint16 if code.shape[1] * 64 * (1 << PLANES) < 1 << 16 else np.uint32)
    columns = [np.ascontiguousarray(code[:, w]) for w in range(code.shape[1])]
    both = np.empty(out.shape, U64)
    for j in reversed(range(PLANES)):
        out <<= 1
        for w, column in enumerate(columns):
            np.bitwise_and(planes[j, :, w, None], column, out=both)
            out += np.bitwise_count(both)
    return out


def search_block(s: Queries, at: slice, code: np.ndarray, ones: np.ndarray, r: np.ndarray, f: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, code) of the pairs in a block whose upper bound reaches the query's floor."""
    wide = code.shape[1] * 64
    g = (r / f / np.sqrt(wide)).astype(np.float32)
    step, low, norm = (x[at].astype(np.float32)[:, None] for x in (s.step, s.low, s.norm))
    up = popcounts(s.planes[:, at], code).astype(np.float32)
    up *= 2 * step
    up += 2 * low * ones - s.sum[at].astype(np.float32)[:, None]  # the code's inner product with the rotated query
    up *= g
    spread = (r * np.sqrt(np.maximum(1 - f * f, 0)) / f / np.sqrt(max(wide - 1, 1))).astype(np.float32)
    up += epsilon * np.hypot(norm * spread, step / np.float32(np.sqrt(12)) * (r / f).astype(np.float32))
    need = s.floor[at] - s.base[at]
    return np.nonzero(up >= (need - 1e-5 * (1 + np.abs(need))).astype(np.float32)[:, None])


def search_codes(s: Queries, x: np.ndarray, code: np.ndarray, r: np.ndarray, f: np.ndarray, ids: np.ndarray, k: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, code, score) of each query's k best codes, as far as they reach its floor, and how many were reranked.

    The floors of s rise while the codes are searched, and stay risen.
    """
    ones = np.bitwise_count(code).sum(1).astype(np.float32)
    out, reranked = [], 0
    for a in range(0, len(s.q), _Q):
        at = slice(a, min(a + _Q, len(s.q)))
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for lo in range(0, len(code), _C):
            z = slice(lo, lo + _C)
            qi, ci = search_block(s, at, code[z], ones[z], r[z], f[z], epsilon)
            reranked += len(qi)
            qi, ci = qi + a, ci + lo
            score = np.empty(len(qi))
            for p in range(0, len(qi), 1 << 15):
                score[p : p + (1 << 15)] = exact(s.q[qi[p : p + (1 << 15)]], x[ci[p : p + (1 << 15)]])
            ok = score >= s.floor[qi]
            qi, ci, score = (np.concatenate((u, v[ok])) for u, v in zip(best, (qi, ci, score), strict=True))
            order = np.lexsort((ids[ci], -score, qi))
            qi, ci, score = qi[order], ci[order], score[order]
            rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
            full = rank == k - 1
            s.floor[qi[full]] = np.maximum(s.floor[qi[full]], score[full])
            best = qi[rank < k], ci[rank < k], score[rank < k]
        out.append(best)
    qi, ci, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return qi, ci, score, reranked


def first_floors(q: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A score that k vectors of the sample reach; no floor if it has fewer."""
    if len(sample) < k:
        return np.full(len(q), -np.inf)
    out = np.empty(len(q))
    for lo in range(0, len(q), 1024):
        score = q[lo : lo + 1024] @ sample.T
        out[lo : lo + 1024] = np.partition(score, -k, axis=1)[:, -k]
    return out - 1e-9 * (1 + np.abs(out))


def _search(v: DataFrame, asked: DataFrame, d: int, folder: str, k: int, epsilon: float, seed: int) -> DataFrame:
    """q1, q2, rank, vec_id, score: the k + 1 rows of v (vectors of length d) nearest to each class of asked."""
    spark = v.sparkSession
    by_class = Window.partitionBy("k1", "k2").orderBy("vec_id")
    v = table(spark, keyed(v).withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= k + 1), f"{folder}/classes")
    members = v.select("k1", "k2", F.col("vec_id").alias("member"))
    one = v.where("nth = 1").drop("nth")
    centre, turn = mean(one), rotation(d, seed)
    order = F.xxhash64("k1", "k2")
    sample = one.select("vec", order.alias("h"), "k1", "k2").orderBy("h", "k1", "k2").limit(SAMPLE).select("vec").toArrow()  # SAMPLE rows at most
    sample = _matrix(sample.column("vec"))
    codes = encode(one, centre, turn)
    asked = asked.groupBy("k1", "k2").agg(F.min_by("vec", "vec_id").alias("vec")).select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), "vec")
    files = write_shards(spark, asked, ["q1", "q2"], f"{folder}/queries", QUERY_ROWS)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            x, (r, f, ids, k1, k2) = _matrix(t.column("vec")), (t.column(c).to_numpy() for c in ("r", "f", "vec_id", "k1", "k2"))
            code = np.frombuffer(b"".join(t.column("code").to_pylist()), "<u8").reshape(len(x), -1)
            for uri in files:
                a = read_shard(uri)
                q = _matrix(a.column("vec"))
                s = Queries(q, first_floors(q, sample, k + 1), centre, turn)
                qi, ci, score, _ = search_codes(s, x, code, r, f, ids, k + 1, epsilon)
                cols = (a.column("q1").to_numpy()[qi], a.column("q2").to_numpy()[qi], k1[ci], k2[ci], ids[ci], score)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["q1", "q2", "k1", "k2", "vec_id", "score"])

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= CODES:
                yield from found()
        if held:
            yield from found()

    best = codes.repartition(n).mapInArrow(released(work), FOUND)
    near = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k + 1).drop("vec_id", "place")
    rows = best.join(members, ["k1", "k2"]).select("q1", "q2", F.col("member").alias("vec_id"), "score")
    return rows.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k + 1)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, epsilon: float = EPSILON, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors to each row of queries (both vec_id, embedding)."""
    spark = vectors.sparkSession
    folder = shared_dir(spark, "vectors")
    v, asked = table(spark, usable(vectors), f"{folder}/vectors"), usable(queries)
    asked = table(spark, asked.groupBy("vec_id").agg(F.min("vec").alias("vec")), f"{folder}/asked")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = [r[0] for r in asked.select(F.size("vec").alias("d")).distinct().join(v.select(F.size("vec").alias("d")).distinct(), "d").collect()]  # one row a length
    for d in sorted(lengths):
        mine = table(spark, keyed(asked.where(F.size("vec") == d)), f"{folder}/asked-{d}")
        near = _search(v.where(F.size("vec") == d), mine, d, f"{folder}/{d}", k, epsilon, seed)
        each = mine.select(F.col("vec_id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        rows = each.join(near, ["q1", "q2"]).where("vec_id != query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = out.union(rows.select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
    return out


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return search(v, v.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op10_vectors": op10_vectors}

ORACLE = {
    "op10_vectors": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id != c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
}
