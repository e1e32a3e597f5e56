"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is cut into lower-case words; every word is read through

* word inputs: an embedding of its hash and the strength of the hash's association with the label,
* character inputs: the mean embedding of its 4-grams and, for 3-, 4- and 5-grams, the strongest
  association of a gram with the label.

Windows of WINDOW words overlap by WINDOW - STRIDE and cover the whole text. A gated recurrent unit runs
over a window in each direction, attention weighs the positions, and the pooled state gives the window's
logit; the document's score is that of its highest window. Labels are known for documents only, so in
training each document teaches through the window that is highest so far.

Associations are smoothed log odds of presence in labelled documents, nearer to 0 by their standard error, so
that few positive documents tell a word that marks them from one that is merely rare. While the network is
trained they come from the other parts of the sample, so that they are as reliable as on new texts. The
sample has at most FIT_ROWS documents and FIT_BYTES of text of each label (expected; drawn by a hash of the id; no
text of more than FIT_TEXT bytes is learned from); the threshold is set for the labels' own frequencies.

Defined cases: null or empty text and text without words: the toxic share of the labels, below 0.5;
labels that are null or neither 0 nor 1, ids with both labels and rows with a null id are not learned from; without labels of
both kinds every score is that share (0 without labels); repeated documents each get their row, and of
texts that share an id the least is learned from; other
columns are ignored (``score``) or kept (``keep_clean``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm.common import BYTE_VALUE, CHUNK_BYTES, LOWER, NOT_ALNUM, U64, gram_hashes, raw, read, released, text_chunks, trim, word_hashes, words

WINDOW, STRIDE = 64, 48
FIT_ROWS = 1000
FIT_BYTES = 4 << 20
FIT_TEXT = 1 << 20
EPOCHS = 5
#: Parts of the sample; a part's associations come from the others.
FOLDS = 4
STEPS = 400  # at least, however few documents there are
HIDDEN = 8
EMBED = 4
ORDERS = (3, 4, 5)
_TABLE = 16  # bits of the association tables
_EMBED = 12  # bits of the embedding tables
_BATCH = 1024
#: Pull of the embeddings to 0, so that few documents aren't learned by heart.
DECAY = 5.0
_F = np.float32


def fold(doc_id: Column, of: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of


# --- inputs --------------------------------------------------------------------------------------


@dataclass
class Vocab:
    """The distinct words of a chunk, by what the inputs need of them."""

    inverse: np.ndarray  # word of the text -> distinct word
    row: np.ndarray  # word of the text -> document
    word: np.ndarray  # hash of each distinct word
    grams: dict  # order -> (hashes, first gram of each distinct word)


def vocab(data: np.ndarray, off: np.ndarray) -> Vocab:
    data = LOWER[data]
    found, lo = [], 0
    while lo < len(off) - 1:  # blocks of documents, as hashing takes many times the bytes
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK_BYTES, "right")) - 1)
        block = data[off[lo] : off[hi]]
        starts, ends, row = words(block, off[lo : hi + 1] - off[lo], NOT_ALNUM)
        found.append((word_hashes(block, starts, ends), starts + off[lo], ends + off[lo], row + lo))
        lo = hi
    h, starts, ends, row = (np.concatenate(x) for x in zip(*found, strict=True))
    word, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    # the distinct words one after the other, each with a blank at both ends
    n = ends[first] - starts[first]
    at = np.concatenate(([0], np.cumsum(n + 2)))
    text = np.full(at[-1], 32, np.uint8)
    of = np.repeat(np.arange(len(n)), n)
    text[np.arange(len(of)) + 2 * of + 1] = data[np.arange(len(of)) - (np.cumsum(n) - n)[of] + starts[first][of]]
    value = BYTE_VALUE[text]
    owner = np.repeat(np.arange(len(n)), n + 2)
    grams = {}
    for k in ORDERS:
        g = gram_hashes(value, k)
        own = owner[: len(g)]
        ok = own == owner[k - 1 :] if len(g) else np.zeros(0, bool)
        g, own = g[ok], own[ok]
        grams[k] = (g, own)
    return Vocab(inverse, row, word, grams)


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64)


def associations(v: Vocab, label: np.ndarray) -> dict[int, np.ndarray]:
    """Tables of association by hash slot: 0 for words, k for k-grams; label of each row, -1: not used."""
    used = label >= 0
    pos, neg = int((label == 1).sum()), int((label == 0).sum())
    out = {}
    pair = np.unique(v.row * (len(v.word) + 1) + v.inverse) if len(v.row) else np.zeros(0, np.int64)
    doc, word = pair // (len(v.word) + 1), pair % (len(v.word) + 1)
    doc, word = doc[used[doc]], word[used[doc]]
    cuts = np.unique(np.concatenate((np.searchsorted(doc, np.arange(0, len(label), 128)), [len(doc)])))  # documents in blocks, for bounded memory
    for k in (0, *ORDERS):
        p, n = np.full(1 << _TABLE, 0.5), np.full(1 << _TABLE, 0.5)
        if k:
            g, own = v.grams[k]
            order = np.argsort(own, kind="stable")
            lo = np.searchsorted(own[order], np.arange(len(v.word) + 1))
            count = np.diff(lo)
            slot = _slot(g[order], _TABLE)
        else:
            lo, count, slot = np.arange(len(v.word)), np.ones(len(v.word), np.int64), _slot(v.word, _TABLE)
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            d, w = doc[start:end], word[start:end]
            m = count[w]
            d = np.repeat(d, m)
            s = slot[np.repeat(lo[w], m) + np.arange(len(d)) - np.repeat(np.cumsum(m) - m, m)]
            both = np.unique(d * (1 << _TABLE) + s)
            d, s = both >> _TABLE, both & ((1 << _TABLE) - 1)
            p += np.bincount(s[label[d] == 1], minlength=1 << _TABLE)
            n += np.bincount(s[label[d] == 0], minlength=1 << _TABLE)
        odds = np.log(p / (pos + 1)) - np.log(n / (neg + 1))
        sure = np.sign(odds) * np.maximum(np.abs(odds) - np.sqrt(1 / p + 1 / n), 0)
        out[k] = np.tanh(sure / 2).astype(_F)
    return out


def subset(v: Vocab, which: np.ndarray) -> Vocab:
    """The vocabulary of some distinct words alone."""
    g, own = v.grams[4]
    lo, hi = np.searchsorted(own, which, "left"), np.searchsorted(own, which, "right")
    n = hi - lo
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return Vocab(np.zeros(0, np.int64), np.zeros(0, np.int64), v.word[which], {4: (g[at], np.repeat(np.arange(len(which)), n))})


def inputs(v: Vocab, table: dict[int, np.ndarray], m: dict[str, np.ndarray], fixed: np.ndarray | None = None) -> np.ndarray:
    """The input vector of each distinct word; fixed: its associations, if they are known already."""
    u = len(v.word)
    x = np.zeros((u, 1 + len(ORDERS) + 2 * EMBED), _F)
    at = 1 + len(ORDERS)
    x[:, at : at + EMBED] = m["words"][_slot(v.word, _EMBED)]
    x[:, at + EMBED :] = _char_mean(v, m["chars"])
    if fixed is not None:
        x[:, :at] = fixed
        return x
    x[:, 0] = table[0][_slot(v.word, _TABLE)]
    for i, k in enumerate(ORDERS):
        g, own = v.grams[k]
        if len(g):
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            x[own[first], 1 + i] = np.maximum.reduceat(table[k][_slot(g, _TABLE)], first)
    return x


def _char_mean(v: Vocab, chars: np.ndarray) -> np.ndarray:
    out = np.zeros((len(v.word), EMBED), _F)
    g, own = v.grams[4]
    if len(g):
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        n = np.diff(np.concatenate((first, [len(own)])))
        out[own[first]] = np.add.reduceat(chars[_slot(g, _EMBED)], first, axis=0) / n[:, None]
    return out


def windows(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and document of all overlapping windows."""
    at = np.searchsorted(row, np.arange(rows + 1))
    n = np.diff(at)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(rows), count)
    start = at[doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    return start, np.minimum(WINDOW, at[doc + 1] - start), doc


# --- network -------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start_weights(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = 1 + len(ORDERS) + 2 * EMBED, HIDDEN
    m = {"words": rng.normal(0, 0.1, (1 << _EMBED, EMBED)), "chars": rng.normal(0, 0.1, (1 << _EMBED, EMBED))}
    for way in "fb":
        m |= {f"W{way}": rng.normal(0, d**-0.5, (d, 3 * h)), f"U{way}": rng.normal(0, h**-0.5, (h, 3 * h)), f"c{way}": np.zeros(3 * h)}
        m |= {f"q{way}": rng.normal(0, h**-0.5, h), f"w{way}": rng.normal(0, h**-0.5, h)}
    m["bias"] = np.zeros(1)
    return {k: v.astype(_F) for k, v in m.items()}


def forward(m: dict, p: dict[str, np.ndarray], word: np.ndarray, start: np.ndarray, length: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    """Logits of windows in order of falling length; p: input projections of the distinct words for each direction."""
    n, steps, h = len(start), int(length[0]), HIDDEN
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(steps)]  # windows longer than t come first
    score, value = np.full((n, steps), -np.inf, _F), np.zeros((n, steps), _F)
    tape: dict = {"live": live}
    part = {}
    for way in "fb":
        u, state = m[f"U{way}"], np.zeros((n, h), _F)
        uz, un = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        s, val, kept = np.zeros((n, steps), _F), np.zeros((n, steps), _F), []
        for t in range(steps):
            a = live[t]
            spot = start[:a] + t if way == "f" else start[:a] + length[:a] - 1 - t
            g, old = p[way][word[spot]], state[:a]
            zr = _sigmoid(g[:, : 2 * h] + old @ uz)
            z, r = zr[:, :h], zr[:, h:]
            new = 2 * _sigmoid(2 * (g[:, 2 * h :] + (r * old) @ un)) - 1
            now = z * old + (1 - z) * new
            at = t if way == "f" else (length[:a] - 1 - t)
            idx = np.arange(a)
            s[idx, at], val[idx, at] = now @ m[f"q{way}"], now @ m[f"w{way}"]
            if keep:
                kept.append((spot, old.copy(), z, r, new, now))
            state[:a] = now
        part[way] = (s, val)
        tape[way] = kept
    inside = np.arange(steps)[None, :] < length[:, None]
    score = np.where(inside, part["f"][0] + part["b"][0], -np.inf)
    value = part["f"][1] + part["b"][1]
    e = np.exp(score - score.max(1, keepdims=True))
    weight = e / e.sum(1, keepdims=True)
    logit = (weight * value).sum(1) + m["bias"][0]
    if keep:
        tape |= {"weight": weight, "value": value, "pooled": (weight * value).sum(1)}
    return logit, tape


def backward(m: dict, x: np.ndarray, word: np.ndarray, start: np.ndarray, length: np.ndarray, tape: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights, and of the distinct words' inputs."""
    h = HIDDEN
    g = {k: np.zeros_like(m[k]) for k in m if k not in ("words", "chars")}
    dx = np.zeros_like(x)
    weight, value = tape["weight"], tape["value"]
    dvalue = weight * dlogit[:, None]
    dscore = weight * (value - tape["pooled"][:, None]) * dlogit[:, None]
    g["bias"][0] = dlogit.sum()
    for way in "fb":
        u, q, w = m[f"U{way}"], m[f"q{way}"], m[f"w{way}"]
        dstate = np.zeros((len(start), h), _F)
        for t in reversed(range(len(tape["live"]))):
            a = tape["live"][t]
            spot, old, z, r, new, now = tape[way][t]
            at = t if way == "f" else (length[:a] - 1 - t)
            idx = np.arange(a)
            ds, dv = dscore[idx, at][:, None], dvalue[idx, at][:, None]
            g[f"q{way}"] += (ds * now).sum(0)
            g[f"w{way}"] += (dv * now).sum(0)
            dh = dstate[:a] + ds * q + dv * w
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (old - new) * z * (1 - z)
            drh = dnew @ u[:, 2 * h :].T
            dr = drh * old * r * (1 - r)
            dg = np.concatenate((dz, dr, dnew), 1)
            g[f"U{way}"][:, : 2 * h] += old.T @ dg[:, : 2 * h]
            g[f"U{way}"][:, 2 * h :] += (r * old).T @ dnew
            dstate[:a] = dh * z + drh * r + dg[:, : 2 * h] @ u[:, : 2 * h].T
            who = word[spot]
            g[f"W{way}"] += x[who].T @ dg
            g[f"c{way}"] += dg.sum(0)
            np.add.at(dx, who, dg @ m[f"W{way}"].T)
    return g, dx


def _projections(m: dict, x: np.ndarray) -> dict[str, np.ndarray]:
    return {way: x @ m[f"W{way}"] + m[f"c{way}"] for way in "fb"}


def window_logits(m: dict, p: dict, v: Vocab, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), _F)
    order = np.argsort(-length, kind="stable")
    for lo in range(0, len(order), _BATCH):
        at = order[lo : lo + _BATCH]
        out[at] = forward(m, p, v.inverse, start[at], length[at])[0]
    return out


@dataclass
class Model:
    weights: dict | None
    table: dict | None
    threshold: float
    prior: float

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        rows = len(off) - 1
        out = np.full(rows, self.prior)
        if self.weights is None or not len(data):
            return out
        v = vocab(data, off)
        start, length, doc = windows(v.row, rows)
        if len(start):
            logit = window_logits(self.weights, _projections(self.weights, inputs(v, self.table, self.weights)), v, start, length)
            best = np.full(rows, -np.inf)
            np.maximum.at(best, doc, logit.astype(float))
            out = np.where(best > -np.inf, _sigmoid(best - self.threshold), out)
        return out


def train(texts: list[bytes], label: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """share: of label 1 among all labels, for the threshold."""
    prior = float(min(share, 0.49))
    if len(set(label.tolist())) < 2:
        return Model(None, None, 0.0, prior)
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    v = vocab(data, off)
    rng = np.random.default_rng(seed)
    half = rng.permutation(len(texts)) % FOLDS
    m = start_weights(seed)
    tables = [associations(v, np.where(half != i, label, -1)) for i in range(FOLDS)]  # for part i, from the others
    start, length, doc = windows(v.row, len(texts))
    groups = [np.flatnonzero(half[doc] == i) for i in range(FOLDS)]
    moment = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in m.items()}
    step = 0

    e = 1 + len(ORDERS)
    fixed = [inputs(v, t, m)[:, :e].copy() for t in tables]

    def logits() -> np.ndarray:
        out = np.zeros(len(start), _F)
        for i in range(FOLDS):
            out[groups[i]] = window_logits(m, _projections(m, inputs(v, tables[i], m, fixed[i])), v, start[groups[i]], length[groups[i]])
        return out

    size = int(np.clip(len(texts) // 24, 8, 64))
    rounds = max(epochs, -(-STEPS // max(1, len(texts) // size)))
    for turn in range(rounds):
        if turn % max(1, rounds // epochs) == 0:
            now = logits()
            order = np.lexsort((-now, doc))
            top = order[np.concatenate(([True], doc[order][1:] != doc[order][:-1]))]  # the highest window of each document
        for i in range(FOLDS):
            mine = rng.permutation(top[half[doc[top]] == i])
            for lo in range(0, len(mine), size):
                at = mine[lo : lo + size]
                at = at[np.argsort(-length[at], kind="stable")]
                first = np.cumsum(length[at]) - length[at]
                spots = np.repeat(start[at] - first, length[at]) + np.arange(length[at].sum())
                which, word = np.unique(v.inverse[spots], return_inverse=True)
                sub = subset(v, which)
                x = inputs(sub, tables[i], m, fixed[i][which])
                out, tape = forward(m, _projections(m, x), word, first, length[at], keep=True)
                d = ((_sigmoid(out) - label[doc[at]]) / len(at)).astype(_F)
                g, dx = backward(m, x, word, first, length[at], tape, d)
                g["words"] = np.zeros_like(m["words"])
                np.add.at(g["words"], _slot(sub.word, _EMBED), dx[:, e : e + EMBED])
                g["chars"] = np.zeros_like(m["chars"])
                gr, own = sub.grams[4]
                count = np.maximum(np.bincount(own, minlength=len(which)), 1)
                np.add.at(g["chars"], _slot(gr, _EMBED), (dx[:, e + EMBED :] / count[:, None])[own])
                step += 1
                for k in m:  # Adam
                    a, b = moment[k]
                    a += 0.1 * (g[k] - a)
                    b += 0.001 * (g[k] * g[k] - b)
                    pull = DECAY * m[k] if k in ("words", "chars") else 0
                    m[k] -= (0.01 * ((a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6) + pull)).astype(_F)
    now = logits()
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, doc, now.astype(float))
    return Model(m, associations(v, label), _threshold(best, label, share), prior)


def _threshold(best: np.ndarray, label: np.ndarray, share: float) -> float:
    """Where F1 is highest when label 1 has its share among all labels; the middle of the gap to the next score."""
    ok = np.isfinite(best)
    best, label = best[ok], label[ok]
    order = np.argsort(-best, kind="stable")
    s, y = best[order], label[order]
    w = np.where(y == 1, share / max((y == 1).sum(), 1), (1 - share) / max((y == 0).sum(), 1))
    tp, fp = np.cumsum(w * (y == 1)), np.cumsum(w * (y == 0))
    f1 = 2 * tp / (tp + fp + share)
    k = int(f1.argmax())
    return float(s[k] if k + 1 == len(s) else (s[k] + s[k + 1]) / 2)


# --- operator ------------------------------------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, epochs: int = EPOCHS) -> Model:
    """Learn from the labelled rows of docs (doc_id, text) and labels (doc_id, toxic) whose fold is not 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__y")).where("__id IS NOT NULL AND __y IN (0, 1)").where(fold(F.col("__id")) != 0)
    known = known.groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).where("__y = __z").drop("__z")
    docs = docs.select(F.col("doc_id").cast("long").alias("__id"), "text")
    size = F.octet_length("text")
    found = known.join(docs.select("__id", size.alias("__size")), "__id", "left")
    short = F.coalesce(F.col("__size") <= FIT_TEXT, F.lit(False))
    n = {r["__y"]: r for r in found.groupBy("__y").agg(F.count_distinct("__id").alias("n"), F.count_if(short).alias("m"), F.sum(F.when(short, F.col("__size")).otherwise(0)).alias("size")).collect()}  # two rows
    share = n[1]["n"] / sum(r["n"] for r in n.values()) if 1 in n else 0.0
    p = {y: min(1.0, fit_rows / max(r["m"], 1), FIT_BYTES / max(r["size"], 1)) for y, r in n.items()}
    draw = F.pmod(F.xxhash64(F.col("__id"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(draw <= F.when(F.col("__y") == 1, p.get(1, 1.0)).otherwise(p.get(0, 1.0)))  # about 2 * fit_rows rows at most
    found = docs.where(size <= FIT_TEXT).join(F.broadcast(drawn), "__id")
    rows = found.groupBy("__id", "__y").agg(F.min("text").alias("text")).collect()  # one text for each id drawn
    rows.sort(key=lambda r: r["__id"])
    texts, label = [r["text"].encode("utf-8", "surrogatepass") for r in rows], np.array([r["__y"] for r in rows], np.int64)
    del rows, found
    model = train(texts, label, share, epochs)
    del texts
    trim()  # the driver goes on
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_chunks(batches):
            s = held.value.score(data, off)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(s, pa.float64()), pa.array(s >= 0.5).cast(pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(released(work), "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose score is below 0.5."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_chunks(batches):
            yield part.filter(pa.array(held.value.score(data, off) < 0.5))

    return docs.mapInArrow(released(work), docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE: dict[str, str] = {}
