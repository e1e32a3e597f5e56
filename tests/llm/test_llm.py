"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from symlake.llm import anchors, bytespans, common, decontam, langid, minhash, mixing, phrases, repeats, suffixes, tokens, toxicity, vectors, warc

DDL = "doc_id long, text string, lang string, source string, n_chars long, size string, __size string"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 150))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = passage[rng.randint(0, 20) :]
        if i % 5 == 0:
            w += passage
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w), "en", None if i % 7 == 0 else f"s{i % 4}"))
    base = [word() for _ in range(200)]
    for i in range(60, 66):
        rows.append((i, " ".join(base[: 100 + i - 60] + ["changed"] * (i > 62) + base[100:]), "de", "s1"))
    rows += [(70, rows[3][1], "en", "s1"), (71, None, None, None), (72, "", "en", "s0"), (73, "One", "en", "s0"), (74, "one", "fr", "s0"), (75, "y " * 20000, "en", "s2"), (76, " \t\n", "en", "s0"), (3, rows[3][1], "en", "s1")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y") for r in corpus], DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_hashes_depend_on_the_word_alone():
    data, off = np.frombuffer(b"ab cd\nab" + b"cd", np.uint8), np.array([0, 8, 10])
    s, e, row = common.words(data, off, common.SPACES)
    h = common.word_hashes(data, s, e)
    assert row.tolist() == [0, 0, 0, 1] and h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    assert (common.gram_hashes(h, 2) == common.span_hashes(h, np.arange(3), np.arange(3) + 2)).all()


def test_anchors_are_leftmost_minima():
    g = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    g[100:160] = g[0]
    want = np.lib.stride_tricks.sliding_window_view(g >> np.uint64(26), 15).argmin(1) + np.arange(len(g) - 14)
    assert (anchors.anchor_of(g, 15) == want).all()


@pytest.mark.parametrize("options", [{}, {"base": 2, "memory": 4}])
def test_suffixes_and_common_prefixes(options):
    rng = np.random.default_rng(0)
    for _ in range(150):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 60))
        b = np.concatenate(list(suffixes.SuffixSorter(t, 5, None, **options).descending()))
        assert b[::-1, 0].tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert (b[1:, 1] == suffixes.common(t, b[1:, 0], b[:-1, 0], 5)).all()


def test_gradients():
    texts, label = [b"aa bb cc dd", b"bb ee aa"], np.array([1, 0])
    v = toxicity.vocab(np.frombuffer(b"".join(texts), np.uint8), np.array([0, 11, 19]))
    m = {k: a.astype(np.float64) for k, a in toxicity.start_weights().items()}
    x = np.random.default_rng(0).normal(size=(len(v.word), 12))
    start, length = np.array([0, 4]), np.array([4, 3])
    logit = lambda: toxicity.forward(m, toxicity._projections(m, x), v.inverse, start, length)[0].sum()
    _, tape = toxicity.forward(m, toxicity._projections(m, x), v.inverse, start, length, keep=True)
    g, _ = toxicity.backward(m, x, v.inverse, start, length, tape, np.ones(2))
    for k in ("Uf", "Wb", "qb", "wf", "cb"):
        i = (0,) * m[k].ndim
        old = m[k][i]
        m[k][i] = old + 1e-4
        up = logit()
        m[k][i] = old - 1e-4
        assert abs((up - logit()) / 2e-4 - g[k][i]) < 1e-3
        m[k][i] = old


def test_scores_agree_with_a_network_read_word_by_word():
    """The score of a text is that of its highest window, read here one word after the other."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["good", "bad", "vile", "mild", "plain"]) + rng.choice("abc") for _ in range(n)).encode() for n in (5, 40, 150, 64, 65, 1)]
    label = np.array([1, 0, 1, 0, 1, 0])
    model = toxicity.train(texts, label, 0.5)
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    m, sig = model.weights, lambda x: 1 / (1 + np.exp(-x))
    for i, got in enumerate(model.score(data, off)):
        v = toxicity.vocab(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
        x = toxicity.inputs(v, model.table, m)[v.inverse].astype(float)
        logits, first = [], 0
        while True:
            w = x[first : first + toxicity.WINDOW]
            states = {}
            for way, order in (("f", range(len(w))), ("b", reversed(range(len(w))))):
                h, out = np.zeros(toxicity.HIDDEN), {}
                for t in order:
                    a = w[t] @ m[f"W{way}"] + m[f"c{way}"]
                    k = toxicity.HIDDEN
                    zr = sig(a[: 2 * k] + h @ m[f"U{way}"][:, : 2 * k])
                    new = np.tanh(a[2 * k :] + (zr[k:] * h) @ m[f"U{way}"][:, 2 * k :])
                    h = zr[:k] * h + (1 - zr[:k]) * new
                    out[t] = h
                states[way] = np.stack([out[t] for t in range(len(w))])
            score, value = (sum(states[way] @ m[f"{c}{way}"] for way in "fb") for c in "qw")
            weight = np.exp(score - score.max())
            logits.append((weight / weight.sum() * value).sum() + m["bias"][0])
            if first + toxicity.WINDOW >= len(x):
                break
            first += toxicity.STRIDE
        assert abs(got - sig(max(logits) - model.threshold)) < 1e-3


def test_toxicity_learns_from_few_and_bounded_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_TEXT", 4000)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioulnst") for _ in range(rng.randint(3, 7)))
    rows = []
    for i in range(300):
        w = [word() for _ in range(rng.randint(100, 400))]
        if i % 7 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["rotten", "beastly", "wretched"])
        rows.append((i, " ".join(w)))
    rows.append((1000, "rotten " * 3000))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0 or i == 1000)) for i, _ in rows] + [(8, 1)], "doc_id long, toxic int")  # 8 has both labels
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    pos, neg = [got[i] for i in held if i % 7 == 0], [got[i] for i in held if i % 7]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.9 and got[1000] >= 0.5


def test_toxicity_learns_and_handles_odd_rows(spark, empty):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice("the of and to in it is was".split()) + rng.choice("abcdef") for _ in range(rng.randint(5, 150))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = "vile" + rng.choice("xyz")
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "a b"), (3, rows[3][1])], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (5, None), (6, 7)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) / len(held) > 0.9
    assert got[1000]["predicted"] == 0 and 0 <= got[1001]["score"] < 0.5
    assert toxicity.score(empty, model).count() == 0 and toxicity.keep_clean(docs, model).columns == docs.columns
    none = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score(docs, none).collect()} == {0}


def test_mix_comes_near_its_targets(docs, corpus, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus) and sum(r["size"] for r in got) == sum(len(split(r[1])) for r in corpus)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, got))
    assert mixing.mix(empty).count() == 0
    copies = mixing.copies(docs)
    assert copies.columns == docs.columns
    assert copies.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in got)


def test_targets_fill_up_to_their_caps():
    got = {s: t for s, _, t in mixing.targets([("a", 10), ("b", 100), (None, 50), ("z", 0)], (3, 1, 2), 1.5, 2)}
    assert got["a"] == 20 and got["z"] == 0 and abs(sum(got.values()) - 240) < 1e-9 and max(got[None] / 100, got["b"] / 200) <= 1


def small_blocks(monkeypatch, n):
    for module in (suffixes, bytespans):
        monkeypatch.setattr(module, "BLOCK", n, raising=False)
    monkeypatch.setattr(suffixes, "HELD", n, raising=False)


def test_suffixes_in_files(monkeypatch):
    small_blocks(monkeypatch, 8)
    rng = np.random.default_rng(2)
    for n in (*range(1, 40), 300, 1500):
        t = rng.integers(0, 1 + n % 4, n)
        b = np.concatenate(list(suffixes.SuffixSorter(t, 5, None, base=2, memory=16).descending()))
        assert b[::-1, 0].tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
        assert (b[1:, 1] == suffixes.common(t, b[1:, 0], b[:-1, 0], 5)).all()


def test_types_and_seeds_lie_in_files(monkeypatch):
    small_blocks(monkeypatch, 1 << 13)
    t = np.random.default_rng(6).integers(0, 257, 1 << 20).astype(np.uint16)
    tracemalloc.start()
    suffixes.SuffixSorter(t, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < t.nbytes


def shard(n):
    """n segments of one frequent phrase with different continuations, some of them in common; every tenth repeated."""
    rng = np.random.default_rng(3)
    tails = rng.integers(97, 123, (max(1, n // 3), 24), np.uint8)
    rows = np.concatenate((np.tile(np.frombuffer(b"a phrase that is met very often indeed", np.uint8), (n, 1)), tails[rng.integers(0, len(tails), n)], rng.integers(97, 123, (n, 22), np.uint8)), 1)
    rows = np.concatenate((rows, rows[::10]))
    low = rng.integers(0, 50, len(rows))
    return rows.ravel(), np.arange(len(rows) + 1) * rows.shape[1], low, low + rng.integers(0, 2, len(rows))


def test_shard_agrees_with_brute_force(monkeypatch, tmp_path):
    small_blocks(monkeypatch, 64)
    data, off, low, high = shard(150)
    seg = [data[a:z].tobytes() for a, z in zip(off[:-1], off[1:], strict=True)]
    of = {}
    for x, a, z in zip(seg, low.tolist(), high.tolist(), strict=True):
        for i in range(len(x) - 49):
            lo, hi = of.get(x[i : i + 50], (99, -1))
            of[x[i : i + 50]] = (min(lo, a), max(hi, z))
    want = {(x, i, of[x[i : i + 50]][0]) for x in seg for i in range(len(x) - 49) if of[x[i : i + 50]][0] < of[x[i : i + 50]][1]}
    got = set()
    for block in bytespans.shard_ranges(data, off, low, high, 50, str(tmp_path), base=8, memory=64):
        for k, first, stop, lo in zip(*(x.tolist() for x in block), strict=True):
            got |= {(seg[k], i, lo) for i in range(first, stop)}
    assert got == want


def test_crowded_segments_are_cut_alike():
    """Equal windows of crowded segments fall in pieces with equal keys, and no window is lost."""
    data, off, _, _ = shard(300)
    n = len(off) - 1
    again = np.arange(n) % 7 > 0
    gram = common.gram_hashes(common.BYTE_VALUE[data], bytespans.GRAM)[off[:-1] + 7].view(np.int64)
    of, lo, hi, key = bytespans.cut_again(data, off[:-1], off[1:], gram, again, 50)
    found, keys = {}, {}
    for k, a, z, x in zip(of.tolist(), lo.tolist(), hi.tolist(), key.tolist(), strict=True):
        found.setdefault(k, []).extend(range(a - off[k], z - off[k]))
        for i in range(a, z):
            if again[k]:
                keys.setdefault(data[i : i + 50].tobytes(), set()).add(x)
    assert {k: sorted(v) for k, v in found.items()} == {k: list(range(off[k + 1] - off[k] - 49)) for k in range(n)}
    assert all(len(v) == 1 for v in keys.values()) and len(set(key.tolist())) > n


def test_the_automaton_locates_phrases():
    """What a block finds comes from its automaton: all places of its phrases, none of others."""
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + rng.choice("abcdefgh")
    text = [" ".join(word() for _ in range(400)).encode() for _ in range(3)]
    data, off = np.frombuffer(b"".join(text), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in text])))
    w = phrases.Words(data, off, 20)
    row, letters = phrases.phrase_places()(data, off)
    pick = np.unique(letters)[::3]
    got_row, gram, _, at, starts = phrases.passages()(data, off, pick)
    place = anchors.places(w.anchor, w.valid)
    assert set(gram.tolist()) == set(w.grams[place[np.isin(letters, pick)]].view(np.int64).tolist())
    assert len(phrases.passages()(data, off, pick[:0])[0]) == 0 and (starts > 0).all() and set(got_row.tolist()) <= {0, 1, 2} and (at >= 0).all()


def test_recurring_grams(tmp_path):
    rng = np.random.default_rng(7)
    gram, row = rng.integers(0, 400, 900), rng.integers(0, 30, 900)
    gram[:200] = 7  # a frequent one
    want = {(g, r) for g, r in zip(gram.tolist(), row.tolist(), strict=True) if (gram == g).sum() > 1}
    groups = [repeats.dealt(gram[i : i + 100], row[i : i + 100]) for i in range(0, 900, 100)]
    sure = {(g, r) for g, r, s in zip(*(np.concatenate(c).tolist() for c in zip(*groups, strict=True)), strict=True) if s}
    unsure = ((g[~s], r[~s]) for g, r, s in groups)
    got = {(g, r) for a, b in repeats.repeated(unsure, str(tmp_path), memory=64) for g, r in zip(a.tolist(), b.tolist(), strict=True)}
    assert sure | got == want
    assert sum((g[~s] == 7).sum() for g, _, s in groups) <= len(groups)


def test_memory_of_a_shard_does_not_grow_with_it(monkeypatch, tmp_path):
    small_blocks(monkeypatch, 1 << 13)
    peaks = []
    for n in (8000, 24000):
        data, off, low, high = shard(n)
        tracemalloc.start()
        for _ in bytespans.shard_ranges(data, off, low, high, 50, str(tmp_path), base=1 << 12, memory=1 << 15):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def jaccard_components(corpus, k, similarity):
    sets = {}
    for i, text, *_ in corpus:
        w = [x.translate(str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})) for x in split(text)]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    comp, before = {i: i for i in sets}, None
    while comp != before:
        before = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return sets, comp


def test_near_duplicates_agree_with_all_pairs(docs, corpus, empty):
    sets, comp = jaccard_components(corpus, 3, 85)
    for r in minhash.near_duplicates(docs, 3, 85).collect():
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), comp[i], comp[i] == i)
    assert minhash.near_duplicates(empty).count() == 0
    sets, comp = jaccard_components(corpus, 5, 80)
    kept = minhash.dedup(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i in comp if comp[i] == i})


def test_near_duplicates_in_crowded_buckets(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = [x for x in base if rng.random() > (0.0, 0.01, 0.03, 0.05)[i % 4]]
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(w if i % 5 else [*w, *(f"own{i}-{j}" for j in range(rng.randint(0, 200)))])))
    _, comp = jaccard_components([(*r, None, None) for r in rows], 3, 85)
    assert 20 < len(set(comp.values())) < 140
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == comp


def test_texts_that_share_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(200)) for c in "ab")
    rows = [(1, a, 0), (1, b, 1), (2, a + " tail", 2), (3, b + " tail", 3), (4, "other words here", 4), (4, "other words here", 4), (5, "", 5), (None, a, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int").repartition(4)
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, 3, 85).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (5, 5, True)]
    assert sorted((r["id"] for r in minhash.dedup(docs, 3, 85).collect())) == [0, 1, 4, 5, 6]


def test_verify_deals_the_mates_of_a_text(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MATES", 3)
    texts = [(i, " ".join(f"w{j}" for j in range(100 - i))) for i in range(40)]
    pairs = spark.createDataFrame([(a, b) for a in (0, 7) for b in range(40) if a != b], "a long, b long")
    got = {(r["a"], r["b"]) for r in minhash.verify(pairs, spark.createDataFrame(texts, "node long, text string"), 3, 85).collect()}
    assert got == {(a, b) for a in (0, 7) for b in range(40) if a != b and 100 * (98 - max(a, b)) >= 85 * (98 - min(a, b))}


def test_agreement_bound():
    assert minhash.least_agreement(160, 85) < 0.85 * 160 and minhash.least_agreement(160, 85) > 0.55 * 160
    rng = np.random.default_rng(5)
    for n in (7, 40, 400):
        s = rng.integers(0, 2**63, n + n // 7 + 1).astype(np.uint64)
        a, b = minhash.sketch(s[: -(n // 14) - 1], 160), minhash.sketch(s[n // 14 :], 160)
        assert (a == b).sum() >= minhash.least_agreement(160, 80)


def test_prefixes_meet_for_every_link(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(base) if rng.random() < 0.03 else x for x in base[: 60 - i % 4])) for i in range(60)]
    sets, _ = jaccard_components([(*r, None, None) for r in rows], 3, 85)
    found = minhash.prefixes(spark.createDataFrame([*rows, (90, None), (91, "one")], "node long, text string"), 3, 85).collect()
    first = {}
    for r in found:
        first.setdefault(r["node"], {})[r["g"]] = (r["at"], r["n"])
    assert 90 not in first and len(first[91]) == 1
    links = 0
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                links += 1
                (n, m) = (len(sets[a]), len(sets[b]))
                assert any(185 * min(n - first[a][g][0], m - first[b][g][0]) >= 85 * (n + m) for g in first[a].keys() & first[b].keys())
    assert links > 50


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = minhash.sketch(s[:380], 512), minhash.sketch(s[20:], 512)
    assert abs((a == b).mean() - 0.9) < 0.06 and (minhash.sketch(s[:1], 64) < np.iinfo(np.uint64).max).all()


def test_tokens_round_trip(docs, corpus, empty):
    tok = tokens.WordEncoder(tokens.vocabulary()).tokenizer
    start = 0
    got = tokens.tokenize(docs).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(r[0] for r in corpus)
    text = dict((r[0], r[1]) for r in corpus)
    for r in got:
        ids = [*tok.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.tokenize(empty).count() == 0
    for odd in ("a\x1cb don't I'll <|endoftext|> é ́q ΑΣ 12ab,c", "İ ǅ x"):
        assert np.frombuffer(tokens.WordEncoder(tokens.vocabulary())([odd.encode()])[0], "<u2").tolist() == tok.encode(odd, add_special_tokens=False).ids


def test_language_of_held_out_texts(spark, empty):
    rng = random.Random(3)
    kinds = {"aa": "ka lo mi tu".split(), "bb": "ge sch und ein".split(), "cc": "que les au oi".split()}
    rows = [(i, " ".join("".join(rng.choices(kinds[c], k=3)) for _ in range(20)), c) for i in range(120) for c in [list(kinds)[i % 3]]]
    docs = spark.createDataFrame([*rows, (500, None, "aa"), (501, "", "aa"), (502, "12 !", "bb"), (None, "kalo", None), (503, "漢字", None)], "doc_id long, text string, lang string")
    f = langid.fit(docs.where("doc_id % 4 != 2"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, f).collect()}
    assert all(got[i] == c for i, _, c in rows) and got[500] == got[501] == got[502] == "und" and got[503] in kinds
    assert langid.predict(empty, f).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}


def test_language_masks_and_counts():
    """Masks hold every language of an n-gram, and what else they hold is what the correction takes off."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64)) for _ in range(11)]
    sets[3] = np.union1d(sets[3], sets[7][:500])
    f = langid.Filters([f"l{i:02}" for i in range(11)], sets, 0, bits=14)
    assert 0.02 < f.false.mean() < 0.3
    pick = [np.concatenate((sets[7][:200], sets[2][:100])), sets[3][-50:], rng.integers(0, 2**63, 4000).astype(np.uint64)]
    h, row = np.concatenate(pick), np.repeat(np.arange(3), [len(x) for x in pick])
    slots = [[set(f.slot(x, p).tolist()) for p in range(f.probes)] for x in sets]
    full = [set().union(*s) for s in slots]
    want = np.zeros((3, 11))
    for g, r in zip(h, row, strict=True):
        for i in range(11):
            want[r, i] += all(int(f.slot(np.array([g]), p)[0]) in full[i] for p in range(f.probes))
    total = np.bincount(row)[:, None]
    assert np.allclose(f.counts(h, row, 3), np.maximum(want - total * f.false, 0) / (1 - f.false))
    assert want[0, 7] >= 200 and want[0, 3] >= 200 and want[0, 2] >= 100
    assert np.abs(f.counts(h, row, 3)[2]).max() < 0.15 * 4000  # strangers are few once corrected


def test_language_fit_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "FIT_TEXT", 50)
    rows = [(i, "abcd " * 3, "aa") for i in range(30)] + [(100 + i, "wxyz " * 40, "bb") for i in range(30)] + [(300, "abcd", "aa"), (300, "abcd", "aa")]
    f = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert f.langs == ["aa"]  # all texts of the other are too long to learn from
    out = langid.predict(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string"), f).collect()
    assert len(out) == 62 and {r["lang_pred"] for r in out} == {"aa"}


@pytest.mark.parametrize("small", [False, True])
def test_contamination_agrees_with_brute_force(spark, docs, corpus, empty, small, monkeypatch):
    if small:  # a file for each item or so, none of them kept, few documents for each
        monkeypatch.setattr(decontam, "HELD_BYTES", 1)
        monkeypatch.setattr(decontam, "GROUP_BYTES", 300)
        monkeypatch.setattr(decontam, "FILE_BYTES", 40)
        monkeypatch.setattr(decontam.item_files, "__defaults__", (40,))
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    items = [(1, " ".join(split(corpus[0][1])[10:60])), (2, corpus[9][1]), (3, "One"), (4, None), (5, "--"), (6, " ".join(split(corpus[6][1])[:4])), (None, "changed")]
    pats = {(tuple(v[j : j + min(13, len(v))]), i) for i, t in items for v in [w(t)] if v for j in range(len(v) - min(13, len(v)) + 1)}
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(docs, table).collect()}
    for i, text, *_ in corpus:
        v, hit, ids = w(text), set(), set()
        for p, item in pats:
            for j in range(len(v) - len(p) + 1):
                if tuple(v[j : j + len(p)]) == p:
                    hit |= set(range(j, j + len(p)))
                    ids |= {str(item)} if item is not None else set()
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert tuple(got[i])[1:] == (len(v), len(hit), len(ids), digest, len(hit) > 0 and 20 * len(hit) >= len(v))
    assert decontam.contamination(empty, table).count() == 0 and decontam.clean(docs, table).columns == docs.columns
    assert decontam.contamination(docs, table.where("false")).where("n_hit > 0").count() == 0


def test_warc_round_trip(spark):
    pages = [(3, "http://a/é b", "same"), (1, None, "same"), (2, "u", "other é"), (4, "u", None), (5, "u", ""), (1, "v", "same"), (None, "w", "same"), (6, "x\r\ny", "z" * 100000)]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, digest string")
    index = warc.write(df, common.shared_dir(spark, "t"))
    got = warc.read_back(index).collect()
    assert len(got) == len(pages) and index.count() == len(pages)
    by = lambda i: [r for r in got if r["page_id"] == i]
    assert [r["record_type"] for r in by(1)] == ["response"] * 2 and by(3)[0]["refers_to"] == 1 and by(None)[0]["refers_to"] == 1
    assert by(4)[0]["record_type"] == "response" and by(5)[0]["refers_to"] == 4 and by(6)[0]["payload"] == b"z" * 100000
    assert all(r["payload_bytes"] == len((h or "").encode()) for i, _, h in pages for r in by(i))
    assert warc.read_back(warc.write(df.where("false"), common.shared_dir(spark, "t"))).count() == 0
    assert warc.ranges([(0, 5), (5, 5), (1000, 5)], 10, 100) == [[(0, 5), (5, 5)], [(1000, 5)]]


def test_phrases_agree_with_brute_force(docs, corpus, empty):
    rows = sorted({(i, t) for i, t, *_ in corpus}, key=lambda r: r[0])
    seen, want = {}, {}
    for i, t in rows:
        v, gone = split(t), set()
        for j in range(len(v) - 19):
            if seen.setdefault(tuple(v[j : j + 20]), (i, j)) != (i, j):
                gone |= set(range(j, j + 20))
        want[i] = (len(v), len(gone), " ".join(x for j, x in enumerate(v) if j not in gone))
    for r in phrases.remove_repeats(docs).collect():
        assert (r["n_words"], r["n_removed"], r["text"]) == want[r["doc_id"]]
    assert phrases.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("crowded", [256, 2])
def test_byte_spans_agree_with_brute_force(docs, corpus, empty, crowded, monkeypatch):
    rows = sorted({(i, t) for i, t, *_ in corpus}, key=lambda r: r[0])
    seen, want = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if seen.setdefault(b[j : j + 50], i) < i:
                gone[j : j + 50] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        want[i] = (len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone]))
    monkeypatch.setattr(bytespans, "CROWDED", crowded)
    for r in bytespans.remove_repeats(docs).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]]
    assert bytespans.remove_repeats(empty).count() == 0


def test_vectors_reach_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 24))
    x[300:600] = x[0]  # a third of the rows are copies of one vector
    rows = [(i, x[i].tolist()) for i in range(900)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None, *[1.0] * 23]), (None, x[5].tolist())]
    rows += [(2020, x[7].tolist()), (2020, x[8].tolist()), (2040, [1.0, 2.0]), (2041, [3.0, 1.0]), (2042, [-1.0, 0.5])]
    v = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, rank string, score int").repartition(3)
    want = {}
    alive = [(i, e) for i, e in rows if i is not None and e is not None and None not in e and np.isfinite(e).all() and any(e)]
    for i in {i for i, _ in alive if i % 20 == 0}:
        q = min(e for j, e in alive if j == i)
        near = sorted((-sum((a * b for a, b in zip(q, e, strict=True)), 0.0), j) for j, e in alive if j != i and len(e) == len(q))
        want[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(near[:20])]
    got = {}
    for r in vectors.search(v, v.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    for i, rows in got.items():
        assert [r[1] for r in sorted(rows)] == [r[1] for r in want[i]] and np.allclose([r[2] for r in sorted(rows)], [r[2] for r in want[i]], rtol=1e-12, atol=0)
    few = v.where("vec_id < 3")
    assert vectors.search(few, few.where("vec_id = 0")).count() == 2 and vectors.search(v.where("false"), v).count() == 0


def test_codes_choose_few_vectors():
    """On vectors without structure, the worst case, less than a twentieth is reranked and nothing of the 21 nearest is missed."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((16384, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    centre, turn = x.mean(0), vectors.rotation(64)
    code, r, f = vectors.codes_of(x, centre, turn)
    q = x[:100]
    planes = vectors.Queries(q, vectors.first_floors(q, x[: vectors.SAMPLE], 21), centre, turn)
    bits = np.unpackbits(code.view(np.uint8), axis=1, bitorder="little")
    level = sum(np.unpackbits(planes.planes[j].view(np.uint8), axis=1, bitorder="little").astype(int) << j for j in range(vectors.PLANES))
    assert (vectors.popcounts(planes.planes[:, :5], code[:50]) == level[:5] @ bits[:50].T).all()
    qi, ci, _, reranked = vectors.search_codes(planes, x, code, r, f, np.arange(len(x)), 21, vectors.EPSILON)
    want = np.argsort(-(q @ x.T), axis=1)[:, :21]
    assert reranked < 0.05 * 100 * len(x)
    assert np.mean([len(set(ci[qi == i]) & set(want[i])) / 21 for i in range(100)]) >= 0.99
def test_a_null_id_counts_as_the_largest(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(None, " ".join(words)), (5, " ".join(["x", *words])), (None, " ".join(["y", *words[:20]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in phrases.remove_repeats(docs).collect()}
    assert got == {(None, 40, 40), (5, 41, 0), (None, 21, 20)}
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in bytespans.remove_repeats(docs).collect()}
    size = [len(t) for _, t in rows]
    assert got == {(None, size[0], size[0]), (5, size[1], 0), (None, size[2], size[2] - 1)}


def test_null_ids_of_tokens(spark):
    rows = [(None, "b a"), (-(2**63), "a"), (2**63 - 1, "c"), (None, None)]
    got = tokens.tokenize(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [-(2**63), 2**63 - 1, None, None] and sorted(r["n_tokens"] for r in got)[0] == 1


def test_ranges_of_token_files(tmp_path, monkeypatch):
    off = np.array([0, 3, 3, 10, 30, 31])
    flat = np.arange(31, dtype="<u2")
    (tmp_path / "x.bin").write_bytes(flat.tobytes())
    monkeypatch.setattr(tokens.pafs, "LocalFileSystem", type(None))  # as of a store that is far away
    parts = list(tokens._ranges(f"file://{tmp_path}/x.bin", "<u2", off, 10))
    assert [p[:2] for p in parts] == [(0, 3), (3, 4), (4, 5)] and np.concatenate([p[2] for p in parts]).tolist() == flat.tolist()


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    """documents, labels and benchmark: 300 documents, a third of them copies or near copies, some toxic, some contaminated."""
    d, rng = tmp_path_factory.mktemp("corpus"), random.Random(12)
    word = lambda: "".join(rng.choice("aeioulnst") for _ in range(rng.randint(3, 7)))
    items = [(f"q{i}", " ".join(word() for _ in range(30))) for i in range(5)]
    rows, base = [], [word() for _ in range(120)]
    for i in range(300):
        w = [word() for _ in range(rng.randint(60, 200))]
        if i % 3 == 0:
            w = list(base)
            w[rng.randrange(120)] = word() if i % 2 else w[0]
        if i % 9 == 1:
            w[5:5] = items[i % 5][1].split()
        if i % 8 == 2:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["rotten", "beastly", "wretched"])
        rows.append((i, " ".join(w), "en", f"s{i % 3}", None))
    rows += [(300, None, "en", "s0", 0), (301, "", "en", None, 0), (5, rows[5][1], "en", "s2", 0)]
    docs = spark.createDataFrame([(*r[:4], len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 2)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), items


def test_pipeline_stages_agree_with_brute_force(spark, small_corpus):
    import corpus_pipeline

    d, items = small_corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    stages = dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, d)
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    bad = lambda t: model.score(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] >= 0.5
    assert rows(clean) == sorted((tuple(r) for r in docs.collect() if not bad(r["text"])), key=repr)
    gone = {r[0] for r in rows(docs)} - {r[0] for r in rows(clean)}
    assert len(gone & {i for i in range(300) if i % 8 == 2}) >= 30 and len(gone - {i for i in range(300) if i % 8 == 2}) <= 10

    single = stages["near_duplicates"](spark, clean, d)
    _, comp = jaccard_components([(r["doc_id"], r["text"], None, None) for r in clean.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i in comp if comp[i] == i)

    pure = stages["decontamination"](spark, single, d)
    grams = {tuple(t.split()[j : j + 13]) for _, t in items for j in range(18)}
    hits = lambda t: len({k for j in range(len(v) - 12) if tuple(v[j : j + 13]) in grams for k in range(j, j + 13)}) if (v := (t or "").split()) else 0
    assert rows(pure) == sorted((tuple(r) for r in single.collect() if not (hits(r["text"]) and 20 * hits(r["text"]) >= len(r["text"].split()))), key=repr)
    assert pure.count() < single.count()

    mixed = stages["mixing"](spark, pure, d)
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(pure).collect() if r["size"]}
    assert sorted(r["doc_id"] for r in mixed.collect() if r["text"]) == sorted(i for i, n in times.items() for _ in range(n))

    mixed.write.mode("overwrite").parquet(f"{d}/mixed")
    mixed = spark.read.parquet(f"{d}/mixed")
    tok = tokens.WordEncoder(tokens.vocabulary()).tokenizer
    want = sorted((r["doc_id"], zlib.crc32(np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in mixed.collect())
    got = stages["token_ids"](spark, mixed, d).orderBy("start").collect()
    assert [(r["doc_id"], r["ids_crc32"]) for r in got] == want and [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def test_pipeline_runs_from_end_to_end(spark, small_corpus):
    import corpus_pipeline

    d, _ = small_corpus
    out = corpus_pipeline.run(spark, d).collect()
    assert out and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out[0].asDict()) and len({r["start"] for r in out}) == len(out)


def test_pipeline_stages_keep_columns(docs, empty):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]
    spark, d = docs.sparkSession, "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        assert name == "token_ids" or stage(spark, docs, d).columns == docs.columns
        assert stage(spark, empty, d).count() == 0
