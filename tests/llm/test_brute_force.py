"""Operators against plain versions on whole small tables."""

import hashlib
import math
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import common, decontamination, licenses, lm_scoring, mixing, near_duplicates, quality_classifier, repeated_passages, sharding
from siltstone.llm.common import Scratch, components

SF = "/root/testdata/sf0.001"


def test_scores(spark, sf_docs):
    got = {r.doc_id: r for r in lm_scoring.score(sf_docs, Scratch(spark, "t"), "doc_id", block_bytes=60000).collect()}
    docs = {r.doc_id: [*r.text.encode().lower().split(), b""] for r in sf_docs.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in docs}
    c = Counter(w for k, words in docs.items() if not held[k] for w in words)
    n, v = sum(c.values()), len(c)
    gain = 0
    for k, words in docs.items():
        r = got[k]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(words), sum(c[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        # The base sells every unknown word at one price, the model by its spelling, so texts with unknown words are not comparable here.
        gain += (r.score - base) * (held[k] and r.n_known == r.n_tokens)
    assert gain > 0


def plain_scores(docs):
    """log10 probabilities of texts {id: words with the end} by the model's definition, with dictionaries; only the feature hash is shared."""
    lm, classes = lm_scoring, lm_scoring.CLASSES
    train = [k for k in docs if zlib.crc32(str(k).encode()) % 5 != 1]
    c = Counter(w for k in train for w in docs[k])
    n, end = sum(c.values()), 0xFFFF
    ending = lambda w: int.from_bytes(w[-2:], "big") if w else end
    tokens, once = Counter(), Counter()
    for w, m in c.items():
        tokens[ending(w)] += m
        once[ending(w)] += m == 1
    cls, load = {e: e % (classes - 1) for e in range(1 << 16)}, [0] * (classes - 1)
    for e in sorted(tokens, key=lambda e: (-tokens[e], e)):
        if e != end:
            k = min(range(classes - 1), key=lambda k: (load[k], k))
            cls[e] = k
            load[k] += tokens[e]
    cls[end] = classes - 1
    per = lambda x: [sum(x[e] for e in x if cls[e] == k) for k in range(classes)]
    tok, one = per(tokens), per(once)
    size = Counter(cls.values())
    bias = np.log([(t + 0.5) / (n + 0.5 * classes) for t in tok])
    letters, contexts, alone = Counter(), Counter(), Counter()

    def spelled(w):
        for i in range(len(w) - 3, -2, -1):
            x = (w[i + 1] << 16) + (w[i + 2] << 8) + (w[i + 3] if i + 3 < len(w) else 10)
            yield [(1, w[i + 1]), (2, (x // 256 * 2654435761 % (1 << 32)) >> 20), (3, (x * 2654435761 % (1 << 32)) >> 18)], w[i] if i >= 0 else 10

    for w in c:
        if w and c[w] == 1:
            for xs, b in spelled(w):
                letters.update((x, b) for x in xs)
                contexts.update(xs)
                alone[b] += 1
    everything = sum(alone.values())

    def q(w):
        if not w:
            return 1.0
        e, k = ending(w), cls[ending(w)]
        u = (one[k] + 0.5) / (tok[k] + 1)
        p = u * (once[e] + 0.5) / (one[k] + 0.5 * size[k])
        for xs, b in spelled(w) if len(w) > 1 else ():
            own = (alone[b] + 0.5) / (everything + 128)
            for x in xs:
                own = (letters[x, b] + lm.SMOOTH * own) / (contexts[x] + lm.SMOOTH)
            p *= own
        p += (1 - u) * c[w] / tok[k] if c[w] else 0.0
        return math.exp(round(math.log(p) * 512) / 512)

    feats, ys = {}, {}
    for d, words in docs.items():
        h = np.array([lm.xxhash.xxh3_64_intdigest(w) >> 32 for w in words], np.uint32)
        ys[d] = np.array([cls[ending(w)] for w in words])
        rows = lm.word_rows(h)
        feats[d] = lm.history(*rows, ys[d], np.array([0]), (rows[0][-1], rows[1][-1])).T
    seen = np.zeros((lm.HASHES, classes))
    for d in train:
        for f in feats[d].T:
            np.add.at(seen, (f, ys[d]), 1)
    share = np.exp(bias) / np.exp(bias).sum()
    row = seen.sum(axis=1, keepdims=True)
    weights = lm.START * np.log((seen / share + lm.PSEUDO) / (row + lm.PSEUDO))

    def softmax(d):
        x = weights[feats[d]].sum(axis=1) + bias
        p = np.exp(x - x.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    for turn in range(lm.ROUNDS):
        g = np.zeros_like(weights)
        for d in train:
            if zlib.crc32(str(d).encode()) // 5 % lm.ROUNDS == turn:
                p = -softmax(d)
                p[np.arange(len(p)), ys[d]] += 1
                for f in feats[d].T:
                    np.add.at(g, f, p)
        weights = weights + np.clip(lm.RATE * g / (seen / lm.ROUNDS + row * share / lm.ROUNDS + lm.PSEUDO), -1, 1)
    pairs = defaultdict(Counter)
    for d in train:
        for before, w in zip([b"", *docs[d]], docs[d]):
            pairs[before, cls[ending(w)]][w] += 1
    # The optimum by nested bisection: for a given Z each weight solves n = N q exp(w) / Z + prior w, and Z is where the shares add up to one.
    keys = [(i, w) for i, words in enumerate(pairs.values()) for w in words]
    at, own = np.array([i for i, _ in keys]), np.array([q(w) for _, w in keys])
    m, total = np.array([m for words in pairs.values() for m in words.values()], float), np.array([sum(words.values()) for words in pairs.values()], float)
    low, high = np.full(len(total), -80.0), np.full(len(total), 80.0)

    def solved(log_z):
        a, b = np.full(len(at), -400.0), np.minimum(m / lm.PRIOR, log_z[at] - np.log(own))
        for _ in range(60):
            mid = (a + b) / 2
            up = m - total[at] * own * np.exp(mid - log_z[at]) - lm.PRIOR * mid > 0
            a, b = np.where(up, mid, a), np.where(up, b, mid)
        return a

    for _ in range(60):
        mid = (low + high) / 2
        more = np.maximum(0, 1 - np.bincount(at, own)) + np.bincount(at, own * np.exp(solved(mid))) > np.exp(mid)
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    fitted = {group: ({}, z) for group, z in zip(pairs, low)}
    for (i, w), theta, group in zip(keys, solved(low), [g for g, words in pairs.items() for _ in words]):
        fitted[group][0][w] = theta
    out = {}
    for d, words in docs.items():
        outer = np.log(softmax(d)[np.arange(len(words)), ys[d]]).sum()
        inner = 0.0
        for before, w in zip([b"", *words], words):
            theta, log_z = fitted.get((before, cls[ending(w)]), ({}, 0.0))
            inner += math.log(q(w)) + (round((theta.get(w, 0.0) - log_z) * 1024) / 1024 if w else 0.0)
        out[d] = (outer + inner) / math.log(10)
    return out


def test_scores_against_a_plain_version(spark, sf_docs):
    got = {r.doc_id: r for r in lm_scoring.score(sf_docs, Scratch(spark, "t"), "doc_id", block_bytes=200000).collect()}
    want = plain_scores({r.doc_id: [*r.text.encode().lower().split(), b""] for r in sf_docs.collect()})
    assert {k: r.score for k, r in got.items()} == pytest.approx(want, rel=2e-3, abs=0.05)


def test_scores_tell_prose_from_noise(spark):
    """Noise is less likely than prose, known words gain on their counts alone, and the layout of the rows does not matter."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(1)
    held = [k for k in range(10**7, 10**7 + 100) if zlib.crc32(str(k).encode()) % 5 == 1][:5]
    noise = [(k, " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 9)) for _ in range(300))) for k in held]
    docs = docs.union(spark.createDataFrame(noise, docs.schema)).cache()
    got = {r.doc_id: r for r in lm_scoring.score(docs, Scratch(spark, "t"), "doc_id").collect()}
    a_token = lambda rows, x="score": sum(r[x] for r in rows) / sum(r.n_tokens for r in rows)
    real = [r for k, r in got.items() if r.held_out and k not in held]
    known = [r for r in real if r.n_known == r.n_tokens]
    assert a_token([got[k] for k in held]) < a_token(real) - 5
    assert a_token(real) > a_token(real, "base_score") and a_token(known) > a_token(known, "base_score") + 1
    again = lm_scoring.score(docs.repartition(7), Scratch(spark, "t"), "doc_id", block_bytes=1 << 20).collect()
    assert all(abs(r.score - got[r.doc_id].score) <= 0.01 * abs(got[r.doc_id].score) for r in again)


def test_inner_model_sums_to_one():
    rng = np.random.default_rng(0)
    group = np.sort(rng.integers(0, 40, 300))
    n, q = rng.integers(0, 4, 300) * (rng.random(300) < 0.8), rng.random(300) / 100
    n[0], q[0] = 100000, 1e-9
    gain = lm_scoring.fit_pairs(group, n, q)
    for g in np.unique(group):
        at = group == g
        rest = lm_scoring.fit_pairs(np.append(group[at], g), np.append(n[at], 0), np.append(q[at], 1e-30))[-1]
        assert (q[at] * np.exp(gain[at])).sum() + (1 - q[at].sum()) * np.exp(rest) == pytest.approx(1)
        assert gain[at][n[at] == 0] == pytest.approx(rest)  # words never seen here share what is left
    p = q * np.exp(gain)
    assert p[0] == pytest.approx(n[0] / n[group == group[0]].sum(), rel=0.01)


def test_pairs_are_fitted_in_slabs():
    """The tables of the fit stay small whatever the number of pairs, and a pair's weight is that of its group alone."""
    rng = np.random.default_rng(1)
    group = np.sort(np.append(rng.integers(0, 90000, 300000), np.full(30000, 500)))
    n, q = rng.integers(0, 3, len(group)), rng.random(len(group)) / 1e6
    tracemalloc.start()
    gain = lm_scoring.fit_pairs(group, n, q)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * gain.nbytes  # 11.7 times with all pairs at once
    for g in (group[0], 500, 501, *rng.choice(group, 50), group[-1]):
        at = group == g
        assert gain[at] == pytest.approx(lm_scoring.fit_pairs(group[at], n[at], q[at]), abs=1e-12)
    assert lm_scoring.fit_pairs(group[:0], n[:0], q[:0]).tolist() == []


def test_blocks_number_words(spark):
    """Blocks hold the words that a byte-wise split gives, whatever a block's size."""
    texts = [None, "", " \t\n\v\f\r", "a A\x0bb\x1cc É\x85é\xa0x \u2003y", " lead", "trail\r\n", "x" * 5000, "", "İ ſ K b a", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    plain = {k: [*(t or "").encode().lower().split(), b""] for k, t in enumerate(texts)}
    for size, blocks in ((1, 7), (40, 3), (1 << 20, 1)):
        rows, got = lm_scoring.tokenised(docs, "doc_id", "text", size).collect(), {}
        for r in rows:
            block = lm_scoring.Tokens(r.asDict())
            words = [block.words[c] for c in block.codes]
            cuts = np.cumsum(block.lengths)
            got |= {k: words[b - m : b] for k, b, m in zip(r.ids, cuts, block.lengths)}
            assert len(set(block.words)) == len(block.words) == r.n_words
            assert list(dict.fromkeys(block.codes[block.codes > 0].tolist())) == list(range(1, r.n_words))
        assert got == plain and [k for r in rows for k in r.ids] == list(plain)
        assert len(rows) == blocks


def test_endings_and_spelling_sum_to_one():
    words = [b"", b"a", b"ab", b"abc", b"xyzab"]
    assert lm_scoring.endings(words).tolist() == [0xFFFF, 97, 97 * 256 + 98, 98 * 256 + 99, 97 * 256 + 98]
    word, cells = lm_scoring.spelling(words)
    assert Counter(word.tolist()) == {2: 1, 3: 2, 4: 4}
    assert [cells[0][word == w][0] % 256 for w in (2, 3, 4)] == [10, 10, 10]
    rng = np.random.default_rng(0)
    model = lm_scoring.Letters(rng.integers(0, 3, lm_scoring.LETTERS) * (rng.random(lm_scoring.LETTERS) < 0.1))
    for x, y, z in ((5, 700, 97), (16383, 0, 255)):
        every = np.stack([c * 256 + np.arange(256) for c in (x, y, z)])
        assert np.exp(model.log(every)).sum() == pytest.approx(1, rel=1e-5)


def test_class_model_sums_to_one():
    rng = np.random.default_rng(0)
    w = rng.normal(size=(lm_scoring.HASHES, lm_scoring.CLASSES)).astype(np.float32)
    one, two = lm_scoring.word_rows(rng.integers(0, 1 << 32, 50, dtype=np.uint32))
    f = lm_scoring.history(one, two, rng.integers(0, 32, 50).astype(np.uint8), np.arange(0, 50, 7), (5, 6))
    p = np.exp(lm_scoring._logits(w, np.zeros(32, np.float32), f))
    assert np.allclose((p / p.sum(axis=1, keepdims=True)).sum(axis=1), 1, atol=1e-5)
    assert (f[:, ::7] == f[:, :1]).all() and (f[1, 1::7] == 6).all()  # a document's start sees nothing of the one before
    total, y = np.zeros((lm_scoring.HASHES, 32), np.float32), rng.integers(0, 32, 50)
    lm_scoring.add_gradient(total, w, np.zeros(32, np.float32), f, y)
    want = np.zeros(total.shape)
    for i, k in enumerate(y):
        g = -p[i] / p[i].sum()
        g[k] += 1
        for row in f[:, i]:
            want[row] += g
    assert np.allclose(total, want, atol=1e-4)


def test_shards(spark, sf_docs):
    copies = sf_docs.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 1000)
    for docs, shards in ((sf_docs.union(copies), 24), (sf_docs.limit(1).withColumn("doc_id", F.explode(F.sequence(F.lit(1), F.lit(500)))), 7), (sf_docs, 1)):
        docs = docs.cache()
        got = sharding.shard(docs, Scratch(spark, "t"), "doc_id", shards=shards).collect()
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert sorted(r.doc_id for r in got) == sorted(texts)
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
            assert r["size"] == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert all(sorted(x) == list(range(len(x))) for x in by.values())
        n = [len(by[s]) for s in range(shards)]
        assert sum(n) == len(texts) and max(n) - min(n) <= 1
    got = {r.doc_id: r.shard for r in sharding.shard(sf_docs.union(copies), Scratch(spark, "t"), "doc_id", shards=8).collect()}
    together = sum(got[k] == got[k + 1000] for k in range(40))
    assert together >= 36


def test_large_groups_stay_whole(spark):
    """Groups that fit a shard are not cut, larger ones lie in as few shards as can be."""
    sizes = {"whole": 90, "half": 50, "third": 33, "eighth": 13, "several": 310}
    rows = [(text, i) for text, n in sizes.items() for i in range(n)]
    rows += [(f"single {i}", 0) for i in range(1000 - len(rows))]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.shard for r in sharding.shard(docs, Scratch(spark, "t"), "doc_id", shards=10).collect()}
    shards = defaultdict(set)
    for i, (t, _) in enumerate(rows):
        shards[t].add(got[i])
    assert sorted(Counter(got.values()).values()) == [100] * 10
    assert {t: len(shards[t]) for t in sizes} == {"whole": 1, "half": 1, "third": 1, "eighth": 1, "several": 4}
    assert sharding.place([7, 25, 3], [10, 10, 11, 10]) == [[(1, 7)], [(2, 11), (0, 10), (3, 4)], [(1, 3)]]


def test_groups_find_room_elsewhere(spark):
    """Pairs whose members' shards have too little room go to another shard; a triple that fits nowhere stays."""
    cells = [(bytes([i]), 0, 2) for i in range(20)] + [(b"t", 1, 3)]
    got = sharding.propagate(spark.createDataFrame(cells, "g binary, shard int, n long"), [1, 1, 2, 38], Scratch(spark, "t")).collect()
    got = {bytes(r.g): r.target for r in got}
    pairs = [got.get(bytes([i])) for i in range(20)]
    assert got[b"t"] == 3 and set(pairs) <= {2, 3, None}
    assert pairs.count(2) == 1 and pairs.count(3) == 17


def test_licenses(spark, sf_docs):
    got = {r.doc_id: r for r in licenses.scan_licenses(sf_docs, "doc_id").collect()}
    for r in sf_docs.collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r.text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        starts, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            starts += found
            labels |= {label} if found else set()
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(g.labels.split(",")) | {""} and 0 <= g.score <= 1
    planted = spark.createDataFrame([(1, "x y Licensed under CC BY-NC 4.0. z"), (2, "licensed under cc, by a friend"), (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and related documentation files")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan_licenses(planted, "doc_id").collect()} == {1: "cc-by-nc-4.0", 2: "", 3: "mit"}


def test_licenses_of_any_frequency(spark):
    """Labels are those of all starts of all templates, however rare the words of other notices are."""
    bsd = next(text for label, text, _ in licenses.TEMPLATES if label == "bsd")
    every = " ".join(text for _, text, _ in licenses.TEMPLATES)
    rows = [(1, f"{bsd}. Licensed under CC BY 4.0"), (2, " ".join(reversed(every.split())) + " x x x Licensed under CC BY 4.0 x x"), (3, every)]
    rows += [(4 + i, "cc by 4 0 licensed under version license the of") for i in range(40)]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    index = licenses.Index(licenses.TEMPLATES, licenses.PHRASES, {}, 0)
    for k, text in rows[:4]:
        words, want = licenses.words_of(text), {label for phrase, label in licenses.PHRASES.items() if licenses.places(licenses.words_of(text), phrase.encode().split())}
        for t, (label, template, _) in enumerate(index.templates):
            for start in range(-len(template), len(words)):
                same = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(template))
                if same >= licenses.MATCH * len(template) and index.keys_hold(words, t, start):
                    want.add(label)
        assert got[k] == (want or {""})
    assert got[1] == {"bsd", "cc-by-4.0"} and "cc-by-4.0" in got[2]


def brute_repeats(texts, length):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = b"\x01" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out.append((len(b), sum(cover), len(re.findall(b"\x01+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 24, 3])
def test_repeats(spark, length):
    rng = np.random.default_rng(length)
    base = bytes(rng.integers(97, 100, 3000)).decode()
    texts = ["a" * 900, base, base[:1000] + "é" * 150 + base[1100:1500], base[37:290] + "Q" + base[37:290], "short", "", "ab" * 400, base[500 : 500 + length], base[10 : 10 + length] + "x", "same text " * 60, "same text " * 60]
    texts += [bytes(rng.integers(97, 99, 700)).decode() for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = repeated_passages.remove_repeats(docs, Scratch(spark, "t"), "doc_id", "text", length=length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept) if r.kept is not None else r.text.encode()).hexdigest()) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts], length)


def test_repeats_with_hot_passages(spark, monkeypatch):
    """Many texts share a passage, with borders and edits of their own; hot keys are joined apart."""
    monkeypatch.setattr(common, "HOT_KEYS", 50)
    rng = np.random.default_rng(8)
    noise = lambda n: bytes(rng.integers(97, 123, n)).decode()
    passage, texts = noise(700), []
    for i in range(1500):
        a, b = sorted(rng.integers(0, 700, 2).tolist())
        edit = passage[:a] + "#" * (i % 3) + passage[b:] if i % 5 == 0 else passage[a : a + 450]
        texts.append(noise(int(rng.integers(0, 90))) + edit + noise(int(rng.integers(0, 90))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = repeated_passages.remove_repeats(docs, Scratch(spark, "t"), "doc_id", "text")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept) if r.kept is not None else r.text.encode()).hexdigest()) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts], 200)


@pytest.mark.parametrize("unit", [b"a", b"ab", b"abcdefg"])
def test_short_periods_are_few_phrases(unit):
    raw = np.frombuffer(unit * (1_000_000 // len(unit)), np.uint8)
    parts = list(repeated_passages.Parser().phrases(raw))
    assert sum(len(p[0]) for p in parts) <= 6 * len(parts)
    assert sum(int((p[1] * p[2]).sum()) for p in parts) == len(raw) - 199


def test_repeats_of_documents(spark, sf_docs):
    rows = sf_docs.select("doc_id", "text").collect()
    found = repeated_passages.remove_repeats(sf_docs, Scratch(spark, "t"), "doc_id").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in found}
    assert [got[r.doc_id] for r in rows] == [x[:3] for x in brute_repeats([r.text.encode() for r in rows], 200)]


def test_mix(spark, sf_docs):
    rows = mixing.mix(sf_docs, Scratch(spark, "a"), "doc_id", "source", block=8).collect()
    again = mixing.mix(sf_docs.repartition(7), Scratch(spark, "b"), "doc_id", "source", block=8).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in sf_docs.collect()}
    own = Counter()
    for r in rows:
        own[r.source] += sizes[r.doc_id]
    names = sorted(own)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(own.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * own[s]}
        target |= {s: 3 * own[s] for s in full} if full else {s: level * weight[s] for s in open_}
        open_ = open_ - full if full else set()
    taken = Counter()
    for r in rows:
        assert r["size"] == sizes[r.doc_id] and r.source_size == own[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * sizes[r.doc_id]
    biggest = {s: max(sizes[r.doc_id] for r in rows if r.source == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= biggest[s] + 1 for s in names)


def test_pivot_keeps_words():
    rng = np.random.default_rng(5)
    size, p = rng.integers(1, 500, 400), np.full(400, 0.37)
    out = mixing.pivot(size, p, 3)
    assert ((out > 0) & (out < 1)).sum() <= 1 and (size * out).sum() == pytest.approx((size * p).sum())
    mean = np.mean([mixing.pivot(size[:6], p[:6], s) for s in range(4000)], axis=0)
    assert np.allclose(mean, 0.37, atol=0.04)


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    test = labels.where("doc_id % 4 = 1")
    found = quality_classifier.classify(docs, labels.where("doc_id % 4 != 1"), Scratch(spark, "t"), "doc_id")
    got = found.join(test, "doc_id").select("kept", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).groupBy("kept", "good").count().collect()
    n = {(r.kept, r.good): r["count"] for r in got}
    assert n.get((True, True), 0) >= 0.99 * (n.get((True, True), 0) + n.get((False, True), 0))
    assert n.get((False, False), 0) >= 0.85 * (n.get((False, False), 0) + n.get((True, False), 0))


def jaccard_links(sets, threshold):
    links, parent = Counter(), {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            index[g].append(k)
    for a, b in {(a, b) for ks in index.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}:
        both = len(sets[a] & sets[b])
        if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return links, {k: root(k) for k in sets}


def test_near_duplicates(spark, sf_docs):
    words = [f"w{i}" for i in range(300)]
    family = [(5000 + i, " ".join(w if j not in (i, 2 * i + 3) else "changed" for j, w in enumerate(words)), None, None, 0) for i in range(60)]
    docs = sf_docs.union(spark.createDataFrame(family, sf_docs.schema)).cache()
    rows = near_duplicates.near_duplicates(docs, Scratch(spark, "t"), "doc_id", tile=16).collect()
    def grams(text):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    sets = {r.doc_id: grams(r.text) for r in docs.collect()}
    links, roots = jaccard_links(sets, 0.8)
    got = {r.doc_id: r for r in rows}
    assert {k: got[k].n_links for k in sets} == {k: links[k] for k in sets}
    assert {k: got[k].class_id for k in sets} == roots


def test_chains_cost_rows_in_proportion(spark):
    """A chain of texts, each like the next only: few rows are dealt to tiles, and all links are found."""
    words, texts = [f"w{i}" for i in range(3000)], []
    texts = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sizes = []
    verify = near_duplicates._verify
    near_duplicates._verify = lambda tiles, threshold: (sizes.append(tiles.count()), verify(tiles, threshold))[1]
    try:
        rows = near_duplicates.near_duplicates(docs, Scratch(spark, "t"), "doc_id", tile=8).collect()
    finally:
        near_duplicates._verify = verify
    links, roots = jaccard_links({k: set(near_duplicates.ngrams(t).tolist()) for k, t in texts}, 0.8)
    assert {r.doc_id: r.n_links for r in rows} == {k: links[k] for k, _ in texts} and {r.doc_id: r.class_id for r in rows} == roots
    assert sizes[0] < 12 * len(texts)  # all blocks with all others would be 75 rows a text


def made(spark, since: int, node: str, metric: str) -> int:
    """The sum of a metric over the nodes of plans, run since an execution, whose description matches."""
    store = spark._jsparkSession.sharedState().statusStore()
    time.sleep(1)  # its listener runs behind
    total, runs = 0, store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(since, runs.size())):
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for x in (nodes.apply(i) for i in range(nodes.size())):
            found = [m for m in (x.metrics().apply(i) for i in range(x.metrics().size())) if m.name() == metric]
            if found and re.search(node, re.sub(r"#\d+L?", "", x.desc())) and (value := values.get(found[0].accumulatorId())).isDefined():
                total += int(re.sub(r"\D.*", "", value.get().replace(",", ""), flags=re.S))
    return total


def test_large_groups_cost_rows_in_proportion(spark):
    """Joins on names of sets make a few rows for each different text of a component of many blocks, not one for each band; copies of a hot text are combined where they are."""
    words = [f"w{i}" for i in range(200)]
    different = [(i, " ".join(w if j != i else "changed" for j, w in enumerate(words))) for i in range(150)]
    docs = spark.createDataFrame(different + [(1000 + i, different[7][1]) for i in range(1500)], "doc_id long, text string").repartition(4).cache()
    docs.count()
    begun = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = near_duplicates.near_duplicates(docs, Scratch(spark, "t"), "doc_id", tile=8).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r.class_id, r.n_links) for r in rows} == {(0, 1649)} and {r.n_copies for r in rows if r.copy_id == 7} == {1501} and len(rows) == 1650
    assert 0 < made(spark, begun, r"^\w+Join \[node\], \[node\]", "number of output rows") < 10 * len(different)
    assert made(spark, begun, r"^Exchange hashpartitioning\(k,", "shuffle records written") < 1500  # fewer than the copies


def test_short_items_are_looked_for_once(monkeypatch):
    """A short item whose words' forms stand at thousands of places of a text costs one search of the text."""
    asked, stands = [], decontamination._stands
    monkeypatch.setattr(decontamination, "_stands", lambda item, text: asked.append(item) or stands(item, text))
    text = " ".join(f"word{i % 977} of{i % 13}" for i in range(2000))
    index = decontamination.Benchmark([(1, "of"), (2, "of1")])
    found = index.find(text)
    assert [item for item, *_ in found] == [2] and len(asked) == len(set(asked)) <= 2
    assert [item for item, *_ in index.find(text + " of")] == [1, 2]


def test_banding_reaches_recall():
    with pytest.raises(ValueError, match="recall"):
        near_duplicates.bands_for(0.05, 0.9999)
    for t, r in ((0.8, 0.9999), (0.5, 0.95), (0.9, 0.999)):
        bands, rows = near_duplicates.bands_for(t, r)
        assert 1 - (1 - t**rows) ** bands >= r and bands * rows <= near_duplicates.MAX_HASHES


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 200)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


BENCH = [
    (1, "A farmer named Alice sells 12 apples and 7 pears for 30 dollars at the market near Boston every Friday morning."),
    (2, "water boils at one hundred degrees"),
    (3, "Which of these planets is the largest in the solar system and how many moons of at least 5 km does it have?"),
]
CASES = {
    1: ("intro text. A farmer named Alice sells 12 apples and 7 pears for 30 dollars at the market near Boston every Friday morning. more", [1]),
    2: ("a FARMER NAMED ALICE SELLS 12 APPLES AND 7 PEARS FOR 30 DOLLARS AT THE MARKET NEAR BOSTON", [1]),
    3: ("A farmer named Bob sells 99 apples and 4 pears for 55 euros at the market near Denver every Friday morning.", [1]),
    4: ("We know that water boils at one hundred degrees in a pot", [2]),
    5: ("A farmer sells apples at the market. The market near Boston opens every Friday morning for everyone.", []),
    6: ("", []),
    7: (None, []),
    8: ("which of these planets is the largest in the solar system", []),
}


@pytest.mark.parametrize("most", [10**6, 0])
def test_decontamination(spark, most):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, bench, "doc_id", max_broadcast=most).collect()}
    assert {k: got[k]["items"] for k in CASES} == {k: v for k, (_, v) in CASES.items()}
    assert [k for k in CASES if got[k].reparameterised] == [3]


def test_slots_must_agree():
    index = decontamination.Benchmark([(1, "Tom has 5 red marbles and gives 5 of the 5 marbles back to the poor old man")])
    assert index.find("so tom has 9 red marbles and gives 9 of the 9 marbles back to the poor old man")[0][2]
    assert index.find("so tom has 9 red marbles and gives 2 of the 4 marbles back to") == []


@pytest.mark.parametrize("most", [decontamination.MAX_BROADCAST, 0])
def test_items_of_numbers(spark, most):
    items = [(1, "Find the next number: 2 4 8 16 32 64 128 256 512 1024"), (2, "What is 7+5?"), (3, "3 5 km 12 m 7 cm"), (4, "17 19 23 29 31 37 41 43 47 53 59 61 67"), (5, "!")]
    cases = {
        1: ("so. find the next number 2 4 8 16 32 64 128 256 512 1024 here", [1]),
        2: ("Find the next number: 3 6 12 24 48 96 192 384 768 1536", [1]),
        3: ("the table 3 6 12 24 48 96 192 384 768 1536 number 5 6 7 8", []),
        4: ("Q: What is 7+5? A: 12", [2]), 5: ("what is 7 and 5", []), 6: ("What is 7+59?", []), 7: ("3 5 km 12 m 7 cm", [3]), 8: ("run 4 5 km 12 m 8 cm", []),
        9: ("so 17 19 23 29 31 37 41 43 47 53 59 61 67 71", [4]), 10: ("so 1 2 3 4 5 6 7 8 9 10 11 12 13 14 !", []),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")
    got = decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), "doc_id", max_broadcast=most).collect()
    assert {r.doc_id: r["items"] for r in got} == {k: v for k, (_, v) in cases.items()}
    assert [r.doc_id for r in got if r.reparameterised] == [2]


def test_names_at_the_start_of_sentences():
    index = decontamination.Benchmark([(1, "Tom has 5 apples. Ann has 3 apples. Joe has 2 apples. Tom gives all of them to Ann."), (2, "Alice walks along the river every day with Bob")])
    for text, want in (
        ("Max has 6 apples. Eva has 4 apples. Kim has 1 apples. Max gives all of them to Eva.", [(1, 19, True)]),
        ("Max has 6 apples. Eva has 4 apples. Kim has 1 apples. Kim gives all of them to Eva.", [(1, 18, True)]),
        ("So. Carol walks along the river every day with Dan", [(2, 9, True)]),
    ):
        assert index.find(text) == want
        assert index.candidates(["", text], decontamination.Coder())[-1:] == [1]


def test_stretch_goes_on_after_a_conflict():
    item = "every shelf of 4 shops near the old town holds 4 kinds of fresh bread for all the guests"
    index = decontamination.Benchmark([(1, item)])
    assert len(item.split()) == 19
    got = index.find(item.replace("of 4 shops", "of 7 shops").replace("holds 4", "holds 9"))
    assert got == [(1, 15, True)]
    rng = np.random.default_rng(3)
    for _ in range(300):
        own_words = [str(x) if x < 4 else f"w{x}" for x in rng.integers(0, 12, 24).tolist()]
        words = [str(rng.integers(0, 2)) if w.isdigit() else w if rng.random() < 0.97 else "other" for w in own_words]
        own, template = (["\x01n" if w.isdigit() else w for w in x] for x in (own_words, words))

        def agrees(i, j):
            pairs = {(a, b) for a, b in zip(own_words[i:j], words[i:j]) if a.isdigit()}
            return own[i:j] == template[i:j] and len({a for a, _ in pairs}) == len(pairs)

        want = max((j - i for i in range(24) for j in range(i, 25) if agrees(i, j)), default=0)
        assert index.run(words, template, (own_words, own), 0)[0] == (want if want >= decontamination.SPAN else 0)


def test_decontamination_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    index = decontamination.Benchmark(bench)
    want = {r.doc_id: [x[0] for x in index.find(r.text)] for r in docs.collect()}
    assert {k for k, v in want.items() if v} >= {r.doc_id for r in docs.collect() if any(t in r.text for _, t in bench)}
    got = {r.doc_id: r["items"] for r in decontamination.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string"), "doc_id").collect()}
    assert got == want


def test_pipeline(spark):
    """The stages one after the other give the rows of run(), and each keeps what the operator says."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality_classifier.classify(docs, labels, Scratch(spark, "t"), "doc_id").where("kept").collect()}
    now = corpus_pipeline.quality(spark, docs, SF).cache()
    assert {r.doc_id for r in now.collect()} == kept
    links, roots = jaccard_links({k: set(near_duplicates.ngrams(rows[k]).tolist()) for k in kept}, 0.8)
    now = corpus_pipeline.dedup(spark, now, SF).cache()
    assert sorted(r.doc_id for r in now.collect()) == sorted(set(roots.values()))
    index = decontamination.Benchmark([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    clean = sorted(k for k in set(roots.values()) if not index.find(rows[k]))
    now = corpus_pipeline.decontamination(spark, now, SF).cache()
    assert sorted(r.doc_id for r in now.collect()) == clean
    copies = {r.doc_id: r.copies for r in mixing.mix(now, Scratch(spark, "t"), "doc_id").collect()}
    now = corpus_pipeline.mixing(spark, now, SF).cache()
    assert Counter(r.doc_id for r in now.collect()) == +Counter(copies)
    final = corpus_pipeline.sharding(spark, now, SF).collect()
    assert sorted(r.doc_id for r in final) == sorted(k for k, n in copies.items() for _ in range(n))
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in final)


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "tiles", "decontamination"])
def test_workers_hold_slices(spark, monkeypatch, stage):
    """However many texts a batch has, a worker unfolds few at once, and its results do not hold the batch."""
    seen = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, run, schema: seen.append(run) or df)
    text, n = "one two three four five six seven eight " * 40, 6000
    docs = spark.createDataFrame([(1, text)], "id long, t string")
    if stage == "quality":
        quality_classifier.evidence(docs, [(np.zeros(1 << quality_classifier.BITS, np.float32), 0.0, 0.5)] * 2, "id", "t", text="t")
    elif stage == "near_duplicates":
        near_duplicates._prepare(docs, 5, 24, 5)
    elif stage == "tiles":
        near_duplicates._with_grams(docs.select(F.col("id").alias("node"), "t"), 5)
    else:
        decontamination._scan(docs, [(1, "nine ten eleven twelve")], "bigint", "id", text="t")
    texts = [pa.array([text] * n)] * (2 if stage == "quality" else 1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), *texts], names=["id", "t", "u"][: 1 + len(texts)])
    rows, begun = [], pa.total_allocated_bytes()
    for out in seen[0](iter([batch])):
        rows += out.column(0).to_pylist()
        assert out.num_rows <= common.SLICE
        assert pa.total_allocated_bytes() - begun < batch.nbytes / 2
    assert rows == list(range(n))


def test_small_tables_start_no_workers(spark):
    for rows in ([], [(b"a", 0, 5, 3), (b"b", 1, 9, 0)]):
        few = sharding._few(spark, rows, "g", "begin", "end", "target")
        assert few.schema.simpleString() == "struct<g:binary,begin:bigint,end:bigint,target:int>"
        assert "RDD" not in few._jdf.queryExecution().toString() and [tuple(r) for r in few.collect()] == rows
