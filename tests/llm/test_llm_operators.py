"""Each operator against brute force, and over nulls, empty texts, repeats, empty tables and odd columns."""

import base64
import collections
import hashlib
import itertools
import json
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import common, graph, license_scan, line_dedup, mixing, piece_bpe, quality, queries, simhash, topk, toxicity, vector_dedup, warc
from lodestrata.llm import kneser_ney as kn
from lodestrata.llm.blocks import Blocks

SF_DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, `key` long, fp string, lines int, size string, _id int, nll int, ids string"
LONG = "alpha beta gamma delta. " * 20_000


def documents(spark, rows):
    return spark.createDataFrame([(*r, None, 1, "f", 2, "s", 3, 4, "i") for r in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "one two three four five", None, None), (3, "one two three four five", None, None), (None, "no id here at all", "en", "b"), (5, LONG, "fr", "b"), (6, " \n\t ", "en", None), (7, "Tab\tand\nline é 日本 🙂", "xx", "c")]
    return documents(spark, rows).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def labels(spark, rows=()):
    return spark.createDataFrame([*rows], "doc_id long, quality int, toxic int")


def find(parent, a):
    while parent[a] != a:
        a = parent[a]
    return a


def smallest(n, pairs, ids):
    parent = list(range(n))
    for i, j in pairs:
        parent[find(parent, i)] = find(parent, j)
    groups = collections.defaultdict(list)
    for k in range(n):
        groups[find(parent, k)].append(ids[k])
    return [min(groups[find(parent, k)]) for k in range(n)]


# Kneser-Ney


def brute(texts, size):
    """Interpolated modified Kneser-Ney over dictionaries of strings."""
    n = kn.ORDER
    c = collections.Counter()
    for t in texts:
        s = kn.BOUNDARY * (n - 1) + t
        c.update(s[k - n + 1 : k + 1] for k in range(n - 1, len(s)))
    orders = [c]
    for _ in range(n - 1):
        orders.append(collections.Counter(x[1:] for x in orders[-1]))

    def p(level, gram):
        if level == n:
            return 1 / size
        counts = orders[level]
        d = (0, *kn.discounts(*(sum(v == k for v in counts.values()) for k in (1, 2, 3, 4))))
        own = {g: v for g, v in counts.items() if g[:-1] == gram[:-1]}
        lower = p(level + 1, gram[1:])
        if not own:
            return lower
        total = sum(own.values())
        v = own.get(gram, 0)
        return (v - d[min(v, 3)]) / total + sum(d[min(v, 3)] for v in own.values()) / total * lower

    return lambda text: [p(0, (kn.BOUNDARY * (n - 1) + text)[k : k + n]) for k in range(len(text))]


TRUSTED = ["the cat sat", "the mat", "a cat ate the hat", "cats and hats", "\u732b\u304c\u5ea7\u3063\u305f", "that cat sat at that mat", "ten hats"] * 2


def test_perplexity_equals_brute_force(spark, monkeypatch):
    texts = [*TRUSTED, "zzz cat", "", None, "\U0001f642 h\u00e2t", "the cat sat\0 on", "he"]
    docs = documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    known = quality._trusted(labels(spark, [(k, 1, 0) for k in range(len(TRUSTED))]))
    part = {r._id: r.part for r in known.collect()}
    assert set(part.values()) == {0, 1}
    blocks = Blocks(docs.select("doc_id", "lang", "text"))
    counts = kn.counts(blocks, blocks.labelled(known), ["part"])
    got = {r.doc_id: r for r in quality.perplexity(blocks, counts).collect()}
    for k in (0, 1):
        own = [t for i, t in enumerate(TRUSTED) if part[i] == k]
        model = brute(own, len(set("".join(own))) + 1)
        for i, t in enumerate(texts):
            t = (t or "").replace("\0", "\ufffd")
            assert got[i][f"nll{k}"] == (pytest.approx(-np.log(model(t)).mean(), rel=1e-5) if t else None) and got[i].n_symbols == len(t)
    # Probabilities of what can follow add up to one.
    chars = sorted(set("".join(t for i, t in enumerate(TRUSTED) if part[i] == 0)))
    assert sum(model_sum([t for i, t in enumerate(TRUSTED) if part[i] == 0], c) for c in chars) < 1


def model_sum(own, char):
    return brute(own, len(set("".join(own))) + 1)(f"the{char}")[-1]


def test_quality_decisions_equal_brute_force(spark):
    rows = [(k, t, "en" if k % 3 else None, "a") for k, t in enumerate([*TRUSTED, "zzz cat", "", None, "qqqqqq", "the hat"])] + [(2, TRUSTED[2], None, "a"), (None, "the cat", "xx", "a")]
    docs, known = documents(spark, rows), labels(spark, [(k, 1, 0) for k in range(len(TRUSTED))] + [(None, 1, 0), (15, 0, 0)])
    part = {r._id: r.part for r in quality._trusted(known).collect()}
    own = [[t for i, t, *_ in rows if part.get(i) == k and i is not None] for k in (0, 1)]
    models = [brute(x, len(set("".join(x))) + 1) for x in own]
    nll = lambda k, t: float(-np.log(models[k](t)).mean())
    judged = [None if not t else (nll(0, t) + nll(1, t)) / 2 for _, t, *_ in rows]
    unseen = [nll(1 - part[i], t) if t and i in part else None for i, t, *_ in rows]

    def bound(some):
        steps = sorted(int(np.floor(x / quality.STEP)) for x in some)
        return (steps[int(np.ceil(0.75 * len(steps) - 1e-9)) - 1] + 1) * quality.STEP

    of = {lang: [x for x, r in zip(unseen, rows, strict=True) if x and r[2] == lang] for lang in ("en", None)}
    want = []
    for x, r in zip(judged, rows, strict=True):
        cut = bound(of[r[2]]) if of.get(r[2]) else bound([*of["en"], *of[None]])
        want.append((str(r[0]), x is not None and x < cut, round(float(np.exp(x)), 4) if x else None, round(float(np.exp(cut)), 4)))
    got = [(str(r.doc_id), r.keep, r.perplexity and round(r.perplexity, 4), round(r.bound, 4)) for r in quality.score(docs, known, 0.75).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_log_ratios_equal_brute_force(spark):
    texts = ["you vile wretch", "a vile thing", "what a wretch he is", "vile vile", "a fine thing", "what a day it is", "you are kind", "a kind thing"] * 2
    known = {k: (k // 8, int(k % 8 < 4)) for k in range(16)}
    docs = documents(spark, [(k, t, "en", "a") for k, t in enumerate([*texts, "a wretch is vile", "zz"])])
    blocks = Blocks(docs.select("doc_id", "text"))
    sides = spark.createDataFrame([(k, *v) for k, v in known.items()], "_id long, part int, toxic int")
    got = {r.x: r for r in toxicity.ratios(kn.counts(blocks, blocks.labelled(sides), ["part", "toxic"])).collect()}
    n, pad = kn.ORDER, kn.BOUNDARY * (kn.ORDER - 1)
    for part in (0, 1):
        own = [[t for k, t in enumerate(texts) if known[k] == (part, c)] for c in (0, 1)]
        pooled = brute(own[0] + own[1], len(set("".join(own[0] + own[1]))) + 1)
        by_class = [collections.Counter((pad + t)[k : k + n] for t in some for k in range(len(t))) for some in own]
        ds = [(0, *kn.discounts(*(sum(v == k for v in c.values()) for k in (1, 2, 3, 4)))) for c in by_class]

        def of(c, gram, lower, by_class=by_class, ds=ds):
            same = [v for g, v in by_class[c].items() if g[:-1] == gram[:-1]]
            if not same:
                return lower
            v = by_class[c][gram]
            return (v - ds[c][min(v, 3)] + sum(ds[c][min(x, 3)] for x in same) * lower) / sum(same)

        for text in ("a wretch is vile", "what a thing"):
            whole = pooled(text)
            for k, shared in enumerate(whole):
                gram = (pad + text)[k : k + n]
                want = np.log(of(1, gram, shared)) - np.log(of(0, gram, shared))
                known_gram = gram in by_class[0] or gram in by_class[1]
                row = got.get(gram if known_gram else gram[:-1])
                assert (row[f"r{part}"] if row and row[f"r{part}"] is not None else 0.0) == pytest.approx(want, abs=1e-5)


def test_slices_and_alphabets_change_nothing(spark, monkeypatch):
    texts = ["some text that goes on " * 20, "", None, "x", "".join(map(chr, range(0x4E00, 0x4E00 + 300)))]
    count = lambda: sorted((g, int(c)) for alphabet, keys, n in kn.counted(texts) for g, c in zip(alphabet.strings(keys, kn.ORDER).to_pylist(), n, strict=True))
    whole = collections.Counter()
    for g, c in count():
        whole[g] += c
    s = [kn.BOUNDARY * (kn.ORDER - 1) + t for t in texts if t]
    assert whole == collections.Counter(t[k - kn.ORDER + 1 : k + 1] for t in s for k in range(kn.ORDER - 1, len(t)))
    for size, radix in ((37, 65535), (1 << 20, 90), (64, 40)):
        monkeypatch.setattr(kn, "SLICE", size)
        monkeypatch.setattr(kn, "RADIX", radix)
        monkeypatch.setattr(kn, "_R", np.uint64(radix))
        monkeypatch.setattr(kn, "_POWER", [np.uint64(radix**k) for k in range(kn.ORDER + 1)])
        parts = collections.Counter()
        for g, c in count():
            parts[g] += c
        assert parts == whole


def test_features_equal_brute_force():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc "), n)) for n in (0, 3, 9, 40, 300)] + [None]
    n, pad = kn.ORDER, kn.BOUNDARY * (kn.ORDER - 1)
    values = {}
    for t in texts:
        for k in range(len(t or "")):
            g = (pad + t)[k : k + n]
            if rng.random() < 0.5:
                values[g] = rng.standard_normal(2).astype(np.float32)
            values.setdefault(g[:-1], rng.standard_normal(2).astype(np.float32))
    table = pa.table({"x": [*values], "r0": [v[0] for v in values.values()], "r1": [v[1] for v in values.values()]})
    got = toxicity.features(texts, table)
    for i, t in enumerate(texts):
        grams = [(pad + (t or ""))[k : k + n] for k in range(len(t or ""))]
        for part in (0, 1):
            r = [float(values.get(g, values[g[:-1]])[part]) for g in grams]
            want = [np.mean(r) if r else 0, *((max(sum(r[max(0, k - w + 1) : k + 1]) / w for k in range(len(r))) if r else 0) for w in toxicity.WINDOWS)]
            assert got[part][i] == pytest.approx(want, abs=1e-5)


def test_blocks_keep_every_row(spark, monkeypatch):
    monkeypatch.setattr("lodestrata.llm.blocks.BLOCK_BYTES", 200)
    docs = documents(spark, [(k, None if k % 7 == 0 else "word " * (k % 30), "en", "a") for k in range(120)])
    blocks = Blocks(docs)
    rows = blocks.df.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, range(120))) and len({(r._block, r._row) for r in rows}) == 120
    assert len({r._block for r in rows}) > 30
    plan = blocks.join(["text"], blocks.df.select("_block", "doc_id"), lambda a, b: a.select(["text"]), "text string")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1
    blocks.drop()


def test_small_sources_end_at_their_targets(spark):
    docs = documents(spark, [(1, "w " * 7, "en", "a"), (2, "w", "en", "b"), (3, "w", "en", None), (4, "w " * 900, "en", "c")])
    rows = mixing.mix(docs).collect()
    for r in rows:
        assert r.taken <= 2 * r.size and (r.taken == round(r.target) if r.target < mixing.BLOCK else abs(r.taken - r.target) <= 3 * mixing.BLOCK)


def test_quality(spark, odd, none):
    good = "The people of the town went to the market in the morning and came home at night. " * 3
    rows = [(k, f"{good} {k}", "en", "a") for k in range(60)] + [(100, "QX#! ZZ@@ 0x0x " * 30, "en", "a"), (101, "", "en", "a")]
    docs = documents(spark, rows)
    known = labels(spark, [(k, 1, 0) for k in range(60) if k % 6])
    got = {r.doc_id: r.keep for r in quality.score(docs, known).collect()}
    assert all(got[k] for k in range(60)) and not got[100] and not got[101]
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(60))
    judged = {r.doc_id: (r.n_symbols, r.perplexity, r.keep) for r in quality.score(odd, labels(spark)).collect()}
    assert len(judged) == 7 and judged[1] == judged[2] == (0, None, False) and judged[5] == (480_000, None, True) and judged[None][2]
    assert quality.score(none, labels(spark)).count() == 0


def test_equal_texts_are_judged_alike(spark):
    """Whether a text is labelled, and under which doc_id it stands, changes neither its score nor its perplexity."""
    texts = [*TRUSTED, "you vile wretch", "a vile thing", "", None]
    docs = documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts * 4)])
    known = labels(spark, [(k, int(k % len(texts) < len(TRUSTED)), int(texts[k % len(texts)] in texts[-4:-2])) for k in range(3 * len(texts)) if k % 5])
    for found, column in ((toxicity.score(docs, known), "score"), (quality.score(docs, known), "perplexity")):
        values = collections.defaultdict(set)
        for r in found.collect():
            values[texts[r.doc_id % len(texts)]].add(None if r[column] is None else round(r[column], 12))
        assert all(len(v) == 1 for v in values.values()) and (column == "score") == (values[None] == values[""] != {None})


def test_toxicity_held_out(spark, odd, none):
    rng = np.random.default_rng(3)
    words = ["market", "people", "garden", "river", "window", "table", "morning", "letter", "house", "music"]
    text = lambda k: " ".join([*rng.choice(words, 40), *(["vilewretch"] if k % 3 == 0 else []), *rng.choice(words, 20)])
    docs = documents(spark, [(k, text(k), "en", "a") for k in range(300)])
    got = {r.doc_id: r for r in toxicity.score(docs, labels(spark, [(k, 1, int(k % 3 == 0)) for k in range(300)])).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    right = [r.predicted == int(k % 3 == 0) for k, r in got.items() if r.held_out]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert toxicity.score(odd, labels(spark, [(1, None, None), (3, 1, 1)])).count() == odd.count()
    assert toxicity.score(none, labels(spark)).count() == 0
    # Two rows of one toxic document are all there is to learn from: all score the base rate.
    known = labels(spark, [(3, 1, 1), (3, 1, 0), (5, 1, None)])
    assert {(r.doc_id, round(r.score, 9), r.predicted) for r in toxicity.score(odd, known).collect()} == {(k, round(2.5 / 3, 9), 1) for k in (1, 2, 3, None, 5, 6, 7)}


# Vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep int, n int")


def sample(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((60, 16))
    near = base[:30] + rng.standard_normal((30, 16)) * 0.08
    crowd = base[0] + rng.standard_normal((40, 16)) * 0.06
    x = np.concatenate([base, near, crowd, base[:5]]).astype(np.float32)
    label = np.concatenate([np.arange(60) % 3, np.arange(30) % 3, np.zeros(40), np.arange(5) % 3]).astype(int)
    return x, label


@pytest.mark.parametrize("chunk", [4096, 8])
def test_vector_links(spark, monkeypatch, chunk):
    monkeypatch.setattr(vector_dedup, "CHUNK", chunk)
    x, label = sample()
    rows = [(k + 1, x[k].tolist(), int(label[k]), 0, 0) for k in range(len(x))]
    bad = [(901, None, 1, 0, 0), (902, [0.0] * 16, 1, 0, 0), (903, [float("nan")] * 16, 1, 0, 0), (904, x[0].tolist(), None, 0, 0), (905, [None] * 16, 1, 0, 0), (906, [], 1, 0, 0)]
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(vectors(spark, rows + bad)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    want = smallest(len(x), np.argwhere(link), list(range(1, len(x) + 1)))
    assert [(got[k + 1].n_links, got[k + 1].component_id) for k in range(len(x))] == [(int(link[k].sum()), want[k]) for k in range(len(x))]
    assert link.sum() > 100
    assert all((got[b[0]].n_links, got[b[0]].component_id, got[b[0]].kept) == (0, b[0], True) for b in bad) and len(got) == len(rows) + len(bad)


def test_vector_edges(spark):
    found = lambda df: sorted(str(tuple(r)) for r in vector_dedup.near_duplicates(df).collect())
    assert found(vectors(spark, []).limit(0)) == []
    twice = vectors(spark, [(1, [1.0, 0.0], 0, 0, 0), (1, [1.0, 0.0], 0, 0, 0), (None, [1.0, 0.0], 0, 0, 0)])
    assert found(twice) == sorted(map(str, [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, False)]))
    # Two vectors of one vec_id, each with neighbours of its own.
    shared = vectors(spark, [(1, [1.0, 0.0], 0, 0, 0), (1, [0.0, 1.0], 0, 0, 0), (2, [1.0, 0.01], 0, 0, 0), (3, [1.0, 0.02], 0, 0, 0), (4, [0.01, 1.0], 0, 0, 0)])
    assert found(shared) == sorted(map(str, [(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 1, False)]))
    lengths = vectors(spark, [(1, [1.0], 0, 0, 0), (2, [1.0, 0.0], 0, 0, 0), (3, [2.0], 0, 0, 0), (4, [1.0, 0.001], 1, 0, 0)])
    assert found(lengths) == sorted(map(str, [(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False), (4, 0, 4, True)]))
    named = spark.createDataFrame([(5, "x", [1.0, 0.0]), (4, "x", [1.0, 0.0]), (3, "y", [1.0, 0.0]), (2, None, [1.0, 0.0])], "vec_id long, label string, embedding array<double>")
    assert found(named) == sorted(map(str, [(5, 1, 4, False), (4, 1, 4, True), (3, 0, 3, True), (2, 0, 2, True)]))


def test_pairs_at_the_edge_are_told_alike():
    rng = np.random.default_rng(4)
    x = vector_dedup._unit(rng.standard_normal((300, 16)))
    turn = vector_dedup.rotation(16)[:, :8]
    limit = float(vector_dedup._distances(x[:1] @ turn, x[7:8] @ turn)[0, 0])
    answers = {bool(vector_dedup._within(x[:n], x[: n + 9], turn, limit)[0, 7]) for n in (1, 3, 17, 200)} | {bool(vector_dedup._within(x[7:8], x[:n], turn, limit)[0, 0]) for n in (1, 5, 300)}
    assert len(answers) == 1


@pytest.mark.parametrize(("blocks", "bins"), [((4096, 512), 256), ((16, 8), 4)])
def test_topk(spark, monkeypatch, blocks, bins):
    monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    monkeypatch.setattr(topk, "BINS", bins)
    x, _ = sample(1)
    x = np.concatenate([x, np.repeat(x[:1], 30, axis=0)])  # ties
    rows = [(k + 1, x[k].tolist(), 0, 0, 0) for k in range(len(x))] + [(900, None, 0, 0, 0), (920, [float("inf")] * 16, 0, 0, 0)]
    got = collections.defaultdict(list)
    for r in topk.search(vectors(spark, rows), F.col("vec_id") % 5 == 0, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    n = np.floor(64 * x.astype(float)).astype(int)
    for q in range(4, len(x), 5):
        s = n @ n[q]
        order = [k for k in np.lexsort((np.arange(len(x)), -s)) if k != q][:7]
        assert got[q + 1] == [(k + 1, s[k]) for k in order]
    assert len(got) == len(x) // 5


def test_topk_small(spark):
    assert topk.search(vectors(spark, []).limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = vectors(spark, [(20, [1.0, 0.0], 0, 0, 0), (20, [1.0, 0.0], 0, 0, 0), (3, [0.5, 0.0], 0, 0, 0)])
    assert [tuple(r) for r in topk.search(few, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 3, 2048)]


# Licenses


def test_base_phrases(spark, odd, none):
    texts = ["Released under the MIT License. mit  LICENSE, submit license", "Apache-License General Public License general public licenses", "no", None, "émit license mit license"]
    docs = documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    spans = {r.doc_id: [(s.label, s.first_word) for s in r.spans if s.base] for r in license_scan.scan(docs).collect()}
    assert spans == {0: [("mit", 3), ("mit", 5)], 1: [("apache", 0), ("gpl", 2)], 2: [], 3: [], 4: [("mit", 2)]}
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(none).count() == 0


@pytest.mark.parametrize(("text", "labels"), [("Licensed under the Apache License, Version 2.0.", ["apache", "apache-2.0"]), ("GNU General Public License, version 3 or later", ["gpl", "gpl-3-or-later"]), ("Licensed under CC BY-NC-SA 4.0.", ["cc-by-nc-sa-4.0"]), ("SPDX-License-Identifier: MIT", ["mit"]), ("GNU Lesser General Public License", ["gpl", "lgpl"]), ("plain text", []), ("available under the table", [])])
def test_license_labels(text, labels):
    scanner = license_scan.Scanner(license_scan.rules())
    _, hits, _ = scanner(text.encode())
    assert sorted({scanner.order[h.rule].label for h in hits}) == labels


@pytest.mark.parametrize(("text", "label"), [("Apache License 2.0", "apache-2.0"), ("Apache License v2.0", "apache-2.0"), ("Mozilla Public License 2.0", "mpl-2.0"), ("GNU General Public License v3", "gpl-3"), ("GNU General Public License 3", "gpl-3"), ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa-4.0"), ("Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc-4.0"), ("Beerware License", "beerware"), ("released into the public domain", "public-domain"), ("GPL v2", "gpl-2"), ("GPL 2.0", "gpl-2"), ("MPL 2.0", "mpl-2.0"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3-or-later"), ("SPDX-License-Identifier: GPL-3.0", "gpl-3"), ("SPDX-License-Identifier: GPL-3.0-only", "gpl-3-only"), ("Expat License", "mit"), ("Licence Ouverte", "etalab"), ("released under the terms of this license", "unspecified")])
def test_phrases_give_their_license_alone(text, label):
    scanner = license_scan.Scanner(license_scan.rules())
    _, hits, _ = scanner(text.encode())
    assert {scanner.order[h.rule].label for h in hits if not scanner.order[h.rule].base} == {label}


def examples(parsed, limit=24):
    """Texts that a pattern matches, every alternative of every branch in at least one."""
    from re import _constants as c

    out = [""]
    for op, arg in parsed:
        if op is c.LITERAL:
            found = [chr(arg)]
        elif op is c.ANY:
            found = ["x"]
        elif op is c.NOT_LITERAL:
            found = [" "]
        elif op is c.IN:
            kind, own = arg[0] if arg[0][0] is not c.NEGATE else (None, None)
            found = [" "] if kind is None else [chr(own if kind is c.LITERAL else own[0]) if kind is not c.CATEGORY else "w"]
            if kind is c.LITERAL:
                found = [chr(v) for k, v in arg if k is c.LITERAL]
        elif op is c.BRANCH:
            found = [x for branch in arg[1] for x in examples(branch, limit)]
        elif op is c.SUBPATTERN:
            found = examples(arg[3], limit)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, _, inner = arg
            some = examples(inner, limit)
            found = ([x * low for x in some] if low else [""]) + ([] if low else some)
        elif op in (c.ASSERT, c.ASSERT_NOT, c.AT):
            found = [""]
        else:
            raise AssertionError(op)
        # Every choice once, with the first of all others.
        n = max(len(out), len(found))
        out = [out[min(k, len(out) - 1)] + found[0] for k in range(len(out))] + [out[0] + f for f in found[1:]] if n > 1 else [out[0] + found[0]]
        out = list(dict.fromkeys(out))[: 40 * limit]
    return out


def test_every_alternative_passes_the_prefilter():
    from re import _parser

    order = license_scan.rules()
    assert len(order) > 500
    for rule in order:
        texts = examples(_parser.parse(rule.pattern.pattern.decode("latin-1")))
        matched = [t for t in texts if rule.pattern.fullmatch(t.encode())]
        assert matched, rule
        missed = [t for t in matched if rule.keyword not in re.sub(license_scan.GAP, b" ", t.encode())]
        assert not missed, (rule.keyword, missed[:3])


def test_prefilter_loses_nothing():
    order = license_scan.rules()
    scanner, plain = license_scan.Scanner(order), lambda t: license_scan.suppress([license_scan.Hit(m.start(), m.end(), k) for k, r in enumerate(order) for m in r.pattern.finditer(t)], order)
    for text in (b"licensed under the\nmozilla public license 2.0, bsd 3-clause; all rights reserved", b"spdx-license-identifier: cc by-sa 4.0 and mit", b"free  of charge, permission is hereby granted, free of charge, to any person obtaining a copy"):
        assert sorted(scanner(text)[1]) == sorted(plain(text))
    assert len(order) > 200


# SimHash


def reference_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sets = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sets]
    return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints(odd):
    for text in ("", None, "One", "one two", "A b c d e a b c", "é ü x\ty\nz \x1c w"):
        assert simhash.fingerprint(text.encode() if text else None) == reference_print(text)


def test_near_copies(spark, odd, none):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(30)]
    texts += [t.replace(" w7 ", " w8 ", 1) for t in texts] + [texts[0]] * 5 + ["", None]
    docs = documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    x = [reference_print(t) for t in texts]
    pairs = [(i, j) for i in range(len(x)) for j in range(i) if (x[i] ^ x[j]).bit_count() <= 3]
    want = smallest(len(x), pairs, list(range(len(x))))
    assert [(got[k].fingerprint, got[k].component_id) for k in range(len(x))] == [(f"{x[k]:016x}", want[k]) for k in range(len(x))]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(none).count() == 0
    assert simhash.keep_first(odd).where("doc_id = 3").count() == 1


def test_all_links_within_three_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    x = {int(b) for b in base}
    for b in base:
        for _ in range(12):
            y = int(b)
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                y ^= 1 << int(bit)
            x.add(y)
    x = sorted(np.array(sorted(x), dtype=np.uint64).view(np.int64).tolist())
    u = np.array(x, dtype=np.int64).view(np.uint64)
    pairs = np.argwhere(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)
    found = graph.components(simhash.links(spark.createDataFrame([(v,) for v in x], "fp long")))
    got = {r.node: r.component for r in found.collect()}
    assert [got.get(v, v) for v in x] == smallest(len(x), pairs, x)


def test_components(spark):
    n = 200
    edges = [(k, k + 1) for k in range(n)] + [(1000, 1000 + k) for k in range(1, 80)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {1000 + k: 1000 for k in range(80)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sorted_groups_cross_batches():
    import pyarrow as pa

    keys = [1, 1, 2, 3, 3, 3, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b])], names=["k"]) for a, b in ((0, 1), (1, 4), (4, 4), (4, 7))]
    assert [g.column("k").to_pylist() for g in graph.sorted_groups(iter(batches), ["k"])] == [[1, 1], [2], [3, 3, 3], [4]]


@pytest.mark.parametrize("doc_id", [None, 4])
def test_first_of_each_component(spark, doc_id):
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(300)], 200)) for _ in range(4)]
    docs = documents(spark, [(doc_id, t, "en", "a") for t in [*texts, texts[0]]] + [(9, texts[1], "en", "a")])
    got = sorted((str(r.doc_id), r.text) for r in simhash.keep_first(docs).collect())
    assert got == sorted((str(9 if doc_id is None and k == 1 else doc_id), t) for k, t in enumerate(texts))


# Lines


@pytest.mark.parametrize("chunk", [256, 3])
def test_lines(spark, monkeypatch, chunk):
    monkeypatch.setattr(line_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(7)
    words = [f"word{k}" for k in range(200)]
    long = [" ".join(rng.choice(words, 40)) for _ in range(12)]
    rows = [[long[k], "short", "", long[(k + 1) % 12].replace("word7", "word8"), long[k].upper() + " end"] for k in range(12)] + [["tiny"], [long[0]] * 2]
    docs = documents(spark, [(k, "\n".join(r), "en", "a") for k, r in enumerate(rows)])
    got = {r.doc_id: (r.n_lines, list(r.removed)) for r in line_dedup.dedup(docs).collect()}
    places = [(d, k, x) for d, r in enumerate(rows) for k, x in line_dedup.lines("\n".join(r))]
    sets = [line_dedup.shingles(x) for *_, x in places]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if places[i][2] == places[j][2] or min(len(places[i][2]), len(places[j][2])) >= 8 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    first = smallest(len(sets), pairs, [p[:2] for p in places])
    want = {d: (sum(p[0] == d for p in places), [p[1] for p, f in zip(places, first, strict=True) if p[0] == d and f != p[:2]]) for d in range(len(rows))}
    assert got == want
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts == {d: "\n".join(x for k, x in enumerate(r) if k not in want[d][1]) for d, r in enumerate(rows) if len(want[d][1]) < want[d][0]}


def test_lines_of_odd_rows(odd, none):
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup(odd).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 0), None: (1, 0), 5: (1, 0), 6: (0, 0), 7: (2, 0)}
    assert line_dedup.dedup(none).count() == 0 and line_dedup.without_repeats(none).count() == 0
    assert line_dedup.without_repeats(odd).count() == odd.count()


@pytest.mark.parametrize("doc_id", [None, 4])
def test_lines_of_unlike_documents_with_one_id(spark, doc_id):
    a, b, c = (" ".join(f"{x}{k}" for k in range(12)) for x in ("apple", "brick", "cloud"))
    docs = documents(spark, [(doc_id, f"{a}\n{b}", "en", "a"), (doc_id, f"{c}\n{a}", "en", "a"), (9, f"{b}\n{c} end", "en", "a")])
    assert sorted(r.text for r in line_dedup.without_repeats(docs).collect()) == sorted([f"{a}\n{b}", c])
    got = sorted((str(r.doc_id), r.n_lines, list(r.removed)) for r in line_dedup.dedup(docs).collect())
    assert got == sorted([(str(doc_id), 2, []), (str(doc_id), 2, [1]), ("9", 2, [0, 1])])


@pytest.mark.parametrize("together", [1, 1 << 17])
def test_groups_of_lines_are_searched_at_once(monkeypatch, together):
    monkeypatch.setattr(line_dedup, "_TOGETHER", together)
    rng = np.random.default_rng(3)
    groups = []
    for size in (1, 2, 40, 1, 7):
        x = list(rng.choice([*"abcd"], 100))
        groups.append([])
        for _ in range(size):  # each like the one before, so that components are chains
            x[rng.integers(100)] = "e"
            groups[-1].append("".join(x))
        rng.shuffle(groups[-1])
    groups.append(groups[2][:9])  # the same lines in another group
    found = [x for g in groups for x in g]
    sets = [line_dedup.shingles(x) for x in found]
    cuts = np.cumsum([0, *map(len, groups)])
    expected = list(range(len(found)))
    for a, b in zip(cuts, cuts[1:], strict=False):
        for i in range(a, b):
            for j in range(a, i):
                if len(sets[i] & sets[j]) >= line_dedup.SIMILARITY * len(sets[i] | sets[j]):
                    p, q = sorted((expected[i], expected[j]))
                    expected[a:b] = [p if x == q else x for x in expected[a:b]]
    assert line_dedup.similar_roots(*line_dedup._codes(found), cuts).tolist() == expected
    assert len(set(expected)) < len(found)


def test_shared_keys_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    rows = [(1, 1), (1, 1), (2, 1), (2, 2), (2, 2), (2, 3), (3, 9), (4, 1), (4, 2)]
    got = sorted(tuple(r) for r in line_dedup.shared(spark.createDataFrame(rows, "key long, h1 long")).collect())
    assert got == [(2, 1), (2, 2), (2, 3), (4, 1), (4, 2)]


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_few_lines_are_searched_by_pairs(size):
    steps = ["abcdefghijklmnopqrstuvwxyz0123456789" * 2 + x for x in ("", "ABCDEFGH", "ABCDEFGHIJKLMNOP", "ABCDEFGHIJKLMNOPQRSTUVWX")]
    for order in itertools.permutations(range(size)):  # a chain, its ends unlike one another, beside a line like none
        found = [*(steps[k] for k in order), "unlike all of them", steps[0]]
        cuts, expected = np.array([0, size, size + 1, size + 2]), [0] * size + [size, size + 1]
        assert line_dedup.similar_roots(*line_dedup._codes(found), cuts).tolist() == expected


def test_texts_are_met_once_and_keys_are_moved_in_packs(spark, monkeypatch):
    plans = []

    def stage(df, what, own=common.stage):
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return own(df, what)

    for module in (line_dedup, graph):
        monkeypatch.setattr(module, "stage", stage)
    long = "a line that stands in two documents, but for its end"
    docs = documents(spark, [(1, f"{long} a", "en", "a"), (2, f"x\n{long} b", "en", "a"), (3, " \n", "en", "a"), (4, None, "en", "a")])
    assert {r.doc_id: (r.n_lines, list(r.removed)) for r in line_dedup.dedup(docs).collect()} == {1: (1, []), 2: (2, [1]), 3: (0, []), 4: (0, [])}
    assert max(p.count("MapInArrow") for p in plans) == 2  # what makes the lines' texts, and what compares them
    assert any("Exchange hashpartitioning(part" in p for p in plans)


# Mixing


def test_targets(spark):
    rows = [("a", 100), ("b", 1000), ("c", 10), ("d", 500), (None, 40), ("e", 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    names = ["a", "b", "c", "d", "e", None]
    weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
    size, fixed, total = dict(rows), {}, 1.5 * sum(n for _, n in rows)
    while True:
        rest = [n for n in names if n not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[n] for n in rest)
        over = [n for n in rest if level * weight[n] > 2 * size[n]]
        if not over:
            break
        fixed |= {n: 2 * size[n] for n in over}
    assert got == {n: pytest.approx(fixed.get(n, level * weight[n])) for n in names}


def test_mix(spark, monkeypatch, odd, none):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rng = np.random.default_rng(8)
    docs = documents(spark, [(k, " ".join(["w"] * int(rng.integers(0, 90))), "en", f"s{k % 7 if k % 3 else 0}") for k in range(400)])
    got = mixing.mix(docs).collect()
    sums = collections.defaultdict(lambda: [0, 0, 0])
    source = {k: f"s{k % 7 if k % 3 else 0}" for k in range(400)}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        s = sums[source[r.doc_id]]
        s[0], s[1], s[2] = s[0] + r.size, s[1] + r.taken, r.target
    assert all(abs(s[1] - s[2]) <= 3 * mixing.BLOCK for s in sums.values()) and sum(s[2] for s in sums.values()) == pytest.approx(1.5 * sum(s[0] for s in sums.values()))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    mixture = mixing.mixture(docs)
    assert mixture.columns == docs.columns
    words = collections.Counter()
    for r in mixture.collect():
        words[r.source] += len(r.text.split())
    assert {k: s[1] for k, s in sums.items() if s[1]} == words
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0 and mixing.mixture(none).count() == 0
    assert sorted({str(r.doc_id) for r in mixing.mixture(odd).collect()}) == ["3", "5", "7", "None"]


def test_schedule_is_spread(spark):
    goals = spark.createDataFrame([("a", 1000, 1000.0), ("b", 3000, 3000.0)], "source string, source_size long, target double")
    plan = mixing.schedule(goals, 10).orderBy("slot").collect()
    share = np.cumsum([r.source == "a" for r in plan]) / np.arange(1, len(plan) + 1)
    assert len(plan) == 401 and abs(share[20:] - 0.25).max() < 0.05


def by_hand(rows, golden=None):
    """The mix of rows(doc_id, source, size) by plain lists."""
    golden = mixing.GOLDEN if golden is None else golden
    names = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    size = {s: sum(n for _, x, n in rows if x == s) for s in names}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    target, free, rest = {}, [*names], 1.5 * sum(size.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            rest -= target[s]
            free.remove(s)
    total, hi, bounds = sum(target.values()), 0.0, []
    for s in names:
        if target[s] > 0:
            bounds.append((s, hi / total, (hi + target[s]) / total))
            hi += target[s]
    blocks = collections.Counter()
    for i in range(int(total // mixing.BLOCK) + 1):
        point = i * golden % 1.0
        blocks.update(s for s, a, b in bounds if a <= point < b)
    return size, target, {s: min(max(1, blocks[s]) * mixing.BLOCK, round(target[s])) for s, *_ in bounds}


@pytest.mark.parametrize("golden", [None, 0.25])
def test_points_decide_what_is_taken(spark, monkeypatch, golden):
    monkeypatch.setattr(mixing, "BLOCK", 10)
    if golden:
        monkeypatch.setattr(mixing, "GOLDEN", golden)
    rng = np.random.default_rng(12)
    rows = [(k, [None, "a", "b", "c", "tiny"][k % 4 if k else 4], int(rng.integers(0, 60)) if k else 2) for k in range(120)]
    docs = documents(spark, [(k, "w " * n, "en", s) for k, s, n in rows])
    size, target, gives = by_hand(rows, golden)
    found = {r.doc_id: r for r in mixing.mix(docs).collect()}
    order = {r.doc_id: r.start for r in mixing.placed(mixing.sized(docs).select("doc_id", "source", "size"), mixing.targets(mixing.sized(docs).select("source", "size"))).collect()}
    for k, s, n in rows:
        upto = min(gives[s], 2 * size[s])
        want = sum(max(0, min(upto, order[k] + e * size[s] + n) - (order[k] + e * size[s])) for e in (0, 1))
        assert (found[k].size, found[k].source_size, found[k].taken) == (n, size[s], want) and found[k].target == pytest.approx(target[s])
    if golden:  # another sequence, another mix
        monkeypatch.setattr(mixing, "GOLDEN", 0.6180339887498949)
        assert {r.doc_id: r.taken for r in mixing.mix(docs).collect()} != {k: r.taken for k, r in found.items()}


def test_mix_follows_the_schedule(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40, raising=False)
    monkeypatch.setattr(mixing, "RUN", 16, raising=False)
    docs = documents(spark, [(k, "w " * 20, "en", "abc"[k % 3]) for k in range(300)])
    mixed = mixing.mix(docs).collect()
    slots = {r.doc_id: list(r.slots) for r in mixed}
    assert all(bool(r.taken) == bool(r.slots) and len(r.slots) <= mixing.REPEATS for r in mixed)
    order = [(r.doc_id, r.source) for r in mixing.mixture(docs).collect()]
    seen = collections.Counter()
    places = []
    for d, _ in order:
        places.append(slots[d][seen[d]])
        seen[d] += 1
    assert places == sorted(places) and seen == {d: len(x) for d, x in slots.items() if x}
    share = collections.Counter(s for _, s in order)
    for s, n in share.items():
        upto = np.cumsum([x == s for _, x in order]) / np.arange(1, len(order) + 1)
        assert abs(upto[60:] - n / len(order)).max() < 0.08
    goals = mixing.targets(mixing.sized(docs).select("source", "size"))
    assert mixing.schedule(goals, 4).count() > 5 * mixing.schedule(goals, 40).count()


# Pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


@pytest.fixture(scope="module")
def own():
    with open(queries.piece_model(), "rb") as f:
        return piece_bpe.PieceBpe(f.read())


def test_pieces_equal_the_library(library, own):
    rng = np.random.default_rng(9)
    parts = [" ", "  ", "\n", "\t", "▁", "the", "tion", "é", "日本", "🙂", "<0x0A>", "<s>", "...", "1234", "\r\n", "\x00", "ing", " " * 9, "Z", "//"] + [str(x) for x in rng.choice([*own.id], 200)]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 9)))
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text) and own.decode(ids) == library.decode(ids.tolist()), repr(text)


def test_pieces_of_tables(spark, library, odd, none):
    for docs in (odd, spark.read.parquet(f"{SF_DIR}/documents.parquet")):
        tokens = piece_bpe.encode(docs, queries.piece_model())
        for r in tokens.collect():
            assert r.ids == library.encode(r.text or "")
        for r in piece_bpe.decode(tokens, queries.piece_model()).collect():
            assert r.decoded == library.decode(list(r.ids))
    assert piece_bpe.round_trip(none, queries.piece_model()).count() == 0


# Archives


def test_archives(spark, tmp_path):
    rows = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (2, None, "<p>x</p>"), (None, "n", "<p>x</p>"), (5, "big", "y" * 200_000), (6, "é", "ü🙂"), (7, "seven", "7")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, file int")
    first = {"<p>x</p>": 1, "": 3}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = sorted(str((i, len((h or "").encode()), digest(h or ""), "response" if first.get(h or "", i) == i else "revisit", None if first.get(h or "", i) == i else first[h or ""])) for i, _, h in rows)
    written = []
    for k, source in enumerate((pages, pages.repartition(5))):
        target = warc.write(source, f"file://{tmp_path}/w{k}", roll=2000)
        got = warc.read(spark, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert sorted(str(tuple(r)) for r in got.collect()) == want
        files = sorted((tmp_path / f"w{k}").glob("*.warc.gz"))
        written.append([(f.name, f.read_bytes()) for f in files])
        manifest = json.loads((tmp_path / f"w{k}" / "manifest.json").read_text())
        assert [(m["file"], m["bytes"]) for m in manifest["files"]] == [(n, len(b)) for n, b in written[-1]]
    assert written[0] == written[1] and len(written[0]) > 1
    payload = {r.page_id: r.payload for r in warc.read(spark, target).where("payload is not null").collect()}
    assert bytes(payload[6]).decode() == "ü🙂" and len(payload[5]) == 200_000
    records = [h for _, b in written[0] for h, _ in warc.parse(b)]
    assert [h["warc-type"] for h in records].count("warcinfo") == len(written[0])
    urns = {h["warc-record-id"]: h for h in records if h["warc-type"] == "response"}
    revisits = [h for h in records if h["warc-type"] == "revisit"]
    assert revisits and all(urns[h["warc-refers-to"]]["warc-target-uri"] == h["warc-refers-to-target-uri"] and urns[h["warc-refers-to"]]["x-page-id"] == h["x-refers-to-page-id"] for h in revisits)
    (tmp_path / "w1" / "records-9999999999-000.warc.gz").write_bytes(written[0][0][1])  # of no manifest
    assert warc.read(spark, target).count() == len(rows)
    target = warc.write(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, target).count() == 0


def test_large_record_and_damage(monkeypatch):
    big = warc.record(1, "u", b"z" * (17 << 20), "D", None)
    assert big.endswith(b"\0") and len([*warc.parse(big)][0][1]) > 17 << 20
    with pytest.raises(ValueError):
        [*warc.parse(big[:-30])]


def test_least_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "x" * 9), (4, "d", "x" * 9)], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.read(spark, warc.write(pages, f"file://{tmp_path}/w", least_bytes=5)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources", "SentencePiece encoding"]
    out = corpus_pipeline.run(spark, SF_DIR)
    rows = out.collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def test_registered():
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.queries()} == set(map(str, range(1, 14)))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, SF_DIR)
    told = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(told.columns) == columns
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[k] for c, k in df.dtypes} == dict(zip(told.columns, map(str, told.types), strict=True))
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"select {quoted} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, want))


def folder(tmp_path, spark, rows):
    """Tables of one's own, as the queries read them."""
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "An MIT license, the Apache-license; GENERAL public  License\nmit license", None, None), (3, "An MIT license, the Apache-license; GENERAL public  License\nmit license", None, None), (None, "Beerware licence \u00e9t\u00e9", "en", "b"), (5, "general public license " * 3000, "fr", "b"), (6, " \n\t ", "en", None)]


def test_op4_columns(spark, tmp_path):
    got = queries.op4_license_scan(spark, folder(tmp_path, spark, ODD)).collect()
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = []
    for i, text, *_ in ODD:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = sorted((k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        want.append(str((i, len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))))
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(want)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert {r.labels for r in got if r.doc_id is None} == {"beerware"}


def test_op9_columns(spark, tmp_path, library):
    got = queries.op9_piece_bpe(spark, folder(tmp_path, spark, ODD)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, text, *_ in ODD:
        ids = library.encode(text or "")
        want.append(str((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))))
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in got) == sorted(want)


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    good = ["the people of the town went home", "a river runs by the old mill", "letters came in the morning", "they sold bread at the market", "rain fell on the garden wall", "the music of the house was soft"]
    rows = [*ODD, *((10 + k, f"{good[k % 6]} and {good[(k + k // 6 + 1) % 6]} at {k}\n{good[(k + 3) % 6]} again", "en", "ab"[k % 2]) for k in range(24))]
    base = folder(tmp_path, spark, rows)
    labels(spark, [(10 + k, 1, 0) for k in range(24)] + [(None, None, None)]).write.parquet(f"{base}/labels.parquet")
    docs = documents(spark, rows)  # with columns of clashing names
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, base)
        assert out.columns == docs.columns and 0 < out.count()
        assert step(spark, docs.limit(0), base).count() == 0
    out = corpus_pipeline.run(spark, base).collect()
    assert {r.doc_id for r in out} <= {r[0] for r in rows} and all(len(r.ids) == r.n_tokens for r in out)


def test_simhash_broadcasts_nothing_that_grows(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} and word{k % 5} go on {k % 9}") for k in range(60)], "doc_id long, text string")
    for found in (simhash.near_duplicates(docs), simhash.keep_first(docs)):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
