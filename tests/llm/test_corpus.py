"""Mixing, infilling and ranked search, brute-force models of quality, language and toxicity, and every stage on odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import time
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lectern.llm import infilling, langid, licenses, mixing, quality, ranking, secrets, sharding, toxicity

LONG = "the same words go on and on. " * 3000
KINDS = "doc_id bigint, text string, lang string, source string, row string, words string, score double"
ODD = [
    (1, None, "a"), (2, "", None), (3, "  \n\t ", "a"), (4, "x", "b"), (5, "x", "b"), (5, "x", "b"), (None, "no key here", None), (None, "x", None),
    (6, LONG, "a"), (7, LONG, "a"), (8, "Ünïcödé 日本語 🙂 ſ K İ Σ", "b"), (9, "a <P> marker", "b"), (10, "🙂é", "a"), (11, "words that stand alone", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, s, s, "r", "w", 0.5) for i, t, s in ODD], KINDS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], KINDS)


# -- mixing -----------------------------------------------------------------------


def _plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Shared again and again until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in full]
        each = (budget - sum(full.values())) / sum(weight[s] for s in left) if left else 0.0
        over = [s for s in left if weight[s] * each > most * sizes[s]]
        if not over:
            return {**{s: weight[s] * each for s in left}, **full}
        full.update({s: most * sizes[s] for s in over})


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5000, None: 7}, {"a": 0, "b": 10}, {"only": 50}, {"a": 0}, {f"s{i:02}": (i * 37) % 11 * 100 for i in range(20)},
])
def test_targets_are_shared_again_until_none_is_above(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = _plain_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", int(rng.integers(0, 400)) if i % 50 else 9000) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    first = mixing.mix_sources(df.repartition(7)).collect()
    again = {r.doc_id: r.taken for r in mixing.mix_sources(df.repartition(3)).collect()}
    assert {r.doc_id: r.taken for r in first} == again and all(0 <= r.taken <= 2 * r.size for r in first)
    taken, target = collections.Counter(), {}
    for r in first:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= target[s] / 1000 + 2 for s in target)
    assert sum(taken.values()) == math.floor(1.5 * sum(r.size for r in first))


def test_mixture_is_ordered_by_finish_time(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(40)], "doc_id bigint, source string, size bigint")
    got = sorted(mixing.mixture(df).where("served > 0").collect(), key=lambda r: r.position)
    assert [r.finish for r in got] == sorted(r.finish for r in got)
    assert [r.position for r in got] == list(np.cumsum([0, *[r.served for r in got]])[:-1])
    # a stops at twice its words, 400, and b has the other 200, so two packets of a go with each of b
    assert all(sum(r.queue == 1 for r in got[:k]) == 2 * k // 3 for k in range(3, 60, 3))


# -- fill in the middle -------------------------------------------------------------


TEXTS = [t or "" for _, t, _ in ODD] + ["ascii only", "é", "日" * 50, "a🙂b" * 20, "\x00\x7f", "<P", "S>", "<<S>", "M>x<", "߿ࠀ￿\U00010000"]


def test_byte_cuts_are_those_of_the_text():
    data = pa.array(TEXTS, pa.string())
    for array in (data, data.slice(3), data.cast(pa.large_string()), data.slice(2, 0)):
        index = infilling.ExceptionIndex(*infilling.string_parts(array))
        texts = array.to_pylist()
        assert index.lengths().tolist() == [len(t) for t in texts]
        for share in (0.0, 0.3, 0.5, 1.0):
            cuts = np.array([int(len(t) * share) for t in texts], np.int64)
            assert index.byte_cuts(cuts).tolist() == [len(t[:c].encode()) for t, c in zip(texts, cuts)]


def test_infilling_against_plain_strings(spark):
    rows = [(i if i % 9 else None, TEXTS[i % len(TEXTS)], "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, infill string").repartition(3)
    made = infilling.fill_in_middle(df).withColumn("back", infilling.restored(F.col("infill.output"), F.col("infill.form")))
    forms = collections.Counter()
    for r in made.collect():
        h = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        t, n = r.text, len(r.text)
        a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
        pre, mid, suf = t[:a], t[a:z], t[z:]
        form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        cuts = (None, None) if form == "plain" else (a, z - a)
        assert tuple(r.infill) == (n, form, *cuts, out) and r.back == t
        forms[form] += 1
    assert len(forms) == 3


# -- ranked search ------------------------------------------------------------------


def _ranked(docs, items, top=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    tfs = [(i, collections.Counter(words(t))) for i, t in docs]
    tfs = [(i, tf) for i, tf in tfs if tf]
    n, length, df = len(tfs), sum(sum(tf.values()) for _, tf in tfs), collections.Counter(t for _, tf in tfs for t in tf)
    terms = collections.defaultdict(set)
    for item, t in items:
        terms[item].update(words(t))
    out = []
    for item, own in terms.items():
        scored = []
        for i, tf in tfs:
            m = 10 + (90 * sum(tf.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in own if t in tf)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _n, _i, i) in enumerate(sorted(scored)[:top], start=1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block_docs", "bundle_items"), [(4096, 256), (5, 2), (40, 1)])
def test_search_against_brute_force(spark, odd, block_docs, bundle_items):
    rng = np.random.default_rng(7)
    docs = [(int(i), " ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.3, rng.integers(0, 60)))) for i in range(100, 330)]
    docs += [(400 + k, docs[0][1]) for k in range(30)] + [(i, t) for i, t, _ in ODD]
    items = [(int(k), " ".join(f"W{min(int(x), 400)}" for x in rng.zipf(1.3, 12))) for k in range(5)] + [
        (None, "The same WORDS x"), (9, ""), (10, None), (11, "日本語 nothere"), (12, "w1"), (12, "w2 w1"), (13, "unknown")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = ranking.rank_documents(d, i, block_docs=block_docs, bundle_items=bundle_items).collect()
    assert sorted(map(tuple, got), key=str) == _ranked(docs, items)


def test_search_of_empty_tables(spark, nothing, odd):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "x words")], "item_id bigint, text string")
    for d, i in ((nothing, some), (odd, none), (nothing, none)):
        assert ranking.rank_documents(d, i).collect() == []


def test_new_operators_on_odd_rows(odd, nothing):
    for df in (odd, nothing):
        n = df.count()
        mixed = mixing.mix_sources(mixing.sized_rows(df).withColumn("taken", F.lit("given"))).collect()
        filled = infilling.fill_in_middle(df)
        assert len(mixed) == n and filled.count() == n and filled.columns == [*df.columns, "infill"]
        assert filled.where("row = 'r' AND words = 'w' AND score = 0.5").count() == n
        assert all(r.taken <= 2 * r.size for r in mixed)


# -- brute-force models ----------------------------------------------------------------


def test_quality_ratio_against_a_plain_loop(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    trusted = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    grams = {}
    for i, t in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams[i] = [g for w, b in zip(words, ["", *words]) for g in ((w,), (w[-3:],), (b, w))]
    singles = sorted({g[0] for gs in grams.values() for g in gs if len(g) == 1})
    pairs = sorted({g for gs in grams.values() for g in gs if len(g) == 2})
    at = {(r.a,): r.h for r in spark.createDataFrame([(a,) for a in singles], "a string").select("a", F.hash("a").alias("h")).collect()}
    at |= {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.hash("a", "b").alias("h")).collect()}
    bucket = {g: h & (quality.BUCKETS - 1) for g, h in at.items()}
    raw, good = collections.Counter(), collections.Counter()
    for i, gs in grams.items():
        raw.update(bucket[g] for g in gs)
        if i in trusted:
            good.update(bucket[g] for g in gs)
    raw_n, good_n = sum(raw.values()) + quality.BUCKETS, sum(good.values()) + quality.BUCKETS
    gain = lambda b: math.log((good[b] + 1) / good_n) - math.log((raw[b] + 1) / raw_n)
    from lectern.llm.queries import QUERIES

    verdicts = collections.Counter()
    for r in QUERIES["op4_quality_rules"](spark, SMALL).collect():
        gs = grams[r.doc_id]
        ratio = sum(gain(bucket[g]) for g in gs) / len(gs) if gs else 0.0
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert math.isclose(r.ratio, ratio, abs_tol=1e-9) and r.base_failed == failed and r.kept == (not failed and ratio >= quality.MIN_RATIO)
        verdicts[r.kept] += 1
    assert len(verdicts) == 2


def _plain_bits(trainings, text, order=langid.ORDER):
    """Prediction by partial matching, byte by byte; before a text stand line breaks."""
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    pad = bytes([langid.PAD]) * order
    for t in trainings:
        whole = pad + t
        for p in range(order, len(whole)):
            for k in range(order + 1):
                counts[k][whole[p - k : p]][whole[p]] += 1

    def chances(context):
        k = len(context)
        shorter = [1 / 256] * 256 if k == 0 else chances(context[1:])
        seen = counts[k].get(context)
        if not seen:
            return shorter
        free, total = sum(p for b, p in enumerate(shorter) if b not in seen), sum(seen.values()) + len(seen)
        return [seen[b] / total if b in seen else len(seen) * p / free / total for b, p in enumerate(shorter)]

    whole = pad + text
    return sum(-math.log2(chances(whole[p - order : p])[whole[p]]) for p in range(order, len(whole)))


def test_code_lengths_against_a_plain_loop():
    trainings = {"a": [b"the cat sat on the mat", b"a cat"], "b": ["größe über öl".encode(), b"der kater"], "c": [b"zz"]}
    model = langid.Model(trainings)
    texts = [b"", b"the mat", "über\x00größe".encode(), b"qqqq", b"cat\ncat"]
    got = model.code_lengths(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    want = [[_plain_bits(trainings[name], t) for name in model.languages] for t in texts]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_languages_of_long_documents_are_learned(spark):
    long_text, rows = "quelques mots qui vont ensemble dans une phrase. " * 900, []
    for i in range(60):
        rows.append((i, long_text if i % 2 else "some words that go together in a sentence. " * 5, "fr" if i % 2 else "en"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df)
    assert model.languages == ["en", "fr"]
    assert all(r.language.lang_pred == r.lang for r in langid.identify(df, model).collect())


def test_swapped_sentences_against_a_plain_fit():
    texts = ["muslims awful", "the muslims awful", "jews fine", "jews and muslims fine", "people fine", "people awful", "christians fine today"] * 3
    toxic = np.array(["awful" in t for t in texts])
    names = sorted(set().union(*map(toxicity.features_of, texts)))
    index, n = {f: i for i, f in enumerate(names)}, len(texts)
    rows = [sorted(index[f] for f in toxicity.features_of(t)) for t in texts]
    fair, decay, rounds = 3.0, 2e-4, 150
    model = toxicity.train(rows, toxic, names, rounds=rounds, decay=decay, fair=fair)
    x = np.zeros((n, len(names)))
    for i, r in enumerate(rows):
        x[i, r] = 1
    # every swap of two terms of a kind in every sentence that changes it, and once for each pair alone
    deltas = []
    for a, b in toxicity.swaps():
        if a in index and b in index:
            alone = np.zeros(len(names))
            alone[index[a]], alone[index[b]] = 1, -1
            deltas.append(alone)
            for t in texts:
                swapped = " ".join({a: b, b: a}.get(w, w) for w in t.split())
                change = np.zeros(len(names))
                for f in toxicity.features_of(t):
                    change[index[f]] += 1
                for f in toxicity.features_of(swapped):
                    change[index[f]] -= 1
                if change.any():
                    deltas.append(change)
    d = np.array(deltas)
    each = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (n - toxic.sum()))
    w, bias, mean, spread = np.zeros(len(names)), 0.0, 0.0, 0.0
    for t in range(1, rounds + 1):
        wrong = (1 / (1 + np.exp(-(x @ w + bias))) - toxic) * each
        both = np.append(x.T @ wrong + decay * w + fair / n * d.T @ (d @ w), wrong.sum())
        mean, spread = 0.9 * mean + 0.1 * both, 0.999 * spread + 0.001 * both**2
        step = 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    assert np.allclose([model.weights.get(f, 0.0) for f in names], w, atol=1e-8) and math.isclose(model.bias, bias, abs_tol=1e-8)


def test_toxicity_query_scores_by_the_model(spark):
    from lectern.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = QUERIES["op8_toxicity"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
        words = set(re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower()))
        heads = {w[:k] + "*" for w in words - toxicity.TERMS for k in toxicity.PREFIXES if len(w) > k}
        logit = model.bias + sum(model.weights.get(f, 0.0) for f in words | heads)
        assert math.isclose(r.score, 1 / (1 + math.exp(-logit)), abs_tol=1e-9)


# -- results can be filtered, secrets of any length, notices ------------------------------


def test_results_are_filtered_without_working_them_out_twice(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    begun = time.monotonic()
    once = secrets.scan_secrets(docs).withColumn("text", secrets.redacted(F.col("text"), F.col("secrets.spans")))
    assert secrets.scan_secrets(once).where("size(secrets.base) > 0 AND secrets.n_hex > 0").count() == 0
    derived = licenses.scan_licenses(docs).withColumn("text", F.concat("text", F.lit(" "), "licenses.labels"))
    assert licenses.scan_licenses(derived).where("licenses.n_words > 5 AND licenses.score > 0").count() >= 0
    ratios = [0.0] * 8
    judged = quality.judge_quality(docs, ratios).withColumn("text", F.concat_ws(" ", "text", F.col("quality.n_words").cast("string")))
    assert quality.judge_quality(judged, ratios).where("quality.kept AND quality.n_words > 60").count() > 0
    assert time.monotonic() - begun < 60


def test_a_given_column_of_the_result_is_replaced(odd):
    for scan, name in ((licenses.scan_licenses, "licenses"), (secrets.scan_secrets, "secrets"), (lambda d: quality.judge_quality(d, [0.0] * 4), "quality")):
        out = scan(odd.withColumn(name, F.lit("given")))
        assert out.columns == [*odd.columns, name] and out.where(f"{name} IS NOT NULL").count() == len(ODD)


def test_sharding_keeps_columns_of_any_name(odd):
    named = odd.withColumns({"_at": F.lit("given"), "at": F.lit("too"), "shard": F.lit("old")})
    out = sharding.shard_mixture(named)
    assert out.columns == [*[c for c in named.columns if c != "shard"], "shard", "slot"]
    assert out.where("_at = 'given' AND at = 'too' AND row = 'r'").count() == len(ODD)


def test_long_keys_are_linked_and_masked(spark):
    key = "aB3/" * 100
    df = spark.createDataFrame([(1, f"user: alice and {key} here"), (2, f"only {key}")], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan_secrets(df).withColumn("clean", secrets.redacted(F.col("text"), F.col("secrets.spans"))).collect()}
    assert [s.split(":")[0] for s in got[1].secrets.listed.split(",")] == ["weak_id", "weak_secret"] and key not in got[1].clean
    assert got[2].secrets.listed == ""


def test_notices_and_bodies(spark):
    said = {
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License": "gpl-3",
        "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of": "lgpl-2.1",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that": "isc",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.": "apache-2",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "bsd",
        "Permission to copy nothing, the general public lives here, and redistribution of wealth in source forms": "",
        "The permission slip was granted free of charge to any person": "",
    }
    df = spark.createDataFrame(list(said.items()), "text string, label string")
    for r in licenses.scan_licenses(df).collect():
        labels = r.licenses.labels.split(",")
        assert r.label in labels if r.label else labels == [""], (r.text, labels)


# -- pipeline ---------------------------------------------------------------------------


def test_stages_on_odd_rows(spark, odd, nothing):
    for df in (odd, nothing):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, SMALL)
            rows = out.collect()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == df.columns and len(rows) <= df.count(), name
            if name == "secret_scan":
                assert len(rows) == df.count()
            if name == "packing":
                assert sum(r.start == 0 for r in rows) == df.count()
