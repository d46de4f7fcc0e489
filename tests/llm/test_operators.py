"""The operators against brute-force versions on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame
from tokenizers import Tokenizer

from trendloom.llm import (
    backoff_automaton, config_packing, golay_simhash, hilbert_shards, license_scan, projection_passes, quadratic_quality,
    suffix_repeats, token_files, tokenized, window_leaks,
)
from trendloom.llm.common import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, score double"


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


@pytest.fixture(scope="module")
def texts():
    """id -> text: copies, near copies, shared passages, null, empty, blank, one word, a long text, odd spaces."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    draw = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage = draw(70)
    out = {}
    for i in range(60):
        body = draw(rnd.choice([3, 30, 90, 200]))
        if i % 3 == 0:
            body[len(body) // 2:len(body) // 2] = passage
        out[i] = " ".join(body) + ("\n" if i % 5 == 0 else "")
    for i in range(60, 80):
        out[i] = out[i % 4 * 7]
    for i in range(80, 90):
        near = out[42].split(" ")
        near[i] = "changed"
        out[i] = " ".join(near)
    out |= {90: None, 91: "", 92: " \n\t ", 93: "one", 94: " ".join(draw(20_000)), 95: "Two  WORDS", 96: "a\x1cb c", 97: None, 98: "x " * 200}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, "src0" if i % 2 else f"s{i}", None, 1, 0.5) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def united(pairs, nodes):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_components_of_chains_stars_and_repeats(spark):
    pairs = [(i, i + 1) for i in range(30, 60)] + [(100, i) for i in range(101, 140)] + [(7, 5), (5, 7), (9, 9), (7, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {n: c for n, c in united(pairs, {x for p in pairs for x in p}).items() if n != 9}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).isEmpty()


# --- 1 -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2)])
def test_curve_visits_every_cell_by_single_steps(spark, dims, bits):
    cells = [F.expr(f"cast(floor(id / {1 << (bits * k)}) % {1 << bits} as int)").alias(f"c{k}") for k in range(dims)]
    grid = spark.range(1 << (bits * dims)).select(*cells)
    path = grid.withColumn("h", hilbert_shards.hilbert_index([F.col(f"c{k}") for k in range(dims)], bits)).orderBy("h").collect()
    assert [r.h for r in path] == list(range(1 << (bits * dims)))
    assert all(sum(abs(a[k] - b[k]) for k in range(dims)) == 1 for a, b in zip(path, path[1:]))


def test_shards(docs, texts, empty):
    rows = hilbert_shards.shard_documents(docs, 24).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    shards = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        shards[r.shard].append(r)
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1 and len(shards) == 24
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    order = [r.hilbert for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert hilbert_shards.shard_documents(empty).isEmpty()


# --- 2 -----------------------------------------------------------------------------------------

def test_license_lines(spark, empty):
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore."), (2, "licensed under CC BY-NC 4.0."), (3, None), (4, ""),
        (5, "This driver has a licence to drive, and nothing in this sentence is a notice of any kind at all."),
        (6, "x " * 300 + "end. Licensed under the Apache License, Version 2.0. " + "y " * 300), (6, "Licensed under CC BY 4.0."),
        (7, "This work is licensed under the GNU General Public License, version 2."), (None, "Released under the MIT License."),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.line, r.license, r.exact) for r in license_scan.scan_licenses(df).collect()}
    assert found == {
        (1, 1, "MIT", True), (2, 0, "CC-BY-NC-4.0", True), (6, 0, "Apache-2.0", True), (6, 0, "CC-BY-4.0", True),
        (7, 0, "GPL-2.0", True), (None, 0, "MIT", True),
    }
    assert license_scan.scan_licenses(empty).isEmpty()


def test_license_notices_over_lines_in_sentences_and_as_texts(spark):
    bsd = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met:"]
    mit = """The MIT License (MIT)\n\nCopyright (c) 2020 Somebody Else\n\nPermission is hereby granted, free of charge, to any person obtaining
    a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
    without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
    permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this
    permission notice shall be included in all copies or substantial portions of the Software."""
    rows = {
        1: "# This work is licensed under the\n# GNU General Public License, version 3.\n", 2: "This project is licensed under the MIT License.",
        3: "x = 1  # SPDX-License-Identifier: MIT", 4: "a\n * " + "\n * ".join(bsd), 5: mit,
        6: "// SPDX-License-Identifier: GPL-2.0-or-later OR Apache-2.0", 7: "This work is licensed under the GNU\nLesser General Public License, version 3.",
        8: "Licensed under either of the MIT License or the Apache License, Version 2.0 at your option.",
        9: "This project is licensed under the XYZ License.", 10: "w " * 90 + "all of it is, as was said, licensed under the Apache\nLicense, Version 2.0, by us " + "w " * 90,
        11: "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
            "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    }
    found = {(r.doc_id, r.line, r.license) for r in license_scan.scan_licenses(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect()}
    assert found == {
        (1, 0, "GPL-3.0"), (2, 0, "MIT"), (3, 0, "MIT"), (4, 1, "BSD"), (5, 0, "MIT"), (5, 4, "MIT"), (6, 0, "GPL-2.0"), (6, 0, "Apache-2.0"),
        (7, 0, "LGPL-3.0"), (8, 0, "MIT"), (8, 0, "Apache-2.0"), (10, 0, "Apache-2.0"), (11, 1, "GPL-3.0"),
    }


# --- 3 -----------------------------------------------------------------------------------------

def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, 16))
    crowd = rng.normal(size=16) + 0.08 * rng.normal(size=(700, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((base, crowd, base[:40], base[:9] * 3.0)))]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, []), (2004, [1.0, None]), (2005, [1.0, 0.0]), (2006, [2.0, 0.0])]
    got = {r.vec_id: r for r in projection_passes.near_vectors(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding").collect()}
    x = np.array([v for i, v in rows if i < 2000])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    root = united(zip(*(a.tolist() for a in np.nonzero(near))), range(len(x)))
    assert len(got) == len(rows)
    assert [got[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    assert all((got[i].component_id, got[i].kept) == (root[i], root[i] == i) for i in range(len(x)))
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(2000, 2005))
    assert (got[2005].n_links, got[2006].component_id) == (1, 2005)


def test_near_vectors_in_a_crowd(spark):
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = np.sqrt(0.3) * unit(rng.standard_normal((6000, 64))) + np.sqrt(0.7) * unit(rng.standard_normal((1, 64)))  # mutual cosine 0.7
    own = x[:300] - x.mean(axis=0)
    near = x.mean(axis=0) + 0.7 * own + 0.714 * unit(rng.standard_normal(own.shape)) * np.linalg.norm(own, axis=1, keepdims=True)
    x = np.concatenate((x, near))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in projection_passes.near_vectors(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding").collect()}
    x = unit(x)
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert [got[i] for i in range(len(x))] == want.tolist() and want.sum() > 200


def test_passes_grow_with_the_table_and_with_crowds():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    crowd = np.sqrt(0.3) * x + np.sqrt(0.7) * x[:1]
    crowd /= np.linalg.norm(crowd, axis=1, keepdims=True)
    small, large, dense = (p * w for p, w in (projection_passes.plan(x, 2000, 0.9), projection_passes.plan(x, 1_000_000, 0.9), projection_passes.plan(crowd, 1_000_000, 0.9)))
    assert small < large < dense


def test_a_small_crowd_in_a_large_table_is_compared_whole(spark, monkeypatch):
    """A crowd that the plan does not know of: with a window of two rows only whole runs find its pairs."""
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    crowd = np.sqrt(0.15) * unit(rng.standard_normal((400, 64))) + np.sqrt(0.85) * unit(rng.standard_normal((1, 64)))  # mutual cosine 0.85
    near = unit(crowd[:100] + 0.43 * unit(rng.standard_normal((100, 64))))
    x = unit(np.concatenate((rng.standard_normal((2500, 64)), crowd, near)))
    monkeypatch.setattr(projection_passes, "RUN_CHUNK", 64, raising=False)
    got = {r.vec_id: (r.n_links, r.component_id) for r in projection_passes.near_vectors(
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"),
        "vec_id", "embedding", window=2).collect()}
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    root = united(np.argwhere(links).tolist(), range(len(x)))
    assert links.sum() > 100
    assert got == {i: (int(links[i].sum()), root[i]) for i in range(len(x))}


# --- 4 -----------------------------------------------------------------------------------------

def plain_fingerprint(text):
    w = [x.encode() for x in words("".join(c.lower() if c.isascii() else c for c in text or ""))]
    parts = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(docs, texts, empty):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    root = united(pairs, prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in golay_simhash.simhash_groups(docs).collect()}
    assert got == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}
    assert golay_simhash.simhash_groups(empty).isEmpty()


def test_golay_keys_find_every_pair_within_three_bits(spark):
    rnd = random.Random(2)
    codes = [golay_simhash.decode(np.array([c]))[0] for c in (0, 1 << 22, (1 << 23) - 1)]
    assert codes[0] == codes[1] != codes[2]  # one wrong bit is corrected
    prints = set()
    for _ in range(150):
        p = rnd.getrandbits(64)
        prints.add(p)
        for _ in range(4):
            q = p
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                q ^= 1 << b
            prints.add(q)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))]
    got = golay_simhash.close_pairs(spark.createDataFrame(rows, "node bigint, fp bigint")).collect()
    want = {(a, b) for a, p in rows for b, q in rows if a < b and ((p ^ q) & ((1 << 64) - 1)).bit_count() <= 3}
    assert {(min(r), max(r)) for r in got} == want and len(want) > 300


# --- 5 -----------------------------------------------------------------------------------------

def test_golay_keys_are_not_broadcast(spark):
    """Spark sizes the keys like the classes, though there are seventy times as many."""
    classes = spark.range(2000).selectExpr("id node", "xxhash64(id) fp")
    plan = golay_simhash.close_pairs(classes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_repeats(docs, texts, empty):
    first = {}
    split = {i: words(t) for i, t in texts.items()}
    for i in sorted(split):
        for k in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][k:k + 50]), i)
    want = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k:k + 50])] < i:
                gone[k:k + 50] = [True] * 50
        left = " ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in suffix_repeats.remove_repeats(docs, kept=None).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 1000
    assert suffix_repeats.remove_repeats(empty).isEmpty()


def test_blocks_of_repeats_are_small(spark, monkeypatch):
    sizes, write = [], suffix_repeats.write_blocks
    monkeypatch.setattr(suffix_repeats, "write_blocks", lambda *a: (sizes.append(write(*a)), sizes[-1])[1])
    docs = spark.createDataFrame([(i, f"w{i} " * 20_000) for i in range(60)], "doc_id long, text string").coalesce(1)
    suffix_repeats.remove_repeats(docs)
    rows = [suffix_repeats.unpack(r.payload) for r in sizes[0].collect()]
    assert sum(map(len, rows)) == 60 and max(sum(map(len, r.column("text").to_pylist())) for r in rows) <= 1 << 20


def test_the_classifier_is_fitted_with_one_python_step_a_stage(spark, monkeypatch):
    plans = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: (plans.append(df._jdf.queryExecution().toString()), collect(df))[1])
    docs = spark.createDataFrame([(i, f"word {i} and more") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    quadratic_quality.fit(docs, labels)
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


def test_repeats_of_rows_without_a_key_and_of_rows_of_one_key(spark):
    t, u, v = (" ".join(f"{p}{i}" for i in range(60)) for p in "tuv")
    schema = "doc_id bigint, text string"
    cases = [
        ([(5, t), (5, t), (None, t), (7, t)], [("5", 0), ("5", 0), ("7", 60), ("None", 60)]),
        ([(3, t), (7, t), (7, u)], [("3", 0), ("7", 0), ("7", 60)]),  # only the copy goes, not the other text of its key
        ([(3, t), (7, u), (7, "x " + t)], [("3", 0), ("7", 0), ("7", 60)]),
        ([(None, t), (None, t), (None, u), (None, u + " x")], [("None", 0)] * 4),
        ([(3, t), (None, t), (None, "x " + t), (None, v)], [("3", 0), ("None", 0), ("None", 60), ("None", 60)]),
        ([(None, t), (None, "y " + t), (9, t + " z")], [("9", 0), ("None", 60), ("None", 60)]),
    ]
    for rows, want in cases:
        df = spark.createDataFrame(rows, schema)
        assert sorted((str(r.doc_id), r.n_removed) for r in suffix_repeats.remove_repeats(df).collect()) == want


# --- 6 -----------------------------------------------------------------------------------------

def test_language_model(docs, texts, empty):
    tokens = {i: [*words("".join(c.lower() if c.isascii() else c for c in t or "")), None] for i, t in texts.items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(x for i in train for x in tokens[i])
    pairs = Counter(p for i in train for p in zip(["<s>", *tokens[i]], tokens[i]))
    history = Counter(h for i in train for h in ["<s>", *tokens[i][:-1]])
    n, v = sum(c.values()), len(c)
    for r in backoff_automaton.score_texts(docs).collect():
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in train, len(t), sum(c[x] > 0 for x in t), n)
        p = [(c[x] + 1) / (n + v + 1) for x in t]
        m = [20 + history[h] for h in ["<s>", *t[:-1]]]
        full = [(pairs[h, x] + k * q) / (history[h] + k) for h, x, k, q in zip(["<s>", *t[:-1]], t, m, p)]
        assert math.isclose(r.base_score, sum(map(math.log10, p)), rel_tol=1e-9)
        assert math.isclose(r.score, sum(map(math.log10, full)), rel_tol=1e-9)
    assert backoff_automaton.score_texts(empty).isEmpty()


# --- 7 -----------------------------------------------------------------------------------------

def test_discriminant(spark, docs, empty):
    rng = np.random.default_rng(0)
    good = [" ".join("word" + str(x) for x in rng.integers(0, 99, 40)) + "." for _ in range(150)]
    bad = [t.upper().replace(" ", "!! ") for t in good[:60]]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")
    labels = spark.createDataFrame([*((i, int(i < 150), 0) for i in range(210)), (999, 1, 0), (3, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quadratic_quality.fit(df, labels)
    for r in quadratic_quality.score_quality(df, model).collect():
        assert (r.score >= 0.3) == (r.doc_id < 150) and 0 <= r.score <= 1
    scored = quadratic_quality.score_quality(docs.drop("score"), model)
    assert scored.count() == docs.count() and scored.filter("score is null or isnan(score)").isEmpty()
    # densities as numpy states them
    x = np.array([quadratic_quality.statistics(t.encode()) for t in good[:5]])
    z = (x - model.means[1]) @ model.factors[1].T
    cov = np.linalg.inv(model.factors[1].T @ model.factors[1])
    want = np.einsum("ij,jk,ik->i", x - model.means[1], np.linalg.inv(cov), x - model.means[1])
    assert np.allclose((z * z).sum(axis=1), want) and np.isclose(model.logdets[1], 0.5 * np.linalg.slogdet(cov)[1])
    assert quadratic_quality.keep_good(empty, quadratic_quality.fit(empty, labels)).isEmpty()


# --- 8 and 10 ------------------------------------------------------------------------------------

@pytest.mark.parametrize("name, space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_ids_equal_the_librarys(texts, name, space):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    rnd = random.Random(1)
    odd = ["".join(rnd.choice([" ", "\n", "a", "Bc", "'s", "1", "é", "\t", "!", "\x01", "　", "\x1f", "\xa0"]) for _ in range(rnd.randint(1, 12))) for _ in range(800)]
    both = [*(t for t in texts.values() if t is not None), *odd, "it's <|endoftext|> here"]
    got = tokenized.Cached(public_tokenizers.path(name), space).encode(both)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in both]


def test_token_files(spark, docs, texts, tmp_path, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_ids(docs, str(tmp_path / "f"), path)
    got = {r.id: r for r in token_files.read_ids(spark, str(tmp_path / "f")).collect()}
    plain = Tokenizer.from_file(path)
    start = 0
    for i in sorted(texts):
        ids = [*plain.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids)) and np.frombuffer(got[i].ids, "<u4").tolist() == ids
        start += len(ids)
    token_files.write_ids(empty, str(tmp_path / "e"), path)
    assert token_files.read_ids(spark, str(tmp_path / "e")).isEmpty()


@pytest.mark.parametrize("name, leading_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_of_latin_letters_skip_the_library_and_keep_its_ids(name, leading_space, monkeypatch):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    texts = ["Onbleeaea reoranat, \xc9T\xc9 na\xefve stra\xdfe", "\u0130stanbul \u0131\u0130 \xaa\xba \u01c5a \u0149x \u017fo e\u0301t", "x", "a \u03a3\u03a3 \u4e2d\u6587 \u0250b it's \xb5m \u212bb"]
    table = tokenized.Cached(path, leading_space)
    asked = []
    call = table._call
    monkeypatch.setattr(table, "_call", lambda parts: (asked.extend(parts), call(parts)))
    for text, raw in zip(texts, table.encode(texts)):
        assert np.frombuffer(raw, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert not {"onbleeaea", "Onbleeaea", " reoranat", "reoranat", "na\xefve", " na\xefve"} & set(asked)


@pytest.mark.parametrize("name, leading_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_a_piece_is_asked_for_once_among_many_texts(name, leading_space, monkeypatch):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    texts = [None, "", "\u0130, \u0130.", "a  b\n", "nul\0 byte", *["Zxqor, zxqor!! tri\nZxqor. 12-7 zxqor"] * 50, "zxqor\tzxqor"]
    table = tokenized.Cached(path, leading_space)
    given, learn = [], table._learn
    monkeypatch.setattr(table, "_learn", lambda parts: (given.extend(parts), learn(parts))[1])
    column = pa.array(["cut away", *texts], pa.string())[1:]
    for text, raw in zip(texts, table.encode_column(column).to_pylist()):
        assert np.frombuffer(raw, "<u2").tolist() == plain.encode(text or "", add_special_tokens=False).ids
    assert given.count(" zxqor" if leading_space else "zxqor") <= 2  # of regular texts, and of the others
    assert len(table.encode_column(column[:0])) == 0


def test_ranks_of_neighbouring_documents():
    rnd = np.random.default_rng(4)
    docs = [rnd.integers(0, 1 << int(rnd.integers(1, 33)), n, dtype=np.uint64).astype(np.uint32) for n in (5, 0, 1, 4, 3, 260, 2, 0)]
    edges = np.cumsum([0, *map(len, docs)])
    control, data = token_files.encode_documents(np.concatenate(docs), edges)
    assert [(c.as_py(), d.as_py()) for c, d in zip(control, data)] == [token_files.encode_ranks(d) for d in docs]
    assert token_files.decode_documents(control[2:], data[2:], np.diff(edges)[2:]).tolist() == np.concatenate(docs[2:]).tolist()


def test_ranks_of_one_to_four_bytes():
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, 7], np.uint32)
    assert token_files.decode_ranks(*token_files.encode_ranks(ranks), len(ranks)).tolist() == ranks.tolist()
    assert len(token_files.decode_ranks(*token_files.encode_ranks(ranks[:0]), 0)) == 0


def test_packing(docs, texts, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    pieces, sequences, total = defaultdict(list), defaultdict(list), 0
    for r in config_packing.pack_texts(docs, path).collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
        total += r.length
    for i, t in texts.items():
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert sorted(pieces[i]) == [(k, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.1 * math.ceil(total / 2048) + 1
    assert config_packing.pack_texts(empty, path).isEmpty()


@pytest.mark.parametrize("histogram", [{}, {2048: 3}, {1: 5000}, {1025: 10, 1023: 10}, {700: 9, 683: 9, 682: 9, 5: 100}, {2047: 4, 1: 4}])
def test_packed_histograms_are_whole(histogram):
    packed = config_packing.solve(histogram)
    used = Counter()
    for copies, times in packed:
        assert sum(n * c for n, c in copies.items()) <= 2048
        for n, c in copies.items():
            used[n] += c * times
    assert used == Counter(histogram)
    assert sum(t for _, t in packed) <= 1.05 * -(-sum(n * c for n, c in histogram.items()) // 2048) + 1


def test_packing_is_the_programs_where_longest_first_is_poor():
    """900 sequences are enough; longest-first filling takes 955."""
    rng = np.random.default_rng(6)
    histogram = Counter()
    for e in rng.integers(8, 60, 600).tolist():
        histogram.update((1024 + e, 512 + e, 512 - 2 * e))
    for e in rng.integers(8, 60, 300).tolist():
        histogram.update((512 + 2 * e, 512 + 2 * e, 512 - 2 * e, 512 - 2 * e))
    packed = config_packing.solve(histogram)
    used = Counter()
    for copies, times in packed:
        assert times > 0 and sum(n * c for n, c in copies.items()) <= 2048
        used.update({n: c * times for n, c in copies.items()})
    assert used == histogram
    assert sum(t for _, t in packed) <= 952


@pytest.mark.parametrize("seed", range(6))
def test_small_histograms_are_packed_about_as_in_the_best_way(seed):
    rng = np.random.default_rng(seed)
    pieces = sorted(rng.integers(3, 14, 9).tolist(), reverse=True)

    def best(left, rooms):
        if not left:
            return len(rooms)
        found = best(left[1:], (*rooms, 20 - left[0]))
        for k in {r: k for k, r in enumerate(rooms) if r >= left[0]}.values():
            found = min(found, best(left[1:], (*rooms[:k], rooms[k] - left[0], *rooms[k + 1:])))
        return found

    assert sum(t for _, t in config_packing.solve(Counter(pieces), 20)) <= best(pieces, ()) + 1


# --- 9 -----------------------------------------------------------------------------------------

def test_leaks(spark, texts, empty):
    base = words(texts[94])
    items = {1: base[100:130], 2: base[500:514], 3: base[900:904], 4: [], 5: base[200:240], 6: base[100:130]}
    changed = list(items[1])
    changed[0] = "other"
    rows = {
        1: "".join(c.upper() if c.isascii() else c for c in " ".join(items[1])), 2: "x " + " ".join(changed), 3: " ".join(items[5][:20]), 4: None, 5: "", 6: "a b c " + " ".join(items[3]),
        7: " ".join(items[2] + items[5]), 8: " ".join(changed[:14] + ["z"] + changed[15:]), 9: texts[1],
    }
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in items.items()), (None, None)], "item_id bigint, text string")
    want = {}
    for d, t in rows.items():
        w = words((t or "").lower())
        for i, item in items.items():
            own = window_leaks.shingles([x.lower().encode() for x in item])
            values = [
                (window_leaks.similarity(window_leaks.shingles([x.encode() for x in w[k:k + len(item)]]), own), -k)
                for k in range(len(w) - len(item) + 1)
            ] if item else []
            if values and max(values)[0] >= 0.8:
                want[d, i] = (max(values)[0], -max(values)[1], len(item))
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in window_leaks.find_leaks(df, bench).collect()}
    assert got == want and {1, 2, 6, 7} == {d for d, _ in want}
    assert {r.doc_id for r in window_leaks.drop_leaks(df, bench).collect()} == set(rows) - {1, 2, 6, 7}
    assert window_leaks.find_leaks(empty, bench).isEmpty() and window_leaks.find_leaks(df, bench.limit(0)).isEmpty()


def test_texts_shorter_than_the_item_leak_it(spark, texts):
    base = words(texts[94])
    items = {1: base[100:159], 2: base[300:310], 3: base[400:405]}
    one = items[1]
    rows = {
        1: one[:-1], 2: one[:56], 3: one[:20] + one[21:], 4: one[3:], 5: one[:30], 6: one[:-1] + ["x"], 7: items[2][:9], 8: items[2][:8],
        9: items[3][:4], 10: one[:48], 11: one[:49], 12: one[:-12] + ["y"], 13: items[2][1:],
    }
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows.items()], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    want = {}
    for d, w in rows.items():
        for i, item in items.items():
            own = window_leaks.shingles([x.lower().encode() for x in item])
            low = [x.lower().encode() for x in w]
            size = min(len(item), len(low))
            value, at = max((window_leaks.similarity(window_leaks.shingles(low[k:k + size]), own), -k) for k in range(len(low) - size + 1))
            if value >= 0.8:
                want[d, i] = (value, -at, len(item))
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in window_leaks.find_leaks(df, bench).collect()}
    assert got == want and {1, 2, 3, 4, 6, 7, 11} <= {d for d, _ in want}
    assert {r.doc_id for r in window_leaks.drop_leaks(df, bench).collect()} == set(rows) - {d for d, _ in want}


def test_tidy_hands_batches_on():
    import pyarrow as pa

    from trendloom.llm.common import tidy

    batches = [pa.RecordBatch.from_pydict({"x": [1, None]}), pa.RecordBatch.from_pydict({"x": pa.array([], pa.int64())})]
    assert list(tidy(lambda rows: (b for b in rows))(iter(batches))) == batches
    assert list(tidy(lambda rows: rows)(iter([]))) == []
