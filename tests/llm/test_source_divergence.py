"""Source divergence against a plain version over all pairs and terms, with small blocks and odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trendloom.llm import source_divergence as sd

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int, kept int, block int"


def plain(docs, min_docs, top):
    n, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in terms]
        n[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, c in in_docs[lang].items() if c >= min_docs]

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + sd.SCALE * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(n[lang, s])
        q, p = share(whole), {s: share(n[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(8)
    vocabulary = [rnd.choice(["ab", "Ä", "É", "x", "ß", "Zz"]) * rnd.randint(1, 3) + rnd.choice("abcdé") for _ in range(60)]
    out = []
    for _ in range(300):
        lang = rnd.choice(["en", "en", "en", "de", None])
        source = rnd.choice(["hot"] * 6 + [f"s{k}" for k in range(9)] + [None, ""])
        out.append((rnd.choice(", -1\x00[`{").join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))), lang, source))
    out += [(None, "en", "only null"), ("", "xx", "a"), ("rare words", "xx", "b"), ("1 2 3", "yy", "alone"), ("hot " * 60_000 + "é" * 5, "en", "s1")]
    return out + out[:20]


@pytest.mark.parametrize("group_block,term_block", [(2, 3), (16, 4096)])
def test_all_pairs_and_terms(spark, docs, group_block, term_block):
    table = spark.createDataFrame([(1, *d, "t", 1, 1, 1) for d in docs], SCHEMA).repartition(5)
    got = sd.source_divergence(table, min_docs=8, top=4, group_block=group_block, term_block=term_block)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    rows = [tuple(r) for r in got.collect()]
    want = plain(docs, 8, 4)
    assert set(rows) == want and len(rows) == len(want)
    assert any(r[2] == "term" for r in want) and any(r[2] == "pair" and r[4] == 0 for r in want)


def test_no_rows(spark):
    assert sd.source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_task_that_flushes_often_gives_the_same_counts(spark, docs, monkeypatch):
    table = spark.createDataFrame([(1, *d, "t", 1, 1, 1) for d in docs], SCHEMA).coalesce(1)
    want = {tuple(r) for r in sd.count_terms(table).collect()}
    monkeypatch.setattr(sd, "HELD", 10)
    monkeypatch.setattr(sd, "PIECE", 100)
    assert {tuple(r) for r in sd.count_terms(table).collect()} == want


def test_pieces_end_between_terms(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 10)
    text = "abc déé fghijklmnopqrstuvw x  yz".encode() * 5
    pieces = list(sd._pieces(text))
    assert b"".join(pieces) == text and len(pieces) > 5
    assert [t for p in pieces for t in sd.TERM.findall(p)] == sd.TERM.findall(text)


def test_shares_are_exact():
    rnd = random.Random(1)
    for size in (10**3, 10**9, 10**15, 10**18):
        of = [rnd.randint(size // 2 + 10, size) for _ in range(200)]
        count = [rnd.randint(0, d - sd.PRIOR) for d in of]
        want = [1 + sd.SCALE * (c + sd.PRIOR) // d for c, d in zip(count, of)]
        assert sd.shares(np.array(count), np.array(of)).tolist() == want
