"""Operator 12 against comparing all words with all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantlens.llm import spelling
from tests.llm import brute


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == (b[i + 1:] if len(a) == len(b) else b[i:])


def plain_counts(rows, damage=97):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if n >= 3 and len(w) >= 5}


def plain(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = [form, None, n, len(near), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def words(seed, n, letters="abé", least=3, most=9):
    rng = random.Random(seed)
    made = set()
    while len(made) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
        made |= {w, w[:1] + w, w + w[-1]}
    return sorted(made)


@pytest.mark.parametrize("chunk", [20_000, 40])
def test_pairs_match_all_against_all(spark, monkeypatch, chunk):
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    vocab = words(1, 500)
    df = spark.createDataFrame([(w, i) for i, w in enumerate(vocab)], "word string, n long")
    got = spelling.near_pairs(df).collect()
    want = {(a, b) for a in vocab for b in vocab if a < b and one_edit(a, b)}
    assert len(got) == len(want) and {(min(r), max(r)) for r in got} == want


def test_acceptor_is_minimal_and_numbers_words():
    codes = np.array(["abcx", "abdx", "bbcx", "bbdx", "bbdy"], dtype="<U4").view(np.uint32).reshape(-1, 4)
    a = spelling.Acceptor(np.zeros(5, np.int64), codes)
    # "a(bcx|bdx)" and "b(bcx|bdx|bdy)" share the state behind c; nothing else has equal languages
    assert [len(layer[0]) - 1 for layer in a.layers] == [1, 2, 2, 2]
    state, at = a.initial, a.base
    for d in range(4):
        row, arc = a.arcs(d, state)
        state, at = a.layers[d][2][arc], at[row] + a.layers[d][3][arc]
    assert sorted(at.tolist()) == [0, 1, 2, 3, 4]


def test_variants_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    monkeypatch.setattr(spelling, "LONG_TEXT", 200)
    rng = random.Random(2)
    vocab = words(5, 400, "abcÀ", 4, 7) + ["Chain", "chainA", "chains", "chainsé", "chain×"]
    rows = [(i if i else None, " ".join(rng.choice(vocab[:rng.randint(5, len(vocab))]) + rng.choice(["", ",", "1", "Ā"])
                                        for _ in range(rng.randint(0, 90)))) for i in range(150)]
    rows += [(3, None), (4, ""), rows[-1], (5, "chains " * 40 + "chainA " * 9 + "chain " * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "key")}).repartition(4)
    counts = plain_counts(rows)
    v = spelling.vocabulary(df, "doc_id", "text", damage=97)
    assert {r["word"]: r["n"] for r in v.collect()} == counts
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(v).collect()}
    assert got == plain(counts)
    assert any(r[1] not in (w, r[0]) for w, r in got.items())  # a root behind the form


def test_awkward_and_empty_tables(spark):
    df = brute.awkward(spark)
    out = spelling.variants(spelling.vocabulary(df, "doc_id", "text", damage=97)).collect()
    assert {r["word"]: r["n"] for r in out} == {}
    assert spelling.variants(spelling.vocabulary(brute.empty(spark), "doc_id", "text")).collect() == []


def test_query_on_the_small_table_matches_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["word"]: tuple(r)[1:] for r in spelling.op12_spelling_variants(spark, path).collect()}
    assert got == plain(plain_counts(rows))
