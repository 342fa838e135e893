"""Operators 1 and 4 against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from grantlens.llm import jaccard, substring_dedup
from tests.llm import brute


def removed(df, window=20):
    out = substring_dedup.remove_duplicates(df, "doc_id", "text", window).collect()
    return out, {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["kept"])) for r in out if r["doc_id"] is not None}


@pytest.mark.parametrize("vocabulary", [3, 40])
def test_spans_match_brute_force(spark, vocabulary):
    rows = brute.copies(vocabulary=vocabulary)
    df = brute.awkward(spark, rows)
    out, got = removed(df)
    assert got == brute.repeats_removed([(r["doc_id"], r["text"]) for r in df.collect()])
    assert len(out) == df.count()
    assert sum(x[1] for x in got.values()) > 0
    lone = next(r for r in out if r["doc_id"] is None)
    assert lone["n_removed"] == 0 and lone["n_words"] == 7


def test_factors_are_copies(spark):
    rows = brute.copies(seed=9)
    text = {i: brute.words(t) for i, t in rows}
    for r in removed(spark.createDataFrame(rows, "doc_id long, text string"))[0]:
        for f in r["factors"]:
            n = f["end"] - f["start"]
            assert n >= 20 and (f["ref_doc"], f["ref_start"]) < (r["doc_id"], f["start"])
            assert text[r["doc_id"]][f["start"]:f["end"]] == text[f["ref_doc"]][f["ref_start"]:f["ref_start"] + n]


def test_documents_of_the_driver(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert removed(df)[1] == brute.repeats_removed([(r["doc_id"], r["text"]) for r in df.collect()])


def near_copies():
    rng = random.Random(3)
    names = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(names) for _ in range(rng.randint(2, 90))]
        for _ in range(rng.choice([1, 2, 5, 60])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(names)
            if rng.random() < 0.3:
                w = w[:rng.randint(len(w) * 3 // 4, len(w))]
            rows.append((len(rows), " ".join(w)))
    return rows + [(9003, "A b"), (9004, "a B"), (9005, "a b c")]


@pytest.mark.parametrize("block,frequent,probe", [(1 << 19, 50, 25), (300, 3, 0)])
def test_components_match_brute_force(spark, monkeypatch, block, frequent, probe):
    monkeypatch.setattr(jaccard, "PROBE", probe)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "QUERIES", block)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    df = brute.awkward(spark, near_copies())
    out = jaccard.jaccard_components(df, "doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is not None}
    assert got == brute.jaccard_components([(r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is not None])
    assert len(out) == df.count() and any(k != c for k, (_, c) in got.items())
    assert [r["component_id"] for r in out if r["doc_id"] is None] == [None]
    rows = [(r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is not None]
    assert sorted((r["doc_id"], r["n_links"]) for r in out if r["doc_id"] is not None) == sorted((i, n) for (i, _), n in zip(rows, brute.jaccard_links(rows)))


def test_different_texts_under_one_id_are_one_node(spark):
    rng = random.Random(6)
    a, b = ([f"{x}{rng.randint(0, 99)}" for _ in range(60)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-1], "end"])), (3, " ".join(b)), (4, "alone with its few words"), (4, "alone with its few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(tuple(r) for r in jaccard.jaccard_components(df, "doc_id", "text").select("doc_id", "component_id", "n_links").collect())
    assert out == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 1), (4, 4, 1)]
    kept = jaccard.one_of_each(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([rows[0], rows[1], rows[4]])


def test_one_of_each_group_stays(spark):
    df = brute.awkward(spark, near_copies())
    whole = brute.jaccard_components([(r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is not None])
    kept = jaccard.one_of_each(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(i for i, (_, c) in whole.items() if c == i)
    assert kept.where("doc_id is null").count() == 1


def test_empty_tables(spark):
    assert removed(brute.empty(spark))[0] == []
    assert jaccard.jaccard_components(brute.empty(spark), "doc_id", "text").collect() == []
    assert jaccard.one_of_each(brute.empty(spark), "doc_id", "text").collect() == []


def test_hot_anchors_take_the_joined_way(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    rows = brute.copies(seed=8, vocabulary=3)
    assert removed(spark.createDataFrame(rows, "doc_id long, text string"))[1] == brute.repeats_removed(rows)


def test_many_rows_of_one_id_gather_no_spans_twice(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").unionByName(
        spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(f"own {text} end").alias("text")))
    out = substring_dedup.remove_duplicates(df)
    rows = out.groupBy("doc_id", "n_words", "n_removed", F.size("factors").alias("factors")).count().collect()
    assert sorted(map(tuple, rows)) == [(1, 40, 0, 0, 1), (7, 42, 40, 1, 3000)]


def thue_morse(n, a="a", b="b"):
    """Two different texts of n letters whose polynomial hashes modulo 2**64 are equal for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


def test_words_that_polynomials_confuse_are_told_apart(spark):
    x, y = thue_morse(4096)
    u, v = thue_morse(64)
    rows = [(1, " ".join([*(f"w{i}" for i in range(10)), x, *(f"w{i}" for i in range(10, 30))])),
            (2, " ".join([*(f"w{i}" for i in range(10)), y, *(f"w{i}" for i in range(10, 30))])),
            (3, " ".join([*(f"v{i}" for i in range(20)), u])), (4, " ".join([*(f"v{i}" for i in range(20)), v]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_duplicates(df).collect()}
    want = brute.repeats_removed(rows)
    for i, (n, removed, kept) in got.items():
        assert (n, removed, brute.sha(kept)) == want[i]
    assert got[2][1] == 20 and got[4][1] == 20
    linked = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df, "doc_id", "text").collect()}
    assert linked == {i: c for i, (_, c) in brute.jaccard_components(rows, 4, 85).items()} and linked[2] == 2


def test_hashes_of_words():
    import numpy as np

    from grantlens.llm.common import RangeHash
    words = [b"", b"a", b"aa", b"\0", b"\0\0", b"abcdefgh", b"abcdefgi", b"abcdefgh\0", b"x" * 64, b"x" * 65, b"x" * 66, *(t.encode() for t in thue_morse(1024)),
             *(t.encode() for t in thue_morse(32)), *(f"word{i}".encode() for i in range(5000))]
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    h = RangeHash(5).words(np.frombuffer(b"".join(words), np.uint8), start, end)
    assert len(set(h.tolist())) == len(words)
    alone = [RangeHash(5).words(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words]
    assert h.tolist() == [int(x) for x in alone] and h[1] != RangeHash(6).words(np.frombuffer(b"a", np.uint8), np.array([0]), np.array([1]))[0]
