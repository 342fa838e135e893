"""Operator 11 against every order applied document by document."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from grantlens.llm import filter_audit
from tests.llm import brute


def plain(rows, labels):
    """{(part, order, step): counts}; rows of (id, text, part)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = brute.words(t)
        fails = {f for f, x in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and least[t] < i)) if x}
        docs.append((part or "", fails, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine),
                    sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df, labels):
    masks = filter_audit.failing_masks(df, "doc_id", "text", "source")
    flagged = filter_audit.with_classes(masks, labels, "doc_id", {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return filter_audit.audit(filter_audit.failing_lists(flagged))


def test_every_order_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BLOCK", 7)
    monkeypatch.setattr(filter_audit, "LONG_TEXT", 300)
    rng = random.Random(3)
    rows = []
    for i, t in brute.copies(n=90, vocabulary=400, most=120):
        t = rng.choice([t, t.upper(), t + " #", rows[-1][1] if rows else t])
        rows.append((i, t, rng.choice(["a", "a", "b", None, ""])))
    rows += [(None, rows[5][1], "a"), (None, rows[5][1], "b"), (rows[5][0], rows[5][1], "a"), (7, "other text", "b"), (200, None, "a"), (201, "", None)]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 90, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5000, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {c: F.lit("clash") for c in ("key", "part", "mask", "place", "ids")}).repartition(5)
    out = result(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("key", F.lit(1))).collect()
    want = plain(rows, labels)
    assert len(out) == len(want) == 3 * 600
    for r in out:
        assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) == \
            want[r["part"], r["filter_order"], r["step"]]


def test_awkward_and_empty_tables(spark):
    df = brute.awkward(spark).withColumn("source", F.lit("one"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = result(df, none).where("step = 5").select("kept").distinct().collect()
    n = df.count()
    assert len(out) == 1 and 0 <= out[0][0] < n
    assert result(brute.empty(spark), none).collect() == []


def test_galloping_set_operations():
    rng = np.random.default_rng(1)
    for n, m in ((0, 0), (0, 9), (5000, 3), (3, 5000), (4000, 3000), (2000, 2000)):
        a, b = (np.sort(rng.choice(9000, k, replace=False)) for k in (n, m))
        assert np.array_equal(filter_audit.gallop(a, b), np.searchsorted(a, b))
        assert np.array_equal(filter_audit.united(a, b), np.union1d(a, b))


def test_lists_hold_ids_in_order_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BLOCK", 10)
    df = spark.createDataFrame([(i, "x", "hot") for i in range(95)], "doc_id long, text string, source string")
    masks = filter_audit.failing_masks(df, "doc_id", "text", "source").withColumn("classes", F.lit(0))
    rows = filter_audit.failing_lists(masks, 5, 1).collect()
    assert all(len(r["ids"]) <= 10 and list(r["ids"]) == sorted(r["ids"]) and len(r["places"]) == 6 for r in rows)
    assert sorted(i for r in rows for i in r["ids"]) == list(range(95))
    assert sum(len(r["places"][4]) for r in rows) == 94 and sum(len(r["places"][0]) for r in rows) == 95
