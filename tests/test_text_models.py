"""Relational text models: planted signal, brute force and independence of the partitioning."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantlens.operators import sparse_models as sparse
from grantlens.operators import text, topics
from grantlens.operators import word_vectors as wv


def _labelled(spark, n=300):
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        y = i % 2
        words = [rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.randint(0, 6))]
        words += [rnd.choice(["good", "fine"] if y else ["bad", "poor"])] if rnd.random() < 0.9 else []
        rnd.shuffle(words)
        rows.append((i, " ".join(words), y))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_classifiers_learn_planted_terms(spark):
    out = {r.modelo: r for r in text.text_classifiers(_labelled(spark)).collect()}
    assert set(out) == {"Naive Bayes", "Logistic Reg.", "SVM Lineal"}
    assert all(r.auc > 0.9 and r.n == 60 for r in out.values())


def _dense(documents, pairs):
    docs = {r.gid: (r.label, r.weight) for r in documents.collect()}
    rows = pairs.collect()
    terms = sorted({r.term for r in rows})
    x = np.zeros((len(docs), len(terms)))
    at = {g: i for i, g in enumerate(docs)}
    for r in rows:
        x[at[r.gid], terms.index(r.term)] = r.x
    y, w = (np.array([v[i] for v in docs.values()], float) for i in (0, 1))
    return terms, x, y, w


@pytest.mark.parametrize("loss", ["logistic", "hinge"])
def test_linear_weights_match_a_dense_solver(spark, monkeypatch, loss):
    monkeypatch.setattr(sparse, "LEAST_GAIN", 1e-9)
    documents = sparse.weighted_documents(text.split_documents(_labelled(spark, 120)).where("split = 'train'"))
    pairs = sparse.valued_terms(documents, sparse.inverse_frequencies(documents))
    weights, bias = sparse.fit_linear(sparse.term_arrays(pairs), sparse.LOGISTIC if loss == "logistic" else sparse.SQUARED_HINGE, 0.05)
    terms, x, y, w = _dense(documents, pairs)
    got = {r.term: r.w for r in weights.collect()}
    assert sorted(got) == terms
    s, share = 2 * y - 1, w / w.sum()
    have = x.sum(axis=1) > 0  # documents without a known term have no margin to move

    def objective(v, b):
        z = x[have] @ v + b
        each = np.logaddexp(0, -s[have] * z) if loss == "logistic" else np.maximum(0, 1 - s[have] * z) ** 2
        return (each * share[have]).sum() + 0.025 * v @ v
    v, b = np.zeros(len(terms)), 0.0
    for _ in range(20_000):  # plain gradient steps
        z = x[have] @ v + b
        r = -s[have] / (1 + np.exp(s[have] * z)) if loss == "logistic" else -2 * s[have] * np.maximum(0, 1 - s[have] * z)
        r = r * share[have]
        v, b = v - 0.05 * (x[have].T @ r + 0.05 * v), b - 0.05 * r.sum()
    mine = objective(np.array([got[t] for t in terms]), bias)
    assert mine == pytest.approx(objective(v, b), rel=1e-4)


def test_no_documents_of_a_part(spark):
    one = spark.createDataFrame([(1, "a b", 1)], "doc_id long, text string, label int")
    assert sorted(r.modelo for r in text.text_classifiers(one).collect()) == ["Logistic Reg.", "Naive Bayes", "SVM Lineal"]


def test_planted_synonyms_are_nearest(spark):
    rnd = random.Random(4)
    groups = [[f"{g}{c}" for c in "abcdefgh"] for g in "pqr"]
    rows = []
    for i in range(400):
        g = groups[i % 3]
        words = [rnd.choice(g) for _ in range(8)]
        if i % 3 == 0:
            words.insert(4, rnd.choice(["same", "alike"]))  # these two are found among the same words
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows + [(999, "alone"), (1000, None)], "doc_id long, text string")
    got = {r.term: np.array(r.vector) for r in text.word_vectors(df, size=6).collect()}
    other = {r.term: np.array(r.vector) for r in text.word_vectors(df.repartition(11, "text"), size=6).collect()}
    assert len(got) == 27 and all(len(v) == 6 for v in got.values()) and not got["alone"].any()

    def cosine(a, b):
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-300)
    near = sorted((t for t in got if t not in ("same", "alone")), key=lambda t: -cosine(got["same"], got[t]))
    assert near[0] == "alike"
    for a in got:
        for b in ("same", "pb", "rf"):
            assert cosine(got[a], got[b]) == pytest.approx(cosine(other[a], other[b]), abs=1e-6)


def test_mutual_information_by_hand(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],), (["d"],)], "tokens array<string>")
    counts = wv.cooccurrence(df, window=1)
    assert {(r.term, r.near): r.n for r in counts.collect()} == {("a", "b"): 2, ("b", "a"): 2, ("b", "c"): 1, ("c", "b"): 1}
    got = {(r.term, r.near): r.m for r in wv.mutual_information(counts).collect()}
    assert got["a", "b"] == pytest.approx(math.log(2 * 6 / (2 * 3))) and got["c", "b"] == pytest.approx(math.log(1 * 6 / (1 * 3)))


def test_planted_topics_are_found_by_one_fit(spark):
    rnd = random.Random(5)
    words = [[f"{g}{c}" for c in "abcdef"] for g in "xyz"]
    rows = [(i, " ".join(rnd.choice(words[i % 3]) for _ in range(12))) for i in range(240)]
    df = spark.createDataFrame(rows + [(500, ""), (501, None)], "doc_id long, text string")
    fit = text.topic_model(df, k=3)
    top = {}
    for r in topics.topic_terms(fit, 6).collect():
        top.setdefault(r.topic, []).append(r.term)
    assert sorted(sorted(t) for t in top.values()) == [sorted(w) for w in words]
    assert {r.topic: r.n_docs for r in topics.topic_sizes(fit).collect()} == {0: 80, 1: 80, 2: 80}
    assert -fit.log_likelihood < math.log(6) + 0.2
    shares = fit.terms.select(F.explode("share").alias("s")).agg(F.sum("s")).first()[0]
    assert shares == pytest.approx(3.0)
    again = text.topic_model(df.repartition(9, "text"), k=3)
    assert again.log_likelihood == pytest.approx(fit.log_likelihood, rel=1e-9)
