"""In-row term frequencies vs brute force; measured-size broadcast decisions."""

import random
from collections import Counter

from pyspark.sql import functions as F

from grantlens.operators import text
from grantlens.session import broadcast_if_small


def _docs():
    rnd = random.Random(5)
    words = ["casa", "vivienda", "subsidio", "año", "niño", "z", "Casa", "ÁRBOL"]
    rows = [(0, ""), (1, "uno"), (2, "uno uno uno"), (3, "  ...  "), (4, None),
            (5, "b a b a b"), (6, "Ñandú ñandú, ÑANDÚ! 42 x-y")]
    for i in range(7, 60):
        rows.append((i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 400)))))
    return rows


def _brute_tokens(t):
    import regex
    return [w.lower() for w in regex.findall(r"\p{L}+", t or "")]


def test_term_counts_match_brute_force(spark):
    rows = _docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.term): r.tf for r in text.term_counts(text.tokenize(docs), "tokens").collect()}
    want = {}
    for i, t in rows:
        for term, n in Counter(_brute_tokens(t)).items():
            want[(i, term)] = n
    assert got == want


def test_vocabulary_and_ngrams_match_brute_force(spark):
    rows = _docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = {r.term: (r.df, r.tf) for r in text.vocabulary(docs).collect()}
    df_, tf_ = Counter(), Counter()
    for _, t in rows:
        toks = _brute_tokens(t)
        tf_.update(toks)
        df_.update(set(toks))
    assert vocab == {k: (df_[k], tf_[k]) for k in tf_}

    grams = {r.term: (r.tf, r.df, r.n) for r in text.ngram_counts(docs).collect()}
    gtf, gdf = Counter(), Counter()
    for _, t in rows:
        toks = _brute_tokens(t)
        terms = toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]
        gtf.update(terms)
        gdf.update(set(terms))
    assert grams == {k: (gtf[k], gdf[k], len(k.split(" "))) for k in gtf}


def test_tfidf_plan_shuffles_no_doc_term_pairs(spark):
    docs = spark.createDataFrame(_docs(), "doc_id long, text string")
    plan = text.vocabulary(docs)._jdf.queryExecution().executedPlan().toString()
    # One exchange keyed by the term only (after a partial aggregate).
    exchanges = [ln for ln in plan.splitlines() if "Exchange hashpartitioning" in ln]
    assert len(exchanges) == 1 and "doc_id" not in exchanges[0], plan


def test_broadcast_if_small_respects_ceiling(spark):
    small = spark.range(100).select(F.col("id"), F.concat(F.lit("k"), F.col("id").cast("string"))
                                    .alias("name"))
    big = spark.range(20000).select(F.col("id"), F.repeat(F.lit("x"), 64).alias("name"))

    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or \
            "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 20))
    try:
        s, b = broadcast_if_small(small, big)
        # 100 rows are far under 1 MiB; 20,000 rows x (64 string bytes + 64) are over it.
        assert hinted(s) and not hinted(b)
        assert b.storageLevel.useMemory is False
        assert s.count() == 100 and b.count() == 20000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
