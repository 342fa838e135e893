"""Corpus, tokens, n-grams, vocabulary, TF-IDF, chi-square,
text classifiers and topics.

Tokens stay in an array column; bigrams are built inside the row with a
higher-order function, so no window or shuffle is needed to pair
neighbours.  Per-document term frequencies are also computed inside the
row (sorted runs), and corpus counts aggregate them with a partial
aggregate per task, so a very frequent term costs one row per task and
no (document, term) pair is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.operators import sparse_models as sparse
from grantlens.operators import topics
from grantlens.operators import word_vectors as vectors_of
from grantlens.plans.materialize import written
from grantlens.session import broadcast_if_small

# The corpus columns and the letter-run token pattern.
CORPUS_COLUMNS = ("Programa", "Estado", "Municipio", "Departamento")
TOKEN_PATTERN = r"\p{L}+"
NON_LETTERS = r"[^\p{L}]+"


def corpus(apps: DataFrame, columns=CORPUS_COLUMNS, id_col: str = "app_id",
           label: str | None = "Aprobado") -> DataFrame:
    """One document per record, the chosen columns joined by spaces."""
    cols = [F.col(id_col).alias("doc_id"), F.concat_ws(" ", *columns).alias("text")]
    if label:
        cols.append(F.col(label).alias("label"))
    return apps.select(cols)


def tokens_of(text: str | Column) -> Column:
    """Lower-cased letter runs of the whole text.

    Split on runs of non-letters and drop the empty edge pieces: the same
    tokens as extracting letter runs, about 20-40% cheaper per row.
    """
    t = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(t), NON_LETTERS), "")


def tokenize(docs: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    return docs.withColumn(out, tokens_of(text))


def explode_terms(df: DataFrame, array_col: str, out: str = "term", keep=("doc_id",),
                  with_pos: bool = False) -> DataFrame:
    """Explode an array column, one row per element.

    ``explode_outer`` + a null filter is used instead of ``explode``: the
    plain form makes Catalyst infer a ``size(array) > 0`` filter and push
    it below the projection, which re-evaluates the tokenizer for it.
    """
    if with_pos:
        gen = F.posexplode_outer(array_col).alias("pos", out)
    else:
        gen = F.explode_outer(array_col).alias(out)
    return df.select(*keep, gen).where(F.col(out).isNotNull())


def exploded_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, token), pos 0-based."""
    return explode_terms(tokenize(docs, text), "tokens", "token", with_pos=True)


def bigrams(tokens: str = "tokens") -> Column:
    return F.expr(f"transform(sequence(0, size({tokens}) - 2), i -> "
                  f"concat({tokens}[i], ' ', {tokens}[i + 1]))")


def with_ngrams(docs: DataFrame, tokens: str = "tokens", out: str = "terms",
                max_n: int = 2) -> DataFrame:
    """Unigrams followed by bigrams (empty bigram list for < 2 tokens)."""
    grams = F.col(tokens)
    if max_n >= 2:
        grams = F.when(F.size(tokens) >= 2, F.concat(F.col(tokens), bigrams(tokens))) \
            .otherwise(F.col(tokens))
    return docs.withColumn(out, grams)


# Run starts and ends in a sorted token array ``_s``; each run of equal
# tokens becomes one (term, tf) entry.  ``get`` is NULL out of bounds.
_RUN_LENGTHS = """zip_with(
    filter(sequence(0, size(_s) - 1), i -> i = 0 OR get(_s, i - 1) != _s[i]),
    filter(sequence(0, size(_s) - 1), i -> i = size(_s) - 1 OR get(_s, i + 1) != _s[i]),
    (a, b) -> named_struct('term', _s[a], 'tf', CAST(b - a + 1 AS BIGINT)))"""


def with_term_frequencies(docs: DataFrame, terms: str = "terms",
                          out: str = "tfs") -> DataFrame:
    """Per-document term frequencies computed inside the row.

    The term array is sorted once and cut into runs of equal terms, so
    ``out`` is an array of (term, tf) with one entry per distinct term.
    Corpus counts then shuffle only per-task partial aggregates keyed by
    term, instead of first shuffling every distinct (document, term) pair.
    """
    d = docs.withColumn("_s", F.sort_array(terms))
    return d.withColumn(out, F.when(F.size("_s") > 0, F.expr(_RUN_LENGTHS))).drop("_s")


def term_counts(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """(doc_id, term, tf) — one row per distinct term per document, no shuffle."""
    d = with_term_frequencies(docs.select("doc_id", terms), terms, "_tfs")
    return explode_terms(d, "_tfs", "_t").select("doc_id", "_t.term", "_t.tf")


def ngram_counts(docs: DataFrame, max_n: int = 2) -> DataFrame:
    """Term, n, total count, document frequency."""
    d = with_ngrams(tokenize(docs), max_n=max_n)
    per_doc = term_counts(d)
    return (per_doc.groupBy("term")
            .agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))
            .withColumn("n", (F.size(F.split("term", " "))).cast("int")))


def vocabulary(docs: DataFrame) -> DataFrame:
    """Term, document frequency, total count (unigrams)."""
    per_doc = term_counts(tokenize(docs), "tokens")
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def tfidf(docs: DataFrame, max_n: int = 1) -> DataFrame:
    """Raw tf x smoothed idf = ln((1 + N) / (1 + df)) + 1.

    Per-document tf needs no shuffle; the document frequency is one
    partial aggregate on the term, joined back on the term.
    """
    d = with_ngrams(tokenize(docs), max_n=max_n)
    per_doc = term_counts(d)
    n_docs = docs.count()
    df_ = per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df_.select("term", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df")))
                              + F.lit(1.0)).alias("idf"))
    return (per_doc.join(broadcast_if_small(idf), "term")
            .select("doc_id", "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf")))


def chi2_terms(docs: DataFrame, label: str = "label", max_n: int = 2,
               classes=("No aprobado", "Aprobado")) -> DataFrame:
    """Chi-square of each term's count against the binary class.

    Observed = term count in class c; expected = term total x share of
    documents in class c.  The associated class is the one whose observed
    count exceeds its expectation.
    """
    d = with_ngrams(tokenize(docs), max_n=max_n)
    priors = docs.groupBy(label).agg(F.count(F.lit(1)).alias("_nd"))
    p = {int(r[label]): r["_nd"] for r in priors.collect()}  # at most 2 rows
    n = float(sum(p.values()))
    p0, p1 = p.get(0, 0) / n, p.get(1, 0) / n
    per = (explode_terms(d, "terms", keep=(label,))
           .groupBy("term").agg(F.sum((F.col(label) == 1).cast("long")).alias("o1"),
                                F.sum((F.col(label) != 1).cast("long")).alias("o0")))
    tot = F.col("o0") + F.col("o1")
    e0, e1 = tot * F.lit(p0), tot * F.lit(p1)
    d0, d1 = F.col("o0") - e0, F.col("o1") - e1
    chi = (F.when(e0 > 0, d0 * d0 / e0).otherwise(F.lit(0.0))
           + F.when(e1 > 0, d1 * d1 / e1).otherwise(F.lit(0.0)))
    return per.select("term", chi.alias("chi2"),
                      F.when(F.col("o1") > e1, classes[1]).otherwise(classes[0]).alias("clase"))


def chi2_top_terms(docs: DataFrame, k: int = 20, **kw) -> DataFrame:
    """O2: top-k terms by chi-square (term breaks ties); the limit is the report."""
    return chi2_terms(docs, **kw).orderBy(F.col("chi2").desc(), F.col("term")).limit(k)


def split_documents(docs: DataFrame, label: str = "label") -> DataFrame:
    """``docs`` (doc_id, text, label) with terms (unigrams and bigrams) and the stratified split."""
    from grantlens.operators.features import stratified_split

    d = with_ngrams(tokenize(docs), max_n=2).select("doc_id", F.col(label).alias("label"), "terms")
    return stratified_split(d, label="label", id_col="doc_id")


def naive_bayes_scores(docs: DataFrame, label: str = "label") -> DataFrame:
    """(doc_id, label, prob) of the test documents by multinomial naive Bayes on TF-IDF, smoothing 1."""
    split = written(split_documents(docs, label), "text-split")
    train = sparse.weighted_documents(split.where("split = 'train'"))
    idf = written(sparse.inverse_frequencies(train), "text-idf")
    model, bias = sparse.naive_bayes(sparse.valued_terms(train, idf), train)
    test = split.where("split = 'test'")
    weights = broadcast_if_small(idf.join(model, "term").select("term", (F.col("idf") * F.col("w")).alias("w")))
    sums = term_counts(test).join(weights, "term").groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("w")).alias("z"))
    z = F.coalesce("z", F.lit(0.0)) + F.lit(bias)
    return test.select("doc_id", "label").join(sums, "doc_id", "left").select(
        "doc_id", "label", (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("prob"))


def text_classifiers(docs: DataFrame, label: str = "label") -> DataFrame:
    """Naive Bayes, logistic regression and linear SVM on TF-IDF; see ``operators.sparse_models``.

    Every term of the training part has its own weight (no hashing).  The
    penalty of the linear models is that of C = 1: one over the documents for
    the mean loss.
    """
    from grantlens.operators.evaluation import classification_metrics

    documents = sparse.weighted_documents(split_documents(docs, label))
    train, test = (documents.where(F.col("split") == part) for part in ("train", "test"))
    idf = written(sparse.inverse_frequencies(train), "text-idf")
    pairs = written(sparse.valued_terms(train, idf), "text-features")
    n = float(train.agg(F.sum("weight")).first()[0] or 1.0)
    vectors = written(sparse.term_arrays(pairs), "text-vectors")
    fits = {"nb": sparse.naive_bayes(pairs, train), "lr": sparse.fit_linear(vectors, sparse.LOGISTIC, 1.0 / n),
            "svm": sparse.fit_linear(vectors, sparse.SQUARED_HINGE, 1.0 / n)}
    weights = idf.select("term")
    for name, (w, _) in fits.items():
        weights = weights.join(w.withColumnRenamed("w", name), "term", "left")
    scored = sparse.margins(sparse.valued_terms(test, idf), test, broadcast_if_small(weights.na.fill(0.0)), {k: b for k, (_, b) in fits.items()})
    names = {"nb": "Naive Bayes", "lr": "Logistic Reg.", "svm": "SVM Lineal"}
    each = F.array(*(F.struct(F.lit(title).alias("modelo"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(c)))).alias("prob")) for c, title in names.items()))
    # One row per document again, as the metrics count rows.
    rows = scored.select("label", F.explode(each).alias("_m"), "weight").select("label", "_m.*", F.explode(F.sequence(F.lit(1), F.col("weight"))))
    return classification_metrics(rows, "label", "prob", "modelo")


def word_vectors(docs: DataFrame, size: int = 50, window: int = 5) -> DataFrame:
    """(term, vector) of every token; see ``operators.word_vectors``."""
    return vectors_of.word_vectors(tokenize(docs).select("tokens"), size, window)


def topic_model(docs: DataFrame, k: int = 7, **kw) -> topics.Topics:
    """The fit that topic terms and topic sizes share; see ``operators.topics``."""
    return topics.fit_topics(tokenize(docs), k, **kw)
