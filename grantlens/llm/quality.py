"""Operator 9 [native]: quality rules and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets.  Two
multinomials over the buckets are counted: one over the trusted target
(documents labelled good), one over the whole raw corpus.  A document's
score is the mean over its words and pairs of log(p_target / p_raw), so it
does not depend on the length; documents below a threshold are rejected, and
so are those that break a base rule (too few words, too much repetition).  All
of it is DataFrame expressions: the features stay inside the row, the corpus
counts shuffle one partial sum per bucket and task, and the weights (one
double a bucket, so of fixed size) are a written table of one row, which the
rows read through a scalar subquery: they do not pass through Python.

Nothing in the verdict depends on the size of the corpus: the target's rates
are mixed with the corpus's in the fixed share ``MIXED``, and the threshold
comes from labelled documents that the target leaves out (one text in
``HELD_OUT``, by the hash of the text, so copies stay on one side).  Every
label counts, for the target or for the threshold.

``let`` binds a value to a lambda variable, because Catalyst would otherwise
compute an expression again for each element of a lambda that uses it.

Defined cases: a null or empty text has no words, fails the base rules and
is not kept; a text of fewer than three words has no window; repeated rows
give repeated results (each counts in the raw corpus); without labels the
target is the raw corpus and every score is 0; an empty table gives an
empty result; columns other than the key and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.llm.common import packed, table
from grantlens.plans.materialize import written
from grantlens.session import ensure_parallelism

SPACES = "[ \\t\\n\\x0B\\f\\r]+"
NOT_SPACE = "[^ \\t\\n\\x0B\\f\\r]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BUCKETS = 1 << 16
#: Keys of labels that are broadcast to the documents at most; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Parts of the corpus's rates that are mixed into one part of the target's.
MIXED = 1.0
#: One labelled text in so many sets the threshold and is not in the target.
HELD_OUT = 5
#: Share of the held-out good documents that may lie below the threshold.
LOW = 0.01


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def buckets_of(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the words, then of the pairs of neighbouring words."""
    def both(h):
        pairs = F.when(F.size(h) > 1, F.transform(
            F.sequence(F.lit(0), F.size(h) - 2),
            lambda i: F.pmod(F.xxhash64(F.get(h, i), F.get(h, i + 1)), F.lit(buckets)).cast("int")))
        own = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
        return F.concat(own, F.coalesce(pairs, F.array().cast("array<int>")))
    return let(hashes, both)


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text."""
    def covered(grams):
        by_hash = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = let(by_hash, lambda p: F.filter(F.transform(p, lambda x, i: F.when(
            F.coalesce(F.get(p, i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["g"] == x["g"], F.lit(False)),
            x["i"])), lambda i: i.isNotNull()))
        return let(F.sort_array(twice), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
            F.lit(0), lambda a, b: a + b))

    def windows(h):
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3),
                           lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    return let(hashes, lambda h: F.when(F.size(h) >= 3, let(windows(h), lambda g: F.when(
        F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0)))).otherwise(F.lit(0)))


def measures(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hashes, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    t = F.col("text")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    h, words = F.col("hashes"), F.col("words")
    # The words are cut once; a search for a character class is much cheaper than a translation of every character.
    return ensure_parallelism(rows).select("key", "text", words_of(t).alias("words")).select(
        "key", hashes_of(words).alias("hashes"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("key", "hashes", F.size(h).cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
             repeated_words(h).cast("long").alias("n_repeat_words"))


def labelled(labels: DataFrame, label_key: str, condition: Column) -> DataFrame:
    """The different keys of all labels under a condition."""
    return labels.where(condition & F.col(label_key).isNotNull()).select(F.col(label_key).alias("key")).distinct()


def to_join(keys: DataFrame) -> DataFrame:
    """``keys`` as the side of a join with documents: labels grow with the corpus, so it is counted first."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_LABELS else keys


def is_held_out() -> Column:
    return F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0


def bucket_weights(df: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, good: Column,
                   buckets: int = BUCKETS, mixed: float = MIXED) -> DataFrame:
    """One row, in a table of its own: the array of log(p_target / p_raw) of every bucket.

    p_target is a mixture with ``mixed`` parts of p_raw, and held-out texts are not in the target.
    """
    target = to_join(labelled(labels, label_key, good).withColumn("good", F.lit(1)))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = F.coalesce("good", F.lit(0))
    flagged = ensure_parallelism(rows).join(target, "key", "left").select(
        F.when(is_held_out(), F.lit(0)).otherwise(own).alias("good"),
        buckets_of(hashes_of(words_of(F.col("text"))), buckets).alias("b"))
    counts = (flagged.select("good", F.explode_outer("b").alias("b")).where(F.col("b").isNotNull())
              .groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target")))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0)
    listed = every.agg(F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("c"),
                       F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))

    def of_bucket(x):
        scaled = x["target"] * F.col("n_raw") / F.col("n_target")
        return F.when(x["raw"] == 0, F.lit(0.0)).otherwise(F.log((scaled / x["raw"] + mixed) / (1 + mixed)))

    ratio = F.transform("c", lambda x: F.when(F.col("n_target") == 0, F.lit(0.0)).otherwise(of_bucket(x)))
    return written(listed.select(ratio.alias("weights")), "quality-weights")


def with_weights(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``rows`` with the weights as a column, for ``mean_ratio`` to read once.

    A higher-order function takes no subquery, but a column; the optimizer puts the subquery, a constant by then,
    in the column's only place, so no row holds the array.
    """
    return rows.select("*", weights.select("weights").scalar().alias("weights"))


def mean_ratio(weights: Column, hashes: Column) -> Column:
    total = let(weights, lambda w: F.aggregate(buckets_of(hashes), F.lit(0.0), lambda a, b: a + F.get(w, b)))
    return F.when(F.size(hashes) > 0, total / (2 * F.size(hashes) - 1)).otherwise(F.lit(0.0))


def threshold_of(df: DataFrame, key: str, text: str, weights: DataFrame, labels: DataFrame, label_key: str,
                 good: Column, bad: Column) -> float:
    """Where held-out good documents end.

    Good documents reach down to their ``LOW`` quantile; the threshold lies as far below it as the median lies
    above, but not under the middle between good and bad unless good documents lie there themselves.  Without
    held-out good documents those of the target stand for them, and without labels all scores are 0, which pass.
    """
    some = to_join(labelled(labels, label_key, good).withColumn("good", F.lit(True)).unionByName(
        labelled(labels, label_key, bad).withColumn("good", F.lit(False))))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = ensure_parallelism(rows).join(some, "key").select(
        "good", is_held_out().alias("out"), hashes_of(words_of(F.col("text"))).alias("hashes")).where(F.size("hashes") >= MIN_WORDS)
    scored = with_weights(found, weights).select("good", "out", mean_ratio(F.col("weights"), F.col("hashes")).alias("r"))
    by = {(x["good"], x["out"]): x for x in scored.groupBy("good", "out").agg(
        *(F.expr(f"percentile_disc({p}) within group (order by r)").alias(n) for n, p in (("low", LOW), ("mid", 0.5))),
        F.avg("r").alias("mean")).collect()}
    own, other = (by.get((g, True)) or by.get((g, False)) for g in (True, False))
    if own is None:
        return 0.0
    below = 2 * own["low"] - own["mid"]
    return round(below if other is None else max(below, min(own["low"], (own["mean"] + other["mean"]) / 2)), 9)


def judge(df: DataFrame, key: str, text: str, weights: DataFrame, threshold: float) -> DataFrame:
    """The measures of every document with base_failed, kept and log_ratio; ``weights`` as from bucket_weights."""
    given = [F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    scored = with_weights(measures(df, key, text), weights).select(
        *given, mean_ratio(F.col("weights"), F.col("hashes")).alias("log_ratio"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.select(*scored.columns[:-1], failed.alias("base_failed"),
                         (~failed & (F.round("log_ratio", 9) >= threshold)).alias("kept"), "log_ratio")


def good_weights(df: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """Weights of ``documents`` rows against those labelled of good quality, and the threshold."""
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    weights = bucket_weights(df, "doc_id", "text", labels, "doc_id", good)
    return weights, threshold_of(df, "doc_id", "text", weights, labels, "doc_id", good, bad)


def keep_good(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` (all columns) that are kept."""
    return judge(packed(df, "text"), "row", "text", *good_weights(df, labels)).where("kept").select("row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the five measures, base_failed, kept and log_ratio of every document."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, "doc_id", "text", *good_weights(docs, table(spark, sf_dir, "labels")))
