"""Text classifiers whose weights are a table keyed by term.

A document is its terms with TF-IDF values; documents with the same terms and
label are one row with a weight.  No vocabulary, weight vector or matrix is
ever on the driver or in one task:

* naive Bayes is counts per (term, class), joined back on the term;
* logistic regression and the linear SVM (squared hinge) are fitted by L-BFGS
  in its vector-free form: the weights, the gradient and the last few steps are
  columns of one table keyed by term, a pass over the documents sums the
  gradient per term, and only the products of those columns with each other
  (a few dozen numbers) and the intercept come to the driver.

A pass joins the weights to the terms (Spark broadcasts their file if it is small),
sums the margin per document, and sums residual times value per term after a
map-side aggregate, so a term of every document is one row per task.  Each new
state is written to the shared folder and the one before is removed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.plans.materialize import release, written

#: Steps that L-BFGS remembers, most passes, and the relative gain from which on it stops.
MEMORY, MOST_STEPS, LEAST_GAIN = 5, 30, 1e-4


def weighted_documents(docs: DataFrame, keys=("label", "split"), terms: str = "terms") -> DataFrame:
    """(gid, *keys, tfs, weight): documents of equal terms as one row; ``tfs`` is the array of (term, tf)."""
    from grantlens.operators.text import with_term_frequencies
    rows = with_term_frequencies(docs.select(*keys, terms), terms, "tfs")
    rows = rows.withColumn("tfs", F.coalesce("tfs", F.expr("array()").cast("array<struct<term:string,tf:bigint>>")))
    once = rows.groupBy(*keys, "tfs").agg(F.count(F.lit(1)).alias("weight"))
    # Numbers follow the written files, so a repeated task gives the same ones.
    return written(once, "text-documents").withColumn("gid", F.monotonically_increasing_id())


def inverse_frequencies(train: DataFrame) -> DataFrame:
    """(term, idf) of weighted documents: ln((1 + documents) / (1 + documents with the term))."""
    total = train.agg(F.sum("weight")).scalar()
    held = train.select(F.explode_outer("tfs.term").alias("term"), "weight").where(F.col("term").isNotNull())
    return held.groupBy("term").agg(F.sum("weight").alias("df")).select(
        "term", F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("df"))).alias("idf"))


def valued_terms(documents: DataFrame, idf: DataFrame, keep=("label", "weight")) -> DataFrame:
    """(gid, *keep, term, x): the TF-IDF value of every known term of every document."""
    held = documents.select("gid", *keep, F.explode_outer("tfs").alias("_t")).where(F.col("_t").isNotNull())
    return held.select("gid", *keep, "_t.term", "_t.tf").join(idf, "term").select("gid", *keep, "term", (F.col("tf") * F.col("idf")).alias("x"))


# ---------------------------------------------------------------- naive Bayes
def naive_bayes(pairs: DataFrame, documents: DataFrame, smoothing: float = 1.0) -> tuple[DataFrame, float]:
    """((term, w), bias): a document's log odds of class 1 are the bias plus the sum of w * x of its terms."""
    def mass(c):
        return F.sum(F.when(F.col("label") == c, F.col("x") * F.col("weight")).otherwise(0.0))
    per = written(pairs.groupBy("term").agg(mass(0).alias("s0"), mass(1).alias("s1")), "term-mass")
    t = per.agg(F.sum("s0"), F.sum("s1"), F.count(F.lit(1))).first()
    n = {r["label"]: r["n"] for r in documents.groupBy("label").agg(F.sum("weight").alias("n")).collect()}  # two classes
    if not t[2]:
        return per.select("term", F.lit(0.0).alias("w")), math.log((n.get(1, 0) + smoothing) / (n.get(0, 0) + smoothing))
    lower, upper = (t[c] + smoothing * t[2] for c in (0, 1))
    w = F.log((F.col("s1") + smoothing) / F.lit(upper)) - F.log((F.col("s0") + smoothing) / F.lit(lower))
    return per.select("term", w.alias("w")), math.log((n.get(1, 0) + smoothing) / (n.get(0, 0) + smoothing))


# ---------------------------------------------------------------- L-BFGS over a table
@dataclass(frozen=True)
class Loss:
    """Loss of a margin z of a document of sign s (-1 or 1), and its derivative by z."""
    value: object
    slope: object


def _softplus(v: Column) -> Column:
    return F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))


LOGISTIC = Loss(lambda z, s: _softplus(-s * z), lambda z, s: -s / (F.lit(1.0) + F.exp(s * z)))
SQUARED_HINGE = Loss(lambda z, s: F.pow(F.greatest(F.lit(1.0) - s * z, F.lit(0.0)), 2),
                     lambda z, s: F.lit(-2.0) * s * F.greatest(F.lit(1.0) - s * z, F.lit(0.0)))


def margins(pairs: DataFrame, documents: DataFrame, weights: DataFrame, columns: dict[str, float], keep=("label", "weight")) -> DataFrame:
    """``documents`` (gid, keep) with one margin per weight column: its intercept plus the sum of x * weight."""
    sums = pairs.join(weights, "term").groupBy("gid").agg(*(F.sum(F.col("x") * F.col(c)).alias(f"_{c}") for c in columns))
    return documents.select("gid", *keep).join(sums, "gid", "left").select(
        "gid", *keep, *((F.coalesce(f"_{c}", F.lit(0.0)) + F.lit(b)).alias(c) for c, b in columns.items()))


def direction(products: dict, steps: int) -> dict[str, float]:
    """The L-BFGS direction as coefficients of the columns g, s*, y*, from their products alone."""
    def dot(a: dict, b: str) -> float:
        return sum(v * products[min(k, b), max(k, b)] for k, v in a.items())

    q = {"g": -1.0}
    alpha = {}
    for i in range(steps):  # the newest first
        rho = products[f"s{i}", f"y{i}"]
        alpha[i] = dot(q, f"s{i}") / rho
        q[f"y{i}"] = q.get(f"y{i}", 0.0) - alpha[i]
    if steps:
        scale = products["s0", "y0"] / products["y0", "y0"]
        q = {k: v * scale for k, v in q.items()}
    for i in reversed(range(steps)):
        beta = dot(q, f"y{i}") / products[f"s{i}", f"y{i}"]
        q[f"s{i}"] = q.get(f"s{i}", 0.0) + alpha[i] - beta
    return q


def term_arrays(pairs: DataFrame) -> DataFrame:
    """(gid, label, weight, xs): every document with its terms as one array of (term, x)."""
    return pairs.groupBy("gid", "label", "weight").agg(F.collect_list(F.struct("term", "x")).alias("xs"))


def fit_linear(vectors: DataFrame, loss: Loss, penalty: float) -> tuple[DataFrame, float]:
    """((term, w), intercept) that minimise the mean loss plus penalty / 2 * |w|^2 (the intercept is free).

    ``vectors`` as from ``term_arrays``.  The state is one row per term, and one with a null term for the intercept,
    with the weight w, the gradient g and the last steps s* and changes of gradient y*; it is written once per step,
    and one aggregate over it gives all that the next step needs.
    """
    total = float(vectors.agg(F.sum("weight")).first()[0] or 0.0)
    terms = vectors.select(F.explode("xs.term").alias("term")).distinct()
    if not total:
        return terms.select("term", F.lit(0.0).alias("w")), 0.0
    sign = F.when(F.col("label") == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    share, z = F.col("weight") / F.lit(total), F.col("z")

    def evaluated(state: DataFrame, bias: float, steps: int):
        """The state at its w with the gradient there, written, and its aggregate."""
        held = vectors.select("gid", "label", "weight", F.explode("xs").alias("_t")).select("gid", "label", "weight", "_t.*")
        z_of = held.join(state.where("term is not null").select("term", "w"), "term").groupBy("gid", "label", "weight").agg(
            (F.sum(F.col("x") * F.col("w")) + F.lit(bias)).alias("z"), F.collect_list(F.struct("term", "x")).alias("xs"))
        slope = loss.slope(z, sign) * share
        parts = z_of.select(slope.alias("r"), (loss.value(z, sign) * share).alias("l"), "xs").select(F.explode(F.concat(
            F.transform("xs", lambda t: F.struct(t["term"].alias("term"), (t["x"] * F.col("r")).alias("g"), F.lit(0.0).alias("l"))),
            F.array(F.struct(F.lit(None).cast("string").alias("term"), F.col("r").alias("g"), F.col("l").alias("l"))))).alias("_p"))
        slopes = parts.select("_p.*").groupBy("term").agg(F.sum("g").alias("_g"), F.sum("l").alias("l")).withColumnRenamed("term", "_term")
        shrunk = F.when(F.col("term").isNotNull(), F.lit(penalty) * F.col("w")).otherwise(0.0)
        g = F.coalesce("_g", F.lit(0.0)) + shrunk
        changes = [(g - F.col("old")).alias("y0")] if steps else []
        kept = [c for c in state.columns if c not in ("term", "w", "old")]
        out = written(state.join(slopes, F.col("term").eqNullSafe(F.col("_term")), "left").select(
            "term", "w", g.alias("g"), *changes, *kept, F.coalesce("l", F.lit(0.0)).alias("l")), "weights")
        names = sorted(["g"] + [f"{c}{i}" for i in range(steps) for c in "sy"])
        both = [(a, b) for i, a in enumerate(names) for b in names[i:]]
        row = out.agg(F.sum("l"), F.sum(F.when(F.col("term").isNotNull(), F.col("w") * F.col("w"))), F.max(F.when(F.col("term").isNull(), F.col("w"))),
                      *(F.sum(F.col(a) * F.col(b)) for a, b in both)).first()
        return out, row[0] + penalty / 2 * (row[1] or 0.0), row[2], dict(zip(both, row[3:]))

    start = terms.unionByName(vectors.sparkSession.createDataFrame([(None,)], "term string")).withColumn("w", F.lit(0.0))
    state, value, bias, products = evaluated(start, 0.0, 0)
    steps = 0
    for _ in range(MOST_STEPS):
        way = direction(products, steps)
        slope = sum(v * products[min(k, "g"), max(k, "g")] for k, v in way.items())
        if slope > -1e-12:
            break
        size = 1.0 if steps else min(1.0, 1.0 / math.sqrt(products["g", "g"]))
        kept = min(steps, MEMORY - 1)
        older = [F.col(f"{c}{i}").alias(f"{c}{i + 1}") for i in range(kept) for c in "sy"]
        at_bias = state.where("term is null").select(*way).first()
        while True:
            move = sum((F.col(k) * F.lit(v) for k, v in way.items()), F.lit(0.0)) * F.lit(size)
            moved = bias + size * sum(at_bias[k] * v for k, v in way.items())
            trial, after, _, products = evaluated(
                state.select("term", (F.col("w") + move).alias("w"), F.col("g").alias("old"), move.alias("s0"), *older), moved, kept + 1)
            if after <= value + 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
            release(trial)
        release(state)
        gain, state, value, bias, steps = value - after, trial, after, moved, kept + 1
        if gain < LEAST_GAIN * max(1e-12, abs(value)) or products["s0", "y0"] <= 1e-15:
            break
    return state.where("term is not null").select("term", "w"), bias
