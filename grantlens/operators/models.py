"""Approval classifiers as Spark ML pipelines.

Each model is a ``Pipeline``: an optional min-max stage (a
``SQLTransformer`` holding the train-only bounds, so constant columns
scale to 0 and the stage persists with the model), a
``VectorAssembler`` over the 12 features, and the estimator.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.operators.features import FEATURES, LABEL
from grantlens.operators.ranking import ranked
from grantlens.plans.materialize import written


@dataclass(frozen=True)
class ModelSpec:
    name: str
    scaled: bool
    weighted: bool = False


# Model names and which ones read min-max scaled input.
MODEL_SPECS = {
    "Logistic Regression": ModelSpec("Logistic Regression", scaled=True, weighted=True),
    "Random Forest": ModelSpec("Random Forest", scaled=False),
    "XGBoost": ModelSpec("XGBoost", scaled=False),
    "Gradient Boosting": ModelSpec("Gradient Boosting", scaled=False),
    "Red MLP": ModelSpec("Red MLP", scaled=True),
}
#: Split candidates per feature of the boosted trees: more than the municipality codes of the reference's data (984).
MAX_BINS = 1024
#: Those of the forest.  Municipalities in the order of their rate are the feature hist_ap, so their codes need no bin
#: each.  The figure in MB bounds the rows of a subtree that one task grows (``operators.forest``) and the nodes that a
#: pass over all rows counts at once.
FOREST_BINS, FOREST_MEMORY_MB = 128, 64
#: Most steps of a walk back into the range of a permutation.
WALK = 64
# The serving threshold and the MLP's training threshold.
SERVE_THRESHOLD = 0.5
MISSING_PROB = 0.5


def scaler_stage(bounds: dict[str, tuple[float, float]], features=FEATURES) -> SQLTransformer:
    """Min-max scaling with train-only bounds as a persistable SQL stage."""
    exprs = []
    for c in features:
        lo, hi = bounds[c]
        rng = (hi - lo) if hi != lo else 1.0
        exprs.append(f"(`{c}` - ({lo!r})) / ({rng!r}) AS `{c}__s`")
    return SQLTransformer(statement="SELECT *, " + ", ".join(exprs) + " FROM __THIS__")


def estimator(name: str, n_train_weight: float | None = None, seed: int = 42,
              iterations: int | None = None):
    """Spark ML estimator standing in for each reference model."""
    from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                           MultilayerPerceptronClassifier)

    from grantlens.operators.forest import ForestClassifier
    if name == "Logistic Regression":
        # sklearn C=1 on a weighted sum == Spark's mean loss with regParam = 1 / sum(w).
        reg = 1.0 / n_train_weight if n_train_weight else 0.0
        return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                                  maxIter=iterations or 1000, regParam=reg, elasticNetParam=0.0,
                                  standardization=False)
    if name == "Random Forest":
        return ForestClassifier(featuresCol="features", labelCol="label",
                                numTrees=iterations or 20, maxDepth=30, maxBins=FOREST_BINS,
                                maxMemoryInMB=FOREST_MEMORY_MB, featureSubsetStrategy="sqrt", seed=seed)
    if name == "XGBoost":
        return GBTClassifier(featuresCol="features", labelCol="label", maxIter=iterations or 100,
                             maxDepth=6, stepSize=0.3, maxBins=MAX_BINS, seed=seed)
    if name == "Gradient Boosting":
        return GBTClassifier(featuresCol="features", labelCol="label", maxIter=iterations or 150,
                             maxDepth=5, stepSize=0.1, maxBins=MAX_BINS, seed=seed)
    if name == "Red MLP":
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label",
                                              layers=[len(FEATURES), 128, 64, 32, 2],
                                              blockSize=512, maxIter=iterations or 50, seed=seed)
    raise KeyError(name)


def pipeline(name: str, bounds, n_train_weight: float | None = None,
             iterations: int | None = None, features=FEATURES) -> Pipeline:
    spec = MODEL_SPECS[name]
    stages = []
    cols = list(features)
    if spec.scaled:
        stages.append(scaler_stage(bounds, features))
        cols = [f"{c}__s" for c in features]
    stages.append(VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"))
    est = estimator(name, n_train_weight, iterations=iterations)
    if len(features) != len(FEATURES) and name == "Red MLP":
        est.setLayers([len(features), 128, 64, 32, 2])
    stages.append(est)
    return Pipeline(stages=stages)


def prepare_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.col(LABEL).cast("double"))


def fit(name: str, train: DataFrame, bounds, iterations: int | None = None,
        features=FEATURES) -> PipelineModel:
    """Fit one model; LR gets balanced class weights."""
    from grantlens.operators.features import with_class_weight
    t = prepare_labels(train)
    wsum = None
    if MODEL_SPECS[name].weighted:
        t = with_class_weight(t, LABEL, "weight")
        wsum = float(t.agg(F.sum("weight")).first()[0])
    return pipeline(name, bounds, wsum, iterations, features).fit(t)


def positive_probability(model_out: DataFrame) -> DataFrame:
    return model_out.withColumn("prob", vector_to_array("probability").getItem(1))


def score(model: PipelineModel | None, df: DataFrame, id_col: str = "app_id",
          threshold: float = SERVE_THRESHOLD, keep=(LABEL,)) -> DataFrame:
    """(id, prob, prediction); a missing model scores 0.5 / class 0."""
    keep = [c for c in keep if c in df.columns]
    if model is None:
        return df.select(id_col, *keep, F.lit(0.5).alias("prob"), F.lit(0).alias("prediction"))
    out = positive_probability(model.transform(df))
    return out.select(id_col, *keep, "prob",
                      (F.col("prob") >= threshold).cast("int").alias("prediction"))


def bijection(rank: Column, n: int, seed: int = 7, rounds: int = 6) -> Column:
    """A keyed permutation of 0..n-1: the place that each rank is sent to.

    A generalised Feistel network on pairs (left of a, right of b), a * b the
    least such product of near squares from n on: in turn, each half is moved
    by a hash of the other, which can be undone, so pairs are permuted.  The
    fewer than a places beyond n are sent on until they fall below it; a walk of
    ``WALK`` steps that never does has a probability of at most n**(-WALK / 2).
    """
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))

    def once(x):
        pair = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

        def turn(p, i):
            return F.when(i % 2 == 0, F.struct(F.pmod(p["l"] + F.pmod(F.xxhash64(p["r"], i, F.lit(seed)), F.lit(a)), F.lit(a)).alias("l"), p["r"].alias("r"))) \
                .otherwise(F.struct(p["l"].alias("l"), F.pmod(p["r"] + F.pmod(F.xxhash64(p["l"], i, F.lit(seed)), F.lit(b)), F.lit(b)).alias("r")))
        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), pair, turn, lambda p: p["l"] * F.lit(b) + p["r"])

    steps = min(WALK, a * b - n)
    first = once(rank.cast("long"))
    if not steps:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda x, _: F.when(x >= F.lit(n), once(x)).otherwise(x))


def with_partner(df: DataFrame, features, key: str, seed: int) -> DataFrame:
    """``df`` with ``_rot_<feature>``: the values of the row that each row is sent to, over the whole table.

    Rows are ranked by their key without a global window; the partner's values come by one join on the rank.  So a
    row's partner depends on the keys and the seed, not on how the table is partitioned.
    """
    placed = written(ranked(df, [key], "_rank"), "permutation")
    others = placed.select(F.col("_rank").alias("_partner"), *(F.col(c).alias(f"_rot_{c}") for c in features))
    return placed.withColumn("_partner", bijection(F.col("_rank"), placed.count(), seed)).join(others, "_partner").drop("_rank", "_partner")


def permute_column(df: DataFrame, col: str, key: str = "app_id", seed: int = 7) -> DataFrame:
    """Shuffle one column across all rows."""
    return with_partner(df, [col], key, seed).withColumn(col, F.col(f"_rot_{col}")).drop(f"_rot_{col}")


def permuted_variants(df: DataFrame, features=FEATURES, key: str = "app_id", seed: int = 7) -> DataFrame:
    """The rows once as they are and once per feature with that feature permuted.

    Every feature uses the permutation of ``permute_column``, so all permuted
    columns come out of one join.  ``_variant`` is ``__base__`` or the permuted
    feature's name.
    """
    keep = [c for c in df.columns if c not in features]
    d = with_partner(df.select(*keep, *features), features, key, seed)
    variants = [F.struct(F.lit(BASE_VARIANT).alias("_variant"), *[F.col(c) for c in features])]
    for c in features:
        variants.append(F.struct(F.lit(c).alias("_variant"),
                                 *[(F.col(f"_rot_{x}") if x == c else F.col(x)).alias(x)
                                   for x in features]))
    return d.select(*keep, F.explode(F.array(*variants)).alias("_v")).select(*keep, "_v.*")


BASE_VARIANT = "__base__"


def permutation_importance(model: PipelineModel, test: DataFrame, features=FEATURES,
                           seed: int = 7) -> DataFrame:
    """M8: AUC drop when one feature is shuffled (model-agnostic).

    One job: the test rows fan out to the unpermuted variant plus one per
    feature, are scored once, and reduce to score-bin counts per variant;
    only the per-variant AUCs (one row per feature) reach the driver.
    """
    from grantlens.operators.evaluation import auc

    scored = score(model, permuted_variants(test, features, seed=seed),
                   keep=(LABEL, "_variant"))
    aucs = {r["_variant"]: float(r["auc"] or 0.0)
            for r in auc(scored, LABEL, "prob", "_variant").collect()}
    base = aucs[BASE_VARIANT]
    rows = [(c, base, aucs[c]) for c in features]
    out = test.sparkSession.createDataFrame(
        rows, "feature string, base_auc double, permuted_auc double")
    return out.withColumn("importance", F.col("base_auc") - F.col("permuted_auc"))


def tree_importance(model: PipelineModel, features=FEATURES) -> list[tuple[str, float]]:
    est = model.stages[-1]
    imp = est.featureImportances.toArray().tolist()
    return list(zip(features, imp))
