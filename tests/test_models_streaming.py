"""Planted-signal classifiers, model save/load, stream == batch."""

import random

import pytest
from pyspark.sql import functions as F

from grantlens.operators import evaluation, features, models


@pytest.fixture(scope="module")
def separable(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(600):
        y = i % 2
        vals = [rnd.gauss(2.0 * y, 0.5) for _ in features.FEATURES]
        rows.append((i, *vals, y))
    schema = "app_id long, " + ", ".join(f"{c} double" for c in features.FEATURES) + \
             ", Aprobado int"
    df = spark.createDataFrame(rows, schema)
    split = features.stratified_split(df).persist()
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    return train, test, features.minmax_fit(train)


@pytest.mark.parametrize("name,iters", [("Logistic Regression", 100), ("Random Forest", 10),
                                        ("XGBoost", 10), ("Gradient Boosting", 10),
                                        ("Red MLP", 50)])
def test_classifiers_learn_planted_signal(spark, separable, name, iters):
    train, test, bounds = separable
    m = models.fit(name, train, bounds, iterations=iters)
    s = models.score(m, test).withColumn("modelo", F.lit(name))
    r = evaluation.classification_metrics(s, features.LABEL, "prob", "modelo").first()
    assert r.auc > 0.9, (name, r)
    pr = s.agg(F.min("prob"), F.max("prob")).first()
    assert 0.0 <= pr[0] <= pr[1] <= 1.0


def test_model_save_load_round_trip(spark, separable, tmp_path):
    from pyspark.ml import PipelineModel
    train, test, bounds = separable
    m = models.fit("Logistic Regression", train, bounds, iterations=50)
    p = str(tmp_path / "lr")
    m.write().overwrite().save(p)
    m2 = PipelineModel.load(p)
    a = {r.app_id: r.prob for r in models.score(m, test).collect()}
    b = {r.app_id: r.prob for r in models.score(m2, test).collect()}
    assert a == b


def test_missing_model_scores_half(spark, separable):
    _, test, _ = separable
    r = models.score(None, test).select("prob", "prediction").distinct().collect()
    assert [(x.prob, x.prediction) for x in r] == [(0.5, 0)]


@pytest.fixture(scope="module")
def served(spark):
    """Applications, requests and quickly fitted models."""
    from grantlens.plans import training
    from grantlens.sources import tables
    apps = tables.applications(spark, "/root/testdata/sf0.001").persist()
    split = features.stratified_split(features.training_matrix(apps)).persist()
    train = split.where(F.col("split") == "train")
    td = training.TrainingData(split, features.minmax_fit(train))
    td.fitted = {(n, None): models.fit(n, train, td.bounds, iterations=5) for n in ("Logistic Regression", "XGBoost")}
    return apps, tables.requests_from_applications(apps), td


NAMES = ("Logistic Regression", "XGBoost")


def _rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_saved_versions_score_alike_and_later_rows_change_nothing(spark, served, tmp_path):
    from grantlens.operators import scoring, stats
    from grantlens.plans import serving, training
    from grantlens.sources import artifacts, tables
    apps, req, td = served
    base = str(tmp_path / "saved")
    with pytest.raises(LookupError):
        artifacts.load_version(spark, base)
    clusters = scoring.rate_clusters(stats.municipality_profile(apps)).withColumnRenamed("municipio", "Municipio")
    assert artifacts.save_version(spark, base, artifacts.build_lookups(apps, clusters), lambda p: training.save_models(td, p, NAMES)) == 1
    want = _rows(serving.score_requests(req, artifacts.build_lookups(apps), {n: td.fitted[n, None] for n in NAMES}))
    assert _rows(serving.batch_score(spark.newSession(), req, base)) == want and len(want) > 0
    # A municipality that sorts before all others shifts the codes of today's table, not the saved ones.
    later = apps.unionByName(apps.limit(1).withColumn("Municipio", F.lit("AAA")))
    assert features.label_encode(later).where("category = 'Municipio' and code = 0").first()["value"] == "AAA"
    assert _rows(serving.batch_score(spark, tables.requests_from_applications(later).where(F.col("municipio") != "AAA"), base)) == want

    # A version that breaks off before its manifest does not exist.
    def broken(path):
        training.save_models(td, path, NAMES[:1])
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        artifacts.save_version(spark, base, artifacts.build_lookups(later), broken)
    assert artifacts.load_version(spark, base).version == 1
    assert _rows(serving.batch_score(spark, req, base)) == want
    # A second version answers side by side with the first.
    assert artifacts.save_version(spark, base, artifacts.build_lookups(later), lambda p: training.save_models(td, p, NAMES)) == 2
    both = serving.batch_respond(spark, req, base, (1, 2)).persist()
    assert [r[0] for r in both.select("version").distinct().orderBy("version").collect()] == [1, 2]
    one = both.where("version = 1").select("req_id", "modelo", *[c for c in serving.score_requests(
        req, artifacts.build_lookups(apps), {}).columns if c not in ("req_id", "modelo")])
    assert _rows(one) == want
    struct = both.where("version = 1 and modelo_seleccionado.cluster is not null").first()
    assert struct["modelo_seleccionado"]["cluster_perfil"] == struct["reference"]["cluster_perfil"] is not None
    assert both.where("version = 2 and modelo_seleccionado.cluster is not null").count() == 0  # saved without clusters


def test_stream_takes_the_newest_version_and_restarts_without_loss(spark, served, tmp_path, monkeypatch):
    from grantlens.plans import serving, training
    from grantlens.sources import artifacts
    from grantlens.streaming import scoring as stream
    apps, req, td = served
    base, src, out, bad, ckpt = (str(tmp_path / x) for x in ("saved", "in", "out", "bad", "ckpt"))
    save = lambda: artifacts.save_version(spark, base, artifacts.build_lookups(apps), lambda p: training.save_models(td, p, NAMES))
    save()
    half = [req.where(f"req_id % 2 = {i}") for i in (0, 1)]
    half[0].coalesce(1).write.mode("append").parquet(src)

    def run():
        stream.start_stream_score(spark, src, req.schema, base, out, bad, ckpt).awaitTermination()
    run()
    assert {r[0] for r in spark.read.parquet(out).select("version").distinct().collect()} == {1}
    save()
    half[1].coalesce(1).write.mode("append").parquet(src)
    # The batch fails after its answers are written and before it is done: the restart repeats it.
    real, calls = stream.release, []

    def lost(df):
        calls.append(1)
        raise RuntimeError("lost")
    monkeypatch.setattr(stream, "release", lost)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(stream, "release", real)
    run()
    run()  # nothing is left to do
    rows = spark.read.parquet(out).persist()
    assert calls and {tuple(r) for r in rows.select("batch", "version").distinct().collect()} == {(0, 1), (1, 2)}
    want = serving.batch_respond(spark, req, base, (1,)).drop("version")
    assert _rows(rows.drop("version", "batch")) == _rows(want) and rows.count() > 0
    rejected = spark.read.parquet(bad)
    assert rejected.count() + rows.count() == req.count() and rejected.where("error is null").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 10, 97, 1000, 1023, 5000])
def test_the_bijection_is_one(spark, n):
    rows = spark.range(n).select(models.bijection(F.col("id"), n).alias("p"), models.bijection(F.col("id"), n, seed=8).alias("q"), "id").collect()
    assert sorted(r.p for r in rows) == sorted(r.q for r in rows) == list(range(n))
    if n >= 97:
        near = sum(abs(r.p - r.id) <= n // 50 for r in rows)
        assert near < n / 8 and [r.p for r in rows] != [r.q for r in rows]


def test_permuted_column_is_whole_and_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("app_id"), (F.col("id") * 1.5).alias("x"))
    a, b = ({r.app_id: r.x for r in models.permute_column(d, "x").collect()} for d in (df.repartition(2), df.repartition(13, "x")))
    assert a == b and sorted(a.values()) == sorted(i * 1.5 for i in range(3000))
    moved = sum(abs(x / 1.5 - i) > 1024 for i, x in a.items())
    assert moved > 1000  # partners come from the whole table


def test_permutation_importance_one_pass_equals_per_feature(spark):
    """The one-pass variants give the same AUCs as permuting one column at a time."""
    import random

    from pyspark.sql import functions as F

    from grantlens.operators import models
    from grantlens.operators.evaluation import auc
    from grantlens.operators.features import FEATURES, LABEL

    rnd = random.Random(3)
    rows = []
    for i in range(600):
        y = rnd.random() < 0.5
        rows.append((i, *[rnd.gauss(1.5 if (y and j < 3) else 0.0, 1.0) for j in range(12)],
                     int(y)))
    df = spark.createDataFrame(rows, ["app_id", *FEATURES, LABEL])
    bounds = {c: (-5.0, 5.0) for c in FEATURES}
    m = models.fit("Logistic Regression", df, bounds, iterations=50)
    got = {r.feature: r.permuted_auc for r in models.permutation_importance(m, df).collect()}
    for c in FEATURES[:4]:
        s = models.score(m, models.permute_column(df, c)).withColumn("modelo", F.lit("m"))
        want = auc(s, LABEL, "prob", "modelo").first()["auc"]
        assert abs(got[c] - want) < 1e-12, c
    # Signal lives in the first three features: permuting them costs AUC.
    assert min(got[c] for c in FEATURES[:3]) < max(got[c] for c in FEATURES[3:])


def test_forest_counts_of_all_cores_fit_in_a_small_executor(spark):
    """Spark holds one group of nodes per running task, in half as many bytes again as the estimator's figure."""
    mb = models.estimator("Random Forest").getMaxMemoryInMB()
    small_heap_mb, cores = 1800, 4
    assert 1.5 * mb * cores < small_heap_mb / 4


def test_forest_grows_whole_trees_when_a_level_takes_many_passes(spark, monkeypatch):
    rows = [(i, *(float((i * p) % 997) for p in range(3, 3 + len(features.FEATURES))), (i * i // 7) % 2) for i in range(1500)]
    df = spark.createDataFrame(rows, "app_id long, " + ", ".join(f"{c} double" for c in features.FEATURES) + ", Aprobado int")

    def grown():
        m = models.fit("Random Forest", df, {}, iterations=3)
        return m.stages[-1].totalNumNodes, models.score(m, df).where("prediction = Aprobado").count()

    nodes, right = grown()
    monkeypatch.setattr(models, "FOREST_MEMORY_MB", 1)  # about 128 nodes in a pass
    few_nodes, few_right = grown()
    assert few_nodes > 0.85 * nodes and few_right > 0.9 * right
