"""The forest's growing: best splits against all splits, passes against subtrees, and what the model keeps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantlens.operators import features, forest, models


def test_best_splits_equal_trying_every_split():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n, width, m, classes = int(rng.integers(1, 60)), 3, int(rng.integers(1, 5)), int(rng.integers(2, 4))
        x, y, w = rng.integers(0, 6, (width, n)), rng.integers(0, classes, n), rng.integers(1, 4, n)
        node = np.sort(rng.integers(0, m, n))
        node = np.unique(node, return_inverse=True)[1]
        m = node.max() + 1
        counts = np.bincount(node * classes + y, w, m * classes).reshape(m, classes).T
        chosen = forest.drawn(rng, m, width, 2)
        gain, feature, cut, left = forest.best_splits(x, y, w, node, counts, chosen)
        for k in range(m):
            best = (-np.inf,)
            for f in chosen[k]:
                for c in np.unique(x[f, node == k])[:-1]:
                    side = (node == k) & (x[f] <= c)
                    a = np.bincount(y[side], w[side], classes)
                    g = forest.gains(a[:, None], counts[:, k:k + 1])[0]
                    if g > best[0]:
                        best = g, f, c, a.tolist()
            assert best[0] == gain[k] and (best[0] == -np.inf or best[1:] == (feature[k], cut[k], left[:, k].tolist()))


def _rows(spark, n=1500):
    rows = [(i, *(float((i * p) % 997) for p in range(3, 3 + len(features.FEATURES))), (i * i // 7) % 2) for i in range(n)]
    return spark.createDataFrame(rows, "app_id long, " + ", ".join(f"{c} double" for c in features.FEATURES) + ", Aprobado int")


def _checked(model):
    """Every child's counts make up its parent's, and no two sibling leaves agree."""
    trees = model.arrays()
    assert sum(len(t[0]) for t in trees) == model.totalNumNodes
    for feature, _, lo, counts in trees:
        inner = np.flatnonzero(lo >= 0)
        left = lo[inner]
        assert sorted(np.concatenate((left, left + 1)).tolist()) == list(range(1, len(lo))) and ((feature >= 0) == (lo >= 0)).all()
        assert (counts[left] + counts[left + 1] == counts[inner]).all()
        same = counts[left].argmax(axis=1) == counts[left + 1].argmax(axis=1)
        assert not ((lo[left] < 0) & (lo[left + 1] < 0) & same).any()


@pytest.mark.parametrize("rows_per_mb", [4096, 2])
def test_the_forest_is_whole_whether_grown_in_passes_or_in_one_task(spark, monkeypatch, tmp_path, rows_per_mb):
    """64 MB are 262,144 rows: every tree is one subtree.  With 128 rows the upper levels take passes over all rows."""
    from pyspark.ml import PipelineModel
    monkeypatch.setattr(forest, "ROWS_PER_MB", rows_per_mb)
    df = _rows(spark)
    m = models.fit("Random Forest", df, {}, iterations=3)
    model = m.stages[-1]
    subtrees = model.nodes.count()
    assert (subtrees == 3) if rows_per_mb == 4096 else (subtrees > 20)
    _checked(model)
    assert 1500 < model.totalNumNodes < 2000 and len(model.arrays()) == 3  # Spark's own trainer: 1715
    # 1219 with Spark's own trainer: three trees, each grown on two rows in three until it holds them
    assert models.score(m, df).where("prediction = Aprobado").count() > 1180
    assert abs(model.featureImportances.toArray().sum() - 1) < 1e-9
    m.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = ({r.app_id: (r.prob, r.prediction) for r in models.score(x, df).collect()} for x in (m, again))
    assert a == b and len(a) == 1500
    # Votes by hand: each tree adds the shares of the leaf of the row.
    v = np.array([[float((i * p) % 997) for p in range(3, 3 + len(features.FEATURES))] for i in range(20)])
    x = forest.binned_rows(v, model.thresholds)
    share = sum(c[:, 1] / c.sum(axis=1) for c in (t[-1][forest.leaves(x, t)] for t in model.arrays())) / 3
    assert all(abs(a[i][0] - share[i]) < 1e-12 for i in range(20))


def test_the_forest_does_not_depend_on_the_order_in_which_parts_arrive(spark):
    x = np.array([[1, 2, 3, 4, 5, 6] * 5, [3, 1, 2] * 10])
    y, w = np.array([0, 1, 1] * 10), np.arange(30) % 3 + 1
    a = forest.grow(x, y, w, 2, 30, 2, np.random.default_rng(1))
    order = np.random.default_rng(2).permutation(30)
    b = forest.grow(x[:, order], y[order], w[order], 2, 30, 2, np.random.default_rng(1))
    assert all((getattr(a, c) == getattr(b, c)).all() for c in ("feature", "cut", "lo", "hi", "counts"))


def test_odd_training_rows(spark):
    df = _rows(spark, 40)
    one_class = models.fit("Random Forest", df.withColumn("Aprobado", F.lit(0)), {}, iterations=2)
    assert [tuple(r) for r in models.score(one_class, df).select("prob", "prediction").distinct().collect()] == [(0.0, 0)]
    absent = df.withColumn(features.FEATURES[0], F.lit(float("nan")))
    assert models.score(models.fit("Random Forest", absent, {}, iterations=2), absent).where("prob between 0 and 1").count() == 40
    for bad in (df.where("false"), df.withColumn("Aprobado", F.lit(None).cast("int"))):
        with pytest.raises(Exception):
            models.fit("Random Forest", bad, {}, iterations=2)
