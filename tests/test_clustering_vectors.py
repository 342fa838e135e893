"""Density outliers/clusters vs brute force; k-means relabel; cosine and top-k."""

import math
import random

import pytest
from pyspark.sql import functions as F

from grantlens.operators import clustering, density, vectors

COLS = ["x", "y", "z"]


def _points():
    rnd = random.Random(11)
    pts = []
    for cx, cy in ((0, 0), (5, 5), (-5, 4)):
        for _ in range(30):
            pts.append((cx + rnd.gauss(0, 0.4), cy + rnd.gauss(0, 0.4), rnd.gauss(0, 0.3)))
    pts += [(20.0, 20.0, 0.0), (-20.0, 3.0, 1.0), (9.0, -9.0, 0.0), (0.9, 0.9, 2.0)]
    return [(f"p{i:03d}", *p) for i, p in enumerate(pts)]


def _brute(pts, eps, min_pts):
    def d(a, b):
        return math.sqrt(sum((a[i] - b[i]) ** 2 for i in range(1, 4)))
    nb = {a[0]: [b[0] for b in pts if d(a, b) <= eps] for a in pts}
    core = {k for k, v in nb.items() if len(v) >= min_pts}
    noise = {k for k, v in nb.items() if k not in core and not (set(v) & core)}
    # components over core-core edges, label = min member
    label = {k: k for k in core}
    changed = True
    while changed:
        changed = False
        for k in core:
            m = min([label[k]] + [label[j] for j in nb[k] if j in core])
            if m != label[k]:
                label[k] = m
                changed = True
    comp = {}
    for k in nb:
        if k in core:
            comp[k] = label[k]
        elif k not in noise:
            comp[k] = min(label[j] for j in nb[k] if j in core)
    ids = {c: i for i, c in enumerate(sorted(set(comp.values())))}
    return nb, core, noise, {k: ids[comp[k]] if k in comp else -1 for k in nb}


def test_density_outliers_and_clusters_match_brute_force(spark):
    pts = _points()
    df = spark.createDataFrame(pts, "Municipio string, x double, y double, z double")
    nb, core, noise, clusters = _brute(pts, 1.0, 5)
    out = {r.Municipio: r for r in clustering.density_outliers(df, cols=COLS, eps=1.0,
                                                               min_pts=5).collect()}
    assert set(out) == set(nb)
    for k, r in out.items():
        assert r.n_neighbors == len(nb[k])
        assert r.is_core == (k in core)
        assert r.is_noise == (k in noise)
    got = {r.Municipio: r.cluster for r in
           clustering.density_clusters(df, cols=COLS, eps=1.0, min_pts=5).collect()}
    assert got == clusters
    assert len(set(clusters.values()) - {-1}) == 3


def _labels(df, eps, min_pts, cols):
    out = {r.Municipio: r for r in clustering.density_outliers(df, cols=cols, eps=eps, min_pts=min_pts).collect()}
    got = {r.Municipio: r.cluster for r in clustering.density_clusters(df, cols=cols, eps=eps, min_pts=min_pts).collect()}
    return out, got


def _brute_arrays(x, eps, min_pts):
    """(neighbours, core, noise, cluster) of points in the order of their keys, over all pairs."""
    import numpy as np
    near = np.zeros((len(x), len(x)))
    for d in range(x.shape[1]):
        diff = x[:, None, d] - x[None, :, d]
        near = near + diff * diff
    near = near <= eps * eps
    n = near.sum(axis=1)
    core = n >= min_pts
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        least = np.where(near & core[None, :], label[None, :], len(x)).min(axis=1)
        new = np.where(core, np.minimum(label, least), len(x))
        if (new == label).all():
            break
        label = new
    label = np.where(core, label, np.where(near & core[None, :], label[None, :], len(x)).min(axis=1))
    ids = {c: i for i, c in enumerate(sorted(set(label[label < len(x)].tolist())))}
    return n, core, ~core & (label == len(x)), [ids.get(c, -1) for c in label.tolist()]


@pytest.mark.parametrize("d,eps,min_pts,leaf", [(1, 0.004, 4, 32), (2, 0.1, 6, 2), (5, 0.5, 8, 32)])
def test_cells_match_all_pairs(spark, monkeypatch, d, eps, min_pts, leaf):
    import numpy as np
    monkeypatch.setattr(density, "LEAF", leaf)
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(0, 0.15, (500, d)), rng.normal(2, 0.4, (500, d)), rng.uniform(-2, 3, (700, d)),
                        np.repeat(rng.uniform(-2, 3, (10, d)), 20, axis=0), np.round(rng.uniform(-1, 1, (100, d)), 1)])
    rows = [(f"p{i:05d}", *map(float, p)) for i, p in enumerate(x)]
    cols = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame(rows, "Municipio string, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    n, core, noise, clusters = _brute_arrays(x, eps, min_pts)
    out, got = _labels(df, eps, min_pts, cols)
    assert len(out) == len(got) == len(x) and 0 < core.sum() < len(x) and noise.any() and max(clusters) > 0
    for i, (k, *_) in enumerate(rows):
        assert (out[k].n_neighbors, out[k].is_core, out[k].is_noise) == (n[i], core[i], noise[i])
        assert got[k] == clusters[i]


def test_a_cell_of_many_equal_points_makes_no_pairs(spark):
    same = spark.range(100_000).select(F.format_string("a%06d", "id").alias("Municipio"), F.lit(1.0).alias("x"), F.lit(-2.0).alias("y"), F.lit(0.0).alias("z"))
    grid = density.Grid(3, 1.0)
    _, locations = density.locations_of(same, "Municipio", COLS, grid)
    near = density.near_cells(locations, grid)
    assert locations.count() == 1 and near.count() == 1
    assert density.core_locations(locations, near, grid, 5).count() == 1
    out = clustering.density_outliers(same, cols=COLS)
    assert [tuple(r) for r in out.groupBy("n_neighbors", "is_core", "is_noise").count().collect()] == [(100_000, True, False, 100_000)]
    assert [tuple(r) for r in clustering.density_clusters(same, cols=COLS).groupBy("cluster").count().collect()] == [(0, 100_000)]


def test_dense_cells_of_different_points_are_decided_by_boxes(spark, monkeypatch):
    """Two crowded cells next to each other: no join of all their points, however many they hold."""
    import random
    rnd = random.Random(5)
    pts = [(f"{c}{i:05d}", rnd.uniform(0, 0.3) + (0.35 if c == "b" else 0.0), rnd.uniform(0, 0.3), 0.0) for c in "ab" for i in range(3000)]
    df = spark.createDataFrame(pts, "Municipio string, x double, y double, z double")
    grid = density.Grid(3, 1.0)
    _, locations = density.locations_of(df, "Municipio", COLS, grid)
    near = density.near_cells(locations, grid)
    assert density.core_locations(locations, near, grid, 5).count() == 6000
    assert {r.cluster for r in clustering.density_clusters(df, cols=COLS, eps=1.0).collect()} == {0}
    assert {r.n_neighbors for r in clustering.density_outliers(df, cols=COLS, eps=1.0).collect()} == {6000}


def test_points_without_a_place_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("b", -0.0, 0.0, 0.0), ("c", None, 1.0, 1.0), ("d", float("nan"), 1.0, 1.0)],
                               "Municipio string, x double, y double, z double")
    out, got = _labels(df, 1.0, 2, COLS)
    assert {k: (r.n_neighbors, r.is_core) for k, r in out.items()} == {"a": (2, True), "b": (2, True)} and got == {"a": 0, "b": 0}
    assert _labels(df.where("x > 5 and x < 6"), 1.0, 2, COLS) == ({}, {})


def test_ranks_do_not_need_one_task(spark):
    from grantlens.operators.ranking import ranked, ranked_within
    df = spark.range(500).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).cast("string").alias("g")).where("v <> 7").repartition(7)
    want = {v: i for i, v in enumerate(sorted(r.v for r in df.collect()))}
    got = ranked(df, ["v"], "r")
    assert {r.v: r.r for r in got.collect()} == want
    assert "SinglePartition" not in "\n".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in x)
    with_null = df.withColumn("g", F.when(F.col("g") != "1", F.col("g")))
    rows = ranked_within(with_null, "g", ["v"], "r").collect()
    for g in ("0", "2", None):
        mine = sorted((r.v, r.r) for r in rows if r.g == g)
        assert [r for _, r in mine] == list(range(len(mine))) and mine
    assert ranked(df.where("v < 0"), ["v"]).collect() == []


def test_kmeans_relabel_descending_rate(spark):
    pts = _points()
    rate = {p[0]: (0.9 if p[1] > 3 else 0.5 if p[1] > -3 and p[2] < 3 else 0.2) for p in pts}
    df = spark.createDataFrame([(p[0], p[1], p[2], p[3]) for p in pts],
                               "Municipio string, x double, y double, z double")
    prof = spark.createDataFrame(list(rate.items()), "Municipio string, tasa double")
    assign, _ = clustering.kmeans_clusters(df, cols=COLS, k=3, n_init=2)
    prof_rows = clustering.cluster_profiles(assign, prof).orderBy("cluster").collect()
    rates = [r.cluster_tasa for r in prof_rows]
    assert rates == sorted(rates, reverse=True)
    assert [r.cluster for r in prof_rows] == [0, 1, 2]


def test_cosine_and_nearest(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 0.1]), (4, [-1.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    pairs = vectors.cosine_pairs(e, vectors.successor_pairs(e)).orderBy("left_id").collect()
    assert len(pairs) == 4
    assert abs(pairs[0].cosine - 0.0) < 1e-12
    assert abs(pairs[1].cosine - 1 / math.sqrt(2)) < 1e-7
    near = vectors.nearest_vectors(e, [1.0, 0.0], 2, exclude_id=0).collect()
    assert [r.vec_id for r in near] == [3, 2]
    assert F is not None
