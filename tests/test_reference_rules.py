"""Rules of the reference on values that the driver's tables do not hold."""

import random

import pytest

from grantlens.functions import bands, cleaning
from grantlens.operators import clustering, evaluation, scoring, timeseries


@pytest.mark.parametrize("text,households,value", [
    ("12", 12, 12.0), (" 12 ", 12, 12.0), ("12.9", 12, 12.9), ("-3.5", -3, -3.5), ("+4", 4, 4.0), (".5", 0, 0.5), ("7.", 7, 7.0),
    ("1e3", 1000, 1000.0), ("12d", 0, 0.0), ("3f", 0, 0.0), ("0x1A", 0, 0.0), ("1_000", 0, 0.0), ("inf", 0, 0.0), ("-Infinity", 0, 0.0),
    ("nan", 0, 0.0), ("", 0, 0.0), ("   ", 0, 0.0), (None, 0, 0.0), ("abc", 0, 0.0), ("1e400", 0, 0.0), ("1e30", 0, 1e30), ("1 2", 0, 0.0)])
def test_lenient_numbers(spark, text, households, value):
    df = spark.createDataFrame([(text, None if text is None else f"${text}")], "h string, v string")
    r = df.select(cleaning.lenient_int("h").alias("h"), cleaning.currency("v").alias("v")).first()
    assert (r["h"], r["v"]) == (households, value)


def test_currency_text_and_count_of_unreadable_numbers(spark):
    rows = [("1", "$1,200.50"), ("x", "$1,200d"), ("", "$"), (None, None), ("inf", "abc")]
    df = spark.createDataFrame(rows, "Hogares string, Valor_Asignado string")
    assert [r[0] for r in df.select(cleaning.currency("Valor_Asignado")).collect()] == [1200.5, 0.0, 0.0, 0.0, 0.0]
    assert tuple(cleaning.unreadable_numbers(df).first()) == (2, 2)


def test_auc_tells_close_scores_apart(spark):
    df = spark.createDataFrame([("m", 0.7009, 1), ("m", 0.7001, 0), ("k", 0.7001, 1), ("k", 0.7009, 0), ("t", 0.5, 1), ("t", 0.5, 0),
                                ("one", 0.5, 1)], "modelo string, prob double, label int")
    got = {r["modelo"]: r["auc"] for r in evaluation.auc(df).collect()}
    assert got == {"m": 1.0, "k": 0.0, "t": 0.5, "one": None}


def test_auc_matches_all_pairs(spark):
    rng = random.Random(2)
    rows = [("m", rng.choice([rng.random(), round(rng.random(), 2)]), int(rng.random() < 0.4)) for _ in range(400)]
    pos, neg = ([p for _, p, y in rows if y == k] for k in (1, 0))
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "modelo string, prob double, label int").repartition(5)
    assert evaluation.auc(df).first()["auc"] == pytest.approx(want, abs=1e-12)
    full = evaluation.classification_metrics(df).first()
    assert full["auc"] == pytest.approx(want, abs=1e-12) and full["n"] == 400


def test_forecast_does_not_learn_from_what_it_predicts(spark):
    one = spark.createDataFrame([("a", 2000, 1.0, 2.0), ("b", 2000, 3.0, 9.0)], "Municipio string, Anio_int int, x1 double, y double")
    assert [r["yhat"] for r in timeseries.next_year_forecast(one, 1).collect()] == [None, None]


def test_sequences_of_eight_years_need_ten(spark):
    rows = [("nine", y, y) for y in range(9)] + [("ten", y, 10 * y) for y in range(10)] + [("gap", 2 * y, y) for y in range(12)]
    out = timeseries.year_sequences(spark.createDataFrame(rows, "Municipio string, Anio_int int, hogares int")).collect()
    got = sorted((r["Municipio"], r["Anio_int"], [r[f"x{i}"] for i in range(1, 9)], r["y"]) for r in out)
    assert got == [("gap", 16, list(map(float, range(8))), 8.0), ("gap", 18, list(map(float, range(1, 9))), 9.0),
                   ("gap", 20, list(map(float, range(2, 10))), 10.0), ("gap", 22, list(map(float, range(3, 11))), 11.0),
                   ("ten", 8, [10.0 * i for i in range(8)], 80.0), ("ten", 9, [10.0 * i for i in range(1, 9)], 90.0)]


def test_gap_text_is_pythons(spark):
    rng = random.Random(5)
    pairs = [(0.5625, 0.5), (0.5, 0.5625), (0.9975, 0.99), (0.75, 0.5), (1.0, 0.0), (0.6015, 0.5), (0.5675, 0.5), (0.53125, 0.5)]
    pairs += [(rng.random(), rng.random()) for _ in range(500)] + [(rng.randrange(10001) / 1e4, rng.randrange(10001) / 1e4) for _ in range(500)]
    df = spark.createDataFrame([(i, a, b, "M") for i, (a, b) in enumerate(pairs)], "i int, a double, b double, m string")
    for r in df.select("i", bands.interpretation("a", "b", "m").alias("t")).collect():
        d = pairs[r["i"]][0] - pairs[r["i"]][1]
        if abs(d) >= 0.03:
            assert f" {abs(d) * 100:.1f} pp" in r["t"], (pairs[r["i"]], r["t"])


def test_nested_response_with_and_without_a_cluster(spark):
    scored = spark.createDataFrame([(1, "known", "Random Forest", 0.8, 0.7), (2, "unknown", "Red MLP", 0.2, 0.7)],
                                   "req_id long, municipio string, modelo string, prob_sel double, prob_ref double")
    clusters = spark.createDataFrame([("known", 3, "Alto volumen urbano", 0.6, "Monitoreo continuo")],
                                     "municipio string, cluster int, cluster_perfil string, cluster_tasa double, accion string")
    out = {r["req_id"]: r for r in scoring.response_struct(
        scoring.score_compare(scored, spark, keep=["municipio"]), clusters).collect()}
    assert out[1]["modelo_seleccionado"]["cluster"] == 3 and out[1]["reference"]["cluster_tasa"] == 0.6
    assert out[1]["modelo_seleccionado"]["accion"] == "Monitoreo continuo"
    assert out[2]["modelo_seleccionado"]["cluster"] is None and out[2]["reference"]["modelo"] == "XGBoost"
    assert out[2]["modelo_seleccionado"]["clasificacion"] == "NO RECOMENDADO"


def test_clusters_past_the_named_profiles_have_none(spark):
    n = len(clustering.CLUSTER_PROFILES)
    assign = spark.createDataFrame([(f"m{i}", i) for i in range(n + 2)], "Municipio string, cluster int")
    rates = spark.createDataFrame([(f"m{i}", 1.0 - i / 10) for i in range(n + 2)], "Municipio string, tasa double")
    got = {r["cluster"]: (r["cluster_perfil"], r["accion"]) for r in clustering.cluster_profiles(assign, rates).collect()}
    assert got == {i: clustering.CLUSTER_PROFILES[i] if i < n else (None, None) for i in range(n + 2)}


def test_density_clusters_of_a_long_chain(spark):
    rows = [(f"p{i:03d}", i * 0.9, 0.0) for i in range(150)] + [("far", 500.0, 9.0)] + [(f"q{i}", 900.0, float(i % 2)) for i in range(5)]
    got = {r["Municipio"]: r["cluster"] for r in clustering.density_clusters(
        spark.createDataFrame(rows, "Municipio string, a double, b double"), cols=("a", "b"), eps=1.0, min_pts=2).collect()}
    assert {got[f"p{i:03d}"] for i in range(150)} == {0} and got["far"] == -1 and {got[f"q{i}"] for i in range(5)} == {1}
