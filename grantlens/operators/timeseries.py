"""Per-entity year series, rolling means, lag sequences, forecasts.

Rows are reduced to one row per (entity, year) before any window, and
every window is partitioned by the entity, so a window task holds one
entity's years, never raw records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlens.operators.stats import mean_of
from grantlens.operators.store import cells


def yearly_series(apps: DataFrame, key: str = "Municipio", year: str = "Anio_int") -> DataFrame:
    """(key, year) -> households, approval rate, records."""
    return (cells(apps).where(F.col(key).isNotNull()).groupBy(key, year)
            .agg(F.sum("cell_hh").alias("hogares"), mean_of("cell_ap", "cell_n_ap").alias("tasa"),
                 F.sum("cell_n").alias("n")))


def rolling_mean(series: DataFrame, key: str, order: str, value: str, n: int = 5,
                 out: str | None = None) -> DataFrame:
    """Trailing mean over n rows; NULL until n values are present."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
    out = out or f"{value}_ma{n}"
    return series.withColumn(
        out, F.when(F.count(F.col(value)).over(w) >= n, F.avg(value).over(w)))


def year_sequences(series: DataFrame, key: str = "Municipio", year: str = "Anio_int",
                   value: str = "hogares", window: int = 8, min_years: int = 10) -> DataFrame:
    """Inputs x1..x<window> (oldest first) and target y per year.

    Entities need at least ``min_years`` observed years; lags run over
    observed years (gaps are skipped, not filled).
    """
    w = Window.partitionBy(key).orderBy(year)
    whole = Window.partitionBy(key)
    s = (series.withColumn("_years", F.count(F.lit(1)).over(whole))
         .withColumn("_idx", F.row_number().over(w)))
    lags = [F.lag(value, window - i + 1).over(w).cast("double").alias(f"x{i}")
            for i in range(1, window + 1)]
    s = s.select(key, year, "_years", "_idx", *lags, F.col(value).cast("double").alias("y"))
    return (s.where((F.col("_years") >= min_years) & (F.col("_idx") > window))
            .drop("_years", "_idx"))


def persistence_forecast(seqs: DataFrame, window: int) -> DataFrame:
    """Naive baseline: next value = last observed value."""
    return seqs.withColumn("yhat", F.col(f"x{window}"))


def next_year_forecast(seqs: DataFrame, window: int, year: str = "Anio_int",
                       max_iter: int = 50) -> DataFrame:
    """Linear model on the lag vector; train on earlier target years,
    predict the latest target year.  Without an earlier target year there is
    nothing to learn from: the forecasts are NULL."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    feats = [f"x{i}" for i in range(1, window + 1)]
    last = seqs.agg(F.max(year)).first()[0]
    va = VectorAssembler(inputCols=feats, outputCol="features")
    data = va.transform(seqs)
    train = data.where(F.col(year) < last)
    test = data.where(F.col(year) == last)
    if train.limit(1).count() == 0:
        return test.select(*[c for c in seqs.columns if c not in feats], F.lit(None).cast("double").alias("yhat"))
    model = LinearRegression(featuresCol="features", labelCol="y", maxIter=max_iter,
                             regParam=0.0).fit(train)
    return model.transform(test).select(*[c for c in seqs.columns if c not in feats],
                                        F.col("prediction").alias("yhat"))
