"""One store of mergeable partial aggregates behind the statistics, reports and series.

A cell is one combination of department, municipality, program, state and year,
with counts, exact sums (money in whole cents) and maxima of its applications.
Every statistic over records is a sum, mean, maximum or distinct count over
cells, so once the cells are written no report scans the records again.

The store is a folder of parts, one per load of applications.  Adding a load
writes the cells of its own rows only; a part that is written again replaces
itself, so a repeated load counts once.  Readers merge the cells of all parts,
which gives what a rebuild from all records gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("Departamento", "Municipio", "Programa", "Estado", "Anio_int")
#: Measures that are summed, and measures of which the greatest is kept.
SUMS = ("cell_n", "cell_ap", "cell_n_ap", "cell_hh", "cell_n_hh", "cell_cents", "cell_n_val", "cell_lost")
MAXIMA = ("cell_hh_max", "cell_val_max")


def money_cents(col: str):
    """Money as whole cents (exact integer sums at any scale)."""
    return F.round(F.col(col) * F.lit(100.0)).cast("long")


def cells(apps: DataFrame) -> DataFrame:
    """The cells of cleaned applications; a frame that holds cells already is returned as it is.

    Works with the columns that are there: a missing key is left out, a measure of a missing column is null.
    """
    if "cell_n" in apps.columns:
        return apps
    keys = [k for k in KEYS if k in apps.columns]
    has = lambda c, e: e if c in apps.columns else F.lit(None)
    lost = F.sum(F.when(F.col("Aprobado") == 0, money_cents("Valor_Num"))) if {"Aprobado", "Valor_Num"} <= set(apps.columns) else F.lit(None)
    return apps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cell_n"),
        has("Aprobado", F.sum("Aprobado")).cast("long").alias("cell_ap"), has("Aprobado", F.count("Aprobado")).cast("long").alias("cell_n_ap"),
        has("Hogares", F.sum("Hogares")).cast("long").alias("cell_hh"), has("Hogares", F.count("Hogares")).cast("long").alias("cell_n_hh"),
        has("Valor_Num", F.sum(money_cents("Valor_Num"))).cast("long").alias("cell_cents"), has("Valor_Num", F.count("Valor_Num")).cast("long").alias("cell_n_val"),
        lost.cast("long").alias("cell_lost"),
        has("Hogares", F.max("Hogares")).cast("long").alias("cell_hh_max"), has("Valor_Num", F.max("Valor_Num")).cast("double").alias("cell_val_max"))


def add(base: str, apps: DataFrame, part: str) -> None:
    """Add a load of applications to the store below ``base``, or replace the load of that name."""
    cells(apps).write.mode("overwrite").parquet(f"{base}/part={part}")


def read(spark: SparkSession, base: str) -> DataFrame:
    """The merged cells of all loads."""
    parts = spark.read.option("basePath", base).parquet(f"{base}/part=*").drop("part")
    return parts.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS), *(F.max(c).alias(c) for c in MAXIMA))
