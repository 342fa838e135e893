"""Group statistics, KPIs and category lists.

Every statistic is read from cells, one row per combination of the categories
and the year (``operators.store``): given cells, no record is scanned; given
applications, they are reduced to cells first, by one partial (map-side)
aggregate, so a hot key costs one row per map task, not its whole group.
Null group keys are dropped (pandas ``groupby`` semantics).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlens.operators.ranking import ranked_within
from grantlens.operators.store import cells

CATEGORY_COLUMNS = ("Departamento", "Municipio", "Programa")


def mean_of(total: str, count: str):
    """Mean of an exact sum: divided once, null without values."""
    return F.try_divide(F.sum(total).cast("double"), F.sum(count))


def _rate():
    return mean_of("cell_ap", "cell_n_ap")


def _households():
    return mean_of("cell_hh", "cell_n_hh")


def municipality_stats(apps: DataFrame, key: str = "Municipio") -> DataFrame:
    """A1: mean approval, mean households and record count per municipality."""
    return (cells(apps).where(F.col(key).isNotNull()).groupBy(key)
            .agg(_rate().alias("hist_ap"), _households().alias("hist_hh"), F.sum("cell_n").alias("n_reg")))


def program_stats(apps: DataFrame, key: str = "Programa") -> DataFrame:
    """A2: mean approval and mean households per program."""
    return (cells(apps).where(F.col(key).isNotNull()).groupBy(key)
            .agg(_rate().alias("prog_ap"), _households().alias("prog_hh")))


def dataset_kpis(apps: DataFrame) -> DataFrame:
    """A3: rows, distinct municipalities, approval rate (one row)."""
    return cells(apps).agg(F.coalesce(F.sum("cell_n"), F.lit(0)).alias("n_records"),
                           F.countDistinct("Municipio").alias("n_municipalities"),
                           _rate().alias("approval_rate"))


def national_rate(apps: DataFrame) -> float:
    """Overall approval rate as a scalar (one-row aggregate)."""
    return float(cells(apps).agg(_rate()).first()[0] or 0.0)


def category_lists(apps: DataFrame, columns=CATEGORY_COLUMNS) -> DataFrame:
    """A4: sorted distinct values per category column, as (category, value, position).

    Each column is reduced to its distinct values, which are ranked by range
    partitions: no task holds all values of a column.
    """
    parts = [apps.select(F.lit(c).alias("category"), F.col(c).alias("value"))
             .where(F.col("value").isNotNull()).distinct() for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ranked_within(out, "category", ["value"], "position")


def dataset_bounds(apps: DataFrame) -> DataFrame:
    """A5: min/max year, max households, max value (one row)."""
    return cells(apps).agg(F.min("Anio_int").alias("anio_min"), F.max("Anio_int").alias("anio_max"),
                           F.max("cell_hh_max").alias("hogares_max"), F.max("cell_val_max").alias("valor_max"))


def municipalities_by_department(apps: DataFrame, exploded: bool = True) -> DataFrame:
    """Department -> sorted distinct municipalities.

    ``exploded=False`` gives one row per department with a sorted array
    (the lookup form); the default gives (Departamento, Municipio, position).
    The array form collects one department's distinct municipalities,
    which is bounded by the number of municipalities, not by rows.
    """
    pairs = (apps.where(F.col("Departamento").isNotNull() & F.col("Municipio").isNotNull())
             .select("Departamento", "Municipio").distinct())
    if not exploded:
        return pairs.groupBy("Departamento").agg(
            F.sort_array(F.collect_list("Municipio")).alias("municipios"))
    w = Window.partitionBy("Departamento").orderBy("Municipio")
    return pairs.withColumn("position", F.row_number().over(w) - 1)


def municipality_profile(apps: DataFrame, key: str = "Municipio") -> DataFrame:
    """Rate, mean households, mean value, count, distinct programs."""
    return (cells(apps).where(F.col(key).isNotNull()).groupBy(key)
            .agg(_rate().alias("tasa"), _households().alias("hh_mean"),
                 (mean_of("cell_cents", "cell_n_val") / F.lit(100.0)).alias("val_mean"),
                 F.sum("cell_n").alias("n_reg"),
                 F.countDistinct("Programa").alias("n_prog")))


def prior_history(apps: DataFrame, key: str = "Municipio", year: str = "Anio_int") -> DataFrame:
    """Leakage-free history per (key, year) from strictly earlier years.

    Cells are reduced to one row per (key, year); the running window
    then sees years, not records.  Years with no earlier data get NULL
    rates and 0 counts.
    """
    per_year = (cells(apps).where(F.col(key).isNotNull()).groupBy(key, year)
                .agg(F.sum("cell_ap").alias("_ap"), F.sum("cell_hh").alias("_hh"),
                     F.sum("cell_n").alias("_n")))
    w = (Window.partitionBy(key).orderBy(year)
         .rangeBetween(Window.unboundedPreceding, -1))
    n_prev = F.coalesce(F.sum("_n").over(w), F.lit(0))
    return per_year.select(
        key, year,
        F.try_divide(F.sum("_ap").over(w), n_prev).alias("prior_ap"),
        F.try_divide(F.sum("_hh").over(w), n_prev).alias("prior_hh"),
        n_prev.alias("prior_n"))
