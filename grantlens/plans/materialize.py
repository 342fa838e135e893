"""Materialize the cleaned application table once per session and data folder.

Every report, feature and model job starts from the same cleaned table.
Instead of re-running the orders/customer/nation/region/lineitem joins in
each job, the table is written once as parquet to the shared folder and
read back, so later jobs get column pruning and filter pushdown on it and
a lost executor re-reads files instead of recomputing the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grantlens.operators import store
from grantlens.session import scratch_path
from grantlens.sources import tables

_TABLES: dict[tuple, str] = {}


def applications_table(spark: SparkSession, sf_dir: str, refresh: bool = False) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if refresh or key not in _TABLES:
        path = scratch_path(spark, "applications")
        # The view spreads an under-partitioned orders input itself, so the
        # write already yields at least one file per core.
        tables.applications(spark, sf_dir).write.mode("overwrite").parquet(path)
        _TABLES[key] = path
    return spark.read.parquet(_TABLES[key])


_CELLS: dict[tuple, str] = {}


def cells_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partial aggregates of the applications (``operators.store``), written once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CELLS:
        base = scratch_path(spark, "cells")
        store.add(base, applications_table(spark, sf_dir), "0")
        _CELLS[key] = base
    return store.read(spark, _CELLS[key])


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a fresh path in the shared folder and read it back.

    Cuts the lineage with one computation of ``df`` (an eager
    ``checkpoint()`` computes its plan twice: once to count, once to
    write), and later readers get column pruning and filter pushdown.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.written_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove the files of tables from ``written`` that no later plan reads, such as a round that the next one replaces."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
