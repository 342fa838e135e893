"""Global ranks without a global window.

Rows are range-partitioned on the order columns and written with the number
of their range.  The ranges' sizes are one row per range; their running sums
are the ranks at which the ranges start, and inside a range rows are numbered
by a window over that range alone.  So no task ever holds all rows, and the
sort is the only shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlens.plans.materialize import written


def ranked(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """``df`` with a long column ``out``: the 0-based place of each row in the order of the columns ``order``.

    Nulls come first.  Rows that are equal in ``order`` are numbered in any
    order; on distinct rows the ranks do not depend on the partitioning.
    """
    cut = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranks")
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    # One row per range, in one array: as many entries as the sort had partitions.
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct("_range", "n"))).alias("s"))
    running = F.aggregate(
        "s", F.struct(F.lit(0).cast("long").alias("at"), F.expr("array()").cast("array<struct<_range:int,_start:bigint>>").alias("out")),
        lambda a, r: F.struct((a["at"] + r["n"]).alias("at"),
                              F.concat(a["out"], F.array(F.struct(r["_range"].alias("_range"), a["at"].alias("_start")))).alias("out")))["out"]
    starts = listed.select(F.inline(running))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return (cut.withColumn("_inside", inside).join(F.broadcast(starts), "_range")
            .withColumn(out, F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start"))


def ranked_within(df: DataFrame, group: str, order: list[str], out: str = "rank") -> DataFrame:
    """``df`` with the 0-based place of each row among those of its ``group``: a global rank less the group's first one."""
    whole = ranked(df, [group, *order], "_rank")
    first = whole.groupBy(group).agg(F.min("_rank").alias("_first"))
    return (whole.join(first, whole[group].eqNullSafe(first[group]), "left").drop(first[group])
            .withColumn(out, F.col("_rank") - F.col("_first")).drop("_rank", "_first"))
