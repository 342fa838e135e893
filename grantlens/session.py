"""Session helpers: sane defaults for local tests, shared-folder discovery."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app_name: str = "grantlens",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster ``master`` stays None and the cluster's own settings win;
    only keys that are unset get a default here.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        # Local mode runs every task inside the driver JVM.
        b = b.config("spark.driver.memory", os.environ.get("GRANTLENS_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder visible to every executor, taken from ``spark.checkpoint.dir``.

    The cluster names it.  Only in local mode (tests) is a fresh folder
    under the system temp dir created and registered when it is unset; on
    a cluster an unset value is an error, never a machine-local folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        # A machine-local folder is not visible to other executors.
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach "
                           "(HDFS/S3/ABFS); materialized tables and checkpoints go there")
    local = tempfile.mkdtemp(prefix="grantlens-ckpt-")
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared folder for job outputs."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cpu_count() -> int:
    return os.cpu_count() or 8


def ensure_parallelism(df, min_partitions: int | None = None):
    """Round-robin repartition only when ``df`` has fewer partitions than cores.

    Small inputs (one parquet row group, a coalesced result) would otherwise
    run heavy per-row work in one or two tasks.  Large inputs already have
    at least as many partitions as cores, so this never adds a shuffle there.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def broadcast_threshold(spark: SparkSession) -> int:
    """Spark's broadcast ceiling in bytes (``-1`` disables broadcasting)."""
    raw = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
             "g": 1 << 30, "gb": 1 << 30}
    for suffix in sorted(units, key=len, reverse=True):
        if raw.endswith(suffix):
            return int(float(raw[: -len(suffix)]) * units[suffix])
    return int(raw)


def broadcast_if_small(*dfs):
    """Broadcast each frame only when its measured size fits Spark's ceiling.

    Lookup tables (statistics per category, known category values, code
    and cluster tables) are bounded by the number of categories, not by
    records, but that bound depends on the data, so it is measured: one
    job counts the rows and sums the bytes of every string column of all
    given frames (persisted first, so the joins then read those cached
    results).  Each row also counts 8 bytes per field plus 48 bytes of
    row header and hash table entry.  A frame past the ceiling has its
    cache released and is returned as is: Spark plans a sort-merge join
    with AQE skew splitting.  Returns one frame or a list, like the input.
    """
    from functools import reduce

    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    limit = broadcast_threshold(dfs[0].sparkSession)
    out = list(dfs)
    measures = []
    for i, df in enumerate(dfs):
        fields = df.schema.fields
        if limit <= 0 or any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
                             for f in fields):
            continue
        strings = [F.coalesce(F.sum(F.octet_length(F.col(f.name))), F.lit(0))
                   for f in fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
        out[i] = df.persist()
        measures.append(out[i].agg(
            F.lit(i).alias("i"),
            (F.count(F.lit(1)) * (48 + 8 * len(fields))
             + reduce(lambda a, b: a + b, strings, F.lit(0))).cast("long").alias("bytes")))
    if measures:
        sizes = {r["i"]: r["bytes"] for r in
                 reduce(lambda a, b: a.unionByName(b), measures).collect()}  # one row per frame
        for i, size in sizes.items():
            if size <= limit:
                out[i] = F.broadcast(out[i])
            else:
                out[i].unpersist()
                out[i] = dfs[i]
    return out[0] if len(dfs) == 1 else out
