"""Every SQL-checked key equals its DuckDB oracle; plan shape checks."""

import importlib.util
import os

from conftest import SF_SMALL

HERE = os.path.dirname(os.path.abspath(__file__))


def _oracle_check():
    spec = importlib.util.spec_from_file_location("oracle_check", f"{HERE}/oracle_check.py")
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_all_sql_keys_match_duckdb(spark):
    import __spark_entry__ as E
    keys = sorted(E.oracle_sql())
    res = _oracle_check().compare(spark, SF_SMALL, keys, verbose=False)
    bad = {k: v for k, v in res.items() if v[0] != "ok"}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "Aprobado" in df.columns


def test_no_cartesian_products_in_sql_keys(spark):
    import __spark_entry__ as E
    qs = E.queries()
    for k in sorted(E.oracle_sql()):
        plan = qs[k](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, k
        assert "BroadcastNestedLoopJoin" not in plan, k


def test_scan_pruning_and_pushdown(spark):
    from pyspark.sql import functions as F

    from grantlens.sources import tables
    raw = tables.applications_raw(spark, SF_SMALL)
    df = raw.where(F.col("Programa") == "1-URGENT").select("app_id", "Programa")
    plan = df._jdf.queryExecution().executedPlan().toString()
    # lineitem is not needed for these columns: the join is pruned away.
    assert "lineitem" not in plan
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)" in plan
    # Neither is the price: no scan reads it.
    assert "o_totalprice" not in plan


def _join_counts(df):
    import re
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {j: len(re.findall(j, plan)) for j in ("BroadcastHashJoin", "SortMergeJoin")}


def test_lookup_joins_broadcast_only_within_ceiling(spark):
    """Category lookups broadcast when measured small; past the ceiling
    they fall back to sort-merge joins and the results do not change."""
    import __spark_entry__ as E
    qs = E.queries()
    keys = ["training_matrix", "validate_requests", "serving_features", "tfidf"]
    for k in keys:
        assert _join_counts(qs[k](spark, SF_SMALL))["SortMergeJoin"] == 0, k
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        for k in keys:
            assert _join_counts(qs[k](spark, SF_SMALL))["SortMergeJoin"] >= 1, k
        res = _oracle_check().compare(spark, SF_SMALL, keys, verbose=False)
        assert all(v[0] == "ok" for v in res.values()), res
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_single_partition_exchanges_only_above_aggregates(spark):
    """No global window or sort gathers raw rows into one task: every
    single-partition exchange reads the output of an aggregate."""
    import __spark_entry__ as E
    qs = E.queries()
    skip = ("Project", "AQEShuffleRead", "InputAdapter", "WholeStageCodegen", "Filter")
    for k in sorted(E.oracle_sql()):
        lines = qs[k](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString().splitlines()
        for i, ln in enumerate(lines):
            if "Exchange SinglePartition" not in ln:
                continue
            below = [x.strip(" :+-*()0123456789") for x in lines[i + 1:]]
            child = next(x for x in below if not x.startswith(skip))
            assert "Aggregate" in child, (k, ln.strip(), child[:120])
