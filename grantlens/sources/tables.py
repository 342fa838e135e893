"""Driver tables and the application / request views derived from them.

The application view maps one order to one subsidy application:
orders join customer, nation and region, left join the line count per
order.  Only the columns named below are read, so Catalyst prunes the
parquet scans to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.functions.cleaning import clean_applications
from grantlens.session import broadcast_if_small, ensure_parallelism

# Status text written for open orders, chosen by key % 4.
OPEN_ORDER_STATES = ["Apto con Subsidio Vencido", "Renuncia", "Revocado", "Rechazado"]
# Models a request may select (the scoring service's list).
SELECTABLE_MODELS = ["Logistic Regression", "Random Forest", "XGBoost", "Red MLP"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(index: Column, values: list[str]) -> Column:
    out = None
    for i, v in enumerate(values):
        out = F.when(index == i, F.lit(v)) if out is None else out.when(index == i, F.lit(v))
    return out


def applications_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw application records (string-typed like the source file) + app_id.

    ``orders`` drives the row count.  When it arrives in fewer partitions
    than there are cores (a small single-file table), it is spread once so
    the joins, the text formatting and the downstream write run on every
    core; large inputs already have enough splits and are left alone.
    """
    orders = ensure_parallelism(read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderdate", "o_orderpriority"))
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select(
        "n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # Partial (map-side) count per order before the shuffle on l_orderkey.
    lines = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).alias("n_lines")))

    # Dimension chain first: nation/region are tiny and broadcast by size.
    # The chain is the build side of the join with orders when its measured
    # size fits the broadcast ceiling (Spark's own estimate of a join
    # output is a product of sizes, which would pick orders instead);
    # beyond it both sides shuffle on the customer key.
    geo = (customer.join(nation, customer.c_nationkey == nation.n_nationkey)
           .join(region, nation.n_regionkey == region.r_regionkey))
    geo = broadcast_if_small(geo)
    base = (orders.join(geo, orders.o_custkey == geo.c_custkey)
            .join(lines, orders.o_orderkey == lines.l_orderkey, "left"))

    key = F.col("o_orderkey")
    estado = (F.when(F.col("o_orderstatus") == "F", F.lit("Asignados"))
              .when(F.col("o_orderstatus") == "P", F.lit("asignado parcial"))
              .otherwise(_pick(key % 4, OPEN_ORDER_STATES)))
    month_frac = (F.month("o_orderdate") - 1).cast("double") / F.lit(12.0)
    return base.select(
        key.alias("app_id"),
        F.col("r_name").alias("Departamento"),
        F.col("r_regionkey").cast("string").alias("Cod_Dpto"),
        F.concat_ws("/", "n_name", "c_mktsegment").alias("Municipio"),
        F.col("n_nationkey").cast("string").alias("Cod_Mpio"),
        F.col("o_orderpriority").alias("Programa"),
        F.year("o_orderdate").cast("string").alias("Anio_raw"),
        (F.year("o_orderdate").cast("double") + month_frac).alias("Anio_real"),
        estado.alias("Estado"),
        F.col("n_lines").cast("string").alias("Hogares"),
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("Valor_Asignado"),
    )


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned applications (P1-P6 applied)."""
    return clean_applications(applications_raw(spark, sf_dir))


def requests_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from_applications(applications(spark, sf_dir))


def requests_from_applications(apps: DataFrame) -> DataFrame:
    """Scoring requests derived from every application.

    Fixed shares (by app_id % 20) carry an unknown model, department,
    municipality, program or an out-of-range year so that each rejection
    path is exercised; every other request mirrors its application.
    """
    k = F.col("app_id")
    slot = k % 20
    model = F.when(slot == 1, F.lit("Gradient Boosting")).otherwise(
        _pick(F.floor(k / 20) % 4, SELECTABLE_MODELS))
    return apps.select(
        k.alias("req_id"),
        F.when(slot == 2, F.lit("ATLANTIS")).otherwise(F.col("Departamento")).alias("departamento"),
        F.when(slot == 3, F.lit("NATION_X/NONE")).otherwise(F.col("Municipio")).alias("municipio"),
        F.when(slot == 4, F.lit("6-UNKNOWN")).otherwise(F.col("Programa")).alias("programa"),
        F.when(slot == 5, F.col("Anio_int") + 40).otherwise(F.col("Anio_int")).alias("anio"),
        F.col("Hogares").alias("hogares"),
        (F.col("Valor_Num") * F.lit(1000.0)).alias("valor_cop"),
        model.alias("modelo"),
    )
