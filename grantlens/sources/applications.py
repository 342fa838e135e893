"""Load the raw application table with a pinned schema.

The source is read positionally (11 columns) and renamed, the trailing
``Extra`` column is dropped.  Excel is not read here: convert it to
parquet or CSV first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Positional column names of the application table.
APPLICATION_COLUMNS = [
    "Departamento", "Cod_Dpto", "Municipio", "Cod_Mpio", "Programa",
    "Anio_raw", "Anio_real", "Estado", "Hogares", "Valor_Asignado", "Extra",
]

RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType() if c == "Anio_real" else T.StringType())
     for c in APPLICATION_COLUMNS])


def load_applications(spark: SparkSession, path: str, fmt: str = "parquet",
                      header: bool = True) -> DataFrame:
    """Read an application file and pin names and types.

    Parquet files are renamed by position; CSV files are read with the
    explicit schema (never inferred).  Numeric-looking text columns stay
    strings: cleaning (``grantlens.functions.cleaning``) parses them.
    """
    if fmt == "csv":
        df = (spark.read.schema(RAW_SCHEMA).option("header", header)
              .option("mode", "PERMISSIVE").csv(path))
    else:
        df = spark.read.format(fmt).load(path)
        if len(df.columns) != len(APPLICATION_COLUMNS):
            raise ValueError(
                f"expected {len(APPLICATION_COLUMNS)} columns, got {len(df.columns)}")
        df = df.toDF(*APPLICATION_COLUMNS)
        df = df.select([df[f.name].cast(f.dataType) for f in RAW_SCHEMA.fields])
    return df.drop("Extra")
