"""Column expressions that clean and derive application fields.

All are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What counts as a number; a plain cast would also take a type suffix such as in '12d'.
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def _number(text: Column) -> Column:
    """The number in a text, or NULL: junk, blanks, 'nan', and what is not finite as a double."""
    x = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)


def _zero_if_missing(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def year_half_even(col: str | Column) -> Column:
    """Round half to even, then int (2004.5 -> 2004, 2005.5 -> 2006)."""
    return F.bround(F.col(col) if isinstance(col, str) else col, 0).cast("int")


def lenient_int(col: str | Column) -> Column:
    """Lenient number -> 0 when missing/bad/out of range, truncated toward zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_number(c.cast("string")).try_cast("bigint"), F.lit(0).cast("bigint"))


def currency(col: str | Column) -> Column:
    """Strip '$' and ',' then parse; missing/bad -> 0.0."""
    c = F.col(col) if isinstance(col, str) else col
    return _zero_if_missing(_number(F.regexp_replace(c.cast("string"), r"[$,]", "")))


def unreadable_numbers(raw: DataFrame) -> DataFrame:
    """One row: how many non-empty household and value texts are read as 0 because they are no numbers."""
    def bad(text: Column) -> Column:
        return F.count_if((F.trim(text) != "") & _number(text).isNull())
    return raw.agg(bad(F.col("Hogares").cast("string")).alias("hogares"),
                   bad(F.regexp_replace(F.col("Valor_Asignado").cast("string"), r"[$,]", "")).alias("valor"))


def approved_flag(col: str | Column, marker: str = "ASIGNAD") -> Column:
    """1 when upper(Estado) contains the marker, else 0 (NULL -> 0)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.upper(c).contains(marker).cast("int"), F.lit(0))


def log1p_of(col: str | Column) -> Column:
    """P5: log(1+x); NULL for x <= -1 (such rows drop in P8)."""
    return F.log1p(F.col(col) if isinstance(col, str) else col)


def value_per_household_train(value: str, households: str) -> Column:
    """V / h when h > 0, else 0 (training form)."""
    return F.when(F.col(households) > 0, F.col(value) / F.col(households)).otherwise(F.lit(0.0))


def value_per_household_serve(value: str, households: str) -> Column:
    """V / max(h, 1) (serving form; differs from P6 at h <= 0)."""
    return F.col(value) / F.greatest(F.col(households), F.lit(1)).cast("double")


def clean_applications(raw: DataFrame) -> DataFrame:
    """P1-P6 on a raw application table; keeps every other column."""
    return (raw
            .withColumn("Anio_int", year_half_even("Anio_real"))
            .withColumn("Hogares", lenient_int("Hogares"))
            .withColumn("Valor_Num", currency("Valor_Asignado"))
            .withColumn("Aprobado", approved_flag("Estado"))
            .withColumn("Log_H", log1p_of("Hogares"))
            .withColumn("Log_V", log1p_of("Valor_Num"))
            .withColumn("VxH", value_per_household_train("Valor_Num", "Hogares")))
