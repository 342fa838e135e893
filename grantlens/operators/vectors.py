"""Cosine similarity of vector pairs and nearest vectors.

Pairs are fetched with two equi-joins on the id; similarity is computed
inside the row with ``zip_with``/``aggregate`` (JVM, no Python).  The
nearest-vector search scores every row against one query vector held as
a literal (its size is the vector dimension) and keeps the top k with a
distributed take-ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def _norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0), lambda acc, v: acc + v))


def cosine(a: Column, b: Column) -> Column:
    den = _norm(a) * _norm(b)
    return F.when(den > 0, _dot(a, b) / den)


def cosine_pairs(vectors: DataFrame, pairs: DataFrame, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """(left_id, right_id) -> cosine similarity of their vectors."""
    left = vectors.select(F.col(id_col).alias("left_id"), F.col(vec_col).alias("_a"))
    right = vectors.select(F.col(id_col).alias("right_id"), F.col(vec_col).alias("_b"))
    return (pairs.join(left, "left_id").join(right, "right_id")
            .select("left_id", "right_id", cosine(F.col("_a"), F.col("_b")).alias("cosine")))


def successor_pairs(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Each id paired with id + 1 when present (equi-join, no pair blow-up)."""
    a = vectors.select(F.col(id_col).alias("left_id"))
    b = vectors.select(F.col(id_col).alias("right_id"))
    return a.join(b, b.right_id == a.left_id + 1).select("left_id", "right_id")


def nearest_vectors(vectors: DataFrame, query: list[float], k: int = 5,
                    id_col: str = "vec_id", vec_col: str = "embedding",
                    exclude_id=None) -> DataFrame:
    """Top-k rows by cosine to ``query``; ties broken by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(id_col, cosine(F.col(vec_col), q).alias("cosine"))
    if exclude_id is not None:
        scored = scored.where(F.col(id_col) != F.lit(exclude_id))
    ordered = scored.orderBy(F.col("cosine").desc_nulls_last(), F.col(id_col)).limit(k)
    return ordered


def vector_of(vectors: DataFrame, vec_id, id_col: str = "vec_id",
              vec_col: str = "embedding") -> list[float]:
    row = vectors.where(F.col(id_col) == F.lit(vec_id)).select(vec_col).first()
    if row is None:
        raise KeyError(vec_id)
    return [float(x) for x in row[0]]
