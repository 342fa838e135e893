"""Word vectors as a factorisation of the co-occurrence table.

Skip-gram vectors factorise the pointwise mutual information of a term and the
terms around it.  Here that table is counted in one shuffle, (term, near term,
count) with a map-side aggregate, and its positive mutual information, a sparse
symmetric matrix, is factorised by a randomised subspace iteration: the table
times a thin random block, made orthonormal, a few times over.

The block has one row per term and a few dozen columns; its rows stay
distributed.  A product is a join on the term and a sum per term; only products
of columns with columns (a square of a few dozen numbers) come to the driver.
The random start is a hash of the term, so neither the number of tasks nor the
cluster changes the result beyond the order of sums.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.plans.materialize import release, written

#: Columns beyond the size asked for, and products after the first.
SPARE, PRODUCTS = 10, 2


def cooccurrence(docs: DataFrame, tokens: str = "tokens", window: int = 5) -> DataFrame:
    """(term, near, n): how often ``near`` stands within ``window`` tokens of ``term``, both ways."""
    once = docs.groupBy(F.col(tokens).alias("tokens")).agg(F.count(F.lit(1)).alias("times"))
    at = once.where(F.size("tokens") > 1).select("tokens", "times", F.explode(F.sequence(F.lit(1), F.size("tokens") - 1)).alias("i"))
    pairs = at.select(F.get("tokens", F.col("i") - 1).alias("a"), F.explode(F.slice("tokens", F.col("i") + 1, window)).alias("b"), "times")
    one = pairs.groupBy("a", "b").agg(F.sum("times").alias("n"))
    both = one.select(F.col("a").alias("term"), F.col("b").alias("near"), "n").unionByName(
        one.select(F.col("b").alias("term"), F.col("a").alias("near"), "n"))
    return both.groupBy("term", "near").agg(F.sum("n").alias("n"))


def mutual_information(counts: DataFrame) -> DataFrame:
    """(term, near, m): the positive pointwise mutual information, zeros left out."""
    of = counts.groupBy("term").agg(F.sum("n").alias("of_term"))
    near = of.select(F.col("term").alias("near"), F.col("of_term").alias("of_near"))
    m = F.log(F.col("n") * of.agg(F.sum("of_term")).scalar() / (F.col("of_term") * F.col("of_near")))
    return counts.join(of, "term").join(near, "near").select("term", "near", m.alias("m")).where("m > 0")


def _literal(matrix: np.ndarray) -> Column:
    """A small matrix as one constant."""
    return F.from_json(F.lit(json.dumps(matrix.tolist())), "array<array<double>>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def product(matrix: DataFrame, block: DataFrame, width: int) -> DataFrame:
    """(term, v): the matrix times the block."""
    rows = matrix.join(block.select(F.col("term").alias("near"), "v"), "near")
    sums = rows.groupBy("term").agg(*(F.sum(F.col("m") * F.get("v", F.lit(j))).alias(f"_{j}") for j in range(width)))
    return written(sums.select("term", F.array(*(F.col(f"_{j}") for j in range(width))).alias("v")), "vector-block")


def columns_by_columns(both: DataFrame, width: int) -> np.ndarray:
    """The sum over the rows (u, v) of the products of every entry of u with every entry of v."""
    left = both.select(F.posexplode("u").alias("i", "a"), "v")
    cells = left.select("i", "a", F.posexplode("v").alias("j", "b")).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s")).collect()
    out = np.zeros((width, width))
    for r in cells:  # width * width numbers
        out[r["i"], r["j"]] = r["s"]
    return out


def turned(block: DataFrame, turn: np.ndarray) -> DataFrame:
    """The block times a small matrix."""
    return block.select("term", F.transform(_literal(turn.T), lambda row: _dot(F.col("v"), row)).alias("v"))


def orthonormal(block: DataFrame, width: int) -> tuple[DataFrame, int]:
    """A block of orthonormal columns that span the same space, and how many there are."""
    size, way = np.linalg.eigh(columns_by_columns(block.select(F.col("v").alias("u"), "v"), width))
    kept = size > 1e-10 * max(size.max(), 1e-300)
    return turned(block, way[:, kept] / np.sqrt(size[kept])), int(kept.sum())


def word_vectors(docs: DataFrame, size: int = 50, window: int = 5, seed: int = 42) -> DataFrame:
    """(term, vector) of every token of (tokens); a term that stands alone everywhere has a vector of zeros."""
    counts = written(cooccurrence(docs, window=window), "cooccurrence")
    matrix = written(mutual_information(counts), "mutual-information")
    width = size + SPARE
    start = matrix.select("term").distinct().select("term", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.when(
        F.xxhash64(F.col("term"), j, F.lit(seed)) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))).alias("v"))
    block = product(matrix, start, width)
    for _ in range(PRODUCTS):
        base, width = orthonormal(block, width)
        base = written(base, "vector-block")
        release(block)
        if not width:
            break
        block = product(matrix, base, width)
    terms = docs.select(F.explode_outer("tokens").alias("term")).where(F.col("term").isNotNull()).distinct()
    if width:
        inner = columns_by_columns(base.join(block.withColumnRenamed("v", "w"), "term").select(F.col("v").alias("u"), F.col("w").alias("v")), width)
        value, way = np.linalg.eigh((inner + inner.T) / 2)
        best = np.argsort(-np.abs(value), kind="stable")[:size]
        turn = way[:, best] * np.sqrt(np.abs(value[best]))
        # A column's sign is free: the sum over the terms of hash sign times entry is made positive.
        sign = F.when(F.xxhash64(F.col("term"), F.lit(seed)) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        sums = {r["j"]: r["s"] for r in base.select(sign.alias("h"), F.posexplode("v").alias("j", "x")).groupBy("j").agg(F.sum(F.col("h") * F.col("x")).alias("s")).collect()}
        turn = turn * np.where(np.array([sums.get(j, 0.0) for j in range(width)]) @ turn < 0, -1.0, 1.0)
        turn = np.pad(turn, ((0, 0), (0, size - turn.shape[1])))
        found = turned(base, turn).withColumnRenamed("v", "vector")
        terms = terms.join(found, "term", "left")
    else:
        terms = terms.withColumn("vector", F.lit(None).cast("array<double>"))
    return written(terms.select("term", F.coalesce("vector", F.array_repeat(F.lit(0.0), size)).alias("vector")), "word-vectors")
