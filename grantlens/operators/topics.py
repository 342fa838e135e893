"""Topics of documents by expectation maximisation over a table keyed by term.

A topic model's parameters are one row per term with a share per topic.  One
step joins them to the documents' terms, finds each document's topic mixture
inside the document (numpy, whole batches of documents at once), and sums the
expected counts per term and topic after a per-batch aggregate.  Neither the
vocabulary nor the topics are ever on the driver; of each step only the log
likelihood comes there.  Documents of the same terms are one row with a weight.

The model is latent Dirichlet allocation fitted to its posterior mode, with
``ALPHA`` and ``ETA`` as the added counts of topics per document and of terms
per topic.  The start is a hash of term and topic, so the result does not
depend on the cluster beyond the order of sums.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.operators.sparse_models import weighted_documents
from grantlens.plans.materialize import release, written

ALPHA, ETA = 0.1, 0.01
#: Steps at most, the relative gain from which on they stop, and rounds inside a document.
MOST_STEPS, LEAST_GAIN, ROUNDS = 30, 3e-4, 15


@dataclass
class Topics:
    """``terms`` (term, share per topic), ``documents`` (gid, weight, mix per topic), log likelihood per token."""
    k: int
    terms: DataFrame
    documents: DataFrame
    log_likelihood: float


def _mixtures(k: int, alpha: float, rounds: int):
    """Arrow function: rows (gid, weight, terms [(term, tf, share)]) to expected counts per term, or to mixtures."""
    def solve(batch: pa.RecordBatch):
        column = batch.column("terms")
        size = np.diff(column.offsets.to_numpy())
        flat = column.flatten()
        tf = flat.field("tf").to_numpy().astype(float)
        share = flat.field("share").flatten().to_numpy().reshape(-1, k)
        doc = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size  # no document is without terms here
        mix = np.full((len(size), k), 1.0 / k)
        for _ in range(rounds):
            each = share * mix[doc]
            total = each.sum(axis=1, keepdims=True)
            each = each / np.maximum(total, 1e-300) * tf[:, None]
            mix = np.add.reduceat(each, first, axis=0) + alpha
            mix /= mix.sum(axis=1, keepdims=True)
        each = share * mix[doc]
        total = each.sum(axis=1)
        return flat, doc, tf, each / np.maximum(total, 1e-300)[:, None], np.log(np.maximum(total, 1e-300)), mix

    def lists(values: np.ndarray):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * k, pa.int32()), pa.array(values.ravel()))

    def counts(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, doc, tf, each, logs, _ = solve(batch)
            weight = batch.column("weight").to_numpy()[doc] * tf
            codes = flat.field("term").dictionary_encode()
            sums = np.zeros((len(codes.dictionary), k))
            np.add.at(sums, codes.indices.to_numpy(), each * weight[:, None])
            # The row without a term has the batch's log likelihood.
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([codes.dictionary, pa.array([None], pa.string())]), lists(np.vstack([sums, np.zeros((1, k))])),
                 pa.array([*np.zeros(len(sums)), float((logs * weight).sum())])], ["term", "c", "l"])

    def mixtures(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("gid"), batch.column("weight"), lists(solve(batch)[-1])], ["gid", "weight", "mix"])

    return counts, mixtures


def fit_topics(docs: DataFrame, k: int = 7, terms: str = "tokens", seed: int = 42, alpha: float = ALPHA, eta: float = ETA,
               most_steps: int = MOST_STEPS) -> Topics:
    """Fit ``k`` topics to documents (an array column of terms); documents without terms take no part."""
    documents = weighted_documents(docs, (), terms).where(F.size("tfs") > 0)
    held = written(documents.select("gid", "weight", F.explode("tfs").alias("_t")).select("gid", "weight", "_t.term", "_t.tf"), "topic-terms")
    tokens = float(held.agg(F.sum(F.col("tf") * F.col("weight"))).first()[0] or 0.0)
    counts, mixtures = _mixtures(k, alpha, ROUNDS)
    topic = F.sequence(F.lit(0), F.lit(k - 1))
    # Shares of an exponential draw: a uniform number from the hash, its negative logarithm.
    draw = F.transform(topic, lambda j: -F.log((F.pmod(F.xxhash64(F.col("term"), j, F.lit(seed)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)))
    table = written(held.select("term").distinct().select("term", draw.alias("c"), F.lit(0.0).alias("l")), "topics")

    def shares(table: DataFrame) -> DataFrame:
        """(term, share): every topic's share of the term, from the counts."""
        real = table.where("term is not null")
        terms, mass = real.agg(F.count(F.lit(1))).scalar(), real.agg(F.array(*(F.sum(F.get("c", F.lit(j))) for j in range(k)))).scalar()
        share = F.zip_with("c", "all", lambda c, n: (c + F.lit(eta)) / (n + F.col("v") * F.lit(eta)))
        return real.select("term", "c", terms.alias("v"), mass.alias("all")).select("term", share.alias("share"))

    def gathered(table: DataFrame) -> DataFrame:
        return (held.join(shares(table), "term").groupBy("gid", "weight")
                .agg(F.collect_list(F.struct("term", "tf", "share")).alias("terms")))

    value = None
    for _ in range(most_steps if tokens else 0):
        found = gathered(table).mapInArrow(counts, "term string, c array<double>, l double")
        new = written(found.groupBy("term").agg(F.array(*(F.sum(F.get("c", F.lit(j))) for j in range(k))).alias("c"), F.sum("l").alias("l")), "topics")
        release(table)
        table = new
        last, value = value, float(table.where("term is null").first()["l"]) / tokens
        if last is not None and value - last < LEAST_GAIN * abs(last):
            break
    mixed = written(gathered(table).mapInArrow(mixtures, "gid long, weight long, mix array<double>"), "topic-mixtures")
    return Topics(k, written(shares(table), "topic-shares"), mixed, value if value is not None else 0.0)


def topic_terms(topics: Topics, n_terms: int = 5) -> DataFrame:
    """(topic, rank, weight, term, log_perplexity): the top terms of every topic (ties by term), by one ordered take each."""
    parts = [topics.terms.select(F.lit(j).alias("topic"), F.get("share", F.lit(j)).alias("weight"), "term")
             .orderBy(F.col("weight").desc(), "term").limit(n_terms) for j in range(topics.k)]
    rows = reduce(DataFrame.unionByName, parts)
    per = rows.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("less"), "term"))).alias("t"))  # n_terms entries
    return per.select("topic", F.posexplode("t").alias("rank", "_t")).select(
        "topic", "rank", (-F.col("_t.less")).alias("weight"), "_t.term", F.lit(-topics.log_likelihood).alias("log_perplexity"))


def topic_sizes(topics: Topics) -> DataFrame:
    """(topic, n_docs): documents per topic with the largest share (the first of ties)."""
    best = F.array_position("mix", F.array_max("mix")) - 1
    return topics.documents.groupBy(best.cast("int").alias("topic")).agg(F.sum("weight").alias("n_docs"))
