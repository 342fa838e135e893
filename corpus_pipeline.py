"""The training-data pipeline: five operators, one after the other, over the documents.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes each stage's rows to the shared folder and reads them
again, so a lost executor repeats one stage at most.  All but the last
return the columns of ``documents``.

* quality: documents that the rules or the log-likelihood ratio reject go.
* near_duplicates: of each group of documents linked by a Jaccard similarity of 0.8 or more over
  five-word shingles the one of the smallest id stays.
* decontamination: documents that hold a test item go.
* secrets: every span found is replaced by a mark (and n_chars follows).
* tokens: the ids of each text, as counts and digests, after an exact round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grantlens.llm import bpe, decontam, jaccard, quality, secrets
from grantlens.llm.common import table
from grantlens.plans.materialize import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Five words and 0.8; op4_ngram_jaccard has its own contract.
    return jaccard.one_of_each(docs, "doc_id", "text", size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, "text", table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs, "text", "n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs, "doc_id", "text")


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("tokens", tokens),
]

#: SQL expresses neither the hashed log ratio, nor the alignment, nor BPE;
#: the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
