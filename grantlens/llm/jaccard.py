"""Operator 4: n-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set is its different word shingles.  Two documents link when
the sets' Jaccard similarity reaches the threshold, so each set must hold at
least T of the other's shingles.

1. Documents of equal sets are one class; its smallest id stands for it.
2. Shingles have one global order: frequent ones (counted over all documents,
   in runs) last, otherwise by hash.  By the pigeonhole principle two linked
   sets share at least c shingles among the first n - T + c of each, so these
   prefixes are an inverted index that misses no link.  A class whose prefix
   shares fewer than c shingles with the other classes can link with nothing
   and is done; on real corpora few classes remain, and only their sets are
   looked at.
3. The remaining classes are dealt into blocks, near copies into the same one
   (by their most frequent shared shingle); a class is a query to each block in which its prefix
   meets c shingles.  A block is an inverted index in memory.  A query's
   short lists are merged, its long lists probed by binary search for those
   candidates that the short lists leave possible (or merged too, where that
   is less work); what reaches the required overlap links.  All links are
   counted, weighted by the classes' sizes; a block returns the counts and a
   forest of links, not all pairs.
4. The forests' connected components are the classes' components.

Blocks and their queries have a bounded number of shingles, however large a
group of copies is.  What stays quadratic, divided by the block size, is the
number of queries of one group of different texts that are near copies or
almost; no pair is skipped there, because each of their links is counted.

Defined cases: a null text, or one without words, has an empty set, links
with nothing and is its own component; shorter texts than a shingle have the
whole word sequence as their one shingle; repeated rows are each returned, and
count as copies; different texts under one id are one node of the graph, whose
rows are each returned with their own set; a null id links with nothing
(component null); an empty table gives an empty result; extra columns are not
read.  Shingles are compared by 64-bit hashes,
sets for equality by 128-bit digests.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grantlens.llm.common import LOWER, RangeHash, map_arrow, table, text_chunks, word_spans, workers_import
from grantlens.llm.decontam import Members
from grantlens.operators.components import connected_components
from grantlens.plans.materialize import release, written
from grantlens.session import ensure_parallelism

SHINGLE = 4
PERCENT = 85
#: Part of the required overlap that prefixes are made to share: one in so many shingles.
SHARE = 32
#: From so many documents on a shingle counts as frequent; so many frequent ones are ordered last at most
#: (the order decides only how soon unlike documents are told apart, never the result).
FREQUENT, MOST_FREQUENT = 8, 200_000
#: Shingles counted together in a task before those met once are let go.
RUN = 1 << 22
#: Shingles of a block, and of the queries that meet it in one task.
BLOCK, QUERIES = 1 << 19, 1 << 21
#: Up to so many ids are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Steps of a merge that one binary probe costs.
PROBE = 25
_HASH = RangeHash(41)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n shares at least with any set that it links with."""
    return -(-percent * n // 100)


def share(n: int) -> int:
    return n // SHARE + 1


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return min(n, n - least_overlap(n, percent) + share(n))


def shared_least(n, percent: int = PERCENT):
    """Column: shingles that linked sets share in their prefixes, for a set of n."""
    return F.floor(F.ceil(n * F.lit(percent) / 100) / SHARE) + 1


def sets_of(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    data = LOWER[data]
    start, end, first = word_spans(data, off)
    prefix = _HASH.prefix(_HASH.words(data, start, end))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a < size:
            at, stop = (np.array([a]), np.array([b])) if b > a else (np.zeros(0, int),) * 2
        else:
            at = np.arange(a, b - size + 1)
            stop = at + size
        out.append(np.unique(_HASH.ranges(prefix, at, stop)))
    return out


def digests_of(sets: list[np.ndarray]) -> list[np.ndarray]:
    return [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """The most frequent shingles, the rarest of them first."""
    def run(batches):
        held, count = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            some = n > 1
            return pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(n[some])], names=["s", "n"])

        for batch in batches:
            for _, _, data, off in text_chunks(batch.column(1)):
                sets = sets_of(data, off, size)
                held += sets
                count += sum(map(len, sets))
                if count >= RUN:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    rows = (map_arrow(docs, run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
            .orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).collect())
    return np.array([r["s"] for r in reversed(rows)], np.int64).view(np.uint64)


def prefixes(docs: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(doc, n, d1, d2, prefix, late): set size, set digest, the first shingles in the global order, and how many of
    them, at the end, are frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        late = Members(shared.value)
        place = np.argsort(shared.value)  # where each of the sorted values stands in the order
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column(1)):
                sets = sets_of(data, off, size)
                digests = digests_of(sets)
                first, often = [], []
                for s in sets:
                    p = prefix_length(len(s), percent)
                    at, k = late.find(s)
                    rest = np.delete(s, at)
                    often.append(max(0, p - len(rest)))
                    if len(rest) < p:
                        rest = np.concatenate((rest, s[at[np.argsort(place[k], kind="stable")][:p - len(rest)]]))
                    first.append(rest[:p].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int32()),
                     pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                     pa.array(first, pa.list_(pa.int64())), pa.array(often, pa.int32())], names=["doc", "n", "d1", "d2", "prefix", "late"])

    return map_arrow(docs, run, "doc long, n int, d1 long, d2 long, prefix array<long>, late int")


def enough(postings: DataFrame, percent: int) -> DataFrame:
    """The postings (s, node, n) of the nodes that have as many as linked sets share."""
    kept = (postings.groupBy("node", "n").agg(F.collect_list("s").alias("shingles"))
            .where(F.size("shingles") >= shared_least(F.col("n"), percent)))
    return kept.select(F.explode("shingles").alias("s"), "node", "n")


def first_met(classes: DataFrame, percent: int) -> DataFrame:
    """(s, node, n): the prefix shingles that other classes may hold, of classes with enough of them.

    Shingles that are not frequent are shuffled once and counted where they arrive, as few hold each; frequent ones
    are held by others anyway and are not counted here.
    """
    rare = F.size("prefix") - F.col("late")
    few = classes.select(F.explode(F.slice("prefix", F.lit(1), rare)).alias("s"), "node", "n")
    few = few.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("s"))).where("k > 1").drop("k")
    often = classes.where("late > 0").select(F.explode(F.slice("prefix", rare + 1, F.col("late"))).alias("s"), "node", "n")
    return enough(few.unionByName(often), percent)


def possible(postings: DataFrame, percent: int) -> DataFrame:
    """(s, k, node, n) of the classes whose shingles meet enough shingles of others.

    Only met shingles are kept; k is the number of classes that hold one.
    """
    met = postings.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return enough(postings.join(met.select("s"), "s"), percent).join(met, "s")


def link_block(index: pa.Table, queries: pa.Table, percent: int) -> pa.Table:
    """Rows (a, b, null): a forest of the links between queries and the block's classes; rows (a, null, n): how many
    documents the links found here give to each document of class a."""
    nodes, copies = index["node"].to_numpy(), index["copies"].to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in index["shingles"]]
    sizes = np.array([len(s) for s in sets])
    own = np.repeat(np.arange(len(sets)), sizes)
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.lexsort((own, tokens))
    own, (values, begin) = own[order], np.unique(tokens[order], return_index=True)
    stop = np.append(begin[1:], len(own))
    # One sorted array of (list, class) for the binary probes.
    probe = np.repeat(np.arange(len(values)), stop - begin) * len(sets) + own
    every, asks = np.unique(np.concatenate([nodes, queries["node"].to_numpy()])), queries["node"].to_numpy()
    label = np.arange(len(every))  # the component of each class here
    of_index, of_query = np.searchsorted(every, nodes), np.searchsorted(every, asks)
    gained = np.zeros(len(every), np.int64)

    links = []
    for x, here, home, weight, raw in zip(asks.tolist(), of_query.tolist(), queries["home"].to_pylist(), queries["copies"].to_pylist(), queries["shingles"]):
        s = np.frombuffer(raw.as_py(), np.uint64)
        n = len(s)
        k = np.searchsorted(values, s)
        k[k == len(values)] = 0
        k = k[values[k] == s]
        least = least_overlap(n, percent)
        if len(k) < least:
            continue
        length = stop[k] - begin[k]
        k = k[np.argsort(length, kind="stable")]
        # DivideSkip: this many of the longest lists are probed instead of merged.
        probed = min(least - 1, int(least / (0.0085 * math.log2(max(2, length.max())) + 1)))
        short, long = k[:len(k) - probed], k[len(k) - probed:]
        merged = np.concatenate([own[begin[i]:stop[i]] for i in short]) if len(short) else np.zeros(0, np.int64)
        candidate, overlap = np.unique(merged, return_counts=True)
        good = (overlap >= least - probed) & (sizes[candidate] * 100 >= n * percent) & (n * 100 >= sizes[candidate] * percent)
        if home:  # within its own block a pair is looked at once
            good &= nodes[candidate] < x
        candidate, overlap = candidate[good], overlap[good]
        if not len(candidate):
            continue
        if len(candidate) * len(long) * PROBE > (stop[long] - begin[long]).sum():
            overlap = overlap + np.bincount(np.concatenate([own[begin[i]:stop[i]] for i in long]), minlength=len(sets))[candidate]
        elif len(long):
            asked = (long[None, :] * len(sets) + candidate[:, None]).ravel()
            hit = np.searchsorted(probe, asked)
            hit[hit == len(probe)] = 0
            overlap = overlap + (probe[hit] == asked).reshape(len(candidate), -1).sum(axis=1)
        found = candidate[100 * overlap >= percent * (n + sizes[candidate] - overlap)]
        if not len(found):
            continue
        gained[here] += copies[found].sum()
        gained[of_index[found]] += weight
        reached, one = np.unique(label[of_index[found]], return_index=True)
        for c, y in zip(reached.tolist(), nodes[found[one]].tolist()):
            if c != label[here]:
                label[label == c] = label[here]
                links.append((x, y))
    some = np.flatnonzero(gained)
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array([*a, *every[some].tolist()], pa.int64()), "b": pa.array([*b, *[None] * len(some)], pa.int64()),
                     "n": pa.array([*[None] * len(a), *gained[some].tolist()], pa.int64())})


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, n) as ``link_block`` of the classes (node, doc, copies, d1, d2, n, prefix, late) of (doc, text)."""
    first = written(first_met(classes, percent), "jaccard-left")
    left = written(possible(first, percent), "jaccard-left")  # partners that fell out no longer count
    release(first)
    # Copies agree on the shingle that most classes hold, so they come into the same block.
    of_node = left.groupBy("node", "n").agg(F.max(F.struct("k", "s"))["s"].alias("home"))
    # Blocks: a shingle whose classes fill a block has blocks of its own, the others share.
    totals = of_node.agg(F.count(F.lit(1)), F.sum("n")).first()
    shared = max(1, -(-(totals[1] or 0) // BLOCK))
    weight = of_node.groupBy("home").agg(F.sum("n").alias("w"))
    placed = of_node.join(weight, "home").select("node", F.when(F.col("w") < BLOCK, F.pmod("home", F.lit(shared))).otherwise(
        F.xxhash64("home", F.pmod(F.xxhash64("node"), F.ceil(F.col("w") / BLOCK)))).alias("block"))
    placed = written(placed.join(classes.select("node", "doc", "copies", "d1", "d2"), "node"), "jaccard-placed")

    def run(batches):
        for batch in batches:
            for _, _, data, off in text_chunks(batch.column(1)):
                sets = sets_of(data, off, size)
                digests = digests_of(sets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=["d1", "d2", "shingles"])

    ids = placed.select("doc").distinct()
    rows = docs.select("doc", "text").join(F.broadcast(ids) if totals[0] <= BROADCAST_IDS else ids, "doc", "left_semi")
    sets = map_arrow(rows, run, "d1 long, d2 long, shingles binary").dropDuplicates(["d1", "d2"])
    sets = written(sets.join(placed, ["d1", "d2"]).select("node", "copies", "block", "shingles"), "jaccard-sets")

    tokens = left.join(placed.select("node", "block"), "node")
    of_block = tokens.select("s", F.col("block").alias("other")).distinct()
    # Between two blocks the classes of the one with the larger number ask.
    routes = (tokens.join(of_block, "s").where("other <= block").groupBy("node", "n", "block", "other").agg(F.count(F.lit(1)).alias("k"))
              .where(F.col("k") >= shared_least(F.col("n"), percent))
              .select("node", F.col("n").alias("size"), F.col("other").alias("target"), (F.col("other") == F.col("block")).alias("home")))
    parts = routes.groupBy("target").agg(F.ceil(F.sum("size") / QUERIES).cast("int").alias("parts"))
    index = (sets.withColumnRenamed("block", "target").join(parts, "target")
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("target", "part", "node", "copies", "shingles"))
    queries = (routes.join(parts, "target").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
               .join(docs.sparkSession.read.parquet(sets.written_path).drop("block"), "node").select("target", "part", "node", "copies", "home", "shingles"))
    workers_import(docs.sparkSession)
    return index.groupBy("target", "part").cogroup(queries.groupBy("target", "part")).applyInArrow(
        lambda a, b: link_block(a, b, percent), "a long, b long, n long")


def jaccard_components(df: DataFrame, key: str, text: str, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, class_id, component_id, n_links) of every document.

    class_id is the least id of an equal set, n_links the number of other documents that the document links with.
    """
    docs = ensure_parallelism(df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")))
    signed = written(prefixes(docs, size, percent, frequent_shingles(docs, size)), "jaccard-prefixes")
    real = signed.where("n > 0 and doc is not null")
    sets = real.groupBy("d1", "d2").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"))
    # A class has a number of its own, as two texts may share an id; the numbers follow the written files.
    sets = written(sets, "jaccard-classes").withColumn("node", F.monotonically_increasing_id())
    prefix = signed.select("doc", "d1", "d2", "n", "prefix", "late").dropDuplicates(["d1", "d2", "doc"])
    classes = prefix.join(sets, ["d1", "d2", "doc"])
    found = written(links(docs.where(F.col("doc").isNotNull()), classes, size, percent), "jaccard-links")
    # Different texts of one id hang together.
    several = (real.join(sets.select("d1", "d2", "node"), ["d1", "d2"]).groupBy("doc").agg(F.min("node").alias("a"), F.collect_set("node").alias("all"))
               .where(F.size("all") > 1).select("a", F.explode("all").alias("b")))
    parts = connected_components(found.where("b is not null").select("a", "b").unionByName(several), "a", "b")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    of_set = sets.join(parts, "node", "left").join(counts, "node", "left")
    least = of_set.where("component is not null").groupBy("component").agg(F.min("doc").alias("least"))
    of_set = of_set.join(least, "component", "left").select(
        "d1", "d2", F.col("doc").alias("class"), F.coalesce("least", "doc").alias("component"),
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    own = (F.col("n") > 0) & F.col("doc").isNotNull()
    return signed.select("doc", "n", "d1", "d2").join(of_set, ["d1", "d2"], "left").select(
        F.col("doc").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(own, F.col("class")).otherwise(F.col("doc")).alias("class_id"),
        F.when(own, F.col("component")).otherwise(F.col("doc")).alias("component_id"),
        F.when(own, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def one_of_each(df: DataFrame, key: str, text: str, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` (all columns) that stay when one document of each group does: that of the smallest id.

    Of repeated rows one stays, of different texts under that id each; rows without an id link with nothing and stay.
    """
    groups = jaccard_components(df, key, text, size, percent)
    first = groups.where(F.col("component_id") == F.col(key)).select(F.col("component_id").alias("__first")).distinct()
    here = F.col(f"`{key}`")
    kept = df.where(here.isNotNull()).join(first, here.cast("long") == F.col("__first"), "left_semi").dropDuplicates([key, text])
    return kept.unionByName(df.where(here.isNull()))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and n_links of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"), "doc_id", "text").select(
        "doc_id", "n_shingles", "component_id", "class_id", "n_links")
