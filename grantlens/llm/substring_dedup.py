"""Operator 1: duplicate word spans by Relative Lempel-Ziv parsing against the indexed corpus.

The reference is the corpus itself, in the order of document and position;
a word window that starts earlier is a phrase to copy from.  The reference
is indexed by anchors: in every window of ``window`` words the leftmost
least hash of its runs of ``GRAM`` words.  Equal windows choose the same
anchor, so an index block (one hash range of anchors) holds every place
that a factor with this anchor can be copied from, and a document meets all
the index blocks that hold one of its anchors.

1. Anchors that occur once in the corpus begin no factor and go.
2. The context of an anchor is all words that its windows can reach.  Where
   the whole context has occurred earlier, it is a sufficiently long factor
   and a duplicate span, found with one row instead of one per window.
3. Where it has not, but the anchor occurs in another context too, a factor
   may end inside the context: at these factor boundaries each window of the
   anchor is looked up by itself, among the boundary windows of the corpus.
   (The first place of each different context holds every window of it, so
   the other places need no lookup.)
4. The spans of a document are merged from left to right into factors, each
   with the place it copies; the words they cover are removed.

Rows per text are one per anchor (about one in eight words) and, at
boundaries, one per window; each kind is shuffled once, after a count that is
pre-aggregated in the map tasks.  Anchors or windows of a hot passage are
pre-aggregated and joined to their first place, so they are split like any
skewed join.  Contexts are compared by an anchor's hash and an independent
hash of all their words (64 bits each), windows by hashes of 64 and 31 bits.

Defined cases: a null or empty text has no words; texts shorter than the
window keep all words; a null doc_id takes no part, its words are kept;
repeated rows (same id) are one document: neither is earlier than the other;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantlens.llm.common import RangeHash, map_arrow, mix, record_batch, table, text_chunks, within, word_spans
from grantlens.plans.materialize import written
from grantlens.session import ensure_parallelism

WINDOW = 20
#: Words of the runs that serve as anchors; a window holds WINDOW - GRAM + 1 of them.
GRAM = 5
#: Rows of an anchor or window that are compared inside one task.
HOT = 100_000
_A, _B = RangeHash(11), RangeHash(12)


def leftmost_min(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the leftmost least value of each run of ``size`` values."""
    at, width = np.arange(len(values)), 1
    while width < size and len(at):
        step = min(width, size - width)
        a, b = at[:-step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        width += step
    return at


class Words:
    """The words of a run of texts, with their hashes and the anchor of every window."""

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int):
        start, end, self.first = word_spans(data, off)
        self.window = window
        self.of_text = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.a = _A.prefix(_A.words(data, start, end))
        self.b = _B.prefix(_B.words(data, start, end))
        n = len(start)
        at = np.arange(max(0, n - GRAM + 1))
        self.grams = _A.ranges(self.a, at, at + GRAM)
        self.windows = within(self.first, window)
        self.anchor = leftmost_min(self.grams, window - GRAM + 1)[self.windows]

    def contexts(self):
        """Place, anchor hash and context hash of every anchor."""
        q = self.anchor[np.flatnonzero(np.diff(self.anchor, prepend=-1))]
        text = self.of_text[q]
        left = np.maximum(q - (self.window - GRAM), self.first[text])
        right = np.minimum(q + self.window, self.first[text + 1])
        e = mix(_B.ranges(self.b, left, right) ^ ((q - left).astype(np.uint64) << np.uint64(32)))
        return q, text, self.grams[q], e


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def never_null(columns: str) -> T.StructType:
    """Columns without nulls, so that no join adds a filter and both uses of the rows share one shuffle."""
    return T.StructType([T.StructField(f.name, f.dataType, False) for f in T.StructType.fromDDL(columns)])


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc, q, h, e): place, hash and context of every anchor."""
    schema = pa.schema([("doc", pa.int64()), ("q", pa.int32()), ("h", pa.int64()), ("e", pa.int64())])

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, off in text_chunks(batch.column(1)):
                w = Words(data, off, window)
                q, text, h, e = w.contexts()
                yield record_batch(schema, ids[i:j][text], q - w.first[text], signed(h), signed(e))

    return map_arrow(docs, run, never_null("doc long, q int, h long, e long"))


def boundary_windows(docs: DataFrame, window: int) -> DataFrame:
    """From (doc, text, qs) to (w1, w2, doc, p): the windows whose anchor is among qs."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int32()), ("doc", pa.int64()), ("p", pa.int32())])

    def run(batches):
        for batch in batches:
            ids, places = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for i, j, data, off in text_chunks(batch.column(1)):
                w = Words(data, off, window)
                wanted = np.zeros(len(w.of_text) + 1, bool)
                part = places.slice(i, j - i)
                lengths = np.array([len(x) for x in part])
                wanted[part.flatten().to_numpy() + np.repeat(w.first[:-1], lengths)] = True
                p = w.windows[wanted[w.anchor]]
                text = w.of_text[p]
                yield record_batch(schema, signed(_A.ranges(w.a, p, p + window)), (_B.ranges(w.b, p, p + window) >> np.uint64(33)).astype(np.int32),
                                   ids[i:j][text], p - w.first[text])

    return map_arrow(docs, run, never_null("w1 long, w2 int, doc long, p int"))


def met_again(rows: DataFrame, part: str, keys: list[str], place: str) -> DataFrame:
    """The rows whose ``part`` occurs again, with the first place of equal keys (f) and the number of different keys
    of the part (kinds).

    Rows are shuffled by the part once and compared inside a task; parts of more than HOT rows are pre-aggregated
    and joined instead, which Spark can split.
    """
    count = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(count, part)
    here = F.struct("doc", place)
    first = F.min(here).over(W.partitionBy(*keys))
    usual = met.where(F.col("n") <= HOT).withColumn("f", first)
    usual = usual.withColumn("kinds", F.sum((here == F.col("f")).cast("long")).over(W.partitionBy(part)))
    hot = met.where(F.col("n") > HOT)
    firsts = hot.groupBy(*keys).agg(F.min(here).alias("f"))
    kinds = firsts.groupBy(part).agg(F.count(F.lit(1)).alias("kinds"))
    hot = hot.join(firsts, keys).join(kinds, part)
    return usual.unionByName(hot.select(*usual.columns))


def duplicate_places(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, at, whole, ref_doc, ref_at) of (doc, text): contexts (whole) and windows that occur earlier."""
    found = met_again(anchors(docs, window), "h", ["h", "e"], "q")
    # Contexts that occur earlier, and the first places of the contexts of anchors with several contexts.
    copy = F.struct("doc", "q") != F.col("f")
    found = written(found.where(copy | (F.col("kinds") > 1)).select(
        "doc", F.col("q").alias("at"), copy.alias("copy"), F.col("f.doc").alias("ref_doc"), F.col("f.q").alias("ref_at")), "anchors")
    whole = found.where("copy").select("doc", "at", F.lit(True).alias("whole"), "ref_doc", "ref_at")
    ends = found.where("not copy").groupBy("doc").agg(F.collect_set("at").alias("qs"))
    windows = met_again(boundary_windows(docs.join(ends, "doc"), window), "w1", ["w1", "w2"], "p")
    partial = windows.where(F.struct("doc", "p") != F.col("f")).select(
        "doc", F.col("p").alias("at"), F.lit(False).alias("whole"), F.col("f.doc").alias("ref_doc"), F.col("f.p").alias("ref_at"))
    return whole.unionByName(partial)


def factors(spans: list[tuple], n: int, window: int) -> list[tuple[int, int, int, int]]:
    """Merge the places of a text of n words into factors (start, end, ref_doc, ref_start), from left to right."""
    reach = window - GRAM
    placed = []
    for at, whole, ref_doc, ref_at in spans:
        start = max(0, at - reach) if whole else at
        placed.append((start, min(n, at + window), ref_doc, ref_at - (at - start)))
    out: list[tuple[int, int, int, int]] = []
    for start, end, ref_doc, ref_start in sorted(placed):
        if out:
            a, b, doc, ref = out[-1]
            if doc == ref_doc and ref - a == ref_start - start and start <= b:
                out[-1] = (a, max(b, end), doc, ref)
                continue
            if end <= b:
                continue
        out.append((start, end, ref_doc, ref_start))
    return out


def remove_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept, factors) of every document; kept is the rest, joined by blanks."""
    docs = ensure_parallelism(df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")))
    # The same filtered frame meets the boundaries and the spans, so its texts are shuffled once.
    with_id, without = docs.where(F.col("doc").isNotNull()), docs.where(F.col("doc").isNull())
    spans = (duplicate_places(with_id, window)
             .groupBy("doc").agg(F.collect_set(F.struct("at", "whole", "ref_doc", "ref_at")).alias("spans")))  # rows may repeat an id
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
                        ("factors", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                                                        ("ref_doc", pa.int64()), ("ref_start", pa.int32())])))])

    def run(batches):
        names = ("start", "end", "ref_doc", "ref_start")
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column(1)):
                raw, rows = data.tobytes(), []
                part = batch.slice(i, j - i)
                for doc, a, b, places in zip(part.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), part.column(2)):
                    words = raw[a:b].split()  # bytes.split cuts at the same six ASCII characters
                    n, found = len(words), []
                    if places.is_valid:
                        found = factors([tuple(x.values()) for x in places.as_py()], n, window)
                        keep = np.ones(n, bool)
                        for f in found:
                            keep[f[0]:f[1]] = False
                        words = list(compress(words, keep))
                    rows.append((doc, n, n - len(words), b" ".join(words).decode(), [dict(zip(names, f)) for f in found]))
                yield record_batch(schema, *zip(*rows))

    rows = with_id.join(spans, "doc", "left")
    rows = rows.unionByName(without.select("doc", "text", F.lit(None).cast(rows.schema["spans"].dataType).alias("spans")))
    out = map_arrow(rows, run, "doc long, n_words long, n_removed long, kept string, "
                    "factors array<struct<start:int,end:int,ref_doc:long,ref_start:int>>")
    return out.withColumnRenamed("doc", key)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    out = remove_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", WINDOW)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def kept_digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()
