"""Operator 11: what every order of a set of filters removes, from sorted posting lists.

Each filter has, per part and per id range, the sorted list of the documents
that fail it; a class of documents (good, toxic) is such a list too.  The
audit never looks at a document again: inside a range it unites the lists of
every set of filters by galloping merges (doubling steps over the longer list,
a binary search inside the last step), takes each filter's list less each
union, and intersects what is left with the classes.  Ranges do not overlap,
so their sizes are summed, and the sizes of all 2**k unions and k*2**(k-1)
differences answer all k! orders at once:

* kept after some filters = documents - union,
* removed by a filter after some others = its list less their union,
* redundant = its list - removed, unique = its list less all others' union,
* Shapley sum = the differences, each weighted by the orders that meet it.

On Spark: the texts are read once, and one narrow row per document is written
to the shared folder.  Copies are found by the digest of the text: the least
id per digest is pre-aggregated on the map side, and the join back is on rows
of a few bytes, which AQE may split.  Rows are then range-partitioned and
sorted by part and id, so a hot part is cut into many ranges, and a posting
row never spans more than ``BLOCK`` documents.

Defined cases: a null text counts as empty and a null part as the empty
string; a null id neither is a smaller id nor has one, so such a row never
fails by being a copy, and it has no label; rows that repeat an id are
separate documents, and only smaller ids make copies; an id with several
labels has a class if any of them says so; an empty table gives no row;
columns other than key, text and part are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantlens.llm.common import flat_text, keyed_schema, map_arrow, table
from grantlens.plans.materialize import written
from grantlens.session import ensure_parallelism

#: The five text filters, in the order of the bits of a row's mask.
FILTERS = ("A", "B", "C", "D", "E")
CLASSES = ("good", "toxic")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
#: Documents of one posting row.
BLOCK = 1 << 16
#: Ids looked up between two gallops.
STRIDE = 256
#: Texts longer than this are counted word by word instead of being split at once.
LONG_TEXT = 1 << 22

_SYMBOL = re.compile(rb"[#$%&*|]")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CAPITALS = bytes(range(65, 91))
_CONTINUATION = bytes(range(0x80, 0xC0))


def text_mask(data: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    if len(data) > LONG_TEXT:
        n, seen = 0, set()
        for m in _WORD.finditer(data):
            n += 1
            seen.add(m[0])
        distinct = len(seen)
    else:
        words = data.split()  # of bytes: exactly the six ASCII separators
        n, distinct = len(words), len(set(words))
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    points = len(data.translate(None, _CONTINUATION))
    return ((n < LEAST_WORDS) | (100 * distinct < LEAST_DISTINCT * n) << 1
            | (100 * capitals > MOST_CAPITALS * points) << 2 | (_SYMBOL.search(data) is not None) << 3)


def _measured(batches):
    for batch in batches:
        data, off = flat_text(batch.column(2))
        raw, masks, digests = data.tobytes(), [], []
        for a, b in itertools.pairwise(off.tolist()):
            masks.append(text_mask(raw[a:b]))
            digests.append(hashlib.sha256(raw[a:b]).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
            ["key", "part", "mask", "digest"])


def failing_masks(df: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(key, part, mask, place): the filters that each row fails, written to the shared folder before copies are joined."""
    rows = ensure_parallelism(df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"),
                                        F.col(f"`{text}`").alias("text")))
    schema = keyed_schema(rows, "key", "part string, mask int, digest binary")
    # The place tells rows of one id apart; it follows the written files, so a repeated task gives the same.
    seen = written(map_arrow(rows, _measured, schema), "filter-masks").withColumn("place", F.monotonically_increasing_id())
    first = (seen.where(F.col("key").isNotNull()).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"))
             .where("copies > 1").select("digest", "first"))
    copy = F.coalesce(F.col("key") > F.col("first"), F.lit(False))
    return seen.join(first, "digest", "left").select("key", "part", F.when(copy, F.col("mask").bitwiseOR(16)).otherwise(F.col("mask")).alias("mask"), "place")


def with_classes(masks: DataFrame, labels: DataFrame, key: str, classes: dict) -> DataFrame:
    """``masks`` with a column ``classes``: one bit per class that the labels give the id."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), (
        F.max(F.when(c, 1 << i).otherwise(0)) for i, c in enumerate(classes.values())))
    of = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(bits.alias("classes"))
    return masks.join(of, "key", "left").withColumn("classes", F.coalesce("classes", F.lit(0)))


def _lists_of(n_filters: int, n_classes: int):
    def lists(batches):
        held, size, now = [], 0, None

        def row():
            block = pa.Table.from_batches(held)
            mask, marks = (block.column(c).to_numpy() for c in ("mask", "classes"))
            failing = [np.flatnonzero(mask >> i & 1) for i in range(n_filters)] + [np.flatnonzero(marks >> i & 1) for i in range(n_classes)]
            cut = np.cumsum([0, *map(len, failing)], dtype=np.int32)
            places = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(failing).astype(np.int32)))
            ids = block.column("key").combine_chunks()
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([
                pa.array([now]), ids, pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), places)], ["part", "ids", "places"])

        for batch in batches:
            part = np.array(batch.column("part").to_pylist(), dtype=object)
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in itertools.pairwise(cuts):
                while a < b:
                    if held and (part[a] != now or size == BLOCK):
                        yield row()
                        held, size = [], 0
                    now, take = part[a], min(b - a, BLOCK - size)
                    held.append(batch.slice(a, take))
                    size, a = size + take, a + take
        if held:
            yield row()

    return lists


def failing_lists(flagged: DataFrame, n_filters: int = len(FILTERS), n_classes: int = len(CLASSES)) -> DataFrame:
    """(part, ids, places) of every part and id range.

    ``ids`` are the range's documents in order, ``places`` one sorted list per filter, then one per class,
    of the places in ``ids`` that fail it (or belong to it).
    ``flagged`` has key, part, mask, classes and a place that tells equal ids apart.
    """
    cols = ["part", "key", "mask", "classes"]
    rows = flagged.repartitionByRange("part", "key", "place").sortWithinPartitions("part", "key", "place").select(*cols)
    ids = T.ArrayType(flagged.schema["key"].dataType)
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("ids", ids),
                           T.StructField("places", T.ArrayType(T.ArrayType(T.IntegerType())))])
    return map_arrow(rows, _lists_of(n_filters, n_classes), schema)


def gallop(into: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of the sorted ``ids`` the place of the first entry of ``into`` that is not below it."""
    out, at = np.empty(len(ids), np.int64), 0
    for i in range(0, len(ids), STRIDE):
        some = ids[i:i + STRIDE]
        end, step = at, STRIDE
        while end < len(into) and into[end] < some[-1]:
            end, step = end + step, 2 * step
        out[i:i + STRIDE] = at + np.searchsorted(into[at:end + 1], some)
        at = int(out[min(i + STRIDE, len(ids)) - 1])
    return out


def _absent(ids: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``ids`` are not in ``into``, and where they would stand."""
    at = gallop(into, ids)
    absent = np.ones(len(ids), bool)
    inside = at < len(into)
    absent[inside] = into[at[inside]] != ids[inside]
    return absent, at


def united(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    few, many = (a, b) if len(a) < len(b) else (b, a)
    absent, at = _absent(few, many)
    return np.insert(many, at[absent], few[absent])


def range_sizes(n: int, lists: list[np.ndarray], classes: list[np.ndarray]) -> list[list[int]]:
    """Rows (before, filter, documents, gone, failing, removed, unique, shapley, class losses...) of one range.

    ``before`` is the set of filters that ran earlier, as bits; ``gone`` is the union after this one.
    """
    k = len(lists)
    everyone = (1 << k) - 1
    union = [np.zeros(0, np.int64)]
    for s in range(1, 1 << k):
        low = (s & -s).bit_length() - 1
        union.append(united(union[s & (s - 1)], lists[low]))
    rows = []
    for f, failing in enumerate(lists):
        lost = [~_absent(failing, c)[0] for c in classes]
        here = {}
        for s in range(1 << k):
            if not s >> f & 1:
                left, _ = _absent(failing, union[s])
                here[s] = [int(left.sum()), *(int((left & x).sum()) for x in lost)]
        shapley = sum(math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count()) * v[0] for s, v in here.items())
        alone = here[everyone & ~(1 << f)][0]
        rows += [[s, f, n, len(union[s | 1 << f]), len(failing), v[0], alone, shapley, *v[1:]] for s, v in here.items()]
    return rows


def _sizes_of(n_filters: int, out: pa.Schema):
    def rows(part, sums):
        return pa.RecordBatch.from_arrays([pa.array([part] * len(sums)), *(pa.array(c) for c in sums.T)], schema=out)

    def sizes(batches):
        now, sums = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                part, n = batch.column("part")[i].as_py(), len(batch.column("ids")[i])
                lists = [x.values.to_numpy().astype(np.int64) for x in batch.column("places")[i].values]
                found = np.array(range_sizes(n, lists[:n_filters], lists[n_filters:]), np.int64)
                if sums is not None and part == now:
                    sums[:, 2:] += found[:, 2:]
                    continue
                if sums is not None:
                    yield rows(now, sums)
                now, sums = part, found
        if sums is not None:
            yield rows(now, sums)

    return sizes


def audit(lists: DataFrame, filters=FILTERS, classes=CLASSES) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of documents of the module's head."""
    k = len(filters)
    counts = ["documents", "gone", "failing", "removed", "unique_fails", "shapley", *(f"{c}_lost" for c in classes)]
    schema = T.StructType([T.StructField("part", T.StringType()), *(T.StructField(c, T.LongType()) for c in ["before", "filter", *counts])])
    arrow = pa.schema([("part", pa.string()), *((c, pa.int64()) for c in ["before", "filter", *counts])])
    sums = (map_arrow(lists, _sizes_of(k, arrow), schema).groupBy("part", "before", "filter")
            .agg(*(F.sum(c).alias(c) for c in counts)))
    steps = [("".join(filters[f] for f in order), i + 1, sum(1 << f for f in order[:i]), order[i])
             for order in itertools.permutations(range(k)) for i in range(k)]  # k! orders of k steps, whatever the data
    orders = lists.sparkSession.createDataFrame(steps, "filter_order string, step int, before long, filter long")
    return sums.join(F.broadcast(orders), ["before", "filter"]).select(
        "part", "filter_order", "step", (F.col("documents") - F.col("gone")).alias("kept"), "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", *(f"{c}_lost" for c in classes), "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of every order."""
    masks = failing_masks(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    flagged = with_classes(masks, table(spark, sf_dir, "labels"), "doc_id",
                           {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return audit(failing_lists(flagged))
