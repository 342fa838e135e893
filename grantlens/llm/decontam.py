"""Operator 10: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

The corpus is read twice and never shuffled:

1. The words of the test items are counted over the whole corpus.  An
   n-gram of two or three item words whose expected rate (the product of its
   words' rates) is at most ``RARE_RATE`` is a seed; an item always has its
   ``LEAST_SEEDS`` rarest three-word n-grams and the rarest one of each of
   up to ``LEAST_SEEDS`` parts of it, so no single edit removes all (under
   six words: all word pairs; under ``LEAST_WORDS``: the whole item).  The rate is computed from
   single words, so a passage that leaked into many documents stays rare.
2. Every place where a document holds a seed gives a window around the
   diagonal of the item; overlapping windows are joined, and the item is
   aligned to the window by Smith-Waterman over words.  A document whose
   best local alignment with an item reaches ``SCORE`` of a perfect copy's,
   and ``LEAST_MATCHED`` words (in a shorter item: all but one edited word),
   is reported with the item, the score and the words it spans.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z
and the accented Latin-1 capitals lower-cased, so punctuation and case do not matter.  Items are used in
blocks of at most ``ITEM_BYTES`` of text, each sent to the tasks once; rows
shuffled are one count per item word and task.

Defined cases: null and empty texts hold no seed; items of fewer than
``LEAST_WORDS`` words count where they stand whole and unchanged; equal items and repeated rows are each
reported; a null id is reported as it is; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.llm.common import LOWER, RangeHash, keyed_schema, map_arrow, table, text_chunks, within, word_spans
from grantlens.session import ensure_parallelism

RARE_RATE = 1e-8
LEAST_SEEDS = 4
LEAST_WORDS = 5
#: Matched words, less one half for every edit between them, that an alignment has to reach besides its share.
LEAST_MATCHED = 6
#: Share of the score of a perfect copy from which a document counts as contaminated.
SCORE = 0.35
MATCH, MISMATCH, GAP = 2, -1, -1
ITEM_BYTES = 32 << 20
SIZES = (2, 3)
#: Windows that are aligned side by side.
BATCH = 128

_HASH = RangeHash(31)
_OTHER = np.ones(256, dtype=bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FILTER_BITS = 22


def words_in(data: np.ndarray, off: np.ndarray):
    """Hashes of the words, and the first word of each text."""
    start, end, first = word_spans(data, off, _OTHER)
    low = LOWER[data]
    # In UTF-8 the capitals are C3 80 to C3 9E (97 is the multiplication sign).
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    low[at] += 0x20
    return _HASH.words(low, start, end), first


def words_of_texts(texts: list[str]) -> list[np.ndarray]:
    raw = [t.encode() for t in texts]
    off = np.cumsum([0] + [len(x) for x in raw])
    h, first = words_in(np.frombuffer(b"".join(raw), np.uint8), off)
    return [h[a:b] for a, b in zip(first[:-1], first[1:])]


class Members:
    """Finds the values of a sorted array in long arrays; a bitmap keeps most others out."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self._low(self.values)] = True

    @staticmethod
    def _low(h):
        return (h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, places in the values) of the members among h."""
        at = np.flatnonzero(self.bits[self._low(h)])
        k = np.searchsorted(self.values, h[at])
        k[k == len(self.values)] = 0
        same = self.values[k] == h[at] if len(self.values) else np.zeros(len(at), bool)
        return at[same], k[same]


def count_words(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Occurrences of each vocabulary word in the corpus, and the words of the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        members = Members(shared.value)
        counts, total = np.zeros(len(members.values), np.int64), 0
        for batch in batches:
            for _, _, data, off in text_chunks(batch.column(0)):
                h, _ = words_in(data, off)
                counts += np.bincount(members.find(h)[1], minlength=len(counts))
                total += len(h)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(counts[some], total), pa.int64())],
                                         names=["word", "n"])

    rows = map_arrow(docs.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}  # at most one row per word of the items
    return np.array([found.get(i, 0) for i in range(len(vocabulary))], np.int64), found.get(-1, 0)


def needed_score(words: int) -> float:
    """The alignment score from which an item of so many words is found."""
    if words < LEAST_WORDS:
        return MATCH * words
    one_edit = MATCH * (words - 1) + MISMATCH
    return max(SCORE * MATCH * words, min(one_edit, MATCH * LEAST_MATCHED))


class Seeds:
    """The items' words, and for every seed hash the items and places it comes from."""

    def __init__(self, items: list[np.ndarray], vocabulary: np.ndarray, counts: np.ndarray, total: int):
        self.items = items
        log_rate = np.log10((counts + 0.5) / (total + 1.0))
        rows = []
        for k, words in enumerate(items):
            if len(words) < LEAST_WORDS:
                if len(words):
                    rows.append((int(_HASH.grams(words, len(words))[0]), len(words), k, 0))
                continue
            rates = np.concatenate(([0.0], np.cumsum(log_rate[np.searchsorted(vocabulary, words)])))
            for n in SIZES:
                at = np.arange(len(words) - n + 1)
                rate = rates[at + n] - rates[at]
                rare = rate <= math.log10(RARE_RATE)
                if n == SIZES[-1]:
                    rare[np.argsort(rate, kind="stable")[:LEAST_SEEDS]] = True
                    parts = min(LEAST_SEEDS, len(words) // n)
                    cuts = np.arange(parts + 1) * len(words) // parts
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        rare[a + np.argmin(rate[a:b - n + 1])] = True
                elif len(words) < 2 * SIZES[-1]:
                    rare[:] = True
                h = _HASH.grams(words, n)
                rows += [(int(h[i]), n, k, int(i)) for i in np.flatnonzero(rare)]
        self.by_size = {}
        for n in sorted({r[1] for r in rows}):
            own = sorted((h, k, i) for h, m, k, i in rows if m == n)
            h = np.array([x[0] for x in own], np.uint64)
            members = Members(h)
            self.by_size[n] = (members, np.searchsorted(h, members.values), np.searchsorted(h, members.values, side="right"),
                               np.array([x[1:] for x in own], np.int64).reshape(-1, 2))

    def windows(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, from, to): joined windows of words around the diagonals of all seed hits."""
        found = []
        of_text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        prefix = _HASH.prefix(h)
        length = np.array([len(x) for x in self.items], np.int64)
        for n, (members, low, high, origin) in self.by_size.items():
            at = within(first, n)
            hit, seed = members.find(_HASH.ranges(prefix, at, at + n))
            times = (high - low)[seed]
            place = np.repeat(at[hit], times)
            own = origin[np.repeat(low[seed] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))]
            item, diagonal, text = own[:, 0], place - own[:, 1], of_text[place]
            slack = length[item] // 2 + 2
            found.append(np.stack([text, item, np.maximum(first[text], diagonal - slack),
                                   np.minimum(first[text + 1], diagonal + length[item] + slack)], axis=1))
        rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
        out: list[list[int]] = []
        for text, item, a, b in rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))].tolist():
            if out and out[-1][:2] == [text, item] and a <= out[-1][3]:
                out[-1][3] = max(out[-1][3], b)
            else:
                out.append([text, item, a, b])
        return [tuple(x) for x in out]

    def alignments(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, past last word): the best alignment of each text and item that counts."""
        h, first = words_in(data, off)
        windows = sorted(self.windows(h, first), key=lambda w: (w[3] - w[2], w))
        best: dict[tuple[int, int], tuple] = {}
        for at in range(0, len(windows), BATCH):
            part = windows[at:at + BATCH]
            items = [self.items[item] for _, item, _, _ in part]
            texts = [h[a:b] for _, _, a, b in part]
            score, end = local_alignment(items, texts)
            share = score / (MATCH * np.array([len(x) for x in items]))
            good = np.flatnonzero(score >= np.array([needed_score(len(x)) for x in items]) - 1e-9)
            if not len(good):
                continue
            # The same alignment from its end backwards gives where it starts.
            _, back = local_alignment([items[i][::-1] for i in good], [texts[i][:end[i]][::-1] for i in good])
            for i, length in zip(good.tolist(), back.tolist()):
                text, item, a, _ = part[i]
                stop = a + int(end[i]) - int(first[text])
                row = (float(share[i]), -(stop - length), text, item, stop)
                best[text, item] = max(best.get((text, item), row), row)
        return [(text, item, score, -start, stop) for score, start, text, item, stop in sorted(best.values(), key=lambda x: x[2:4])]


def local_alignment(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of pairs of word sequences, side by side, and where in the text the best one first ends."""
    n, rows, width = len(items), max(map(len, items)), max(map(len, texts))
    left, right = np.zeros((n, rows), np.uint64), np.zeros((n, width), np.uint64)
    used_left, used_right = np.zeros((n, rows), bool), np.zeros((n, width), bool)
    for i, (x, y) in enumerate(zip(items, texts)):
        left[i, :len(x)], right[i, :len(y)] = x, y
        used_left[i, :len(x)], used_right[i, :len(y)] = True, True
    slope = np.arange(width + 1, dtype=np.int32) * -GAP
    above = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for r in range(rows):
        same = (right == left[:, r:r + 1]) & used_right & used_left[:, r:r + 1]
        row = np.zeros_like(above)
        row[:, 1:] = np.maximum(np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] + GAP), 0)
        # A gap in the item: the best value to the left, less one per word.
        above = np.maximum.accumulate(row + slope, axis=1) - slope
        at = above.argmax(axis=1)
        top = above[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


def item_blocks(items: DataFrame, key: str, text: str):
    """The items in blocks of at most about ITEM_BYTES, each as (ids, texts) on the driver."""
    rows = items.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = -(-size // ITEM_BYTES)
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()
        yield [r["id"] for r in own], [r["text"] for r in own]


def seeds_of(docs: DataFrame, items: DataFrame, item_key: str, item_text: str):
    """(ids, seeds) of each block of items; ``docs`` has the column text."""
    for ids, texts in item_blocks(items, item_key, item_text):
        words = words_of_texts(texts)
        vocabulary = np.unique(np.concatenate(words))
        yield ids, Seeds(words, vocabulary, *count_words(docs, vocabulary))


def find_leaks(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """(key, item, score, start, end): the test items that each document holds, with the words they span."""
    spark = df.sparkSession
    docs = ensure_parallelism(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    schema = keyed_schema(df, key, f"item {items.schema[item_key].dataType.simpleString()}, score double, start int, end int")
    out = spark.createDataFrame([], schema)
    for ids, seeds in seeds_of(docs, items, item_key, item_text):
        shared = spark.sparkContext.broadcast((ids, seeds))

        def run(batches, shared=shared):
            ids, seeds = shared.value
            for batch in batches:
                for i, _, data, off in text_chunks(batch.column(1)):
                    if found := seeds.alignments(data, off):
                        rows, item, score, start, end = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array([i + r for r in rows])), pa.array([ids[k] for k in item]),
                             pa.array(score), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                            names=["key", "item", "score", "start", "end"])

        out = out.unionByName(map_arrow(docs, run, schema))
    return out.withColumnRenamed("key", key)


def without_leaks(df: DataFrame, text: str, items: DataFrame, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text holds no test item; nothing is shuffled."""
    at = df.columns.index(text)
    for _, seeds in seeds_of(df.select(F.col(text).alias("text")), items, item_key, item_text):
        shared = df.sparkSession.sparkContext.broadcast(seeds)

        def run(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _, data, off in text_chunks(batch.column(at)):
                    for found in shared.value.alignments(data, off):
                        clean[i + found[0]] = False
                yield batch.filter(pa.array(clean))

        df = map_arrow(df, run, df.schema)
    return df


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, start and end of every test item found in a document."""
    found = find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("item", "item_id")
