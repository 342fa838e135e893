"""Operator 5: licence scans by winnowed fingerprints and banded alignment.

Every template is a sequence of words.  Its runs of ``GRAM`` words are
hashed and winnowed: of each ``WINNOW`` neighbouring hashes the least is
kept, so any shared run of GRAM + WINNOW - 1 words holds a fingerprint.
The fingerprints form an inverted index (hash to template and place), of
fixed size, which every task holds.  A document's word runs are looked up;
hits on neighbouring diagonals form a candidate, which is aligned to the
template inside the band around these diagonals.  An alignment is reported
with its matched coverage of the template and its span in code points if it
covers ``COVERAGE`` of the template (``SHORT_COVERAGE`` for short notices,
where one other word may name another licence) and its span holds the word
sequences that tell the template from others (a version, "Affero",
"NoDerivatives").  A licence that no template is true to is not reported.  Where a reported span lies
inside a longer one, the longer one stands for both.

The scan is one pass without a shuffle.  Words are cut as in operator 10.

Defined cases: null and empty texts hold no licence; repeated rows are each
reported; a null id is reported as it is; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.llm.common import keyed_schema, map_arrow, table, text_chunks, within, word_spans
from grantlens.llm.decontam import _HASH, _OTHER, BATCH, Members, words_in, words_of_texts
from grantlens.llm.license_texts import TEMPLATES
from grantlens.llm.substring_dedup import leftmost_min
from grantlens.session import ensure_parallelism

GRAM, WINNOW = 3, 3
COVERAGE, SHORT_COVERAGE, SHORT_WORDS = 0.8, 0.9, 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words by which an alignment may leave the diagonals of its hits, besides a tenth of the template.
SLACK = 4
#: An alignment's value holds its score and, below it, its matched words.
UNIT = 1 << 13


class Index:
    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, *_ in templates]
        self.words = words_of_texts([t[1] for t in templates])
        self.must = [words_of_texts(list(t[2])) if len(t) > 2 and t[2] else [] for t in templates]
        self.needed = [math.ceil(len(w) * (SHORT_COVERAGE if len(w) < SHORT_WORDS else COVERAGE) - 1e-9) for w in self.words]
        rows = []
        for k, w in enumerate(self.words):
            h = _HASH.grams(w, min(GRAM, len(w)))
            kept = np.unique(leftmost_min(h, min(WINNOW, len(h))))
            rows += [(int(h[i]), k, int(i)) for i in kept]
        rows.sort()
        h = np.array([r[0] for r in rows], np.uint64)
        self.members = Members(h)
        self.low = np.searchsorted(h, self.members.values)
        self.high = np.searchsorted(h, self.members.values, side="right")
        self.origin = np.array([r[1:] for r in rows], np.int64).reshape(-1, 2)

    def candidates(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, template, lowest diagonal, highest diagonal) of neighbouring hits."""
        at = within(first, GRAM)
        prefix = _HASH.prefix(h)
        hit, k = self.members.find(_HASH.ranges(prefix, at, at + GRAM))
        times = (self.high - self.low)[k]
        place = np.repeat(at[hit], times)
        own = self.origin[np.repeat(self.low[k] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))]
        text = np.searchsorted(first, place, side="right") - 1
        out: list[list[int]] = []
        for t, k, d in sorted(zip(text.tolist(), own[:, 0].tolist(), (place - own[:, 1]).tolist())):
            if out and out[-1][:2] == [t, k] and d - out[-1][3] <= self.slack(k):
                out[-1][3] = d
            else:
                out.append([t, k, d, d])
        return [tuple(x) for x in out]

    def slack(self, k: int) -> int:
        return SLACK + len(self.words[k]) // 10

    def scan(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, str, float, int, int, int]]:
        """(text, name, coverage, matched words, from, to) of every licence in the texts, in code points."""
        h, first = words_in(data, off)
        found = sorted(self.candidates(h, first), key=lambda x: (x[3] - x[2], x))
        rows = []
        for at in range(0, len(found), BATCH):
            part = found[at:at + BATCH]
            spans = [(int(first[t]), int(first[t + 1])) for t, *_ in part]
            result = banded([self.words[k] for _, k, _, _ in part], h, spans,
                            [(low - self.slack(k), high + self.slack(k)) for _, k, low, high in part])
            rows += [(t, k, *r) for (t, k, _, _), r in zip(part, result)
                     if r[0] >= self.needed[k] and all(holds(h[r[1]:r[2]], m) for m in self.must[k])]
        if not rows:
            return []
        start, end, _ = word_spans(data, off, _OTHER)
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        out: list[tuple] = []
        for t, k, matched, a, b in sorted(rows, key=lambda r: (r[0], r[3], -r[4], -r[2], -r[2] / len(self.words[r[1]]), r[1])):
            if out and out[-1][0] == t and b <= out[-1][-1]:
                continue
            out.append((t, k, matched, a, b))
        return [(t, self.names[k], matched / len(self.words[k]), matched, int(points[start[a]] - points[off[t]]),
                 int(points[end[b - 1]] - points[off[t]])) for t, k, matched, a, b in out]


def holds(words: np.ndarray, run: np.ndarray) -> bool:
    """Whether the words hold the run, one after the other."""
    n = len(words) - len(run) + 1
    return n > 0 and bool(np.logical_and.reduce([words[i:i + n] == w for i, w in enumerate(run)]).any())


def banded(templates: list[np.ndarray], words: np.ndarray, spans: list[tuple[int, int]],
           bands: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(matched words, first, past last text word) of the best local alignment inside each band of diagonals."""
    n, rows = len(templates), max(map(len, templates))
    width = max(b - a for a, b in bands) + 1
    low = np.array([a for a, _ in bands])[:, None]
    high = np.array([b for _, b in bands])[:, None]
    begin, stop = (np.array([s[i] for s in spans])[:, None] for i in (0, 1))
    lengths = np.array([len(t) for t in templates])[:, None]
    left = np.zeros((n, rows), np.uint64)
    for i, t in enumerate(templates):
        left[i, :len(t)] = t
    across = np.arange(width)[None, :]
    slope = np.arange(width, dtype=np.int64) * UNIT * -GAP
    above, above_start = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    best, first, last = (np.zeros(n, np.int64) for _ in range(3))
    for r in range(rows):
        place = low + across + r  # the text word of each cell
        inside = (low + across <= high) & (place >= begin) & (place < stop) & (r < lengths)
        same = inside & (words[np.clip(place, 0, max(0, len(words) - 1))] == left[:, r:r + 1])
        step = above + np.where(same, MATCH * UNIT + 1, MISMATCH * UNIT)
        fresh = above < UNIT  # nothing to extend: an alignment begins here
        start = np.where(fresh, place, above_start)
        down = np.full_like(above, -1)
        down[:, :-1] = above[:, 1:] + GAP * UNIT
        down_start = np.zeros_like(start)
        down_start[:, :-1] = above_start[:, 1:]
        row = np.where(step >= down, step, down)
        row_start = np.where(step >= down, start, down_start)
        row = np.where(inside & (row >= UNIT), row, 0)
        # Words of the text that the template lacks: the best cell to the left, less one a word.
        reach = np.maximum.accumulate(row + slope, axis=1)
        origin = np.maximum.accumulate(np.where(row + slope == reach, across, 0), axis=1)
        moved = reach - slope
        above = np.where(inside & (moved >= UNIT), moved, 0)
        above_start = np.take_along_axis(row_start, origin, axis=1)
        at = above.argmax(axis=1)
        top = above[np.arange(n), at]
        better = top > best
        best[better] = top[better]
        first[better] = above_start[np.arange(n), at][better]
        last[better] = place[np.arange(n), at][better] + 1
    return [(int(v % UNIT), int(a), int(b)) for v, a, b in zip(best, first, last)]


def find_licenses(df: DataFrame, key: str, text: str, templates=TEMPLATES) -> DataFrame:
    """(key, license, coverage, matched_words, start, end) of every licence found; spans are code points, end exclusive."""
    docs = ensure_parallelism(df.select(F.col(key).alias("key"), F.col(text).alias("text")))

    def run(batches):
        index = Index(templates)
        for batch in batches:
            for i, _, data, off in text_chunks(batch.column(1)):
                if found := index.scan(data, off):
                    rows, name, coverage, matched, start, end = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([i + r for r in rows])), pa.array(name), pa.array(coverage),
                         pa.array(matched, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                        names=["key", "license", "coverage", "matched_words", "start", "end"])

    out = map_arrow(docs, run, keyed_schema(
        df, key, "license string, coverage double, matched_words long, start long, end long"))
    return out.withColumnRenamed("key", key)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, coverage, matched_words, start and end of every licence found in the documents."""
    return find_licenses(table(spark, sf_dir, "documents"), "doc_id", "text")
