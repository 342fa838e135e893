"""Shared pieces of the training-data operators: tables, Arrow text access, word hashing.

A word is a run of ``[^\\x20\\x09-\\x0D]+``.  These are ASCII separators, so
words can be cut from the UTF-8 bytes directly; numpy does this for a whole
Arrow batch at once, without a Python object per word.  Words are hashed
under a random key, eight bytes at a time; n-gram hashes are polynomials
over the words' hashes, and prefix sums give that of any run of words in
constant time.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once inside a task; one longer text is handled alone.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_import(spark: SparkSession) -> None:
    """Let the Python workers import this package where it lies at the same path.

    Elsewhere the package has to be installed or passed by ``--py-files``.
    """
    env = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def keyed_schema(df: DataFrame, key: str, rest: str) -> T.StructType:
    """A column ``key`` of the type that it has in ``df``, then the columns ``rest``."""
    return T.StructType([T.StructField("key", df.schema[key].dataType), *T.StructType.fromDDL(rest).fields])


def packed(df: DataFrame, text: str) -> DataFrame:
    """(row, text): every column inside one, so that no name can clash; unpack by ``select("row.*")``."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text).alias("text"))


def map_arrow(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    workers_import(df.sparkSession)
    return df.mapInArrow(run, schema)


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets; a null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES):
    """Yield (first row, past row, bytes, offsets) for runs of rows of at most ``max_bytes``."""
    data, off = flat_text(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray, separators: np.ndarray = _SPACE):
    """Start and end of every word, and the first word of each text (one more at the end)."""
    blank = separators[data]
    begins, ends = ~blank, ~blank
    word = begins.copy()
    begins[1:] &= blank[:-1]
    ends[:-1] &= blank[1:]
    full = off[1:] > off[:-1]
    first, last = off[:-1][full], off[1:][full] - 1
    begins[first] = word[first]
    ends[last] = word[last]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, off)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Words of more bytes are hashed by a keyed digest, one by one.
LONG_WORD = 64
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class RangeHash:
    """Hashes of words and of short runs of words; ``seed`` picks an independent family.

    A word goes through the mixing step eight bytes at a time, so words of up to eight bytes never collide
    with others of their length, and a longer one is a chain of 64-bit permutations under a random key.
    A run's hash is a polynomial over its words' hashes modulo 2**64, taken from prefix sums.  Its
    coefficients are random numbers, so that runs of a few dozen words are told apart; sums over thousands
    of equal words are not meant to be hashed like this.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.key = rng.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(2**61, 2**62)) * 2 + 1
        self._pow = self._inv = np.zeros(0, np.uint64)

    def _powers(self, n: int):
        if len(self._pow) < n:
            size = max(n, 2 * len(self._pow), 1 << 16)
            for name, b in (("_pow", self.base), ("_inv", pow(self.base, -1, 2**64))):
                p = np.full(size, b, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self._pow, self._inv

    def prefix(self, values: np.ndarray) -> np.ndarray:
        power, _ = self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[:len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, inv = self._powers(len(prefix))
        return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = np.full(len(start), self.key[0], np.uint64)
        eight = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
        now = np.flatnonzero(size <= LONG_WORD)
        for at in range(0, LONG_WORD, 8):
            now = now[size[now] > at]
            if not len(now):
                break
            part = eight[start[now] + at].view("<u8")[:, 0] & _TAIL[np.minimum(size[now] - at, 8)]
            out[now] = mix(out[now] ^ part) * self.key[1]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            digest = hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8, key=self.key.tobytes()).digest()
            out[i] = np.frombuffer(digest, "<u8")[0]
        return mix(out + size.astype(np.uint64))

    def grams(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hash of every run of ``k`` words (also those that cross texts: mask them)."""
        at = np.arange(max(0, len(words) - k + 1))
        return self.ranges(self.prefix(words), at, at + k)


def within(word_off: np.ndarray, k: int) -> np.ndarray:
    """Positions at which a run of ``k`` words stays inside one text."""
    n = int(word_off[-1])
    room = np.repeat(word_off[1:], np.diff(word_off)) - np.arange(n)
    return np.flatnonzero(room >= k)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
