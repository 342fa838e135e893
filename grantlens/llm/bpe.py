"""Operator 8: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of the pre-tokens are one long linked list with barriers between
pre-tokens.  Every adjacent pair whose joined bytes have a rank waits in the
bucket of that rank.  A bitmap over the ranks in words of 256 bits, with a
level above it that says which words are not zero, gives the lowest
non-empty rank by two find-first-set steps, however many pairs wait.  Its
bucket is worked off from left to right; entries that a neighbouring merge
made stale are skipped when met, and when a merge opens a pair of a lower
rank, what is left of the bucket waits again.  So n bytes take about n log n
steps, also when they are a single pre-token.

Pre-tokens repeat, so each Python worker keeps the ids of those it has met
in a cache of bounded size; the cache changes the time only.

Defined cases: a null text counts as empty; an empty text has no ids, and
its digests are those of the empty string; ids and extra columns of the
input are not touched; repeated rows give repeated results; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.llm.common import keyed_schema, map_arrow, table, text_chunks
from grantlens.session import ensure_parallelism

#: The code points that count as white space in the pattern.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of white space and the run of other characters after it; what follows
#: never changes how such a piece is split.
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Where this is not found, pieces also begin before each blank, comma and full
#: stop, and line ends are pieces of their own.
RUNS = re.compile(f"[{WHITE}][{WHITE}]|(?:^|[\\W_])[,.]|[{WHITE}]$|\x00")
#: Entries of each worker's cache (memory bound; not a limit on texts).
CACHE = 600_000
#: Longer pieces are not kept in the cache.
KEPT = 64


def pattern(text: str) -> regex.Pattern:
    """The given pattern with white space spelled out, as the rank files' library reads it."""
    return regex.compile(text.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]"))


def pieces(text: str) -> list[str]:
    """Cut a text into pieces that are split into pre-tokens independently."""
    if RUNS.search(text):
        return PIECE.findall(text)
    marked = text.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").replace("\n", "\0\n\0")
    return marked.split("\0")


class Encoder:
    """Encodes texts by the ranks of a file; ``decode`` is its inverse on the bytes."""

    def __init__(self, path: str, split: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.split = pattern(split)
        self.words = max(self.ranks.values()) // 256 + 1
        self.of_pair = np.full(65536, -1, np.int32)
        for raw, rank in self.ranks.items():
            if len(raw) == 2:
                self.of_pair[raw[0] << 8 | raw[1]] = rank
        self.known: dict[str, tuple[int, ...]] = {"": ()}

    def merge(self, tokens: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each pre-token, by one rank queue over all of them."""
        raw = b"".join(tokens)
        n = len(raw)
        if not n:
            return [() for _ in tokens]
        rank_of = self.ranks.get
        cuts = np.cumsum([0] + [len(t) for t in tokens])
        first = np.zeros(n + 1, np.uint8)  # a barrier stands before these
        first[cuts] = 1
        data = np.frombuffer(raw, np.uint8).astype(np.int32)
        pairs = np.full(n, -1, np.int32)
        pairs[:-1] = self.of_pair[data[:-1] << 8 | data[1:]]
        pairs[first[1:] == 1] = -1
        # Buckets of positions by rank, and the bitmap of those that are not empty.
        at = np.flatnonzero(pairs >= 0)
        at = at[np.argsort(pairs[at], kind="stable")]
        begin = np.flatnonzero(np.diff(pairs[at], prepend=-1))
        buckets = {r: x.tolist() for r, x in zip(pairs[at[begin]].tolist(), np.split(at, begin[1:]))} if len(at) else {}
        low, top = [0] * self.words, 0
        for r in buckets:
            low[r >> 8] |= 1 << (r & 255)
            top |= 1 << (r >> 8)
        waits, first = pairs.tolist(), first.tobytes()  # the rank under which the pair that starts here waits
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while top:
            b = (top & -top).bit_length() - 1
            word = low[b]
            r = b << 8 | (word & -word).bit_length() - 1
            low[b] = word = word & (word - 1)
            if not word:
                top &= top - 1
            bucket = buckets.pop(r)
            bucket.sort()
            for done, i in enumerate(bucket, 1):
                if waits[i] != r:
                    continue  # stale
                j = after[i]
                k = after[i] = after[j]
                waits[i] = waits[j] = -1
                opened = []
                if not first[k]:
                    before[k] = i
                    opened.append((rank_of(raw[i:after[k]], -1), i))
                if not first[i]:
                    h = before[i]
                    opened.append((rank_of(raw[h:k], -1), h))
                lower = False
                for q, p in opened:
                    waits[p] = q
                    if q >= 0:
                        if q in buckets:
                            buckets[q].append(p)
                        else:
                            buckets[q] = [p]
                            low[q >> 8] |= 1 << (q & 255)
                            top |= 1 << (q >> 8)
                        lower = lower or q < r
                if lower:
                    if rest := bucket[done:]:
                        buckets[r] = rest
                        low[b] |= 1 << (r & 255)
                        top |= 1 << b
                    break
        out, ranks, i = [], self.ranks, 0
        for end in cuts[1:].tolist():
            ids = []
            while i < end:
                j = after[i]
                ids.append(ranks[raw[i:j]])
                i = j
            out.append(tuple(ids))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of every text."""
        parts = [pieces(x) for x in texts]
        known = self.known
        if len(known) > CACHE:
            known.clear()
            known[""] = ()
        new = set(chain.from_iterable(parts)).difference(known)
        split = {p: [p] if p.isalpha() or p[0] == " " and p[1:].isalpha() else self.split.findall(p) for p in new}
        tokens = {t: t.encode() for t in set(chain.from_iterable(split.values())).difference(known)}
        ids = {t: (self.ranks[raw],) for t, raw in tokens.items() if raw in self.ranks}  # a whole token
        todo = [t for t in tokens if t not in ids]
        ids.update(zip(todo, self.merge([tokens[t] for t in todo])))
        for p, own in split.items():
            ids[p] = tuple(chain.from_iterable([ids[t] if t in ids else known[t] for t in own]))
        known.update(ids)
        out = [list(chain.from_iterable(map(known.__getitem__, x))) for x in parts]
        for p in [p for p in ids if len(p) > KEPT]:
            del known[p]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, split: str) -> Encoder:
    """One encoder a worker process, with its caches."""
    if (path, split) not in _ENCODERS:
        _ENCODERS[path, split] = Encoder(path, split)
    return _ENCODERS[path, split]


def encode_texts(df: DataFrame, key: str, text: str, ranks_path: str | None = None,
                 split: str | None = None) -> DataFrame:
    """(key, ids, decoded): the ids of every text and the bytes they decode to; a null text is empty."""
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    split = split or public_tokenizers.PATTERN

    def run(batches):
        enc = encoder(ranks_path, split)
        for batch in batches:
            for i, j, _, _ in text_chunks(batch.column(1)):
                part = batch.slice(i, j - i)
                ids = enc.encode([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(x) for x in ids], pa.binary())],
                    names=["key", "ids", "decoded"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = map_arrow(ensure_parallelism(rows), run, keyed_schema(rows, "key", "ids array<int>, decoded binary"))
    return out.withColumnRenamed("key", key)


def token_digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, n_bytes) of every text."""
    return encode_texts(df, key, text).select(
        key, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), F.octet_length("decoded").cast("long").alias("n_bytes"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes of every document."""
    return token_digests(table(spark, sf_dir, "documents"), "doc_id", "text")


def digest(ids: list[int]) -> str:
    """Lower-case hex SHA-256 of the decimal ids joined by one space."""
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
