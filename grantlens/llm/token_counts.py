"""Operator 6: exact token counts at every prefix, by dynamic programming.

For each prefix of a pre-token the table holds the last token of its
encoding and the number of tokens.  The last token of a prefix is the one
vocabulary entry that ends there and may stand after the last token of what
is before it; so a table of n bytes is filled from left to right without
encoding any prefix.  Two tokens may stand side by side when no merge across
their border would come before the merges that build them: this is read
off the right edge of the first token's merge tree and the left edge of the
second's.

The counts of a text's pre-tokens, summed from left to right, answer "how
many tokens has the prefix of b bytes" and "which is the longest prefix
within a budget" without another encoding.  A prefix that ends inside a
pre-token counts what the pre-token's own prefix encodes to.

Tables of the pre-tokens met are kept in a cache of bounded size in each
Python worker; it changes the time only.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); strings of
special tokens inside a text count as one token each, the library's default;
repeated rows give repeated results; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.llm.bpe import CACHE, KEPT, pattern, pieces
from grantlens.llm.common import keyed_schema, map_arrow, table, text_chunks
from grantlens.session import ensure_parallelism

#: More than any merge rank.
NEVER = 1 << 30


class PrefixCounter:
    """Prefix tables by the merges of a byte-level tokenizer file."""

    def __init__(self, path: str, split: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        # The file writes each byte as a printable character: those that print stand for
        # themselves, the others follow from code point 256 in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        raw = {name: bytes(byte_of[c] for c in name) for name in vocab if all(c in byte_of for c in name)}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.parts: dict[bytes, tuple[int, bytes, bytes]] = {}  # rank and halves of each merged token
        for i, pair in enumerate(merges):
            a, b = (raw[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[a, b] = i
            self.parts.setdefault(a + b, (i, a, b))
        self.tokens = set(raw.values())
        self.longest = max(map(len, self.tokens))
        self.special = [x["content"] for x in spec.get("added_tokens", ()) if x.get("special")]
        self.split = pattern(split)
        self.right: dict[bytes, list] = {}
        self.left: dict[bytes, list] = {}
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str, bytes | np.ndarray] = {}
        self.alone = {t: self._own(t) for t in self.tokens}

    def _own(self, token: bytes) -> bool:
        """Whether the token's bytes encode to the token itself."""
        if len(token) == 1:
            return True
        if token not in self.parts:
            return False
        _, a, b = self.parts[token]
        # Its halves stand until the last merge, so no merge across their border may come first.
        return self._own(a) and self._own(b) and self._border(a, b, self.parts[token][0])

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """(token, rank at which it is merged into the next) from the outer byte up to the whole token."""
        out, above = [], NEVER
        while True:
            out.append((token, above))
            if token not in self.parts:
                return out[::-1]
            rank, *halves = self.parts[token]
            token, above = halves[side], rank

    def _border(self, a: bytes, b: bytes, last: int = NEVER) -> bool:
        """Whether a and b are built before any merge of rank under ``last`` crosses their border."""
        if a not in self.right:
            self.right[a] = self._edge(a, 1)
        if b not in self.left:
            self.left[b] = self._edge(b, 0)
        left, right, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, x_up), (y, y_up) = left[i], right[j]
            across = self.rank.get((x, y), NEVER)
            # Of equal ranks the pair further left is merged first.
            if across < x_up and across <= y_up and across < last:
                return False
            if x_up == y_up == NEVER:
                return True
            if x_up <= y_up:
                i += 1
            else:
                j += 1

    def may_follow(self, a: bytes, b: bytes) -> bool:
        found = self.beside.get((a, b))
        if found is None:
            if len(self.beside) >= CACHE:
                self.beside.clear()
            found = self.beside[a, b] = self._border(a, b)
        return found

    def table(self, raw: bytes) -> list[int]:
        """Tokens of raw[:1], raw[:2], ... of one pre-token."""
        tokens, alone, beside, may_follow = self.tokens, self.alone, self.beside, self.may_follow
        last, count = [b""], [0]
        for end in range(1, len(raw) + 1):
            for start in range(max(0, end - self.longest), end):
                t = raw[start:end]
                if t not in tokens:
                    continue
                if start:
                    ok = beside.get((last[start], t))
                    if ok is None:
                        ok = may_follow(last[start], t)
                    if not ok or not alone[t]:
                        continue
                elif not alone[t]:
                    continue
                last.append(t)
                count.append(count[start] + 1)
                break
        return count[1:]

    def tables(self, texts: list[str]) -> list[list]:
        """For each text the prefix tables of its pieces, in order."""
        parts = [self._cut(x) for x in texts]
        known = self.known
        if len(known) > CACHE:
            known.clear()
        new = set(chain.from_iterable(parts)).difference(known)
        for s in self.special:
            if s in new:
                known[s] = bytes([1] * len(s.encode()))
                new.discard(s)
        split = {p: self.split.findall(p) for p in new}
        for p, own in split.items():
            total, counts = 0, []
            for t in own:
                done = known.get(t) if t is not p else None
                if done is None:
                    done = self.table(t.encode())
                counts += [total + c for c in done] if total else list(done)
                total = counts[-1]
            known[p] = bytes(counts) if total < 256 else np.array(counts, np.int64)
        out = [[known[p] for p in x] for x in parts]
        for p in new:
            if len(p) > KEPT:
                del known[p]
        return out

    def _cut(self, text: str) -> list[str]:
        out = [text]
        for s in self.special:
            if s in text:
                between = ([x] if x in self.special else [y for z in x.split(s) for y in (s, z)][1:] for x in out)
                out = list(chain.from_iterable(between))
        return [p for x in out for p in ([x] if x in self.special else pieces(x)) if p]


_COUNTERS: dict[tuple[str, str], PrefixCounter] = {}


def counter(path: str, split: str) -> PrefixCounter:
    if (path, split) not in _COUNTERS:
        _COUNTERS[path, split] = PrefixCounter(path, split)
    return _COUNTERS[path, split]


def prefix_counts(tables: list) -> np.ndarray:
    """Tokens at every byte prefix of a text (from 1 byte on), from its pieces' tables."""
    if not tables:
        return np.zeros(0, np.int64)
    base = np.concatenate(([0], np.cumsum([int(t[-1]) for t in tables])))
    return np.concatenate([np.frombuffer(t, np.uint8).astype(np.int64) + b if isinstance(t, bytes) else t + b
                           for t, b in zip(tables, base)])


def longest_prefix(tables: list, budget: int) -> int:
    """Bytes of the longest prefix of at most ``budget`` tokens.

    Adding a byte may lower the count again, so inside the piece that goes
    past the budget the last byte within it is taken.
    """
    ends = list(accumulate(int(t[-1]) for t in tables))
    k = bisect_right(ends, budget)
    done = sum(len(t) for t in tables[:k])
    if k == len(tables):
        return done
    left = budget - (ends[k - 1] if k else 0)
    within = np.flatnonzero(np.asarray(tables[k] if not isinstance(tables[k], bytes) else list(tables[k])) <= left)
    return done + (int(within[-1]) + 1 if len(within) else 0)


def count_tokens(df: DataFrame, key: str, text: str, budget: int = 512, path: str | None = None,
                 split: str | None = None) -> DataFrame:
    """(key, n_bytes, n_tokens, budget_bytes): budget_bytes is the longest whole-character prefix within the budget."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    split = split or public_tokenizers.PATTERN

    def run(batches):
        c = counter(path, split)
        for batch in batches:
            for i, j, data, off in text_chunks(batch.column(1)):
                part = batch.slice(i, j - i)
                found = c.tables([x or "" for x in part.column(1).to_pylist()])
                cut = []
                for t, a, b in zip(found, off[:-1].tolist(), off[1:].tolist()):
                    at = longest_prefix(t, budget)
                    while 0 < at < b - a and data[a + at] & 0xC0 == 0x80:  # not inside a character
                        at -= 1
                    cut.append(at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(off), pa.int64()),
                     pa.array([sum(int(x[-1]) for x in t) for t in found], pa.int64()), pa.array(cut, pa.int64())],
                    names=["key", "n_bytes", "n_tokens", "budget_bytes"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = map_arrow(ensure_parallelism(rows), run, keyed_schema(rows, "key", "n_bytes long, n_tokens long, budget_bytes long"))
    return out.withColumnRenamed("key", key)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than 512 tokens), budget_bytes (prefix of at most 512 tokens)."""
    out = count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", 512)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "budget_bytes")
