"""Operators 6 and 8 against the tokenizer libraries."""

import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from grantlens.llm import bpe, token_counts
from tests.llm import brute

ALPHABET = "ab  \n\t'sé1²٣Ⅷ\x1c\x1f\x85\xa0　日本#$.,\r\x0b_́ \x00<|endoftext|>"


def texts(n=3000):
    rng = random.Random(1)
    mixed = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    plain = ["".join(rng.choice("abcth ,.\n") for _ in range(rng.randint(0, 15))) for _ in range(n)]
    return mixed + plain + ["", "a" * 3000, "ab" * 1500, "x <|endoftext|> y<|endoftext|><|endoftext|>",
                            "".join(rng.choice("etaoinsh") for _ in range(20_000))]


def library():
    enc = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return enc, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


def test_ids_match_the_library_and_decode_to_the_text():
    enc, lib = library()
    given = texts()
    for text, ids in zip(given, enc.encode(given)):
        assert ids == lib.encode_ordinary(text), repr(text)
        assert enc.decode(ids) == text.encode()


def test_a_small_cache_changes_nothing(monkeypatch):
    enc, lib = library()
    monkeypatch.setattr(bpe, "CACHE", 10)
    for part in (texts(50), texts(50)[::-1]):
        assert enc.encode(part) == [lib.encode_ordinary(x) for x in part]


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def test_counts_match_the_library(counter):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    given = texts()
    for text, tables, ids in zip(given, counter.tables(given), lib.encode_batch(given, add_special_tokens=False)):
        assert sum(int(t[-1]) for t in tables) == len(ids.ids), repr(text)


def test_every_prefix_and_every_budget(counter):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    for text in ["".join(rng.choice("aaabcth") for _ in range(rng.randint(1, 40))) for _ in range(200)]:
        tables = counter.tables([text])[0]
        counts = token_counts.prefix_counts(tables).tolist()
        assert counts == [len(lib.encode(text[:i + 1], add_special_tokens=False).ids) for i in range(len(text))]
        for budget in (0, 1, 3, 100):
            whole = 0  # whole pieces that fit, then the last prefix of the next that fits
            for t in tables:
                if sum(int(x[-1]) for x in tables[:whole + 1]) > budget:
                    break
                whole += 1
            cut = token_counts.longest_prefix(tables, budget)
            assert cut == 0 or counts[cut - 1] <= budget
            assert cut >= sum(len(t) for t in tables[:whole])


def test_awkward_rows(spark):
    enc, lib = library()
    df = brute.awkward(spark)
    rows = {(r["doc_id"], r["n_tokens"]): r for r in bpe.token_digests(df, "doc_id", "text").collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counted = {(r["doc_id"], r["n_tokens"], r["n_bytes"]): r for r in token_counts.count_tokens(df, "doc_id", "text", 5).collect()}
    for r in df.collect():
        text = r["text"] or ""
        ids = lib.encode_ordinary(text)
        got = rows[r["doc_id"], len(ids)]
        assert got["ids_sha256"] == bpe.digest(ids) and got["decoded_sha256"] == brute.sha(text)
        n = len(tok.encode(text, add_special_tokens=False).ids)
        cut = counted[r["doc_id"], n, len(text.encode())]["budget_bytes"]
        assert len(tok.encode(text.encode()[:cut].decode(), add_special_tokens=False).ids) <= 5
    assert bpe.token_digests(brute.empty(spark), "doc_id", "text").collect() == []
    assert token_counts.count_tokens(brute.empty(spark), "doc_id", "text").collect() == []
