"""Operator 13: patterns against plain expressions, the field against enumeration, held-out lines, awkward rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from grantlens.llm import pii
from grantlens.llm.pii_examples import labelled_lines
from tests.llm import brute


def plain_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                twice = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or twice % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), pii.KINDS.index(kind), m.end()))
    return sorted(out)


def test_patterns_match_plain_expressions():
    rng = random.Random(4)
    for alphabet, size in (("019.", 40), ("0123456789 -", 60), ("+12 ().-", 40), ("a@.-é ", 40), ("a1@.+ -(", 60)):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, size)))
            assert pii.base_spans(text) == plain_spans(text), text
    for line in labelled_lines(300, 8):
        text = "".join(p for p, _ in line)
        assert pii.base_spans(text) == plain_spans(text)
    for text in ("1" * 300_000, "a" * 300_000, "1.256.3.4.5.6.7.8", "é" + "9" * 5000 + ".1.1.1", "+1" * 100_000, "0" * 500 + "1.1.1.1", "a" * 300_000 + " @", "@" * 100_000):
        assert len(pii.base_spans(text)) <= 1


def small_field(seed):
    rng = np.random.default_rng(seed)
    return pii.Field(rng.normal(size=(pii.FEATURES, 256, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)))


def test_viterbi_matches_enumeration():
    field, rng = small_field(1), np.random.default_rng(2)
    length = np.array([1, 4, 2, 3, 4, 1])
    features = rng.integers(0, 256, (pii.FEATURES, length.sum())).astype(np.uint8)
    got, at = field.viterbi(features, length), 0
    for n in length:
        each = field.scores(features[:, at:at + n])
        best = max((p for p in itertools.product(range(pii.LABELS), repeat=int(n)) if p[0] in (0, 1, 3, 5, 7)),
                   key=lambda p: sum(each[i, x] for i, x in enumerate(p)) + sum(field.steps[a, b] for a, b in itertools.pairwise(p)))
        assert tuple(got[at:at + n]) == best
        assert field.path(features[:, at:at + n], got[at:at + n]) > -1e6
        at += n


def test_likelihood_matches_enumeration_and_its_gradient():
    rng = np.random.default_rng(5)
    weights, steps = rng.normal(size=(pii.FEATURES, 256, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS))
    length, labels = np.array([3, 1, 2]), np.array([0, 1, 2, 0, 3, 0])
    features = rng.integers(0, 256, (pii.FEATURES, 6)).astype(np.uint8)
    value, grad, moved = pii.likelihood(weights, steps, features, length, labels)
    field, want, at = pii.Field(weights, steps), 0.0, 0
    for n in length:
        each = field.scores(features[:, at:at + n])

        def score(p, each=each):
            return sum(each[i, x] for i, x in enumerate(p)) + sum(field.steps[a, b] for a, b in itertools.pairwise(p))
        every = [score(p) for p in itertools.product(range(pii.LABELS), repeat=int(n)) if p[0] in (0, 1, 3, 5, 7)]
        want += score(labels[at:at + n]) - np.logaddexp.reduce(every)
        at += n
    assert value == pytest.approx(want)
    for f, x, k in ((0, features[0, 1], 1), (3, features[3, 0], 0), (8, features[8, 4], 3)):
        more = weights.copy()
        more[f, x, k] += 1e-5
        assert (pii.likelihood(more, steps, features, length, labels)[0] - value) / 1e-5 == pytest.approx(grad[f, x, k], abs=1e-3)
    more = steps.copy()
    more[1, 2] += 1e-5
    assert (pii.likelihood(weights, more, features, length, labels)[0] - value) / 1e-5 == pytest.approx(moved[1, 2], abs=1e-3)


@pytest.fixture(scope="module")
def field():
    return pii.train(labelled_lines(pii.ROWS, pii.SEED))


def test_held_out_lines(field):
    lines = labelled_lines(500, 77)
    texts = ["".join(p for p, _ in line) for line in lines]
    raw = [t.encode() for t in texts]
    found = pii.added_spans(field, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    right = wrong = missed = more = 0
    for i, (line, text) in enumerate(zip(lines, texts)):
        at, want = 0, set()
        for piece, kind in line:
            if kind:
                want.add((at, pii.KINDS.index(kind), at + len(piece)))
            at += len(piece)
        got = set(found.get(i, ()))
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
        more += len(want & got - set(pii.base_spans(text)))
    assert right / (right + missed) > 0.9 and wrong / (right + wrong) < 0.02
    assert more > 50  # what no pattern finds


def test_long_texts_and_batches_give_what_single_texts_give(field):
    texts = ["call (212) 555-0147 now", "", "x " * 3000 + "anna(at)mail.example.com." + " y" * 10, "1 2 3 " * 2000, "Ää +1 (555) 200-1234é (212) 555-0147\n(212)\n555-0147"]
    raw = [t.encode() for t in texts]
    both = pii.added_spans(field, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, b in enumerate(raw):
        assert pii.added_spans(field, np.frombuffer(b, np.uint8), np.array([0, len(b)])).get(0) == both.get(i)
    assert [texts[0][a:b] for a, _, b in both[0]] == ["(212) 555-0147"] and [texts[2][a:b] for a, _, b in both[2]] == ["anna(at)mail.example.com"]


def test_awkward_and_empty_tables(spark, field):
    df = brute.awkward(spark, [(1, "é mail x.y@z.org, or (212) 555-0147"), (2, "4111 1111 1111 1111 or 4111/1111/1111/1111")])
    rows = pii.find_personal(df, "doc_id", "text", field).collect()
    assert len(rows) == df.count()
    got = {r["doc_id"]: r for r in rows}
    assert [tuple(s) for s in got[1]["base"]] == [(7, "email", 16)]
    assert [tuple(s) for s in got[1]["spans"]] == [(7, "email", 16), (21, "phone", 35)]
    assert [s["kind"] for s in got[2]["base"]] == ["card"] and len(got[2]["spans"]) == 2
    assert got[900_001]["base"] == got[900_001]["spans"] == [] and got[900_004]["base"] == []
    assert pii.find_personal(brute.empty(spark), "doc_id", "text", field).collect() == []
    one = pii.labelled_table(spark, 30, 1)
    assert np.allclose(pii.fit(one).weights, pii.train(labelled_lines(30, 1)).weights)
    assert pii.train([]).weights.sum() == 0


def test_query_matches_plain_expressions(spark):
    path = "/root/testdata/sf0.01"
    want = {r["doc_id"]: plain_spans(r["text"] or "") for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    rows = pii.op13_personal_data(spark, path).collect()
    assert len(rows) == len(want)
    for r in rows:
        spans = want[r["doc_id"]]
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in spans) for i in range(4)]
        assert set(text.split(",")) - {""} <= set(r["spans"].split(","))
        if not spans:
            assert r["spans"] == ""  # made-up prose without personal data stays alone
