"""Operators 5, 7 and 10, and the pipeline."""

import collections
import gzip
import random

import numpy as np
import pytest

import corpus_pipeline
from grantlens.llm import decontam, licenses, warc
from grantlens.llm.license_texts import TEMPLATES
from grantlens.session import scratch_path
from tests.llm import brute

PAGES = [(1, "u r\nl", "x" * 200), (2, None, "x" * 200), (None, "u", "x" * 200), (3, "u", None), (4, "u", ""), (1, "u", "x" * 200),
         (5, "é", "é\r\n\r\nWARC/1.1\r\nContent-Length: 9"), (6, "u", "y" * 99), (7, "u", "y" * 99), (8, "u", "z" * 100), (9, "u", "z" * 100)]


def test_archives_round_trip(spark):
    path = scratch_path(spark, "warc-test")
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")
    warc.write_archives(df, f"{path}/raw", records=3)
    files = spark.read.format("binaryFile").load(f"{path}/raw").collect()
    assert len(files) > 1
    warc.write_normalised(spark, f"{path}/raw", path)
    members = spark.read.parquet(f"{path}/members")
    got = sorted(((r["id"], r["bytes"], r["digest"], r["type"], r["refers"]) for r in warc.read_records(members).collect()), key=str)
    first = {"x" * 200: 1, "z" * 100: 8}
    want = []
    for i, _, html in PAGES:
        ref = first.get(html)
        ref = None if ref == i else ref
        want.append((i, len((html or "").encode()), brute.sha(html or ""), "revisit" if ref else "response", ref))
    assert got == sorted(want, key=str)
    # Each archive's members, end to end, are the records of the monolithic file; the index finds each alone.
    whole = {f["path"].rsplit("/", 1)[-1]: gzip.decompress(f["content"]) for f in files}
    rows = collections.defaultdict(list)
    for r in members.collect():
        rows[r["archive"]].append(r)
    for name, own in rows.items():
        joined = b"".join(r["member"] for r in sorted(own, key=lambda r: r["offset"]))
        assert gzip.decompress(joined) == whole[name]
        for r in own:
            record = gzip.decompress(joined[r["offset"]:r["offset"] + r["length"]])
            assert warc.parse(record)["warc-record-id"] == r["id"]
    index = spark.read.parquet(f"{path}/index")
    assert index.count() == len(PAGES) and "member" not in index.columns


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        warc.inflate(gzip.compress(b"WARC/1.1\r\n" * 50)[:-9])
    with pytest.raises(ValueError):
        list(warc.split_records(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nabc\r\n\r\n"))


def test_empty_pages(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{path}/raw")
    warc.write_normalised(spark, f"{path}/raw", path)
    assert warc.read_records(spark.read.parquet(f"{path}/members")).collect() == []


def test_local_alignment_matches_the_recurrence():
    rng = np.random.default_rng(3)
    pairs = [(rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64), rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    score, _ = decontam.local_alignment([x for x, _ in pairs], [y for _, y in pairs])
    assert score.tolist() == [brute.local_alignment(x.tolist(), y.tolist()) for x, y in pairs]


def leaks(spark):
    rng = random.Random(11)
    names = [f"term{i}" for i in range(3000)] + ["the", "of", "and", "to"] * 400
    items = [(i, " ".join(rng.choice(names) for _ in range(rng.randint(12, 40)))) for i in range(30)] + [(90, "too short"), (91, None), (92, "")]
    docs, planted = [], set()
    for d in range(200):
        w = [rng.choice(names) for _ in range(rng.randint(20, 300))]
        if d % 3 == 0:
            k, item = items[rng.randrange(30)]
            own = item.split()
            for _ in range(int(len(own) * rng.choice([0, 0.1, 0.2]))):
                own[rng.randrange(len(own))] = "edited"
            if rng.random() < 0.3:
                own.insert(len(own) // 2, "inserted")
            a = rng.randint(0, len(w))
            w[a:a] = [x.upper() + "," for x in own] if rng.random() < 0.3 else own
            planted.add((d, k))
        docs.append((d, " ".join(w)))
    return docs, spark.createDataFrame(items, "item_id long, text string"), planted


@pytest.mark.parametrize("block", [1 << 25, 2000])
def test_planted_items_are_found_and_nothing_else(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "ITEM_BYTES", block)
    docs, items, planted = leaks(spark)
    df = brute.awkward(spark, docs)
    found = decontam.find_leaks(df, "doc_id", "text", items).collect()
    assert {(r["doc_id"], r["item"]) for r in found} == planted
    text = dict(docs)
    for r in found:
        got = decontam.words_of_texts([text[r["doc_id"]]])[0][r["start"]:r["end"]]
        item = decontam.words_of_texts([next(x["text"] for x in items.collect() if x["item_id"] == r["item"])])[0]
        assert brute.local_alignment(item.tolist(), got.tolist()) == pytest.approx(r["score"] * 2 * len(item))
    clean = decontam.without_leaks(df, "text", items)
    assert clean.columns == df.columns
    assert clean.count() == df.count() - len({d for d, _ in planted})


def test_no_items_and_no_documents(spark):
    docs, items, _ = leaks(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert decontam.find_leaks(df, "doc_id", "text", none).collect() == []
    assert decontam.without_leaks(df, "text", none).count() == len(docs)
    assert decontam.find_leaks(brute.empty(spark), "doc_id", "text", items).collect() == []


def test_licences(spark):
    texts = {n: t for n, t, _ in TEMPLATES}
    mit = texts["MIT"].split()
    rows = [(0, "foo é bar " + " ".join(mit) + " tail"), (1, "x " + " ".join(mit[:40] + ["new", "words"] + mit[45:]) + " y"),
            (2, " ".join(mit[:50])), (3, "Released under the BSD License."), (4, "Licensed under the apache license version 2.0 " * 2),
            (5, "nothing at all"), *((100 + i, f"before {t} after") for i, (_, t, _) in enumerate(TEMPLATES))]
    df = brute.awkward(spark, rows)
    found = collections.defaultdict(list)
    text = dict(rows)
    for r in licenses.find_licenses(df, "doc_id", "text").collect():
        found[r["doc_id"]].append((r["license"], r["coverage"], text[r["doc_id"]][r["start"]:r["end"]]))
    assert found[0] == [("MIT", 1.0, " ".join(mit)[:-1])]
    assert found[1][0][0] == "MIT" and 0.9 < found[1][0][1] < 1
    assert [x[0] for x in found[4]] == ["Apache-2.0-notice"] * 2
    assert not found[2] and not found[3] and not found[5]
    for i, (name, *_) in enumerate(TEMPLATES):
        assert [(x[0], x[1]) for x in found[100 + i]] == [(name, 1.0)]
    assert not [k for k in found if k is None or k > 900_000]
    assert licenses.find_licenses(brute.empty(spark), "doc_id", "text").collect() == []


def test_licences_that_differ_in_a_word_are_told_apart(spark):
    texts = {n: t for n, t, _ in TEMPLATES}
    rows = {"AGPL-3.0-header": texts["AGPL-3.0-header"], "GPL-2.0-header": texts["GPL-2.0-header"], "LGPL-2.1-header": texts["LGPL-2.1-header"],
            "BSD-3-Clause-excerpt": texts["BSD-3-Clause-excerpt"], "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
            "CC-BY-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
            "MIT-excerpt": " ".join(texts["MIT"].split()[:130]),
            "": texts["GPL-3.0-header"].replace("version 3", "version 1"),
            None: "This work is licensed under a Creative Commons Attribution 3.0 International License."}
    df = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(rows.values())], "doc_id long, text string")
    found = collections.defaultdict(list)
    for r in licenses.find_licenses(df, "doc_id", "text").collect():
        found[r["doc_id"]].append(r["license"])
    for i, name in enumerate(rows):
        assert found[i] == ([name] if name else []), (name, found[i])


def plain_local(template, words):
    """Most score (and its matches) of a local alignment, over all cells."""
    best = (0, 0)
    row = [(0, 0)] * (len(words) + 1)
    for a in template:
        new = [(0, 0)]
        for j, b in enumerate(words):
            step = (row[j][0] + (2 if a == b else -1), row[j][1] + (a == b))
            top = max(step, (row[j + 1][0] - 1, row[j + 1][1]), (new[j][0] - 1, new[j][1]))
            new.append(top if top[0] > 0 else (0, 0))
            best = max(best, new[-1])
        row = new
    return best


def test_banded_alignment_matches_all_cells():
    rng = random.Random(12)
    for _ in range(60):
        template = [rng.randint(1, 9) for _ in range(rng.randint(3, 25))]
        words = [w for w in template if rng.random() > 0.1]
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randint(0, len(words)), rng.randint(1, 9))
        words = [rng.randint(10, 19) for _ in range(rng.randint(0, 6))] + words + [rng.randint(10, 19) for _ in range(rng.randint(0, 6))]
        (matched, first, last), = licenses.banded([np.array(template, np.uint64)], np.array(words, np.uint64), [(0, len(words))], [(-len(template), len(words))])
        assert matched == plain_local(template, words)[1]
        assert plain_local(template, words[first:last]) == plain_local(template, words)


def test_pipeline_stages_follow_each_other(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, sf), "test")
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "quality":
            assert all(len(brute.words(r["text"])) >= 50 for r in after.values())
        elif name == "near_duplicates":
            groups = brute.jaccard_components([(i, r["text"]) for i, r in before.items()])
            assert set(after) == {i for i, (_, c) in groups.items() if c == i}
        elif name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert {i for i, r in before.items() if any(x in r["text"] for x in items)}.isdisjoint(after)
            assert all(after[i] == before[i] for i in after)
        else:
            assert set(after) == set(before) and not any(brute.base_secrets(r["text"]) for r in after.values())
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in final} == set(after) and set(after) < ids
    assert all(r["decoded_sha256"] == brute.sha(after[r["doc_id"]]["text"]) for r in final)


def test_pipeline_on_empty_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = brute.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "test-empty")
    assert docs.count() == 0


def test_near_duplicates_take_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(100)]
    edited = [w + "x" if i in (30, 70) else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(f"v{i}" for i in range(100)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, None).collect()
    assert {r["doc_id"] for r in kept} == {i for i, (_, c) in brute.jaccard_components(rows, 5, 80).items() if i == c} == {1, 3}
    assert len({c for _, c in brute.jaccard_components(rows).values()}) == 3


def test_short_and_common_items_and_their_look_alikes(spark):
    common = "the of and to in a is it on as at by".split()
    rng = random.Random(4)
    filler = [(100 + i, " ".join(rng.choice(common) + f" z{i}x{j}" for j in range(60))) for i in range(60)]
    items = [(1, "zebra quartz violin harbor comet"), (2, "amber falcon ridge"), (3, "lunar pepper canyon drift ember silk mango otter"),
             (4, "the of and to in a is it on as at by")]
    docs = [(1, "x zebra quartz violin harbor comet y"), (2, "x zebra quartz nothing else here"), (3, "an Amber, falcon ridge."),
            (4, "amber falcon and ridge"), (5, "lunar pepper canyon alone"), (6, "see lunar pepper canyon EDIT ember silk mango otter"),
            (7, "q q the of and to in EDIT is it on as at by q"), (8, "zebra quartz EDIT harbor comet"), *filler]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontam.find_leaks(df, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item"]) for r in found} == {(1, 1), (3, 2), (6, 3), (7, 4), (8, 1)}


def test_no_single_edit_removes_every_seed():
    for n in range(5, 30):
        words = np.arange(n, dtype=np.uint64) + np.uint64(1)
        seeds = decontam.Seeds([words], words, np.full(n, 10**6), 10**7)  # frequent words: no n-gram is rare
        for edit in range(n):
            text = words.copy()
            text[edit] = 999
            assert seeds.windows(text, np.array([0, n])), (n, edit)
