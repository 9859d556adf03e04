"""The stages of the corpus pipeline, each on awkward input and against brute force."""

import collections
import os
import random
import re

import pytest

import corpus_pipeline as pipeline
from proofgrid.llm import quality

# The columns of documents and some that clash with names inside the operators.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, block int, n long, id string, host string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rng, n):
    return " ".join(rng.choice("the of and house town water people river they stone light with from".split()) + rng.choice(["", "", "s"]) for _ in range(n))


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "src1", 1, "r", 2, 3, 4, "i", "h")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(31)
    good = [sentence(rng, rng.randint(80, 200)) for _ in range(40)]
    near = [" ".join(g.split()[:-3] + ["one", "more", "end"]) for g in good[:10]]
    return [*good, *near, good[3], None, "", " \n\t", "# " * 300, "short text", sentence(rng, 40_000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [row(i, t, "en" if i % 4 else None) for i, t in enumerate(texts)]
    rows += [row(None, texts[5]), row(None, None), row(7, texts[7]), row(7, texts[7])]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def kept(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_stages_of_nothing(spark, empty, name):
    out = dict(pipeline.STAGES)[name](spark, empty, "")
    assert out.count() == 0
    if name != "packing":
        assert out.columns == empty.columns


def test_quality_stage_equals_its_operator(spark, docs, texts):
    out = pipeline.quality_rules(spark, docs, "")
    assert out.columns == docs.columns
    verdicts = {(r["doc_id"], r["kept"]) for r in quality.query(docs).collect()}
    got = kept(out)
    assert {i for i, _ in got} == {i for i, ok in verdicts if ok}
    assert got[7, texts[7]] == 3 and got[None, texts[5]] == 1 and got[None, None] == 0
    words = {t: WORD.findall(t or "") for t in texts}
    assert all(len(words[t]) >= 50 for _, t in got)


def test_language_stage(spark, docs, texts):
    out = pipeline.language_id(spark, docs, "")
    got = kept(out)
    assert out.columns == docs.columns
    assert all(got[i, t] for i, t in enumerate(texts[:40]))  # prose stays, declared or not
    assert not any(t is None or not t.strip() for _, t in got)
    assert got[7, texts[7]] == 3 and got[None, texts[5]] == 1


def shingles(text):
    ws = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def test_near_duplicate_stage_equals_brute_force(spark, docs, texts):
    got = kept(pipeline.near_duplicates(spark, docs, ""))
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    expected = collections.Counter((i, t) for i, t in enumerate(texts) if find(i) == i)
    expected.update([(None, texts[5]), (None, None)])
    assert got == expected


def test_packing_stage_packs_every_token(spark, docs):
    rows = pipeline.pack(spark, docs, "").collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len((r["text"] or "").encode()) + 1 for r in docs.collect())
    batches = collections.defaultdict(list)
    for r in rows:
        batches[r["batch"]].append(r)
    for members in batches.values():
        assert len({r["bucket"] for r in members}) == 1
        assert len(members) * members[0]["bucket_tokens"] <= 65_536
        assert sorted(r["slot"] for r in members) == list(range(len(members)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="tables not present")
def test_run_is_its_stages_one_after_another(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    ids = {r["doc_id"] for r in docs.collect()}
    rows = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in rows} == ids and ids
