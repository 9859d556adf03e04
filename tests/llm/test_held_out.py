"""Operators without an SQL form on rows that they were not made from, and the entry with and without the package."""

import collections
import itertools
import os
import random
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofgrid.llm import crf, langid, licences, sharding, sigtree

ROOT = Path(__file__).resolve().parents[2]
FOLDER = "/root/testdata/sf0.01"
there = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")

# --- licences ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return licences.fit()


def families(spark, texts, model):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["family"] for r in licences.documents(df, model).collect()}
    return [found[i] for i in range(len(texts))]


def test_other_and_negated_licences_are_unknown(spark, model):
    want = {
        "Licensed under the Mozilla Public License 2.0.": None,
        "Released under the ISC License.": None,
        "Licensed under the MIT-like Foo License.": None,
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, version 3.": None,
        "This work is not licensed under the GNU General Public License, version 3.": None,
        "This program is not released under the MIT License.": None,
        "Code released under GPLv3.": "GPL",
        "This software is distributed under the terms of the MIT licence.": "MIT",
        "All content is available under CC BY-NC-SA 4.0.": "CC-BY-NC",
        "Our library is provided under the Apache 2.0 license.": "Apache-2.0",
        "The code is covered by the new BSD license.": "BSD",
        "He studied at MIT and drove without a license.": None,
    }
    assert dict(zip(want, families(spark, list(want), model), strict=True)) == want


def test_held_out_notices(spark, model):
    """Wordings that were not trained on, whole, inside a sentence and wrapped: precision and recall."""
    rng = random.Random(12)
    rows = rng.sample(licences.wordings(True, rng), 400)
    texts = []
    for i, (tokens, _) in enumerate(rows):
        line = " ".join(tokens).capitalize() + "."
        if i % 3 == 1:
            line = f"We met at noon. {line} He left early."
        if i % 3 == 2:
            cut = len(tokens) // 2
            line = "Some words here.\n\n" + " ".join(tokens[:cut]) + "\n" + " ".join(tokens[cut:]) + "\n\nMore words."
        texts.append(line)
    want = [None if f == licences.UNKNOWN else f for _, f in rows]
    found = families(spark, texts, model)
    said, right = sum(f is not None for f in found), sum(f is not None and f == w for f, w in zip(found, want, strict=True))
    assert right / said >= 0.95 and right / sum(w is not None for w in want) >= 0.95


def test_repeated_rows_and_ids_do_not_change_answers(spark, model):
    notice = "Code released under the MIT license terms."
    rows = [(1, notice), (2, notice), (2, notice), (2, notice), (3, "Released under GPLv3."), (3, notice), (None, notice), (None, notice)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = licences.documents(df, model).collect()
    assert len(found) == len(rows)
    one = {tuple(r)[1:] for r in found if r["doc_id"] != 3}
    assert len(one) == 1
    assert {r["family"] for r in found if r["doc_id"] == 3} == {"GPL", "MIT"}
    long = "word " * 30_000 + "released under the MIT license " + "word " * 30_000
    assert families(spark, [long, "x" * 200_000], model) == ["MIT", None]


def test_only_known_ngrams_are_looked_up(spark, model):
    """All of a line's known n-grams are found, and what is looked up does not grow with its unknown words."""
    known, rng = sorted(licences._grams(model)), random.Random(5)
    texts = ["", "--", "mit", "the, mit-license", "the mit mit license mit license", "xmit license", "apachelicense 2.0", "école mit"]
    for _ in range(50):
        parts = [rng.choice((rng.choice(known), f"zq{rng.randrange(10**6)}")) for _ in range(rng.randrange(1, 80))]
        texts.append("".join(part + rng.choice((" ", ", ", ". ", "-", " é ")) for part in parts))
    texts.append(" ".join(f"zq{i}" for i in range(20_000)) + " released under the mit license")
    df = spark.createDataFrame(list(enumerate(texts)), "i long, line string")
    units = df.select("i", licences._known_words(F.col("line"), model).alias("tokens"))
    found = {r["i"]: r["grams"] for r in units.select("i", licences._ngrams(F.col("tokens")).alias("grams")).collect()}
    for i, text in enumerate(texts):
        want = licences._features(licences._tokens(text))
        assert want & set(known) == set(found[i]) & set(known)
        assert set(found[i]) <= want | {None} and len(found[i]) == len(set(found[i]))
    assert len(found[len(texts) - 1]) <= 10


# --- main text ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def field():
    return crf.fit(crf.training_pages())


def page(*inside):
    return (
        "<html><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News of today</a></ul></nav><article><h1>On energy</h1>"
        + "".join(inside) + "</article><footer>&copy; example &middot; All rights reserved.</footer></body></html>"
    )


def test_text_of_the_article_stays(field):
    first = "<p>It was a long day, and many words were said about it in the end.</p>"
    lines = ["On energy", "It was a long day, and many words were said about it in the end."]
    for inner, text in (
        ("<p>Energy is <math><mi>E</mi>=mc</math> always.</p>", "Energy is E=mc always."),
        ("<p>See <object data=x>the drawing of it</object> here.</p>", "See the drawing of it here."),
        ("<p>A mark <svg><text>of some size</text></svg> stands here.</p>", "A mark of some size stands here."),
        ("<p><a href='/x'>The whole sentence is a link to another place.</a></p>", "The whole sentence is a link to another place."),
        ("<p class='share'>We share what we have with all who come to us.</p>", "We share what we have with all who come to us."),
        ("<p class='advert'>The word was coined long before the press was.</p>", "The word was coined long before the press was."),
    ):
        assert crf.main_text(field, page(first, inner, first)).split("\n") == [*lines, text, lines[1]], inner


def test_held_out_pages(field):
    pages = list(crf.training_pages(150, seed=91))
    wrong = sum(int((np.array(crf.viterbi(field, b)) != labels).sum()) for b, labels in pages)
    assert wrong / sum(len(labels) for _, labels in pages) < 0.03


def test_deep_and_long_pages_cost_their_length(field):
    start = time.monotonic()
    deep = crf.leaf_blocks("<div class=a>x" * 100_000, field.names)
    assert len(deep) == 100_000 and time.monotonic() - start < 20
    assert len(crf.leaf_blocks("<b><i>" * 50_000 + "</p></u>" * 50_000 + "x")) == 1
    long = "<p>" + "word " * 400_000 + "</p>"
    assert len(crf.leaf_blocks(long)[0].text) == 5 * 400_000 - 1
    assert crf.main_text(field, page("<p>" + "Many words. " * 50_000 + "</p>")).count("Many words.") == 50_000


# --- shards ------------------------------------------------------------------------------------------------------


def brute_capacity(sizes, shards):
    """The smallest largest shard of a contiguous partition."""
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        used, room = 1, middle
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("kind", range(5))
def test_shards_are_minimax_and_none_is_empty(spark, kind):
    rng = random.Random(kind)
    sizes = {
        0: [5] * 41, 1: [rng.randint(1, 50) for _ in range(300)], 2: [7] * 12,
        3: [rng.randint(1, 9) for _ in range(80)] + [4000], 4: [rng.choice((1, 1, 1, 60)) for _ in range(100)],
    }[kind]
    rows = [(i, g, s) for i, (g, s) in enumerate((f"g{n}", s) for n, s in enumerate(sizes))]
    table = spark.createDataFrame(rows, "id long, g string, size long").persist()
    found = sharding.assign_shards(table, "g", "size", "id", 40).collect()
    loads, members = collections.Counter(), collections.defaultdict(list)
    for r in found:
        loads[r["shard"]] += r["size"]
        members[r["shard"]].append(r["id"])
    assert len(found) == len(sizes) and len(loads) == min(40, len(sizes)) and max(loads) < 40
    # Groups above an even share come first and alone; the others are cut in their order.
    total, left, rest = sum(sizes), 40, sorted(sizes, reverse=True)
    alone = []
    while rest and left > 1 and rest[0] * left > total:
        alone.append(rest.pop(0))
        total, left = total - alone[-1], left - 1
    if alone:
        assert sorted((loads[i] for i in range(len(alone))), reverse=True) == alone
    others = [s for s in sizes if s not in set(alone)]
    if others:
        assert max(n for s, n in loads.items() if s >= len(alone)) == brute_capacity(others, left)
    ends = [(min(members[s]), max(members[s])) for s in sorted(members) if s >= len(alone)]
    assert all(a[1] < b[0] for a, b in itertools.pairwise(ends))


# --- language ----------------------------------------------------------------------------------------------------


@there
def test_language_of_rows_without_or_with_a_wrong_declaration(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    found = {r["id"]: r["lang"] for r in langid.documents(hidden).collect()}
    asked = [i for i in truth if i % 2]
    assert sum(found[i] == truth[i] for i in asked) >= 0.99 * len(asked)
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 6 == 1, F.when(F.col("lang") == "en", "fr").otherwise("en")).otherwise(F.col("lang")))
    found = {r["id"]: r["lang"] for r in langid.documents(wrong).collect()}
    asked = [i for i in truth if i % 6 == 1]
    assert sum(found[i] == truth[i] for i in asked) >= 0.95 * len(asked)


def test_language_codes(spark):
    tags = {"en": "en", "EN-us": "en", " de_AT ": "de", "deu": "de", "xx": "mis", "qqq-x": "mis", "english": None, "": None, None: None}
    df = spark.createDataFrame([(t,) for t in tags], "t string").select("t", langid.language_code(F.col("t")).alias("code"))
    assert {r["t"]: r["code"] for r in df.collect()} == tags


def test_language_of_pages(spark):
    en, de = "the words of the house and the people in the town were there " * 3, "die Worte und das Haus der Leute in der Stadt waren da und " * 3
    rows = [(i, f"http://h{i % 3}.example.{'de' if i % 2 else 'uk'}/x", f"<html lang={'de-AT' if i % 2 else 'en'}><body><p>{de if i % 2 else en}</p></body></html>") for i in range(40)]
    rows += [
        (100, None, f"<html><title>The</title><p>{de}</p><script>the of and the</script>"), (101, "x", f"<p>{en}"),
        (102, None, None), (103, "u", ""), (104, "u", "<script>the words</script>"), (100, None, None),
        (None, "u", f"<p>{en}" * 3000),
    ]
    found = langid.query_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows)
    langs = collections.defaultdict(set)
    for r in found:
        langs[r["page_id"]].add(r["lang"])
    assert langs[101] == {"en"} and langs[100] == {"de", "und"} and langs[None] == {"en"}
    assert langs[102] == langs[103] == langs[104] == {"und"}
    assert all(langs[i] == {"de" if i % 2 else "en"} for i in range(40))
    nothing = spark.createDataFrame([], "page_id long, url string, html string")
    assert langid.query_pages(nothing).count() == 0


# --- word sets ---------------------------------------------------------------------------------------------------


def test_a_large_group_of_near_copies_sends_few_links(spark, monkeypatch):
    """Copies that differ from each other: cells send fewer links than they have components, and lose none."""
    rng = random.Random(21)
    base = [str(rng.getrandbits(40)) for _ in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for at in rng.sample(range(120), rng.randint(1, 5)):
            own[at] = f"w{rng.getrandbits(30)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = []
    for name in ("remaining_candidates", "dense_links"):
        before = getattr(sigtree, name)
        monkeypatch.setattr(sigtree, name, lambda *a, before=before, **k: made.append(before(*a, **k).persist()) or made[-1])
    found = {r["doc_id"]: r["component_id"] for r in sigtree.near_duplicates(df).collect()}
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in rows}
    links = collections.defaultdict(set)
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            links[a].add(b)
            links[b].add(a)
    for i in sets:
        reach, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        assert found[i] == min(reach)
    edges, links_sent = made
    assert edges.filter("dense").count() >= 100  # this group goes as its members
    assert edges.count() <= 4 * len(rows) and links_sent.count() < len(rows)


# --- entry -------------------------------------------------------------------------------------------------------


def run(code, folder):
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=280, cwd=folder)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


@there
def test_python_queries_run_from_another_folder(tmp_path):
    code = f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", {str(ROOT / "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "c")!r}).getOrCreate())
print("rows", entry.queries()["op13_exact_dedup"](spark, "/root/testdata/sf0.001").count())
"""
    assert "rows" in run(code, tmp_path)


def test_the_other_queries_stay_without_the_vocabulary_files(tmp_path):
    code = f"""
import sys
sys.modules["public_tokenizers"] = None
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
names = entry.queries()
assert len(names) > 160 and not [n for n in names if n.startswith("op")] and "pipeline" not in names
assert set(entry.oracle_sql()) <= set(names)
"""
    run(code, tmp_path)
