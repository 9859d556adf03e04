"""Filter audit, phrase mining and exact duplicates against brute force, and on awkward input."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from proofgrid.llm import exactdedup, filteraudit, golomb, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# A clash of names with what the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, block int, digest string, part string, share int, n long, mask int"
LABELS = "doc_id long, quality int, toxic int, good int, part string"


def rows_of(texts, **given):
    return [
        (given.get("ids", range(len(texts)))[i], t, ["en", "fr", None][i % 3], ["a", None, "b"][i % 5 % 3], 1, "d", "p", 2, 3, 4)
        for i, t in enumerate(texts)
    ]


def texts_for(seed, n=150):
    rng = random.Random(seed)
    pool = "the Of a cat DOG Éa x1 # runs $ over lazy und der".split()
    made = [" ".join(rng.choice(pool) for _ in range(rng.choice((0, 1, 3, 49, 50, 51, 90)))) for _ in range(n)]
    made += ["".join(rng.choice("ab. \t\n,C") for _ in range(40)) for _ in range(n // 3)]
    made += [rng.choice(made) for _ in range(n)]
    return [*made, None, "", "", " \n\t ", "x" * 70_000, "Ab " * 30_000, "ab " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    texts = texts_for(3)
    ids = [*range(len(texts) - 6), 5, 5, None, None, 3, 2**40]
    return spark.createDataFrame(rows_of(texts, ids=ids), DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- Golomb codes -------------------------------------------------------------------------------------------------


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 100, 5000):
        for top in (1, 2, 1 << 20, (1 << 64) - 1):
            values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
            code = golomb.encode(values)
            assert np.array_equal(golomb.decode(code), values)
            if n == 5000 and top == 1 << 20:
                assert len(code) < 1.3 * n * np.log2(top / n) / 8 + 20  # near the entropy of such a set
    lopsided = np.array([0, *range(1 << 40, (1 << 40) + 1000), 1 << 63], np.uint64)
    assert np.array_equal(golomb.decode(golomb.encode(lopsided)), lopsided)


# --- Exact duplicates ---------------------------------------------------------------------------------------------


def brute_duplicates(rows):
    groups = collections.defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(LOWER)].append(doc)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [None, 16, 1, 64])
def test_exact_duplicates(docs, bits):
    """With one bit, almost every row is a suspect, so texts must be told apart by their bytes."""
    found = exactdedup.exact_duplicates(docs, bits=bits)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, found.collect()), key=str) == brute_duplicates(rows)


def test_exact_duplicates_of_nothing_and_of_one_text(spark, empty):
    assert exactdedup.exact_duplicates(empty).count() == 0
    same = spark.createDataFrame([(i, "Same") for i in range(3000)], "doc_id long, text string").repartition(7)
    found = exactdedup.exact_duplicates(same)
    assert {(r["keep_id"], r["group_size"]) for r in found.collect()} == {(2999, 3000)}
    assert found.filter("kept").count() == 1


def test_only_suspects_are_sent_and_owners_do_not_grow_with_partitions(spark, docs):
    blocks = exactdedup.hashed_blocks(docs.select("doc_id", "text")).persist()
    codes = exactdedup.sent(blocks, 40, 3).collect()
    assert len(codes) <= 3 * blocks.count()
    sent = [int(p) for c in codes for p in golomb.decode(bytes(c["code"]))]
    texts = {exactdedup.normalised(r["text"]) for r in docs.select("text").collect()}
    expected = {int.from_bytes(hashlib.sha256(t).digest()[:8], "big") >> 24 for t in texts}
    assert set(sent) == expected
    blocks.unpersist()


def test_fingerprints_follow_the_rows():
    assert exactdedup.fingerprint_bits(0) == 16
    assert exactdedup.fingerprint_bits(10**6) == 32
    assert exactdedup.fingerprint_bits(10**18) == 64


# --- Filter audit -------------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    """Documents one after another through every order."""
    good, toxic = collections.defaultdict(bool), collections.defaultdict(bool)
    for doc, quality, bad in labels:
        if doc is not None:
            good[doc] |= quality == 1
            toxic[doc] |= bad == 1
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    kinds = []
    for doc, text, source in rows:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(ws) < 50:
            fails.add("A")
        if 100 * len(set(ws)) < 65 * len(ws):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if doc is not None and doc > least[text]:
            fails.add("E")
        kinds.append((source or "", fails, good.get(doc, False), toxic.get(doc, False)))
    out = {}
    shapley = collections.Counter()
    for order in itertools.permutations("ABCDE"):
        for part in {k[0] for k in kinds}:
            left = [k for k in kinds if k[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                here = [k for k in left if letter in k[1]]
                redundant = sum(letter in k[1] for k in gone)
                left = [k for k in left if letter not in k[1]]
                gone += here
                shapley[part, letter] += len(here)
                alone = sum(k[0] == part and k[1] == {letter} for k in kinds)
                out[part, "".join(order), step] = [
                    len(left), len(here), redundant, alone, sum(k[2] for k in here), sum(k[3] for k in here)
                ]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_filter_audit(spark, docs, empty):
    rng = random.Random(8)
    labels = [(rng.choice([None, *range(200)]), rng.choice([0, 1, None]), rng.choice([0, 1]), 1, "x") for _ in range(150)]
    table = spark.createDataFrame(labels, LABELS)
    found = filteraudit.audit_documents(docs, table).collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    expected = brute_audit(rows, [x[:3] for x in labels])
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found} == expected and len(found) == len(expected)
    assert filteraudit.audit_documents(empty, table).count() == 0
    without = filteraudit.audit_documents(docs, spark.createDataFrame([], LABELS))
    assert without.filter("good_lost + toxic_lost > 0").count() == 0 and without.count() == len(expected)


def test_removal_steps_are_the_first_failing_filter():
    steps = filteraudit.removal_steps(3)
    orders, _ = filteraudit.places(3)
    for mask in range(8):
        for o, order in enumerate(orders):
            first = next((s for s, f in enumerate(order, 1) if mask >> f & 1), filteraudit.NEVER)
            assert steps[mask, o] == first


def test_audit_of_other_filters(spark):
    """Any number of filters: what is removed in total does not depend on the order."""
    counts = spark.createDataFrame([("p", m, 5 + m, 1, 0) for m in range(8)], "part string, mask int, n long, good long, toxic long")
    rows = filteraudit.audit(counts, "XYZ").collect()
    assert len(rows) == 6 * 3
    totals = collections.Counter()
    for r in rows:
        totals[r["filter_order"]] += r["removed"]
    assert set(totals.values()) == {sum(5 + m for m in range(1, 8))}


# --- Phrases ------------------------------------------------------------------------------------------------------


def brute_phrases(rows, threshold, top=2000):
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                counts[lang or "und"].update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, f in counts.items():
        total = sum(c for g, c in f.items() if len(g) == 1)
        cand = {g: c for g, c in f.items() if len(g) > 1 and c >= threshold}
        found = []
        for g, a in cand.items():
            if any(
                len(h) > len(g) and 100 * c >= 50 * a and any(h[i : i + len(g)] == g for i in range(len(h)))
                for h, c in cand.items()
            ):
                continue
            score, _, l, r = min(
                (10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g))
            )
            found.append((" ".join(g), a, l, r, total, score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, rank, *x) for rank, x in enumerate(found[:top], 1)]
    return sorted(out)


def answer(found):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect())


@pytest.mark.parametrize("threshold,top,filter_bytes", [(10, 2000, 1 << 20), (2, 7, 1 << 20), (3, 50, 8)])
def test_phrases(docs, threshold, top, filter_bytes):
    """A filter that is far too small lets everything pass and changes nothing."""
    found = phrases.collocations(docs, threshold, top, filter_bytes=filter_bytes)
    rows = [tuple(r) for r in docs.select("text", "lang").collect()]
    expected = brute_phrases(rows, threshold, top)
    assert answer(found) == expected and expected


def test_phrases_of_nothing(spark, empty):
    assert phrases.collocations(empty).count() == 0
    blank = spark.createDataFrame([(None, None), ("", "en"), (".,;", "en")], "text string, lang string")
    assert phrases.collocations(blank, 1).count() == 0


def test_slices_never_cut_a_piece():
    rng = random.Random(5)
    for _ in range(50):
        text = "".join(rng.choice("ab  .\n") for _ in range(rng.randint(0, 80))).encode()
        parts = list(phrases.slices(text, 7))
        assert b"".join(parts) == text
        assert all(p[-1:] in b".\n" for p in parts[:-1])


def test_summaries_keep_what_is_frequent_and_are_mergeable():
    rng = np.random.default_rng(6)
    for threshold in (3, 10):
        keys = np.concatenate([rng.integers(0, 50, 400), rng.integers(50, 10**6, 4000)]).astype(np.uint64)
        rng.shuffle(keys)
        summary = phrases.Summary(len(keys) // threshold + 1)
        for part in np.array_split(keys, 13):
            summary.merge(*np.unique(part, return_counts=True))
            assert len(summary.keys) <= summary.capacity
        values, counts = np.unique(keys, return_counts=True)
        assert summary.error < threshold
        assert set(values[counts >= threshold].tolist()) <= set(summary.frequent(threshold).tolist())


def test_counts_of_grams():
    text = b"A b. a  b\tc\nb c a b c"
    grams = phrases.Grams([text, b"", b"c"])
    named = {
        tuple(grams.words[i].decode() for i in m): int(c)
        for members, counts in zip(grams.members, grams.counts, strict=True) for m, c in zip(members, counts, strict=True)
    }
    assert named == {
        ("a",): 3, ("b",): 4, ("c",): 4, ("a", "b"): 3, ("b", "c"): 3, ("c", "a"): 1,
        ("a", "b", "c"): 2, ("b", "c", "a"): 1, ("c", "a", "b"): 1,
    }
    assert grams.n_words == 11
