"""Each operator against brute force, a round trip or held-out rows, and on awkward input."""

import base64
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import public_tokenizers
import regex
import tiktoken

from proofgrid.llm import bpe, chat, crf, hamming, langid, licences, packing, quality, sharding, sigtree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# A clash of names with what operators use inside, nulls, empty and repeated rows.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, block int, id int"


def words(rng, n):
    return [rng.choice("ab cd efg hi the of jk lm nop qr st uv wx".split()) + rng.choice(["", "a", "b", "c"]) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.choice((1, 3, 4, 5, 40, 120, 400)))) for _ in range(60)]
    for i in range(0, 40, 2):
        copy = texts[i].split(" ")
        copy[rng.randrange(len(copy))] = "Änd's  x\n"
        texts.append(" ".join(copy))
    texts += [None, "", " \n\t", "x" * 5000, texts[3], texts[3], "MiXed " + texts[4], "a\nb\na\n\n", "it's 'tis 12 3\r\n  y"]
    rows = [(i, t, "en" if i % 3 else None, "src.example.de", 1, "r", 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_bucket_ends_are_optimal():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randint(1, 9)
        lengths = np.array(sorted(rng.sample(range(1, 60), n)))
        counts = np.array([rng.randint(1, 50) for _ in range(n)])
        k = rng.randint(1, 4)
        ends, cost = packing.optimal_buckets(lengths, counts, k)
        best = min(
            sum(c * (min(e for e in (*cut, lengths[-1]) if e >= x) - x) for x, c in zip(lengths, counts, strict=True))
            for cut in itertools.combinations(lengths[:-1], min(k, n) - 1)
        )
        assert cost == best and len(ends) <= k and ends[-1] == lengths[-1]
    assert packing.optimal_buckets(np.array([], int), np.array([], int), 3) == ([], 0)


def test_packing_keeps_all_tokens(docs, empty):
    rows = packing.pack(docs, max_tokens=256, buckets=4, budget=1024).collect()
    texts = texts_of(docs)
    per_doc = collections.defaultdict(list)
    for r in rows:
        per_doc[r["doc_id"]].append(r)
        assert r["padding"] == r["bucket_tokens"] - r["n_tokens"] >= 0
    for doc, pieces in per_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        assert sum(r["n_tokens"] for r in pieces) == len(texts[doc].encode()) + 1
        assert [r["start"] for r in pieces] == [256 * i for i in range(len(pieces))]
    assert set(per_doc) == set(texts)
    batches = collections.defaultdict(list)
    for r in rows:
        batches[r["batch"]].append(r)
    assert sorted(batches) == list(range(len(batches)))
    for batch in batches.values():
        assert len({r["bucket"] for r in batch}) == 1 and sum(r["bucket_tokens"] for r in batch) <= 1024
        assert sorted(r["slot"] for r in batch) == list(range(len(batch)))
    assert packing.pack(empty).count() == 0


def test_scan_follows_the_pattern():
    assert bpe.PATTERN == public_tokenizers.PATTERN
    rng = random.Random(1)
    alphabet = ["'", "'", *"strevlmd", " ", " ", "\n", "\t", "é", "1", "２", "!", ".", " ", "　", "\x85", "\x1c", "字", "A", "<"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(5000)] + ["", " ", "'s", "a'"]
    scan = bpe.Scan(texts)
    found = [scan.joined[a:b] for a, b in zip(scan.starts, scan.ends, strict=True)]
    at = 0
    for text, n in zip(texts, scan.counts, strict=True):
        assert found[at : at + n] == regex.findall(bpe.PATTERN, text)
        at += n
    assert len(set(found)) == len(set(scan.keys.tolist()))


def test_bpe_equals_the_library(docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = texts_of(docs)
    rows = {r["doc_id"]: r for r in bpe.query(docs, path).collect()}
    assert set(rows) == set(texts)
    for doc, text in texts.items():
        ids = own.encode_ordinary(text)
        assert rows[doc]["n_tokens"] == len(ids)
        assert rows[doc]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    raw = bpe.read_ranks(path)
    back = bpe.decode(bpe.encode(docs, raw), raw).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in back} == texts
    assert bpe.query(empty, path).count() == 0


def test_language_fusion(spark, empty):
    rng = random.Random(2)
    own = {"en": "the of and that was with this are".split(), "de": "der die und nicht ein für ist schön".split()}
    rows = []
    for i in range(300):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choice(own[lang]) for _ in range(rng.choice((1, 30))))
        rows.append((i, text, lang if i % 3 else None, f"www.{lang}host.{'de' if lang == 'de' else 'uk'}", 1, "", 0, 0))
    rows += [(1000, None, "en", None, 1, "", 0, 0), (1001, "", None, "", 1, "", 0, 0), (1002, "01 10 \x07\x08\x0e" * 40, None, "x", 1, "", 0, 0)]
    rows += [rows[0]]
    found = langid.query(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == len(rows)
    right = sum(r["lang"] == ("en" if r["doc_id"] % 2 else "de") for r in found if r["doc_id"] < 300)
    assert right >= 299
    by_id = {r["doc_id"]: r for r in found}
    assert not any(by_id[i]["kept"] for i in (1000, 1001, 1002))
    kept = langid.keep(spark.createDataFrame(rows, DOCS))
    assert kept.columns == empty.columns and kept.count() == 301
    assert langid.query(empty).count() == 0


def test_every_declared_language_is_known(spark, monkeypatch):
    monkeypatch.setattr(langid, "LEAST", 20, raising=False)
    own = {"en": "the of and that was with", "de": "der die und nicht ein ist", "eo": "kaj estas ĉiuj homoj laŭ digno"}
    rng = random.Random(9)
    langs = ["en"] * 3000 + ["de"] * 1000 + ["eo"] * 3
    rows = [(i, " ".join(rng.choice(own[x].split()) for _ in range(30)), x, None, 1, "", 0, 0) for i, x in enumerate(langs)]
    rows += [(5000, "", "fr", None, 1, "", 0, 0), (5001, "kaj estas homoj kaj laŭ digno estas", None, None, 1, "", 0, 0)]
    df = spark.createDataFrame(rows, DOCS)
    plain = df.selectExpr("doc_id as id", "coalesce(text, '') as text", "lang as declared")
    names, table = langid.fit_text(plain, sample=100)
    assert names == ["de", "en", "eo", "und"] and table.shape == (4, langid.GRAMS)
    whole_names, whole = langid.fit_text(plain)
    assert whole_names == names and np.array_equal(table[2], whole[2]) and not np.array_equal(table[1], whole[1])
    found = langid.identify(df, "doc_id", df.text, df.lang, df.source, sample=100).filter("id >= 4000").collect()
    assert {r["lang"] for r in found if r["id"] in (4000, 4001, 4002, 5001)} == {"eo"}


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 64))
    near = [base[i % 8] + 0.1 * rng.standard_normal(64) for i in range(80)]
    vectors = [*base, *near, base[0], base[0] * 2, base[1]]
    rows = [(i, [float(x) for x in v], i % 2 if i < 120 else 0, "x") for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [None, 1.0], [1.0, 2.0]]
    rows += [(1000 + i, v, 0, "x") for i, v in enumerate(odd)] + [(2000, rows[0][1], None, "x")]
    kind = "vec_id long, embedding array<float>, label int, bucket string"
    found = {r["vec_id"]: r for r in hamming.near_duplicates(spark.createDataFrame(rows, kind)).collect()}
    assert len(found) == len(rows)
    good = [(i, np.float32(v).astype(float), label) for i, v, label, _ in rows if i < 1000]
    links = collections.defaultdict(set)
    for (i, x, p), (j, y, q) in itertools.combinations(good, 2):
        if p == q and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
            links[i].add(j)
            links[j].add(i)
    for i, *_ in good:
        reach, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        assert (found[i]["n_links"], found[i]["component_id"]) == (len(links[i]), min(reach))
        assert found[i]["kept"] == (min(reach) == i)
    for i in [*range(1000, 1006), 2000]:
        assert (found[i]["n_links"], found[i]["component_id"]) == (0, i)
    assert hamming.near_duplicates(spark.createDataFrame([], kind)).count() == 0


def smallest_capacity(sizes, shards):
    def fits(c):
        used, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                used, left = used + 1, c
            left -= s
        return used <= shards

    return next(c for c in range(1, sum(sizes) + 1) if fits(c))


def test_cuts_are_minimax(spark):
    rng = random.Random(5)
    for cells in (64, 1 << 16):
        sizes = [rng.randint(1, 50) for _ in range(60)]
        upto = list(itertools.accumulate(sizes))
        running = spark.createDataFrame(list(zip(sizes, upto, strict=True)), "_bytes long, _upto long").cache()
        cuts = sharding.find_cuts(running, sum(sizes), 7, cells)
        ends = [0, *cuts, sum(sizes)]
        assert max(b - a for a, b in itertools.pairwise(ends)) == smallest_capacity(sizes, 7)
        assert len(cuts) <= 6


def test_shards(docs, empty):
    import zlib

    texts = texts_of(docs)
    rows = sharding.shard_documents(docs, shards=5).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    place = {}
    slots = collections.defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert place.setdefault(raw, r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    assert sharding.shard_documents(empty).count() == 0


def shingles(text):
    found = WORD.findall(text.translate(LOWER))
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else {tuple(found)} - {()}


def brute_components(sets):
    links = collections.defaultdict(set)
    for i, j in itertools.combinations(sets, 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            links[i].add(j)
            links[j].add(i)
    out = {}
    for i in sets:
        reach, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        out[i] = min(reach)
    return out


@pytest.mark.parametrize("hot_cell,block", [(1 << 20, 256), (2, 3)])
def test_set_join_equals_brute_force(docs, empty, monkeypatch, hot_cell, block):
    monkeypatch.setattr(sigtree, "HOT_CELL", hot_cell)
    monkeypatch.setattr(sigtree.remaining_candidates, "__defaults__", (block,))
    monkeypatch.setattr(sigtree.dense_links, "__defaults__", (block, 400 if block > 3 else 60))
    monkeypatch.setattr(sigtree, "DENSE", 3 if block > 3 else 0)
    monkeypatch.setattr(sigtree, "HELD_PAIRS", 1 << 18 if block > 3 else 2)
    sets = {i: shingles(t) for i, t in texts_of(docs).items()}
    roots = brute_components(sets)
    rows = sigtree.near_duplicates(docs).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows} == {(i, len(s), roots[i]) for i, s in sets.items()}
    if block > 8:
        assert sigtree.near_duplicates(empty).count() == 0


def test_hot_keys_of_two_sets_in_two_slices_link(spark, monkeypatch):
    monkeypatch.setattr(sigtree, "HOT_CELL", 40)
    rng = random.Random(8)
    text = " ".join(str(rng.getrandbits(40)) for _ in range(60))
    # The copies are one set; with its variant each of their keys has two sets, dealt to slices 0 and 1.
    rows = [(2 * i, text) for i in range(50)] + [(101, text + " end")]
    found = sigtree.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 51 and {r["component_id"] for r in found} == {0}


def test_tree_drops_only_pairs_that_can_not_match():
    rng = random.Random(6)
    sets = [np.unique(np.array([rng.getrandbits(64) for _ in range(rng.randint(60, 80))], np.uint64)) for _ in range(30)]
    sets += [np.unique(np.append(s[3:], np.uint64(rng.getrandbits(64)))) for s in sets]
    n = np.array([len(s) for s in sets])
    bits = np.stack([sigtree.fold(np.frombuffer(sigtree.bitmap(s), np.uint8), 16) for s in sets]).view(np.uint64)
    tree = sigtree.Tree(n, np.arange(len(sets)), bits)
    left = {tuple(sorted(p)) for x, y in sigtree.tree_pairs(tree, tree, 80) for p in zip(x.tolist(), y.tolist(), strict=True)}
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 80 * (n[i] + n[j] - both):
            assert (i, j) in left
    assert len(left) < 30 * 59


def test_chats_come_back(spark):
    tricky = ["<|im_end|>", "<||", "a<", "|>\n", "<|im_sep|>x", "", None, "ünï\n\n"]
    rows = [(i // 5, i % 5, ["user", "assistant", "assistant", None, "a<|nl|>\nb"][i % 5], tricky[i % 8], "x") for i in range(60)]
    rows += [(50, 1, "user", "same", "x"), (50, 1, "user", "same", "x"), (51, None, "user", "null turn", "x"), (None, 0, "user", "y", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    found = {r["conv_id"]: r for r in chat.query(df).collect()}
    chats = collections.defaultdict(list)
    for conv, turn, role, text, _ in rows:
        chats[conv].append((turn is not None, turn or 0, role or "", text or ""))
    chats[-1] = [(True, 0, "user", chat.OWN_CASE), (True, 1, "assistant", chat.OWN_CASE)]
    assert set(found) == set(chats)
    for conv, turns in chats.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.limit(0)).count() == 0


def test_quality_measures(docs, empty):
    texts = texts_of(docs)
    for r in quality.query(docs).collect():
        text = texts[r["doc_id"]]
        found = WORD.findall(text)
        grams = collections.Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
        covered = {i + k for i in range(len(found) - 2) if grams[tuple(found[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(found) < 50 or 100 * len(covered) > 50 * len(found))
        assert not (r["kept"] and r["base_failed"])
    assert quality.keep(docs).columns == docs.columns and quality.query(empty).count() == 0


def test_licences(spark, empty):
    own = {
        1: "Some text.\nLicensed under CC BY-NC 4.0.\nMore.", 2: "Released under the MIT License.",
        3: "This work is licensed under the GNU General Public License, version 3.",
        4: "A driving license is required in version 3 of the game.", 5: "", 6: None,
        7: "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.",
    }
    df = spark.createDataFrame([(i, t, "en", "s", 1, "r", 2, 3) for i, t in own.items()], DOCS)
    found = {r["doc_id"]: r for r in licences.documents(df).collect()}
    assert {i: r["family"] for i, r in found.items() if i != 7} == {1: "CC-BY-NC", 2: "MIT", 3: "GPL", 4: None, 5: None, 6: None}
    assert found[7]["n_confirmed"] == 2 and found[7]["family"] in ("MIT", "Apache-2.0")
    assert licences.documents(empty).count() == 0


def test_wrapped_notices(spark):
    gpl = licences.NOTICES["GPL"][1].split()
    wrap = lambda notice, n: "\n".join(" ".join(notice[i : i + n]) for i in range(0, len(notice), n))
    bsd, nc = licences.NOTICES["BSD"][0].split(), licences.NOTICES["CC-BY-NC"][0].split()
    own = {
        1: "We met.\n\n" + wrap(gpl, 12) + "\n\nThe end.", 2: wrap(gpl, 1), 3: "He came. " + wrap(gpl, 5) + " So he said.",
        4: wrap(bsd, 8), 5: wrap(nc, 8), 6: wrap(gpl, 12) + "\n" + wrap(gpl, 12), 7: wrap(bsd, 6).replace("\n", "\n\n"),
        8: wrap(gpl, 12) + "\nReleased under the MIT License.", 9: "The public may\nuse the library\nfree of charge.",
    }
    df = spark.createDataFrame([(i, t, "en", "s", 1, "r", 2, 3) for i, t in own.items()], DOCS)
    found = {r["doc_id"]: r for r in licences.documents(df).collect()}
    want = {1: "GPL", 2: "GPL", 3: "GPL", 4: "BSD", 5: "CC-BY-NC", 6: "GPL", 7: None, 9: None}
    assert {i: found[i]["family"] for i in want} == want
    assert [found[i]["n_confirmed"] for i in (1, 2, 3, 4, 5, 6, 8)] == [1, 1, 1, 1, 1, 2, 2]
    rows = {r["doc_id"]: r for r in licences.scan(df.filter("doc_id in (1, 2)"), known=True).collect()}
    assert (rows[1]["paragraph"], rows[1]["coverage"], rows[2]["coverage"]) == (2, 1.0, 1.0)


def test_main_text(spark):
    field = crf.fit(crf.training_pages(200))
    pages = list(crf.training_pages(100, seed=77))
    wrong = sum(int((np.array(crf.viterbi(field, b)) != labels).sum()) for b, labels in pages)
    assert wrong / sum(len(labels) for _, labels in pages) < 0.04
    page = (
        "<html><head><title>T</title><script>var t='</p>'</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class=\"ad\">Buy now.</div><article><h1>Title &amp more</h1><p><b>One  two\nthree.<br><p>Four &eacute;. "
        "Some more words in here.</article><footer>&copy; x &middot; Words.</footer>"
    )
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "", "x"), (4, "u", "<p", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted(crf.extract(df, field=field).collect())
    assert found[0]["text"] == "Title & more\nOne two three.\nFour é. Some more words in here."
    assert [r["n_chars"] for r in found[1:4]] == [0, 0, 0] and len(found) == 5
    assert crf.extract(df.limit(0), field=field).count() == 0


def test_viterbi_equals_brute_force():
    field = crf.fit(crf.training_pages(60), rounds=30)
    for blocks, _ in crf.training_pages(15, seed=8):
        blocks = blocks[:9]
        scores = [sum(field.weights.get(f, 0.0) for f in fs) for fs in crf.block_features(blocks)]
        value = lambda y: sum(s for s, v in zip(scores, y, strict=True) if v) + sum(field.moves[2 * a + b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=value)
        assert value(best) == pytest.approx(value([int(v) for v in crf.viterbi(field, blocks)]))
