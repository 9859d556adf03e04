"""Column functions against plain Python on edge cases and random texts."""

import difflib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from proofgrid.config import ScoringConfig
from proofgrid.functions import editing, hygiene, labels, metrics, modelnames, textnorm, typed
from proofgrid.operators.scoring import score_pairs

EDGE = [
    (None, None), (None, "x"), ("x", None), ("", ""), ("a b", "ab"), ("a　b", "ab"),
    ("the cat sat", "the cat sad now"), ("𠮷a", "吉a"), ("  a\x1cb ", "a b"), (" ", "　"),
    ("輕度", "中度"), ("其他類", "障礙類別：其他類"), ("a  b\n c", "a b c"), ("A", "a"),
]


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left if x == y else 1 + min(left, row[j], row[j - 1])
    return row[-1]


def expected_rates(a, b):
    def chars(x):
        return re.sub(r"\s+", "", (x or "").strip())

    def words(x):
        return re.sub(r"\s+", " ", (x or "").strip())

    def rate(x, y):
        if not x and not y:
            return 0.0
        return table_distance(x, y) / max(len(x), len(y))

    l, r = words(a), words(b)
    split = (l.split(), r.split()) if " " in l or " " in r else (list(l), list(r))
    return rate(chars(a), chars(b)), rate(*split)


@pytest.fixture(scope="module")
def random_pairs():
    source = random.Random(7)
    letters = ["a", "b", "類", "𠮷", " ", "　", "é"]
    words = ["the", "cat", "障礙", "第1類", "𠮷", "sat", "on"]
    pairs = []
    for _ in range(150):
        pairs.append(tuple("".join(source.choices(letters, k=source.randint(0, 12)))
                           for _ in "ab"))
        pairs.append(tuple(" ".join(source.choices(words, k=source.randint(0, 8))) for _ in "ab"))
    return pairs


@pytest.mark.parametrize("engine", ["builtin", "auto"])
def test_rates_agree_with_a_plain_table(spark, random_pairs, engine):
    data = [(i, a, b) for i, (a, b) in enumerate(EDGE + random_pairs)]
    df = spark.createDataFrame(data, "i int, correct string, predicted string")
    cfg = ScoringConfig(edit_engine=engine, long_pair_cells=20)
    got = score_pairs(df, cfg).collect()
    for row in got:
        cer, wer = expected_rates(row.correct, row.predicted)
        assert row.cer == pytest.approx(cer), row
        assert row.wer == pytest.approx(wer), row
        assert row.similarity == pytest.approx(1 - cer)
        assert row.is_exact_match == (row.similarity >= 0.99)
        assert row.is_mismatch == (row.similarity < 0.8)
    single = df.select("i", metrics.ocr_metrics("correct", "predicted", cfg).alias("m"))
    assert {r.i: r.m.wer for r in single.collect()} == {r.i: r.wer for r in got}


def test_bit_parallel_distance(random_pairs):
    for a, b in random_pairs:
        assert editing.edit_distance(a, b) == table_distance(a, b)
    assert editing.edit_distance("ab" * 300, "ba" * 310) == table_distance("ab" * 300, "ba" * 310)


def test_rates_are_symmetric_and_bounded(spark, random_pairs):
    df = spark.createDataFrame(random_pairs, "a string, b string")
    both = df.select(
        metrics.cer("a", "b").alias("x"), metrics.cer("b", "a").alias("y"),
        metrics.cer("a", "a").alias("z"),
    ).collect()
    assert all(r.x == pytest.approx(r.y) and 0 <= r.x <= 1 and r.z == 0 for r in both)


def test_gestalt_and_opcodes(spark, random_pairs):
    df = spark.createDataFrame(EDGE + random_pairs, "a string, b string")
    folded = df.select(
        "a", "b", metrics.similarity("a", "b", ScoringConfig(method="gestalt")).alias("g"),
        metrics.similarity("a", "b", ScoringConfig(method="gestalt_trim")).alias("t"),
        metrics.opcode_cer("a", "b").alias("o"),
    ).collect()

    def ratio(x, y):
        if not x or not y:
            return float(not x and not y)
        return difflib.SequenceMatcher(None, x, y).ratio()

    for r in folded:
        l, h = (re.sub(r"\s+", "", x or "") for x in (r.a, r.b))
        fold = str.maketrans("【】（）", "[]()")
        assert r.g == pytest.approx(ratio(l.translate(fold).lower(), h.translate(fold).lower()))
        assert r.t == pytest.approx(ratio((r.a or "").strip(), (r.b or "").strip()))
        errors = sum(
            max(i2 - i1, j2 - j1)
            for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, l, h).get_opcodes()
            if tag != "equal"
        )
        assert r.o == pytest.approx(errors / len(l) if l else 0.0)


AMOUNTS = [
    "1,200", "1200", "abc", "xyz", "1_000", "1__0", "_1", "nan", "-NaN", "１２", "12d", "0x1p3",
    " 1 200 ", "", None, "1e5", "1E+05", ".5", "5.", ".", "+3", "-4.25", "inf", "-Infinity", "1,2.5",
    "٣٤", "1e400", "12345678", "1e16", "0.00015", "0.00001", "123456789012345678", "1.5e-7", "1e22",
    "9999999.5", "0.001", "1.2.3",
]


def python_amount(text):
    text = re.sub(r"[,\s]", "", (text or "").strip())
    try:
        return float(text)
    except ValueError:
        return 0.0


def test_amounts_and_their_text(spark):
    df = spark.createDataFrame([(a,) for a in AMOUNTS], "a string")
    rows = df.select(
        "a", typed.normalize_amount("a").alias("v"),
        typed.float_text(typed.normalize_amount("a")).alias("t"),
        typed.normalize_value("a", F.lit(typed.AMOUNT)).alias("n"),
    ).collect()
    for r in rows:
        expected = python_amount(r.a)
        assert r.v == expected or (math.isnan(r.v) and math.isnan(expected)), r
        assert r.t == str(expected), r
        assert r.n == ("" if r.a is None else str(expected)), r
    pairs = [("abc", "xyz", 1.0), (None, "0", 1.0), ("nan", "nan", 0.0), ("1,200", "1200.0", 1.0),
             ("１２", "12", 1.0), ("1", "2", 0.0), ("inf", "Infinity", 1.0)]
    got = spark.createDataFrame(pairs, "l string, r string, s double").select(
        "s", typed.amount_similarity("l", "r").alias("g")
    ).collect()
    assert all(r.s == r.g for r in got)


DATES = ["114/04/24", "114/4/24", "114-4-24", "1140424", "20240424", "2024-04-24", "2024/4/24",
         "113-04-24", "x", "", None, " 1140424 ", "１１４０４２４", "114042", "123456789", "1140424\n-"]


def python_date(text):
    text = (text or "").strip()
    digits = re.sub(r"[/-]", "", text)
    if re.match(r"^\d{7,8}$", digits):
        digits = "0" + digits if len(digits) == 7 else digits
        return f"{digits[:3]}/{digits[3:5]}/{digits[5:7]}"
    return text


def test_dates(spark):
    df = spark.createDataFrame([(d,) for d in DATES], "d string")
    for r in df.select("d", typed.normalize_date("d").alias("n")).collect():
        assert r.n == python_date(r.d), r
    # Cleaned twice, the day of the month does not count; unpadded dates stay as they are.
    cases = [("1140424", "1140430", 1.0), ("20240424", "20240401", 1.0), ("1140524", "1140424", 2 / 3),
             ("114/4/24", "114/04/24", 0.0), ("114-4-24", "1140424", 0.0)]
    scored = spark.createDataFrame(cases, "l string, r string, s double").select(
        "s",
        typed.field_similarity(
            typed.normalize_date("l"), typed.normalize_date("r"), F.lit(typed.DATE)
        ).alias("g"),
    )
    assert all(r.s == pytest.approx(r.g) for r in scored.collect())


def test_booleans_and_types(spark):
    words = {"是": "Y", " y ": "Y", "TRUE": "Y", "1": "Y", "0": "N", "否": "N", "No": "N",
             "maybe": "MAYBE", None: ""}
    df = spark.createDataFrame([(k, v) for k, v in words.items()], "b string, e string")
    assert all(r.e == r.g for r in
               df.select("e", typed.normalize_boolean("b").alias("g")).collect())
    cases = [
        ("發文日期", "x", None, typed.DATE), ("UpDate", "x", None, typed.DATE),
        ("總元", "x", None, typed.AMOUNT), ("Amount due", None, "1", typed.AMOUNT),
        ("解約金_範圍", "單筆", "Y", typed.TEXT), ("解約金_範圍", None, "Y", typed.BOOLEAN),
        ("小額終老非扣押範圍", "x", "x", typed.BOOLEAN), ("備註", "Yes", "1", typed.BOOLEAN),
        ("備註", "98/4/24 後", None, typed.DATE), ("備註", "2024-04-24", None, typed.TEXT),
        ("備註", "1,234.50", "x", typed.AMOUNT), ("備註", "x", "12", typed.AMOUNT),
        ("備註", None, None, typed.TEXT), ("備註", "12\n,", None, typed.AMOUNT),
    ]
    rows = spark.createDataFrame(cases, "n string, l string, r string, e string").select(
        "*", typed.field_type("n", "l", "r").alias("g")
    ).collect()
    assert all(r.e == r.g for r in rows), [r for r in rows if r.e != r.g]


def test_fixed_text_rounds_like_python(spark):
    source = random.Random(3)
    values = [0.0, 1.0, 0.1225, 0.125, 0.1235, 12.25, 0.15, 0.25, 0.35, 2.675, 0.9995, 0.0005,
              2 / 3, 6 / 7, 99.95, 1e-9] + [source.random() for _ in range(300)] + [
                  k / 1000 for k in range(0, 1000, 7)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", labels.percent_text("v", 1).alias("one"), labels.percent_text("v", 2).alias("two"),
        labels.fixed_text("v", 3).alias("three"),
    ).collect()
    for r in rows:
        assert (r.one, r.two, r.three) == (f"{r.v:.1%}", f"{r.v:.2%}", f"{r.v:.3f}"), r.v


def test_label_limits(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.1, 0.2, 0.4, 0.6, 0.61)], "c double")
    levels = [r[0] for r in df.select(labels.ocr_level("c")).collect()]
    assert levels == ["優秀", "優秀", "良好", "可接受", "需改進", "不合格", "不合格"]
    notes = [r[0][:2] for r in df.select(labels.cer_suggestion("c")).collect()]
    assert notes == ["完美", "優秀", "優秀", "良好", "普通", "較差", "差劣"]
    sims = spark.createDataFrame([(x,) for x in (0.2, 0.3, 0.5, 0.7, 0.8, 0.9)], "s double")
    got = sims.select(
        labels.error_type("s").alias("t"), labels.error_priority("s").alias("p"),
        labels.performance_level("s").alias("l"), labels.similarity_suggestion("s").alias("a"),
    ).collect()
    assert [r.t for r in got] == ["完全不符", "完全不符", "內容錯誤", "內容錯誤", "格式差異", "格式差異"]
    assert [r.p for r in got] == ["高", "中", "中", "低", "低", "低"]
    assert [r.l for r in got] == ["需改進", "需改進", "普通", "良好", "良好", "優秀"]
    assert [r.a[:2] for r in got] == ["完全", "重新", "重新", "內容", "內容", "格式"]


def test_model_names(spark):
    texts = {"GEMINI 2.5 Pro x": "gemini-2.5-pro", "gemma327bqat": "gemma 3 27b qat",
             "about gpt4": "GPT-4", "chatgpt4": "ChatGPT-4", "LLaMA-2": "LLaMA", "none": "", None: ""}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "t string, e string")
    assert all(r.e == r.g for r in df.select("e", modelnames.from_text("t").alias("g")).collect())
    files = {
        "a/gemma327bqat.xlsx": "gemma3:27b", "x/[Mine] data.v2.xlsx": "Mine", "[ ] data.xlsx": "data",
        "plain.name.xlsx": "plain.name", "": "", "[gemini2.5pro] t.xlsx": "gemini-2.5-pro-exp-03-25",
        "a/.xlsx": "未知模型", "no_ending": "no_ending", "]x[.xlsx": "]x[",
    }
    df = spark.createDataFrame([(k, v) for k, v in files.items()], "t string, e string")
    rows = df.select("*", modelnames.from_file_name("t").alias("g")).collect()
    assert all(r.e == r.g for r in rows), [r for r in rows if r.e != r.g]


def test_hygiene(spark):
    long = "x" * 32768
    values = {"nan": "", None: "", "a\x00b\tc\x1f": "ab\tc", long: "x" * 32760 + "...",
              "y" * 32767: "y" * 32767}
    df = spark.createDataFrame([(k, v) for k, v in values.items()], "t string, e string")
    assert all(r.e == r.g for r in df.select("e", hygiene.clean_value("t").alias("g")).collect())
    names = {"a/b:c": ("a_b_c", "abc"), "m" * 40: ("m" * 28 + "...", "m" * 31),
             "模型[1] é_-": ("模型_1_ é_-", "模型1 é_-")}
    df = spark.createDataFrame([(k, *v) for k, v in names.items()], "t string, a string, b string")
    for r in df.select("*", hygiene.sheet_name("t").alias("x"),
                       hygiene.document_sheet_name("t").alias("y")).collect():
        assert (r.a, r.b) == (r.x, r.y)
    got = spark.createDataFrame([("[a]b/c.v1.xlsx",)], "t string").select(
        hygiene.output_name("t", F.lit("r1"))
    ).first()[0]
    assert got == "ab_c.v1_accuracy_evaluation_r1.xlsx"


def test_strip_keeps_null_and_knows_unicode(spark):
    df = spark.createDataFrame([("　 a\x1c\n",), (None,)], "t string")
    assert [r[0] for r in df.select(textnorm.strip("t")).collect()] == ["a", None]


def test_config_bounds():
    for bad in ({"mismatch_threshold": 1.2}, {"method": "x"}, {"denominator": "x"},
                {"edit_engine": "x"}, {"chunk_rows": 0}):
        with pytest.raises(ValueError):
            ScoringConfig(**bad)


def test_word_distance_equals_brute_force(spark):
    """Words of one side, of both, repeated ones, empty sides and many distinct words."""
    rng = random.Random(17)
    pool = [f"w{i}" for i in range(30)] + ["é", "a", "\U0001f600", ""]
    rows = [
        ([rng.choice(pool) for _ in range(rng.randint(0, 25))], [rng.choice(pool) for _ in range(rng.randint(0, 25))])
        for _ in range(150)
    ]
    many = [f"x{i}" for i in range(1500)]
    rows += [(many, many[::-1]), (many, many[5:] + ["end"]), ([], []), (["a"], ["b"]), (["a", "b"], ["b", "a"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l array<string>, r array<string>")
    got = {r.i: r.d for r in df.select("i", metrics.token_distance(F.col("l"), F.col("r")).alias("d")).collect()}
    assert got == {i: editing.edit_distance(l, r) for i, (l, r) in enumerate(rows)}
