"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import words
from proofgrid.plans.storage import stored

SYMBOL = "[#*$%&|<>]"
WORD_CHAR = r"[^\x20\x09-\x0D]"
# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that for it was on with as be by are this from at or an "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "le la les de des et en un une du que dans est pour qui sur au par pas "
    "el los las y del se por con no para su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``low * base <= value <= high * base``; an open end is None."""

    name: str
    value: str
    base: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.2),
    Rule("stop_words", "n_stop_words", "n_words", 0.05, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``df``) and the measures of its text; a null text counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = df.select(F.struct("*").alias("row"), whole.alias("_text"))
    parts = base.select(
        "row", "_text", words(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: F.rlike(line, F.lit(WORD_CHAR))).alias("_lines"),
    )
    counted = parts.select(
        "row", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.slice(
            F.transform(
                "_words",
                lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
            ), 1, F.greatest(F.size("_words") - 2, F.lit(0)),
        ).alias("_windows"),
    )
    # Only a text with an equal pair of windows is sorted.
    ranked = counted.withColumn(
        "_ranked",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda entry, k: F.coalesce(F.get("_ranked", k)["h"] == entry["h"], F.lit(False))
    found = ranked.withColumn(
        "_found",
        F.sort_array(
            F.array_compact(
                F.transform("_ranked", lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["i"]))
            )
        ),
    )
    covered = F.aggregate(
        F.transform("_found", lambda at, k: F.least(F.lit(3), F.coalesce(F.get("_found", k + 1) - at, F.lit(3)))),
        F.lit(0), lambda total, n: total + n,
    )
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "_windows", "_ranked", "_found"
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules hold."""
    passed = F.lit(True)
    for rule in rules:
        value, base = F.col(rule.value), F.col(rule.base)
        if rule.low is not None:
            passed = passed & (value >= base * rule.low)
        if rule.high is not None:
            passed = passed & (value <= base * rule.high)
    return passed


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row``, the measures, ``base_failed`` and ``kept``.

    Null and empty texts have no words: they fail the base rule. Repeated rows are judged one by one; an empty
    table gives an empty result; columns of ``df`` stay inside ``row`` and can't clash.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure(df, text).select("*", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def keep(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that pass, with its own columns.

    The verdict is written first: pushed below the projections, the filter would hold all of them many times over.
    """
    return stored(judge(df, text, rules), "quality").filter("kept").select("row.*")


def query(df: DataFrame) -> DataFrame:
    return judge(df.select("doc_id", "text")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_stop_words",
    )


def sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
    with t as (
        select doc_id, coalesce(text, '') as text from documents
    ), w as (
        select doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
        from t
    ), s as (
        select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w
    ), g as (
        select doc_id, i, word, lead(word, 1) over o as w2, lead(word, 2) over o as w3 from s
        window o as (partition by doc_id order by i)
    ), r as (
        select doc_id, i, count(*) over (partition by doc_id, word, w2, w3) as k from g where w3 is not null
    ), c as (
        select doc_id, count(distinct j) as n from (
            select doc_id, i as j from r where k > 1 union all select doc_id, i + 1 from r where k > 1
            union all select doc_id, i + 2 from r where k > 1) group by doc_id
    ), m as (
        select doc_id, len(ws)::bigint as n_words,
            length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
            (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
            (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
            coalesce(c.n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines,
            len(list_filter(ws, lambda x: x in ({stops})))::bigint as n_stop_words
        from w left join c using (doc_id)
    )
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
        and word_chars >= n_words * 2.0 and word_chars <= n_words * 15.0 and n_symbols <= n_words * 0.2
        and n_stop_words >= n_words * 0.05 and n_dup_lines <= n_lines * 0.5 as kept
    from m"""
