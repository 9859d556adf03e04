"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEAM, BREAK = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|nl|>"
OWN_CASE = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    """Control strings start with ``<|``; in texts a bar is added, so none can occur in them."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def format_chats(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (text, loss).

    Turns are sorted by (turn, role, text); nulls come first, null roles and texts count as empty, repeated
    rows stay. Adjacent turns of one role share a block, with a seam between their texts. The segments joined
    are the formatted text; those with ``loss`` are the texts to learn. Other columns are not read.
    """
    rows = df.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("entry"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("entry")).alias("turns"))
    header = lambda r: F.concat(F.lit(START), F.replace(escape(r), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))

    def piece(entry: Column, i: Column) -> Column:
        same = F.get("turns", i - 1)["role"] == entry["role"]
        lead = (
            F.when(i == 0, header(entry["role"])).when(same, F.lit(SEAM))
            .otherwise(F.concat(F.lit(END + "\n"), header(entry["role"])))
        )
        return F.array(
            F.struct(lead.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(entry["text"]).alias("text"), (entry["role"] == loss_role).alias("loss")),
        )

    tail = F.array(F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")))
    segments = chats.select("conv_id", F.concat(F.flatten(F.transform("turns", piece)), tail).alias("segments"))
    return segments.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def read_chats(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    blocks = F.split(formatted, r"\Q" + START + r"\E")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END + "\n"))
        name = unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))
        return F.transform(
            F.split(body, r"\Q" + SEAM + r"\E"),
            lambda t: F.struct(name.alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), turns))


def with_own_case(df: DataFrame) -> DataFrame:
    """The table plus conversation -1, whose texts hold control strings."""
    own = df.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(OWN_CASE).alias("text"),
    )
    return df.select("conv_id", "turn", "role", "text").unionByName(own)


def query(df: DataFrame) -> DataFrame:
    done = format_chats(with_own_case(df)).withColumn("turns", read_chats(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = done.select("conv_id", "formatted", "turns", loss.alias("loss"), whole.alias("whole"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("whole", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = f"""
with raw as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '{OWN_CASE}' union all select -1, 1, 'assistant', '{OWN_CASE}'
), t as (
    select *, row_number() over w as i, lag(role) over w as before from raw
    window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*)::bigint as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
    sum(length(replace(text, '<|', '<||'))
        + case when before = role then 10
               else 13 + length(replace(role, '<|', '<||')) + 5 * (length(role) - length(replace(role, chr(10), '')))
                    + 11 end)::bigint as formatted_chars
from t group by conv_id"""
