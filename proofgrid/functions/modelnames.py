"""Model names found in texts and file names. The rules below are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from proofgrid.functions.textnorm import column, contains_any, strip, text

# A cell that holds one of these words names a model.
MODEL_WORDS = ["gemini", "gemma", "chatgpt", "claude", "gpt", "llama", "palm", "bard"]

UNKNOWN_MODEL = "未知模型"

TEXT_RULES = [
    ("gemini-2.5-pro-exp-03-25", "gemini-2.5-pro-exp-03-25"),
    ("gemini 2.5 pro exp 03 25", "gemini-2.5-pro-exp-03-25"),
    ("gemini2.5proexp0325", "gemini-2.5-pro-exp-03-25"),
    ("gemini2.5pro", "gemini-2.5-pro"),
    ("gemini 2.5 pro", "gemini-2.5-pro"),
    ("gemini", "Gemini"),
    ("gemma 3 27b qat", "gemma 3 27b qat"),
    ("gemma3:27b", "gemma3:27b"),
    ("gemma327bqat", "gemma 3 27b qat"),
    ("gemma327b", "gemma3:27b"),
    ("gemma3", "gemma3"),
    ("gemma", "Gemma"),
    ("chatgpt 4.1", "ChatGPT 4.1"),
    ("chatgpt4.1", "ChatGPT 4.1"),
    ("chatgpt-4", "ChatGPT-4"),
    ("chatgpt4", "ChatGPT-4"),
    ("chatgpt", "ChatGPT"),
    ("gpt-4", "GPT-4"),
    ("gpt4", "GPT-4"),
    ("claude-3", "Claude-3"),
    ("claude3", "Claude-3"),
    ("claude", "Claude"),
    ("llama", "LLaMA"),
    ("palm", "PaLM"),
    ("bard", "Bard"),
]

FILE_RULES = [
    ("gemini2.5proexp0325", "gemini-2.5-pro-exp-03-25"),
    ("gemini2.5pro", "gemini-2.5-pro-exp-03-25"),
    ("gemma327b", "gemma3:27b"),
    ("gemma327bqat", "gemma 3 27b qat"),
    ("gemma3", "gemma3"),
    ("chatgpt4.1", "Chatgpt 4.1"),
    ("chatgpt", "ChatGPT"),
]

# Words in a column name that make the column a candidate for holding model names.
MODEL_COLUMN_WORDS = [
    "模型", "model", "ai", "預測", "prediction", "gemini", "gemma", "chatgpt", "claude",
]


def is_model_cell(value) -> Column:
    return contains_any(F.lower(text(value)), MODEL_WORDS)


def _first_rule(lowered: Column, rules, otherwise: Column) -> Column:
    result = otherwise
    for pattern, name in reversed(rules):
        result = F.when(F.contains(lowered, F.lit(pattern)), F.lit(name)).otherwise(result)
    return result


def from_text(value) -> Column:
    """Name by the first rule that occurs in the text, else the empty string."""
    return _first_rule(F.lower(text(value)), TEXT_RULES, F.lit(""))


def from_file_name(value) -> Column:
    """Name by rule, else what stands in brackets, else the base name without brackets."""
    value = column(value)
    base = F.substring_index(value, "/", -1)
    opening, closing = F.instr(base, "["), F.instr(base, "]")
    inside = F.when(
        (opening > 0) & (closing > opening),
        strip(F.substring(base, opening + 1, closing - opening - 1)),
    )
    stem = F.when(
        F.contains(base, F.lit(".")), F.regexp_replace(base, r"\.[^.]*\z", "")
    ).otherwise(base)
    bare = F.when(
        F.startswith(stem, F.lit("[")) & (F.instr(stem, "]") > 0),
        F.substring(stem, F.instr(stem, "]") + 1, F.char_length(stem)),
    ).otherwise(stem)
    rest = F.coalesce(
        F.nullif(inside, F.lit("")), F.nullif(strip(bare), F.lit("")), F.lit(UNKNOWN_MODEL)
    )
    return F.when(text(value) == "", "").otherwise(_first_rule(F.lower(base), FILE_RULES, rest))
