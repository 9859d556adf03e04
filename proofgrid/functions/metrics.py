"""Error rates and similarities as column expressions.

Pairs that agree after clean-up never reach the edit distance. Word-level distance numbers the words that
both texts of a pair have, writes each number as one four-byte character and then uses the built-in
``levenshtein``, so it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from proofgrid.config import ScoringConfig
from proofgrid.functions import editing
from proofgrid.functions.textnorm import (
    normalize_folded,
    normalize_text,
    normalize_words,
    strip,
    text,
)

DEFAULT = ScoringConfig()

# A number is written as the bytes of 0xF0000000 and the number. ``levenshtein`` takes four bytes that start with
# F0 to F4 for one character, whatever follows, which is room for 83,886,080 numbers; an array of as many words
# would be beyond the 2 GB that a value may have.
_FIRST_CODE = 0xF0000000


def long_pair(left: Column, right: Column, cfg: ScoringConfig = DEFAULT) -> Column:
    """Differing texts whose distance is left to the Arrow helper."""
    if cfg.edit_engine == "builtin":
        return F.lit(False)
    sizes = F.char_length(left).cast("long") * F.char_length(right).cast("long")
    return (left != right) & (sizes > cfg.long_pair_cells)


def char_distance(
    left: Column, right: Column, cfg: ScoringConfig = DEFAULT, slow: Column | None = None
) -> Column:
    """Edit distance over code points."""
    if cfg.edit_engine == "builtin":
        return F.levenshtein(left, right)
    slow = long_pair(left, right, cfg) if slow is None else slow
    helper = editing.long_char_distance(F.when(slow, left), F.when(slow, right))
    return F.when(slow, helper).otherwise(F.levenshtein(left, right))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it.

    Inside ``transform`` and ``aggregate`` Spark computes what it is given again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _halvings(vocabulary: Column) -> Column:
    """The steps by which a place among sorted words is found, largest first."""
    most = F.floor(F.log2(F.greatest(F.size(vocabulary), F.lit(1)))).cast("int") + 1  # one too many does no harm
    return F.transform(
        F.sequence(most, F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i)
    )


def _interned(tokens: Column, vocabulary: Column, steps: Column, foreign: int) -> Column:
    """One character per token: its place in the sorted vocabulary plus two, or ``foreign`` if it is not there.

    The place is found by halving, so a pair costs its words times the logarithm of its vocabulary.
    """

    def place(token: Column) -> Column:
        """How many entries of the vocabulary are at most the token."""
        return F.aggregate(
            steps, F.lit(0),
            lambda at, step: F.when(F.get(vocabulary, at + step - 1) <= token, at + step).otherwise(at),
        )

    def at_place(token: Column, at: Column) -> Column:
        known = F.coalesce(F.get(vocabulary, at - 1) == token, F.lit(False))
        return F.hex(F.when(known, at.cast("long") + 1).otherwise(foreign) + F.lit(_FIRST_CODE))

    def code(token: Column) -> Column:
        return _bound(place(token), lambda at: at_place(token, at))

    return F.unhex(F.array_join(F.transform(tokens, code), "")).cast("string")


def token_distance(left: Column, right: Column) -> Column:
    """Edit distance over two arrays of tokens.

    Words of one side only equal no word of the other, so all of a side share one character.
    """
    def distance(words: Column) -> Column:
        both = [words["vocabulary"], words["steps"]]
        return F.levenshtein(_interned(words["left"], *both, 0), _interned(words["right"], *both, 1))

    def with_steps(words: Column) -> Column:
        return _bound(
            F.struct(
                words["left"].alias("left"), words["right"].alias("right"),
                words["vocabulary"].alias("vocabulary"), _halvings(words["vocabulary"]).alias("steps"),
            ),
            distance,
        )

    def with_vocabulary(words: Column) -> Column:
        shared = F.sort_array(F.array_intersect(words["left"], words["right"]))
        return _bound(
            F.struct(
                words["left"].alias("left"), words["right"].alias("right"), shared.alias("vocabulary")
            ),
            with_steps,
        )

    return _bound(F.struct(left.alias("left"), right.alias("right")), with_vocabulary)


def word_distance(
    left: Column, right: Column, cfg: ScoringConfig = DEFAULT, slow: Column | None = None
) -> Column:
    """Edit distance over the words of two texts with single spaces."""
    builtin = token_distance(F.split(left, " "), F.split(right, " "))
    if cfg.edit_engine == "builtin":
        return builtin
    slow = long_pair(left, right, cfg) if slow is None else slow
    helper = editing.long_word_distance(F.when(slow, left), F.when(slow, right))
    return F.when(slow, helper).otherwise(builtin)


def error_rate(
    left: Column, right: Column, distance: Column, size_l: Column, size_r: Column,
    cfg: ScoringConfig = DEFAULT,
) -> Column:
    """Distance over the longer length, or over the reference length (may exceed 1).

    The distance stands in the expression once, behind the test for equal texts.
    """
    size = size_l if cfg.denominator == "reference" else F.greatest(size_l, size_r)
    return (
        F.when(left == right, 0.0)
        .when((left == "") | (right == ""), 1.0)
        .otherwise(distance / size)
    )


def cer_clean(
    left: Column, right: Column, cfg: ScoringConfig = DEFAULT, slow: Column | None = None
) -> Column:
    """Character error rate of two texts that are already cleaned."""
    return error_rate(
        left, right, char_distance(left, right, cfg, slow),
        F.char_length(left), F.char_length(right), cfg,
    )


def has_words(left: Column, right: Column) -> Column:
    return F.contains(left, F.lit(" ")) | F.contains(right, F.lit(" "))


def _count_words(value: Column) -> Column:
    return F.char_length(value) - F.char_length(F.translate(value, " ", "")) + 1


def word_rate_clean(
    left: Column, right: Column, cfg: ScoringConfig = DEFAULT, slow: Column | None = None
) -> Column:
    """Error rate over words of two texts with single spaces; an empty text has no words."""
    return error_rate(
        left, right, word_distance(left, right, cfg, slow),
        _count_words(left), _count_words(right), cfg,
    )


def cer(reference, hypothesis, cfg: ScoringConfig = DEFAULT) -> Column:
    return cer_clean(normalize_text(reference), normalize_text(hypothesis), cfg)


def wer(reference, hypothesis, cfg: ScoringConfig = DEFAULT) -> Column:
    """Word error rate: by words when either side has a space, otherwise by characters."""
    def rate(left: Column, right: Column) -> Column:
        return F.when(has_words(left, right), word_rate_clean(left, right, cfg)).otherwise(
            cer_clean(left, right, cfg)
        )

    left, right = normalize_words(reference), normalize_words(hypothesis)
    if cfg.edit_engine != "builtin":
        return rate(left, right)  # the Arrow helpers cannot stand inside of another function
    cleaned = F.struct(left.alias("left"), right.alias("right"))
    return _bound(cleaned, lambda texts: rate(texts["left"], texts["right"]))


def accuracy(rate: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - rate)


def cer_accuracy(reference, hypothesis, cfg: ScoringConfig = DEFAULT) -> Column:
    return accuracy(cer(reference, hypothesis, cfg))


def wer_accuracy(reference, hypothesis, cfg: ScoringConfig = DEFAULT) -> Column:
    return accuracy(wer(reference, hypothesis, cfg))


def similarity(reference, hypothesis, cfg: ScoringConfig = DEFAULT) -> Column:
    """Similarity by the configured method."""
    if cfg.method == "gestalt":
        return _gestalt(normalize_folded(reference), normalize_folded(hypothesis))
    if cfg.method == "gestalt_trim":
        return _gestalt(strip(text(reference)), strip(text(hypothesis)))
    if cfg.method == "opcode":
        return accuracy(opcode_cer(reference, hypothesis))
    return cer_accuracy(reference, hypothesis, cfg)


def ocr_metrics(reference, hypothesis, cfg: ScoringConfig = DEFAULT) -> Column:
    rate = cer(reference, hypothesis, cfg)
    return F.struct(
        rate.alias("cer"),
        wer(reference, hypothesis, cfg).alias("wer"),
        accuracy(rate).alias("accuracy"),
        accuracy(rate).alias("similarity"),
    )


def _gestalt(left: Column, right: Column) -> Column:
    compare = (left != right) & (left != "") & (right != "")
    ratio = editing.gestalt_ratio(F.when(compare, left), F.when(compare, right))
    return F.when(left == right, 1.0).when(compare, ratio).otherwise(0.0)


def opcode_cer(reference, hypothesis) -> Column:
    """Documented variant: opcode errors over the reference length; may exceed 1."""
    left, right = normalize_text(reference), normalize_text(hypothesis)
    compare = (left != right) & (left != "") & (right != "")
    errors = editing.opcode_errors(F.when(compare, left), F.when(compare, right))
    return (
        F.when(left == right, 0.0)
        .when(compare, errors / F.char_length(left))
        .when(left == "", 0.0)
        .otherwise(1.0)
    )


def opcode_wer(reference, hypothesis) -> Column:
    """The documented word variant treats every character as a word."""
    return opcode_cer(reference, hypothesis)
