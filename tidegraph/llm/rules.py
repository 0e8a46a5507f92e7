"""Quality rules: a threshold table compiled into one projection, without user functions.

Measures are built-in expressions over the whole text.  A rule is a row of :data:`RULES`; :func:`compile_rules`
turns the table into one boolean column per rule.  Defined results: a null text counts as the empty text, which
has no word and fails ``min_words``; repeated rows each get their own result; an empty table gives an empty result;
texts may be of any length; a measure equal to its threshold passes.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import SPACE_CHARS, SPACE_CLASS, let

#: The marks counted as symbols, and common words of the corpus languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
    "der die das und ist nicht von zu mit den dem des ein eine im auf als auch für "
    "le la les de des du et en un une que qui est dans pour par sur au pas "
    "el los las y es una por con para se del al su lo como más"
).split()
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document passes if ``numerator <= at_most * denominator`` (or ``>= at_least``), from ``min_words`` words on.

    Thresholds are taken as the decimal numbers they are written as, and compared in whole numbers.  A document that
    fails one of the ``base`` rules has ``base_failed``.
    """

    name: str
    numerator: str
    denominator: str | None = None
    at_least: float | None = None
    at_most: float | None = None
    min_words: int = 0
    base: bool = False


#: The production table.
RULES = (
    Rule("min_words", "n_words", at_least=10, base=True),
    Rule("repeat_words", "n_repeat_words", "n_words", at_most=0.2, base=True),
    Rule("symbols", "n_symbols", "n_words", at_most=0.25),
    Rule("exclamations", "n_bangs", "n_words", at_most=0.25),
    Rule("capitals", "n_upper", "n_letters", at_most=0.5),
    Rule("word_length_low", "word_chars", "n_words", at_least=1.5),
    Rule("word_length_high", "word_chars", "n_words", at_most=40),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", at_most=0.5),
    Rule("stop_words", "n_stop_words", "n_words", at_least=0.02, min_words=50),
)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+"))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that occur twice or more in the text, the first included.

    Windows are hashed, sorted with their positions, and those equal to a neighbour kept: n log n in the text's
    length.  Then each repeated window covers as many new words as lie before the next one.
    """

    def hashed(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(w) - (window - 1)),
            lambda i: F.struct(F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(window)]).alias("h"), i.alias("i")),
        )

    def starts(s: Column) -> Column:
        hit = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, x: total + x)

    # the words are bound too: written out inside the lambda, the split would be made anew for each window
    counted = let(words, lambda w: let(F.sort_array(hashed(w)), lambda s: let(starts(s), covered)))
    return F.when(F.size(words) < window + 1, F.lit(0).cast("bigint")).otherwise(counted)


def _kept_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def measures(text: Column, words: Column) -> dict[str, Column]:
    """Name to expression.  ``words`` is the split text, so that it is split once."""
    upper = "".join(map(chr, range(65, 91)))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    bare = lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"'()")))
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("bigint"),
        "n_symbols": _kept_chars(text, SYMBOLS),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeat_words(words),
        "n_lines": F.size(lines).cast("bigint"),
        "n_bangs": _kept_chars(text, "!"),
        "n_upper": _kept_chars(text, upper),
        "n_letters": _kept_chars(text, upper + upper.lower()),
        "n_stop_words": F.size(F.filter(words, lambda w: bare(w).isin(STOP_WORDS))).cast("bigint"),
    }


def compile_rules(rules=RULES) -> dict[str, Column]:
    """One boolean column for each rule: does the document pass it?"""
    out = {}
    for r in rules:
        a, b = F.col(r.numerator), F.col(r.denominator) if r.denominator else F.lit(1)
        good = F.lit(True)
        if r.at_least is not None:
            least = Fraction(str(r.at_least))
            good = good & (a * least.denominator >= b * least.numerator)
        if r.at_most is not None:
            most = Fraction(str(r.at_most))
            good = good & (a * most.denominator <= b * most.numerator)
        out[r.name] = good | (F.col("n_words") < r.min_words) if r.min_words else good
    return out


def apply_rules(docs: DataFrame, *, text: str = "text", carry=("doc_id",), rules=RULES) -> DataFrame:
    """The carried columns, every measure, ``base_failed``, ``failed`` (names of failed rules) and ``kept``.

    Carried columns named like a measure would clash; they keep their values under the given name only if the
    caller renames them first, so such a name raises ValueError.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    names = set(measures(F.lit(""), F.array())) | {"base_failed", "failed", "kept"}
    if clash := names & set(carry):
        raise ValueError(f"columns clash with measures: {sorted(clash)}")
    split = docs.select(*carry, own.alias("__text"), words_of(own).alias("__words"))
    measured = split.select(*carry, *[c.alias(n) for n, c in measures(F.col("__text"), F.col("__words")).items()])
    passed = compile_rules(rules)
    base = ~reduce(and_, [passed[r.name] for r in rules if r.base], F.lit(True))
    failed = F.filter(F.array(F.lit(None).cast("string"), *[F.when(~passed[r.name], F.lit(r.name)) for r in rules if not r.base]), lambda x: x.isNotNull())
    return measured.withColumn("base_failed", base).withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def keep_good(docs: DataFrame, *, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that pass every rule."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text}`").alias("__body"))
    judged = apply_rules(row, text="__body", carry=("__row",), rules=rules)
    # the row number keeps the filter above the projection; pushed below it, the measures would be computed twice
    kept = judged.withColumn("__at", F.monotonically_increasing_id()).filter("kept and __at >= 0")
    return kept.select("__row.*")
