"""Checks on a source text and its counterpart (translation, rewrite)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.numbers import fixed2, python_round
from corpusmill.functions.text import col, let, strip, words

# Letters of the Arabic script, as regex ranges.
ARABIC_RANGES = (
    r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{0870}-\x{08FF}"
    r"\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}\x{10EC0}-\x{10EFF}\x{1EE00}-\x{1EEFF}"
)

# Phrases of a model that declines to answer.
REFUSAL_PHRASES = (
    r"i'?m sorry",
    r"i cannot",
    r"i can'?t (help|assist|provide)",
    r"as an ai",
    r"i am unable",
    r"cannot fulfill",
    r"i must decline",
    r"it is not appropriate",
    r"if you are in crisis",
    r"please (seek|contact|reach out to) ",
)

# Flags that mean lost content.
HARD_FLAGS = ("empty", "refusal", "too_short", "script_residue", "degenerate")


@dataclass(frozen=True)
class QualityRules:
    """Thresholds and patterns of the pair checks."""

    script_ranges: str = ARABIC_RANGES
    placeholder: str = "<PERS>"
    refusal_phrases: tuple[str, ...] = REFUSAL_PHRASES
    refusal_head: int = 400
    refusal_ratio: float = 0.9
    short_ratio: float = 0.55
    long_ratio: float = 2.5
    residue_limit: float = 0.10
    loop_limit: float = 0.15
    loop_window: int = 40
    loop_floor: float = 0.30


DEFAULT_RULES = QualityRules()


def len_ratio(src: Column | str, out: Column | str) -> Column:
    """Characters of ``out`` per character of ``src``, at least one of the latter."""
    return F.length(col(out)).cast("double") / F.greatest(F.length(col(src)), F.lit(1))


def script_ratio(c: Column | str, ranges: str = ARABIC_RANGES) -> Column:
    """Share of the letters that belong to a script; 0.0 without letters."""
    letters = F.regexp_replace(col(c), r"\P{L}+", "")

    def share(text: Column) -> Column:
        inside = F.length(F.regexp_replace(text, f"[^{ranges}]+", ""))
        return F.when(text != "", inside / F.length(text)).otherwise(F.lit(0.0))

    return let(letters, share)


def looping_ratio(c: Column | str, window: int = 40, floor: float = 0.30) -> Column:
    """Share of half-overlapping word windows with few distinct words.

    Windows start every ``window // 2`` words and before word ``n - window``; a text
    of at most ``window`` words has none and gives 0.0.
    """
    step = window // 2

    def share(w: Column) -> Column:
        n = F.size(w)
        starts = F.sequence(F.lit(0), F.greatest(n - (window + 1), F.lit(0)), F.lit(step))
        poor = F.filter(
            starts,
            lambda i: F.size(F.array_distinct(F.slice(w, i + 1, window))) / F.lit(window) < floor,
        )
        return F.when(n > window, F.size(poor) / F.size(starts)).otherwise(F.lit(0.0))

    return let(words(F.lower(col(c))), share)


def placeholder_count(c: Column | str, token: str) -> Column:
    """Occurrences of a literal token."""
    gone = F.length(F.replace(col(c), F.lit(token), F.lit("")))
    return ((F.length(col(c)) - gone) / F.lit(len(token))).cast("int")


def is_refusal(out: Column | str, ratio: Column, rules: QualityRules = DEFAULT_RULES) -> Column:
    """A refusal phrase near the start of a short output."""
    pattern = rf"(?iU)\b({'|'.join(rules.refusal_phrases)})"
    return F.rlike(F.substring(col(out), 1, rules.refusal_head), F.lit(pattern)) & (
        ratio < rules.refusal_ratio
    )


MEASURES = ("is_empty", "ratio", "refused", "residue", "out_loop", "src_marks", "out_marks")


def pair_measures(src: Column | str, out: Column | str, rules: QualityRules = DEFAULT_RULES) -> Column:
    """Struct of the ``MEASURES`` that flags are made from, beside the ``source_loop``."""
    ratio = len_ratio(src, out)
    return F.struct(
        (strip(out) == "").alias("is_empty"),
        ratio.alias("ratio"),
        is_refusal(out, ratio, rules).alias("refused"),
        script_ratio(out, rules.script_ranges).alias("residue"),
        looping_ratio(out, rules.loop_window, rules.loop_floor).alias("out_loop"),
        placeholder_count(src, rules.placeholder).alias("src_marks"),
        placeholder_count(out, rules.placeholder).alias("out_marks"),
    )


def source_loop(src: Column | str, rules: QualityRules = DEFAULT_RULES) -> Column:
    """``looping_ratio`` of the source: costly, and flags need it only where the output loops."""
    return looping_ratio(src, rules.loop_window, rules.loop_floor)


def flags_from_measures(
    m: Column | Mapping[str, Column], src_loop: Column, rules: QualityRules = DEFAULT_RULES, details: bool = False
) -> Column:
    """Flag array from the measures of a pair; ``details`` adds the numbers in brackets.

    ``src_loop`` is evaluated for pairs whose output loops, and for no others.
    """

    def named(kind: str, *numbers: Column | str) -> Column:
        if not details or not numbers:
            return F.lit(kind)
        return F.concat(F.lit(f"{kind}("), *[F.lit(n) if isinstance(n, str) else n for n in numbers], F.lit(")"))

    ratio, residue = m["ratio"], m["residue"]
    out_loop = m["out_loop"]
    src_marks, out_marks = m["src_marks"], m["out_marks"]
    loops = (out_loop > rules.loop_limit) & (out_loop > src_loop + rules.loop_limit)
    checks = F.array(
        F.when(m["refused"], named("refusal")),
        F.when(ratio < rules.short_ratio, named("too_short", fixed2(ratio))).when(
            ratio > rules.long_ratio, named("too_long", fixed2(ratio))
        ),
        F.when(residue > rules.residue_limit, named("script_residue", fixed2(residue))),
        F.when(loops, named("degenerate", fixed2(out_loop), ">", fixed2(src_loop))),
        F.when(
            src_marks != out_marks,
            named("placeholder", src_marks.cast("string"), "->", out_marks.cast("string")),
        ),
    )
    return F.when(m["is_empty"], F.array(F.lit("empty"))).otherwise(F.array_compact(checks))


def quality_flags(
    src: Column | str, out: Column | str, rules: QualityRules = DEFAULT_RULES, details: bool = False
) -> Column:
    """All flags of a pair; an empty array means it looks sound."""
    return let(pair_measures(src, out, rules), lambda m: flags_from_measures(m, source_loop(src, rules), rules, details))


def flag_kind(flag: Column) -> Column:
    """Flag name without its numbers."""
    return F.substring_index(flag, "(", 1)


def hard_flags(flags: Column | str, hard: tuple[str, ...] = HARD_FLAGS) -> Column:
    """The flags that mean lost content."""
    return F.filter(col(flags), lambda f: flag_kind(f).isin(*hard))


def rounded_measures(m: Column | Mapping[str, Column]) -> dict[str, Column]:
    """Stored numbers of a checked pair."""
    return {
        "len_ratio": python_round(m["ratio"], 3),
        "residue_ratio": python_round(m["residue"], 3),
        "marks_src": m["src_marks"],
        "marks_out": m["out_marks"],
    }


