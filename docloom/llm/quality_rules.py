"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Each rule bounds one ratio of a text. ``word_counts`` makes the counts, ``rule_columns`` the ratios and verdicts.

Edge cases: a null text counts as empty; an empty text has no words and fails the base rule; ratios of an empty
text are 0. Rows are judged one by one, so repeated rows and ids give repeated results, and only ``doc_id`` and
``text`` are read, so further columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WORD

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    *("the", "and", "of", "to", "in", "is", "that", "a", "it", "for", "with", "as", "on", "by", "this"),
    *("der", "die", "das", "und", "ist", "zu", "den", "mit", "von", "nicht", "ein", "eine", "für"),
    *("le", "la", "les", "des", "et", "de", "en", "un", "une", "du", "que", "est", "pour"),
    *("el", "los", "las", "y", "por", "con", "para", "se", "del", "al", "no"),
)


@dataclass(frozen=True)
class Rule:
    """``measure`` is SQL over the counts; the text passes if low <= measure <= high."""

    name: str
    measure: str
    low: float
    high: float


#: The threshold table.
RULES = (
    Rule("word_count", "n_words", 50, 100_000),
    Rule("mean_word_chars", "word_chars / n_words", 2, 12),
    Rule("symbols_per_word", "n_symbols / n_words", 0, 0.1),
    Rule("stop_words_per_word", "n_stop_words / n_words", 0.01, 1),
    Rule("alphabetic_words_per_word", "n_alpha_words / n_words", 0.6, 1),
    Rule("shouted_words_per_word", "n_shouted_words / n_words", 0, 0.3),
    Rule("duplicate_lines_per_line", "n_dup_lines / n_lines", 0, 0.3),
    Rule("bullet_lines_per_line", "n_bullet_lines / n_lines", 0, 0.9),
    Rule("ellipsis_lines_per_line", "n_ellipsis_lines / n_lines", 0, 0.3),
    Rule("repeated_words_per_word", "n_repeat_words / n_words", 0, 0.5),
)


def _repeat_words(words: str) -> str:
    """SQL for the number of words in 3-word windows found twice or more.

    Windows become longs of a hash above their position. Sorted, equal windows are neighbours; the words themselves
    are compared there, so that a hash shared by different windows counts for nothing. The next neighbour but one is
    compared as well, so one window that happens to have the hash of two equal ones and lies between them hides nothing.
    Positions fit the low bits, of which there are as many as the text takes.
    """
    bits = f"if(size({words}) < 1048576, 20, if(size({words}) < 67108864, 26, 31))"
    place = f"bigint(x & (shiftleft(1L, {bits}) - 1))"
    same = (
        f"(shiftright(x, {bits}) = shiftright(y, {bits})"
        f" and get({words}, int(x & m)) = get({words}, int(y & m))"
        f" and get({words}, int(x & m) + 1) = get({words}, int(y & m) + 1)"
        f" and get({words}, int(x & m) + 2) = get({words}, int(y & m) + 2))"
    ).replace("& m", f"& (shiftleft(1L, {bits}) - 1)")
    near = " or ".join(f"coalesce({same.replace('y', f'get(s, k {step})')}, false)" for step in ("- 1", "+ 1", "- 2", "+ 2"))
    windows = (
        f"transform(slice({words}, 1, greatest(0, size({words}) - 2)), (x, i) ->"
        f" shiftleft(xxhash64(x, get({words}, i + 1), get({words}, i + 2)), {bits}) | bigint(i))"
    )
    # a one-element array carries each intermediate array into the next lambda
    return f"""get(transform(array(sort_array({windows})), s ->
        get(transform(array(sort_array(transform(filter(s, (x, k) -> {near}),
            x -> {place}))), p ->
            aggregate(transform(p, (x, k) -> least(3L, coalesce(get(p, k + 1) - x, 3L))), 0L, (a, x) -> a + x)), 0)), 0)"""


def word_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts that the rules measure, for each row: all from built-in functions, without a shuffle."""
    text = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    split = text.select(
        *keep,
        "text",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    size = {
        "n_words": "size(words)",
        "word_chars": r"length(translate(text, ' \t\n\u000b\u000c\r', ''))",
        "n_symbols": "length(text) - length(translate(text, '#*$%&|<>', ''))",
        "n_dup_lines": "size(lines) - size(array_distinct(lines))",
        "n_repeat_words": f"if(size(words) < 3, 0, {_repeat_words('words')})",
        "n_lines": "size(lines)",
        "n_bullet_lines": r"size(filter(lines, x -> x rlike '^[ \\t]*[-*•] '))",
        "n_ellipsis_lines": r"size(filter(lines, x -> x rlike '(\\.\\.\\.|…)[ \\t]*$'))",
        "n_stop_words": f"size(filter(words, x -> lower(x) in ({stop})))",
        "n_alpha_words": r"size(filter(words, x -> x rlike '\\p{L}'))",
        "n_shouted_words": r"size(filter(words, x -> x rlike '^[^\\p{Ll}]*\\p{Lu}[^\\p{Ll}]*\\p{Lu}[^\\p{Ll}]*$'))",
    }
    return split.select(*keep, *(F.expr(sql).cast("long").alias(name) for name, sql in size.items()))


def rule_columns(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """One boolean per rule: whether the text breaks it."""
    out = []
    for rule in rules:
        top, _, bottom = rule.measure.partition(" / ")
        value = F.expr(f"coalesce(try_divide({top}, {bottom}), 0)" if bottom else top)
        out.append((~value.between(rule.low, rule.high)).alias(f"breaks_{rule.name}"))
    return out


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, the base rule, each rule's verdict, and ``kept``: the base rule and all others pass."""
    counts = word_counts(docs, keep)
    judged = counts.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        *rule_columns(rules),
    )
    broken = F.col("base_failed")
    for rule in rules:
        broken = broken | F.col(f"breaks_{rule.name}")
    return judged.withColumn("kept", ~broken)
