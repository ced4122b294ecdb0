"""Row filters: quality gates with reasons, language and structure gates, resume and id filters."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def reject_reason(instruction: Column, output: Column, language: str = "EN", raw: Column | None = None, min_words: int = 4, max_output_words: int = 200) -> Column:
    """Why a generated instruction is dropped, the first reason in this order, or null: truncated (only if ``raw`` is given),
    short, long_output, blacklist, write_a_program, punctuation, non_ascii (O33). Null text counts as empty, which is short."""
    inst, out = F.coalesce(instruction, F.lit("")), F.coalesce(output, F.lit(""))
    first = F.substring(inst, 1, 1)
    checks = [] if raw is None else [(~F.contains(raw, F.lit(T.EOI)), "truncated")]
    checks += [
        (T.word_count(inst) < min_words, "short"),
        (T.word_count(out) > max_output_words, "long_output"),
        (T.has_word(inst, T.BLACKLISTS.get(language, [])), "blacklist"),
        (F.startswith(inst, F.lit("Write a program")), "write_a_program"),
        (F.instr(F.lit(T.PUNCTUATION), first) > 0, "punctuation"),
        (F.ascii(first) > 127, "non_ascii"),
    ]
    reason = F.lit(None).cast("string")
    for test, name in reversed(checks):
        reason = F.when(test, name).otherwise(reason)
    return reason


def quality_gate(df: DataFrame, instruction: str = "instruction", output: str = "output", language: str = "EN") -> DataFrame:
    return df.where(reject_reason(F.col(instruction), F.col(output), language).isNull())


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those done (O34, O51); rows with a null key remain."""
    return df.join(done.select(key), key, "left_anti")


def among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def language_filter(df: DataFrame, codes: list[str], language: str = "language", identify: Column | None = None) -> DataFrame:
    """Rows in one of the languages; ``identify`` is asked only where the row does not say."""
    known = F.col(language) if identify is None else F.coalesce(F.col(language), identify)
    return df.withColumn(language, known).where(F.lower(known).isin([c.lower() for c in codes]))


def translation_gate(predicted: Column, confidence: Column, target: Column, least: float = 0.8) -> Column:
    return (F.lower(predicted) == F.lower(target)) & (confidence >= F.lit(least))


def same_structure(before: Column, after: Column, sep: str = T.SEP) -> Column:
    return T.part_count(before, sep) == T.part_count(after, sep)


def glob_names(names: list[str], patterns: list[str]) -> list[str]:
    """The names that match any pattern; a path to a file stands for the task "instruction" (O45)."""
    found = {n for p in patterns for n in names if fnmatch.fnmatchcase(n, p)}
    if any("/" in p or p.endswith(".jsonl") for p in patterns):
        found.add("instruction")
    return sorted(found)


def glob_filter(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column matches a glob, as one pattern on the JVM side."""
    return df.where(F.col(column).rlike("^(?s:" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z") + ")$"))
