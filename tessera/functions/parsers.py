"""Parsers of generated text, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def self_instruct(df: DataFrame, response_col: str, language: str = "EN") -> DataFrame:
    """One row (piece, instruction, input, output) for each well-formed block of a response.

    A block must hold the end marker and exactly three labels, each after white space. A number that precedes a label, whatever it is, belongs to the label.
    """
    one, two, three = T.LABELS[language]
    label = rf"(?:\d+\.)?\s+(?:{one}|{two}|{three}):"
    pieces = F.split(F.concat(F.lit(f"1. {one}: "), F.col(response_col)), "#####", -1)
    rows = df.select(*[c for c in df.columns if c != response_col], F.posexplode(pieces).alias("piece", "_raw"))
    rows = rows.where(F.contains("_raw", F.lit(T.EOI))).withColumn("_raw", T.strip(F.col("_raw"))).where(F.regexp_count("_raw", F.lit(label)) == 3)
    whole = rf"(?s)^.*?{label}(.*?){label}(.*?){label}(.*)$"
    part = lambda k: F.regexp_extract("_raw", whole, k)
    return rows.select(
        *[c for c in rows.columns if c != "_raw"], T.strip(part(1)).alias("instruction"), T.decode_no_input(T.strip(part(2))).alias("input"), F.replace(T.strip(part(3)), F.lit(T.EOI), F.lit("")).alias("output"),
    )


def problem_solution(response: Column) -> Column:
    """struct<problem, solution> from the lines between and after the first markers of each; null if one lacks or they are out of order (O100)."""
    lines = F.split(response, r"(?<=\n)")
    low = F.transform(lines, F.lower)
    is_problem = F.transform(low, lambda x: F.contains(x, F.lit("[problem description]")) | F.contains(x, F.lit("**problem description**")))
    is_solution = F.transform(low, lambda x: F.contains(x, F.lit("[solution]")) | F.contains(x, F.lit("**solution**")))
    a, b = F.array_position(is_problem, F.lit(True)).cast("int"), F.array_position(is_solution, F.lit(True)).cast("int")
    between = F.array_join(F.slice(lines, a + 1, b - a - 1), "")
    after = F.array_join(F.slice(lines, b + 1, F.size(lines)), "")
    return F.when((a > 0) & (b > 0) & (a < b), F.struct(T.strip(between).alias("problem"), T.strip(after).alias("solution")))


def evolved(response: Column) -> Column:
    """The text between the first and the second marker, or after the only one; without a marker empty (O101)."""
    return T.strip(F.coalesce(F.get(F.split(response, "\\Q" + T.EVOLVED + "\\E", -1), F.lit(1)), F.lit("")))


def dialogue(response: Column) -> Column:
    """array<struct<content, role>> from text with "User:" and "AI:" (O102).

    Text of a segment without "AI:" waits, replacing what waited before, and precedes the next segment's user text.
    """
    say = lambda c, role: F.struct(c.alias("content"), F.lit(role).alias("role"))
    empty = F.array().cast("array<struct<content:string,role:string>>")
    start = F.struct(F.lit("").alias("waits"), empty.alias("messages"))

    def step(acc: Column, segment: Column) -> Column:
        parts = F.split(segment, "AI:", -1)
        asked = F.concat(acc["waits"], T.strip(parts[0]))
        answer = F.concat(T.strip(F.get(parts, F.lit(1))), F.coalesce(T.strip(F.get(parts, F.lit(2))), F.lit("")))
        talk = F.concat(acc["messages"], F.array(say(asked, "user"), say(answer, "assistant")))
        return F.when(F.size(parts) > 1, F.struct(F.lit("").alias("waits"), talk.alias("messages"))).otherwise(F.struct(T.strip(segment).alias("waits"), acc["messages"].alias("messages")))

    return F.aggregate(F.split(response, "User:", -1), start, step, lambda acc: acc["messages"])


def root_verb_object(sentence: Column) -> Column:
    """struct<verb, noun>: the first word of a text and the next one that is longer than three letters. A stand-in for a
    dependency parse, which needs a model; supply those columns instead where a parser is at hand (O127)."""
    w = T.words(F.lower(F.regexp_replace(sentence, r"[^\p{L}\s]", "")))
    return F.struct(F.get(w, F.lit(0)).alias("verb"), F.get(F.filter(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x: F.length(x) > 3), F.lit(0)).alias("noun"))
