"""Prompt assembly. Long prompts are parameters: a template with {named} fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

# The formats that the scoring models were trained with.
COMPLEXITY = "You are a helpful assistant. Please identify the complexity score of the following user query. \n##Query: {instruction}  \n##Complexity: "
QUALITY = "You are a helpful assistant. Please identify the quality score of the Response corresponding to the Question. \n #Question#:\n{instruction}\n#Response#:\n{output} \n##Quality: "
CATEGORY = "USER: {instruction}\n\nASSISTANT: {output}"
# Our own wording, by default; what the answers' parsers look for is named in each.
EVOLVE = (
    "Make the task below harder, but keep it one that a person can understand and a model can answer.\n"
    "First list three ways to add to it, then plan which to use, then write the new task, then look for what is unreasonable in it and mend that.\n"
    f"End with the mended task alone, after the line\n{T.EVOLVED}\n\nTask:\n{{instruction}}\n"
)
EVERYDAY = (
    "Write a short everyday talk of four to eight turns between a person and a helpful assistant about {topics}. Sentences are short and plain.\n"
    "The person's turns start with \"User:\", the assistant's with \"AI:\", each on a line of its own. The first line is\nUser: {greeting}\n"
)
PROBLEM = (
    "Let the piece of code below inspire a programming problem of your own, complete in itself, and solve it.\n\nCode:\n{code}\n\n"
    "Answer in two parts, the first after the line\n[Problem Description]\nand the second, the whole solution, after the line\n[Solution]\n"
)
TRANSLATE = "Translate the text from {source_lang} into {target_lang}. Keep its lines, code and names. End the translation with ##EOT##.\n\nText:\n{text}\n\nTranslation:\n"
JUDGE = (
    "Which of two translations into {target_language} says the same as the source text, more faithfully and in better {target_language}?\n\n"
    "Source text:\n{source_text}\n\nTranslation (a):\n{translation_1}\n\nTranslation (b):\n{translation_2}\n\n"
    f"Answer with \"Translation (a)\" or \"Translation (b)\" and nothing else, then {T.EOS}\n"
)
INSTRUCTION = "### Instruction:\n{instruction}\n\n### Response:"


def fill(template: str, **fields: Column) -> Column:
    """The template with its {fields} replaced; a null field makes the prompt null. Other braces stay as they are."""
    parts = re.split(r"\{(" + "|".join(map(re.escape, fields)) + r")\}", template)
    return F.concat(*(fields[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def few_shot(examples: Column, language: str = "EN") -> Column:
    """Numbered blocks of an array<struct<instruction, input, output>>."""
    one, two, three = T.LABELS[language]

    def block(x: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        return F.concat(
            F.lit("#####\n"), n, F.lit(f". {one}: "), T.squeeze(x["instruction"]), F.lit("\n"), n, F.lit(f". {two}:\n"), T.encode_no_input(x["input"]), F.lit("\n"), n, F.lit(f". {three}:\n"), x["output"], F.lit(T.EOI + "\n"),
        )

    return F.array_join(F.transform(examples, block), "")
