"""Expressions over array<struct<role, content>> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T


def triple_messages(instruction: Column, output: Column, input_: Column | None = None) -> Column:
    """A user and an assistant message; with an input column the user says instruction, blank line, input."""
    asked = instruction if input_ is None else F.concat(instruction, F.lit("\n\n"), input_)
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(say("user", asked), say("assistant", output))


def user_text(messages: Column) -> Column:
    """What the user says in all turns, joined by spaces and stripped."""
    return T.strip(F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"]), " "))


def flat_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")


def first_pair(messages: Column) -> tuple[Column, Column]:
    return F.get(messages, F.lit(0))["content"], F.get(messages, F.lit(1))["content"]


def last_pair(messages: Column) -> tuple[Column, Column]:
    return F.try_element_at(messages, F.lit(-2))["content"], F.try_element_at(messages, F.lit(-1))["content"]


def alternates(messages: Column) -> Column:
    """Whether user and assistant take turns, the user first, after at most one system message (O36, O121)."""
    rest = without_system(messages)
    return ~F.exists(F.transform(rest, lambda m, i: (m["role"] == "user") != (i % 2 == 0)), lambda x: x)


def without_system(messages: Column) -> Column:
    system = F.get(messages, F.lit(0))["role"] == "system"
    return F.when(system, F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)


def chatml(messages: Column, end: str = "</s>", after: str = "", generation_prompt: bool = False) -> Column:
    """ChatML text; the defaults are the supervised variant, end="<|im_end|>" and after="\\n" the preference one (O120)."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit(end + after))), "")
    return F.concat(body, F.lit("<|im_start|>assistant\n")) if generation_prompt else body


def llama(messages: Column, strict: bool = False) -> Column:
    """[INST] text with the system message folded into the first user turn; where roles do not alternate null, or an error if ``strict`` (O121)."""
    system = F.when(F.get(messages, F.lit(0))["role"] == "system", messages[0]["content"])

    def turn(m: Column, i: Column) -> Column:
        head = F.when((i == 0) & system.isNotNull(), F.concat(F.lit("<<SYS>>\n"), system, F.lit("\n<</SYS>>\n\n"))).otherwise("")
        said = T.strip(F.concat(head, m["content"]))
        return F.when(m["role"] == "user", F.concat(F.lit("<s>[INST] "), said, F.lit(" [/INST]"))).otherwise(F.concat(F.lit(" "), said, F.lit(" </s>")))

    text = F.array_join(F.transform(without_system(messages), turn), "")
    wrong = F.raise_error(F.lit("Conversation roles must alternate user/assistant/user/assistant/...")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(alternates(messages), text).otherwise(wrong)


def loss_spans(messages: Column, target: str = "assistant") -> Column:
    """array<struct<role, text, is_target>>: which of the rendered pieces a completion-only loss covers (O122)."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("text"), (m["role"] == target).alias("is_target")))
