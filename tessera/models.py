"""The boundary to models: protocols for generators, scorers, embedders and translators, and offline stand-ins."""

import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import chat, prompts
from tessera.functions import text as T

REQUEST = "prompt string, max_tokens int, do_sample boolean, temperature double, top_p double, stop_sequences array<string>"
RESPONSE = "prompt string, response string, created_at string"


@dataclass(frozen=True)
class Sampling:
    max_tokens: int = 1024
    do_sample: bool = True
    temperature: float = 1.0
    top_p: float = 1.0
    stop_sequences: tuple[str, ...] = field(default_factory=tuple)


class Client(Protocol):
    """Answers a batch of prompts; built once for each task."""

    name: str

    def __call__(self, prompts: list[str], sampling: Sampling) -> list[str]: ...


def generate(df: DataFrame, prompt_col: str, client: Callable[[], Client], sampling: Sampling = Sampling(), batch: int = 16, response_col: str = "response", retries: int = 3,
             wait: float = 0.0, growth: float = 1.1) -> DataFrame:
    """Adds ``response_col`` (U1). A client is built once per task and asked for ``batch`` prompts at a time; a failing batch is tried again after
    ``wait`` seconds, each time ``growth`` times as many, then fails the task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = client()
        for prompts in batches:
            out: list[str] = []
            for at in range(0, len(prompts), batch):
                some = [p or "" for p in prompts[at : at + batch]]
                for left in range(retries, -1, -1):
                    try:
                        out += ask(some, sampling)
                        break
                    except Exception:
                        if not left:
                            raise
                        time.sleep(wait * growth ** (retries - left))
            yield pd.Series(out, dtype=object)

    return df.withColumn(response_col, F.pandas_udf(run, "string")(F.col(prompt_col)))


def generate_chat(df: DataFrame, messages_col: str, client: Callable[[], Client], sampling: Sampling = Sampling(), template: Callable[[Column], Column] = chat.chatml, **more) -> DataFrame:
    """Responses to conversations rendered by a chat template."""
    told = generate(df.withColumn("_prompt", template(F.col(messages_col))), "_prompt", client, sampling, **more)
    return told.drop("_prompt")


def translate_text(df: DataFrame, text_col: str, source: str, target: str, client: Callable[[], Client], template: str = prompts.TRANSLATE, out_col: str = "translated", marker: str = "##EOT##", wait: float = 1.0) -> DataFrame:
    """Adds the text in another language (U6), up to the marker that ends a translation, with retries that wait; what is wanted in English stays as it
    is. ``template`` has {source_lang}, {target_lang} and {text}."""
    if target.lower().split("-")[0] == "en":
        return df.withColumn(out_col, F.col(text_col))
    prompt = prompts.fill(template, source_lang=T.language_name(F.lit(source)), target_lang=T.language_name(F.lit(target)), text=F.col(text_col))
    told = generate(df.withColumn("_prompt", prompt), "_prompt", client, response_col=out_col, wait=wait)
    return told.withColumn(out_col, T.strip(F.substring_index(out_col, marker, 1))).drop("_prompt")


def score_prompts(df: DataFrame, prompt_col: str, scorer: Callable[[], Callable[[list[str]], list[list[float]]]], out_col: str) -> DataFrame:
    """Adds an array of numbers for each prompt, such as the log probabilities of the scores 1 to 6; a scorer is built once per task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = scorer()
        for told in batches:
            yield pd.Series([list(map(float, x)) for x in ask([p or "" for p in told])], dtype=object)

    return df.withColumn(out_col, F.pandas_udf(run, "array<double>")(F.col(prompt_col)))


@dataclass
class Echo:
    """Answers each prompt by itself, or by a function of it."""

    name: str = "echo"
    reply: Callable[[str], str] = str

    def __call__(self, prompts: list[str], sampling: Sampling) -> list[str]:
        return [self.reply(p) for p in prompts]


def replay(df: DataFrame, prompt_col: str, table: DataFrame, response_col: str = "response") -> DataFrame:
    """Recorded responses by the prompt's hash, a plain join; ``table`` has (prompt, response)."""
    known = table.select(F.sha2("prompt", 256).alias("_h"), F.col("response").alias(response_col))
    return df.withColumn("_h", F.sha2(F.col(prompt_col), 256)).join(known, "_h", "left").drop("_h")


Translator = Callable[[Column, Column], Column]


def identity_translator(text: Column, target: Column) -> Column:
    return text


def hashed_embedding(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 64) -> DataFrame:
    """A stand-in for a sentence encoder (U4): signed counts of hashed words and character trigrams, of unit length."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim)
            low = (t or "").lower()
            for g in [*low.split(), *(low[i : i + 3] for i in range(len(low) - 2))]:
                h = zlib.crc32(g.encode())
                v[h % dim] += 1 if h & 0x80000000 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return df.withColumn(out_col, embed(F.col(text_col)))


# Frequent words of four languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "mit", "zu", "den"],
    "fr": ["le", "la", "les", "de", "et", "des", "est", "une", "dans", "que"],
    "es": ["el", "la", "los", "de", "y", "que", "en", "una", "por", "con"],
}


def identify_language(text: Column) -> Column:
    """struct<lang, confidence>: a stand-in for a language identifier (U5), the share of each language's frequent words among all such words."""
    w = F.split(F.lower(F.regexp_replace(text, r"\s+", " ")), " ")

    def vote(lang: str) -> Column:
        return F.struct(F.size(F.filter(w, lambda x: x.isin(STOP_WORDS[lang]))).alias("n"), F.lit(lang).alias("lang"))

    votes = [vote(lang) for lang in sorted(STOP_WORDS)]
    best = F.array_max(F.array(*votes))
    total = sum((v["n"] for v in votes[1:]), votes[0]["n"])
    return F.struct(F.when(best["n"] > 0, best["lang"]).alias("lang"), F.when(total > 0, best["n"] / total).otherwise(0.0).alias("confidence"))


ANALYSES = ("categories", "complexity", "quality", "tagging", "tokens", "embeddings", "reward_modelling")


class Analyzers:
    """Named analyses, each a function DataFrame -> DataFrame that adds its column (U3); results are written once by (analysis, dataset)."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, run: Callable[[DataFrame], DataFrame]) -> None:
        if name not in ANALYSES:
            raise ValueError(f"unknown analysis {name}")
        self.known[name] = run

    @classmethod
    def standard(cls, models: dict[str, Callable], scores: int = 6, budget: int = 2048) -> "Analyzers":
        """The seven analyses over (instruction, response), each by a model that is given by its name: categories and tagging a client's factory,
        complexity, quality and reward_modelling a scorer's, embeddings a function of a table and a column. Tokens are words."""
        found = cls()

        def expected(name: str, template: str) -> None:
            def run(df: DataFrame) -> DataFrame:
                left = F.lit(budget - len(template.split())) - T.word_count(F.col("instruction"))
                prompt = prompts.fill(template, instruction=F.col("instruction"), output=T.truncate_words(F.col("response"), left))
                told = score_prompts(df.withColumn("_prompt", prompt), "_prompt", models[name], "_told")
                return told.withColumn(name, T.expected_score([F.get("_told", F.lit(k)) for k in range(scores)])).drop("_prompt", "_told")

            found.register(name, run)

        def asked(name: str, prompt: Callable[[], Column], read: Callable[[Column], Column]) -> None:
            def run(df: DataFrame) -> DataFrame:
                told = generate(df.withColumn("_prompt", prompt()), "_prompt", models[name], response_col="_told")
                return told.withColumn(name, read(F.col("_told"))).drop("_prompt", "_told")

            found.register(name, run)

        def reward(df: DataFrame) -> DataFrame:
            prompt = prompts.fill(prompts.CATEGORY, instruction=F.col("instruction"), output=F.col("response"))
            told = score_prompts(df.withColumn("_prompt", prompt), "_prompt", models["reward_modelling"], "_told")
            return told.withColumn("reward_modelling", F.get("_told", F.lit(0))).drop("_prompt", "_told")

        for name, run in (
            ("categories", lambda: asked("categories", lambda: prompts.fill(prompts.CATEGORY, instruction=F.col("instruction"), output=F.col("response")), T.strip)),
            ("tagging", lambda: asked("tagging", lambda: F.col("instruction"), T.parse_tags)),
            ("complexity", lambda: expected("complexity", prompts.COMPLEXITY)),
            ("quality", lambda: expected("quality", prompts.QUALITY)),
            ("reward_modelling", lambda: found.register("reward_modelling", reward)),
        ):
            if name in models:
                run()
        found.register("tokens", lambda df: df.withColumn("tokens", T.word_count(F.concat_ws(" ", "instruction", "response"))))
        embed = models.get("embeddings", hashed_embedding)
        found.register("embeddings", lambda df: embed(df.withColumn("_text", F.concat_ws(" ", "instruction", "response")), "_text", "embeddings").drop("_text"))
        return found

    def run(self, df: DataFrame, names: list[str]) -> DataFrame:
        for n in names:
            df = self.known[n](df)
        return df
