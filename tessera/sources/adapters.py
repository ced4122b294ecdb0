"""A catalogue of instruction datasets: each name maps to a reader and one of ten shapes that give
(ordinal, instruction, response) (O06)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import chat

TRIPLE = "instruction string, input string, output string"
MESSAGES = "messages array<struct<role:string,content:string>>"
SHARED = "id string, language string, composition string, conversations array<struct<from:string,value:string>>"
PLAIN = "conversations array<string>"
TREE = "prompt struct<text:string,lang:string,replies:array<struct<text:string>>>"


@dataclass(frozen=True)
class Shape:
    schema: str
    instruction: Callable[[], Column]
    response: Callable[[], Column]
    keep: Callable[[], Column] | None = None


def _joined() -> Column:
    return F.concat("instruction", F.lit("\n\n"), "input")


def _joined_if_any() -> Column:
    return F.when(F.coalesce(F.col("input"), F.lit("")) == "", F.col("instruction")).otherwise(_joined())


def _at(array: str, i: int, fld: str | None = None) -> Callable[[], Column]:
    return lambda: F.get(array, F.lit(i))[fld] if fld else F.get(array, F.lit(i))


def _valid_share() -> Column:
    c = F.col("conversations")
    return (F.size(c) >= 2) & (F.get(c, F.lit(0))["from"] == "human") & (F.get(c, F.lit(1))["from"] == "gpt")


#: A: instruction, blank line, input, always. B: the input only where there is one. D: instruction alone. E: the input is the instruction.
#: F: first two messages of several (F0: of any number). G: last two messages. H: first two shared turns of several (H0: plain strings). I: reply tree
#: in English. J: shared turns that begin with a human and a model.
SHAPES: dict[str, Shape] = {
    "A": Shape(TRIPLE, _joined, lambda: F.col("output")),
    "B": Shape(TRIPLE, _joined_if_any, lambda: F.col("output")),
    "D": Shape("instruction string, output string", lambda: F.col("instruction"), lambda: F.col("output")),
    "E": Shape("input string, output string", lambda: F.col("input"), lambda: F.col("output")),
    "F": Shape(MESSAGES, _at("messages", 0, "content"), _at("messages", 1, "content"), lambda: F.size("messages") > 1),
    "F0": Shape(MESSAGES, _at("messages", 0, "content"), _at("messages", 1, "content")),
    "G": Shape(MESSAGES, lambda: chat.last_pair(F.col("messages"))[0], lambda: chat.last_pair(F.col("messages"))[1], lambda: F.size("messages") > 1),
    "H": Shape(SHARED, _at("conversations", 0, "value"), _at("conversations", 1, "value"), lambda: F.size("conversations") > 1),
    "H0": Shape(PLAIN, _at("conversations", 0), _at("conversations", 1)),
    "I": Shape(TREE, lambda: F.col("prompt.text"), lambda: F.get("prompt.replies", F.lit(0))["text"], lambda: (F.size("prompt.replies") > 0) & (F.col("prompt.lang") == "en")),
    "J": Shape(SHARED, _at("conversations", 0, "value"), _at("conversations", 1, "value"), _valid_share),
}


@dataclass(frozen=True)
class Dataset:
    name: str
    title: str
    path: str
    shape: str
    fmt: str = "jsonl"  # or json (one array), parquet
    where: str | None = None  # SQL predicate, such as language = 'EN' AND composition = 'chat'
    limit: int | None = None


class Catalogue:
    """Registered datasets; ``load`` raises ValueError for an unknown name."""

    def __init__(self, *datasets: Dataset):
        self.datasets = {d.name: d for d in datasets}

    def register(self, dataset: Dataset) -> None:
        if dataset.shape not in SHAPES:
            raise ValueError(f"{dataset.name}: unknown shape {dataset.shape}")
        self.datasets[dataset.name] = dataset

    def load(self, spark: SparkSession, name: str) -> tuple[str, DataFrame]:
        if name not in self.datasets:
            raise ValueError(f"unknown dataset {name}; known: {', '.join(sorted(self.datasets))}")
        d = self.datasets[name]
        return d.title, adapt(read(spark, d), d.shape).withColumn("dataset", F.lit(name))


# Public instruction datasets, by name: title, file and shape. What a hub offers is expected as Parquet.
PUBLIC = """
no_robots | No Robots | no_robots.parquet | F0
flan_v2_cot | Flan V2 CoT | flan_v2_cot.jsonl | B
dolly_15k | Databricks Dolly 15k | dolly_15k.jsonl | B
alpaca | Stanford Alpaca | alpaca_data.json | A
alpaca_gpt4 | Stanford Alpaca (with GPT4) | alpaca-gpt4.parquet | A
lima | LIMA | lima.parquet | H0
bactrian-x_en | Bactrian-X-en | bactrian-x_en.parquet | A
wizardlm_orca | WizardLM-Orca | wizardlm_orca.parquet | D
sharegpt | ShareGPT | ShareGPT_V3_unfiltered_cleaned_split.json | H
oasst2 | OASST2 | 2023-11-05_oasst2_all.trees.jsonl | I
ultrachat | UltraChat | ultrachat_200k.parquet | F
deita_10k | Deita 10K V0 | deita-10k-v0.parquet | H
wizardlm_evol_instruct | WizardLM Evol Instruct V2 | WizardLM_evol_instruct_V2_196k.parquet | H
longform | LongForm | LongForm.parquet | E
gsm8k | GSM8K | gsm8k.jsonl | D
open_math_instruct | MATH | open_math_instruct.jsonl | D
cs_net_python_20k | CodeSearchNet 20k | cs_net_python_20k.jsonl | D
code-search-net | CodeSearchNet 20k | cs_net_python_20k.jsonl | A
UltraInteract_math_28k | UltraInteract 28k (Math only; no interactions) | UltraInteract_math_28k.jsonl | A
magicoder_4k | OSS-Instruct (with DeepSeek V2 Coder Instruct) | magicoder_4k.jsonl | A
nemotron-4-340B_self_instruct | Self-instruct (with Nemotron-4-340B) | nemotron-4-340B_self_instruct.jsonl | A
"""


def public_catalogue(folder: str) -> Catalogue:
    """The public datasets, below a folder; other files are registered by their shape."""
    known = Catalogue()
    for line in PUBLIC.strip().splitlines():
        name, title, file, shape = (x.strip() for x in line.split("|"))
        known.register(Dataset(name, title, f"{folder}/{file}", shape, fmt=file.rsplit(".", 1)[1]))
    return known


def read(spark: SparkSession, d: Dataset) -> DataFrame:
    from tessera.sources.io import with_ordinal

    if d.fmt == "parquet":
        rows = spark.read.parquet(d.path)
    else:
        rows = spark.read.schema(SHAPES[d.shape].schema).option("multiLine", d.fmt == "json").json(d.path)
    rows = rows if d.where is None else rows.where(d.where)
    rows = rows if "ordinal" in rows.columns else with_ordinal(rows)
    return rows if d.limit is None else rows.where(F.col("ordinal") < d.limit)


def adapt(rows: DataFrame, shape: str) -> DataFrame:
    s = SHAPES[shape]
    rows = rows if s.keep is None else rows.where(s.keep())
    return rows.select("ordinal", s.instruction().alias("instruction"), s.response().alias("response"))


def resave_shared(rows: DataFrame, language: str, prefix: str = "teg_v1") -> DataFrame:
    """Shared conversations as chat rows (O17): data_id numbers them, origin is "teg_" and the id without its last token, roles are recoded, and
    the language is the one given."""
    from tessera.operators.ranking import ordinal

    ids = F.split("id", "_")
    counted = ordinal(rows.where(_valid_share()), "ordinal", name="_i")
    return counted.select(
        F.concat(F.lit(f"{prefix}_{language}_"), F.col("_i").cast("string")).alias("data_id"),
        F.concat(F.lit("teg_"), F.array_join(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), "_")).alias("origin"),
        F.lit(language).alias("language"),
        F.transform("conversations", lambda c: F.struct(F.when(c["from"] == "human", "user").otherwise("assistant").alias("role"), c["value"].alias("content"))).alias("messages"),
    )
