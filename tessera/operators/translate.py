"""Packing of samples for translation and back, for every shape of document, and the pairing of preference rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


@dataclass(frozen=True)
class Task:
    """How a document becomes one translatable string and how a translated string becomes a document again (U7, O103).

    ``pack`` gives a string column; ``unpack`` takes the parts, an array of strings, and gives the replaced columns by name.
    """

    name: str
    pack: Callable[[], Column]
    unpack: Callable[[Column], dict[str, Column]]
    trailing: bool = True
    strategy: str = "simple"
    topic: Callable[[], Column] | None = None

    def packed(self, df: DataFrame, column: str = "combined") -> DataFrame:
        return df.withColumn(column, self.pack())

    def unpacked(self, df: DataFrame, translated: str = "translated", original: str = "combined") -> DataFrame:
        """Documents whose translation has as many parts as the original (O41), with their columns replaced."""
        ok = df.where(T.part_count(F.col(translated)) == T.part_count(F.col(original)))
        return ok.withColumns(self.unpack(T.unpack(F.col(translated), trailing=self.trailing)))


def _one(*names: str) -> Column:
    return F.array(*(F.col(n) for n in names))


def _from(parts: Column, start: int | Column) -> Column:
    """The parts from a place (from 0) on."""
    at = F.lit(start) if isinstance(start, int) else start
    return F.slice(parts, at + 1, F.greatest(F.size(parts) - at, F.lit(0)))


def _unpack_messages(parts: Column) -> dict[str, Column]:
    """The original roles with the translated texts."""
    return {"messages": F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.trim(F.get(parts, i)).alias("content")))}


TASKS: dict[str, Task] = {
    "arc": Task("arc", lambda: T.pack(_one("question"), F.col("choices.text"), trailing=True), lambda p: {"question": p[0], "choices": F.struct(_from(p, 1).alias("text"), F.col("choices.label").alias("label"))}),
    "hellaswag": Task(
        "hellaswag", lambda: T.pack(_one("activity_label", "ctx_a", "ctx_b"), F.col("endings"), trailing=True),
        lambda p: {"activity_label": p[0], "ctx_a": p[1], "ctx_b": p[2], "ctx": F.concat(p[1], F.lit(" "), p[2]), "endings": _from(p, 3)}, strategy="topics", topic=lambda: F.split("source_id", "~")[0],
    ),
    "mmlu": Task("mmlu", lambda: T.pack(_one("question"), F.col("choices"), trailing=True), lambda p: {"question": p[0], "choices": _from(p, 1)}),
    "gsm8k": Task("gsm8k", lambda: T.pack(_one("question", "answer"), trailing=False), lambda p: {"question": p[0], "answer": T.restore_entities(p[1])}, trailing=False),
    "truthfulqa_mc": Task(
        "truthfulqa_mc", lambda: T.pack(_one("question"), F.col("mc1_targets.choices"), F.col("mc2_targets.choices"), trailing=True),
        lambda p: {
            "question": p[0],
            "mc1_targets": F.struct(F.slice(p, 2, F.size("mc1_targets.labels")).alias("choices"), F.col("mc1_targets.labels").alias("labels")),
            "mc2_targets": F.struct(_from(p, F.size("mc1_targets.labels") + 1).alias("choices"), F.col("mc2_targets.labels").alias("labels")),
        },
    ),
    "truthfulqa_gen": Task(
        "truthfulqa_gen", lambda: T.pack(_one("question", "best_answer"), F.col("correct_answers"), F.col("incorrect_answers"), trailing=True),
        lambda p: {"question": p[0], "best_answer": p[1], "correct_answers": F.slice(p, 3, F.size("correct_answers")), "incorrect_answers": _from(p, F.size("correct_answers") + 2)},
        strategy="topics", topic=lambda: F.concat("type", F.lit("/"), "category"),
    ),
    "triple": Task("triple", lambda: T.pack(_one("instruction", "input", "output")), lambda p: {"instruction": p[0], "input": p[1], "output": p[2]}, trailing=False),
    "seed": Task(
        "seed", lambda: T.pack(F.array(F.col("instruction"), F.col("instances")[0]["input"], F.col("instances")[0]["output"])),
        lambda p: {"instruction": p[0], "instances": F.array(F.struct(p[1].alias("input"), p[2].alias("output")))}, trailing=False,
    ),
    "messages": Task("messages", lambda: T.pack(F.transform("messages", lambda m: m["content"]), sep=f" {T.SEP} "), _unpack_messages, trailing=False),
    "preference": Task(
        "preference", lambda: T.pack(F.transform(F.concat(F.col("prompt"), F.flatten("completion")), lambda m: m["content"])),
        lambda p: {
            "prompt": F.transform("prompt", lambda m, i: F.struct(m["role"].alias("role"), F.get(p, i).alias("content"))),
            "completion": F.transform("completion", lambda c, i: F.array(F.struct(c[0]["role"].alias("role"), F.get(p, F.size("prompt") + i).alias("content")))),
        }, trailing=False,
    ),
}


TASKS["winogrande"] = Task("winogrande", lambda: T.pack_blank(F.col("sentence")), lambda p: {"sentence": F.replace(p[0], F.lit("<x>_</x>"), F.lit("_"))}, trailing=False)

# The subjects of a public multiple-choice benchmark, and the two sets of another.
SUBJECTS = """
    abstract_algebra anatomy astronomy business_ethics clinical_knowledge college_biology college_chemistry college_computer_science college_mathematics
    college_medicine college_physics computer_security conceptual_physics econometrics electrical_engineering elementary_mathematics formal_logic
    global_facts high_school_biology high_school_chemistry high_school_computer_science high_school_european_history high_school_geography
    high_school_government_and_politics high_school_macroeconomics high_school_mathematics high_school_microeconomics high_school_physics
    high_school_psychology high_school_statistics high_school_us_history high_school_world_history human_aging human_sexuality international_law
    jurisprudence logical_fallacies machine_learning management marketing medical_genetics miscellaneous moral_disputes moral_scenarios nutrition
    philosophy prehistory professional_accounting professional_law professional_medicine professional_psychology public_relations security_studies
    sociology us_foreign_policy virology world_religions
""".split()
ARC_SETS = {"arc_challenge": "ARC-Challenge", "arc_easy": "ARC-Easy"}


def task_registry() -> dict[str, tuple[Task, str | None]]:
    """The tasks by the names that they are asked for, each with the subset of its dataset (U7): one for each subject and set, and the others alone."""
    known = {name: (TASKS["arc"], subset) for name, subset in ARC_SETS.items()}
    known |= {name: (TASKS[name], None) for name in ("hellaswag", "truthfulqa_mc", "truthfulqa_gen", "gsm8k")}
    known |= {f"hendrycks_{subject}": (TASKS["mmlu"], subject) for subject in SUBJECTS}
    return known | {"instruction": (TASKS["triple"], None)}


def pack_pairs(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Rows 2k and 2k + 1 of a preference set become one with both completions."""
    return df.groupBy(F.floor(F.col(ordinal) / 2).alias("pair")).agg(
        F.min_by("data_id", ordinal).alias("data_id"), F.min_by("prompt", ordinal).alias("prompt"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal), F.col("completion")))), lambda x: x["completion"]).alias("completion"),
    )  # two rows at most


def unpack_pairs(df: DataFrame) -> DataFrame:
    """One row for each completion: label true for the first, false for the second, whose id's last number is one higher."""
    rows = df.select("data_id", "prompt", F.posexplode("completion").alias("_at", "completion"))
    return rows.select(F.when(F.col("_at") == 0, F.col("data_id")).otherwise(T.next_number(F.col("data_id"))).alias("data_id"), "prompt", "completion", (F.col("_at") == 0).alias("label"))


def parameter_grid(spark, **axes: list) -> DataFrame:
    """Every combination of a few parameter values (O55); the values are the driver's."""
    from itertools import product

    names = list(axes)
    return spark.createDataFrame([tuple(x) for x in product(*axes.values())], names)


def row_id(ordinal: Column, data_id: Column | None = None, id_: Column | None = None, subject: str | None = None) -> Column:
    """data_id, else id, else the counter, with its subject in front if there is one."""
    counter = ordinal.cast("string") if subject is None else F.concat(F.lit(subject + "/"), ordinal.cast("string"))
    return F.coalesce(*(c for c in (data_id, id_) if c is not None), counter)
