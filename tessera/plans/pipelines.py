"""Compound pipelines: generate, parse, gate, dedup, analyse, mix, translate, judge, render."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import chat, parsers, prompts
from tessera.functions import text as T
from tessera.models import Client, Sampling, generate
from tessera.operators import gates, judge, neighbours, ranking, stats, translate
from tessera.operators.collection import VectorCollection
from tessera.sources import io
from tessera.sources.config import Mixture
from tessera.sources.resume import ResumableOutput


def self_instruct_round(
    seeds: DataFrame, machine: DataFrame, client: Callable[[], Client], requests: int, examples: int, collection: DataFrame | VectorCollection, embed: Callable[[DataFrame], DataFrame],
    template: str = "{examples}", least: float = 0.3, language: str = "EN", seed: int = 0, first_request: int = 0,
) -> DataFrame:
    """One turn of the generation loop (P1): prompts of sampled examples, generation, parsing, gates, exact dedup, and the distance to the
    collection, a table (id, vector) or one that grows on disk. ``seeds`` and ``machine`` have (id, instruction, input, output); gives the accepted rows with request_idx,
    cosine_distance and the new rows' vector."""
    spark = seeds.sparkSession
    pool = seeds.select("id", "instruction", "input", "output").unionByName(machine.select("id", "instruction", "input", "output"))
    asks = spark.range(first_request, first_request + requests).withColumnRenamed("id", "request_idx")
    if machine.isEmpty():
        chosen = ranking.sample_each(pool, asks, "request_idx", "id", examples, seed)
    else:
        chosen = ranking.sample_each(seeds, asks, "request_idx", "id", examples // 3, seed)
        chosen = chosen.unionByName(ranking.sample_each(machine, asks, "request_idx", "id", examples // 3 * 2, seed), allowMissingColumns=True)
    shots = chosen.groupBy("request_idx").agg(F.array_sort(F.collect_list(F.struct("id", "instruction", "input", "output"))).alias("e"))
    asked = asks.join(shots, "request_idx").withColumn("prompt", prompts.fill(template, examples=prompts.few_shot(F.col("e"), language)))
    told = generate(asked.select("request_idx", "prompt"), "prompt", client, Sampling(stop_sequences=()))
    rows = parsers.self_instruct(told.drop("prompt"), "response", language)
    rows = gates.quality_gate(rows, language=language)
    rows = stats.first_by_key(rows, [F.concat_ws(" ### ", "instruction", "input")], F.struct("request_idx", "piece"))
    rows = embed(rows.withColumn("id", F.xxhash64("instruction", "input"))).withColumnRenamed("embedding", "vector")
    one = collection.nearest(rows, 1) if isinstance(collection, VectorCollection) else neighbours.nearest(rows, collection, 1)
    near = one.select(F.col("query_id").alias("id"), F.col("distance").alias("cosine_distance"))
    return rows.join(near, "id", "left").where(F.coalesce(F.col("cosine_distance") > least, F.lit(True)))


def oss_instruct(documents: DataFrame, client: Callable[[], Client], template: str = prompts.PROBLEM, key: str = "id", content: str = "content", seed: str = "", limit: int | None = None) -> DataFrame:
    """Problems and solutions from windows of documents."""
    rows = documents.withColumn("seed", ranking.line_window(F.col(content), F.col(key), seed=seed))
    rows = rows if limit is None else ranking.sample_k(rows, key, limit, seed)
    told = generate(rows.withColumn("prompt", prompts.fill(template, code=F.col("seed"))), "prompt", client)
    out = told.withColumn("parsed", parsers.problem_solution(F.col("response"))).where("parsed is not null")
    return out.select(key, "seed", "parsed.problem", "parsed.solution").where("problem <> '' and solution <> ''")


def evol_instruct(rows: DataFrame, client: Callable[[], Client], template: str = prompts.EVOLVE) -> DataFrame:
    """Rewrites instructions that have no input (P3); a failure keeps its row, empty and flagged."""
    some = rows.where("input = ''").withColumn("prompt", prompts.fill(template, instruction=F.col("instruction")))
    told = generate(some, "prompt", client).withColumn("evolved", parsers.evolved(F.col("response")))
    return told.withColumn("failed", F.col("evolved") == "").drop("prompt", "response")


def everyday_conversations(topics: DataFrame, client: Callable[[], Client], template: str = prompts.EVERYDAY, key: str = "id") -> DataFrame:
    """Small-talk dialogues by topic (P4). ``topics`` has (id, topics)."""
    rows = topics.withColumn("prompt", prompts.fill(template, topics=F.col("topics"), greeting=ranking.pick(T.GREETINGS, F.col(key))))
    told = generate(rows, "prompt", client)
    return told.select(key, parsers.dialogue(F.col("response")).alias("messages"), F.split("topics", "/").alias("topics"))


def analyse(rows: DataFrame, score: str, bins: int | None = None, low: float | None = None, high: float | None = None) -> dict[str, DataFrame]:
    """What an analysis run shows of one score (P5): its histogram, by category too if there is one, and its mean."""
    out = {"histogram": stats.histogram(rows, score, bins=bins, low=low, high=high), "mean": rows.agg(F.avg(score).alias("mean"))}
    if "category" in rows.columns:
        out["by_category"] = stats.histogram(rows, score, by=["category"], bins=200)
    return out


def diversity_report(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """Per dataset: rows, mean scores, distinct tags per row."""
    means = rows.groupBy("dataset").agg(F.count("*").alias("size"), F.avg("complexity").alias("complexity"), F.avg("quality").alias("quality"), F.avg("embedding_distance").alias("embedding_distance"))
    distinct = rows.select("dataset", F.explode(tags).alias("tag")).groupBy("dataset").agg(F.count_distinct("tag").alias("tags"))
    return means.join(distinct, "dataset", "left").withColumn("tag_diversity", F.coalesce("tags", F.lit(0)) / F.col("size"))


def build_mixture(mix: Mixture, load: Callable[[dict], DataFrame], embed: Callable[[DataFrame], DataFrame], identify: Column | None = None, share: float = 0.985, seed: str = "") -> DataFrame:
    """Scored parts to one split mixture (P7). ``load`` gives a part's rows: data_id (long), messages, origin, language and metrics.

    The first part gives its best rows within its quotas; each later one what is far enough from all accepted before, or brings a new tag (ins_tags), in
    order of preference. With quotas or tags that pass goes by windows of ranks; without them it runs in parallel rounds.
    """
    frames = [(p, load(p)) for p in mix.parts]
    scored = [f for p, f in frames if p.get("sample_scored", True)]
    metrics = ("reward", "quality", "complexity")
    norms: dict[str, float] = {}
    if scored:
        together = scored[0].select(*metrics)
        for f in scored[1:]:
            together = together.unionByName(f.select(*metrics))
        norms = stats.p95(together, list(metrics))
    kept: DataFrame | None = None
    for number, (p, rows) in enumerate(frames):
        preference = stats.overall_preference(norms) if p.get("sample_scored", True) else F.lit(1.0)
        rows = rows.withColumn("overall_preference", preference)
        if p.get("filter_key"):
            rows = rows.where(F.col(p["filter_key"]) == p["subset_name"])
        if p.get("language_filter"):
            rows = gates.language_filter(rows, p["language_filter"], identify=identify)
        size, least = p.get("sample_size"), p.get("min_distance", 0)
        quotas = {k: q * size for k, q in p["setfit_limits"].items()} if p.get("setfit_limits") and size else {}
        if number and (least > 0 or quotas):
            ranked = ranking.global_rank(rows, [F.desc_nulls_last("overall_preference"), F.asc("data_id")])
            vectors = lambda df: embed(df.withColumn("id", F.col("data_id")).withColumn("text", chat.user_text(F.col("messages")))).withColumnRenamed("embedding", "vector")
            items = vectors(ranked)
            near = neighbours.near_ids(items, vectors(kept), least) if least > 0 else rows.select(F.col("data_id").alias("id")).limit(0)
            tagged = "ins_tags" in rows.columns
            if quotas or tagged:
                items = items.join(near.withColumn("near", F.lit(True)), "id", "left").withColumn("label", F.col("setfit_label"))
                items = items.withColumn("tags", T.tag_names(F.col("ins_tags"))) if tagged else items
                seen = kept.select(F.explode(T.tag_names(F.col("ins_tags"))).alias("tag")).distinct() if tagged and "ins_tags" in kept.columns else None
                rows = neighbours.greedy_windows(items, least, size, quotas, tagged, seen).select(*rows.columns)
            else:
                rows = neighbours.greedy_select(items.join(near, "id", "left_anti"), least).select(*rows.columns)
        elif quotas:
            rows = ranking.category_quota(rows, "setfit_label", "overall_preference", "data_id", p["setfit_limits"], size)
        rows = ranking.top(rows, "overall_preference", "data_id", size) if size else rows
        kept = rows if kept is None else kept.unionByName(rows, allowMissingColumns=True)
    if kept is None:
        raise ValueError("a mixture needs parts")
    if mix.proportions:
        kept = ranking.proportion_fit(kept, "setfit_label", "overall_preference", "data_id", mix.proportions)
    return ranking.train_val(kept, "data_id", share, seed)


def translate_docs(docs: DataFrame, task: translate.Task, client: Callable[[], Client] | None, lang: str, done: DataFrame | ResumableOutput | None = None, key: str = "data_id", identify: Callable[[Column], Column] | None = None) -> DataFrame:
    """Resumable translation (P8): skips what is done, packs, translates, and keeps translations in the target language with their structure whole. No client: identity."""
    left = docs if done is None else done.remaining(docs) if isinstance(done, ResumableOutput) else gates.remaining(docs, done, key)
    packed = task.packed(left)
    told = packed.withColumn("translated", F.col("combined")) if client is None else generate(packed, "combined", client, response_col="translated")
    if identify is not None:
        guess = identify(F.regexp_replace("translated", "\n", " "))
        told = told.where(gates.translation_gate(guess["lang"], guess["confidence"], F.lit(lang)))
    return task.unpacked(told).drop("combined", "translated")


def translation_cost(docs: DataFrame, task: translate.Task) -> DataFrame:
    """Characters and euros of a dry run."""
    return task.packed(docs).agg(F.sum(F.length("combined")).cast("long").alias("chars"), T.char_cost(F.sum(F.length("combined"))).alias("eur"))


def judge_pairs(source: DataFrame, one: DataFrame, two: DataFrame, lang: str, names: tuple[str, str], client: Callable[[], Client], template: str = prompts.JUDGE) -> DataFrame:
    """Winners of two translations."""
    rows = judge.judged_rows(source, one, two, lang)
    asked = rows.withColumn("prompt", prompts.fill(template, target_language=T.language_name(F.lit(lang)), source_text=F.col("source"), translation_1=F.col("translation_1"), translation_2=F.col("translation_2")))
    told = generate(asked, "prompt", client, Sampling(max_tokens=10, temperature=0.0, stop_sequences=(T.EOS,)))
    return judge.judgements(told, *names).select("data_id", "winner", "model1", "model2").withColumn("language", F.lit(lang))


def training_text(spark: SparkSession, path: str, style: str = "chatml", share: float = 0.97, seed: str = "42") -> DataFrame:
    """Rendered training rows with their spans and split (P10)."""
    rows = io.with_ordinal(io.load_training(spark, path))
    text = chat.llama(F.col("messages"), strict=True) if style == "llama" else chat.chatml(F.col("messages"))
    out = rows.select("ordinal", text.alias("text"), chat.loss_spans(F.col("messages")).alias("spans"))
    return ranking.train_val(out, "ordinal", share, seed)


def verb_noun(rows: DataFrame, instruction: str = "instruction", parse: Callable[[Column], Column] = parsers.root_verb_object, verbs: int = 20, nouns: int = 4, least: int = 0) -> DataFrame:
    """The commonest verbs and their commonest objects."""
    pairs = rows.select(instruction).distinct().select(parse(F.col(instruction)).alias("p")).select("p.verb", "p.noun").dropna()
    counts = pairs.groupBy("verb", "noun").agg(F.count("*").alias("n")).where(F.col("n") > least)
    top = pairs.groupBy("verb").agg(F.count("*").alias("all")).orderBy(F.desc("all"), "verb").limit(verbs)
    return ranking.top_per_group(counts.join(top, "verb", "left_semi"), "verb", [F.desc("n"), F.asc("noun")], nouns)
