"""Queries on statistics: compositions, histograms, correlations, tags, counters, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import text as T
from tessera.operators import gates, moments, ranking, stats
from tessera.operators.diversity import DiversityStore
from tessera.tables import Tables

WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))"


def _docs(spark, d):
    return table(spark, d, "documents")


@query("SELECT lang, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM documents GROUP BY lang")
def composition_pct(spark, d):
    return stats.composition(_docs(spark, d), "lang").select("lang", "n", F.round("pct", 6).alias("pct"))


@query("""WITH s AS (SELECT count(*) AS n, min(n_chars)::DOUBLE AS a, max(n_chars)::DOUBLE AS b, quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25) AS iqr FROM documents),
w AS (SELECT *, CASE WHEN iqr > 0 THEN least(2 * iqr * pow(n, -1.0::DOUBLE / 3), (b - a) / (log2(n) + 1)) ELSE (b - a) / (log2(n) + 1) END AS width FROM s),
k AS (SELECT *, ceil((b - a) / width) AS k FROM w)
SELECT least(floor((n_chars - a) * k / (b - a)), k - 1)::BIGINT AS bin, count(*) AS n FROM documents, k GROUP BY 1""")
def hist_auto(spark, d):
    return stats.histogram(_docs(spark, d), "n_chars")


@query("SELECT lang, least(floor((n_chars - 0.0) * 200 / 20000.0::DOUBLE), 199)::BIGINT AS bin, count(*) AS n FROM documents WHERE n_chars BETWEEN 0 AND 20000 GROUP BY 1, 2")
def hist_by_category(spark, d):
    return stats.histogram(_docs(spark, d), "n_chars", by=["lang"], low=0, high=20000, bins=200)


@query("SELECT round(quantile_cont(n_chars, 0.95), 6) AS n_chars, round(quantile_cont(doc_id % 17, 0.95), 6) AS mod FROM documents")
def p95_norm(spark, d):
    told = stats.p95(_docs(spark, d).withColumn("mod", F.col("doc_id") % 17), ["n_chars", "mod"])
    return spark.createDataFrame([(told["n_chars"], told["mod"])], "n_chars double, mod double").select(F.round("n_chars", 6).alias("n_chars"), F.round("mod", 6).alias("mod"))


TAGS = r"(SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS tags FROM documents)"


def _tags(spark, d):
    return _docs(spark, d).select("doc_id", T.words(F.lower("text")).alias("tags"))


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM {TAGS}) GROUP BY tag")
def tag_freq(spark, d):
    return stats.tag_counts(_tags(spark, d), "tags")


@query(f"WITH t AS (SELECT unnest(tags) AS tag FROM {TAGS}), c AS (SELECT count(DISTINCT tag) AS d, count(*) AS t FROM t), n AS (SELECT count(*) AS n FROM documents) SELECT round(d / n, 6) AS unique_per_row, round(n * d / (100.0::DOUBLE * t), 6) AS inverse_frequency FROM c, n")
def tag_diversity(spark, d):
    told = stats.tag_diversity(_tags(spark, d), "tags")
    return told.select(F.round("unique_per_row", 6).alias("unique_per_row"), F.round("inverse_frequency", 6).alias("inverse_frequency"))


@query("SELECT DISTINCT source AS tag FROM documents")
def tag_set(spark, d):
    return stats.tag_counts(_docs(spark, d).select(F.array("source").alias("tags")), "tags").select("tag")


SCORES = "(SELECT d.doc_id, d.n_chars AS x, l.quality + d.doc_id % 7 AS y FROM documents d JOIN labels l USING (doc_id))"


def _scores(spark, d):
    rows = _docs(spark, d).join(table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", F.col("n_chars").alias("x"), (F.col("quality") + F.col("doc_id") % 7).alias("y"))


@query(f"SELECT round(corr(x, y), 6) AS r FROM {SCORES}")
def pearson(spark, d):
    return stats.pearson(_scores(spark, d), "x", "y").select(F.round("r", 6).alias("r"))


@query(f"""WITH r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS b FROM {SCORES})
SELECT round(corr(a, b), 6) AS r FROM r""")
def spearman(spark, d):
    return stats.spearman(_scores(spark, d), "x", "y").select(F.round("r", 6).alias("r"))


@query(f"SELECT round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM {SCORES}")
def ols(spark, d):
    return stats.ols(_scores(spark, d), "x", "y").select(F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("SELECT source, count(*) AS size, round(avg(n_chars), 6) AS chars, round(avg(quality), 6) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def dataset_summary(spark, d):
    rows = _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("size"), F.round(F.avg("n_chars"), 6).alias("chars"), F.round(F.avg("quality"), 6).alias("quality"))


@query("SELECT round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, count(*) AS n FROM labels")
def mean_scores(spark, d):
    return table(spark, d, "labels").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def group_counts(spark, d):
    return _docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT lang || '/' || source AS topic, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def topic_groups(spark, d):
    return _docs(spark, d).groupBy(F.concat("lang", F.lit("/"), "source").alias("topic")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(f"SELECT count(*) AS generated, count(*) FILTER (WHERE {WORDS} BETWEEN 4 AND 200) AS kept, count(*) FILTER (WHERE NOT {WORDS} BETWEEN 4 AND 200) AS dropped FROM documents")
def run_counters(spark, d):
    reason = gates.reject_reason(F.lit("a plain good instruction"), F.col("text"))
    short = F.when(T.word_count(F.col("text")) < 4, "short").otherwise(reason)
    return stats.run_counters(_docs(spark, d).withColumn("reason", short), "reason")


PAIR = r"(SELECT list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')[1] AS verb, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')[2] AS noun FROM documents)"


def _pairs(spark, d):
    first = lambda k: F.lower(F.regexp_extract("text", r"^\s*(\S+)\s+(\S+)", k))  # noqa: E731  reads no further than two words
    return _docs(spark, d).select(first(1).alias("verb"), first(2).alias("noun")).where("verb <> '' and noun <> ''")


@query(f"""WITH p AS (SELECT * FROM {PAIR} WHERE verb IS NOT NULL AND noun IS NOT NULL), t AS (SELECT verb FROM p GROUP BY verb ORDER BY count(*) DESC, verb LIMIT 20),
c AS (SELECT verb, noun, count(*) AS n FROM p WHERE verb IN (SELECT verb FROM t) GROUP BY verb, noun) SELECT verb, noun, n FROM (SELECT *, row_number() OVER (PARTITION BY verb ORDER BY n DESC, noun) AS r FROM c) WHERE r <= 4""")
def topk_per_group(spark, d):
    p = _pairs(spark, d)
    top = p.groupBy("verb").agg(F.count("*").alias("all")).orderBy(F.desc("all"), "verb").limit(20)
    counts = p.join(top, "verb", "left_semi").groupBy("verb", "noun").agg(F.count("*").alias("n"))
    return ranking.top_per_group(counts, "verb", [F.desc("n"), F.asc("noun")], 4)


@query(f"SELECT verb, count(*) AS n FROM {PAIR} WHERE verb IS NOT NULL AND noun IS NOT NULL GROUP BY verb HAVING count(*) > 3")
def top_groups(spark, d):
    return _pairs(spark, d).groupBy("verb").agg(F.count("*").alias("n")).where(F.col("n") > 3)


@query("SELECT sum(length(text))::BIGINT AS chars, round(sum(length(text)) / 50000.0::DOUBLE, 6) AS eur FROM documents")
def char_cost(spark, d):
    chars = F.sum(F.length("text"))
    return _docs(spark, d).agg(chars.cast("long").alias("chars"), F.round(T.char_cost(chars), 6).alias("eur"))


METRICS = ["n_chars", "quality", "toxic", "mod"]
_PAIRS = [(x, y) for x in METRICS for y in METRICS if x != y]


@query("WITH m AS (SELECT d.n_chars::DOUBLE AS n_chars, l.quality::DOUBLE AS quality, l.toxic::DOUBLE AS toxic, (d.doc_id % 17)::DOUBLE AS mod FROM documents d LEFT JOIN labels l USING (doc_id)) "
       + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, regr_count({y}, {x})::BIGINT AS n, round(corr({x}, {y}), 6) AS r, round(regr_slope({y}, {x}), 6) AS slope, round(regr_intercept({y}, {x}), 5) AS intercept FROM m" for x, y in _PAIRS))
def metric_matrix(spark, d):
    """Correlation and regression of every pair of metrics, in one scan."""
    rows = _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left").withColumn("mod", F.col("doc_id") % 17)
    told = moments.matrix(rows, METRICS)
    return told.select("x", "y", "n", F.round("r", 6).alias("r"), F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query(f"WITH t AS (SELECT unnest(tags) AS tag FROM {TAGS}) SELECT tag, count(*) AS n FROM t GROUP BY tag HAVING count(*) >= 0.002::DOUBLE * (SELECT count(*) FROM t)")
def frequent_tags(spark, d):
    """Tags of a share of all occurrences, from statistics kept for each of the four languages and merged."""
    rows = _docs(spark, d).select("lang", T.words(F.lower("text")).alias("tags"))
    store = DiversityStore(spark, f"{Tables(spark).folder}/diversity")
    for lang in ("de", "en", "es", "fr"):
        store.add(lang, rows.where(F.col("lang") == lang))
    store.add("other", rows.where("lang is null or lang not in ('de', 'en', 'es', 'fr')"))
    return store.frequent(0.002)
