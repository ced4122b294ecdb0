"""Queries on rows: joins, dedup, samples, splits, selections, set operations, judgements, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import text as T
from tessera.functions import vector as V
from tessera.operators import collection, gates, judge, neighbours, ranking, stats, translate
from tessera.operators.embedder import fit_and_embed
from tessera.sources import io
from tessera.tables import Tables


def _docs(spark, d):
    return table(spark, d, "documents")


def _labels(spark, d):
    return table(spark, d, "labels")


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text, source")
def exact_dedup(spark, d):
    return stats.first_by_key(_docs(spark, d).select("doc_id", "text", "source"), [F.col("text"), F.col("source")], F.col("doc_id")).select("doc_id", "text")


@query("SELECT count(DISTINCT text) AS n FROM documents")
def distinct_texts(spark, d):
    return _docs(spark, d).select("text").distinct().agg(F.count("*").alias("n"))


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, d):
    return gates.remaining(_docs(spark, d), _labels(spark, d), "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def id_intersection(spark, d):
    return judge.shared_ids(_docs(spark, d), _labels(spark, d), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def id_semijoin(spark, d):
    return gates.among(_docs(spark, d), _labels(spark, d).where("quality = 1"), "doc_id").select("doc_id", "lang")


@query("""SELECT 'set_x_de_' || d.doc_id AS data_id, d.text AS source, lower(d.text) AS translation_1, upper(d.lang) AS translation_2
FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en'""")
def judged_rows(spark, d):
    rows = _docs(spark, d)
    name = lambda lang: F.concat(F.lit(f"set_x_{lang}_"), F.col("doc_id").cast("string")).alias("data_id")
    source = rows.select(name("en"), "text")
    one = rows.where("lang = 'en'").select(name("de"), F.lower("text").alias("text"))
    two = gates.among(rows, _labels(spark, d), "doc_id").select(name("de"), F.upper("lang").alias("text"))
    return judge.judged_rows(source, one, two, "de")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE -1 END AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def metric_attach(spark, d):
    side = _labels(spark, d).select(F.col("doc_id").alias("ordinal"), F.col("quality").alias("value"))
    rows = _docs(spark, d).select(F.col("doc_id").alias("ordinal"), F.lit(-1).alias("quality"))
    return io.attach(rows, side, "quality").select(F.col("ordinal").alias("doc_id"), "quality")


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def metric_left_join(spark, d):
    return _docs(spark, d).join(_labels(spark, d), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, doc_id AS x FROM documents), b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, doc_id AS y FROM labels)
SELECT ordinal, x, y FROM a JOIN b USING (ordinal)""")
def positional_join(spark, d):
    a = ranking.ordinal(_docs(spark, d).select(F.col("doc_id").alias("x")), "x")
    b = ranking.ordinal(_labels(spark, d).select(F.col("doc_id").alias("y")), "y")
    return a.join(b, "ordinal").select("ordinal", "x", "y")


PAIRS = """WITH p AS (SELECT doc_id, doc_id // 2 AS pair, 's_x_en_' || doc_id AS data_id, lang, text FROM documents)"""


def _preference(spark, d):
    own = F.concat(F.lit("s_x_en_"), F.col("doc_id").cast("string"))
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), F.col(c).alias("content")))
    return _docs(spark, d).select(F.col("doc_id").alias("ordinal"), own.alias("data_id"), one("user", "lang").alias("prompt"), one("assistant", "text").alias("completion"))


@query(PAIRS + " SELECT min_by(data_id, doc_id) AS data_id, min_by(lang, doc_id) AS prompt, count(*) AS completions, string_agg(text, '|' ORDER BY doc_id) AS texts FROM p GROUP BY pair")
def kto_pack(spark, d):
    rows = translate.pack_pairs(_preference(spark, d))
    return rows.select("data_id", F.col("prompt")[0]["content"].alias("prompt"), F.size("completion").cast("long").alias("completions"), F.array_join(F.transform("completion", lambda c: c[0]["content"]), "|").alias("texts"))


@query(PAIRS + " SELECT CASE WHEN doc_id = first THEN data_id ELSE 's_x_en_' || (first + 1) END AS data_id, doc_id = first AS label, text FROM (SELECT *, min(doc_id) OVER (PARTITION BY pair) AS first FROM p)")
def kto_unpack(spark, d):
    rows = translate.unpack_pairs(translate.pack_pairs(_preference(spark, d)))
    return rows.select("data_id", "label", F.col("completion")[0]["content"].alias("text"))


# Samples and splits, all in the order of md5(id || seed).


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || 's'), doc_id) AS rank FROM documents")
def md5_shuffle_rank(spark, d):
    return ranking.shuffled(_docs(spark, d), "doc_id", "s").select("doc_id", "rank")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || 'k'), doc_id LIMIT 100")
def md5_sample_k(spark, d):
    return ranking.sample_k(_docs(spark, d).select("doc_id"), "doc_id", 100, "k")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || 'f'), doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= floor(0.1::DOUBLE * n)")
def md5_sample_frac(spark, d):
    return ranking.sample_share(_docs(spark, d).select("doc_id"), "doc_id", 0.1, "f")


@query("SELECT * FROM (SELECT item_id AS id, 'seed' AS kind FROM benchmark ORDER BY md5(item_id || 'b'), item_id LIMIT 3) UNION ALL SELECT * FROM (SELECT doc_id AS id, 'machine' AS kind FROM documents ORDER BY md5(doc_id || 'b'), doc_id LIMIT 6)")
def bootstrap_mix(spark, d):
    seeds = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("seed").alias("kind"))
    return ranking.bootstrap(seeds, _docs(spark, d).select(F.col("doc_id").alias("id"), F.lit("machine").alias("kind")), "id", 10, "b")


@query("SELECT doc_id, ['Hi!', 'Hello', 'Heya', 'Good morning'][1 + ('0x' || substr(md5(doc_id || 'g'), 1, 8))::BIGINT % 4] AS greeting FROM documents")
def greeting_pick(spark, d):
    return _docs(spark, d).select("doc_id", ranking.pick(T.GREETINGS, F.col("doc_id"), "g").alias("greeting"))


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || 't'), doc_id) AS r, count(*) OVER (PARTITION BY source) AS g, count(*) OVER () AS n FROM documents) WHERE r <= 200 * g // n""")
def strat_sample(spark, d):
    return ranking.stratified(_docs(spark, d).select("doc_id", "source"), "source", "doc_id", 200, "t")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || '42'), doc_id) <= floor(0.985::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'val' END AS split FROM documents")
def train_val_split(spark, d):
    return ranking.train_val(_docs(spark, d).select("doc_id"), "doc_id", 0.985, 42)


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS raw FROM documents), q AS (SELECT doc_id, list_filter(list_transform(raw, lambda x, i: CASE WHEN i < len(raw) THEN x || chr(10) ELSE x END), lambda x: x <> '') AS l FROM p),
r AS (SELECT doc_id, l, ('0x' || substr(md5(doc_id || 'wa'), 1, 8))::BIGINT % greatest(len(l), 1) AS s, 1 + ('0x' || substr(md5(doc_id || 'wb'), 1, 8))::BIGINT % 15 AS k FROM q)
SELECT doc_id, array_to_string(l[s + 1 : s + k], '') AS seed FROM r""")
def code_seed_window(spark, d):
    return _docs(spark, d).select("doc_id", ranking.line_window(F.col("text"), F.col("doc_id"), seed="w").alias("seed"))


# Selection by preference.

PREFERENCE = """WITH s AS (SELECT d.doc_id, d.lang, d.n_chars::DOUBLE AS reward, coalesce(l.quality, 0)::DOUBLE AS quality, (d.doc_id % 17)::DOUBLE AS complexity FROM documents d LEFT JOIN labels l USING (doc_id)),
n AS (SELECT quantile_cont(reward, 0.95) AS r, quantile_cont(quality, 0.95) AS q, quantile_cont(complexity, 0.95) AS c FROM s),
p AS (SELECT doc_id, lang, 0.4::DOUBLE * reward / r + 0.4::DOUBLE * quality / q + 0.2::DOUBLE * complexity / c AS preference FROM s, n)"""


def _preferred(spark, d):
    rows = _docs(spark, d).select("doc_id", "lang", "n_chars").join(_labels(spark, d).select("doc_id", "quality"), "doc_id", "left")
    rows = rows.select("doc_id", "lang", F.col("n_chars").cast("double").alias("reward"), F.coalesce("quality", F.lit(0)).cast("double").alias("quality"), (F.col("doc_id") % 17).cast("double").alias("complexity"))
    norms = stats.p95(rows, ["reward", "quality", "complexity"])
    return rows.select("doc_id", "lang", stats.overall_preference(norms).alias("preference"))


@query(PREFERENCE + " SELECT doc_id, round(preference, 6) AS preference FROM p")
def overall_preference(spark, d):
    return _preferred(spark, d).select("doc_id", F.round("preference", 6).alias("preference"))


@query(PREFERENCE + " SELECT doc_id FROM p ORDER BY preference DESC, doc_id LIMIT 50")
def top_by_preference(spark, d):
    return ranking.top(_preferred(spark, d), "preference", "doc_id", 50).select("doc_id")


@query(PREFERENCE + " SELECT doc_id, row_number() OVER (ORDER BY round(preference, 3) DESC, doc_id) AS place FROM p")
def preference_order(spark, d):
    rows = _preferred(spark, d).withColumn("preference", F.round("preference", 3))
    return ranking.global_rank(rows, [F.desc_nulls_last("preference"), F.asc("doc_id")], "place").select("doc_id", "place")


@query(PREFERENCE + " SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY preference DESC, doc_id) AS r FROM p) WHERE r <= CASE lang WHEN 'en' THEN 31 WHEN 'de' THEN 20 WHEN 'fr' THEN 10 ELSE 1000000000 END")
def category_quota(spark, d):
    return ranking.category_quota(_preferred(spark, d), "lang", "preference", "doc_id", {"en": 0.305, "de": 0.2, "fr": 0.1}, 100).select("doc_id", "lang")


@query(PREFERENCE + """, c AS (SELECT sum((lang = 'en')::INT) AS e, sum((lang = 'de')::INT) AS g, sum((lang = 'fr')::INT) AS f, count(*) AS n FROM p),
z AS (SELECT 0.5::DOUBLE AS pe, 0.25::DOUBLE AS pg, (f / n::DOUBLE) / (f / n::DOUBLE) * (1 - 0.75::DOUBLE) AS pf, e, g, f FROM c), m AS (SELECT *, floor(least(e / pe, g / pg, f / pf)) AS m FROM z)
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY preference DESC, doc_id) AS r FROM p), m WHERE r <= CASE lang WHEN 'en' THEN floor(m * pe) WHEN 'de' THEN floor(m * pg) WHEN 'fr' THEN floor(m * pf) ELSE 0 END""")
def proportion_fit(spark, d):
    return ranking.proportion_fit(_preferred(spark, d), "lang", "preference", "doc_id", {"en": 0.5, "de": 0.25, "fr": -1.0, "es": 0.0}).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id >= 10 AND doc_id < 60")
def index_slice(spark, d):
    return io.index_slice(_docs(spark, d), 10, 60, "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def first_n(spark, d):
    return io.first_n(_docs(spark, d), 25, "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE source = 'src3'")
def subset_filter(spark, d):
    return _docs(spark, d).where(F.col("source") == "src3").select("doc_id")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND text <> ''")
def drop_empty(spark, d):
    return _docs(spark, d).where("text <> ''").select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE source LIKE 'src1%'")
def glob_filter(spark, d):
    return gates.glob_filter(_docs(spark, d), "source", "src1*").select("doc_id", "source")


@query("SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark")
def union_all(spark, d):
    a = _docs(spark, d).select(F.col("doc_id").alias("id"), "text", "lang")
    return a.unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), allowMissingColumns=True)


@query("SELECT DISTINCT source FROM documents WHERE lang = 'en' EXCEPT SELECT source FROM documents WHERE lang = 'es'")
def tag_difference(spark, d):
    by = lambda lang: _docs(spark, d).where(F.col("lang") == lang).select("source")
    return by("en").distinct().exceptAll(by("es").distinct())


@query("SELECT n.n_name AS nation, r.r_name AS region, s.split FROM nation n CROSS JOIN region r CROSS JOIN (SELECT 'train' AS split UNION ALL SELECT 'val') s")
def param_grid(spark, d):
    names = lambda t, c: sorted(r[0] for r in table(spark, d, t).select(c).collect())  # noqa: E731  parameter values: 25 nations, 5 regions
    return translate.parameter_grid(spark, nation=names("nation", "n_name"), region=names("region", "r_name"), split=["train", "val"])


@query("SELECT (row_number() OVER (ORDER BY k, i) - 1)::VARCHAR AS id, document FROM (SELECT 0 AS k, item_id AS i, text AS document FROM benchmark UNION ALL SELECT 1, doc_id, text FROM documents)")
def collection_append(spark, d):
    base = collection.numbered(table(spark, d, "benchmark").select(F.col("item_id").alias("o"), F.col("text").alias("document")), "o").select("id", "document")
    return collection.append(base, _docs(spark, d).select(F.col("doc_id").alias("o"), F.col("text").alias("document")), "o")


@query("SELECT doc_id // 16 AS batch, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def request_batches(spark, d):
    return _docs(spark, d).groupBy(collection.batch_of(F.col("doc_id"), 16).alias("batch")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


# Judgements.

VERDICTS = """WITH j AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS model1, CASE WHEN doc_id % 2 = 0 THEN 'beta' ELSE 'alpha' END AS model2,
CASE WHEN quality = 1 THEN 'Translation (a)' WHEN toxic = 1 THEN 'neither' ELSE 'Translation (b)' END AS said FROM labels)"""


def _verdicts(spark, d):
    even = F.col("doc_id") % 2 == 0
    said = F.when(F.col("quality") == 1, "Translation (a)").when(F.col("toxic") == 1, "neither").otherwise("Translation (b)")
    return _labels(spark, d).select("doc_id", F.when(even, "alpha").otherwise("beta").alias("model1"), F.when(even, "beta").otherwise("alpha").alias("model2"), said.alias("said"))


@query(VERDICTS + " SELECT doc_id, CASE said WHEN 'Translation (a)' THEN model1 WHEN 'Translation (b)' THEN model2 ELSE said END AS winner FROM j")
def winner_map(spark, d):
    raw = F.concat(F.lit(" "), "said", F.lit(f" {T.EOS} because"))
    return _verdicts(spark, d).select("doc_id", T.verdict(raw, F.col("model1"), F.col("model2")).alias("winner"))


@query(VERDICTS + " SELECT doc_id, 'alpha vs beta' AS pair FROM j")
def pair_key(spark, d):
    return _verdicts(spark, d).select("doc_id", T.pair_key(F.col("model1"), F.col("model2")).alias("pair"))


@query(VERDICTS + """, w AS (SELECT 'alpha vs beta' AS pair, CASE said WHEN 'Translation (a)' THEN model1 WHEN 'Translation (b)' THEN model2 ELSE said END AS winner FROM j)
SELECT pair, winner, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY pair), 6) AS share FROM w GROUP BY pair, winner""")
def winrate(spark, d):
    cut = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("said", r"\)$", "")).otherwise(F.col("said"))
    return judge.win_rates(_verdicts(spark, d).withColumn("winner", cut)).select("pair", "winner", "n", F.round("share", 6).alias("share"))


# Vectors.

UNIT = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query(UNIT + " SELECT a.vec_id, b.vec_id AS other, round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    a, b = _vectors(spark, d), _vectors(spark, d)
    b = b.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("vector").alias("w"))
    return a.join(b, "id").select(F.col("id").alias("vec_id"), "other", F.round(V.cosine_distance(F.col("vector"), F.col("w")), 6).alias("distance"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE + 2 * embedding[2]::DOUBLE - embedding[3]::DOUBLE, 6) AS first, round(0.5::DOUBLE * embedding[2]::DOUBLE, 6) AS second FROM embeddings")
def reward_mix(spark, d):
    gate = F.slice("vector", 1, 3)
    told = V.matrix_times([[1.0, 2.0, -1.0], [0.0, 0.5, 0.0]], gate)
    return _vectors(spark, d).select(F.col("id").alias("vec_id"), F.round(told[0], 6).alias("first"), F.round(told[1], 6).alias("second"))


KNN_ALL = UNIT + ", n AS (SELECT a.vec_id AS query_id, b.vec_id AS id, 1 - list_cosine_similarity(a.e, b.e) AS dist FROM v a, v b WHERE a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM n)"


def _knn_all(spark, d, k):
    rows = _vectors(spark, d)
    return neighbours.nearest(rows, rows, k, skip_same_id=True)


@query(KNN_ALL + " SELECT query_id, round(dist, 6) AS distance FROM r WHERE rank = 1")
def nn1_distance_all(spark, d):
    return _knn_all(spark, d, 1).select("query_id", F.round("distance", 6).alias("distance"))


@query(KNN_ALL + " SELECT query_id, rank::INT AS rank, round(1 - dist, 6) AS similarity FROM r WHERE rank <= 3")
def nn_topk_all(spark, d):
    return _knn_all(spark, d, 3).select("query_id", F.col("rank").cast("int").alias("rank"), F.round(1 - F.col("distance"), 6).alias("similarity"))


@query(KNN_ALL + " SELECT query_id FROM r WHERE rank = 1 AND dist > 0.5")
def distance_gate_all(spark, d):
    return _knn_all(spark, d, 1).where(F.col("distance") > 0.5).select("query_id")


@query(KNN_ALL.replace("a.vec_id <> b.vec_id", "true") + " SELECT query_id, rank::INT AS rank, round(1 - dist, 6) AS similarity FROM r WHERE rank <= 3")
def collection_search(spark, d):
    """Searches a collection that grew by three appends."""
    known = collection.VectorCollection(spark, f"{Tables(spark).folder}/vectors", most=500)
    rows = _vectors(spark, d).withColumn("document", F.col("id").cast("string"))
    for part in ("id < 100", "id >= 100 and id < 300", "id >= 300"):
        known.append(rows.where(part), "id")
    found = known.nearest(rows.select("id", "vector"), 3)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.round(1 - F.col("distance"), 6).alias("similarity"))


@query(UNIT + """, n AS (SELECT a.vec_id AS q, b.vec_id AS i, a.label = b.label AS same, 1 - list_cosine_similarity(a.e, b.e) AS dist FROM v a, v b),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, i) AS k FROM n) SELECT q AS id, round(CASE WHEN bool_or(k = 1 AND same) THEN max(dist) FILTER (WHERE k = 2) ELSE max(dist) FILTER (WHERE k = 1) END, 6) AS distance FROM r WHERE k <= 2 GROUP BY q""")
def self_nn2(spark, d):
    rows = _vectors(spark, d).withColumn("text", F.col("label").cast("string"))
    return neighbours.self_distance(rows).select("id", F.round("distance", 6).alias("distance"))


@query(UNIT + """, r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k, e FROM v),
n AS (SELECT a.k, coalesce(list(b.k) FILTER (WHERE b.k < a.k AND 1 - list_cosine_similarity(a.e, b.e) <= 0.6), []::BIGINT[]) AS near FROM r a, r b GROUP BY a.k),
g AS (WITH RECURSIVE t(k, acc) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT t.k + 1, CASE WHEN len(list_intersect(t.acc, n.near)) = 0 THEN list_append(t.acc, n.k) ELSE t.acc END FROM t JOIN n ON n.k = t.k + 1) SELECT acc FROM t ORDER BY k DESC LIMIT 1)
SELECT r.vec_id AS id FROM r, g WHERE list_contains(g.acc, r.k)""")
def greedy_select(spark, d):
    rows = _vectors(spark, d).withColumn("rank", F.col("id"))
    return neighbours.greedy_select(rows, 0.6).select("id")


@query(UNIT + """, r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k, e, coalesce(label, -1)::VARCHAR AS label, [vec_id % 97, 1000 + vec_id % 5] AS tags FROM v),
n AS (SELECT a.k, any_value(a.label) AS label, any_value(a.tags) AS tags, coalesce(list(b.k) FILTER (WHERE b.k < a.k AND 1 - list_cosine_similarity(a.e, b.e) <= 0.7), []::BIGINT[]) AS near
FROM r a, r b GROUP BY a.k),
g AS (WITH RECURSIVE t(k, acc, seen, q1, q2, q3) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], 3, 10, 0 UNION ALL SELECT k,
CASE WHEN ok THEN list_append(acc, k) ELSE acc END, CASE WHEN ok THEN list_distinct(list_concat(seen, tags)) ELSE seen END,
CASE WHEN ok AND label = '1' THEN q1 - 1 ELSE q1 END, CASE WHEN ok AND label = '2' THEN q2 - 1 ELSE q2 END, CASE WHEN ok AND label = '3' THEN q3 - 1 ELSE q3 END
FROM (SELECT t.acc, t.seen, t.q1, t.q2, t.q3, n.*, len(t.acc) < 150 AND NOT (label = '1' AND q1 <= 0) AND NOT (label = '2' AND q2 <= 0) AND NOT (label = '3' AND q3 <= 0)
AND (len(list_intersect(t.acc, n.near)) = 0 OR len(list_intersect(seen, tags)) < 2) AS ok FROM t JOIN n ON n.k = t.k + 1)) SELECT acc FROM t ORDER BY k DESC LIMIT 1)
SELECT r.vec_id AS id FROM r, g WHERE list_contains(g.acc, r.k)""")
def greedy_quota_tags(spark, d):
    """Selection by distance or new tags within quotas, at most 150 rows."""
    label = F.coalesce("label", F.lit(-1)).cast("string")
    tags = F.array((F.col("id") % 97).cast("string"), (1000 + F.col("id") % 5).cast("string"))
    rows = _vectors(spark, d).withColumns({"rank": F.col("id"), "label": label, "tags": tags})
    return neighbours.greedy_windows(rows, 0.7, 150, {"1": 3, "2": 10, "3": 0}, True).select("id")


@query()
def text_neighbours(spark, d):
    """The nearest other document of each by a text embedder trained on all of them."""
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    known = fit_and_embed(docs, "id", "text")[1]
    return neighbours.nearest(known, known, 1, skip_same_id=True).select(F.col("query_id").alias("doc_id"), F.col("id").alias("other"), F.round("distance", 4).alias("distance"))
