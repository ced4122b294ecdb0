"""Queries on texts: gates, normalisation, prompts, packing, parsing of tags and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import chat, parsers, prompts
from tessera.functions import text as T
from tessera.models import STOP_WORDS, identify_language
from tessera.operators.language import fit_language
from tessera.operators import gates, translate

QUOTED = T.PUNCTUATION.replace("'", "''")


def _black(c: str) -> str:
    return f"regexp_matches({c}, '(?i){T.bounded(T.BLACKLISTS['EN'])}')"


def _words(c: str) -> str:
    return rf"len(list_filter(string_split_regex({c}, '\s+'), lambda w: w <> ''))"


FIRST_LINE = "string_split(text, chr(10))[1]"
REASON = f"""CASE WHEN {_words(FIRST_LINE)} < 4 THEN 'short' WHEN {_words('text')} > 200 THEN 'long_output' WHEN {_black(FIRST_LINE)} THEN 'blacklist'
WHEN starts_with({FIRST_LINE}, 'Write a program') THEN 'write_a_program' WHEN strpos('{QUOTED}', substr({FIRST_LINE}, 1, 1)) > 0 THEN 'punctuation' WHEN unicode(substr({FIRST_LINE}, 1, 1)) > 127 THEN 'non_ascii' END"""


def _documents(spark, d):
    return table(spark, d, "documents")


def _first_line():
    return F.split("text", "\n")[0]


@query(f"SELECT doc_id, {REASON} AS reason FROM documents")
def gate_reasons(spark, d):
    return _documents(spark, d).select("doc_id", gates.reject_reason(_first_line(), F.col("text")).alias("reason"))


@query(f"SELECT doc_id FROM documents WHERE {REASON} IS NULL")
def gate_keep(spark, d):
    rows = _documents(spark, d).select("doc_id", _first_line().alias("instruction"), F.col("text").alias("output"))
    return gates.quality_gate(rows).select("doc_id")


@query("SELECT doc_id, " + _black("text") + " AS hit FROM documents")
def blacklist_hits(spark, d):
    return _documents(spark, d).select("doc_id", T.has_word(F.col("text"), T.BLACKLISTS["EN"]).alias("hit"))


@query(r"SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ':+$', '') AS squeezed FROM documents")
def squeeze_text(spark, d):
    return _documents(spark, d).select("doc_id", T.squeeze(F.col("text")).alias("squeezed"))


@query("SELECT doc_id, " + _words("text") + " AS words FROM documents")
def word_counts(spark, d):
    return _documents(spark, d).select("doc_id", T.word_count(F.col("text")).alias("words"))


@query(r"SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:50], ' ') AS truncated FROM documents")
def prompt_truncate(spark, d):
    return _documents(spark, d).select("doc_id", T.truncate_words(F.col("text"), 50).alias("truncated"))


@query(r"""WITH e AS (SELECT item_id // 4 AS batch, item_id, row_number() OVER (PARTITION BY item_id // 4 ORDER BY item_id) AS n, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ':+$', '') AS a,
CASE WHEN item_id % 2 = 0 THEN '' ELSE (text || '!') END AS i, lower(text) AS o FROM benchmark)
SELECT batch, string_agg('#####' || chr(10) || n || '. Instruction: ' || a || chr(10) || n || '. Input:' || chr(10) || CASE WHEN i = '' THEN '<noinput>' ELSE i END || chr(10) || n || '. Output:' || chr(10) || o || '##EOI##' || chr(10), '' ORDER BY n) AS prompt FROM e GROUP BY batch""")
def fewshot_prompt(spark, d):
    b = table(spark, d, "benchmark")
    rows = b.select(F.floor(F.col("item_id") / 4).alias("batch"), "item_id", F.struct(F.col("text").alias("instruction"), F.when(F.col("item_id") % 2 == 0, "").otherwise(F.concat("text", F.lit("!"))).alias("input"), F.lower("text").alias("output")).alias("x"))
    shots = rows.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "x"))), lambda s: s["x"]).alias("e"))
    return shots.select("batch", prompts.few_shot(F.col("e")).alias("prompt"))


@query("SELECT item_id, text || '<x>SEP</x>' || '' || '<x>SEP</x>' || (text || '!') AS combined, text AS instruction, '' AS input, (text || '!') AS output FROM benchmark")
def sep_roundtrip_pair(spark, d):
    task = translate.TASKS["triple"]
    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("instruction"), F.lit("").alias("input"), F.concat("text", F.lit("!")).alias("output"))
    packed = task.packed(rows).withColumn("translated", F.col("combined")).drop("instruction", "input", "output")
    return task.unpacked(packed).select("item_id", "combined", "instruction", "input", "output")


@query("SELECT item_id, text || '<x>SEP</x>' || lower(text) || '<x>SEP</x>' || (text || '!') || '<x>SEP</x>' AS combined, lower(text) AS second FROM benchmark")
def sep_roundtrip_choices(spark, d):
    task = translate.TASKS["mmlu"]
    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"), F.array(F.lower("text"), F.concat("text", F.lit("!"))).alias("choices"))
    back = task.unpacked(task.packed(rows).withColumn("translated", F.col("combined")))
    return back.select("item_id", "combined", F.col("choices")[0].alias("second"))


@query("SELECT doc_id, 'set_x_' || lower('DE') || '_' || doc_id AS data_id FROM documents")
def id_lang_rewrite(spark, d):
    own = F.concat(F.lit("set_x_en_"), F.col("doc_id").cast("string"))
    return _documents(spark, d).select("doc_id", T.rewrite_language(own, F.lit("DE")).alias("data_id"))


@query("SELECT doc_id, string_split(replace(text, ' ', '_'), '_')[1] || '<x>_</x>' || coalesce(string_split(replace(text, ' ', '_'), '_')[2], '') AS packed FROM documents")
def winogrande_blank(spark, d):
    return _documents(spark, d).select("doc_id", T.pack_blank(F.replace(F.col("text"), F.lit(" "), F.lit("_"))).alias("packed"))


@query(r"SELECT item_id, replace(regexp_replace(replace(regexp_replace('  ' || text || ' [title] next  [step]  ' || text || chr(10), '^\s+|\s+$', '', 'g'), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS cleaned FROM benchmark")
def title_clean(spark, d):
    raw = F.concat(F.lit("  "), "text", F.lit(" [title] next  [step]  "), "text", F.lit("\n"))
    return table(spark, d, "benchmark").select("item_id", T.clean_titles(raw).alias("cleaned"))


@query("SELECT page_id, replace(replace(replace(replace(html, '<', '&lt;'), '>', '&gt;'), '&lt;', '<'), '&gt;', '>') AS restored FROM pages")
def entity_restore(spark, d):
    coded = F.replace(F.replace(F.col("html"), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return table(spark, d, "pages").select("page_id", T.restore_entities(coded).alias("restored"))


@query("SELECT doc_id, CASE WHEN lower(CASE WHEN doc_id % 3 = 0 THEN '<NoInput>' ELSE text END) = '<noinput>' THEN '' ELSE text END AS decoded, CASE WHEN doc_id % 3 = 0 THEN '<noinput>' ELSE text END AS encoded FROM documents")
def noinput_code(spark, d):
    some = F.when(F.col("doc_id") % 3 == 0, "<NoInput>").otherwise(F.col("text"))
    none = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text"))
    return _documents(spark, d).select("doc_id", T.decode_no_input(some).alias("decoded"), T.encode_no_input(none).alias("encoded"))


@query("SELECT item_id, ltrim(ltrim('Q: ' || text, 'Q: '), 'A: ') AS bare, substr('Q: ' || text, 1, 3) || (text || '!') AS again FROM benchmark")
def qa_prefix_strip(spark, d):
    asked = F.concat(F.lit("Q: "), "text")
    return table(spark, d, "benchmark").select("item_id", T.strip_qa_prefix(asked).alias("bare"), F.concat(F.substring(asked, 1, 3), F.concat("text", F.lit("!"))).alias("again"))


@query(r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS trimmed FROM documents")
def stop_trim(spark, d):
    raw = F.concat(F.lit("<pad>"), "text", F.when(F.col("doc_id") % 2 == 0, T.EOS).otherwise("<|im_end|>"))
    return _documents(spark, d).select("doc_id", T.trim_stops(raw, [T.EOS, "<|im_end|>"]).alias("trimmed"))


def _tagged(spark, d):
    one = lambda tag: F.concat(F.lit('{"tag": "'), tag, F.lit('", "explanation": "x"}'))
    whole = F.concat(F.lit("["), one(F.col("lang")), F.lit(", "), one(F.col("source")), F.lit("]"))
    return _documents(spark, d).withColumn("raw", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("["), one(F.col("lang")), F.lit(", {"))).otherwise(whole))


@query("SELECT doc_id, unnest([lang, source]) AS tag FROM documents WHERE doc_id % 4 <> 0")
def tag_parse(spark, d):
    return _tagged(spark, d).select("doc_id", F.explode(T.tag_names(T.parse_tags(F.col("raw")))).alias("tag"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END::BIGINT AS n_tags FROM documents")
def tag_count(spark, d):
    return _tagged(spark, d).select("doc_id", F.size(T.parse_tags(F.col("raw"))).cast("long").alias("n_tags"))


@query("""WITH l AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE -(doc_id % 5)::DOUBLE END AS l1, -(n_chars % 7)::DOUBLE AS l2, -(doc_id % 3)::DOUBLE AS l3, -(n_chars % 4)::DOUBLE AS l4, -(doc_id % 11)::DOUBLE AS l5, -(n_chars % 13)::DOUBLE AS l6 FROM documents),
e AS (SELECT doc_id, exp(coalesce(l1, -20)) AS a, exp(l2) AS b, exp(l3) AS c, exp(l4) AS d, exp(l5) AS e, exp(l6) AS f FROM l)
SELECT doc_id, round((a + 2 * b + 3 * c + 4 * d + 5 * e + 6 * f) / (a + b + c + d + e + f), 6) AS score FROM e""")
def expected_score(spark, d):
    part = lambda c, k: (-(F.col(c) % k)).cast("double")
    logs = [F.when(F.col("doc_id") % 7 != 0, part("doc_id", 5)), part("n_chars", 7), part("doc_id", 3), part("n_chars", 4), part("doc_id", 11), part("n_chars", 13)]
    return _documents(spark, d).select("doc_id", F.round(T.expected_score(logs), 6).alias("score"))


@query("SELECT doc_id, substr(sha256(doc_id || '|' || lang || '|' || source || '|' || text), 1, 5) AS fingerprint FROM documents")
def fingerprint(spark, d):
    return _documents(spark, d).select("doc_id", T.fingerprint(F.col("doc_id").cast("string"), F.col("lang"), F.col("source"), F.col("text")).alias("fingerprint"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END AS name FROM documents")
def lang_names(spark, d):
    return _documents(spark, d).select("doc_id", T.language_name(F.col("lang")).alias("name"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def lang_filter(spark, d):
    return gates.language_filter(_documents(spark, d), ["EN", "DE"], "lang").select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars / (n_chars + 500.0::DOUBLE) >= 0.8")
def translation_gate(spark, d):
    sure = F.col("n_chars") / (F.col("n_chars") + F.lit(500.0))
    return _documents(spark, d).where(gates.translation_gate(F.col("lang"), sure, F.lit("EN"))).select("doc_id")


@query("SELECT item_id, text AS instruction, (text || '!') AS input, lower(text) AS output FROM benchmark")
def seed_flatten(spark, d):
    seeds = table(spark, d, "benchmark").select("item_id", F.col("text").alias("instruction"), F.array(F.struct(F.concat("text", F.lit("!")).alias("input"), F.lower("text").alias("output"))).alias("instances"))
    return seeds.select("item_id", "instruction", F.col("instances")[0]["input"].alias("input"), F.col("instances")[0]["output"].alias("output"))


@query("SELECT doc_id, 0 AS at, 'user' AS role, lang || chr(10) || chr(10) || source AS content FROM documents UNION ALL SELECT doc_id, 1, 'assistant', text FROM documents")
def triple_to_messages(spark, d):
    rows = _documents(spark, d).select("doc_id", F.posexplode(chat.triple_messages(F.col("lang"), F.col("text"), F.col("source"))).alias("at", "m"))
    return rows.select("doc_id", "at", "m.role", "m.content")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'unknown' END AS origin FROM documents")
def add_default_origin(spark, d):
    own = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return _documents(spark, d).select("doc_id", F.coalesce(own, F.lit("unknown")).alias("origin"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id WHEN doc_id % 3 = 1 THEN 'i' || doc_id ELSE 'math/' || doc_id END AS row_id FROM documents""")
def row_ids(spark, d):
    text = F.col("doc_id").cast("string")
    data_id, id_ = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("d"), text)), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("i"), text))
    return _documents(spark, d).select("doc_id", translate.row_id(F.col("doc_id"), data_id, id_, "math").alias("row_id"))


def _vote_sql(lang: str) -> str:
    return f"len(list_filter(w, lambda x: list_contains({STOP_WORDS[lang]}, x))) AS {lang}"


@query(f"""WITH w AS (SELECT doc_id, string_split(lower(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents), v AS (SELECT doc_id, {", ".join(map(_vote_sql, sorted(STOP_WORDS)))} FROM w)
SELECT doc_id, CASE WHEN greatest(de, en, es, fr) = 0 THEN NULL WHEN fr = greatest(de, en, es, fr) THEN 'fr' WHEN es = greatest(de, en, es, fr) THEN 'es' WHEN en = greatest(de, en, es, fr) THEN 'en' ELSE 'de' END AS guess,
round(CASE WHEN de + en + es + fr > 0 THEN greatest(de, en, es, fr) / (de + en + es + fr)::DOUBLE ELSE 0.0::DOUBLE END, 6) AS confidence FROM v""")
def language_votes(spark, d):
    told = identify_language(F.col("text"))
    return _documents(spark, d).select("doc_id", told["lang"].alias("guess"), F.round(told["confidence"], 6).alias("confidence"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(regexp_replace(text, '[^\p{L}\s]', '', 'g')), '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, w[1] AS verb, list_filter(w[2:], lambda x: length(x) > 3)[1] AS noun FROM w""")
def verb_object(spark, d):
    told = parsers.root_verb_object(F.col("text"))
    return _documents(spark, d).select("doc_id", told["verb"].alias("verb"), told["noun"].alias("noun"))


@query()
def language_bayes(spark, d):
    """Every document's language by a model of character n-grams, learned from the documents whose hash is not divisible by four."""
    docs = _documents(spark, d)
    model = fit_language(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0))
    return docs.select("doc_id", model.identify(F.col("text")).alias("x")).select("doc_id", F.col("x.lang").alias("guess"), "x.confidence")
