"""The registered queries of this subpackage: thin digests of the operators' results, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ngram_lm
from tessera.llm._store import Kept
from tessera.llm.byte_bpe import encode_documents
from tessera.llm.chat_format import format_chat, read_turns, unescape
from tessera.llm.html_text import main_text
from tessera.llm.language_id import fit_language, identify_language
from tessera.llm.lattice_dedup import lattice_links
from tessera.llm.packing import pack
from tessera.llm.polytope_search import search
from tessera.llm.prefix_trie import numbered_turns, prefix_trie, respliced
from tessera.llm.quality import fit_quality, score_quality
from tessera.llm.shingle_join import shingle_links
from tessera.llm.substring_dedup import dedup_substrings
from tessera.llm.token_alignment import align_tokens


LM_ORDER = 3


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_of(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def fifth(id_col: str = "doc_id") -> Column:
    return crc_of(id_col) % 5


def op1_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_links(_read(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), output="crc32").withColumnRenamed("ids", "ids_crc32")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, output="digest")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(fifth() != 0))
    told = score_quality(docs.select("doc_id", "text"), model)
    return told.select("doc_id", (fifth() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_links(_read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = dedup_substrings(_read(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = main_text(_read(spark, sf_dir, "pages"))
    return told.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = ngram_lm.fit(docs.where(fifth() != 1), order=LM_ORDER)
    scores = Kept(spark).put(ngram_lm.score(docs, model), "scores", whole=True)
    ngram_lm.delete_model(spark, model)
    return scores.select("doc_id", (fifth() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    chats = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    told = format_chat(chats).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss.alias("loss"))
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_polytope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return search(vectors, F.col("vec_id") % 20 == 0)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return align_tokens(_read(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), public.PATTERN, digest=True)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = crc_of() % 3 == 1
    model = fit_language(docs.where(~held_out))
    return identify_language(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Kept(spark)
    turns = kept.put(numbered_turns(_read(spark, sf_dir, "conversations"), kept=kept), "turns-numbered")
    rebuilt, convs = respliced(turns)
    return prefix_trie(kept.put(rebuilt, "turns-rebuilt"), convs, kept)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_dedup": op1_lattice_dedup,
    "op2_packing": op2_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality": op4_quality,
    "op5_shingle_join": op5_shingle_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_html_text": op7_html_text,
    "op8_ngram_lm": op8_ngram_lm,
    "op9_chat_format": op9_chat_format,
    "op10_polytope_search": op10_polytope_search,
    "op11_token_alignment": op11_token_alignment,
    "op12_language_id": op12_language_id,
    "op13_prefix_trie": op13_prefix_trie,
}

def _components(links: str, nodes: str) -> str:
    """SQL: the smallest node that each node reaches over the symmetric ``links`` (a, b)."""
    return f"r AS (WITH RECURSIVE t(a, b) AS (SELECT id, id FROM {nodes} UNION SELECT t.a, l.b FROM t JOIN {links} l ON l.a = t.b) SELECT a AS id, min(b) AS component_id FROM t GROUP BY a)"


_ESCAPED = r"regexp_replace(regexp_replace(replace({0}, '\', '\\'), '([<\[])([|/sI<])', '\1\\\2', 'g'), '([<\[])([|/sI<])', '\1\\\2', 'g')"

#: crc32 of an id's digits, a byte and then a bit at a time.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda p, i: xor(p >> 1, 3988292384 * (p & 1)))))"""

ORACLE_SQL: dict[str, str] = {
    "op1_lattice_dedup": """WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.label = q.label AND p.id <> q.id WHERE list_cosine_similarity(p.e, q.e) >= 0.98),
"""
    + _components("l", "v")
    + """, n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT v.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.component_id, v.id = r.component_id AS kept FROM v LEFT JOIN n USING (id) JOIN r USING (id)""",
    "op5_shingle_join": r"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT id, g FROM (SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
s AS (SELECT id, count(*) AS n FROM g GROUP BY id), c AS (SELECT p.id AS a, q.id AS b, count(*) AS k FROM g p JOIN g q ON p.g = q.g AND p.id < q.id GROUP BY 1, 2),
h AS (SELECT a, b FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE k / (x.n + y.n - k)::DOUBLE >= 0.8), l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
"""
    + _components("l", "w")
    + """, n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT w.id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_links, r.component_id, w.id = r.component_id AS kept FROM w LEFT JOIN n USING (id) JOIN r USING (id)""",
    "op6_substring_dedup": r"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT id, unnest(range(1, len(w) - 48)) AS s FROM w WHERE len(w) >= 50), g AS (SELECT s.id, s.s, array_to_string(w.w[s.s : s.s + 49], ' ') AS g FROM s JOIN w USING (id)),
m AS (SELECT id, s, min(id) OVER (PARTITION BY g) AS first FROM g), x AS (SELECT DISTINCT id, unnest(range(s, s + 50)) AS i FROM m WHERE first < id),
p AS (SELECT id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w), k AS (SELECT p.id, p.i, p.word, x.i IS NULL AS kept FROM p LEFT JOIN x ON x.id = p.id AND x.i = p.i),
t AS (SELECT id, count(*) FILTER (WHERE NOT kept) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE kept) AS text FROM k GROUP BY id)
SELECT w.id AS doc_id, len(w.w)::BIGINT AS n_words, coalesce(t.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t.text, '')) AS kept_sha256 FROM w LEFT JOIN t USING (id)""",
    "op9_chat_format": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT *, length({_ESCAPED.format("text")}) AS t, length({_ESCAPED.format("role")}) AS r FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
length(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), ''))::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
sum(t + CASE WHEN opens THEN r + length('<|im_start|><|im_body|><|im_end|>') + 1 ELSE length('<|im_sep|>') END)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
    "op13_prefix_trie": f"""WITH t AS (
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, count(*) AS n, {_CRC32.format("conv_id")} % 6 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h UNION ALL
SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), role, text FROM c JOIN t USING (conv_id) LEFT JOIN c b ON b.conv_id = c.base WHERE t.pos > c.h),
k AS (SELECT conv_id, list(sha256(length(role) || ' ' || role || text) ORDER BY pos) AS k, list(length(text) ORDER BY pos) AS s FROM r GROUP BY conv_id),
q AS (SELECT c.conv_id, coalesce(k, []) AS k, coalesce(s, []) AS s FROM c LEFT JOIN k USING (conv_id)),
p AS (SELECT conv_id, d, array_to_string(k[1:d], ' ') AS path, array_to_string(k[1:d - 1], ' ') AS up, d = len(k) AS ends, CASE WHEN d > 0 THEN s[d] ELSE 0 END AS size
FROM (SELECT *, unnest(range(0, len(k) + 1)) AS d FROM q)),
n AS (SELECT d, path, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size,
sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends FROM p GROUP BY d, path),
m AS (SELECT n.*, coalesce(x.children, 0) AS children FROM n LEFT JOIN (SELECT d - 1 AS d, up AS path, count(*) AS children FROM n WHERE d > 0 GROUP BY 1, 2) x USING (d, path)),
a AS (SELECT conv_id, d, n_convs, size, children, unnest(range(0, d + 1)) AS j FROM m),
z AS (SELECT a.j AS d, p.path, count(*) FILTER (WHERE a.children = 0) AS leaves, sum((a.n_convs - 1) * a.size) AS saved FROM a JOIN p ON p.conv_id = a.conv_id AND p.d = a.j GROUP BY 1, 2)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.children AS n_children, z.leaves AS n_leaves, z.saved::BIGINT AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN z USING (d, path) LEFT JOIN n u ON m.d > 0 AND u.d = m.d - 1 AND u.path = m.up""",
}
