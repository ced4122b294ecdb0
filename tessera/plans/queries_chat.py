"""Queries on conversations: messages, pairs, roles, templates, masks, dialogue parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import chat, parsers, prompts
from tessera.functions import text as T
from tessera.operators import gates, translate


def messages(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, messages) with the turns in order."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


M = "WITH m AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS ms FROM conversations GROUP BY conv_id)"


@query("SELECT conv_id, count(*) AS n_messages, string_agg(text, chr(10) ORDER BY turn) AS flat_text FROM conversations GROUP BY conv_id")
def conv_messages(spark, d):
    return messages(spark, d).select("conv_id", F.size("messages").cast("long").alias("n_messages"), chat.flat_text(F.col("messages")).alias("flat_text"))


@query(r"SELECT conv_id, regexp_replace(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'user'), ''), '^\s+|\s+$', '', 'g') AS user_text FROM conversations GROUP BY conv_id")
def conv_user_text(spark, d):
    return messages(spark, d).select("conv_id", chat.user_text(F.col("messages")).alias("user_text"))


@query(M + " SELECT conv_id, ms[1].content AS instruction, ms[2].content AS response FROM m WHERE len(ms) > 1")
def conv_first_pair(spark, d):
    a, b = chat.first_pair(F.col("messages"))
    return messages(spark, d).where(F.size("messages") > 1).select("conv_id", a.alias("instruction"), b.alias("response"))


@query(M + " SELECT conv_id, ms[len(ms) - 1].content AS instruction, ms[len(ms)].content AS response FROM m WHERE len(ms) > 1")
def conv_last_pair(spark, d):
    a, b = chat.last_pair(F.col("messages"))
    return messages(spark, d).where(F.size("messages") > 1).select("conv_id", a.alias("instruction"), b.alias("response"))


ALTERNATES = """WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r0 FROM conversations),
k AS (SELECT conv_id, role, i - CASE WHEN r0 = 'system' THEN 1 ELSE 0 END AS j FROM n WHERE NOT (i = 0 AND role = 'system')),
v AS (SELECT conv_id, bool_and((role = 'user') = (j % 2 = 0)) AS ok FROM k GROUP BY conv_id)"""


@query(ALTERNATES + """ SELECT c.conv_id, coalesce(v.ok, true) AS alternates, coalesce(f.a = 'user' AND f.b = 'assistant', false) AS starts_right
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN v USING (conv_id)
LEFT JOIN (SELECT conv_id, max(role) FILTER (WHERE i = 0) AS a, max(role) FILTER (WHERE i = 1) AS b FROM n GROUP BY conv_id) f USING (conv_id)""")
def conv_role_validity(spark, d):
    m = F.col("messages")
    starts = (F.get(m, F.lit(0))["role"] == "user") & (F.get(m, F.lit(1))["role"] == "assistant")
    return messages(spark, d).select("conv_id", chat.alternates(m).alias("alternates"), F.coalesce(starts, F.lit(False)).alias("starts_right"))


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '</s>', '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def chatml_sft(spark, d):
    return messages(spark, d).select("conv_id", chat.chatml(F.col("messages")).alias("rendered"))


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS rendered FROM conversations GROUP BY conv_id")
def chatml_kto(spark, d):
    return messages(spark, d).select("conv_id", chat.chatml(F.col("messages"), "<|im_end|>", "\n", generation_prompt=True).alias("rendered"))


@query(ALTERNATES + r""", s AS (SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) WHERE i = 1 AND role = 'system'),
t AS (SELECT n.conv_id, n.turn, n.role, regexp_replace(CASE WHEN s.text IS NOT NULL AND n.i = 1 THEN '<<SYS>>' || chr(10) || s.text || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END || c.text, '^\s+|\s+$', '', 'g') AS said
FROM n JOIN conversations c ON c.conv_id = n.conv_id AND c.turn = n.turn LEFT JOIN s ON s.conv_id = n.conv_id WHERE NOT (n.i = 0 AND n.role = 'system')),
g AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '<s>[INST] ' || said || ' [/INST]' ELSE ' ' || said || ' </s>' END, '' ORDER BY turn) AS rendered FROM t GROUP BY conv_id)
SELECT c.conv_id, CASE WHEN coalesce(v.ok, true) THEN coalesce(g.rendered, '') END AS rendered FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN v USING (conv_id) LEFT JOIN g USING (conv_id)""")
def llama_chat(spark, d):
    return messages(spark, d).select("conv_id", chat.llama(F.col("messages")).alias("rendered"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS at, role, role = 'assistant' AS is_target, length(text) AS chars FROM conversations")
def loss_mask_spans(spark, d):
    rows = messages(spark, d).select("conv_id", F.posexplode(chat.loss_spans(F.col("messages"))).alias("at", "s"))
    return rows.select("conv_id", F.col("at").cast("long").alias("at"), "s.role", "s.is_target", F.length("s.text").cast("long").alias("chars"))


@query("SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'assistant' WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role FROM conversations")
def role_recode(spark, d):
    shared = F.when(F.col("role") == "user", "human").otherwise("gpt")
    return table(spark, d, "conversations").select("conv_id", "turn", T.recode_role(shared).alias("role"))


@query("SELECT conv_id, string_agg(text, ' <x>SEP</x> ' ORDER BY turn) AS combined, count(*) AS parts FROM conversations GROUP BY conv_id HAVING conv_id % 3 <> 0 OR count(*) = 1")
def sep_count_gate(spark, d):
    task = translate.TASKS["messages"]
    rows = task.packed(messages(spark, d)).withColumn("translated", F.when(F.col("conv_id") % 3 == 0, F.split("combined", "<x>SEP</x>", -1)[0]).otherwise(F.col("combined")))
    kept = rows.where(gates.same_structure(F.col("combined"), F.col("translated")))
    return kept.select("conv_id", "combined", T.part_count(F.col("combined")).alias("parts"))


@query("SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN '' ELSE " + r"regexp_replace(max(text) FILTER (WHERE turn = 0), '^\s+|\s+$', '', 'g')" + " END AS evolved FROM conversations GROUP BY conv_id")
def evol_extract(spark, d):
    first = table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("t"))
    marker = F.lit(T.EVOLVED)
    reply = F.when(F.col("conv_id") % 4 == 0, F.col("t")).when(F.col("conv_id") % 4 == 1, F.concat(F.lit("#Plan#"), marker, F.lit("\n"), "t")).otherwise(F.concat(marker, F.lit(" "), "t", F.lit("\n"), marker, F.lit("again")))
    return first.select("conv_id", parsers.evolved(reply).alias("evolved"))


@query(r"""WITH p AS (SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS a, max(text) FILTER (WHERE turn = 1) AS b FROM conversations GROUP BY conv_id)
SELECT conv_id, regexp_replace(a, '^\s+|\s+$', '', 'g') AS problem, regexp_replace(b, '^\s+|\s+$', '', 'g') AS solution FROM p WHERE conv_id % 3 <> 0 AND a IS NOT NULL AND b IS NOT NULL""")
def problem_solution_parse(spark, d):
    said = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(said(0).alias("a"), said(1).alias("b"))
    good = F.concat(F.lit("Sure.\n[Problem Description]\n"), "a", F.lit("\n**Solution**\n"), "b")
    bad = F.concat(F.lit("[Solution]\n"), "b", F.lit("\n[Problem Description]\n"), "a")
    told = rows.withColumn("p", parsers.problem_solution(F.when(F.col("conv_id") % 3 == 0, bad).otherwise(good)))
    return told.where("p is not null").select("conv_id", "p.problem", "p.solution")


@query(r"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS at, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content
FROM (SELECT *, bool_and(role = CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END) OVER (PARTITION BY conv_id) AS plain, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE plain AND n % 2 = 0""")
def dialog_parse(spark, d):
    m = F.col("messages")
    plain = messages(spark, d).where(chat.alternates(m) & (m[0]["role"] == "user") & (F.size(m) % 2 == 0))
    reply = F.array_join(F.transform(m, lambda x: F.concat(F.when(x["role"] == "user", "User: ").otherwise("AI: "), x["content"], F.lit("\n"))), "")
    rows = plain.select("conv_id", F.posexplode(parsers.dialogue(reply)).alias("at", "x"))
    return rows.select("conv_id", F.col("at").cast("long").alias("at"), "x.role", "x.content")


@query(r"""WITH p AS (SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS a, max(text) FILTER (WHERE turn = 1) AS b FROM conversations GROUP BY conv_id)
SELECT conv_id, 0 AS piece, regexp_replace(a, '^\s+|\s+$', '', 'g') AS instruction, '' AS input, regexp_replace(b, '^\s+|\s+$', '', 'g') AS output FROM p WHERE a IS NOT NULL AND b IS NOT NULL
UNION ALL SELECT conv_id, 1, regexp_replace(b, '^\s+|\s+$', '', 'g'), regexp_replace(a, '^\s+|\s+$', '', 'g'), 'done' FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND conv_id % 2 = 0""")
def si_parse(spark, d):
    said = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(said(0).alias("a"), said(1).alias("b"))
    end = F.when(F.col("conv_id") % 2 == 0, F.lit(T.EOI)).otherwise("")  # a truncated second block
    reply = F.concat("a", F.lit("\n1. Input:\n<noinput>\n1. Output:\n"), "b", F.lit(T.EOI + "\n#####\n2. Instruction: "), "b", F.lit("\n2. Input:\n"), "a", F.lit("\n2. Output:\ndone"), end)
    told = parsers.self_instruct(rows.select("conv_id", reply.alias("response")), "response")
    return told.select("conv_id", F.col("piece").cast("int").alias("piece"), "instruction", "input", "output")


@query(M + " SELECT conv_id, 'USER: ' || ms[1].content || chr(10) || chr(10) || 'ASSISTANT: ' || ms[2].content AS prompt FROM m WHERE len(ms) > 1")
def prompt_build(spark, d):
    a, b = chat.first_pair(F.col("messages"))
    return messages(spark, d).where(F.size("messages") > 1).select("conv_id", prompts.fill(prompts.CATEGORY, instruction=a, output=b).alias("prompt"))


@query(M + " SELECT conv_id, len(ms) AS n_messages, (ms[1].role = 'system') AS has_system FROM m")
def train_projection(spark, d):
    rows = messages(spark, d).withColumn("origin", F.lit("x")).select("conv_id", "messages")
    return rows.select("conv_id", F.size("messages").cast("long").alias("n_messages"), (F.col("messages")[0]["role"] == "system").alias("has_system"))
