"""Expressions: gates, templates, parsers, packing, scores, on small frames with the odd cases."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import chat, parsers, prompts
from tessera.functions import text as T
from tessera.functions import vector as V
from tessera.models import identify_language
from tessera.operators import gates, translate

MESSAGE = "array<struct<role:string,content:string>>"


def one(spark, schema, value, *columns):
    df = spark.createDataFrame([(value,)], f"x {schema}")
    return tuple(df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def many(spark, values, column, schema="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {schema}")
    return [r[1] for r in sorted(df.select("i", column.alias("v")).collect())]


def talk(*turns):
    return [{"role": r, "content": c} for r, c in turns]


def test_gate_reasons(spark):
    cases = [
        ("Draw a nice picture now", "ok", "blacklist"), ("Ein schönes mapé für dich", "ok", None), ("one two three", "ok", "short"), (None, "ok", "short"), ("", None, "short"), ("a good long instruction", "w " * 201, "long_output"),
        ("Write a program that sorts", "ok", "write_a_program"), ("(odd) start of a text", "ok", "punctuation"), ("Élan vital is a term", "ok", "non_ascii"), ("Please GO TO the next room", "ok", "blacklist"), ("the photographs are very good", "ok", None), ("fine words to pass here", None, None),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r[0]: r[1] for r in df.select("i", gates.reject_reason(F.col("a"), F.col("b"))).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}
    raw = spark.createDataFrame([("x ##EOI##",), ("cut",)], "r string").select(gates.reject_reason(F.lit("a good long one"), F.lit("ok"), raw=F.col("r")))
    assert [r[0] for r in raw.collect()] == [None, "truncated"]
    assert many(spark, ["A képek szép", "KÉPEK itt", "képeken"], T.has_word(F.col("x"), T.BLACKLISTS["HU"])) == [True, True, False]


def test_words_and_trims(spark):
    texts = [" a  b\n\tc : ", "", None, "x::", "\n"]
    assert many(spark, texts, T.squeeze(F.col("x"))) == ["a b c ", "", None, "x", ""]
    assert many(spark, texts, T.word_count(F.col("x"))) == [4, 0, None, 1, 0] or many(spark, texts, T.word_count(F.col("x")))[:2] == [4, 0]
    assert many(spark, ["a b c", "a"], T.truncate_words(F.col("x"), 2)) == ["a b", "a"]
    assert many(spark, ["a b c"], T.truncate_words(F.col("x"), 0)) == ["a b c"]  # a budget that the prompt uses up does not cut
    assert many(spark, ["3 a b c", "1 a", "0 a b", "x a"], T.truncate_words(F.col("x"), F.split("x", " ")[0].try_cast("int"))) == ["3 a b", "1", "0 a b", "x a"]
    assert many(spark, ["ok</s>", "<pad>ok\n", "a##EOS##b", "x.*"], T.trim_stops(F.col("x"), ["</s>", "##EOS##", ".*"])) == ["ok", "ok", "a##EOS##b", "x"]
    assert many(spark, ["Q: Queen", "A: Art", "plain"], T.strip_qa_prefix(F.col("x"))) == ["ueen", "rt", "plain"]
    assert many(spark, [" a [title] b [x] c  d "], T.clean_titles(F.col("x"))) == ["a. b c d"]
    assert many(spark, ["a_b", "none"], T.pack_blank(F.col("x"))) == ["a<x>_</x>b", "none<x>_</x>"]
    assert many(spark, ["a\\nb"], T.unescape_newlines(F.col("x"))) == ["a\nb"]


def test_ids_and_names(spark):
    assert many(spark, ["a_b_en_7", "a_b_en", "p_q_EN_r_12"], T.rewrite_language(F.col("x"), F.lit("DE"))) == ["a_b_de_7", "a_b_de", "p_q_de_r_12"]
    assert many(spark, ["a_b_en_9"], T.next_number(F.col("x"))) == ["a_b_en_10"]
    assert many(spark, ["de", "PT-PT", "xx", None], T.language_name(F.col("x"))) == ["German", "Portuguese", None, None]
    assert many(spark, ["b", "a"], T.pair_key(F.col("x"), F.lit("ab"))) == ["ab vs b", "a vs ab"]
    a, b = F.lit("m1"), F.lit("m2")
    assert many(spark, [" Translation (a) ##EOS## x", "Translation (b)", "both"], T.verdict(F.col("x"), a, b)) == ["m1", "m2", "both"]
    assert many(spark, ["Translation (a", "Translation (b)", None, "m1"], T.repair_winner(F.col("x"), a, b)) == ["m1", "m2", None, "m1"]


def test_tags_and_scores(spark):
    raw = ['[{"tag": "a", "explanation": "x"}, {"tag": "b"}]', '[{"tag": "a"}, {', "nonsense]", None, "[]", '[{"other": 1}]']
    assert many(spark, raw, T.tag_names(T.parse_tags(F.col("x")))) == [["a", "b"], ["a"], [], [], [], []]  # an unfinished list gives what is whole
    df = spark.createDataFrame([(0.0, 0.0), (None, 5.0), (None, None), (float("nan"), 0.0)], "a double, b double")
    got = [r[0] for r in df.select(T.expected_score([F.col("a"), F.col("b")])).collect()]
    assert got[0] == 1.5 and got[1] == pytest.approx(2, abs=1e-6) and got[2] == 1.5 and got[3] == 3.0
    assert one(spark, "array<float>", [3.0, 4.0], V.norm(F.col("x")), V.cosine_distance(F.col("x"), F.col("x")), V.matrix_times([[1, 0], [0, 2]], F.col("x"))) == (5.0, 0.0, [3.0, 8.0])


def test_chat_templates(spark):
    m = talk(("user", "Hi "), ("assistant", "Yo"))
    x = F.col("x")
    assert one(spark, MESSAGE, m, chat.chatml(x), chat.chatml(x, "<|im_end|>", "\n", True), chat.llama(x)) == (
        "<|im_start|>user\nHi </s><|im_start|>assistant\nYo</s>",
        "<|im_start|>user\nHi <|im_end|>\n<|im_start|>assistant\nYo<|im_end|>\n<|im_start|>assistant\n",
        "<s>[INST] Hi [/INST] Yo </s>",
    )
    system = talk(("system", "Be kind"), ("user", "Hi"), ("assistant", "Yo"), ("user", "And?"))
    assert one(spark, MESSAGE, system, chat.llama(x)) == ("<s>[INST] <<SYS>>\nBe kind\n<</SYS>>\n\nHi [/INST] Yo </s><s>[INST] And? [/INST]",)
    wrong = talk(("user", "a"), ("user", "b"))
    assert one(spark, MESSAGE, wrong, chat.llama(x), chat.alternates(x)) == (None, False)
    with pytest.raises(Exception, match="alternate"):
        one(spark, MESSAGE, wrong, chat.llama(x, strict=True))
    assert one(spark, MESSAGE, [], chat.chatml(x), chat.llama(x), chat.first_pair(x)[0], chat.last_pair(x)[1], chat.user_text(x)) == ("", "", None, None, "")
    assert one(spark, MESSAGE, system, chat.user_text(x), chat.flat_text(x), chat.last_pair(x)[0], F.transform(chat.loss_spans(x), lambda s: s["is_target"])) == ("Hi And?", "Be kind\nHi\nYo\nAnd?", "Yo", [False, False, True, False])


def test_few_shot_and_fill(spark):
    df = spark.createDataFrame([([{"instruction": "Do  it:", "input": "", "output": "o"}, {"instruction": "Two", "input": "i", "output": "p"}],)], "e array<struct<instruction:string,input:string,output:string>>")
    text = df.select(prompts.few_shot(F.col("e"), "DE")).first()[0]
    assert text == "#####\n1. Anweisung: Do it\n1. Eingabe:\n<noinput>\n1. Ausgabe:\no##EOI##\n#####\n2. Anweisung: Two\n2. Eingabe:\ni\n2. Ausgabe:\np##EOI##\n"
    assert one(spark, "string", "A", prompts.fill("{a} {json} {b}{a}", a=F.col("x"), b=F.lit("B"))) == ("A {json} BA",)


def slow_si(response):
    label = r"(?:\d+\.)?\s+(?:Instruction|Input|Output):"
    out = []
    for at, piece in enumerate(("1. Instruction: " + response).split("#####")):
        if "##EOI##" not in piece:
            continue
        parts = re.split(label, piece.strip())
        if len(parts) == 4:
            a, b, c = (p.strip() for p in parts[1:])
            out.append((at, a, "" if b.lower() == "<noinput>" else b, c.replace("##EOI##", "")))
    return out


def test_self_instruct_parser(spark):
    rng = random.Random(0)
    bits = ["#####", "\n", " 1. Instruction:", "\n2. Input:", "\n3. Output:", " Output:", "##EOI##", "word ", "<noinput>", "Input:", "7. ", "é", "  "]
    good = " do this\n1. Input:\n<NOINPUT>\n1. Output:\nok##EOI##\n#####\n5. Instruction: b\n2. Input: i\n2. Output: o##EOI##"
    responses = [good, ""] + ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(300)] + [good.replace("word", rng.choice(bits)) + rng.choice(bits) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(responses)), "i int, r string")
    got = sorted(tuple(r) for r in parsers.self_instruct(df, "r").collect())
    assert got == sorted((i, *x) for i, r in enumerate(responses) for x in slow_si(r))
    assert len(got) >= 4


def slow_problem(text):
    lines = text.splitlines(keepends=True) if "\r" not in text else None
    low = [x.lower() for x in lines]
    a = next((i for i, x in enumerate(low) if "[problem description]" in x or "**problem description**" in x), None)
    b = next((i for i, x in enumerate(low) if "[solution]" in x or "**solution**" in x), None)
    if a is None or b is None or a >= b:
        return None
    return "".join(lines[a + 1 : b]).strip(), "".join(lines[b + 1 :]).strip()


def test_problem_solution(spark):
    rng = random.Random(1)
    bits = ["[Problem Description]", "**SOLUTION**", "[solution]", "\n", "text", " ", "**problem description** x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(300)]
    got = many(spark, texts, parsers.problem_solution(F.col("x")))
    assert [None if g is None else tuple(g) for g in got] == [slow_problem(t) for t in texts]


def slow_dialogue(text):
    out, waits = [], ""
    for segment in text.split("User:"):
        if "AI:" in segment:
            parts = segment.split("AI:")
            answer = parts[1].strip() + (parts[2].strip() if len(parts) > 2 else "")
            out += [(waits + parts[0].strip(), "user"), (answer, "assistant")]
            waits = ""
        else:
            waits = segment.strip()
    return out


def test_dialogue_and_evolved(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["User:", "AI:", " hi", "\n", "you "]) for _ in range(rng.randrange(15))) for _ in range(300)]
    got = many(spark, texts, parsers.dialogue(F.col("x")))
    assert [[tuple(m) for m in g] for g in got] == [slow_dialogue(t) for t in texts]
    m = T.EVOLVED
    assert many(spark, [f"a{m} b {m}c", f"{m} d\n", "none", m], parsers.evolved(F.col("x"))) == ["b", "d", "", ""]


def test_translation_tasks_round_trip(spark):
    say = lambda r, c: {"role": r, "content": c}
    docs = {
        "arc": ("question string, choices struct<text:array<string>,label:array<string>>", ("q", (["a", "b"], ["A", "B"]))),
        "hellaswag": ("activity_label string, ctx_a string, ctx_b string, ctx string, endings array<string>, source_id string", ("l", "a", "b", "a b", ["x", "y"], "s~1")),
        "mmlu": ("question string, choices array<string>", ("q", ["1", "2", ""])),
        "gsm8k": ("question string, answer string", ("q", "a")),
        "truthfulqa_mc": ("question string, mc1_targets struct<choices:array<string>,labels:array<int>>, mc2_targets struct<choices:array<string>,labels:array<int>>", ("q", (["a"], [1]), (["b", "c"], [1, 0]))),
        "truthfulqa_gen": ("question string, best_answer string, correct_answers array<string>, incorrect_answers array<string>, type string, category string", ("q", "b", ["c1", "c2"], ["i1"], "t", "c")),
        "triple": ("instruction string, input string, output string", ("i", "", "o")),
        "winogrande": ("sentence string", ("a _ b",)),
        "seed": ("instruction string, instances array<struct<input:string,output:string>>", ("i", [("a", "b")])),
        "messages": (f"messages {MESSAGE}", ([say("system", "s"), say("user", "u")],)),
        "preference": (f"prompt {MESSAGE}, completion array<{MESSAGE}>", ([say("system", "s"), say("user", "u")], [[say("assistant", "good")], [say("assistant", "bad")]])),
    }
    assert set(docs) == set(translate.TASKS)
    for name, (schema, row) in docs.items():
        task = translate.TASKS[name]
        df = spark.createDataFrame([row], schema)
        packed = task.packed(df)
        same = task.unpacked(packed.withColumn("translated", F.col("combined"))).select(*df.columns)
        assert same.first() == df.first(), name
        assert task.unpacked(packed.withColumn("translated", F.concat("combined", F.lit(T.SEP)))).count() == 0
        assert (task.strategy == "topics") == (task.topic is not None)
    gsm = translate.TASKS["gsm8k"].unpacked(spark.createDataFrame([("q", "a", "q<x>SEP</x>1 &lt; 2")], "question string, answer string, translated string").withColumn("combined", F.lit("q<x>SEP</x>a")))
    assert gsm.first().answer == "1 < 2"


def test_language_votes(spark):
    got = many(spark, ["the cat and the dog of it", "der Hund und die Katze", "zzz", None], identify_language(F.col("x"))["lang"])
    assert got[:3] == ["en", "de", None]


def test_structure_and_globs(spark):
    assert gates.glob_names(["mmlu_a", "arc", "mmlu_b"], ["mmlu*"]) == ["mmlu_a", "mmlu_b"]
    assert gates.glob_names(["arc"], ["data/x.jsonl"]) == ["instruction"]
    df = spark.createDataFrame([("src1",), ("src12",), ("xsrc1",), (None,)], "s string")
    assert sorted(r.s for r in gates.glob_filter(df, "s", "src1?*").collect()) == ["src12"]
    assert math.isclose(one(spark, "bigint", 100_000, T.char_cost(F.col("x")))[0], 2.0)


def test_unfinished_tag_lists(spark):
    raw = ['[{"tag": "a"}, {"tag": "b"}, {"ta', '[{"tag": "a", "explanation": "x"}, {"tag"', '[{"tag": "a"}', '[x, {"tag": "a"}, {', "", '[{"tag": "a"}]']
    assert many(spark, raw, T.tag_names(T.parse_tags(F.col("x")))) == [["a", "b"], [], [], [], [], ["a"]]
