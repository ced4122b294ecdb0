"""Readers and writers in a temporary folder, the dataset catalogue, configurations, models, pipelines and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.models import Analyzers, Echo, Sampling, generate, generate_chat, hashed_embedding, replay, translate_text
from tessera.operators import translate
from tessera.plans import pipelines
from tessera.sources import adapters, io
from tessera.sources.config import load_mixture
from tessera.streaming import incremental


def put(path, *lines):
    path.write_text("".join(x + "\n" for x in lines), encoding="utf-8")
    return str(path)


def jsonl(path, *rows):
    return put(path, *(json.dumps(r, ensure_ascii=False) for r in rows))


def test_sidecars(spark, tmp_path):
    rows = io.with_ordinal(spark.createDataFrame([(f"t{k}", 9.0) for k in range(50)], "t string, score double").repartition(6))
    side = io.read_scalar_sidecar(spark, put(tmp_path / "s.csv", "1.5", "None", "x", "2"))
    assert sorted((r.ordinal, r.value) for r in side.collect() if r.value is not None) == [(0, 1.5), (3, 2.0)]
    got = {r.ordinal: r.score for r in io.attach(rows, side, "score").collect()}
    assert len(got) == 50 and got[0] == 1.5 and got[1] is None and got[3] == 2.0 and got[4] == 9.0
    io.write_scalar_sidecar(io.attach(rows, side, "score"), str(tmp_path / "out"), "score")
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ["1.5", "None", "None", "2.0"] + ["9.0"] * 46
    tags = io.read_tag_sidecar(spark, put(tmp_path / "t.jsonl", '[{"tag":"a"}]', "[]"))
    assert [[t.tag for t in r.tags] for r in sorted(tags.collect())] == [["a"], []]
    io.write_tag_sidecar(tags, str(tmp_path / "tags"))
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "tags").glob("part-*")) == 2


def test_files(spark, tmp_path):
    triple = "instruction string, input string, output string"
    path = jsonl(tmp_path / "a.jsonl", {"instruction": "i", "input": "", "output": "o"}, {"instruction": "é"})
    assert [tuple(r) for r in io.read_jsonl(spark, path, triple).collect()] == [("i", "", "o"), ("é", None, None)]
    array = put(tmp_path / "b.json", json.dumps([{"instruction": "x"}, {"instruction": "y"}]))
    assert io.read_json_array(spark, array, triple).count() == 2
    assert io.read_text(spark, put(tmp_path / "p.txt", "a", "b")) == "a\nb\n"
    assert [r.value for r in io.read_prompts(spark, put(tmp_path / "q.txt", r"a\nb", "c")).collect()] == ["a\nb", "c"]
    for name in ("m_1", "m_2", "n_1"):
        put(tmp_path / f"{name}.csv", "winner,judge", f"{name},j")
    got = io.read_csvs(spark, str(tmp_path), "m_*.csv")
    assert sorted(r.winner for r in got.collect()) == ["m_1", "m_2"] and {r.file for r in got.collect()} == {"m_1.csv", "m_2.csv"}
    io.write_csv(got, str(tmp_path / "csv"))
    assert io.read_csvs(spark, str(tmp_path / "csv")).count() == 2
    df = spark.createDataFrame([("a", "train", "de"), ("b", "test", "de")], "x string, split string, lang string")
    df.write.partitionBy("lang", "split").json(str(tmp_path / "built"))
    assert [r.x for r in io.read_language_split(spark, str(tmp_path / "built"), "de", "test", "x string").collect()] == ["b"]
    io.write_splits(df.drop("lang"), str(tmp_path / "splits"))
    assert spark.read.json(str(tmp_path / "splits")).count() == 2


def test_resume(spark, tmp_path):
    out = str(tmp_path / "out")
    assert io.done_keys(spark, out, "request_idx", "long").count() == 0 and io.next_index(spark, out) == 0
    io.write_jsonl(spark.createDataFrame([(0, "a"), (4, "b")], "request_idx long, t string"), out)
    io.write_jsonl(spark.createDataFrame([(5, "c")], "request_idx long, t string"), out)
    assert io.next_index(spark, out) == 6 and io.done_keys(spark, out, "request_idx", "long").count() == 3


def test_training_files(spark, tmp_path):
    m = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    path = jsonl(tmp_path / "t.jsonl", {"messages": m, "other": 1})
    assert io.load_training(spark, path).columns == ["messages"]
    kto = jsonl(tmp_path / "k.jsonl", {"prompt": m[:1], "completion": m[1:], "label": True})
    assert io.load_training(spark, kto, "kto").columns == ["prompt", "completion", "label"]
    with pytest.raises(ValueError, match="no column"):
        io.load_training(spark, kto)
    with pytest.raises(ValueError, match="expected"):
        io.load_training(spark, str(tmp_path / "t.txt"))
    rows = pipelines.training_text(spark, path, "llama").collect()
    assert rows[0].text == "<s>[INST] q [/INST] a </s>" and [s.is_target for s in rows[0].spans] == [False, True]


def test_annotations(spark):
    rows = spark.createDataFrame([(0, ""), (1, "x")], "ordinal long, input string")
    answers = spark.createDataFrame([(0, "yes", "good"), (1, "no", "bad")], "ordinal long, input_relevance string, output_correctness string")
    assert sorted((r.ordinal, r.input_relevance) for r in io.annotate(rows, answers).collect()) == [(0, "n/a"), (1, "no")]


def test_adapters(spark, tmp_path):
    turn = lambda f, v: {"from": f, "value": v}
    say = lambda r, c: {"role": r, "content": c}
    share = [
        {"id": "a_1", "language": "EN", "composition": "chat", "conversations": [turn("human", "q"), turn("gpt", "r")]}, {"id": "a_2", "language": "EN", "composition": "chat", "conversations": [turn("gpt", "r"), turn("human", "q")]},
        {"id": "a_3", "language": "DE", "composition": "chat", "conversations": [turn("human", "solo")]},
    ]
    talk = [{"messages": [say("system", "s"), say("user", "u"), say("assistant", "a")]}, {"messages": [say("user", "only")]}]
    data = {
        "A": ([{"instruction": "i", "input": "", "output": "o"}], [("i\n\n", "o")]),
        "B": ([{"instruction": "i", "input": "", "output": "o"}, {"instruction": "i", "input": "x", "output": "o"}, {"instruction": "j", "output": "o"}], [("i", "o"), ("i\n\nx", "o"), ("j", "o")]),
        "D": ([{"instruction": "i", "output": "o"}], [("i", "o")]),
        "E": ([{"input": "i", "output": "o"}], [("i", "o")]),
        "F": (talk, [("s", "u")]),
        "F0": (talk, [("s", "u"), ("only", None)]),
        "G": (talk, [("u", "a")]),
        "H": (share, [("q", "r"), ("r", "q")]),
        "H0": ([{"conversations": ["q", "r"]}, {"conversations": ["q"]}], [("q", "r"), ("q", None)]),
        "I": ([{"prompt": {"text": "q", "lang": "en", "replies": [{"text": "r"}, {"text": "s"}]}}, {"prompt": {"text": "q", "lang": "de", "replies": [{"text": "r"}]}}, {"prompt": {"text": "q", "lang": "en", "replies": []}}], [("q", "r")]),
        "J": (share, [("q", "r")]),
    }
    assert set(data) == set(adapters.SHAPES)
    known = adapters.Catalogue()
    for name, (rows, want) in data.items():
        known.register(adapters.Dataset(name, f"Title {name}", jsonl(tmp_path / f"{name}.jsonl", *rows), name))
        title, df = known.load(spark, name)
        got = [(r.instruction, r.response) for r in df.orderBy("ordinal").collect()]
        assert title == f"Title {name}" and got == want and {r.dataset for r in df.collect()} == {name}
    with pytest.raises(ValueError, match="unknown dataset"):
        known.load(spark, "nope")
    known.register(adapters.Dataset("some", "Some", str(tmp_path / "B.jsonl"), "B", where="input = 'x'", limit=5))
    assert known.load(spark, "some")[1].count() == 1
    raw = io.with_ordinal(spark.read.schema(adapters.SHARED).json(str(tmp_path / "J.jsonl")))
    (r,) = adapters.resave_shared(raw, "en").collect()
    assert (r.data_id, r.origin, r.language, [tuple(m) for m in r.messages]) == ("teg_v1_en_0", "teg_a", "en", [("user", "q"), ("assistant", "r")])


def test_mixture_config():
    mix = load_mixture({"blend": {"data": [{"name": "a", "sample_size": 3, "subsets": [{"subset_name": "x"}, {"subset_name": "y", "sample_size": 9}]}, {"name": "b", "setfit_limit": {"c": 1}}], "final_setfit_proportions": {"c": 1.0}}})
    assert mix.name == "blend" and [(p["name"], p.get("sample_size")) for p in mix.parts] == [("a", 3), ("a", 9), ("b", None)]
    assert mix.parts[2]["setfit_limits"] == {"c": 1} and mix.proportions == {"c": 1.0}
    with pytest.raises(ValueError):
        load_mixture({"a": {}, "b": {}})


def test_generators(spark):
    class Flaky:
        """Fails every other time."""

        name = "flaky"
        calls = 0

        def __call__(self, prompts, sampling):
            self.calls += 1
            if self.calls % 2:
                raise OSError("busy")
            return [p[:3] for p in prompts]

    df = spark.createDataFrame([(i, f"prompt {i}") for i in range(40)], "id long, prompt string")
    assert {r.response for r in generate(df, "prompt", lambda: Echo(reply=str.upper), batch=7).collect()} == {f"PROMPT {i}" for i in range(40)}
    assert generate(df, "prompt", Flaky, Sampling(max_tokens=3)).where("response = 'pro'").count() == 40
    table = spark.createDataFrame([("prompt 3", "three")], "prompt string, response string")
    assert replay(df, "prompt", table).where("response = 'three'").collect()[0].id == 3
    a = Analyzers()
    a.register("tokens", lambda d: d.withColumn("tokens", T.word_count(F.col("prompt"))))
    assert a.run(df, ["tokens"]).first().tokens == 2
    with pytest.raises(ValueError):
        a.register("nope", lambda d: d)


REPLY = " Explain how {0} works in detail\n1. Input:\n<noinput>\n1. Output:\nIt works.##EOI##\n#####\n2. Instruction: Draw a picture of it please\n2. Input:\nx\n2. Output:\ny##EOI##"


def test_self_instruct_round(spark):
    rows = "id long, instruction string, input string, output string"
    seeds = spark.createDataFrame([(i, f"Seed number {i} here", "", "o") for i in range(6)], rows)
    machine = spark.createDataFrame([(100 + i, f"Machine text {i} here", "x", "o") for i in range(6)], rows)
    embed = lambda df: hashed_embedding(df, "instruction")
    old = embed(seeds).select("id", F.col("embedding").alias("vector"))
    out = pipelines.self_instruct_round(seeds, machine, lambda: Echo(reply=lambda p: REPLY.format(len(p))), 3, 6, old, embed, template="Tasks:\n{examples}", least=0.1).collect()
    assert out and all(r.instruction.startswith("Explain how") and r.cosine_distance > 0.1 for r in out)
    same = pipelines.self_instruct_round(seeds, machine.limit(0), lambda: Echo(reply=lambda p: " Seed number 1 here\n1. Input:\n<noinput>\n1. Output:\no##EOI##"), 2, 3, old, embed).collect()
    assert same == []


def test_generation_pipelines(spark):
    docs = spark.createDataFrame([(1, "def f():\n  return 1\n"), (2, "x = 1")], "id long, content string")
    out = pipelines.oss_instruct(docs, lambda: Echo(reply=lambda p: f"[Problem Description]\nfix {p}\n[Solution]\ndone" if "def" in p or "return" in p else "no"), "Code: {code}").collect()
    assert [r.id for r in out] == [1] and out[0].solution == "done"
    rows = spark.createDataFrame([("do", ""), ("skip", "has input"), ("bad", "")], "instruction string, input string")
    got = {r.instruction: (r.evolved, r.failed) for r in pipelines.evol_instruct(rows, lambda: Echo(reply=lambda p: "" if "bad" in p else f"{T.EVOLVED} more {p}"), "{instruction}").collect()}
    assert got == {"do": ("more do", False), "bad": ("", True)}
    topics = spark.createDataFrame([(1, "a/b")], "id long, topics string")
    (r,) = pipelines.everyday_conversations(topics, lambda: Echo(reply=lambda p: "User: hi AI: hello " + p), "{topics} {greeting}").collect()
    assert r.topics == ["a", "b"] and r.messages[0].content == "hi" and r.messages[1].role == "assistant"


def test_own_templates_ask_for_what_parsers_read(spark):
    """A client that follows the default prompts to the letter is understood."""
    docs = spark.createDataFrame([(1, "def f():\n  return 1\n")], "id long, content string")
    said = lambda p: p.replace("[Problem Description]\nand", "[Problem Description]\nSum it.\nand").replace("after the line\n[Solution]\n", "after the line\n[Solution]\nsum(x)")
    (r,) = pipelines.oss_instruct(docs, lambda: Echo(reply=said)).collect()
    assert r.problem.startswith("Sum it.") and r.solution == "sum(x)"
    rows = spark.createDataFrame([("count {x}", "")], "instruction string, input string")
    (r,) = pipelines.evol_instruct(rows, lambda: Echo(reply=lambda p: f"Plan\n{T.EVOLVED}\n" + p.split("Task:\n")[1].strip() + " twice")).collect()
    assert r.evolved == "count {x} twice" and not r.failed
    (r,) = pipelines.everyday_conversations(spark.createDataFrame([(1, "tea/rain")], "id long, topics string"), lambda: Echo(reply=lambda p: p.strip().splitlines()[-1] + "\nAI: Hello")).collect()
    assert r.messages[0].content in T.GREETINGS and r.messages[1].content == "Hello"
    df = spark.createDataFrame([("Hallo {du}",)], "text string")
    told = translate_text(df, "text", "de", "fr", lambda: Echo(reply=lambda p: p.split("Text:\n")[1].split("\n\n")[0].upper() + "##EOT## more")).first()
    assert told.translated == "HALLO {DU}"
    text = "data_id string, text string"
    sides = [spark.createDataFrame([(f"a_b_{lang}_1", t)], text) for lang, t in (("en", "Good"), ("de", "Gut"), ("de", "Schlecht"))]
    won = pipelines.judge_pairs(*sides, "de", ("m", "n"), lambda: Echo(reply=lambda p: ("Translation (a)" if "Translation (a):\nGut" in p else "Translation (b)") + T.EOS)).collect()
    assert [r.winner for r in won] == ["m"]


def test_mixture(spark):
    msg = "array<struct<role:string,content:string>>"
    shape = f"data_id long, messages {msg}, origin string, language string, setfit_label string, reward double, quality double, complexity double"

    def part(first, n, texts):
        rows = [(first + i, [("user", texts[i % len(texts)]), ("assistant", "a")], f"o{first}", "en" if i % 4 else "de", "xy"[i % 2], float(i), 1.0, 2.0) for i in range(n)]
        return spark.createDataFrame(rows, shape)

    parts = {"a": part(0, 20, [f"alpha number {k} text" for k in range(20)]), "b": part(100, 20, ["alpha number 19 text", "wholly different words", "zebra crossing ahead"])}
    mix = load_mixture({"m": {"data": [{"name": "a", "sample_size": 8, "language_filter": ["en"]}, {"name": "b", "sample_size": 5, "min_distance": 0.3}], "final_setfit_proportions": {"x": 0.5, "y": 0.5}}})
    out = pipelines.build_mixture(mix, lambda p: parts[p["name"]], lambda df: hashed_embedding(df, "text"), share=0.8).collect()
    labels = [r.setfit_label for r in out]
    assert labels.count("x") == labels.count("y") > 0
    assert {r.origin for r in out} == {"o0", "o100"} and {r.language for r in out if r.origin == "o0"} == {"en"}
    assert sum(r.split == "train" for r in out) == int(0.8 * len(out))
    assert len({r.messages[0].content for r in out if r.origin == "o100"}) == sum(r.origin == "o100" for r in out)
    plain = pipelines.build_mixture(load_mixture({"m": {"data": [{"name": "a", "sample_scored": False, "filter_key": "setfit_label", "subset_name": "x", "setfit_limits": {"x": 0.5}, "sample_size": 4}]}}), lambda p: parts["a"], lambda df: df)
    assert plain.count() == 2
    limited = load_mixture({"m": {"data": [{"name": "a", "sample_size": 4}, {"name": "b", "sample_size": 10, "min_distance": 0.3, "setfit_limits": {"x": 0.1}}]}})
    parts["b"] = part(100, 20, ["river stone", "green apple", "fast trains", "old music", "warm bread", "night sky", "paper boat", "quiet room"])
    tagged = {k: f.withColumn("ins_tags", F.array(F.struct(F.lit("t" if k == "a" else "u").alias("tag"), F.lit("").alias("explanation")))) for k, f in parts.items()}
    rows = [r for r in pipelines.build_mixture(limited, lambda p: tagged[p["name"]], lambda df: hashed_embedding(df, "text")).collect() if r.origin == "o100"]
    assert sum(r.setfit_label == "x" for r in rows) == 1 and len(rows) >= 2


def test_translation_pipeline(spark):
    docs = spark.createDataFrame([("a_b_en_1", "i", "", "the o"), ("a_b_en_2", "j", "x", "and p")], "data_id string, instruction string, input string, output string")
    task = translate.TASKS["triple"]
    same = pipelines.translate_docs(docs, task, None, "DE")
    assert sorted(same.collect()) == sorted(docs.collect())
    done = docs.where("data_id = 'a_b_en_1'")
    got = pipelines.translate_docs(docs, task, lambda: Echo(reply=lambda p: p.replace("p", "q")), "de", done).collect()
    assert [r.output for r in got] == ["and q"]
    broken = pipelines.translate_docs(docs, task, lambda: Echo(reply=lambda p: p + T.SEP), "de")
    assert broken.count() == 0
    assert pipelines.translation_cost(docs, task).first().chars == sum(len(x) for x in ("ithe o", "jxand p")) + 4 * len(T.SEP)
    judged = pipelines.judge_pairs(
        spark.createDataFrame([("a_b_en_1", "s")], "data_id string, text string"), *(spark.createDataFrame([("a_b_de_1", x)], "data_id string, text string") for x in ("one", "two")), "DE", ("m1", "m2"),
        lambda: Echo(reply=lambda p: "Translation (b) ##EOS##" if "German" in p else "?"), "{target_language} {source_text} {translation_1} {translation_2}",
    ).first()
    assert judged.winner == "m2" and judged.language == "DE"


def test_reports(spark):
    rows = spark.createDataFrame([("d", 1.0, 2.0, 0.1, ["a", "b"], "x"), ("d", 3.0, 2.0, 0.3, ["a"], "y"), ("e", 1.0, 1.0, 0.2, [], "x")], "dataset string, complexity double, quality double, embedding_distance double, tags array<string>, category string")
    got = {r.dataset: r for r in pipelines.diversity_report(rows).collect()}
    assert got["d"].size == 2 and got["d"].complexity == 2.0 and got["d"].tag_diversity == 1.0 and got["e"].tag_diversity == 0.0
    told = pipelines.analyse(rows, "complexity", low=1, high=6)
    assert told["mean"].first().mean == pytest.approx(5 / 3) and sum(r.n for r in told["by_category"].collect()) == 3
    texts = spark.createDataFrame([("Write long stories",), ("Write long poems",), ("write long stories",), ("Cut wood",)], "instruction string")
    pairs = {(r.verb, r.noun): r.n for r in pipelines.verb_noun(texts).collect()}
    assert pairs == {("write", "long"): 3, ("cut", "wood"): 1}


def test_stream_accepts_once(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    row = lambda i, t: {"request_idx": i, "instruction": t, "input": "", "output": "fine"}
    jsonl(source / "a.json", row(0, "Explain how rivers are formed"), row(1, "Explain how rivers are formed"), row(2, "too short"))
    incremental.run(spark, str(source), out, state).awaitTermination()
    jsonl(source / "b.json", row(3, "Explain how rivers are formed"), row(4, "List many uncommon kitchen tools"), row(5, "Explain how rivers are formed!"))
    incremental.run(spark, str(source), out, state).awaitTermination()
    got = sorted(r.request_idx for r in incremental.accepted(spark, out, 99).collect())
    assert got == [0, 4]
    again = spark.createDataFrame([(4, "List many uncommon kitchen tools", "", "fine")], incremental.SCHEMA)
    incremental.accept(again, 1, out)
    assert sorted(r.request_idx for r in incremental.accepted(spark, out, 99).collect()) == [0, 4]


def test_ordinals_follow_the_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.txt").write_text("".join(f"{k}-{i}\n" for i in range(50)))
    rows = io.with_ordinal(spark.read.option("maxPartitionBytes", 64).text(str(tmp_path)))
    got = sorted((r.ordinal, r.value) for r in rows.collect())
    assert [o for o, _ in got] == list(range(150)) and len({v for _, v in got}) == 150
    for k in range(3):
        assert [v for _, v in got if v.startswith(f"{k}-")] == [f"{k}-{i}" for i in range(50)]


def test_pretty_array(spark, tmp_path):
    import json

    df = spark.createDataFrame([(1, "b\n", [1, 2]), (0, "ä", [])], "ordinal long, text string, n array<int>").repartition(2)
    io.write_pretty(df, str(tmp_path / "out"))
    io.write_pretty(df.limit(0), str(tmp_path / "none"))
    read = lambda p: "".join(x.read_text() for x in sorted(p.glob("part-*")))
    assert json.loads(read(tmp_path / "out")) == [{"text": "ä", "n": []}, {"text": "b\n", "n": [1, 2]}] and "\n    {\n" in read(tmp_path / "out")
    assert json.loads(read(tmp_path / "none")) == []


def test_public_catalogue(spark, tmp_path):
    (tmp_path / "gsm8k.jsonl").write_text('{"instruction": "1 + 1", "output": "2"}\n')
    known = adapters.public_catalogue(str(tmp_path))
    title, rows = known.load(spark, "gsm8k")
    assert title == "GSM8K" and [(r.instruction, r.response) for r in rows.collect()] == [("1 + 1", "2")] and len(known.datasets) == 21


def test_stream_drops_near_copies_of_one_batch(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(0, "Explain how rivers are formed", "", "a"), (1, "Explain how rivers are formed!", "", "b"), (2, "List many uncommon kitchen tools", "", "c")]
    incremental.accept(spark.createDataFrame(rows, incremental.SCHEMA), 0, out)
    assert sorted(r.request_idx for r in incremental.accepted(spark, out, 99).collect()) == [0, 2]


def test_standard_analyses(spark):
    df = spark.createDataFrame([("Add two numbers", "1 2 3 4"), ("Say hi", "hi")], "instruction string, response string")
    scorer = lambda: lambda told: [[-20.0] * 5 + [0.0] for _ in told]
    models = {"categories": Echo, "tagging": lambda: Echo(reply=lambda p: '[{"tag": "' + p + '"}]'), "complexity": scorer, "quality": scorer, "reward_modelling": lambda: lambda told: [[float(len(t))] for t in told]}
    known = Analyzers.standard(models)
    assert set(known.known) == {"categories", "complexity", "quality", "tagging", "tokens", "embeddings", "reward_modelling"}
    out = {r.instruction: r for r in known.run(df, sorted(known.known)).collect()}
    r = out["Add two numbers"]
    assert r.tokens == 7 and r.tagging[0].tag == "Add two numbers" and r.quality == pytest.approx(6.0) and r.complexity == pytest.approx(6.0)
    assert r.categories.startswith("USER: Add") and r.reward_modelling == len(r.categories) and len(r.embeddings) == 64


def test_translations_and_chats(spark):
    df = spark.createDataFrame([("Hallo", [("user", "Hi")])], "text string, messages array<struct<role:string,content:string>>")
    calls = []

    def flaky():
        def ask(told, sampling):
            calls.append(1)
            if not calls[1:]:
                raise RuntimeError("busy")
            return [t.upper() + "##EOT## rest" for t in told]
        return ask

    template = "{source_lang}>{target_lang}: {text}"
    assert translate_text(df, "text", "de", "en", flaky, template).first().translated == "Hallo"
    assert translate_text(df, "text", "de", "fr", flaky, template, wait=0.0).first().translated == "GERMAN>FRENCH: HALLO"
    assert generate_chat(df, "messages", Echo).first().response == "<|im_start|>user\nHi</s>"
