"""Shingle join, substring dedup, packing and the pipeline against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import packing
from tessera.llm._components import components
from tessera.llm.packing import best_fit, local_search, pack, slots
from tessera.llm.shingle_join import _climb, forest_depth, forest_depths, shingle_links
from tessera.llm.substring_dedup import FingerprintIndex, dedup_substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, rep int, spans string, chunk string, _0 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", 1, "b", "c", "d") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}é" for _ in range(n)]


def corpus(seed=0):
    rng = random.Random(seed)
    passage = words(rng, 70)
    rows = []
    for k in range(40):
        w = words(rng, rng.choice([3, 20, 60, 150, 400]))
        if k % 4 == 0:
            at = rng.randrange(len(w) + 1)
            w = w[:at] + passage + w[at:]
        rows.append(w)
        for _ in range(k % 4):
            c = list(w)
            for _ in range(rng.randrange(4)):
                c[rng.randrange(len(c))] = "changed"
            rows.append(c)
    line = words(rng, 30)
    rows += [line * 8, words(rng, 10) + line * 5, line * 6]
    texts = [rng.choice([" ", "\n", " \t "]).join(w) for w in rows]
    texts += [None, "", " \n", "one", "one", "one two", words(rng, 1)[0] * 3000, " ".join(words(rng, 6000)), " ".join(passage), " ".join(passage[:49]), "a b c d e"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def brute_links(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    n, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                    n[a] += 1
                    n[b] += 1
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return sorted((i, n[i], find(i)) for i in ids)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 500 + k) for k in range(1, 40)] + [(700, 700), (None, 3), (801, 800), (800, 801)]
    rng.shuffle(edges)
    want = {**{i: 0 for i in range(201)}, **{500 + k: 500 for k in range(40)}, 800: 800, 801: 800}
    for small in (0, 60, 1000):
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
        assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_forest_depth():
    assert forest_depth(20, 16, 0.8, 0.9995) == 5
    assert forest_depth(1, 16, 0.8, 0.99) == 1


def test_forest_depths_by_size():
    """Small sets that are similar at all are nearly equal, so their prefixes stay longer; none is shorter than recall asks for."""
    depths = forest_depths(20, 8, 0.8, 0.9995)
    assert depths[1:4].tolist() == [8, 8, 8] and depths[4] == 5 and depths[6] == 6 and depths.min() == depths[-1] == 5
    for m in range(1, 12):
        lowest = min(x for n in range(1, 30) for k in range(1, min(m, n) + 1) if (x := k / (m + n - k)) >= 0.8)
        assert lowest == 1 or 1 - (1 - lowest ** depths[m]) ** 20 >= 0.9995


def test_climb_over_batches():
    """The nodes of a sorted run are the same however it is cut into batches."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = sorted((int(rng.integers(2)), tuple(rng.integers(3, size=4).tolist()), i, int(rng.integers(2, 5))) for i in range(200))

    def nodes(cut):
        made = []
        for at in range(0, len(rows), cut):
            tree, label, rep, need = zip(*rows[at : at + cut])
            raw = [np.array(x, ">u4").tobytes() for x in label]
            made.append(pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(raw, pa.binary()), pa.array(rep, pa.int64()), pa.array(need, pa.int32())], names=["tree", "label", "rep", "need"]))
        out = pa.Table.from_batches(list(_climb(4, frozenset([2, 3, 4]), 1)(iter(made)))).to_pylist()
        members = {}
        for r in out:
            members.setdefault((r["tree"], r["node"]), set()).add(r["rep"])
        return sorted(sorted(x) for x in members.values() if len(x) > 1)

    want = []
    for depth in (2, 3, 4):
        groups = {}
        for tree, label, rep, need in rows:
            if need <= depth:
                groups.setdefault((tree, label[:depth]), []).append(rep)
        want += [sorted(g) for g in groups.values() if len(g) > 1]
    for cut in (1, 7, 64, 200):
        assert nodes(cut) == sorted(want)


def test_shingle_links_match_brute_force(spark):
    rows = corpus()
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in shingle_links(frame(spark, rows).repartition(3)).collect())
    assert got == brute_links(rows)


def test_shingle_links_in_small_chunks(spark):
    rng = random.Random(9)
    base = words(rng, 300)
    rows = []
    for i in range(60):
        c = list(base)
        c[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(c)))
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in shingle_links(frame(spark, rows), chunk=8).collect())
    assert got == brute_links(rows)


def test_shingle_links_edges(spark):
    assert shingle_links(frame(spark, [])).collect() == []
    text = "a b c d e f g h"
    rows = [(None, text), (1, text), (1, text), (2, text), (3, None)]
    got = sorted((r.doc_id or -1, r.n_links, r.component_id, r.kept) for r in shingle_links(frame(spark, rows)).collect())
    assert got == [(-1, 0, None, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def brute_removed(rows, window=50):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((-1 if i is None else i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3])
def test_substrings_match_brute_force(spark, batches):
    rows = corpus(1)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in dedup_substrings(frame(spark, rows).repartition(3), batches=batches).collect())
    assert got == brute_removed(rows)


def test_substrings_edges(spark):
    assert dedup_substrings(frame(spark, [])).collect() == []
    long = " ".join(f"v{k}" for k in range(60))
    rows = [(4, long), (4, long), (4, "other " + long), (None, long), (5, "  " + long + " tail\n"), (6, None)]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in dedup_substrings(frame(spark, rows)).collect())
    assert got == brute_removed(rows)
    own = {r.doc_id: r for r in dedup_substrings(frame(spark, rows[4:]), columns=("text", "id", "_0"), verbatim=True).collect()}
    assert own[5].kept_text == rows[4][1] and own[5].id == "a" and own[5]._0 == "d" and own[6].kept_text in (None, "")


def test_index_grows_and_compacts(spark):
    """Batches of a growing corpus give what one pass over all of it gives."""
    rows = corpus(2)
    index = FingerprintIndex(spark, max_runs=2)
    spans = []
    for at in range(0, len(rows), 30):
        spans += index.add(frame(spark, rows[at : at + 30])).collect()
        assert len(index.runs) <= 2
    split = {i: WORD.findall(t or "") for i, t in rows}
    gone = {i: [False] * len(w) for i, w in split.items()}
    for s in spans:
        for k in [0] if s.whole else s.starts:
            size = len(split[s.id]) if s.whole else 50
            gone[s.id][k : k + size] = [True] * size
    assert sorted((i, sum(g)) for i, g in gone.items()) == [(i, r) for i, _, r, _ in brute_removed(rows)]
    assert index.compactions > 0
    index.close()
    assert index.runs == {}


def test_index_is_opened_again(spark, tmp_path):
    """Two sessions, each with half of the corpus, remove what one pass over all of it removes."""
    rows = corpus(3)
    folder = f"file://{tmp_path}/index"
    half = len(rows) // 2
    spans = FingerprintIndex(spark, folder=folder).add(frame(spark, rows[:half])).collect()
    later = FingerprintIndex(spark, folder=folder, max_runs=1)
    assert len(later.runs) == 1 and len(later.texts) == 1
    spans += later.add(frame(spark, rows[half:])).collect()
    assert len(later.runs) == 1 and later.compactions == 1
    later.close()
    assert len(FingerprintIndex(spark, folder=folder).runs) == 1
    with pytest.raises(ValueError):
        FingerprintIndex(spark, window=40, folder=folder)
    split = {i: WORD.findall(t or "") for i, t in rows}
    gone = {i: [False] * len(w) for i, w in split.items()}
    for s in spans:
        for k in [0] if s.whole else s.starts:
            size = len(split[s.id]) if s.whole else 50
            gone[s.id][k : k + size] = [True] * size
    assert sorted((i, sum(g)) for i, g in gone.items()) == [(i, r) for i, _, r, _ in brute_removed(rows)]


def test_best_fit_and_search():
    rng = random.Random(3)
    counts = Counter(rng.randrange(1, 100) for _ in range(3000))
    bins = best_fit(counts, 100)
    better = local_search(bins, 100)
    for b in (bins, better):
        assert Counter(x for p, n in b.items() for x in p for _ in range(n)) == counts
        assert all(sum(p) <= 100 for p in b)
    least = -(-sum(k * n for k, n in counts.items()) // 100)
    big = sum(n for k, n in counts.items() if k > 50)  # no two of these share a bin
    assert max(least, big) <= sum(better.values()) <= sum(bins.values()) <= 1.02 * max(least, big)


def test_search_empties_bins():
    """Best fit needs three bins for what two hold; an exchange finds it."""
    bins = Counter({(5, 3): 1, (4, 4): 1, (2, 2): 1})
    assert sum(local_search(bins, 10).values()) == 2
    assert sum(local_search(Counter({(6, 3): 100, (6, 2): 100, (2,): 100}), 11).values()) == 200


def test_slots_give_every_piece_a_place():
    counts = Counter({5: 7, 3: 9, 10: 2})
    plan = slots(best_fit(counts, 10))
    seen = {}
    for length, n in counts.items():
        for rank in range(n):
            at = np.searchsorted(plan[length][:, 0], rank, "right") - 1
            first, sequence, offset = plan[length][at]
            seen.setdefault(sequence + rank - first, []).append((offset, length))
    for parts in seen.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 10


def check_packing(rows, out, tokenizer, capacity):
    want = Counter()
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for p in range(0, len(ids), capacity):
            part = ids[p : p + capacity].tobytes()
            want[i, p // capacity, p, len(part) // 4, part] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_pack(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(6)
    odd = ["hello <|endoftext|> world", "a<|startoftext|>b <|ENDOFTEXT|> C<|endoftext|>'s", "<|endoftext|><|endoftext|> <|endoftext", "ΑΣ ΣΑΣ　Σ", "é ́x", "<|endoftext|> it's 1234 ½ ＡＢ", "a b c", "x" * 5000, "日本語 テスト", "İstanbul \x1c\x1d ok", "don't\r\nI'LL"]
    rows = corpus(4) + [(1000 + k, t) for k, t in enumerate(odd)] + [(None, "null id"), (7, "again"), (2000, " ".join(words(rng, 3000)))]
    out = pack(frame(spark, rows).repartition(4), path, capacity=256).collect()
    bins = check_packing(rows, out, tokenizer, 256)
    alone = sum(best_fit(Counter(r.length for r in out), 256).values())
    assert -(-sum(r.length for r in out) // 256) <= bins <= alone
    crc = {(r.doc_id, r.piece): r.ids for r in pack(frame(spark, rows[:20]), path, output="crc32").collect()}
    whole = {(r.doc_id, r.piece): r.ids for r in pack(frame(spark, rows[:20]), path).collect()}
    assert crc == {k: zlib.crc32(v) for k, v in whole.items()}
    assert pack(frame(spark, []), path).collect() == []


def test_word_ids(monkeypatch):
    """Parts cut at signs, and parts forgotten in between, give the ids of whole texts."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rng = random.Random(0)
    letters = "".join(chr(c) for c in range(1, 256)) + "\u0301\u2026\u3000\u2019\u0130\u03a3\u212a" + "ab.,'!sT " * 20
    texts = ["it's don't I'LL 'tis o'clock''s a'", "a.b,c1d2 é.x …. a…b", "x\u0301.y .\u0301a", "...a...b", "a", ".b", None, "", "x <|endoftext|>y", "<|EndOfText|> A.<|startoftext|>.b'<|endoftext|>", "<|endoftext|>"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(1500)]
    encode = packing.WordIds(path)
    monkeypatch.setattr(packing.WordIds, "MEMO", 3000)
    for _ in range(2):
        for at in range(0, len(texts), 400):
            ids, of = encode(pa.array(texts[at : at + 400]), 0)
            want = whole.encode_batch([t or "" for t in texts[at : at + 400]], add_special_tokens=False)
            assert [ids[a:b].tolist() for a, b in zip(of, of[1:])] == [[*w.ids, 0] for w in want]


def test_hash_hits_are_checked(monkeypatch):
    """Parts of one hash are encoded apart."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    encode = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = pa.array(["one two", "three, four", None])
    want = [x.tolist() for x in encode(texts, 0)]
    own = packing.Words.hashes
    monkeypatch.setattr(packing.Words, "hashes", lambda self, seed=0: own(self, seed) if seed else own(self) * np.uint64(0))
    encode.forget()
    assert [x.tolist() for x in encode(texts, 0)] == want == [x.tolist() for x in encode.plain(texts, 0)]


def test_cased_and_joining_tokenizers(tmp_path):
    pytest.importorskip("tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer, models, pre_tokenizers

    cased = Tokenizer(models.WordLevel({"?": 0, "Ab": 1, "ab": 2, "a": 3, "b": 4, **{chr(c): c for c in range(33, 48)}}, unk_token="?"))
    cased.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    cased.save(str(tmp_path / "joins.json"))
    with pytest.raises(ValueError):  # letters and digits are one token
        packing.WordIds(str(tmp_path / "joins.json"))
    cased.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.BertPreTokenizer(), pre_tokenizers.Digits()])
    cased.save(str(tmp_path / "cased.json"))
    ids, of = packing.WordIds(str(tmp_path / "cased.json"))(pa.array(["Ab ab!AB", "a-b"]), 99)
    assert [ids[a:b].tolist() for a, b in zip(of, of[1:])] == [[*cased.encode(t).ids, 99] for t in ("Ab ab!AB", "a-b")]


def test_search_says_when_it_is_stopped(caplog):
    local_search(Counter({(5, 3): 1, (4, 4): 1, (2, 2): 1}), 10, steps=1)
    assert "stopped after 1" in caplog.text


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    good = [" ".join(words(rng, 120)) for _ in range(60)]
    junk = ["".join(rng.choice("ABCDEFG") for _ in range(6)) + "!! " for _ in range(60)]
    junk = [" ".join(rng.sample(junk, 40)) for _ in range(30)]
    shared = " ".join(words(rng, 80))
    texts = good + junk + [good[0], good[1] + " tail", shared + " " + " ".join(words(rng, 60)), " ".join(words(rng, 40)) + " " + shared, None, ""]
    rows = list(enumerate(texts))
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 0 if 60 <= i < 90 else 1, 0) for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = {r.doc_id: r for r in docs.collect()}
    assert not set(range(60, 90)) & set(left["quality"]) and set(range(60)) <= set(left["quality"])
    assert 90 not in left["near_dedup"] and 91 not in left["near_dedup"] and 0 in left["near_dedup"]
    assert left["substrings"][92].text == texts[92] and shared not in left["substrings"][93].text
    assert left["substrings"][93].n_chars == len(left["substrings"][93].text)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(left["substrings"])
    assert len({r.sequence_id for r in packed}) <= sum(best_fit(Counter(r.length for r in packed), 2048).values())


def test_registered_queries(spark):
    """The thin queries over the smallest tables, held against plain Python."""
    from tessera.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in QUERIES["op5_shingle_join"](spark, d).collect())
    assert got == brute_links(rows)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op6_substring_dedup"](spark, d).collect())
    assert got == [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute_removed(rows)]


def test_shared_folder_is_cleared(spark):
    from tessera.llm import _store

    table = _store.Kept(spark).put(spark.range(3), "x")
    assert table.count() == 3 and table._tessera_path.startswith(_store.shared_folder(spark))
    _store.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(table._tessera_path).count()


def test_only_small_tables_are_merged(spark, tmp_path, monkeypatch):
    from tessera.llm import _store

    spark.range(1000).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t")).repartition(40)
    assert _store.few_files(rows).rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(_store, "SMALL_BYTES", 0)
    assert _store.few_files(rows).rdd.getNumPartitions() == 40


def test_ids_are_whole_numbers(spark):
    rows = spark.createDataFrame([("x1", "a b c")], "doc_id string, text string")
    for operator in (shingle_links, dedup_substrings):
        with pytest.raises(Exception):
            operator(rows).collect()
    rows = spark.createDataFrame([("7", "a b c"), ("8", "a b c")], "doc_id string, text string")
    assert {r.doc_id: r.n_links for r in shingle_links(rows).collect()} == {7: 1, 8: 1}
