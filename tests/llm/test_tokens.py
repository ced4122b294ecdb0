"""Token alignment, language identification and the trie of conversations: brute force, held-out accuracy, edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language_id, prefix_trie, token_alignment
from tessera.llm.language_id import Parser, fit_language, identify_language, letters, suffix_automaton
from tessera.llm.prefix_trie import numbered_turns, respliced
from tessera.llm.prefix_trie import prefix_trie as trie
from tessera.llm.queries import QUERIES
from tessera.llm.token_alignment import Aligner, align_tokens, boundaries, byte_alphabet, overlaps

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"
ODD = [None, "", "a", " a", "a ", "  ", "\n", "a\n b", "a \n\n  b  ", "<s> x</s> <0x41> <|endoftext|>", "▁ a", "é  b", "x y", "\x00 a", "日本 語 　 b", "👩‍👩‍👧 a", "  a", "it's 'll  'x", "a b " * 300]


def slow_tokens():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b, letter = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_alphabet()
    a.encode_special_tokens = True

    def told(text):
        """[(id, bytes)] of both, none if they do not give the text back."""
        one = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (one, two) if b"".join(x for _, x in one) == whole == b"".join(x for _, x in two) else ([], [])

    return told


def slow_alignment(texts):
    tokens, rows, counts = slow_tokens(), [], Counter()
    for text in texts:
        one, two = tokens(text) if text else ([], [])
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (one, two)]
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            own = [[], []]
            while i < len(one) and ends[0][i] <= e:
                own[0].append(one[i][0])
                i += 1
            while j < len(two) and ends[1][j] <= e:
                own[1].append(two[j][0])
                j += 1
            groups.append(own)
            links.append((own[0][-1], own[1][-1]))
        counts.update(links)
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(one), len(two), len(groups), links, hashlib.sha256(told.encode()).hexdigest() if told else ""))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(a, b, g, len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), sha) for a, b, g, x, sha in rows]


def test_interval_index():
    rng = random.Random(1)
    for _ in range(200):
        cut = lambda: sorted({*rng.sample(range(1, 40), rng.randint(0, 20)), 40})
        a, b = np.array(cut()), np.array(cut())
        sa, sb = np.concatenate([[0], a[:-1]]), np.concatenate([[0], b[:-1]])
        first, last = overlaps(sa, a, sb, b)
        for i in range(len(a)):
            assert list(range(first[i], last[i])) == [j for j in range(len(b)) if sb[j] < a[i] and sa[i] < b[j]]
        assert b[boundaries(first, last, len(b))].tolist() == sorted(set(a) & set(b))


@pytest.mark.parametrize("small", [False, True])
def test_alignment_matches_brute_force(spark, monkeypatch, small):
    """Whole tables of odd texts, in one block and in blocks of a few stretches."""
    if small:
        monkeypatch.setattr(token_alignment, "BLOCK_STRETCHES", 50)
        monkeypatch.setattr(token_alignment, "ROW", 7)
        monkeypatch.setattr(token_alignment, "KEPT", 10)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(list("ab  \n\té's1.▁ 　<s>#日")) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(20).collect()]
    aligner = Aligner.of(A, B, public_tokenizers.PATTERN)
    block = token_alignment.Block(0, aligner)
    want = slow_alignment(texts)
    told = block.texts(pa.array(texts), pa.array(range(len(texts))), True)
    names = ["n_a", "n_b", "n_groups", "n_links"]
    assert list(zip(*(told.column(c).to_pylist() for c in names), told.column("groups").to_pylist())) == [(*w[:4], w[6]) for w in want]
    rows = [(i if i % 9 else None, t, f"x{i}", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, groups string, block int").repartition(3)
    got = align_tokens(df, A, B, public_tokenizers.PATTERN, digest=True)
    assert got.columns == ["doc_id", *names, "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == Counter((r[0], *w) for r, w in zip(rows, want))


def test_alignment_of_other_tokenizers_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "a  b"), (1, "a  b"), (2, None)], "doc_id long, text string")
    told = align_tokens(df, A, B).collect()  # without a pattern the tokenizer itself encodes
    assert sorted((r.doc_id, r.n_links, r.n_best, r.count_sum, r.groups != "") for r in told) == [(1, 3, 3, 6, True)] * 2 + [(2, 0, 0, 0, False)]
    assert align_tokens(df.limit(0), A, B).collect() == []


def test_op11(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = dict(zip(docs, slow_alignment(docs.values())))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_token_alignment"](spark, DATA).collect()}
    assert got == want


def slow_phrases(text, sample):
    """Greedy longest matches by plain search, in stretches."""
    n = 0
    for at in range(0, len(text), language_id.STRETCH):
        part, i = text[at : at + language_id.STRETCH], 0
        while i < len(part):
            j = i + 1
            while j < len(part) and any(part[i : j + 1] in s for s in sample) and any(part[i:j] in s for s in sample):
                j += 1
            n, i = n + 1, j
    return n


def test_automaton_knows_all_substrings():
    rng = random.Random(2)
    for _ in range(50):
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30)))
        moves = suffix_automaton(text)

        def known(s, moves=moves):
            state = 0
            for c in s:
                if c not in moves[state]:
                    return False
                state = moves[state][c]
            return True

        assert len(moves) <= max(1, 2 * len(text))
        for a in range(len(text)):
            assert all(known(text[a:b]) for b in range(a, len(text) + 1))
        assert all(known(s) == (s in text) for s in (bytes(rng.choice(b"abcd") for _ in range(3)) for _ in range(30)))


def test_phrases_match_brute_force(monkeypatch):
    monkeypatch.setattr(language_id, "STRETCH", 40)
    rng = random.Random(3)
    make = lambda letters_, n: bytes(rng.choice(letters_) for _ in range(n))
    samples = [[make(b"abc ", 60), make(b"ab", 30)], [make(b"bcd ", 80)], [b""]]
    parser = Parser([[t for t in s if t] for s in samples])
    texts = [make(b"abcd e", rng.randint(0, 150)) for _ in range(60)]
    at = np.cumsum([0, *map(len, texts)])
    got = parser.phrases(np.frombuffer(b"".join(texts), np.uint8), at)
    assert got.tolist() == [[slow_phrases(t, [x for x in s if x]) for s in samples] for t in texts]
    raw, at = letters(pa.array(["Ab-1 C", None, "  É!x", "..", ""]))
    assert [raw[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == ["ab c", "", "é x", "", ""]


def test_languages_of_odd_rows(spark):
    rng = random.Random(4)
    words = {"xx": ["aka", "oki", "uka", "ikka"], "yy": ["bel", "lob", "blu", "elb"]}
    say = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(i, say(k, 40), k, "old") for i in range(20) for k in words] + [(None, None, "xx", None), (7, say("xx", 9), None, "old"), (8, "123 !?", "yy", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").repartition(3)
    model = fit_language(df)
    assert model.names == ["xx", "yy"]
    odd = [(1, "AKA, OKI!", "a", "b"), (2, None, "a", "b"), (3, "", "a", "b"), (4, "99 --", "a", "b"), (5, say("yy", 30_000), "a", "b"), (6, "qqq", "a", "b"), (6, "qqq", "a", "b"), (None, "lob", "a", "b")]
    told = identify_language(spark.createDataFrame(odd, "doc_id long, text string, _text string, lang_pred string"), model)
    assert told.columns == ["doc_id", "text", "_text", "lang_pred", "score"]
    got = Counter((r.doc_id, r.lang_pred) for r in told.where("doc_id is null or doc_id <> 6").collect())
    assert got == Counter([(1, "xx"), (2, "und"), (3, "und"), (4, "und"), (5, "yy"), (None, "yy")])
    assert told.where("doc_id = 6").select("lang_pred", "score").distinct().count() == 1 and told.count() == 8
    assert all(0 <= r.score <= 1 and r._text == "a" and (r.score == 0) == (r.lang_pred == "und") for r in told.collect())
    assert all(r.score == pytest.approx(0.5, abs=0.2) for r in told.where("doc_id = 6").collect())  # nothing speaks for either
    assert identify_language(df.limit(0), model).collect() == []
    none = fit_language(df.where("lang is null"))
    assert none.names == [] and {r.lang_pred for r in identify_language(df, none).collect()} == {"und"}


def test_op12_held_out(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = QUERIES["op12_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    aside = [r for r in got if r.held_out]
    assert len(aside) > 250 and sum(r.lang_pred == docs[r.doc_id].lang for r in aside) >= 0.98 * len(aside)
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", docs[r.doc_id].text or "")) for r in got)


CHATS = "conv_id long, turn long, role string, text string"


def slow_order(rows):
    by_conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by_conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(x)] for c, x in by_conv.items()}


def slow_trie(convs):
    nodes = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes[d, tuple(convs[c][:d])].append(c)
    saved = {k: (len(v) - 1) * (len(k[1][-1][1]) if k[0] else 0) for k, v in nodes.items()}
    out = []
    for (d, path), members in nodes.items():
        below = [k for k in nodes if k[0] >= d and k[1][:d] == path]
        kids = [k for k in below if k[0] == d + 1]
        ends = ",".join(str(c) for c in members if len(convs[c]) == d)
        up = nodes[d - 1, path[:-1]][0] if d else None
        leaves = sum(not any(x[0] == k[0] + 1 and x[1][: k[0]] == k[1] for x in nodes) for k in below)
        out.append((members[0], d, up, len(members), len(kids), leaves, sum(saved[k] for k in below), hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def slow_respliced(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:]
    return out


def chats(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        own = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc"])) for t in range(rng.randint(1, 7))]
        rows += own
        if c % 5 == 0:
            rows += [(1000 + 10 * c + k, t, r, x) for k in range(3) for _, t, r, x in own]  # copies
    rows += [(None, 0, "user", "lost"), (3, None, None, None), (-250, None, "user", "x"), (-250, None, "user", "x"), (-200, 5, None, "y"), (-201, 0, "user", "short")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("wide", [1024, 3])
def test_trie_matches_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(prefix_trie, "WIDE", wide)
    rows = chats(wide, 25)
    df = spark.createDataFrame([(*r, "clash") for r in rows], CHATS + ", pos string").repartition(5)
    told = numbered_turns(df, texts=True)
    want = slow_order(rows)
    got = defaultdict(list)
    for r in told.orderBy("conv_id", "pos").collect():
        got[r.conv_id].append((r.pos, (r.role, r.text)))
        assert r.size == len(r.text)
    assert {c: [t for _, t in x] for c, x in got.items()} == want and all([p for p, _ in x] == list(range(1, len(x) + 1)) for x in got.values())
    assert Counter(tuple(r) for r in trie(told).collect()) == slow_trie(want)
    rebuilt, convs = respliced(numbered_turns(df))
    assert Counter(tuple(r) for r in trie(rebuilt, convs).collect()) == slow_trie(slow_respliced(want))


def test_trie_of_deep_copies_and_of_nothing(spark):
    """Long equal conversations are one chain; a conversation may end inside another."""
    long = [(t, "user", f"t{t % 3}") for t in range(120)]
    rows = [(c, *t) for c in (4, 9) for t in long] + [(5, *t) for t in long[:2]] + [(6, *t) for t in long[:1]] + [(6, 1, "user", "other")]
    df = spark.createDataFrame(rows, CHATS)
    assert Counter(tuple(r) for r in trie(numbered_turns(df)).collect()) == slow_trie(slow_order(rows))
    empty = numbered_turns(df.limit(0))
    assert trie(empty).collect() == []
    turnless = spark.createDataFrame([(3,), (1,)], "conv_id long")
    assert [tuple(r) for r in trie(empty, turnless).collect()] == [(1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,3").hexdigest())]
