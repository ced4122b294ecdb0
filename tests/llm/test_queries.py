"""The registered queries over the smallest tables, as they are registered, against plain Python."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_documents import brute_links, brute_removed, check_packing
from tests.llm.test_texts import LOWER, brute_main_text, slow_model
from tests.llm.test_vectors import brute

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def queries():
    from tessera.llm.queries import QUERIES

    return QUERIES


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def remainder(i):
    return zlib.crc32(str(i).encode()) % 5


def test_op2(spark, queries, documents):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = queries["op2_packing"](spark, DATA).collect()
    want = Counter()
    for i, t in documents:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for at in range(0, len(ids), 2048):
            want[i, at // 2048, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) <= 1.02 * math.ceil(sum(r.length for r in out) / 2048) + 1


def test_op3(spark, queries, documents):
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in documents:
        ids = own.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries["op3_byte_bpe"](spark, DATA).collect()) == want


def test_op4(spark, queries, documents):
    out = {r.doc_id: r for r in queries["op4_quality"](spark, DATA).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert set(out) == {i for i, _ in documents}
    assert all(r.held_out == (remainder(i) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in out.items())
    aside = [i for i in labels if remainder(i) == 0 and labels[i] is not None and i in out]
    assert np.mean([out[i].predicted == labels[i] for i in aside]) >= 0.85


def test_op7(spark, queries):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    out = queries["op7_html_text"](spark, DATA).collect()
    assert Counter((r.page_id, r.text) for r in out) == brute_main_text(pages) and all(r.n_chars == len(r.text) for r in out)


def test_op8(spark, queries, documents):
    train = [t for i, t in documents if remainder(i) != 1]
    from tessera.llm.queries import LM_ORDER

    before = LM_ORDER - 1
    p, vocabulary = slow_model(train, LM_ORDER)
    counts = Counter(w for t in train for w in [*WORD.findall((t or "").translate(LOWER)), "</s>"])
    total = sum(counts.values())
    out = {r.doc_id: r for r in queries["op8_ngram_lm"](spark, DATA).collect()}
    for i, t in documents:
        tokens = [*WORD.findall((t or "").translate(LOWER)), "</s>"]
        padded = ["<s>"] * before + tokens
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(i) == 1, len(tokens), sum(w in counts for w in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in tokens), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(p(padded[k : k + before], w)) for k, w in enumerate(tokens)), rel=1e-9)


def test_op10(spark, queries):
    rows = [(r.vec_id, None if r.embedding is None else list(r.embedding), 0) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want, got = brute(rows, 20), {}
    for r in queries["op10_polytope_search"](spark, DATA).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {q for q, x in want.items() if x}
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in x}) for q, x in want.items() if x)
    assert hits >= 0.9 * sum(len(x) for x in want.values())
    for q, found in got.items():
        exact = dict(brute_scores(rows, q))
        assert all(s == exact[i] for _, i, s in found) and len(found) == len(want[q])


def brute_scores(rows, q):
    x = next(np.array(v, np.float64) for i, v, _ in rows if i == q)
    return [(i, float((x * np.array(v, np.float64)).sum())) for i, v, _ in rows if v and len(v) == len(x) and None not in v]


def test_pipeline_matches_brute_force(spark, tmp_path, documents):
    """Each stage after the classifier, held against brute force on what the stage before has kept."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs, left = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = docs.collect()
    kept = [(r.doc_id, r.text) for r in left["quality"]]
    assert 0.5 * len(documents) < len(kept) < len(documents)
    apart = [(r.doc_id, r.text) for r in left["near_dedup"]]
    firsts = {i for i, _, c in brute_links(kept) if i == c}
    assert sorted(apart) == sorted(x for x in kept if x[0] in firsts)
    texts = dict(apart)
    want = {i: t if k else texts[i] for i, n, k, t in brute_removed(apart) if not k or k < n}
    assert {r.doc_id: r.text for r in left["substrings"]} == want
    assert all(r.n_chars == len(r.text or "") for r in left["substrings"] if r.text != texts[r.doc_id])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter((r.doc_id, r.piece, r.ids_crc32) for r in left["packing"])
    own = Counter()
    for i, t in want.items():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for at in range(0, len(ids), 2048):
            own[i, at // 2048, zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    assert pieces == own
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, DATA).collect()) == own


def test_stages_of_nothing_and_of_odd_rows(spark, tmp_path):
    """No rows, null ids and texts, repeated rows, and columns of names that operators use."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    clash = ["k1", "spans", "n_words", "n_removed", "kept_text", "_text", "_score", "_gone", "c1"]
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    long = " ".join(f"w{i}" for i in range(60))
    odd = [(None, long, "en", "s", 5, "a", "b"), (None, None, None, None, None, None, None), (1, None, "en", "s", 0, "a", "b"), (2, long, "en", "s", len(long), "a", "b"), (2, long, "en", "s", len(long), "a", "b"), (3, "", "en", "s", 0, "a", "b")]
    odd = [(*r[:5], *(f"{c}{r[5]}" for c in clash)) for r in odd]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, shape)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert name == "packing" or docs.dtypes == spark.createDataFrame([], shape).dtypes
            if name == "substrings" and rows:  # nothing but texts and sizes has changed
                got = Counter(tuple(r[c] for c in ("doc_id", "lang", "source", *clash)) for r in docs.collect())
                assert got == Counter((r[0], r[2], r[3], *r[5:]) for r in rows)
        assert Counter(r.doc_id for r in docs.collect()) == Counter(r[0] for r in rows)
