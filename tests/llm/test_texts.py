"""Byte BPE, quality, HTML, language model and chat formatting: references, round trips and edge cases."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_lm, quality
from tessera.llm._text import Words, grams, pieces, within
from tessera.llm.byte_bpe import ByteBPE, encode_documents
from tessera.llm.chat_format import END, SEP, START, escape, format_chat, read_turns, unescape
from tessera.llm.html_text import Page, main_text

SCHEMA = "doc_id long, text string, score double, id string, label string, told string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "a", "b", "c") for i, t in rows], SCHEMA)


def test_words_match_the_pattern():
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab \t\n\x0b\x0c\ré日\x1c\u00a0") for _ in range(rng.randrange(30))) for _ in range(300)] + [None, ""]
    column = pa.array(texts)
    w = Words(column)
    got = [[w.text(k).decode() for k in range(w.of[i], w.of[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    h = dict(zip([x for g in got for x in g], w.hashes().tolist()))
    assert len(set(h.values())) == len(h)
    valid, of = within(w.of, 3)
    assert int(valid.sum()) == of[-1] == sum(max(0, len(g) - 2) for g in got)
    assert len(grams(w.hashes(), 3)) == max(0, len(w) - 2)
    assert [len(p) for _, p in pieces(column, 40)] and sum(len(p) for _, p in pieces(column, 40)) == len(texts)
    assert len(Words(column.slice(5, 7))) == sum(map(len, got[5:12]))


def slow_merge(ranks, token):
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_merges_in_rank_order():
    """Also where a merge makes a pair of lower rank than its own."""
    rng = random.Random(1)
    for trial in range(30):
        letters = [bytes([c]) for c in b"abcd"]
        grown = set()
        while len(grown) < 25:
            pool = letters + sorted(grown)
            grown.add(rng.choice(pool) + rng.choice(pool))
        order = sorted(g for g in grown if len(g) < 9)
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate([bytes([b]) for b in range(256)] + order)}
        bpe = ByteBPE(ranks, r"\S+|\s+")
        tokens = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
        want = [[ranks[t]] if t in ranks else slow_merge(ranks, t) for t in tokens]
        assert bpe.merge(tokens) == want and [bpe.merge([t])[0] for t in tokens] == want, trial


def test_bpe_as_tiktoken(spark):
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \t\n  é1'!sté\u00a0\x1c\x85😀\u2003 日") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += [None, "", "a" * 30_000, "ab" * 5000 + " x", "<|endoftext|>", "it's we'll they'd'"]
    rows = list(enumerate(texts)) + [(None, "null id"), (1, "again")]
    out = encode_documents(frame(spark, rows).repartition(3), path, public_tokenizers.PATTERN).collect()
    want = Counter((i, tuple(own.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in out) == want and all(r.n_tokens == len(r.ids) for r in out)
    digest = encode_documents(frame(spark, rows), path, public_tokenizers.PATTERN, output="digest").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digest) == Counter(
        (i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t).hexdigest()) for i, x, t in want.elements()
    )
    assert encode_documents(frame(spark, []), path, public_tokenizers.PATTERN).collect() == []


def test_quality_learns_and_passes_columns(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "of", "words", "flow", "gently", "and", "stop."]) + rng.choice(["", "ing", "ed"]) for _ in range(60))
    bad = lambda: " ".join("".join(rng.choice("QWERTZ") for _ in range(5)) + rng.choice(["!!", "%%%"]) for _ in range(60))
    rows = [(i, good() if i % 4 else bad()) for i in range(300)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0, "x") for i in range(0, 300) if i % 5] + [(None, 1, "x"), (7, None, "x")], "doc_id long, quality int, text string")
    model = quality.fit_quality(docs, labels)
    again = quality.fit_quality(docs.repartition(7), labels)
    more = frame(spark, rows + [(1000, None), (1001, ""), (None, good()), (1002, good() + "\n" + "word " * 20000)])
    out = {r.doc_id: r for r in quality.score_quality(more, model, score_col="_q").collect()}
    assert all((out[i]._q >= 0.3) == bool(i % 4) for i in range(0, 300, 5))
    assert out[1].score == 0.5 and out[1].label == "b" and 0 <= out[1000]._q <= 1 and out[1000]._q == out[1001]._q
    twice = {r.doc_id: r.score for r in quality.score_quality(more, again).collect()}
    assert all(abs(out[i]._q - twice[i]) < 1e-9 for i in range(300))
    assert quality.score_quality(frame(spark, []), model).collect() == []


def test_quality_tells_words_of_one_form_apart(spark):
    """Texts of equal word shapes whose labels lie in the words alone."""
    rng = random.Random(8)
    kinds = (["spam", "cash", "sell", "wins"], ["good", "calm", "read", "tree"])
    rows = [(i, " ".join(rng.choice(kinds[i % 2] + ["with", "from", "that"]) for _ in range(40))) for i in range(300)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300) if i % 5], "doc_id long, quality int")
    out = {r.doc_id: r.score for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()}
    assert all((out[i] >= 0.5) == bool(i % 2) for i in range(0, 300, 5))


def test_word_vectors_match_brute_force(spark):
    """Contexts of words of two labelled rows and more, and the means of documents, by their definition."""
    rng = random.Random(14)
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rng.randrange(1, 9))) + f" own{k}" for k in range(30)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    model = quality.fit_quality(frame(spark, [*enumerate(texts), (3, texts[3]), (99, "alpha unlabelled")]), labels)
    names = sorted({w for t in texts for w in t.split()})
    hashed = dict(zip(names, Words(pa.array([" ".join(names)])).hashes().tolist()))
    index = {w: quality.index_vectors(np.array([h], np.uint64))[0].astype(float) for w, h in hashed.items()}
    sums, rows = defaultdict(lambda: np.zeros(quality.WIDTH)), Counter()
    for t in texts:
        w = t.split()
        rows.update(set(w))
        for i, x in enumerate(w):
            for j in range(max(0, i - quality.NEIGHBOURS), min(len(w), i + quality.NEIGHBOURS + 1)):
                if i != j:
                    sums[x] += index[w[j]]
    want = {hashed[w]: np.rint(sums[w] / max(np.linalg.norm(sums[w]), 1e-9) * quality.UNIT) for w, n in rows.items() if n > 1}
    assert model.known.tolist() == sorted(want)
    assert all((model.learned[k] == want[h]).all() for k, h in enumerate(model.known.tolist()))
    vector = lambda w: index[w] + want.get(hashed[w], 0) / quality.UNIT
    means = quality.word_means(Words(pa.array(texts)), model.known, model.learned)
    assert np.allclose(means, [np.mean([vector(w) for w in t.split()], axis=0) for t in texts], atol=1e-6)


def test_quality_without_labels(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in quality.score_quality(docs, quality.fit_quality(docs, ones)).collect())


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";if(a<b){}</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home<li>Two</ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">Accept</div><div id="ad-1">Buy</div>
<article><h1>Title&nbsp;&lt;one&gt;</h1><p>First <b>bold</b>\n  text<br>line<p>Second &eacute; &#233; &#xe9;<ul><li>x<li>y</ul><div class="share">Share</div><form><p>Your mail</p></form>tail</article>
<section class="comments"><p>Nice!</p></section><aside>Side</aside><footer>End</footer></body>"""


def test_page():
    assert Page(PAGE).text == "Title <one>\nFirst bold text line\nSecond é é é\nx\ny\ntail"
    assert Page("").text == "" and Page("plain  text").text == "plain text"
    assert Page("<p>a<p>b</div></span>c<table><tr><td>1<td>2</table>").text == "a\nbc\n1\n2"
    assert Page("<body><main><p>m</p></main><p>outside</p>").text == "m"
    assert Page("a < b <3 <p title='x>y'>c</p><p class=\"un>closed").text == "a < b <3\nc\nclosed"
    assert Page("<script>never closed <p>x").text == ""
    deep = Page("<div>" * 20_000 + "core" + "</div>" * 20_000)
    assert deep.text == "core"


@pytest.mark.parametrize(("page", "text"), [
    ('<main><p>Long real text.</p><section class="comments"><article class="comment">Nice</article></section></main>', "Long real text."),
    ("<main><p>Long real text.</p><aside><article>See also</article></aside></main>", "Long real text."),
    ("<div><p>Long real text.</p></div><article></article>", "Long real text."),
    ('<body><form id="all"><nav>Menu</nav><article><p>Long real text.</p></article><input><button>Go</button></form></body>', "Long real text."),
    ('<main><p>Long real text.</p><article class="related-card">See also</article></main>', "Long real text."),
    ("<p>A</p><!--><p>B</p><!---><p>C</p><!-- x --!><p>D</p><!-- y > -- --><p>E</p>", "A\nB\nC\nD\nE"),
    ('<div class="page-header"><h1>Title</h1></div><div class="content related"><p>Body</p></div><div class="header">Site</div><div class="related">More</div>', "Title\nBody"),
    ("<form><p>Your mail</p></form><form><main><p>In</p></main></form><form><p>Again</p></form>", "In"),
    ('<div><article class="teaser"><p>One</p></article><p>Two</p></div>', "One\nTwo"),
    ("<nav>Menu</nav><form><label>Name</label></form>", ""),
])
def test_a_page_keeps_its_text(page, text):
    assert Page(page).text == text
    frame_ = f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>"
    assert Page(frame_).text == text


class Tree(HTMLParser):
    """Elements and texts of well-formed markup, by the standard library's parser."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.root = self.top = ("body", {}, [], None)
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (tag, dict(attrs), [], self.top)
        self.top[2].append(node)
        self.top = node

    def handle_endtag(self, tag):
        self.top = self.top[3]

    def handle_data(self, data):
        self.top[2].append(data)


def slow_main_text(source):
    """The contract's rules on a tree: what goes, in which region each block of text stands, and the highest region that has text."""
    blocks = []

    def holds(node):
        return any(not isinstance(c, str) and (c[0] in ("article", "main") or holds(c)) for c in node[2])

    def walk(node, region, line, inline):
        tag, attrs, children, _ = node
        words = (attrs.get("class") or "").split() if tag != "main" else []  # a main element is one whatever it is called
        if tag in ("nav", "aside", "footer", "script") or "ad" in words or "comments" in words or (tag == "form" and not holds(node)) or (tag == "header" and not region):
            if tag not in ("b", "span"):
                end(line, region)
            return
        card = tag == "article" and "card" in words
        if card and region:
            end(line, region)
            return
        own = 2 if tag == "article" and not card else max(1, region) if tag == "main" else region
        block = tag not in ("b", "span")
        if block:
            end(line, region)
        for c in children:
            if isinstance(c, str):
                line.append(c)
            else:
                walk(c, own, line, inline)
        if block:
            end(line, own)

    def end(line, region):
        text = " ".join("".join(line).split())
        if text:
            blocks.append((region, text))
        line.clear()

    walk(Tree(source).root, 0, [], False)
    best = max((r for r, _ in blocks), default=0)
    return "\n".join(t for r, t in blocks if r >= best)


def test_random_pages_match_a_slow_extractor():
    rng = random.Random(4)

    def grow(depth, form):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["word ", "two  words", "&amp; &eacute;", " ", "\n", "x<!-- gone -->y"])
        tag = rng.choice(["div", "section", "b", "span", "main", "article", "aside", "nav", "header", "footer", "form", "div", "div", "p"])
        if tag == "form" and form:
            tag = "div"
        if tag == "p":
            return f"<p>{rng.choice(['par', 'a <b>bold</b> one'])}</p>"
        attrs = rng.choice(["", "", "", ' class="ad"', ' class="comments"', ' class="card big"', ' class="text"', ' id="k1"'])
        return f"<{tag}{attrs}>" + "".join(grow(depth - 1, form or tag == "form") for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    some = 0
    for _ in range(4000):
        source = "".join(grow(4, False) for _ in range(3))
        assert Page(source).text == slow_main_text(source), source
        some += Page(source).text != ""
    assert some > 2000


def test_site_templates(spark):
    pages = []
    for k in range(12):
        body = f"<div><p>Own text {k}</p></div><div><p>Read our blog</p><p>Daily</p></div>"
        pages.append((k, f"https://a.example/{k}", f"<html><body>{body}</body></html>", "x"))
    for k in range(30):
        art = "The same article" if k < 15 else f"Article {k}"
        pages.append((100 + k, f"http://B.example/{k}?q", f"<body><div>Menu of B</div><article><p>{art}</p></article></body>", "x"))
    pages += [(200, None, "<p>null url</p>", "x"), (201, "https://c.example/", None, "x"), (None, "https://c.example/", "<p>null id</p>", "x"), (0, "https://a.example/0", pages[0][2], "x")]
    out = main_text(spark.createDataFrame(pages, "page_id long, url string, html string, text string").repartition(3)).collect()
    got = Counter((r.page_id, r.text) for r in out)
    want = Counter((k, f"Own text {k}") for k in range(12)) + Counter((100 + k, "The same article" if k < 15 else f"Article {k}") for k in range(30))
    assert got == want + Counter([(200, "null url"), (201, ""), (None, "null id"), (0, "Own text 0")])
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_templates_outside_leave_articles(spark):
    """Blocks that recur in footers, asides or plain divs of a host, or wrappers of copied articles, take nothing out of its articles."""
    pages = []
    for k in range(12):
        same = "<p>Released under MIT</p><h2>Title</h2>" if k < 4 else ""
        extra = "<div><p>Released under MIT</p></div><footer><p>Released under MIT</p></footer><aside><h2>Title</h2></aside>"
        pages.append((k, f"https://a.example/{k}", f"<body><article><p>Own {k}</p>{same}</article>{extra}</body>"))
        copied = "copied" if k < 6 else f"other {k}"
        pages.append((100 + k, f"https://b.example/{k}", f"<body><div><article><p>It is {copied}</p></article></div></body>"))
        body = "<p>Thanks</p>" if k == 0 else "<footer><p>Thanks</p></footer>"
        pages.append((200 + k, f"https://c.example/{k}", f"<body><p>Mine {k}</p>{body}</body>"))
    out = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {
        **{k: f"Own {k}" + ("\nReleased under MIT\nTitle" if k < 4 else "") for k in range(12)},
        **{100 + k: "It is " + ("copied" if k < 6 else f"other {k}") for k in range(12)},
        **{200 + k: f"Mine {k}" + ("\nThanks" if k == 0 else "") for k in range(12)},
    }


def test_templates_of_copies_and_of_large_hosts(spark):
    """Copies without article elements keep their text, alike but for their head too, and so does a page of one block; a notice on
    100 pages goes, however large the host."""
    pages = []
    for k in range(15):
        body = "<div><h1>Copied</h1><p>whole</p></div>" if k < 6 else f"<div><h1>Other {k}</h1><p>text {k}</p></div>"
        pages.append((k, f"https://a.example/{k}", f"<head><title>{k % 3}</title></head><body><div>{body}</div></body>"))
        notice = "<div>Closed</div>" if k < 5 else f"<p>Open {k}</p><div>Closed</div>"
        pages.append((100 + k, f"https://b.example/{k}", f"<body>{notice}</body>"))
    for k in range(1200):
        notice = "<div>On request</div>" if k < 108 else ""
        rare = "<div>Rare</div>" if k < 99 else ""
        pages.append((1000 + k, f"https://c.example/{k}", f"<body><p>Text {k}</p>{notice}{rare}</body>"))
    out = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {
        **{k: "Copied\nwhole" if k < 6 else f"Other {k}\ntext {k}" for k in range(15)},
        **{100 + k: "Closed" if k < 5 else f"Open {k}" for k in range(15)},
        **{1000 + k: f"Text {k}" + ("\nRare" if k < 99 else "") for k in range(1200)},
    }


LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def slow_model(texts, order):
    """Modified Kneser-Ney by its definition, on strings; gives probability(context, token)."""
    split = [["<s>"] * (order - 1) + WORD.findall((t or "").translate(LOWER)) + ["</s>"] for t in texts]
    counts = {order: Counter(tuple(s[i : i + order]) for s in split for i in range(len(s) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    vocabulary = {g[-1] for g in counts[1]}

    def discounts(c):
        n = Counter(c.values())
        return ngram_lm.discounts(n[1], n[2], n[3], n[4])

    d = {k: discounts(c) for k, c in counts.items()}
    totals = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            t = totals[k][g[:-1]]
            t[0] += n
            t[min(n, 3)] += 1

    def p(context, token, k=order):
        if k == 0:
            return 1 / (len(vocabulary) + 1)
        v = tuple(context[len(context) - k + 1 :]) if k > 1 else ()
        low = p(context, token, k - 1)
        if v not in totals[k]:
            return low
        t = totals[k][v]
        n = counts[k][v + (token,)]
        return (max(n - d[k][min(n, 3)], 0) + sum(d[k][j] * t[j] for j in (1, 2, 3)) * low) / t[0]

    return p, vocabulary


@pytest.mark.parametrize("order", [2, 3, 4, 5])
def test_kneser_ney(spark, order):
    rng = random.Random(order)
    text = lambda: " ".join(rng.choice(["A", "b", "C", "dé", "É"]) * rng.choice([1, 1, 2]) for _ in range(rng.randrange(12)))
    train = [text() for _ in range(120)] + [None, "", "b b b"]
    test = [text() + " zzz" * (k % 3) for k in range(20)] + [None, "", "b B b", "unseen words only"]
    model = ngram_lm.fit(frame(spark, list(enumerate(train))).repartition(3), order=order)
    out = {r.doc_id: r for r in ngram_lm.score(frame(spark, list(enumerate(test))), model).collect()}
    p, vocabulary = slow_model(train, order)
    unigrams = Counter(w for t in train for w in [*WORD.findall((t or "").translate(LOWER)), "</s>"])
    total = sum(unigrams.values())
    for i, t in enumerate(test):
        tokens = [*WORD.findall((t or "").translate(LOWER)), "</s>"]
        padded = ["<s>"] * (order - 1) + tokens
        want = sum(math.log10(p(padded[k : k + order - 1], w)) for k, w in enumerate(tokens))
        base = sum(math.log10((unigrams[w] + 0.5) / (total + 0.5 * (len(unigrams) + 1))) for w in tokens)
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in unigrams for w in tokens), total)
        assert r.score == pytest.approx(want, rel=1e-9) and r.base_score == pytest.approx(base, rel=1e-9)
    for context in (["<s>"] * (order - 1), ["b"] * (order - 1), ["zzz"] * (order - 1)):
        assert sum(p(context, w) for w in [*vocabulary, "never"]) == pytest.approx(1)
    ngram_lm.delete_model(spark, model)


def test_wide_ids_and_large_counts(spark):
    """Ids of 64 bits, counts beyond a byte, and a vocabulary in many shards give the same model."""
    rng = random.Random(2)
    train = ["a b " * 300, "a b c " * 90] + [" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(40)]
    test = ["a b a b c", "h g z a", "", "b " * 20]
    p, _ = slow_model(train, 3)
    scores = []
    for wide in (False, True):
        model = ngram_lm.fit(frame(spark, list(enumerate(train))).repartition(3), order=3, wide=wide)
        scores.append({r.doc_id: r.score for r in ngram_lm.score(frame(spark, list(enumerate(test))), model).collect()})
        ngram_lm.delete_model(spark, model)
    for i, t in enumerate(test):
        padded = ["<s>", "<s>", *t.split(), "</s>"]
        want = sum(math.log10(p(padded[k : k + 2], w)) for k, w in enumerate(padded[2:]))
        assert scores[0][i] == pytest.approx(want, rel=1e-9) and scores[1][i] == scores[0][i]


def test_counted_rows():
    """Rows of columns that one number holds and of more."""
    rng = np.random.default_rng(3)
    for bits, width in ((20, 3), (20, 5), (31, 4), (3, 2)):
        columns = [rng.integers(0, min(1 << bits, 6), 500).astype(np.uint64) for _ in range(width)]
        found, n = ngram_lm.count_rows(columns, bits)
        want = sorted(Counter(zip(*(c.tolist() for c in columns))).items())
        assert list(zip(*(c.tolist() for c in found))) == [k for k, _ in want] and n.tolist() == [v for _, v in want]


def test_slots_are_dealt_apart(spark):
    for parts in (1, 7, 64):
        df = spark.createDataFrame([(int(x),) for x in ngram_lm.slots(parts)], "slot int").repartition(parts, "slot")
        assert sorted(r[0] for r in df.select(F.spark_partition_id()).collect()) == list(range(parts))


def test_packed_rows():
    for kind in (np.uint32, np.uint64):
        columns = [np.array([5, 1 << 31, 7], kind), np.array([0, 2, 3], kind)]
        back, n = ngram_lm.unpack_rows(ngram_lm.pack_rows(columns, np.array([1, 254, 1 << 40])))
        assert [b.tolist() for b in back] == [c.tolist() for c in columns] and n.tolist() == [1, 254, 1 << 40] and back[0].dtype == kind


def test_model_of_nothing(spark):
    model = ngram_lm.fit(frame(spark, []))
    (row,) = ngram_lm.score(frame(spark, [(1, "a b")]), model).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)
    assert ngram_lm.score(frame(spark, []), model).collect() == []


CHAT = "conv_id long, turn long, role string, text string, t string, turns string, formatted string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], CHAT)


def test_chat_round_trip(spark):
    rng = random.Random(7)
    odd = ["", None, START, END, SEP, "</s>[INST] ok [/INST]", "\\", "\\\\n", "<\\|im_end|>", "a<|", "[", "<<SYS>>", "\n\n", "x" * 50_000, "😀 é", "<|im_body|>", "\\<|", "$1 \\1"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "system", None, "<|im_body|>\n"]), rng.choice(odd)))
    rows += [(None, 0, "user", "no id"), (50, None, "assistant", "null turn"), (50, 1, "user", "then"), (50, 1, "user", "then"), (60, 5, "assistant", "long " * 9)]
    out = format_chat(chats(spark, rows).repartition(5))
    told = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])).alias("loss"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("whole")).collect()
    assert len(told) == len({r[0] for r in rows})
    for r in told:
        own = sorted(((-1 if t is None else t), a or "", b or "") for c, t, a, b in rows if c == r.conv_id)
        assert [(t.role, t.text) for t in r.turns] == [(a, b) for _, a, b in own]
        assert r.loss == [b for _, a, b in own if a == "assistant"] and r.whole == r.formatted
        assert r.formatted.count(START) == sum(k == 0 or own[k][1] != own[k - 1][1] for k in range(len(own)))
        assert "</s>" not in r.formatted and "[INST]" not in r.formatted
    assert format_chat(chats(spark, [])).collect() == []


def test_escape_is_reversible(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("\\<[|/sI>") for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", escape(F.col("x")).alias("e"))
    for r in df.select("x", "e", unescape(F.col("e")).alias("back")).collect():
        assert r.back == r.x and not re.search(r"<\||</|\[I|<s", r.e)


def test_held_out_is_by_crc(spark):
    from tessera.llm.queries import fifth

    ids = [0, 1, 17, 999, None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(fifth()).collect()]
    assert got == [zlib.crc32(b"" if i is None else str(i).encode()) % 5 for i in ids]


def test_temperature_and_network():
    rng = np.random.default_rng(0)
    z = rng.standard_normal(4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-z / 3))).astype(float)
    assert 2.5 < quality._temperature(z, y) < 3.6


def brute_main_text(pages, **limits):
    """Templates by a plain count of each host's subtrees over its different contents."""
    outer_pages, outer_share, outer_many, inner_pages, inner_share = 3, 0.1, 100, 20, 0.6
    by_host = defaultdict(list)
    for i, url, html in pages:
        host = re.match(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
        by_host[host[1].lower() if host else ""].append((i, Page(html or "", **limits), html or ""))
    out = []
    for rows in by_host.values():
        seen, contents = defaultdict(set), {p.content for _, p, _ in rows}
        for _, p, _ in rows:
            for t in p.subtrees:
                seen[t].add(p.content)
        template = set()
        for (told, inner), c in seen.items():
            n, share = len(c), len(c) / len(contents)
            if n >= inner_pages and share >= inner_share if inner else n >= outer_pages and (share >= outer_share or n >= outer_many):
                template.add((told, inner))
        out += [(i, Page(html, template, **limits).text) for i, _, html in rows]
    return Counter(out)


@pytest.mark.parametrize("marks", [True, False])
def test_templates_match_a_plain_count(spark, marks):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rng = random.Random(12)
    blocks = [f"<div><p>Block {k}</p><span>of the site</span></div>" for k in range(6)]
    for k in range(150):
        inner = "".join(rng.sample(["<p>Same line</p>", f"<p>Line {k % 20}</p>", f"<p>Own {k}</p>", "<h2>Part</h2>"], 3))
        shell = "<article>{}</article>" if k % 2 else "<div>{}</div>"
        rows.append((10_000 + k, f"https://h{k % 3}.example/{k}", "<body>" + "".join(rng.sample(blocks, 2)) + shell.format(inner) + rng.choice(blocks) + "</body>"))
    frame_ = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert Counter((r.page_id, r.text) for r in main_text(frame_, marks=marks).collect()) == brute_main_text(rows, marks=marks)


def test_templates_change_pages(spark):
    """Recurrence alone: the pages of these tables have menus of their own each, so few blocks of theirs are of a template."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    alone = {r.page_id: r.text for r in main_text(pages, marks=False).collect()}
    none = {r.page_id: r.text for r in main_text(pages, marks=False, outer_pages=1 << 40).collect()}
    assert 10 <= sum(alone[i] != none[i] for i in none) and all(len(alone[i]) <= len(none[i]) for i in none)


def test_names_within_articles(spark):
    page = """<body><article><h1 class="post-header">Title</h1><div class="related-work">Work</div><p class="skip">Kept</p><figure><pre>code</pre><figcaption>Caption</figcaption></figure>
<div class="ad-slot">Buy</div><div id="comments">Nice</div><form>Mail</form><p class="ad">Ad</p></article><div class="related-posts">More</div></body>"""
    assert Page(page).text == "Title\nWork\nKept\ncode\nCaption"
    copies = [(k, "https://a.example/x", "<body><h1>Head</h1><p>Text</p></body>") for k in range(3)] + [(10 + k, "https://b.example/x", "<body><article><p>One</p><p>Two</p></article></body>") for k in range(25)]
    out = Counter(r.text for r in main_text(spark.createDataFrame(copies, "page_id long, url string, html string")).collect())
    assert out == Counter({"Head\nText": 3, "One\nTwo": 25})
