"""HTML main text with site template removal (operator 7).

Each page is parsed to element subtrees, which are hashed bottom up. Spark counts on how many pages of a host a subtree
occurs, and subtrees that recur across many of them are deleted: outside an article or main element from
``outer_pages`` pages on, if these are ``outer_share`` of the host's pages or ``outer_many``, within one from ``inner_pages``
and ``inner_share`` on, so that copies of an article are not taken for a template. Pages of a host with the same main text
count as one page, and a subtree that holds all of a page's main text is no template on that page. A subtree is deleted
only on the side, outside or within, where it recurs, and what stands in elements that go anyway is not counted. What a page marks itself as a menu, header, footer, sidebar,
notice, advert, form, script, style or reader comments goes too. If text stands in article elements, that is the main text,
else that in main elements, else that of the body. An article that is a card or a comment is none: within a main element or another article it goes, elsewhere it is text of the
body. A form that holds an article or main element goes round the page and is not the page's form.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import Kept, few_files

# Element names and words in class, id and role attributes.
UNSEEN = frozenset("head button select option datalist svg math canvas object audio video template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
SKIPPED = frozenset("head nav aside form button select option datalist dialog svg math canvas object audio video template menu".split()) | RAW
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("table ul ol dl select html body article".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adbox|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert|"
    r"popup|modal|overlay|newsletter|subscribe|subscription|signup|login|sidebar|menu|menus|nav|navbar|navigation|breadcrumb|breadcrumbs|pagination|pager|"
    r"header|masthead|footer|comment|comments|disqus|replies|share|sharing|social|related|recommended|widget|widgets|toolbar|skip)(?:$|[\s_-])"
)
WITHIN = re.compile(
    r"(?:^|\s)(?:(?:ads?|adbox|advert|adverts|advertisement|advertising|sponsor|sponsored|promo)(?:[-_][\w-]*)?|"
    r"comments?(?:[-_][\w-]*)?|disqus|replies|share|sharing|social|newsletter|subscribe)(?=\s|$)"
)
CARD = re.compile(r"(?:^|[\s_-])(?:card|cards|teaser|related|recommended|preview|comment|comments|reply|replies)(?:$|[\s_-])")
WEAK = re.compile(r"(?:^|\s)(?:(?:page|post|entry|article|content|story)-header|(?:content|article|post|entry|story)\s[\w\s-]*|[\w\s-]*\s(?:content|article|post|entry|story))(?=\s|$)")
DOUBTFUL = re.compile(r"(?:^|(?<=[\s_-]))(?:header|related|notice|widget|promo|skip)(?=$|[\s_-])")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

SALTS = 16

ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
EMPTY_COMMENT, COMMENT_END = re.compile("-?>"), re.compile("--!?>")
FORM_END = re.compile(r"</form", re.I)
HOLDS = re.compile(r"""<(?:article|main)[\s/>]|\srole\s*=\s*["']?main\b""", re.I)
REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")


def _digest(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


class _Element:
    __slots__ = ("name", "parts", "skips", "region", "at")

    def __init__(self, name: str, skips: bool, region: int, at: int):
        self.name, self.skips, self.region, self.at = name, skips, region, at
        self.parts: list[str] = []


class Page:
    """``subtrees``: signed 64-bit hashes of the block elements, within an article or main element or not;
    ``text``: the main text, with the subtrees in ``template``, pairs as in ``subtrees``, deleted; ``content``: a hash of the
    main text with nothing deleted. What stands in a skipped element is no subtree, nor is one that holds all of the main text."""

    def __init__(self, source: str, template: frozenset[tuple[int, bool]] | set[tuple[int, bool]] = frozenset(), hashing: bool = True, marks: bool = True):
        self.subtrees: set[tuple[int, bool]] = set()
        self.hashing, self.marks = hashing, marks
        self.blocks: list[tuple[int, str]] = []
        self.spans: list[tuple[int, bool, int, int]] = []
        self.line: list[str] = []
        self.skipping = 0
        self.stack = [_Element("", False, 0, 0)]
        self._parse(source)
        while len(self.stack) > 1:
            self._close()
        self._flush()
        region = max((r for r, _ in self.blocks), default=0)
        main = [i for i, (r, _) in enumerate(self.blocks) if r >= region]
        self.content = _digest("\n".join(self.blocks[i][1] for i in main))
        gone: set[int] = set()
        for told, inner, begin, end in self.spans:
            if main and begin <= main[0] and end > main[-1]:
                continue  # all of the main text
            self.subtrees.add((told, inner))
            if (told, inner) in template:
                # what it holds of an article goes by the thresholds of its own subtrees
                gone.update(i for i in range(begin, end) if inner or not self.blocks[i][0])
        if gone.issuperset(main):
            gone = set()  # a page of templates alone keeps its text
        self.text = "\n".join(self.blocks[i][1] for i in main if i not in gone)

    def _flush(self) -> None:
        if self.line:
            if text := " ".join("".join(self.line).split()):
                self.blocks.append((self.stack[-1].region, text))
            self.line = []

    def _open(self, name: str, attributes: str, round_page: bool = False) -> None:
        stack = self.stack
        if name in CLOSES_P:
            self._end("p", CLOSES_P - {"p"})
        if name in SIBLINGS:
            for other in SIBLINGS[name]:
                self._end(other, SCOPES)
        region = stack[-1].region
        if not self.marks:
            skips = name in UNSEEN or name in RAW
        elif name == "body" or name == "html":
            skips = False
        else:
            region, skips = self._marked("div" if round_page else name, attributes, region)
        if name not in INLINE and not self.skipping:  # a block within what goes parts no line
            self._flush()
        stack.append(_Element(name, skips, region, len(self.blocks)))
        self.skipping += skips

    @staticmethod
    def _marked(name: str, attributes: str, region: int) -> tuple[int, bool]:
        """The region of an element in ``region``, and whether it goes. Within an article or main element class and id tell only adverts,
        comments and what asks the reader to share or subscribe, and only by a whole word. Elsewhere doubtful words do not count for what also calls itself content."""
        within = region > 0
        told = [(kind.lower(), (a or b or c).lower()) for kind, a, b, c in ATTRIBUTE.findall(attributes)] if attributes and name != "main" else []
        card = name == "article" and any(kind in ("class", "id") and CARD.search(value) for kind, value in told)
        region = region if card else 2 if name == "article" else max(region, 1) if name == "main" else region
        skips = name in SKIPPED or (name == "footer") or (name == "header" and region == 0) or (card and within)
        for kind, value in told:
            if kind == "role":
                region = max(region, 1) if value == "main" else region
                skips |= value in ROLES
            elif kind not in ("class", "id"):
                skips |= kind == "hidden" or value == "true"
            elif within:
                skips |= WITHIN.search(value) is not None
            else:
                skips |= MARKED.search(DOUBTFUL.sub("", value) if WEAK.search(value) else value) is not None
        return region, skips

    def _round_page(self, source: str, at: int) -> bool:
        """Whether the form that opens before ``at`` holds an article or main element. Both places only move on, so a page is searched once."""
        if self.next_end < at:
            found = FORM_END.search(source, at)
            self.next_end = found.start() if found else len(source)
        if self.next_held < at:
            found = HOLDS.search(source, at)
            self.next_held = found.start() if found else len(source) + 1
        return self.next_held < self.next_end

    def _close(self) -> None:
        element = self.stack[-1]
        block = element.name not in INLINE
        if block and not self.skipping:
            self._flush()
        self.stack.pop()
        shown = not self.skipping
        self.skipping -= element.skips
        if not self.hashing:
            return
        told = _digest(element.name + "\x00" + "\x00".join(element.parts))
        if element.parts:
            self.stack[-1].parts.append(f"{told:016x}")
        if block and shown and element.parts and element.name not in ("html", "body", "article", "main"):
            signed = told - (1 << 64) if told >> 63 else told
            self.spans.append((signed, element.region > 0, element.at, len(self.blocks)))

    def _end(self, name: str, stops: frozenset[str]) -> None:
        """Closes the nearest open element of that name, unless one of ``stops`` stands before it."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == name:
                while len(self.stack) > i:
                    self._close()
                return
            if self.stack[i].name in stops:
                return

    def _text(self, raw: str) -> None:
        if not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if self.hashing and (short := " ".join(text.split())):
            self.stack[-1].parts.append(short)
        if not self.skipping:
            self.line.append(text)

    def _parse(self, source: str) -> None:
        self.next_end = self.next_held = -1
        at, n, plain = 0, len(source), False
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                self._text(source[at:])
                return
            if lt + 1 < n and source[lt + 1] in "!?":
                self._text(source[at:lt])
                if source.startswith("<!--", lt):
                    empty = EMPTY_COMMENT.match(source, lt + 4)
                    end = None if empty else COMMENT_END.search(source, lt + 4)
                    at = empty.end() if empty else end.end() if end else n
                else:
                    end = source.find(">", lt)
                    at = n if end < 0 else end + 1
                continue
            closing = source.startswith("</", lt)
            named = NAME.match(source, lt + 1 + closing)
            if not named:
                self._text(source[at : lt + 1])
                at = lt + 1
                continue
            self._text(source[at:lt])
            name = named[0].lower()
            rest = None if plain else REST.match(source, named.end())
            if rest:
                end = rest.end()
            else:
                plain = True  # an open quote: from here on a tag ends at the next >
                end = source.find(">", named.end()) + 1
                if not end:
                    return
            at = end
            if closing:
                if name == "br":
                    self._space()
                else:
                    self._end(name, frozenset())
                continue
            if name in VOID:
                if name == "br":
                    self._space()
                elif name == "hr":
                    self._end("p", CLOSES_P - {"p"})
                    self._flush()
                continue
            self._open(name, source[named.end() : end - 1], name == "form" and self._round_page(source, at))
            if name in RAW:
                closer = re.compile(f"</{name}", re.I).search(source, at)
                stop = closer.start() if closer else n
                if self.hashing and (short := " ".join(source[at:stop].split())):
                    self.stack[-1].parts.append(short)
                at = stop
                if not closer:
                    return

    def _space(self) -> None:
        if not self.skipping:
            self.line.append(" ")


def _subtrees(marks: bool):
    def run(batches):
        for batch in batches:
            yield from _subtrees_of(batch, marks)

    return run


def _subtrees_of(batch: pa.RecordBatch, marks: bool):
    keys, hosts = batch.column("k1").to_pylist(), batch.column("host").to_pylist()
    seconds = batch.column("k2").to_pylist()
    for begin in range(0, batch.num_rows, 500):
        cols: list[list] = [[], [], [], [], [], []]
        for k1, k2, host, source in zip(keys[begin : begin + 500], seconds[begin : begin + 500], hosts[begin : begin + 500], batch.column("html").slice(begin, 500).to_pylist()):
            page = Page(source or "", marks=marks)
            content = page.content - (1 << 64) if page.content >> 63 else page.content
            for told, inner in (*page.subtrees, (None, None)):  # the last stands for the page itself
                for c, v in zip(cols, (k1, k2, host, content, told, inner)):
                    c.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.bool_())],
            names=["k1", "k2", "host", "content", "subtree", "inner"],
        )


def _extract(marks: bool):
    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                texts = []
                for source, gone in zip(part.column("html").to_pylist(), part.column("gone").to_pylist()):
                    template = frozenset((x["subtree"], x["inner"]) for x in gone or ())
                    texts.append(Page(source or "", template, hashing=bool(gone), marks=marks).text)
                keep = [(c, part.column(i)) for i, c in enumerate(part.schema.names) if c not in ("html", "gone")]
                yield pa.RecordBatch.from_arrays([*(x for _, x in keep), pa.array(texts, pa.string())], names=[*(c for c, _ in keep), "text"])

    return run


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    outer_pages: int = 3, outer_share: float = 0.1, inner_pages: int = 20, inner_share: float = 0.6, outer_many: int = 100,
    marks: bool = True,
) -> DataFrame:
    """(page_id, url, text) for every row: character references decoded, white space in a block one space, blocks in
    page order joined by one newline.

    Defined cases: null html is empty and gives an empty text; a page with a null url belongs to the host ""; repeated
    rows are pages of their own; unclosed elements end with their parent, and broken markup is read as far as it goes; an
    empty table gives an empty result; extra columns are not read. A very long page is parsed whole, by one task; nesting of any depth is
    read without recursion.

    Without ``marks`` only recurring subtrees and what browsers do not show are deleted, and the whole body counts as main text; that is the
    method alone.
    """
    spark = pages.sparkSession
    kept = Kept(spark)
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col), F.col(url_col), host.alias("host"), F.col(html_col).alias("html"))
    rows = rows.withColumn("k1", F.xxhash64("host", "html")).withColumn("k2", F.xxhash64(F.lit(0x5EED), "html"))
    found = kept.put(rows.select("k1", "k2", "host", "html").mapInArrow(_subtrees(marks), "k1 long, k2 long, host string, content long, subtree long, inner boolean"), "subtrees", whole=True)
    total = found.where("subtree is null").groupBy("host").agg(F.countDistinct("content").alias("of"))
    often = lambda least, share, many: (F.col("n") >= least) & ((F.col("n") >= share * F.col("of")) | (F.col("n") >= many))
    enough = F.when(F.col("inner"), often(inner_pages, inner_share, float("inf"))).otherwise(often(outer_pages, outer_share, outer_many))
    # rows are no fewer than distinct contents: what too few rows have need not be counted again
    keys = ["host", "subtree", "inner"]
    some = found.where("subtree is not null").groupBy(*keys).agg(F.count("*").alias("n")).join(total, "host").where(enough).select(*keys)
    # a subtree that stands on very many pages of a host meets its one row of the smaller side in SALTS tasks
    spread = lambda t: t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = found.withColumn("salt", F.pmod("k2", F.lit(SALTS)).cast("int"))
    met = kept.put(salted.join(spread(some), [*keys, "salt"]).select("k1", "k2", "content", *keys, "salt"), "met")
    template = kept.put(met.groupBy(*keys).agg(F.countDistinct("content").alias("n")).join(total, "host").where(enough).select(*keys), "template")
    gone = met.join(spread(template), [*keys, "salt"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("subtree", "inner")).alias("gone"))
    told = kept.put(gone, "gone")
    kept.drop(found, met, template)
    kinds = dict(pages.dtypes)
    out = rows.join(told, ["k1", "k2"], "left").select(id_col, url_col, "html", "gone")
    return few_files(out.mapInArrow(_extract(marks), f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string"))
