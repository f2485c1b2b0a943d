"""Main text of pages by template deduction over the pages of a host.

Tokens are elements, by their path from the root (a slot element also by its place among its like), and the texts between tags, by their element. Over a host's different
pages, tokens that occur equally often on every page (equal occurrence vectors, held as sums of hashes of page and count)
form an equivalence class; it is valid if it is on at least half of the pages, and nested in the class of the elements that
its own stand in. The nested classes are the template. Texts of an element's own class that leave nothing else in it are the
site's own words. What other elements hold differs from page to page: these are the slots. The article is in the slot of an article or main element, else in the deepest slot with most of the differing text.

What a template can't tell, as it differs too, are slots of menus, forms, adverts, comments and the like: their elements
are known by tag, role, or names that consist of such words only. A host with fewer than LEAST_PAGES different pages has no
template, and a page without its host's slot is its own.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseframe.llm.base import in_small_batches, joined, tidy, written
from doseframe.llm.urls import url_parts

if TYPE_CHECKING:
    import pandas as pd

# Element names of HTML, and words in names of elements that aren't the article's own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SLOTS = frozenset("article main section div td body".split())
OUTSIDE = frozenset("nav footer aside form script style noscript template iframe svg button select textarea head title menu dialog canvas audio video object xmp noembed noframes input option label".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager header masthead topbar footer bottom comment comments reply replies discussion disqus respond share sharing social related recommended recommendations trending newsletter subscribe "
    "subscription login signin signup search searchform form widget toolbar skip".split()
)
#: Words that say nothing in a name beside those.
PLAIN = frozenset("area bar block box bottom button buttons cell col column container content footer group header holder inner item items js left link links list module outer panel post posts right row section site slot small text top unit view wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Different pages that a template needs.
LEAST_PAGES = 3
ROOT = 0


def boilerplate(name: str) -> bool:
    """Whether a class or id names a part outside articles: `cookie-notice` and `relatedPosts` do, `related-work` doesn't."""
    words = {w.lower() for w in WORD.findall(name)}
    return bool(words & NAMES) and words <= NAMES | PLAIN


def outside(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element is no part of an article: by its tag, role, or the names of its class and id."""
    if tag in OUTSIDE or tag == "header" and not in_article or "hidden" in attributes:
        return True
    if tag in ("html", "body", "article", "main", "h1", "b", "i", "em", "strong", "a"):
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    return any(map(boilerplate, names)) or attributes.get("role", "").lower() in ROLES


def token_of(*parts: object) -> int:
    """63 bits for an element in its parent, or a text in its element."""
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) >> 1


class Element:
    """An element token of a page: how often it occurs, its text (with that of elements inside, and its own, not in an inner
    slot element), tag, depth and parent."""

    __slots__ = ("n", "chars", "own", "tag", "depth", "parent")

    def __init__(self, tag: str, depth: int, parent: int):
        self.n, self.chars, self.own, self.tag, self.depth, self.parent = 0, 0, 0, tag, depth, parent


class Page:
    """blocks of a page: (tokens of the slot elements around it, whether it's outside, text); elements: by their tokens."""

    def __init__(self, source: str):
        self.blocks: list[tuple[tuple[int, ...], bool, str]] = []
        self.elements: dict[int, Element] = {}
        self.stack: list[tuple[str, int, bool, dict[str, int]]] = [("", ROOT, False, {})]  # tag, token, outside, children by name
        self.articles = 0
        self.text: list[str] = []
        at, raw = 0, ""
        for m in TOKEN.finditer(source):
            if m.start() < at:
                continue
            if raw:
                if not (m[1] and m[2].lower() == raw):
                    continue
                raw, at = "", m.start()  # what a raw element holds is no text
            self.add(source[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self.close(tag)
                else:
                    self.open(tag, m[3] or "")
                    if tag in RAW:
                        raw = tag
        if not raw:
            self.add(source[at:])
        self.flush()

    def add(self, text: str) -> None:
        if text:
            self.text.append(text)

    def flush(self) -> None:
        if text := " ".join(entities.unescape("".join(self.text)).split()):
            slots, gone = tuple(x[1] for x in self.stack if x[0] in SLOTS), self.stack[-1][2]
            self.blocks.append((slots, gone, text))
            if not gone:
                for p in slots:
                    self.elements[p].chars += len(text)
                if slots:
                    self.elements[slots[-1]].own += len(text)
        self.text.clear()

    def open(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            if tag in BLOCK:
                self.flush()
            return
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(rest)} if rest.strip() else {}
        if tag in ("td", "th"):
            self.text.append(" ")
        gone = self.stack[-1][2] or outside(tag, attributes, self.articles > 0)
        if tag in BLOCK or gone != self.stack[-1][2]:
            self.flush()
        if tag in BLOCK:
            self.close_open_paragraph(tag)
            gone = self.stack[-1][2] or outside(tag, attributes, self.articles > 0)
        _, parent, _, children = self.stack[-1]
        name = ".".join([tag, *sorted(set(attributes.get("class", "").split()))])
        children[name] = children.get(name, 0) + 1
        path = token_of(parent, name, children[name] if tag in SLOTS else "")
        if path not in self.elements:
            self.elements[path] = Element(tag, len(self.stack), parent)
        self.elements[path].n += 1
        self.articles += tag == "article"
        self.stack.append((tag, path, gone, {}))

    def cut(self, depth: int) -> None:
        self.articles -= sum(x[0] == "article" for x in self.stack[depth:])
        del self.stack[depth:]

    def close_open_paragraph(self, tag: str) -> None:
        """A block ends an open p, an li an open li, and with them what is open inside."""
        ends = {"p"} | ({tag} if tag in ("li", "dt", "dd", "tr", "option") else set())
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in ends:
                self.cut(i)
                return
            if self.stack[i][0] in BLOCK:
                return

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                if self.stack[i][2] != self.stack[i - 1][2]:
                    self.flush()
                self.cut(i)
                return

    def texts(self) -> dict[int, tuple[int, int, int]]:
        """The text tokens: slot element, occurrences, characters of one."""
        found: dict[int, tuple[int, int, int]] = {}
        for slots, gone, text in self.blocks:
            if not gone:
                home = slots[-1] if slots else ROOT
                token = token_of(home, "", text)
                found[token] = (home, found.get(token, (0, 0))[1] + 1, len(text))
        return found


def article_slot(slots: list[tuple[int, str, int, float]]) -> int | None:
    """Of (token, tag, depth, differing characters) the article's: an article or main element with text, the longest; else
    the deepest that holds 60 % of the text; of equal ones the smaller token."""
    slots = [s for s in slots if s[3] > 0]
    for tag in ("article", "main"):
        if named := [s for s in slots if s[1] == tag]:
            return min(named, key=lambda s: (-s[3], s[0]))[0]
    most = max((s[3] for s in slots), default=0)
    return min((s for s in slots if s[3] >= 0.6 * most), key=lambda s: (-s[2], -s[3], s[0]), default=(None,))[0]


def main_text(page: Page, slot: int | None, fixed: frozenset[int] = frozenset()) -> str:
    """The page's text in the slot, where it has that with text, else in the slot of its own template; without the site's
    own words, the text tokens `fixed`. In an article or main element that a text stands on all pages isn't enough: the
    heading `Summary` does too. There it goes only if the page has it outside as well."""
    own = page.elements.get(slot) if slot is not None else None
    if own is None or not own.chars:
        slot = article_slot([(t, e.tag, e.depth, e.chars) for t, e in page.elements.items() if e.tag in SLOTS and e.n == 1])
    kept = [(slots, text) for slots, gone, text in page.blocks if not gone and (slot is None or slot in slots)]
    if fixed and slot in page.elements and page.elements[slot].tag in ("article", "main"):
        outside_too = {text for slots, _, text in page.blocks if slot not in slots}
        return "\n".join(text for slots, text in kept if text not in outside_too or token_of(slots[-1] if slots else ROOT, "", text) not in fixed)
    return "\n".join(text for slots, text in kept if not fixed or token_of(slots[-1] if slots else ROOT, "", text) not in fixed)


TOKENS = {
    "host": pa.string(), "page_key": pa.int64(), "token": pa.int64(), "parent": pa.int64(), "tag": pa.string(), "depth": pa.int32(), "n": pa.int64(), "chars": pa.int64(), "own": pa.int64(),
}


def template_tokens(pages: DataFrame) -> DataFrame:
    """The tokens of each page: its elements, and with an empty tag the texts in its slot elements (parent)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 100):
                rows: list[tuple] = []
                for host, key, source in zip(*(whole.column(i).slice(k, 100).to_pylist() for i in range(3)), strict=True):
                    page = Page(source or "")
                    rows += [(host, key, t, e.parent, e.tag, e.depth, e.n, e.chars, e.own) for t, e in page.elements.items()]
                    rows += [(host, key, t, home, "", 0, n, n * size, 0) for t, (home, n, size) in page.texts().items()]
                columns = zip(*rows, strict=True) if rows else ([] for _ in TOKENS)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, TOKENS.values(), strict=True)], names=list(TOKENS))

    return pages.select("host", "page_key", "html").mapInArrow(tidy(run), "host string, page_key long, token long, parent long, tag string, depth int, n long, chars long, own long")


def nested(tokens: list[dict]) -> dict[int, int]:
    """The class of each token (token, parent, tag, depth; kind: the number of its occurrence vector).

    A token is of its element's class if it has that one's vector; else it is of a class nested in it, with the others of
    its vector there. Elements whose parent isn't among the tokens are of the outermost classes."""
    kind, found = {t["token"]: t["kind"] for t in tokens}, {ROOT: ROOT}
    for t in sorted(tokens, key=lambda t: (not t["tag"], t["depth"])):
        outer = found.get(t["parent"], ROOT)
        found[t["token"]] = outer if kind.get(t["parent"]) == t["kind"] else token_of(outer, t["kind"])
    return found


def template(tokens: list[dict]) -> tuple[int | None, list[int]]:
    """The article's slot, and the text tokens that fill their element wherever it stands: they are of its class, and it holds
    nothing else. Every other element with text is a slot."""
    classes, parent = nested(tokens), {t["token"]: t["parent"] for t in tokens if t["tag"]}
    told = [t for t in tokens if not t["tag"] and t["parent"] in parent and classes[t["token"]] == classes[t["parent"]]]
    texts: dict[int, int] = {}
    for t in told:
        texts[t["parent"]] = texts.get(t["parent"], 0) + t["chars"]
    full = {t["token"]: t["own"] for t in tokens if t["tag"] and 0 < t["own"] == texts.get(t["token"])}
    gone: dict[int, int] = {}
    for at, chars in full.items():  # what is fixed doesn't count for the elements around it
        while at in parent:
            gone[at] = gone.get(at, 0) + chars
            at = parent[at]
    slots = [(t["token"], t["tag"], t["depth"], t["chars"] - gone.get(t["token"], 0)) for t in tokens if t["tag"] in SLOTS and t["total"] == t["pages"]]
    return article_slot(slots), sorted(t["token"] for t in told if t["parent"] in full)


def templates(pages: DataFrame) -> DataFrame:
    """(host, slot, fixed): the article's slot in the template of each host, and the text tokens that are the site's own words."""
    seen = F.xxhash64("page_key", "n")
    vector = template_tokens(pages.dropDuplicates(["host", "page_key"])).groupBy("host", "token").agg(
        F.first("parent").alias("parent"), F.first("tag").alias("tag"), F.first("depth").alias("depth"), F.count("*").alias("pages"), F.sum("n").alias("total"), F.sum("chars").alias("chars"), F.sum("own").alias("own"),
        F.sum(seen.bitwiseAND(0x7FFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned(seen, 33)).alias("high"),
    )
    vector = written(vector, "html-vectors")
    sizes = written(pages.groupBy("host").agg(F.count_distinct("page_key").alias("of")).where(F.col("of") >= LEAST_PAGES), "html-hosts")
    # of tokens on at least half of a host's pages no host has more than twice its pages' mean number of tokens
    often = joined(vector.where(F.col("pages") > 1), sizes, ["host"], "inner", "html-hosts").where((2 * F.col("pages") >= F.col("of")) & (F.col("pages") >= LEAST_PAGES))
    kind = F.xxhash64("pages", "total", "low", "high")
    grouped = often.groupBy("host").agg(F.collect_list(F.struct("token", "parent", "tag", "depth", "chars", "own", "pages", "total", kind.alias("kind"))).alias("tokens"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd  # other workers do without its memory

        for pdf in batches:
            found = [template(list(x)) for x in pdf["tokens"]]
            yield pd.DataFrame({"host": pdf["host"], "slot": pd.array([s for s, _ in found], "Int64"), "fixed": [f for _, f in found]})

    return grouped.mapInPandas(choose, "host string, slot long, fixed array<long>")


def main_texts(pages: DataFrame) -> DataFrame:
    """Every row of pages (page_id, url, html) with the whole main text of its html: page_id, url, slot, text.

    Blocks in page order, one a line; white space in a block is one space; character references are decoded. A null or
    empty html, and one without such text, give ''. A null url counts as a host of its own. Cut-off and unclosed markup is
    read as far as it goes. Repeated rows are extracted each, and count once for the template, as do equal pages; an empty
    table gives an empty one; other columns are not looked at."""
    host = url_parts(F.coalesce("url", F.lit("")))[0]
    rows = in_small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"), F.xxhash64("html").alias("page_key"))
    slots = written(templates(rows), "html-templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 100):
                part = whole.slice(k, 100)
                made = [main_text(Page(h or ""), s, frozenset(f or ())) for h, s, f in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(made, pa.string())], names=["page_id", "url", "slot", "text"])

    both = joined(rows, slots, ["host"], "left", "html-templates").select("page_id", "url", "html", "slot", "fixed")
    return both.mapInArrow(tidy(run), "page_id long, url string, slot long, text string")
