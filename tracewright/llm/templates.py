"""Main texts of web pages, by templates deduced from the pages of a host.

Tokens of a page are its containers, each known by its path of tags, classes and ids, and its blocks of text, each known by
its path and words. A token's occurrence vector (how often each page of its host has it) is kept as sums of random
numbers of pages, so vectors are compared without being gathered, and partial sums leave each task. Tokens of one host with equal
vectors are an equivalence class. Containers that enough of the host's pages have are its template, nested by their paths; each is a slot.
One slot is the article: by what its tags say (article, main, names such as content), else by descending into the
slot that holds most of the text that varies and is no link. Blocks in it whose vector is the slot's own stand on each of these pages
and belong to the template, not to the article: if they're less than half of the text they are left out, as are
elements that are by tag, name or role a menu, header, footer, sidebar, notice, advert, form or reader comments. A page without the slot of its host is a
template of its own. Pages are read twice; only templates (a few numbers a host) are joined to them.

Defined results: a null html, or one without an article, gives an empty text; pages with a null url or none with a host are a host
of their own; repeated rows each give a row; markup that is cut off, unclosed or wrongly nested is read as far as it
goes; a text without markup is a block; other columns are left out, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import functools
import html as references
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, released, small_batches, staged

#: Share of a host's pages that have a template's containers.
SUPPORT = 0.5
#: Pages from which on repeated blocks are the template's: in an article that is marked as such, and in one that is deduced.
MARKED_PAGES, DEDUCED_PAGES = 8, 3
#: Share of links in a slot from which on it is a menu, where nothing marks the article.
LINKS = 0.7
#: Hosts and numbers of templates that are broadcast; beyond them templates are joined by host and one of SALTS.
MOST_HOSTS, MOST_NUMBERS, SALTS = 1 << 16, 1 << 21, 64

# What HTML and common names of classes say.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("html head body div section article main nav header footer aside form ul ol dl menu table details dialog fieldset figure center blockquote noscript template select svg object iframe".split())
BLOCKS = CONTAINERS | set("address caption dd dt figcaption h1 h2 h3 h4 h5 h6 hgroup hr legend li optgroup option p pre summary tbody td tfoot th thead title tr".split())
LEFT_OUT = set("head nav footer aside noscript template select option optgroup datalist button textarea menu dialog svg object iframe canvas audio video map title".split())
ROLES_OUT = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES_OUT = set(
    """ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promotion promotions banner banners nav navbar
    navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter
    subscribe subscription signup signin login share sharing social related recommended recommendations comment comments disqus replies reply respond widget
    widgets pagination pager copyright legal disclaimer search skip""".split()
)
HEADER_NAMES = set("header masthead topbar toolbar".split())
ARTICLE_NAMES = set("article articlebody content entry main maincontent post story".split())
NEGATING = set("has no with without is not".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|xmp|noembed|noframes)\b[^>]*+>.*?(?:</\1\b[^>]*+>|\Z)"""
    r"""|</?[a-zA-Z](?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: Kinds of elements: text goes on, HEADER is left out outside of articles only, FORM unless it holds most of the page.
PLAIN, HEADER, FORM, OUT = 0, 1, 2, 3

TOKENS = "host string, token long, parent long, element boolean, mark int, kind int, pages long, total long, f1 long, f2 long, f3 long, text long, link long"
TEMPLATES = "host string, slots array<long>, texts array<long>, menus array<long>"
EXTRACTED = "page_id long, url string, text string, n_chars long"
ROOT = 0


@functools.lru_cache(maxsize=1 << 12)
def element(raw: str) -> tuple[str, str, int, int]:
    """Tag, signature, kind and mark (3 article, 2 main, 1 a name of an article, 0 none) of a start tag."""
    tag = re.match(r"<([a-zA-Z][^\s/>]*)", raw)[1].lower()
    named: dict[str, str] = {}
    if "=" in raw:
        for key, *values in _NAMED.findall(raw):
            named.setdefault(key.lower(), "".join(values))
    words, before = set(), ""
    for word in _WORDS.findall(f"{named.get('class', '')} {named.get('id', '')}"):
        word = word.lower()
        if before not in NEGATING:
            words.add(word)
        before = word
    role = named.get("role", "").lower()
    mark = 3 if tag == "article" or named.get("itemprop", "").lower() == "articlebody" else 2 if tag == "main" or role == "main" else 1 if words & ARTICLE_NAMES and tag in CONTAINERS else 0
    if tag in LEFT_OUT or role in ROLES_OUT:
        kind = OUT
    elif tag in ("html", "body", "main"):
        kind = PLAIN
    elif tag == "article":
        kind = OUT if words & {"comment", "comments", "reply"} else PLAIN
    elif words & NAMES_OUT:
        kind = OUT
    else:
        kind = FORM if tag == "form" else HEADER if tag == "header" or words & HEADER_NAMES else PLAIN
    if kind in (OUT, HEADER):
        mark = 0
    signature = re.sub(r"\d{3,}", "0", f"{tag}.{named.get('class', '')}#{named.get('id', '')}")
    return tag, signature, kind, mark


@functools.lru_cache(maxsize=1 << 12)
def below(parent: int, signature: str) -> int:
    """The token of a container in another: a signed 64-bit hash, never ROOT."""
    return xxhash.xxh3_64_intdigest(f"{parent} {signature}") - (1 << 63) or 1


class Page:
    """Containers (token, their parent's place, kind, mark) and blocks (its container's place, text, letters in links) of an html, in order."""

    def __init__(self, html: str):
        self.nodes: list[tuple[int, int, int, int]] = [(ROOT, -1, PLAIN, 0)]
        self.blocks: list[tuple[int, str, int]] = []
        self._open: list[tuple[str, int, bool, bool]] = []  # tag, the place of the container in it, whether it is a block, whether it is left out within a block
        self._node, self._links, self._muted = 0, 0, 0
        self._parts: list[str] = []
        self._linked = 0
        end = 0
        for found in _MARKUP.finditer(html):
            if found.start() > end:
                self._text(html[end : found.start()])
            end = found.end()
            raw = found[0]
            if raw[1] in "!?" or found[1]:
                continue
            if raw[1] == "/":
                self._end_tag(re.match(r"</([a-zA-Z][^\s/>]*)", raw)[1].lower())
            else:
                self._start_tag(raw)
        self._text(html[end:])
        self._flush()

    def _text(self, piece: str) -> None:
        if not self._muted:
            self._parts.append(piece)
            if self._links:
                self._linked += len(piece)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(references.unescape("".join(self._parts)).split())
            if text:
                self.blocks.append((self._node, text, min(self._linked, len(text))))
            self._parts.clear()
            self._linked = 0

    def _close(self, at: int) -> None:
        closed = self._open[at:]
        if any(block for _, _, block, _ in closed):
            self._flush()
        self._links -= sum(tag == "a" for tag, _, _, _ in closed)
        self._muted -= sum(muted for _, _, _, muted in closed)
        del self._open[at:]
        self._node = self._open[-1][1] if self._open else 0

    def _end_tag(self, tag: str) -> None:
        block = tag in BLOCKS
        if tag == "br":
            self._text(" ")
        for at in range(len(self._open) - 1, -1, -1):
            if self._open[at][0] == tag:
                self._close(at)
                break
            if not block and self._open[at][2]:  # what stands within a block does not close blocks
                break
        if block:
            self._flush()

    def _start_tag(self, raw: str) -> None:
        tag, signature, kind, mark = element(raw)
        if tag == "br":
            return self._text(" ")
        block = tag in BLOCKS
        if block:
            self._flush()
            for at in range(len(self._open) - 1, -1, -1):
                own = self._open[at][0]
                if own == "p" or own in CLOSED_BY.get(tag, ()):
                    self._close(at)
                    break
                if self._open[at][2]:
                    break
        if tag in VOID or raw.endswith("/>") and tag in ("svg", "iframe", "object", "video", "audio", "canvas"):
            return None
        muted = not block and kind == OUT
        if block and (tag in CONTAINERS or kind == OUT):
            self.nodes.append((below(self.nodes[self._node][0], signature), self._node, kind, mark))
            self._node = len(self.nodes) - 1
        self._links += tag == "a"
        self._muted += muted
        self._open.append((tag, self._node, block, muted))
        return None


def text_token(container: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{container}".encode() + b"\0" + text.encode()) - (1 << 63)


class Counts:
    """Sums of tokens' occurrence vectors over pages."""

    def __init__(self):
        self.rows: dict[tuple[str, int], list[int]] = {}

    def add(self, host: str, number: int, page: Page) -> None:
        own: dict[int, list[int]] = {}
        for token, parent, kind, mark in page.nodes:
            row = own.setdefault(token, [page.nodes[parent][0] if parent >= 0 else ROOT, True, mark, kind, 0, 0, 0])
            row[4] += 1
        for at, text, linked in page.blocks:
            container = page.nodes[at][0]
            own[container][5] += len(text) - linked
            own[container][6] += linked
            row = own.setdefault(text_token(container, text), [container, False, 0, PLAIN, 0, len(text), 0])
            row[4] += 1
        low, mid, high = number & 0xFFFFFF, number >> 20 & 0xFFFFFF, number >> 40  # 24 bits each: sums over 5e11 occurrences are longs
        for token, (parent, is_element, mark, kind, n, text, link) in own.items():
            row = self.rows.setdefault((host, token), [parent, is_element, mark, kind, 0, 0, 0, 0, 0, 0, 0])
            row[4] += 1
            row[5] += n
            row[6] += n * low
            row[7] += n * mid
            row[8] += n * high
            row[9] += text
            row[10] += link

    def batch(self) -> pa.RecordBatch:
        types = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), *[pa.int64()] * 7)
        hosts, tokens = zip(*self.rows)
        columns = [pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*self.rows.values()), types))]
        self.rows = {}
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TOKENS.split(", ")])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """TOKENS of pages (host, number, html), summed within a batch."""
    for batch in batches:
        counts = Counts()
        for host, number, html in zip(*(batch.column(c) for c in ("host", "number", "html"))):
            counts.add(host.as_py(), number.as_py() & ((1 << 64) - 1), Page(html.as_py() or ""))
            if len(counts.rows) > 1 << 14:
                yield counts.batch()
        if counts.rows:
            yield counts.batch()
        released()


def decided(tokens: list[dict]) -> dict[str, list[int]]:
    """Slots of the article, blocks of the template in them, and menus in them, from the template's tokens (rows of TOKENS; the root is among them)."""
    nodes = {t["token"]: t for t in tokens if t["element"]}
    pages = nodes[ROOT]["pages"]
    parents: dict[int, list[int]] = {}
    for token, t in nodes.items():
        if token != ROOT:
            parents.setdefault(t["parent"], []).append(token)
    # containers from the root on whose ancestors are all in the template and none left out, outermost first
    alive, at = [ROOT], 0
    while at < len(alive):
        alive += [c for c in parents.get(alive[at], ()) if nodes[c]["kind"] < OUT]
        at += 1
    vector = lambda t: (t["pages"], t["total"], t["f1"], t["f2"], t["f3"])
    repeated: dict[int, int] = {}  # letters of blocks that stand once on each page of their container
    for t in tokens:
        if not t["element"] and t["total"] == t["pages"] and t["parent"] in nodes and vector(t) == vector(nodes[t["parent"]]):
            repeated[t["parent"]] = repeated.get(t["parent"], 0) + t["text"]
    within = {c: max(0, nodes[c]["text"] - (repeated.get(c, 0) if pages >= DEDUCED_PAGES else 0)) for c in alive}  # letters that vary
    whole = {c: nodes[c]["text"] + nodes[c]["link"] for c in alive}
    links = {c: nodes[c]["link"] for c in alive}
    for c in reversed(alive[1:]):
        for sums in (within, whole, links):
            sums[nodes[c]["parent"]] += sums[c]
    outside = [c for c in alive if nodes[c]["kind"] != FORM or 2 * whole[c] > whole[ROOT]]

    def outermost(mark: int) -> list[int]:
        found: set[int] = set()
        kept = []
        for c in alive:
            if nodes[c]["parent"] in found and c != ROOT:
                found.add(c)
            elif nodes[c]["mark"] == mark:
                found.add(c)
                kept.append(c)
        return kept

    marked = outermost(3) or outermost(2)
    if marked:
        most = max(whole[c] for c in marked)
        slots, least, menus = [c for c in marked if 3 * whole[c] >= most], MARKED_PAGES, []
    else:
        named = [c for c in outermost(1) if 2 * within[c] > within[ROOT]]
        slots, least = named[:1], DEDUCED_PAGES
        if not slots:
            here = ROOT
            while True:
                inner = [c for c in parents.get(here, ()) if c in within and c in outside and nodes[c]["kind"] != HEADER and 2 * within[c] > within[here]]
                if not inner:
                    break
                here = inner[0]
            slots = [here]
        menus = [c for c in alive if c not in slots and whole[c] and links[c] >= LINKS * whole[c]]
    texts = []
    if pages >= least:
        inside = set(slots)
        for c in alive:
            if nodes[c]["parent"] in inside:
                inside.add(c)
        for slot in slots:
            same = [t for t in tokens if not t["element"] and t["parent"] in inside and t["total"] == t["pages"] and vector(t) == vector(nodes[slot])]
            if 2 * sum(t["text"] for t in same) < sum(whole[s] for s in slots):
                texts += [t["token"] for t in same]
    return {"slots": slots, "texts": texts, "menus": menus}


def article(page: Page, template: dict | None) -> str:
    """The blocks of the template's slots, or of the page's own where it has none of these, a line each."""
    tokens = {t for t, *_ in page.nodes}
    if template is None or not tokens.intersection(template["slots"]):
        counts = Counts()
        counts.add("", 0, page)
        names = [c.split()[0] for c in TOKENS.split(", ")][2:]
        template = decided([{"token": token, **dict(zip(names, row))} for (_, token), row in counts.rows.items() if row[1]])
    slots, texts, menus = (set(template[c]) for c in ("slots", "texts", "menus"))
    marked = any(mark >= 2 for token, _, _, mark in page.nodes if token in slots)
    state: list[bool] = []  # of each container: whether it is in a slot and not left out
    for token, parent, kind, _ in page.nodes:
        if token in slots:
            state.append(True)
        else:
            state.append(parent >= 0 and state[parent] and kind != OUT and token not in menus and not (kind == HEADER and not marked) and not (kind == FORM))
    return "\n".join(text for at, text, _ in page.blocks if state[at] and (not texts or text_token(page.nodes[at][0], text) not in texts))


def templates(pages: DataFrame) -> DataFrame:
    """TEMPLATES of the hosts of pages (host, number, html)."""
    sums = [F.max(c).alias(c) for c in ("parent", "element", "mark", "kind")] + [F.sum(c).alias(c) for c in ("pages", "total", "f1", "f2", "f3", "text", "link")]
    tokens = pages.mapInArrow(counted, TOKENS).groupBy("host", "token").agg(*sums)
    tokens = staged(tokens.filter(F.col("element") | (F.col("pages") >= DEDUCED_PAGES)), "tokens")
    hosts = tokens.filter(f"element and token = {ROOT}").select("host", F.col("pages").alias("of"))
    frequent = tokens.join(hosts, "host").filter(F.col("pages") >= SUPPORT * F.col("of")).drop("of")  # bounded by twice a page's mean number of tokens

    def deduced(rows: pd.DataFrame) -> pd.DataFrame:
        found = decided(rows.to_dict("records"))
        return pd.DataFrame({"host": rows["host"].iloc[:1], **{k: [v] for k, v in found.items()}})

    return staged(frequent.groupBy("host").applyInPandas(deduced, TEMPLATES), "templates", small=True)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    found = templates(pages.select("host", F.xxhash64("page_id", "url").alias("number"), "html"))
    size = found.agg(F.count("*"), F.coalesce(F.sum(F.size("slots") + F.size("texts") + F.size("menus")), F.lit(0))).first()
    if size[0] <= MOST_HOSTS and size[1] <= MOST_NUMBERS:
        known = pages.join(F.broadcast(found), "host", "left")
    else:  # a host of any size is spread over its salts
        salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        known = pages.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_merge"), ["host", "_salt"], "left")

    def read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, dict | None] = {}
            texts = []
            for k in range(batch.num_rows):
                name = batch.column("host")[k].as_py()
                if name not in known:
                    known[name] = {c: batch.column(c)[k].as_py() for c in ("slots", "texts", "menus")} if batch.column("slots")[k].is_valid else None
                html = batch.column("html")[k].as_py()
                texts.append(article(Page(html), known[name]) if html else "")
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])
            released()

    return known.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "host", "slots", "texts", "menus").mapInArrow(read_pages, EXTRACTED)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


#: The articles of the given pages are marked and hold paragraphs, headings and bold words only.
OP12_SQL = r"""
WITH b AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '</?(p|h1|br)>', chr(1), 'g'), chr(1)) AS blocks FROM pages
), t AS (
  SELECT page_id, url, list_filter(list_transform(blocks, lambda x: trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM b
)
SELECT page_id, url, coalesce(array_to_string(blocks, chr(10)), '') AS text, length(coalesce(array_to_string(blocks, chr(10)), '')) AS n_chars FROM t
"""
