"""Main text of pages by a site style tree (after Yi, Liu and Li, 2003).

The pages of a host are merged into one tree of element nodes, each known by its path of structural elements
(tag and class). Over the m pages that have a node, three things are measured:

* its content: 1 minus the mean entropy (to the base m) of the texts at and below it over pages: a text
  on one page has entropy 0, one on all pages 1. A text whose pages are all copies of one page counts as on one;
* its presentation: the entropy of its forms (sequences of children) over pages;
* its volume: the mean share of a page's text that it holds, less most of that if its text is links.

Content and presentation are drawn to 1 and 1/2 where m is small. The importance of a container (div, section, nav and
the like, and what has a name like theirs) is CONTENT, STYLE and VOLUME parts of the three, that of an element of running
text (headings, paragraphs, lists, tables) comes from its content alone: a heading is short everywhere. What is below LEAST is removed from each page.
The names of elements are a weak prior: NOISE for those of menus, adverts, comments and the like, MAIN in an article or
main element, 1 for others. So no name removes anything by itself, and small containers go whose form is the same on
all pages, whatever they are called. A name that tells noise doesn't count for an element that has WRAPS of
the page's own text. A single text is judged as an element of text is, by the pages of its node that have it, so a notice
goes that all pages have among other paragraphs.

Elements nested deeper than DEPTH become siblings there, as in browsers. The tree holds one row a node; only
the importance of removed or named nodes and of removed texts is passed on: in memory where that is little, and else each page
gets that of its own nodes and texts by a join.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import join_groups, keep

CONTENT, STYLE, VOLUME = 0.4, 0.2, 0.4
NOISE, MAIN, LEAST, SMALL = 0.6, 2.0, 0.5, 5.0
#: The content below which an element of running text, or a single text, goes.
REPEATED = 0.3
#: How much of a node's importance goes if all its text is links.
LINKED = 0.75
#: The share of a page's text that a menu, advert or the like doesn't have.
WRAPS = 0.8
#: Levels of elements.
DEPTH = 512
#: Rows of importance that executors hold in memory.
HELD_BRANCHES = 100_000

# Names of HTML elements, and words of classes and roles.
NOISE_TAGS = frozenset("nav footer aside form menu dialog".split())
RAW_TAGS = frozenset("script style noscript template svg title textarea iframe select button label datalist object audio video canvas".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    "html body head address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
MAIN_TAGS = frozenset(["article", "main"])
CONTAINERS = frozenset("html body article aside details dialog dir div fieldset figure footer form header main menu nav search section".split())
#: Words that tell noise as the last word of a class or role, words that do so anywhere in it, and words that say nothing.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising alert aside banner banners breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted recommended related replies search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget".split()
)
NOISE_ANYWHERE = frozenset("advertisement breadcrumb breadcrumbs cookie cookies disqus gdpr newsletter popup promoted recommended related sidebar sponsored".split())
PLAIN_WORDS = frozenset("area bar block body bottom box center container content inner item items left link links list outer right section slot text top unit wrap wrapper".split())
#: What an opening block ends, if it is open within the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_NAME = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z0-9]+")


def hidden(attributes: str) -> bool:
    """Whether an element has the attribute hidden itself, or display:none in its style."""
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name == "hidden" or (name == "style" and m[2] and _NOT_SHOWN.search(html.unescape(m[2].strip("\"'")))):
            return True
    return False


def tells_noise(name: str) -> bool:
    """Whether a class, id or role is that of a menu, advert or the like: by its last word that says something."""
    words = _WORD.findall(name)
    told = [w for w in words if w not in PLAIN_WORDS and not w.isdigit()]
    return bool(told) and (told[-1] in NOISE_WORDS or not NOISE_ANYWHERE.isdisjoint(told))


def code_of(text: str, seed: int = 0) -> int:
    """A 63-bit hash."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) >> 1


class Node:
    __slots__ = ("tag", "name", "code", "parent", "noise", "hidden", "main", "size", "links", "children")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        names = [(m[1].lower(), m[2].strip("\"'").lower()) for m in _NAME.finditer(attributes)] if attributes else []
        classes = [c for kind, value in names if kind == "class" for c in value.split()]
        self.tag, self.name, self.parent = tag, tag + ("." + classes[0] if classes else ""), parent
        root = tag in ("html", "body")
        above = parent.code if parent else 0
        #: Of the path; 0 outside of all elements but html and body.
        self.code = above if root else code_of(self.name, above)
        self.main = tag in MAIN_TAGS
        plain = not self.main and not root
        self.noise = plain and (tag in NOISE_TAGS or any(tells_noise(x) for _, value in names for x in value.split()))
        self.hidden = bool(parent and parent.hidden) or tag == "head" or (plain and bool(attributes and hidden(attributes)))
        self.size = self.links = 0
        self.children: list[str] = []


class Page:
    """The shown blocks of text of a page in order, each as (node, text), and its nodes in the order of their beginnings."""

    def __init__(self, page: str):
        self.nodes: list[Node] = []
        self.blocks: list[tuple[Node | None, str]] = []
        self.size = 0
        self._read(page)
        for node in reversed(self.nodes):
            if node.parent:
                node.parent.size += node.size
                node.parent.links += node.links

    def _read(self, page: str) -> None:
        ends: dict[str, list[tuple[int, int]]] = {}
        stack: list[Node] = []
        held: list[str] = []
        at = linked = mains = 0
        link: int | None = None  # the depth at which a link began

        def flush() -> None:
            nonlocal linked
            text = " ".join(html.unescape("".join(held)).split())
            node = stack[-1] if stack else None
            if text and not (node and node.hidden):
                self.blocks.append((node, text))
                self.size += len(text)
                if node:
                    node.size += len(text)
                    node.links += min(linked, len(text))
            held.clear()
            linked = 0

        def cut(k: int) -> None:
            nonlocal mains, link
            mains -= sum(x.main for x in stack[k:])
            del stack[k:]
            if link is not None and link > k:
                link = None

        def hold(text: str) -> None:
            nonlocal linked
            held.append(text)
            if link is not None:
                linked += len(text)

        while at < len(page):
            m = _TOKEN.search(page, at)
            if m is None:
                hold(page[at:])
                break
            if m.start() > at:
                hold(page[at : m.start()])
            at = m.end()
            closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if not closing and tag in RAW_TAGS:
                if not attributes.endswith("/"):
                    at = self._after_raw(page, at, tag, stack, ends)
                continue
            if tag == "a":
                link = None if closing else len(stack)
            if tag == "br":
                held.append(" ")
            if tag not in BLOCK_TAGS or tag in VOID_TAGS:
                if tag == "hr":
                    flush()
                continue
            flush()
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == tag:
                        cut(k)
                        break
                continue
            if stack and stack[-1].tag == "p":
                cut(len(stack) - 1)
            if tag in CLOSES:
                ends, within = CLOSES[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in within:
                        break
                    if stack[k].tag in ends:
                        cut(k)
                        break
            if len(stack) >= DEPTH:
                cut(DEPTH - 1)
            node = Node(tag, attributes, stack[-1] if stack else None)
            if tag == "header" and not mains:
                node.noise = True
            if stack:
                stack[-1].children.append(node.name)
            mains += node.main
            stack.append(node)
            self.nodes.append(node)
        flush()

    @staticmethod
    def _after_raw(page: str, at: int, tag: str, stack: list[Node], ends: dict[str, list[tuple[int, int]]]) -> int:
        """Where an element of raw text ends; one that is never closed ends with an element around it. ``ends``: the closing tags of each name, looked for once a page."""
        if tag not in ends:
            ends[tag] = [(m.start(), m.end()) for m in re.finditer(f"</{re.escape(tag)}(?![^\\s/>])", page, re.I)]
        k = bisect.bisect_left(ends[tag], (at, at))
        if k < len(ends[tag]):
            return page.find(">", ends[tag][k][1]) + 1 or len(page)
        around = "|".join(sorted({re.escape(x.tag) for x in stack}))
        end = re.compile(f"</(?:{around})(?![^\\s/>])", re.I).search(page, at) if around else None
        return len(page) if end is None else end.start()


def host_of(url: str | None) -> str:
    m = re.match(r"(?s).*?://([^/?#]*)", url or "")
    return m[1].translate(_LOWER) if m else ""


#: Letters A-Z in lower case, here and in the join by hosts.
_LOWER = {c: c + 32 for c in range(65, 91)}


def _form(names: list[str]) -> int:
    """Of a sequence of children, in which a run of equal ones counts as one."""
    return code_of(" ".join(x for k, x in enumerate(names) if not k or names[k - 1] != x))


def features(page: Page) -> tuple[set[tuple[int, int]], list[tuple]]:
    """(node, text) of a page, and for each node (node, form, share of text, share of linked text, name, named, nodes above it and itself)."""
    texts = {(node.code, code_of(text)) for node, text in page.blocks if node and node.code}
    forms: dict[int, list] = {}
    above: dict[int, list[int]] = {}
    for node in page.nodes:
        if node.code and node.tag not in ("html", "body") and not node.hidden:
            code = node.code
            if code not in above:
                above[code] = [*above.get(node.parent.code if node.parent else 0, []), code]
            of = forms.setdefault(code, [set(), 0, 0, node.name, False])
            of[0].add(_form(node.children))
            of[1] += node.size
            of[2] += node.links
            of[4] |= node.noise
    total = max(page.size, 1)
    return texts, [(code, code_of(" ".join(map(str, sorted(f)))), size / total, links / total, name, named, above[code]) for code, (f, size, links, name, named) in forms.items()]


_TEXTS = "host string, node long, feature long, copy long"
_NODES = "host string, node long, form long, volume double, linked double, name string, named boolean, above array<long>"


def _read(pages: DataFrame) -> DataFrame:
    """Features of all pages in one pass: rows of a text (feature) and rows of a node (form)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("host", pa.string()), ("node", pa.int64()), ("feature", pa.int64()), ("copy", pa.int64()), ("form", pa.int64()), ("volume", pa.float64()), ("linked", pa.float64()), ("name", pa.string()), ("named", pa.bool_()), ("above", pa.list_(pa.int64()))])
        for batch in batches:
            urls, texts = batch.column("url"), batch.column("html")
            for i in range(0, batch.num_rows, 64):
                rows: list[tuple] = []
                for url, raw in zip(urls.slice(i, 64).to_pylist(), texts.slice(i, 64).to_pylist(), strict=True):
                    host, copy = host_of(url), code_of(raw or "")
                    found, nodes = features(Page(raw or ""))
                    rows += [(host, node, text, copy, *[None] * 6) for node, text in sorted(found)]
                    rows += [(host, node, None, None, *more) for node, *more in nodes]
                columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return pages.select("url", "html").mapInArrow(run, _TEXTS + _NODES.removeprefix("host string, node long"))


def feature_counts(pages: DataFrame) -> DataFrame:
    """(host, node, feature, form, k, volume, linked, name, named, above) by text of a node, and by form of a node; k counts pages."""
    k = F.count(F.lit(1))
    return _read(pages).groupBy("host", "node", "feature", "form").agg(
        F.when(F.min("copy") == F.max("copy"), F.lit(1)).otherwise(k).cast("long").alias("k"),
        F.sum("volume").alias("volume"), F.sum("linked").alias("linked"), F.min("name").alias("name"), F.max("named").alias("named"), F.first("above").alias("above"),
    )


def _drawn(value: Column, m: Column, to: float) -> Column:
    """A measure over m pages, drawn to what is assumed where they are few."""
    return ((m - 1) * value + SMALL * to) / (m - 1 + SMALL)


def style_trees(pages: DataFrame) -> DataFrame:
    """(host, node, code, named, m, importance) of every node of every host's tree; node is its element, code its path."""
    return _trees(keep(feature_counts(pages), "features"))


def _trees(counts: DataFrame) -> DataFrame:
    """Sums are made in two steps, by text and form first, so no task holds a large host."""
    nodes = counts.where("form is not null").groupBy("host", "node").agg(
        F.sum("k").alias("m"), F.sum(F.col("k") * F.log("k")).alias("forms"), F.sum("volume").alias("volume"), F.sum("linked").alias("linked"),
        F.min("name").alias("name"), F.max("named").alias("named"), F.first("above").alias("above"),
    )
    own = counts.where("feature is not null").groupBy(F.col("host").alias("h"), F.col("node").alias("n")).agg(F.sum(F.log("k")).alias("logs"), F.count(F.lit(1)).alias("texts"))
    nodes = keep(nodes.join(own, (F.col("host") == F.col("h")) & (F.col("node") == F.col("n")), "left").drop("h", "n"), "nodes")
    below = nodes.where("texts > 0").select(F.col("host").alias("h"), F.explode("above").alias("n"), "logs", "texts")
    below = below.groupBy("h", "n").agg(F.sum("logs").alias("all_logs"), F.sum("texts").alias("all_texts"))
    wide = nodes.drop("logs", "texts").join(below, (F.col("host") == F.col("h")) & (F.col("node") == F.col("n")), "left")
    m = F.col("m")
    base = F.when(m > 1, F.log("m")).otherwise(1.0)
    style = F.when(m > 1, (base - F.col("forms") / m) / base).otherwise(0.5)
    content = F.when(F.col("all_texts").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("all_logs") / F.col("all_texts") / base))
    links = F.when(F.col("volume") > 0, F.col("linked") / F.col("volume")).otherwise(0.0)
    box = CONTENT * _drawn(content, m, 1.0) + STYLE * _drawn(style, m, 0.5) + VOLUME * F.col("volume") / m
    importance = F.when(F.regexp_extract("name", "^[^.]*", 0).isin(*sorted(CONTAINERS)) | F.col("named"), box).otherwise(_drawn(content, m, 1.0) * LEAST / REPEATED)
    return wide.select("host", F.col("name").alias("node"), F.col("node").alias("code"), "named", "m", (importance * (1 - LINKED * links)).alias("importance"))


def judged_parts(pages: DataFrame) -> DataFrame:
    """(host, code, feature, importance) of nodes that are named as noise or below LEAST, and of texts (feature) below LEAST."""
    counts = keep(feature_counts(pages), "features")
    trees = keep(_trees(counts), "trees")
    often = counts.where((F.col("feature").isNotNull()) & (F.col("k") > SMALL)).select(F.col("host").alias("h"), F.col("node").alias("n"), "feature", "k")
    texts = join_groups(often, trees, (F.col("h") == F.col("host")) & (F.col("n") == F.col("code")))
    alone = F.greatest(F.lit(0.0), 1 - F.log("k") / F.log("m"))
    texts = texts.select("host", "code", "feature", (_drawn(alone, F.col("m"), 1.0) * LEAST / REPEATED).alias("importance")).where(F.col("importance") < LEAST)
    nodes = trees.where((F.col("importance") < LEAST) | F.col("named")).select("host", "code", F.lit(None).cast("long").alias("feature"), "importance")
    return nodes.union(texts)


def by_part(rows: Iterable) -> dict:
    """Importance by node, or by node and text."""
    return {r["code"] if r["feature"] is None else (r["code"], r["feature"]): r["importance"] for r in rows}


def main_text(raw: str | None, tree: dict, names: bool = True) -> str:
    """The page's blocks outside removed branches, one a line. ``tree``: importance of its host's parts by ``by_part``; others have 1. Without ``names`` no prior is used."""
    tree, page = tree or {}, Page(raw or "")
    gone: dict[int, tuple[bool, float]] = {0: (False, 1.0)}  # by node: whether it is removed, and its prior
    for node in page.nodes:
        cut, prior = gone[id(node.parent) if node.parent else 0]
        if not cut and node.tag not in ("html", "body"):
            prior = MAIN if names and node.main else prior
            named = names and node.noise and node.size < WRAPS * page.size
            cut = tree.get(node.code, 1.0) * (NOISE if named else prior) < LEAST
        gone[id(node)] = cut, prior
    repeats = any(isinstance(x, tuple) for x in tree)
    found = []
    for node, text in page.blocks:
        cut, prior = gone[id(node) if node else 0]
        if not cut and repeats and node:
            cut = tree.get((node.code, code_of(text)), 1.0) * prior < LEAST
        if not cut:
            found.append(text)
    return "\n".join(found)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html)``.

    A null or empty html has an empty text. Pages without a host make a tree of their own. Rows are judged
    one by one, repeated ones alike; other columns are not looked at.
    """
    pages = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    judged = keep(judged_parts(pages), "judged")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def rows(batch: pa.RecordBatch, found: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if judged.limit(HELD_BRANCHES + 1).count() <= HELD_BRANCHES:
        of_host: dict[str, list] = {}
        for r in judged.collect():
            of_host.setdefault(r.host, []).append(r.asDict())
        by_host = {h: by_part(x) for h, x in of_host.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 128):
                    part = batch.slice(i, 128)
                    yield rows(part, [main_text(h, by_host.get(host_of(u), {})) for u, h in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True)])

        return pages.mapInArrow(run, schema)

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), "(?s)^.*?://([^/?#]*)", 1), letters, letters.lower())
    # Rows alike in all that counts have one key, and one text.
    keyed = pages.withColumn("host", host).withColumn("key", F.sha2(F.concat_ws("\n", F.col("page_id").cast("string"), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))), 256))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                made = []
                for key, of, raw in zip(*[batch.column(c).slice(i, 64).to_pylist() for c in ("key", "host", "html")], strict=True):
                    page = Page(raw or "")
                    mine = {(x.code, None) for x in page.nodes} | {(x.code, code_of(text)) for x, text in page.blocks if x}
                    made += [(key, of, code, feature) for code, feature in mine]
                columns = list(zip(*made, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "host", "code", "feature"])

    theirs = judged.select(F.col("host").alias("h"), F.col("code").alias("c"), F.col("feature").alias("f"), "importance")
    mine = keyed.select("key", "host", "html").mapInArrow(parts, "key string, host string, code long, feature long")
    # ``judged`` is written, so both sides of the join are exchanges and a large host's pages can be split.
    found = mine.join(theirs, (F.col("host") == F.col("h")) & (F.col("code") == F.col("c")) & F.col("feature").eqNullSafe(F.col("f")))
    lists = keep(found.groupBy(F.col("key").alias("k")).agg(F.collect_set(F.struct("code", "feature", "importance")).alias("tree")), "branches")
    joined = keyed.join(lists, F.col("key") == F.col("k"), "left").select("page_id", "url", "html", "tree")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                yield rows(part, [main_text(h, by_part(tree or ())) for h, tree in zip(part.column("html").to_pylist(), part.column("tree").to_pylist(), strict=True)])

    return joined.mapInArrow(run_joined, schema)
