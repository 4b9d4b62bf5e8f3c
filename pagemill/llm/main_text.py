"""HTML extraction by tree scoring: which container of a page holds the article, and that article's text.

Markup is read into a tree of block elements (inline elements only tell text from link text). Clutter goes first: elements
that are never text (scripts, styles, heads, media), menus, footers, sidebars and forms by their tags, page headers (those outside of an
article), and elements whose role, class or id names clutter (``CLUTTER``), unless the article is inside them. Every block that has text of its own then
passes points to its ancestors: one, one a comma, and one for each hundred characters (three at most), times the share of its text that isn't in
links; its parent gets all, the next ancestor half, those above a third, a quarter and so on. ``article`` and ``main`` begin with a bonus. The best
container is the one with most points; one inside an article is extended to the article. Siblings stay that have a fifth of its points, or are headings right in front of it,
or paragraphs with much text and few links. Inside what stays, lists of links (three links and more, nine tenths of the text) go as menus.

Text: references are decoded, each block's white space becomes single spaces, empty blocks go, blocks are joined by newlines in page order. A ``br`` is white space.

How it scales: a page is one row's work, in time about linear in its length (each paragraph passes points to its next ``REACH`` ancestors). Nothing is shuffled.

Defined results: null and empty html give an empty text, as do pages without any text outside of clutter; broken markup (missing ends, ends that match nothing,
tags inside scripts, comments and tags that never end) is read as browsers do as far as text goes; ties go to the first container in page order; rows that repeat a
page_id are each read by themselves; very long pages count whole; other columns are kept, whatever their names, but ``text`` and ``n_chars`` are
new columns and take the place of columns of that name; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.shared import slices

# The names of elements, by what they are for.
#: Elements that hold raw text, in which tags mean nothing.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never have text of an article in them.
NO_TEXT = frozenset("script style textarea title xmp iframe noembed noframes head noscript template svg math canvas object audio video select button datalist map dialog".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol "
    "option p pre search section summary table caption colgroup tbody tfoot thead tr td th ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLUTTER_TAGS = frozenset("nav footer aside menu form fieldset search".split())
CLUTTER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
#: Words that name clutter, if they are a word of a class or an id.
CLUTTER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars aside menu menus nav navbar navigation "
    "breadcrumb breadcrumbs header masthead topbar footer colophon cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay newsletter subscribe subscription signup signin "
    "login paywall share sharing social related recommended recommendations trending widget widgets toolbar pagination pager skip".split()
)
#: Words that name what readers wrote; not even an article of that name is one.
READERS = frozenset("comment comments commentlist disqus respond reply replies discussion reviews".split())
#: What an element that begins ends: open elements of the same kind, up to those that hold them.
_ITEM = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select", "datalist"})}
_ITEM |= {c: ({"td", "th"}, {"tr", "table"}) for c in ("td", "th")} | {"tr": ({"tr", "td", "th"}, {"table"})} | {c: ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}) for c in ("thead", "tbody", "tfoot")}
_KEEPS_P = frozenset("td th caption table button object".split())

#: How many ancestors a paragraph passes points to, the bonus of an article, and the share of the best points with which a sibling stays.
REACH, BONUS, SIBLING = 8, 10.0, 0.2

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|(?<==)\"[^\"]*+\"|(?<==)'[^']*+'|[\"'])*+)>|<[!?/][^>]*+>?", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """A block element: its content in order (texts with whether they are of a link, and nodes) and its points."""

    __slots__ = ("tag", "up", "inside", "clutter", "points", "n_text", "n_link", "links", "articles")

    def __init__(self, tag: str, up: Node | None, clutter: str = ""):
        self.tag, self.up, self.clutter = tag, up, clutter
        self.inside: list = []
        self.points, self.n_text, self.n_link, self.links, self.articles = 0.0, 0, 0, 0, 0


def clutter_of(tag: str, attributes: str) -> str:
    """Why an element is clutter: ``never`` (no article is in it), ``readers``, or ``maybe`` (unless an article is in it); or ''."""
    why = "never" if tag in NO_TEXT else "maybe" if tag in CLUTTER_TAGS else ""
    if not attributes:
        return why
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "never"
        if name == "role":
            why = why or ("maybe" if value.lower() in CLUTTER_ROLES else "")
        elif name in ("class", "id") and tag not in ("html", "body"):
            words = {w.lower() for w in _WORD.findall(value)}
            if words & READERS:
                return "readers"
            if words & CLUTTER and tag not in ("article", "main"):
                why = why or "maybe"
    return why


def tree(page: str) -> Node:
    """The page's block elements and its text; runs of text are kept as they stand."""
    root = Node("", None)
    here, stack, n_open = root, [root], Counter()  # open blocks, and inline elements that are clutter
    link = None  # the block in which a link began
    # Behind the last ">" no tag ends: one that begins there is never one.
    pos, end = 0, len(page)
    last = page.rfind(">") + 1

    def close(k: int) -> None:
        nonlocal here, link
        if link is not None and link in stack[k:]:
            link = None
        n_open.subtract(x.tag for x in stack[k:])
        del stack[k:]
        here = stack[-1]

    def close_open(tags: set | frozenset, stop: set | frozenset) -> None:
        if not any(n_open[t] > 0 for t in tags):
            return
        found = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in stop:
                break
            if stack[k].tag in tags:
                found = k
        if found:
            close(found)

    while pos < end:
        m = _TOKEN.search(page, pos, last)
        if m is None:
            here.inside.append((re.split("<[a-zA-Z/!?]", page[pos:], maxsplit=1)[0], link is not None))
            break
        if m.start() > pos:
            here.inside.append((page[pos : m.start()], link is not None))
        pos, tag = m.end(), m[2]
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith(">"):
                break  # a comment that never ends
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                link = None
            elif tag in BLOCKS or n_open[tag] > 0:
                for k in range(len(stack) - 1, 0, -1) if n_open[tag] > 0 or tag in HEADINGS else ():
                    if stack[k].tag == tag or tag in HEADINGS and stack[k].tag in HEADINGS:
                        close(k)
                        break
                    if stack[k].tag in ("td", "th", "caption") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body"):
                        break
                else:
                    here.inside.append(None)  # an end that matches nothing still ends a block
            continue
        if tag in ("br", "hr"):
            here.inside.append((" ", False) if tag == "br" else None)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            closing = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, pos)
            pos = closing.start() if closing else end
            after = page.find(">", pos)
            pos = end if closing is None or after < 0 else after + 1
            continue
        if tag == "a":
            link = here
            here.links += 1
            continue
        why = clutter_of(tag, m[3])
        if tag not in BLOCKS and not why:
            continue
        if tag in BLOCKS:
            if tag in _ITEM:
                close_open(*_ITEM[tag])
            close_open({"p"}, _KEEPS_P)
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                close(len(stack) - 1)
        if tag in ("html", "body") and n_open[tag] > 0:
            continue
        if m[3].endswith("/") and tag not in BLOCKS:
            continue
        node = Node(tag, here, why)
        here.inside.append(node)
        stack.append(node)
        n_open[tag] += 1
        here = node
    return root


def in_order(root: Node) -> list[Node]:
    """All nodes, each before what is inside it, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in reversed(node.inside) if isinstance(x, Node))
    return out


def without_clutter(nodes: list[Node]) -> list[Node]:
    """The nodes that aren't in clutter; what is in clutter is taken out of the tree."""
    for node in reversed(nodes):
        own = node.tag in ("article", "main") and node.clutter != "readers"
        inner = sum(x.articles for x in node.inside if isinstance(x, Node) and x.clutter not in ("never", "readers"))
        node.articles = int(own) + inner
    in_article: dict[int, bool] = {}
    out, gone = [], set()
    for node in nodes:
        above = node.up
        inside = above is not None and (in_article.get(id(above), False) or above.tag == "article")
        in_article[id(node)] = inside
        always = node.clutter in ("never", "readers")
        drop = always or node.clutter == "maybe" and not node.articles or node.tag == "header" and not inside and not node.articles
        if above is not None and (id(above) in gone or drop):
            gone.add(id(node))
        else:
            out.append(node)
    for node in out:
        node.inside = [x for x in node.inside if not isinstance(x, Node) or id(x) not in gone]
    return out


def blocks_of(node: Node) -> list[str]:
    """The texts of the blocks in a node, in page order."""
    out: list[str] = []
    now: list[str] = []

    def ended() -> None:
        text = " ".join(html.unescape("".join(now)).split())
        now.clear()
        if text:
            out.append(text)

    todo: list = [iter(node.inside)]
    tags = [node.tag]
    while todo:
        x = next(todo[-1], todo)
        if x is todo:
            todo.pop()
            if tags.pop() in BLOCKS or not todo:
                ended()
        elif x is None:
            ended()
        elif isinstance(x, tuple):
            now.append(x[0])
        else:
            if x.tag in BLOCKS:
                ended()
            todo.append(iter(x.inside))
            tags.append(x.tag)
    return out


def scored(nodes: list[Node]) -> None:
    """Points of every node, and the characters and links in it."""
    for node in reversed(nodes):
        text, in_link, commas = 0, 0, 0
        for x in node.inside:
            if isinstance(x, tuple):
                n = len("".join(x[0].split()))
                text += n
                in_link += n if x[1] else 0
                commas += sum(x[0].count(c) for c in ",،、，")
        node.points += BONUS if node.tag in ("article", "main") and node.clutter != "readers" else 0.0
        if text and node.tag not in HEADINGS:
            passed = (1 + commas + min(3, text / 100)) * (1 - in_link / text)
            up = node.up if node.tag in ("p", "pre", "blockquote", "li", "td", "dd", "dt", "") or node.tag not in BLOCKS else node
            for k in range(1, REACH + 1):
                if up is None:
                    break
                up.points += passed / k
                up = up.up
        node.n_text += text
        node.n_link += in_link
        if node.up is not None:
            node.up.n_text += node.n_text
            node.up.n_link += node.n_link
            node.up.links += node.links


def article_parts(page: str) -> list[str]:
    """The blocks of the page's main text."""
    root = tree(page)
    nodes = without_clutter(in_order(root))
    scored(nodes)
    if not root.n_text:
        return []
    worth = lambda x: x.points * (1 - x.n_link / x.n_text) if x.n_text else 0.0
    best = max(nodes, key=worth)
    if worth(best) <= 0:
        return blocks_of(root)
    around = best
    while around is not None:
        if around.tag == "article":
            best = around
        around = around.up
    most = worth(best)
    for node in nodes:  # menus inside
        if node.up is not None and node.tag in ("ul", "ol", "dl", "div", "section", "table", "p") and node.links >= 3 and node.n_link >= 0.9 * node.n_text and node is not best:
            node.inside = []
    if best.up is None:
        return blocks_of(best)
    out: list[str] = []
    near = [x for x in best.up.inside if isinstance(x, Node)]
    place = next(i for i, x in enumerate(near) if x is best)
    for i, x in enumerate(near):
        few_links = x.n_text and x.n_link / x.n_text < 0.25
        headed = x.tag in HEADINGS and all(y.tag in HEADINGS for y in near[i:place]) and i < place
        if x is best or headed or few_links and (worth(x) >= SIBLING * most or x.tag == "p" and x.n_text > 80):
            out += blocks_of(x)
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, its main text, and ``n_chars``, the code points of that."""
    pages = pages.drop("text", "n_chars").withColumn("html", F.col("html").cast("string"))
    out = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = ["\n".join(article_parts(x)) if x else "" for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=out.names)

    return pages.mapInArrow(run, out)
