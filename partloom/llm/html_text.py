"""Main text of web pages by composite text density.

Every element of the whole DOM gets its link-adjusted characters per tag; an element's density sum adds those of its
children and its own text. The container with the greatest sum is the text's core. The least density on the path
from it to the body is the threshold: neighbours of that path whose density reaches it belong to the text as well, and a
heading belongs to the block that follows it. An element that is boilerplate by its kind, role, class or id (a menu, footer,
form, advert, notice, reader comments) is no part of the text, whatever its density; text in an article or main element counts
more. A layout wrapper or form that holds the page's main part loses its mark (settle()); comments, notices and adverts never do.
Paragraphs, headings and the like are told by fewer names, so that a word such as "reply" or "notice" on one drops nothing of an article.

Defined results: a null page, or one without text but boilerplate, gives an empty string; broken markup is read as
far as it goes (unclosed elements end with their parent, unknown end tags are skipped); a page
without tags is its own text. Of containers with equal sums the first in the page is the core. Very long pages are
read whole, in time and memory in proportion to them. Repeated rows give repeated results; an empty table gives no rows;
other columns of the pages, whatever their names, are left alone.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.base import prepare

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("br body html head caption td th tr tbody thead tfoot option optgroup legend title".split())
#: Start tags that end an open element of these kinds, unless one of the second set stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Elements without text of the page, and kinds that the article is without.
SILENT = frozenset("head select input iframe noscript noembed noframes template script style svg canvas object embed audio video textarea title".split())
BOILERPLATE = frozenset("nav aside footer button dialog menu".split())
#: How much the density of what an article or main element holds counts.
ARTICLE = 4.0
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names in a class or id, hyphens and underscores left out, that mark an element as none of the article.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
NOTICES = frozenset("cookie cookies consent gdpr notice alert".split())
COMMENTS = frozenset("related recommended recommendations comment comments commentlist disqus reply replies respond feedback".split())
LAYOUT = frozenset(
    "banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar popup modal overlay newsletter subscribe subscription signup signin login "
    "share sharing social widget pagination pager toolbar skip".split()
)
MARKS = ADVERTS | NOTICES | COMMENTS | LAYOUT
#: Those that count on a block of running text.
PROSE_MARKS = ADVERTS | frozenset("cookie cookies consent gdpr breadcrumb breadcrumbs newsletter subscribe share sharing pagination pager skip".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote q dl dt dd figcaption caption b i em strong span small sub sup code mark cite".split())
#: Characters of an element's own text, outside links, that make a page's unmarked part more than scraps.
SCRAP = 100
HEAD_MARKS = frozenset(("header", "siteheader", "pageheader"))
CONTAINERS = frozenset("article main section div body html td table blockquote form center dd li".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/><]*)([^<>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?![\w-])\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


class Node:
    """drop: not shown. marked: boilerplate by its kind, role, class or id; wraps: by layout names or as a form alone. inside: in an article or main element."""

    __slots__ = ("tag", "parent", "children", "drop", "chars", "tags", "link_chars", "link_tags", "density", "total", "weight", "marked", "wraps", "inside")

    def __init__(self, tag: str, parent: Node | None, drop: bool, marked: bool = False, wraps: bool = False, inside: bool = False):
        self.tag, self.parent, self.children, self.drop, self.marked, self.wraps, self.inside = tag, parent, [], drop, marked, wraps, inside
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.weight = 1.0


def _prior(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is not shown, whether it is boilerplate, and if so whether only as a form or by layout names.
    inside: it stands in an article or main element."""
    if tag in SILENT:
        return True, False, False
    firm, wraps = tag in BOILERPLATE or tag == "header" and not inside, tag == "form"
    if tag in ("html", "body", "article", "main") or not attributes:
        return False, firm or wraps, not firm
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False, False
        firm = firm or name == "role" and value in ROLES
        if name in ("class", "id"):
            names = set(value.replace("-", "").replace("_", "").split()) & (PROSE_MARKS if tag in PROSE else MARKS | HEAD_MARKS if not inside else MARKS)
            wraps = wraps or bool(names)
            firm = firm or bool(names - LAYOUT)
    return False, firm or wraps, not firm


def settle(nodes: list[Node]) -> None:
    """Take the marks off layout wrappers and forms that hold the page's main part: outside article and main, one that holds a
    main element; and, where no unmarked article, paragraph or longer text stands, one that holds an article or over half of the page's text."""
    if not any(x.marked and x.wraps and not x.drop for x in nodes):
        return
    chars, mains, articles, under = {}, {}, {}, {}
    free = False
    for x in nodes:
        under[id(x)] = x.marked or x.tag == "a" or x.parent is not None and under[id(x.parent)]
        own = chars[id(x)] = sum(len(" ".join(t.split())) for t in x.children if isinstance(t, str))
        free = free or not x.drop and not under[id(x)] and (x.tag in ("article", "main") or own >= (1 if x.tag == "p" else SCRAP))
    for x in reversed(nodes):
        k = id(x)
        mains[k] = mains.get(k, False) or x.tag == "main" and not x.drop
        articles[k] = articles.get(k, False) or x.tag == "article" and not x.drop
        if x.parent:
            up = id(x.parent)
            chars[up] += chars[k]
            mains[up], articles[up] = mains.get(up, False) or mains[k], articles.get(up, False) or articles[k]
    all_chars = chars[id(nodes[0])]
    for x in nodes:
        k = id(x)
        if x.marked and x.wraps and not x.inside and (mains[k] or not free and (articles[k] or 2 * chars[k] > all_chars)):
            x.marked = False


def parse(page: str) -> list[Node]:
    """Elements in page order, the root first. Children are elements and texts; texts in elements that are not shown are left out."""
    root = Node("html", None, False)
    nodes, top, at, inside = [root], root, 0, 0
    end = len(page)

    def close(upto: Node) -> Node:
        nonlocal inside
        node = top
        while node is not upto.parent:
            inside -= node.tag in ("article", "main")
            node = node.parent
        return node

    def open_one(kinds, barriers=frozenset()) -> Node | None:
        node = top
        while node is not root and node.tag not in barriers:
            if node.tag in kinds:
                return node
            node = node.parent
        return None

    while at < end:
        m = TAG.search(page, at)
        if not m:
            if not top.drop:
                top.children.append(page[at:])
            break
        if m.start() > at and not top.drop:
            top.children.append(page[at : m.start()])
        at = m.end()
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            if name not in ("html", "body") and (node := open_one({name}, {"table"} if name not in ("table", "article", "main", "section", "div") else frozenset())):
                top = close(node)
            elif name == "br":
                top.children.append(Node("br", top, top.drop))
            continue
        if name in ("html", "body"):
            if name == "body" and (node := open_one({"head"})):
                top = close(node)
            continue
        if name in CLOSES_P and (node := open_one({"p"}, {"table", "td", "th", "button", "article", "div", "section", "blockquote", "li"})):
            top = close(node)
        if name in ENDS and (node := open_one(*ENDS[name])):
            top = close(node)
        drop, marked, wraps = _prior(name, attributes, inside > 0)
        node = Node(name, top, top.drop or drop, marked, wraps, inside > 0)
        top.children.append(node)
        nodes.append(node)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
        elif name not in VOID and not attributes.rstrip().endswith("/") or name not in VOID and name in BLOCKS:
            top = node
            inside += name in ("article", "main")
    settle(nodes)
    return nodes


def densities(nodes: list[Node]) -> None:
    """Composite text density, prior weight and density sum of every element that is shown; children come after parents in
    nodes. tags: the elements below; link_tags: links among them and the element itself; these, and characters in and out of links, count as one at least."""
    for x in reversed(nodes):
        if x.drop:
            continue
        x.chars += sum(len(" ".join(t.split())) for t in x.children if isinstance(t, str))
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1
        if p := x.parent:
            p.chars, p.tags = p.chars + x.chars, p.tags + x.tags + 1
            p.link_chars, p.link_tags = p.link_chars + x.link_chars, p.link_tags + x.link_tags
    share = nodes[0].link_chars / max(1, nodes[0].chars)
    for x in nodes:
        if x.drop or not x.chars:
            continue
        tags, linked, plain = max(1, x.tags), max(1, x.link_chars), max(1, x.chars - x.link_chars)
        base = math.log(x.chars / plain * linked + share * x.chars + math.e)
        x.density = x.chars / tags * math.log(x.chars / linked * tags / max(1, x.link_tags), base)
        x.weight = (x.parent.weight if x.parent else 1.0) * (not x.marked) * (ARTICLE if x.tag in ("article", "main") and not x.inside else 1.0)
        x.total += x.weight * sum(len(" ".join(t.split())) for t in x.children if isinstance(t, str))
        if x.parent:
            x.parent.total += x.weight * x.density


def chosen(nodes: list[Node]) -> tuple[set[int], set[int]]:
    """The elements whose subtrees make the main text, and those on the path from the core to the body."""
    boxes = [x for x in nodes if not x.drop and x.chars and x.weight and (x.tag in CONTAINERS or x.parent is None) and x.total]
    if not boxes:
        return set(), set()
    core = max(boxes, key=lambda x: x.total)
    path = [core]
    while path[-1].parent:
        path.append(path[-1].parent)
    least = min(x.density for x in path)
    take, on = {id(core)}, {id(x) for x in path[1:]}
    for x in path[1:]:
        after = None  # the block that follows
        for y in reversed(x.children):
            if isinstance(y, str) or y.drop or not y.chars:
                continue
            wanted = y is core or id(y) in on
            if not wanted and not y.marked and y.tag in BLOCKS and (y.weight * y.density >= least or y.tag in HEADINGS and after):
                take.add(id(y))
                wanted = True
            after = wanted
    return take, on


def text_of(root: Node, take: set[int], on: set[int]) -> str:
    """Blocks in page order: references decoded, white space made single, joined by newlines. On the path to the core only
    what is taken counts, and text that stands in an article or main element itself."""
    blocks, run = [], []

    def flush():
        if run:
            if line := " ".join(html.unescape("".join(run)).split()):
                blocks.append(line)
            run.clear()

    stack = [(iter((root,)), False, False)]  # what is left of an element, whether its texts count, whether it ends a block
    while stack:
        rest, counts, ends = stack[-1]
        x = next(rest, None)
        if x is None:
            stack.pop()
            if ends:
                flush()
        elif isinstance(x, str):
            if counts:
                run.append(x)
        elif not x.drop:
            whole = id(x) in take or counts and id(x) not in on and not x.marked
            if whole or id(x) in on:
                if block := x.tag in BLOCKS:
                    flush()
                stack.append((iter(x.children), whole or x.inside or x.tag in ("article", "main"), block))
            elif x.tag in BLOCKS:
                flush()
    flush()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes = parse(page)
    densities(nodes)
    return text_of(nodes[0], *chosen(nodes))


def extract(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: the columns of keep, text and n_chars. No shuffle."""
    prepare(pages.sparkSession)
    given = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{page}`").alias("t"))

    def run(batches):
        for b in batches:
            out = [main_text(t) for t in b.column("t").to_pylist()]
            made = [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], "text", "n_chars"])

    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    out = given.mapInArrow(run, f"{head}text string, n_chars long")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
