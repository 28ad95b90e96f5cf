"""Main text of web pages by tree scoring.

The page is parsed into a tree (implied ends of paragraphs, list items and cells; unclosed and
crossed tags; truncated pages). What is no article by its tag, role or class is set aside; inside an article or main element a name that also says
something else (``article-header``, ``social-history``) sets a part aside only if its text is links.
Every paragraph then has points for its length and commas and passes them to its ancestors: all
to its parent, half to the next, a third of that share and less further up. An ancestor's points
are discounted by its link density (characters in links over all). The best container is kept, and
of its siblings, and of its ancestors' siblings, those with enough points or running text. All blocks of the kept
parts are returned, in page order. A form that holds more than half of the page's paragraphs is a wrapper, and no form.

Rows: null, empty and text-free pages give ''. Rows do not depend on each other, so ties, repeats
and skew do not matter. Nothing is cut: pages are read whole. Columns beside the
named ones are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
_ENDS_P = _BLOCK - {"tr", "tbody", "tfoot", "thead", "caption", "body", "html", "legend"}
_SCOPE = frozenset("html body td th caption button object template".split())
#: Starting tag -> open tags that it ends, up to an open tag of the second set.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
}
_ASIDE_TAGS = frozenset("head script style noscript template nav footer aside form button select textarea title iframe svg canvas object embed dialog menu noembed noframes xmp audio video map".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_ASIDE_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation topbar footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus reply replies respond social share sharing related recommended recommendations newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager toolbar widget widgets hidden outbrain taboola aside".split())
#: Of these one is enough, whatever else a name says.
_ASIDE_ALWAYS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay comment comments commentlist disqus replies respond newsletter subscribe subscription signup login outbrain taboola hidden".split())
#: Parts of names that say nothing.
_FILLERS = frozenset("box block container wrapper wrap inner outer section area list items item links link bar top bottom left right main site page global primary secondary content js l m s xl".split())
_ARTICLE_NAMES = frozenset("article body content entry main page post story text".split())
_PREFIXES = frozenset("has with no without is not".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])").findall
_BOXES = frozenset(["article", "main", "body", "div", "section", "#root"])
#: Points that a tag starts with.
_START = {"article": 10.0, "main": 10.0, "div": 2.0, "section": 2.0, "td": 1.0, "blockquote": 1.0, "pre": 1.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0, "th": -5.0}


#: Ancestors that a paragraph's points reach; at this height a share is under a three-hundredth, and trees of any depth take linear time.
REACH = 100


class Node:
    __slots__ = ("tag", "parent", "kids", "aside", "named", "points", "chars", "linked", "commas")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.kids: list[Node | str] = []
        self.aside = False
        self.named = False
        self.points = _START.get(tag, 0.0)
        self.chars = self.linked = self.commas = 0


def _named_aside(value: str) -> bool:
    """Whether a class or id says that an element is beside the article."""
    for name in value.split():
        parts = [x.lower() for x in _PART(name)]
        if not parts or parts[0] in _PREFIXES:
            continue
        if parts[-1] in _ASIDE_NAMES or any(x in _ASIDE_NAMES for x in parts) and not any(x in _ARTICLE_NAMES for x in parts):
            return True
    return False


def _only_aside(value: str) -> bool:
    """Whether each class or id that names something beside an article names nothing else."""
    for name in value.split():
        parts = [x.lower() for x in _PART(name)]
        if any(x in _ASIDE_ALWAYS for x in parts) or parts and all(x in _ASIDE_NAMES or x in _FILLERS for x in parts) and any(x in _ASIDE_NAMES for x in parts):
            return True
    return False


def _is_aside(tag: str, attrs: str, inside: bool) -> str:
    """'yes' for an element beside the article, 'named' for a part of one (``inside``) that a word of a name speaks against."""
    if tag in _ASIDE_TAGS:
        return "yes"
    if tag == "header" and not inside:
        return "yes"
    if not attrs or tag in ("html", "body", "article", "main"):
        return ""
    named = ""
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and _named_aside(value):
            if not inside or _only_aside(value):
                return "yes"
            named = "named"
        if key == "role" and value.strip().lower() in _ASIDE_ROLES or key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true":
            return "yes"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "yes"
    return named


def _settle(named: list[Node]) -> None:
    """Of parts of an article that a word of a name speaks against those go whose text is links, or that have none."""
    known: dict[int, tuple[int, int]] = {}
    for node in reversed(named):  # inner ones first, so each part of the tree is walked once
        chars = linked = 0
        todo: list[tuple[Node, bool]] = [(node, False)]
        while todo:
            x, link = todo.pop()
            if x.aside:
                continue
            if (got := known.get(id(x))) is not None:
                chars, linked = chars + got[0], linked + (got[0] if link else got[1])
                continue
            link = link or x.tag == "a"
            for y in x.kids:
                if type(y) is Node:
                    todo.append((y, link))
                else:
                    size = len(y.strip())
                    chars, linked = chars + size, linked + (size if link else 0)
        node.aside = 2 * linked >= chars
        known[id(node)] = (chars, linked)


def _tag_end(html: str, at: int) -> int:
    """Where the tag that begins before ``at`` ends (behind its '>'): quoted '>' don't count unless a quote is never closed; -1 without an end."""
    i = at
    while (m := _MARK.search(html, i)) is not None:
        if m[0] == ">":
            return m.end()
        i = html.find(m[0], m.end()) + 1
        if not i:
            break
    return html.find(">", at) + 1 or -1


def _token(html: str, at: int, last: int):
    """The next piece of markup: (start, tag or None, is an end tag, attributes, CDATA, end); None without one. last: the last '>' of the page."""
    while (i := html.find("<", at)) >= 0:
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            return i, None, False, "", None, end + 3 if end >= 0 else len(html)
        if html.startswith("<![CDATA[", i):
            end = html.find("]]>", i + 9)
            return (i, None, False, "", html[i + 9 : end], end + 3) if end >= 0 else (i, None, False, "", html[i + 9 :], len(html))
        if i > last:
            return None  # no tag ends any more
        if html[i + 1 : i + 2] in ("!", "?"):
            return i, None, False, "", None, html.find(">", i) + 1
        if (m := _NAME.match(html, i)) is not None and (end := _tag_end(html, m.end())) > 0:
            return i, m[2].lower(), bool(m[1]), html[m.end() : end - 1], None, end
        at = i + 1
    return None


def parse(html: str) -> Node:
    root = Node("#root", None)
    stack = [root]
    open_: Counter[str] = Counter()
    named: list[Node] = []

    def close(i: int) -> None:
        open_.subtract(x.tag for x in stack[i:])
        del stack[i:]

    at, last = 0, html.rfind(">")
    while (piece := _token(html, at, last)) is not None:
        start, tag, closing, attrs, data, end = piece
        if start > at:
            stack[-1].kids.append(unescape(html[at:start]))
        at = end
        if data:
            stack[-1].kids.append(data)
        if tag is not None and closing:
            for i in range(len(stack) - 1, 0, -1) if open_[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "body", "html", "article", "main", "div", "section"):
                    break  # an end tag in a cell ends nothing outside of it
        elif tag is not None:
            if tag in _ENDS_P and open_["p"] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in _SCOPE:
                        break
            if tag in _ENDS and any(open_[x] > 0 for x in _ENDS[tag][0]):
                ended, scope = _ENDS[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in scope:
                        break
                    if stack[i].tag in ended:
                        close(i)
            node = Node(tag, stack[-1])
            beside = _is_aside(tag, attrs, open_["article"] > 0 or open_["main"] > 0)
            node.aside, node.named = beside == "yes", beside == "named"
            if node.named:
                named.append(node)
            stack[-1].kids.append(node)
            if tag in _RAW and tag not in _VOID:
                found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, end)
                at = found.end() if found else len(html)
            elif tag not in _VOID and not (attrs.endswith("/") and tag in ("svg", "path", "use")):
                stack.append(node)
                open_[tag] += 1
    if at < len(html):
        stack[-1].kids.append(unescape(html[at:]))
    _settle(named)
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes that are not aside, in page order, without recursion."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.aside:
            out.append(node)
            todo.extend(x for x in reversed(node.kids) if type(x) is Node)
    return out


def _unwrap(root: Node) -> None:
    """A form around the page is a container like others."""
    chars: dict[int, int] = {}
    forms: dict[int, Node] = {}
    total = 0
    todo: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    while todo:
        node, form, inside = todo.pop()
        if node.tag == "form" and node.aside and form is None:
            form = forms[id(node)] = node
        elif node.aside:
            continue
        inside = inside or node.tag in ("p", "pre", "article")
        for x in node.kids:
            if type(x) is Node:
                todo.append((x, form, inside))
            elif inside:
                size = len(x.strip())
                total += size
                if form is not None:
                    chars[id(form)] = chars.get(id(form), 0) + size
    for key, n in chars.items():
        if 2 * n > total:
            forms[key].aside = False


def _score(nodes: list[Node]) -> None:
    """Characters, commas and link characters of each node's own part of the tree, then the points."""
    for node in reversed(nodes):
        for x in node.kids:
            if type(x) is str:
                size = len(x) if not x.isspace() else 0
                node.chars += size
                node.commas += x.count(",") + x.count("，") + x.count("、")
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.commas += node.commas
    for node in nodes:
        loose = node.tag in ("div", "section", "article", "main", "body", "td", "#root") and any(type(x) is str and not x.isspace() for x in node.kids)
        if node.tag not in ("p", "pre", "blockquote") and not loose:
            continue
        if loose:  # only what stands in it without a paragraph
            text = "".join(x for x in node.kids if type(x) is str)
            chars, commas, linked = len(text.strip()), text.count(","), 0
        else:
            chars, commas, linked = node.chars, node.commas, node.linked
        if not chars:
            continue
        points = (min(chars / 100.0, 3.0) + commas + (1.0 if chars >= 25 else 0.0)) * (1 - linked / max(chars, linked))
        up, level = (node if loose else node.parent), 0
        while up is not None and level < REACH:
            up.points += points / (1.0, 2.0)[level] if level < 2 else points / (3.0 * level)
            up, level = up.parent, level + 1


def _final(node: Node) -> float:
    return node.points * (1 - node.linked / max(1, node.chars))


def _blocks(node: Node, out: list[str]) -> None:
    """The blocks of a part of the tree: text between starts and ends of block elements."""
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif type(x) is str:
            held.append(x)
        elif not x.aside:
            if x.tag in ("br", "td", "th", "img", "wbr"):
                held.append("" if x.tag == "wbr" else " ")
            if x.tag in _BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.kids))
    flush()


def main_text(html: str | None) -> str:
    if not html or html.isspace():
        return ""
    root = parse(html)
    _unwrap(root)
    nodes = _walk(root)
    _score(nodes)
    boxes = [x for x in nodes if x.chars and (x.tag in _BOXES or x.tag in ("td", "blockquote") and any(type(y) is Node and y.tag in ("p", "div") for y in x.kids))]
    if not boxes:
        return ""
    best = max(boxes, key=_final)  # the first of equals: the outer one
    for whole in ("article", "main"):  # a part of a marked article stands for all of it
        up = best
        while up is not None and up.tag != whole:
            up = up.parent
        if up is not None:
            best = up
            break
    kept = [best]
    if best.parent is not None:
        least = max(10.0, 0.2 * _final(best))
        for x in best.parent.kids:
            if type(x) is Node and x is not best and not x.aside:
                density = x.linked / max(1, x.chars)
                if x.tag in _BLOCK and _final(x) >= least or x.tag == "p" and (x.chars > 80 and density < 0.25 or 0 < x.chars <= 80 and not x.linked):
                    kept.append(x)
                elif x.tag in ("h1", "h2", "h3") and x.chars and not x.linked:
                    kept.append(x)
        chosen = {id(x) for x in kept}
        kept = [x for x in best.parent.kids if id(x) in chosen]
        # parts of the text may stand in other branches
        up = best.parent
        while up.parent is not None and up.tag not in ("article", "main"):
            before = [x for x in up.parent.kids if type(x) is Node]
            at = next(i for i, x in enumerate(before) if x is up)
            also = [not x.aside and x.tag in _BLOCK and _final(x) >= max(2.0, 0.2 * _final(best)) and x.linked < 0.25 * x.chars for x in before]
            kept = [x for i, x in enumerate(before) if i < at and also[i]] + kept + [x for i, x in enumerate(before) if i > at and also[i]]
            up = up.parent
    out: list[str] = []
    for x in kept:
        _blocks(x, out)
    return "\n".join(out)


def extracted(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages, its html column replaced by the main text."""
    names = [c for c in pages.columns if c not in (html_col, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [main_text(x) for x in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*names, out])

    from pyspark.sql.types import StringType, StructType

    schema = StructType([f for f in pages.schema.fields if f.name in names]).add(out, StringType())
    return pages.select(*names, F.col(html_col).cast("string").alias("_html")).mapInArrow(run, schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the main text of every page."""
    pages = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
