"""Readable content of web pages, with the standard library's parser: tree, title, links, content, sections."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_whitespace_py, strip_py
from ..functions.urls import resolve
from ..schemas import ARTICLE

# Headings, elements whose text is a block, elements that hold blocks.
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
TEXT_BLOCKS = frozenset("p li blockquote pre dd dt figcaption summary td th".split())
CONTAINERS = frozenset("div section article main aside header footer ul ol dl table tbody thead tr figure details".split())

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = CONTAINERS | frozenset(HEADINGS) | frozenset("p blockquote pre address form fieldset hr nav hgroup menu figcaption dir center".split())
#: What a start tag closes, and what it closes it in.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
_CLUTTER = frozenset("nav footer aside script style noscript template form iframe button svg".split())
_CLUTTER_NAMES = re.compile(r"(?i)(^|[\s_-])(ads?|advert\w*|banner|breadcrumbs?|comments?|cookie|menu|newsletter|promo|related|share|sidebar|social|sponsor\w*)($|[\s_-])")


class Node:
    __slots__ = ("tag", "attrs", "inside")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.inside: list[Node | str] = []

    def children(self) -> list[Node]:
        return [x for x in self.inside if isinstance(x, Node)]

    def text(self) -> str:
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.inside))
        return "".join(out)

    def all(self):
        todo: list[Node] = [self]
        while todo:
            x = todo.pop()
            yield x
            todo.extend(reversed(x.children()))

    def html(self) -> str:
        """Markup of what is inside."""
        out: list[str] = []
        todo: list[tuple[bool, Node | str]] = [(False, x) for x in reversed(self.inside)]
        while todo:
            end, x = todo.pop()
            if isinstance(x, str):
                out.append(escape(x, quote=False))
            elif end:
                out.append(f"</{x.tag}>")
            else:
                attrs = "".join(f' {k}="{escape(v)}"' for k, v in x.attrs.items() if k in ("href", "src", "alt", "title"))
                out.append(f"<{x.tag}{attrs}>")
                if x.tag not in _VOID:
                    todo.append((True, x))
                    todo.extend((False, y) for y in reversed(x.inside))
        return "".join(out)


class _Tree(HTMLParser):
    """Builds a tree from markup as found: implied end tags, elements without content, raw text."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "textarea", "iframe", "xmp", "noembed", "noframes")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def _close(self, tags, stop) -> None:
        """Closes the innermost open element of tags, unless one of stop is further in."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._close({"p"}, {"table", "td", "th", "button"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inside.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open[-1].tag == tag and tag in ("svg", "path"):
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in _VOID:
            return
        stop = set() if tag in _BLOCKS or tag in ("body", "html", "head") else {"td", "th", "table"}
        self._close({tag}, stop)

    def handle_data(self, data):
        self.open[-1].inside.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def find(root: Node, tag: str) -> Node | None:
    return next((x for x in root.all() if x.tag == tag), None)


def links(root: Node, base: str) -> list[str]:
    """Normalised links in document order, each once."""
    return list(dict.fromkeys(u for a in root.all() if a.tag == "a" and a.attrs.get("href") and (u := resolve(a.attrs["href"], base))))


def walk_sections(content_html: str, title: str) -> list[dict]:
    """Sections (path, text): headings set the path, blocks of text below them are joined by empty lines.

    Text that stands directly in a container, outside any block, counts only if the page has no section at all.
    """
    body = parse(content_html)
    body = find(body, "body") or body
    start = 1 if title else 0
    path: list[str | None] = [title] if title else []
    sections: list[dict] = []
    blocks: list[str] = []

    def flush() -> None:
        if text := normalize_whitespace_py("\n\n".join(blocks)):
            sections.append({"path": list(path), "text": text})
        blocks.clear()

    todo = [iter(body.children())]
    while todo:
        node = next(todo[-1], None)
        if node is None:
            todo.pop()
        elif node.tag in HEADINGS:
            flush()
            at = start + HEADINGS[node.tag] - 1
            path = path[:at] + [None] * (at - len(path)) + [strip_py(node.text())]
        elif node.tag in CONTAINERS:
            todo.append(iter(node.children()))
        elif text := strip_py(node.text()):
            blocks.append(text)
    flush()
    if not sections and (text := normalize_whitespace_py(body.text())):
        sections.append({"path": list(path), "text": text})
    return sections


def _cluttered(node: Node) -> bool:
    return node.tag in _CLUTTER or bool(_CLUTTER_NAMES.search(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}")) and node.tag not in ("html", "body", "article", "main")


def _cleaned(node: Node) -> Node:
    todo = [node]
    while todo:
        x = todo.pop()
        x.inside = [y for y in x.inside if isinstance(y, str) or not _cluttered(y)]
        todo.extend(x.children())
    return node


#: Characters below which a block says nothing, and from which it counts in full: a comment is short, a paragraph is not.
_LEAST, _FULL = 25, 200


def best_block(body: Node) -> Node:
    """The element that holds the reading matter of a page that doesn't name it.

    Each block of text weighs by its length outside links, the less the shorter it is and the more of it is links. Its weight
    goes to the element that holds it, half of it to the one around that, and so on. An element's score is what it was given,
    times the share of its text that is outside links; the best scores highest, the outer of two that score alike.
    """
    order: list[tuple[Node, int]] = []  # elements, each after the one around it, and that one's place
    todo = [(body, -1)]
    while todo:
        node, above = todo.pop()
        order.append((node, above))
        todo.extend((x, len(order) - 1) for x in reversed(node.children()))
    length, linked = [0] * len(order), [0] * len(order)
    for k in range(len(order) - 1, -1, -1):
        node, above = order[k]
        length[k] += sum(len(strip_py(x)) for x in node.inside if isinstance(x, str))
        if node.tag == "a":
            linked[k] = length[k]
        if above >= 0:
            length[above] += length[k]
            linked[above] += linked[k]
    given = [0.0] * len(order)
    for k, (node, above) in enumerate(order):
        bare = node.tag in CONTAINERS and any(isinstance(x, str) and len(strip_py(x)) >= _LEAST for x in node.inside)
        n = length[k]
        if n < _LEAST or not (node.tag in TEXT_BLOCKS or bare) or any(x.tag in CONTAINERS | TEXT_BLOCKS for x in node.children()):
            continue
        weight = (n - linked[k]) * (1 - linked[k] / n) * min(1.0, n / _FULL)
        at = k if bare else above
        while at >= 0 and weight >= 1:
            given[at] += weight
            at, weight = order[at][1], weight / 2
    scores = [g * (1 - linked[k] / length[k]) if length[k] else 0.0 for k, g in enumerate(given)]
    best = max(range(len(order)), key=lambda k: (order[k][0].tag in CONTAINERS or k == 0, scores[k], -k))
    return order[best][0] if scores[best] > 0 else body


def _meta(root: Node, *names: str) -> str | None:
    for name in names:
        for x in root.all():
            if x.tag == "meta" and name in (x.attrs.get("name", "").lower(), x.attrs.get("property", "").lower()) and (v := strip_py(x.attrs.get("content"))):
                return v
    return None


def read_article(url: str, html: str | None) -> dict:
    """What a reader sees of a page. error tells why there is nothing: no markup, or no readable text."""
    root = parse(html or "")
    found = links(root, url)
    title_node = find(root, "title")
    title = _meta(root, "og:title") or (re.sub(r"\s+", " ", strip_py(title_node.text())) if title_node else "") or url
    byline = _meta(root, "author", "article:author") or next((t for x in root.all() if (x.attrs.get("rel") == "author" or "byline" in x.attrs.get("class", "").split()) and (t := strip_py(x.text()))), None)
    site = _meta(root, "og:site_name")
    body = _cleaned(find(root, "body") or root)
    content = find(body, "article") or find(body, "main") or best_block(body)
    text = content.text()
    readable = bool(strip_py(text))
    return {
        "url": url, "title": title, "byline": byline, "site_name": site, "content_html": content.html() if readable else None, "text_content": text if readable else None,
        "links": found, "error": None if readable else "Nothing readable on this page",
    }


_ARROW = pa.schema([(n, pa.list_(pa.string()) if n == "links" else pa.string()) for n in ("url", "title", "byline", "site_name", "content_html", "text_content", "links", "error")])
_SECTIONS = pa.list_(pa.struct([("path", pa.list_(pa.string())), ("text", pa.string())]))


#: Pages that are parsed before what was read of them is handed on: trees and strings of so many are held at once.
SLICE = 64


def _read(batches, failed: bool):
    for b in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
        errors = b.column("error").to_pylist() if failed else [None] * b.num_rows
        rows = [dict.fromkeys(_ARROW.names) | {"url": u, "error": e} if e else read_article(u, h) for u, h, e in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), errors, strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def read_articles(pages: DataFrame) -> DataFrame:
    """Articles of pages (url, html; error of those that couldn't be fetched), in Arrow batches; parsing is what native
    expressions can't do."""
    failed = "error" in pages.columns
    return pages.select("url", "html", *(["error"] if failed else [])).mapInArrow(lambda batches: _read(batches, failed), ARTICLE)


def sections_of(content_html, title, text_content=None):
    """Sections of an article as a column: from its markup or, where there is none, its plain text under its title."""

    def run(htmls: pa.Array, titles: pa.Array, plain: pa.Array) -> pa.Array:
        def some(k: int) -> pa.Array:
            rows = zip(*(a.slice(k, SLICE).to_pylist() for a in (htmls, titles, plain)), strict=True)
            return pa.array([walk_sections(h, t or "") if h else [{"path": [t], "text": normalize_whitespace_py(p or "")}] for h, t, p in rows], _SECTIONS)

        return pa.concat_arrays([some(k) for k in range(0, len(htmls), SLICE)] or [pa.array([], _SECTIONS)])

    plain = F.lit(None).cast("string") if text_content is None else F.col(text_content)
    return F.arrow_udf(run, "array<struct<path: array<string>, text: string>>")(F.col(content_html), F.col(title), plain)
