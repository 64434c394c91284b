"""Raw HTML to typed blocks: a small tree out of the standard library's parser, then one walk over it."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "struct<type:string,level:int,text:string,list_type:string,start:int,n_items:int,n_rows:int,columns:int,src:string,alt:string,source_tag:string,source_index:int>"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Start tags that end an open paragraph (fixed values).
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
CONTAINERS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "ul", "ol", "table", "figure", "img", "section", "article", "div"}
DROPPED_TAGS = {"script", "style", "nav", "form", "iframe", "noscript", "button", "input", "template", "svg", "canvas"}
DROPPED_CLASSES = {"sidebar", "menu", "nav", "advertisement", "ads"}
SAME_END = {"li": {"ul", "ol"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += reversed(node.elements())

    def text(self, skip: frozenset = frozenset({"script", "style"})) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in skip:
                stack += reversed(x.kids)
        return re.sub(r"\s+", " ", "".join(out)).strip()

    def closed(self, names: set[str], within: set[str]) -> Node | None:
        node = self
        while node is not None and node.tag not in within:
            if node.tag in names:
                return node
            node = node.parent
        return None


class Builder(HTMLParser):
    """Builds Nodes; open paragraphs, list entries and table cells end where HTML says they do."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and (p := self.at.closed({"p"}, {"table", "td", "th", "button"})):
            self.at = p.parent
        if tag in SAME_END and (same := self.at.closed({tag} if tag not in ("td", "th", "dt", "dd") else {"td", "th"} if tag[0] == "t" else {"dt", "dd"}, SAME_END[tag])):
            self.at = same.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if found := self.at.closed({tag}, {"#root"}):
            self.at = found.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def number(x: str | None, default: int) -> int:
    try:
        return int(float(x or 0)) or default
    except (ValueError, OverflowError):
        return default


def tree(html: str | None) -> Node:
    b = Builder()
    b.feed(html or "")
    b.close()
    return b.root


def prune(node: Node) -> None:
    for x in list(node.walk()):
        gone = lambda k: isinstance(k, Node) and (k.tag == "aside" or DROPPED_CLASSES & set(k.attrs.get("class", "").split()) or k.attrs.get("aria-hidden") == "true")
        x.kids = [k for k in x.kids if not gone(k)]


def blocks(html: str | None, base: str | None = None) -> list[dict]:
    """Headings, paragraphs, lists, tables and figures in document order.

    The container is the first article, main or role=main, else the body; text
    of 25 characters or less outside of paragraphs is no block.
    """
    root = tree(html)
    home = next((x for x in root.walk() if x.tag in ("article", "main") or x.attrs.get("role") == "main"), None)
    home = home or next((x for x in root.walk() if x.tag == "body"), root)
    prune(home)
    out: list[dict] = []
    skip = frozenset(DROPPED_TAGS)
    count = 0

    def add(type_: str, node: Node, **more) -> None:
        out.append({"type": type_, "source_tag": node.tag, "source_index": count, **more})

    stack = list(reversed(home.elements()))
    while stack:
        node = stack.pop()
        count += 1
        name = node.tag
        if re.fullmatch(r"h[1-6]", name):
            if title := node.text():
                add("part_title" if name == "h1" else "section_heading", node, level=int(name[1]), text=title)
        elif name in ("p", "blockquote"):
            if node.text(skip) or any(x.tag in ("img", "math") for x in node.walk()):
                add("paragraph", node, text=node.text(skip))
        elif name in ("ul", "ol"):
            entries = [t for k in node.elements() if k.tag == "li" and (t := k.text(skip))]
            if entries:
                add("list", node, list_type=name, start=number(node.attrs.get("start"), 1), n_items=len(entries), text=" · ".join(entries))
        elif name == "table":
            rows = [r for tr in node.walk() if tr.tag == "tr" and (r := [c for c in tr.elements() if c.tag in ("td", "th")])]
            if rows:
                width = max(sum(number(c.attrs.get("colspan"), 1) for c in r) for r in rows)
                add("table", node, n_rows=len(rows), columns=max(1, width), text=" · ".join(" | ".join(c.text(skip) for c in r) for r in rows))
        elif name in ("figure", "img"):
            img = node if name == "img" else next((x for x in node.walk() if x.tag == "img"), None)
            if img is not None and img.attrs.get("src"):
                caption = next((x.text() for x in node.walk() if x.tag == "figcaption"), "") if name == "figure" else img.attrs.get("alt", "")
                add("figure", node, src=absolute(img.attrs["src"], base), alt=img.attrs.get("alt") or caption, text=caption)
        elif direct := [k for k in node.elements() if k.tag in CONTAINERS]:
            stack += reversed(direct)
        elif len(node.text(skip)) > 25:
            add("paragraph", node, text=node.text(skip))
    return out


def absolute(url: str, base: str | None) -> str:
    if url.startswith("data:") or not base:
        return url
    try:
        return urljoin(base, url)
    except ValueError:
        return url


FIELDS = [f.split(":")[0] for f in BLOCK[7:-1].split(",")]


def _blocks(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([[{f: b.get(f) for f in FIELDS} for b in blocks(h, u)] for h, u in zip(html, base, strict=True)])


def html_to_blocks(html: Column, base: Column) -> Column:
    """The typed blocks of each HTML text as an array of structs; urls are resolved against `base`."""
    return F.pandas_udf(_blocks, f"array<{BLOCK}>")(html, base)


def block_rows(pages: DataFrame, key: str, html: str = "html", base: str = "url") -> DataFrame:
    """One row for each block with its ordinal; a page without blocks has none."""
    return pages.select(key, F.posexplode(html_to_blocks(F.col(html), F.col(base))).alias("block_ord", "b")).select(key, "block_ord", "b.*")
