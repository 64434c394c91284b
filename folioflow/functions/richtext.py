"""Rich text as array<struct> runs: atoms that keep marks, splitting, collapsing, plain text, HTML out, HTML in."""

from __future__ import annotations

import re
from html import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import atoms as text_atoms
from folioflow.functions.text import escape_html
from folioflow.sources.html_blocks import Node, tree

MARKS = ["bold", "italic", "underline", "superscript", "subscript", "color", "highlight"]
#: Marks from the outermost HTML element to the innermost.
NESTING = [("bold", "strong"), ("italic", "em"), ("underline", "u"), ("superscript", "sup"), ("subscript", "sub")]
RUN = "struct<type:string,text:string,bold:boolean,italic:boolean,underline:boolean,superscript:boolean,subscript:boolean,color:string,highlight:string,href:string>"
FIELDS = [f.split(":")[0] for f in RUN[7:-1].split(",")]


def explode_runs(nodes: Column) -> Column:
    """Every text run as its atoms, each with the run's marks; other nodes stay whole."""
    split = F.transform(nodes, lambda n: F.when(n["type"] == "text_run", F.transform(text_atoms(n["text"]), lambda t: n.withField("text", t))).otherwise(F.array(n)))
    return F.flatten(split)


def collapse_runs(atoms: Column) -> Column:
    """Neighbouring text runs with equal marks become one run."""
    same = lambda a, b: F.reduce(F.array(*[a[m].eqNullSafe(b[m]).cast("int") for m in [*MARKS, "href"]]), F.lit(1), lambda x, y: x * y) == 1

    def add(done, atom):
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (last["type"] == "text_run") & (atom["type"] == "text_run") & same(last, atom)
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(last.withField("text", F.concat(last["text"], atom["text"]))))
        return F.when(joins, grown).otherwise(F.concat(done, F.array(atom)))

    return F.aggregate(atoms, F.filter(atoms, lambda a: F.lit(False)), add)


def split_runs(nodes: Column, units: int) -> tuple[Column, Column]:
    """(first, rest) at `units` atoms; white space at the seam goes."""
    atoms = explode_runs(nodes)
    trim = lambda part, at, pattern: F.filter(F.transform(part, lambda n, i: F.when((i == at) & (n["type"] == "text_run"), n.withField("text", F.regexp_replace(n["text"], pattern, ""))).otherwise(n)), lambda n: (n["type"] != "text_run") | (n["text"] != ""))
    first, rest = F.slice(atoms, 1, units), F.slice(atoms, units + 1, F.greatest(F.size(atoms), F.lit(1)))
    return collapse_runs(trim(first, F.size(first) - 1, r"\s+$")), collapse_runs(trim(rest, F.lit(0), r"^\s+"))


def plain_text(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: F.when(n["type"] == "line_break", "\n").otherwise(F.coalesce(n["text"], F.lit("")))), "")


def to_html(nodes: Column) -> Column:
    """HTML of runs; marks nest in one fixed order, links stand around them."""

    def one(n):
        out = escape_html(F.coalesce(n["text"], F.lit("")))
        style = F.concat_ws(";", F.when(n["color"].isNotNull(), F.concat(F.lit("color:"), n["color"])), F.when(n["highlight"].isNotNull(), F.concat(F.lit("background-color:"), n["highlight"])))
        out = F.when(style != "", F.concat(F.lit('<span style="'), style, F.lit('">'), out, F.lit("</span>"))).otherwise(out)
        for mark, name in reversed(NESTING):
            out = F.when(F.coalesce(n[mark], F.lit(False)), F.concat(F.lit(f"<{name}>"), out, F.lit(f"</{name}>"))).otherwise(out)
        out = F.when(n["href"].isNotNull(), F.concat(F.lit('<a href="'), escape_html(n["href"]), F.lit('">'), out, F.lit("</a>"))).otherwise(out)
        return F.when(n["type"] == "line_break", "<br>").otherwise(out)

    return F.array_join(F.transform(nodes, one), "")


TAG_MARKS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "sup": "superscript", "sub": "subscript"}


def runs(html: str | None) -> list[dict]:
    """Marked runs, links and breaks of an HTML fragment; breaks at the edges go, equal neighbours join."""
    out: list[dict] = []

    def visit(node: Node, marks: dict) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                text = re.sub(r"\s+", " ", kid)
                if text and out and out[-1]["type"] == "text_run" and {k: v for k, v in out[-1].items() if k not in ("type", "text")} == marks:
                    out[-1]["text"] += text
                elif text:
                    out.append({"type": "text_run", "text": text, **marks})
            elif kid.tag == "br":
                out.append({"type": "line_break"})
            elif kid.tag not in ("script", "style"):
                more = dict(marks)
                if kid.tag in TAG_MARKS:
                    more[TAG_MARKS[kid.tag]] = True
                if kid.tag == "a" and "href" not in marks and kid.attrs.get("href"):
                    more["href"] = kid.attrs["href"]
                if more.get("superscript"):
                    more.pop("subscript", None)
                visit(kid, more)

    visit(tree(html), {})
    while out and out[0]["type"] == "line_break":
        out.pop(0)
    while out and out[-1]["type"] == "line_break":
        out.pop()
    return out


def _runs(html: pd.Series) -> pd.Series:
    return pd.Series([[{f: r.get(f) for f in FIELDS} for r in runs(h)] for h in html])


def from_html(html: Column) -> Column:
    return F.pandas_udf(_runs, f"array<{RUN}>")(html)


ALLOWED_STYLE = {"color", "background-color", "font-weight", "font-style", "text-decoration", "text-align", "vertical-align"}
REMOVED = {"script", "style", "nav", "form", "iframe", "noscript", "button", "input", "template", "object", "embed"}


def cleaned(html: str | None) -> str:
    """HTML without active content: listed tags, on* and srcdoc attributes and javascript: urls go, styles keep a few properties."""

    def of(node: Node) -> str:
        inner = "".join(escape(k, quote=False) if isinstance(k, str) else of(k) for k in node.kids)
        if node.tag == "#root":
            return inner
        if node.tag in REMOVED:
            return ""
        attrs = []
        for k, v in node.attrs.items():
            if k.startswith("on") or k == "srcdoc" or v.strip().lower().startswith("javascript:"):
                continue
            if k == "style":
                v = ";".join(p.strip() for p in v.split(";") if p.split(":")[0].strip().lower() in ALLOWED_STYLE)
                if not v:
                    continue
            attrs.append(f' {k}="{escape(v)}"')
        return f"<{node.tag}{''.join(attrs)}>" + ("" if node.tag in ("br", "img", "hr") else f"{inner}</{node.tag}>")

    return of(tree(html))


def _cleaned(html: pd.Series) -> pd.Series:
    return html.map(cleaned)


def clean_html(html: Column) -> Column:
    return F.pandas_udf(_cleaned, "string")(html)
