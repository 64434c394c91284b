"""Word documents (zip of XML parts) to typed blocks, in Arrow batches over Spark's binary file source."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html import escape
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
PIC = "{http://schemas.openxmlformats.org/drawingml/2006/picture}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"

BLOCK = "struct<type:string,level:int,text:string,html:string,style:string,num_id:string,num_fmt:string,start:int,page:int,source_paragraph:int,n_rows:int,columns:int,src:string,width:double,height:double,n_math:int,placement:string,caption:string,label:string,text_labels:array<string>>"
FIELDS = [f.split(":")[0] for f in BLOCK[7:-1].split(",")]
#: Pixels are 9525 of a drawing's units; a text box of so many characters, or with such a beginning, is content and no label (fixed values).
EMU = 9525
SUBSTANTIVE = 170
NOTE = re.compile(r"(?i)(Πυκνότητα!|Σχόλιο|Παρατήρηση|Θυμήσου|Να πάρεις υπόψη|Η εξίσωση Schrödinger)")
CAPTION = re.compile(r"(?i)(Εικόνα|Σχήμα|Γράφημα|Figure|Fig\.|Graph)\s*\d*")
MARKS = [("b", "strong"), ("i", "em"), ("u", "u")]


def val(node: ET.Element | None, path: str) -> str | None:
    found = None if node is None else node.find(path)
    return None if found is None else found.get(W + "val")


def on(node: ET.Element | None, name: str) -> bool:
    """A toggle property: present and not switched off."""
    found = None if node is None else node.find(W + name)
    return found is not None and (found.get(W + "val") or "1") not in ("0", "false", "off", "none")


# --- math ------------------------------------------------------------------------------------------

TAG = lambda name, *kids: f"<{name}>{''.join(kids)}</{name}>"


def part(node: ET.Element, name: str) -> str:
    found = node.find(M + name)
    return TAG("mrow", *(math(k) for k in found)) if found is not None else TAG("mrow")


def prop(node: ET.Element, holder: str, name: str, default: str) -> str:
    found = node.find(f"{M}{holder}/{M}{name}")
    return default if found is None else found.get(M + "val") or default


def run_math(node: ET.Element) -> str:
    text = "".join(t.text or "" for t in node.iter(M + "t"))
    kinds = re.findall(r"[0-9]+(?:[.,][0-9]+)?|[^\W\d_]+|\S", text)
    return "".join(TAG("mn" if k[0].isdigit() else "mi" if k[0].isalpha() else "mo", escape(k)) for k in kinds)


def delimited(node: ET.Element) -> str:
    a, b = prop(node, "dPr", "begChr", "("), prop(node, "dPr", "endChr", ")")
    inner = TAG("mo", ",").join(TAG("mrow", *(math(k) for k in e)) for e in node.findall(M + "e"))
    return TAG("mrow", TAG("mo", escape(a)), inner, TAG("mo", escape(b)))


def nary(node: ET.Element) -> str:
    sign = TAG("mo", prop(node, "naryPr", "chr", "∫"))
    return TAG("mrow", TAG("munderover", sign, part(node, "sub"), part(node, "sup")), part(node, "e"))


def radical(node: ET.Element) -> str:
    degree = node.find(M + "deg")
    return TAG("mroot", part(node, "e"), part(node, "deg")) if degree is not None and len(degree) else TAG("msqrt", part(node, "e"))


def matrix(node: ET.Element) -> str:
    return TAG("mtable", *(TAG("mtr", *(TAG("mtd", *(math(k) for k in e)) for e in mr.findall(M + "e"))) for mr in node.findall(M + "mr")))


def stacked(name: str, *parts: str) -> Callable[[ET.Element], str]:
    return lambda node: TAG(name, *(part(node, p) for p in parts))


MATH: dict[str, Callable[[ET.Element], str]] = {
    "r": run_math,
    "f": stacked("mfrac", "num", "den"),
    "rad": radical,
    "sSub": stacked("msub", "e", "sub"),
    "sSup": stacked("msup", "e", "sup"),
    "sSubSup": stacked("msubsup", "e", "sub", "sup"),
    "sPre": stacked("mmultiscripts", "e", "sub", "sup"),
    "d": delimited,
    "nary": nary,
    "func": stacked("mrow", "fName", "e"),
    "limLow": stacked("munder", "e", "lim"),
    "limUpp": stacked("mover", "e", "lim"),
    "acc": lambda n: TAG("mover", part(n, "e"), TAG("mo", prop(n, "accPr", "chr", "^"))),
    "bar": lambda n: TAG("mover" if prop(n, "barPr", "pos", "top") == "top" else "munder", part(n, "e"), TAG("mo", "¯")),
    "groupChr": lambda n: TAG("munder", part(n, "e"), TAG("mo", prop(n, "groupChrPr", "chr", "⏟"))),
    "m": matrix,
    "eqArr": lambda n: TAG("mtable", *(TAG("mtr", TAG("mtd", *(math(k) for k in e))) for e in n.findall(M + "e"))),
}


def math(node: ET.Element) -> str:
    """MathML of an OMML node; property nodes say nothing, unknown ones speak through their children."""
    name = node.tag.split("}")[-1]
    if name.endswith("Pr"):
        return ""
    return MATH[name](node) if name in MATH else "".join(math(k) for k in node)


# --- parts -----------------------------------------------------------------------------------------


class Package:
    """The parts of a document that blocks depend on."""

    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            self.read = lambda n: ET.fromstring(z.read(n)) if n in names else None
            self.document = self.read("word/document.xml")
            styles, numbering, rels = (self.read(f"word/{n}") for n in ("styles.xml", "numbering.xml", "_rels/document.xml.rels"))
        self.styles = {s.get(W + "styleId"): (val(s, W + "name") or "", val(s, W + "basedOn"), val(s, f"{W}pPr/{W}outlineLvl")) for s in ([] if styles is None else styles.iter(W + "style"))}
        self.rels = {r.get("Id"): r.get("Target") for r in ([] if rels is None else rels)}
        self.numbering = {}
        if numbering is not None:
            abstract = {}
            for n in numbering.findall(W + "abstractNum"):
                abstract[n.get(W + "abstractNumId")] = {lv.get(W + "ilvl"): (val(lv, W + "numFmt") or "decimal", int(val(lv, W + "start") or 1)) for lv in n.findall(W + "lvl")}
            for n in numbering.findall(W + "num"):
                levels = dict(abstract.get(val(n, W + "abstractNumId"), {}))
                for o in n.findall(W + "lvlOverride"):
                    at = o.get(W + "ilvl")
                    start = val(o, W + "startOverride")
                    if start is not None:
                        levels[at] = (levels.get(at, ("decimal", 1))[0], int(start))
                self.numbering[n.get(W + "numId")] = levels

    def heading(self, style: str | None) -> int | None:
        """Level of a heading style: from its name 'heading N', else its outline level plus one, up the chain."""
        seen = set()
        while style in self.styles and style not in seen:
            seen.add(style)
            name, up, outline = self.styles[style]
            if m := re.match(r"(?i)heading\s+([1-9])", name):
                return int(m[1])
            if outline is not None and int(outline) < 9:
                return int(outline) + 1
            style = up
        return None


def within(node: ET.Element, *without: str) -> Iterator[ET.Element]:
    """A node and what lies in it, but not inside elements of the given tags and not in the fallbacks of newer content."""
    stack = [node]
    while stack:
        at = stack.pop()
        yield at
        stack += reversed([k for k in at if k.tag != MC + "Fallback" and k.tag not in without])


def extent(node: ET.Element | None) -> tuple[float, float] | None:
    """Width and height in pixels; None where either is missing or nothing."""
    size = [] if node is None else [round(float(node.get(k) or 0) / EMU, 4) for k in ("cx", "cy")]
    return (size[0], size[1]) if size and min(size) > 0 else None


def pictures(run: ET.Element, pack: Package) -> list[dict]:
    """The images of a run. In a group the drawing's extent is that of the whole group, so a picture's own transform comes first."""
    out = []
    for drawing in (d for d in within(run) if d.tag in (W + "drawing", W + "pict")):
        around = extent(next((e for e in within(drawing, W + "txbxContent") if e.tag == WP + "extent"), None))
        anchor = next((e for e in within(drawing, W + "txbxContent") if e.tag == WP + "anchor"), None)
        side = (anchor.findtext(f"{WP}positionH/{WP}align") or "").strip().lower() if anchor is not None else ""
        placement = "wide" if anchor is None else "float-left" if side in ("left", "inside") else "float-right"
        held = [(pic, e) for pic in within(drawing, W + "txbxContent") if pic.tag == PIC + "pic" for e in within(pic) if e.tag == A + "blip"]
        own = {id(e) for _, e in held}
        held += [(None, e) for e in within(drawing, W + "txbxContent") if e.tag == A + "blip" and id(e) not in own]
        for pic, blip in held:
            size = (extent(pic.find(f"{PIC}spPr/{A}xfrm/{A}ext")) if pic is not None else None) or around or (None, None)
            if target := pack.rels.get(blip.get(R + "embed")):
                out.append({"src": target, "width": size[0], "height": size[1], "placement": placement})
    return out


def text_boxes(p: ET.Element, pack: Package) -> list[dict]:
    """The text boxes that lie in a paragraph, boxes in boxes too, each text once: (text, html, caption?, substantive?, label)."""
    out, seen = [], set()
    for box in (b for b in within(p) if b.tag == W + "txbxContent"):
        own = [paragraph(k, pack) for k in within(box, W + "txbxContent") if k.tag == W + "p"]
        text = re.sub(r"\s+", " ", " ".join(t for t, *_ in own)).strip()
        if not text or text.casefold() in seen:
            continue
        seen.add(text.casefold())
        caption = bool(CAPTION.match(text))
        label = re.match(r"([^.!?]{2,45}[!?:])\s+", text)
        out.append({"text": text, "html": "<br>".join(h for _, h, *_ in own if h), "caption": caption, "substantive": not caption and (len(text) >= SUBSTANTIVE or bool(NOTE.match(text))), "label": label[1] if label else None, "n_math": sum(n for _, _, n, *_ in own)})
    return out


def paragraph(p: ET.Element, pack: Package) -> tuple[str, str, int, bool, list[dict]]:
    """(text, html, math objects, a page break before or in it, images)."""
    text, html, images, n_math, broke = [], [], [], 0, on(p.find(W + "pPr"), "pageBreakBefore")
    stack = list(reversed(list(p)))
    while stack:
        node = stack.pop()
        if node.tag == W + "r":
            props = node.find(W + "rPr")
            part_ = "".join("\t" if k.tag == W + "tab" else "\n" if k.tag == W + "br" else (k.text or "") for k in node if k.tag in (W + "t", W + "tab") or (k.tag == W + "br" and k.get(W + "type") != "page"))
            broke |= any(k.tag == W + "br" and k.get(W + "type") == "page" or k.tag == W + "lastRenderedPageBreak" for k in node)
            out = escape(part_)
            for mark, name in MARKS:
                out = TAG(name, out) if out and on(props, mark) else out
            vert = val(props, W + "vertAlign")
            out = TAG({"superscript": "sup", "subscript": "sub"}[vert], out) if out and vert in ("superscript", "subscript") else out
            text.append(part_)
            html.append(out)
            images += pictures(node, pack)
        elif node.tag in (M + "oMath", M + "oMathPara"):
            n_math += 1 if node.tag == M + "oMath" else len(node.findall(M + "oMath"))
            html.append(f'<math xmlns="http://www.w3.org/1998/Math/MathML">{math(node)}</math>')
        elif node.tag in (W + "hyperlink", W + "ins", W + "smartTag", W + "sdt", W + "sdtContent"):
            stack += reversed(list(node))
    return "".join(text).strip(), "".join(html), n_math, broke, images


def blocks(content: bytes | None) -> list[dict]:
    """Blocks of a document in order, with page numbers from its breaks. A file that is no document has none."""
    try:
        pack = Package(content or b"")
    except (zipfile.BadZipFile, ET.ParseError, KeyError):
        return []
    if pack.document is None:
        return []
    out, page = [], 1
    for at, node in enumerate(pack.document.find(W + "body") or []):
        if node.tag == W + "p":
            text, html, n_math, broke, images = paragraph(node, pack)
            page += broke
            props = node.find(W + "pPr")
            style, num = val(props, W + "pStyle"), val(props, f"{W}numPr/{W}numId")
            level = pack.heading(style)
            base = {"page": page, "source_paragraph": at, "style": style, "n_math": n_math}
            if text or n_math:
                if level:
                    out.append(base | {"type": "part_title" if level == 1 else "section_heading", "level": level, "text": text, "html": html})
                elif num and num != "0":
                    lv = val(props, f"{W}numPr/{W}ilvl") or "0"
                    fmt, start = pack.numbering.get(num, {}).get(lv, ("decimal", 1))
                    out.append(base | {"type": "list_item", "level": int(lv), "text": text, "html": html, "num_id": num, "num_fmt": fmt, "start": start})
                else:
                    out.append(base | {"type": "equation" if n_math == 1 and not text else "paragraph", "text": text, "html": html})
            boxes = text_boxes(node, pack)
            captions = [b["html"] or b["text"] for b in boxes if b["caption"]]
            labels = [b["text"] for b in boxes if not b["caption"] and not b["substantive"]]
            for k, image in enumerate(images):
                # Captions go to the images in their order; labels of a drawing go to its first image.
                out.append(base | {"type": "figure", "caption": captions[k] if k < len(captions) else None, "text_labels": labels if k == 0 else []} | image)
            out += [{"page": page, "source_paragraph": at, "type": "textbox", **{k: b[k] for k in ("text", "html", "label", "n_math")}} for b in boxes if b["substantive"]]
        elif node.tag == W + "tbl":
            rows = [[(" ".join(paragraph(p, pack)[0] for p in tc.iter(W + "p")).strip(), int(val(tc, f"{W}tcPr/{W}gridSpan") or 1)) for tc in tr.findall(W + "tc")] for tr in node.findall(W + "tr")]
            text = " · ".join(" | ".join(t for t, _ in r) for r in rows)
            out.append({"type": "table", "page": page, "source_paragraph": at, "n_rows": len(rows), "columns": max([1, *(sum(s for _, s in r) for r in rows)]), "text": text, "n_math": sum(1 for _ in node.iter(M + "oMath"))})
    return out


def _blocks(content: pd.Series) -> pd.Series:
    return pd.Series([[{f: b.get(f) for f in FIELDS} for b in blocks(c)] for c in content])


def docx_to_blocks(content: Column) -> Column:
    return F.pandas_udf(_blocks, f"array<{BLOCK}>")(content)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, block_ord, block fields) of every .docx under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.posexplode(docx_to_blocks(F.col("content"))).alias("block_ord", "b")).select("path", "block_ord", "b.*")


def import_metrics(found: DataFrame) -> DataFrame:
    """Counters of an import: blocks by kind, figures, math objects, pages."""
    kind = lambda t: F.count_if(F.col("type") == t)
    headings = F.count_if(F.col("type").isin("part_title", "section_heading"))
    return found.groupBy("path").agg(F.count("*").alias("blocks"), headings.alias("headings"), kind("list_item").alias("list_items"), kind("table").alias("tables"), kind("figure").alias("figures"), F.sum("n_math").alias("math"), F.max("page").alias("pages"))
