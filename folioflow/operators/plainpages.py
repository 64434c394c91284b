"""Legacy pages of plain content rewritten in Arrow batches: what migration.rewritten() makes of them, at a fraction of its cost.

A page is plain when what it holds means the same to Spark's variants and casts and to Python: JSON both read alike, whole
numbers, no characters beyond the basic plane, and fields that are cast in a form that leaves no doubt. Any doubt raises Odd;
such a page is handed back as it came, for migration.rewritten() to rewrite.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa

from folioflow.model import ITEM_TYPES, NAV_DEFAULT_TYPES
from folioflow.operators.paginate import PROSE
from folioflow.operators.validation import RICH_TEXT

#: A page of more characters is not plain.
LONGEST = 1 << 20
TEXTS = pa.list_(pa.string())
FIELDS = [
    ("page_id", pa.string()), ("_head", pa.string()), ("_ids", TEXTS), ("_bases", TEXTS), ("_items", TEXTS), ("rules", TEXTS), ("dropped", TEXTS), ("_odd", pa.string()),
]


class Odd(Exception):
    """A page that is not plain."""


def _object(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise Odd
    return found


def _whole(digits: str) -> int:
    if len(digits) > 15 or digits == "-0":
        raise Odd
    return int(digits)


def _refuse(_: str) -> object:
    raise Odd


_quoted = json.encoder.encode_basestring

_UNSURE = re.compile(r"[^\t\n\r -~\u00a0-\ud7ff]|\\u")
_NO_ID, _EDGES, _ID_START = re.compile(r"[^A-Za-z0-9_:\-.Ͱ-Ͽ]+"), re.compile(r"\A-+|-+\Z"), re.compile(r"[A-Za-z_Ͱ-Ͽ]")
_NO_SLUG, _MARKS = re.compile(r"[^a-z0-9Ͱ-Ͽ]+"), re.compile("[\u0300-\u036f]")
_BREAK, _TAG, _SPACES = re.compile(r"<br\s*/?\s*>", re.I | re.A), re.compile(r"<[^>]+>"), re.compile(r"\s+", re.A)
_ENTITIES = [(re.compile(name, re.I | re.A), char) for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))]
_NUMBER, _PLAIN_WORD = re.compile(r"(?:0|-?[1-9][0-9]{0,14})\Z"), re.compile(r"[a-z0-9./-]*\Z")
_YES, _NO = ("t", "true", "y", "yes", "1"), ("f", "false", "n", "no", "0")


def _text(x: object) -> str | None:
    """A text, number or boolean as text, as validation.loose() gives it."""
    if isinstance(x, str):
        return x
    if isinstance(x, bool):
        return "true" if x else "false"
    return str(x) if isinstance(x, int) else None


def _scalars(x: object) -> dict[str, str]:
    return {k: s for k, v in x.items() if (s := v if type(v) is str else _text(v)) is not None} if isinstance(x, dict) else {}


def _boolean(x: str | None) -> bool | None:
    if x is None or x in _NO or x in _YES:
        return None if x is None else x in _YES
    if not _PLAIN_WORD.match(x):
        raise Odd
    return None


def _number(x: str | None, digits: int = 15) -> int | None:
    if not x:
        return None
    if not _NUMBER.match(x) or len(x.lstrip("-")) > digits:
        raise Odd
    return int(x)


def _double(n: int) -> str:
    """A whole number as a double is written in Spark's JSON."""
    s, sign = str(abs(n)), "-" if n < 0 else ""
    return f"{sign}{s}.0" if len(s) < 8 else f"{sign}{s[0]}.{s[1:].rstrip('0') or '0'}E{len(s) - 1}"


def _id(x: str) -> str:
    t = _EDGES.sub("", _NO_ID.sub("-", x.strip(" ")))
    return t if not t or _ID_START.match(t) else f"id-{t}"


def _slug(x: str, size: int) -> str:
    if not x.isascii():
        if "Σ" in x:  # its lower case depends on what follows
            raise Odd
        x = _MARKS.sub("", unicodedata.normalize("NFD", x))
    return _EDGES.sub("", _NO_SLUG.sub("-", x.lower()))[:size] or "item"


def _html_text(x: str) -> str:
    if "<" in x:
        x = _TAG.sub(" ", _BREAK.sub("\n", x))
    if "&" in x:
        for name, char in _ENTITIES:
            x = name.sub(char, x)
    return _SPACES.sub(" ", x).strip(" ")


def rewriter(moves: list, texts: dict[str, tuple[str, ...]], whole: dict[str, tuple[str, ...]]) -> Callable[[str, int], tuple]:
    """A function of (JSON, number) of a plain page that gives the values of FIELDS but the last; the arguments are the tables of migration."""
    read = json.JSONDecoder(object_pairs_hook=_object, parse_int=_whole, parse_float=_refuse, parse_constant=_refuse).decode
    # Variants write the keys of an object in their order.
    written = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode
    known, nav_default, media_types, prose_types = set(ITEM_TYPES), set(NAV_DEFAULT_TYPES), {"figure", "scene"}, set(PROSE)
    laid_out = [m.to for m in moves if m.to.startswith("layout.")]
    above = {m.to: tuple(m.to.split(".")) if "." in m.to else ("", m.to) for m in moves}
    # Where a type has no use for a field, neither has its rule.
    moved_of = {t: [(m.name, m.to, *above[m.to], m.legacy) for m in moves if t in m.types] for t in known}
    texts_of = {t: [n for n, types in texts.items() if t in types] for t in known}
    whole_of = {t: [n for n, types in whole.items() if t in types] for t in known}

    def item(v: object, place: int, page_id: str, translated: bool, rules: list[str], dropped: list[str]) -> tuple[str, str, str]:
        """(given id, its base, JSON behind the id) of an item; the names of its rules and its dropped keys are appended."""
        it = v if isinstance(v, dict) else {}
        own = _scalars(it)
        levels = {"": own, "layout": _scalars(it["layout"]) if "layout" in it else {}, "nav": _scalars(it["nav"]) if "nav" in it else {}}
        raw = it.get("type")
        type_ = raw if isinstance(raw, str) and raw in known else "paragraph"
        at: dict[str, str | None] = {}
        for name, to, level, field, legacy in moved_of[type_]:
            x = levels[level].get(field)
            if x is None:
                for p in legacy:
                    if p in own:
                        x = own[p]
                        rules.append(name)
                        break
            at[to] = x
        given, prose, media = own.get("id", ""), type_ in prose_types, type_ in media_types
        rich = False
        if prose:
            body, html = it.get("body"), it.get("html")
            html = html if isinstance(html, str) else None
            rich = isinstance(body, dict) and body.get("format") == RICH_TEXT and isinstance(body.get("nodes"), list)
        id_, english = given and _id(given), sorted([k for k in it if k.endswith("_en")]) if translated else []
        if prose and not rich and "html" in it:
            rules.append("html-body")
        if not (isinstance(raw, str) and raw in known):
            rules.append("type-unknown")
        if given != "" and id_ != given:
            rules.append("id-normalised")
        if english:
            rules.append("translation-dropped")
            dropped += english

        shown = _boolean(at["nav.show"])
        shown, label = type_ in nav_default if shown is None else shown, at["nav.label"] or ""
        visible = it.get("visibility")
        if isinstance(visible, dict):
            screen, print_ = ("false" if visible.get(c) is False else "true" for c in ("screen", "print"))
            seen = f'{{"screen":{screen},"print":{print_}}}'
        else:
            seen = '{"screen":true,"print":true}'
        out = [f',"type":"{type_}","nav":{{"show":{"true" if shown else "false"},"label":{_quoted(label)}}},"visibility":{seen}']
        called = {"label": None, "title": None, "caption": None}
        for name in texts_of[type_]:
            if name in own:
                out.append(f'"{name}":{_quoted(own[name])}')
                called[name] = own[name]
        src = None
        if media:
            src = (at["src"] if type_ == "scene" else own.get("src")) or ""
            out.append(f'"src":{_quoted(src)}')
        if type_ == "section_heading":
            out.append(f'"level":{_number(at["level"], 9) or 2}')
        if media or type_ == "side_note" or (type_ == "interactive_callout" and any(at[to] is not None for to in laid_out)):
            placement = at["layout.placement"] or ("float-right" if media else "wide")
            wrap = _boolean(at["layout.wrap"])
            wrap = media or placement.startswith("float-") if wrap is None else wrap
            floats = at["layout.floatInteraction"] or ("wrap" if media and wrap else "")
            aspect = at["layout.aspectRatio"]
            aspect = ("16/9" if type_ == "scene" else "natural") if aspect is None else aspect
            sizes = [(n, _number(at[f"layout.{n}"])) for n in ("widthPx", "heightPx")]
            measured = "".join(f'"{n}":{_double(x)},' for n, x in sizes if x is not None)
            out.append(f'"layout":{{"placement":{_quoted(placement)},"wrap":{"true" if wrap else "false"},"floatInteraction":{_quoted(floats)},{measured}"aspectRatio":{_quoted(aspect)}}}')
        said = None
        if prose:
            if rich:
                first = body["nodes"][0] if body["nodes"] else None
                said = first.get("text") if isinstance(first, dict) else None
                if isinstance(said, dict | list):
                    raise Odd
                said = _text(said)
                out.append(f'"body":{written(body)}')
            else:
                said = _html_text(html) if html else ""
                node = f'{{"text":{_quoted(said)},"type":"text_run"}}' if said else ""
                out.append(f'"body":{{"format":"{RICH_TEXT}","nodes":[{node}]}}')
            kept = it.get("legacySourceHtml")
            kept = kept if isinstance(kept, str) else html
            if kept is not None:
                out.append(f'"legacySourceHtml":{_quoted(kept)}')
        for name in whole_of[type_]:
            if name in it:
                out.append(f'"{name}":{written(it[name])}')
        base = id_
        if not base:
            summary = next((t for x in (called["title"], label, called["label"], called["caption"], said, src) if x and (t := x.strip(" "))), type_)
            base = f"{page_id}-{type_}-{_slug(summary, 24)}-{place + 1}"
        return id_, base, ",".join(out) + "}"

    def rewrite(text: str, page: int) -> tuple:
        if len(text) > LONGEST or _UNSURE.search(text):
            raise Odd
        try:
            v = read(text)
        except (ValueError, RecursionError):
            raise Odd from None
        v = v if isinstance(v, dict) else {}
        own = _scalars(v)
        page_id = _id(own["id"]) if own.get("id") else f"page-{page + 1}"
        source = _number(next((own[c] for c in ("sourcePage", "sourceDocxPage", "pdfPage") if c in own), None), 9)
        sides = []
        for side in ("header", "footer"):
            held = v.get(side)
            if not isinstance(held, dict):
                sides.append(f'"{side}":{{"inherit":false,"left":"","center":"","right":""}}')
                continue
            inherit = held.get("inherit")
            if inherit is not None and not isinstance(inherit, bool):
                raise Odd
            said = ",".join(f'"{c}":{_quoted(_text(held.get(c)) or "")}' for c in ("left", "center", "right"))
            sides.append(f'"{side}":{{"inherit":{"true" if inherit else "false"},{said}}}')
        number = "" if source is None else f'"sourcePage":{source},'
        head = f'{{{number}{",".join(sides)},"pageNumbering":{{"inherit":true,"enabled":true,"offset":0,"hide":false}},"visibility":{{"screen":true,"print":true}}}}'
        rules: list[str] = []
        dropped: list[str] = []
        items = v.get("items") if isinstance(v.get("items"), list) else []
        translated = '_en"' in text
        made = [item(x, n, page_id, translated, rules, dropped) for n, x in enumerate(items)]
        return page_id, head, *([m[i] for m in made] for i in range(3)), rules, dropped

    return rewrite


def rewritten_batches(it: Iterator[pa.RecordBatch], rewrite: Callable[[str, int], tuple], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (keys, page, FIELDS) of batches of (keys, page, _json); pages that are not plain have their JSON as _odd, and null JSON becomes ''."""
    for batch in it:
        rows = []
        for text, page in zip(batch.column("_json").to_pylist(), batch.column("page").to_pylist(), strict=True):
            try:
                rows.append((*rewrite(text or "", page), None))
            except Odd:
                rows.append((*[None] * (len(FIELDS) - 1), text or ""))
        kept = [*keys, "page"]
        columns = zip(*rows, strict=True) if rows else [[]] * len(FIELDS)
        arrays = [pa.array(list(c), kind) for c, (_, kind) in zip(columns, FIELDS, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *arrays], [*kept, *(n for n, _ in FIELDS)])
