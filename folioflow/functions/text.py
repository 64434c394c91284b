"""Scalar text functions as Column expressions; they stay inside whole-stage code generation."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of texts: Greek first, then Latin, whatever their case and marks.
COLLATION = "el_CI_AI"


def blank_to_null(x: Column) -> Column:
    t = F.trim(x)
    return F.when(t != "", t)


def first_nonblank(*xs: Column) -> Column:
    return F.coalesce(*[blank_to_null(x) for x in xs])


def _unmarked(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", v)))


def unmarked(x: Column) -> Column:
    """The canonical decomposition without its combining marks. Only texts beyond ASCII go to Python, in Arrow batches."""
    wide = x.rlike(r"[^\x00-\x7F]")
    return F.coalesce(F.pandas_udf(_unmarked, "string")(F.when(wide, x)), x)


def slugify(x: Column, size: int = 60, default: str = "item") -> Column:
    """Marks dropped, lower case, runs of anything but a-z, 0-9 and Greek become one hyphen, trimmed and cut."""
    low = F.lower(unmarked(x))
    cut = F.left(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9Ͱ-Ͽ]+", "-"), r"^-+|-+$", ""), F.lit(size))
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit(default)).otherwise(cut)


def normalize_id(x: Column) -> Column:
    """Trimmed, what no id may hold as hyphens, prefixed where it does not start with a letter; '' where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.trim(x), r"[^A-Za-z0-9_:\-.Ͱ-Ͽ]+", "-"), r"^-+|-+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", "").when(t.rlike(r"^[A-Za-z_Ͱ-Ͽ]"), t).otherwise(F.concat(F.lit("id-"), t))


def html_text(x: Column) -> Column:
    """Tags become spaces, the named entities are decoded in this order, white space collapses."""
    t = F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?\s*>", "\n"), r"<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = F.regexp_replace(t, f"(?i){name}", char)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def escape_html(x: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def atoms(x: Column) -> Column:
    """A word with the white space after it, or leading white space: the units that rich text is split at."""
    return F.regexp_extract_all(x, F.lit(r"(\S+\s*|\s+)"), 1)


def parse_aspect(x: Column) -> Column:
    """'16/9' to 1.777..., '1.44' to 1.44, 'natural' and nonsense to null."""
    w, h = (F.regexp_extract(x, r"^\s*([0-9]*\.?[0-9]+)\s*[/:]\s*([0-9]*\.?[0-9]+)\s*$", i).try_cast("double") for i in (1, 2))
    plain = F.trim(x).try_cast("double")
    return F.when((w > 0) & (h > 0), w / h).when(plain > 0, plain)


def natural_key(x: Column) -> Column:
    """A collated text whose order is natural: digit runs, of any size and without leading zeros, stand behind their length; case and marks have no say.

    The rest is left to Spark's Greek collation, so every letter with marks sorts by its base letter.
    """
    runs = F.regexp_extract_all(x, F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def key(r: Column) -> Column:
        bare = F.regexp_replace(r, "^0+(?=[0-9])", "")
        return F.when(r.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare).cast("string"), 10, "0"), bare)).otherwise(r)

    return F.collate(F.array_join(F.transform(runs, key), ""), COLLATION)


def valid_hex(x: Column) -> Column:
    return F.when(x.rlike(r"^#?[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), F.upper(F.replace(x, F.lit("#"), F.lit("")))))


def css_align(x: Column) -> Column:
    return F.when(x.isin("both", "distribute"), "justify").when(x.isin("center", "right", "left"), x).when(x == "end", "right").otherwise("left")


def twips_to_px(x: Column) -> Column:
    return x / 15.0


def half_points_to_px(x: Column) -> Column:
    return x * 2.0 / 3.0


def emu_to_px(x: Column) -> Column:
    return x / 9525.0


def optional_number(x: Column) -> Column:
    """'' and what is not finite are null."""
    d = F.trim(x).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def lines_value(x: Column) -> Column:
    """Trimmed lines without blanks."""
    return F.filter(F.transform(F.split(x, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")


def status_class(x: Column) -> Column:
    """ready before archived before draft, by substring; '' for anything else."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.when(low.rlike("έτοι|ready"), "ready").when(low.rlike("αρχει|archive"), "archived").when(low.rlike("προσχ|draft|επεξεργ"), "draft").otherwise("")


def dialogue_row(x: Column) -> Column:
    """'speaker | left | right': cut at bars with white space on both sides; three or more parts keep the middle together."""
    parts = F.split(F.trim(x), r"\s+\|\s+")
    n = F.size(parts)
    return F.struct(
        F.when(n >= 2, parts[0]).otherwise("").alias("speaker"),
        F.when(n >= 3, F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), " | ")).when(n == 2, parts[1]).otherwise(parts[0]).alias("left"),
        F.when(n >= 3, F.element_at(parts, -1)).otherwise("").alias("right"),
    )


def frame_text(template: Column, number: Column) -> Column:
    return F.replace(template, F.lit("{page}"), number.cast("string"))


def safe_name(x: Column) -> Column:
    """The last path segment without query and fragment, odd characters as underscores."""
    base = F.regexp_extract(F.regexp_replace(x, r"[?#].*$", ""), r"([^/\\]*)$", 1)
    return F.regexp_replace(base, r"[^A-Za-z0-9._Ͱ-Ͽ-]+", "_")


def display_label(x: Column, labels: dict[str, str]) -> Column:
    """The label of a name in a dictionary, or the name itself."""
    known = F.create_map(*[F.lit(y) for pair in labels.items() for y in pair]) if labels else F.lit(None).cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, x), x)


#: How parameter values that say yes or no are shown (fixed values).
YES_NO = {"1": "ναι", "true": "ναι", "0": "όχι", "false": "όχι"}


def earliest(x: Column, marks: list[str]) -> Column:
    """struct(place from 1, mark) of the mark that comes first in x; null where none does. Of marks at one place the first given wins."""
    found = F.filter(F.array(*[F.struct(F.locate(m, x).alias("place"), F.lit(i).alias("turn"), F.lit(m).alias("mark")) for i, m in enumerate(marks)]), lambda f: f["place"] > 0)
    best = F.array_min(found)
    return F.when(best.isNotNull(), F.struct(best["place"].alias("place"), best["mark"].alias("mark")))


#: Delimiters of mathematics in a text (fixed values): opening, closing, display.
MATH_MARKS = [(r"\(", r"\)", "inline"), (r"\[", r"\]", "block"), ("$$", "$$", "block")]


def math_spans(x: Column) -> Column:
    """array<struct(text, display)> of a text: plain parts (display null) and the mathematics between its delimiters, in order.

    An opening mark without its closing one makes the rest plain; empty plain parts go.
    """
    between = "|".join(re.escape(a) + "[\\s\\S]*?" + re.escape(b) for a, b, _ in MATH_MARKS)
    opened = "|".join(re.escape(a) for a, _, _ in MATH_MARKS)
    # What follows an opening mark that is never closed holds no mathematics, whatever stands in it.
    pattern = rf"(?:{between})|(?:{opened})[\s\S]*|(?:(?!{opened})[\s\S])+"
    parts = F.regexp_extract_all(x, F.lit(pattern), 0)

    def span(p: Column) -> Column:
        out = F.struct(p.alias("text"), F.lit(None).cast("string").alias("display"))
        for a, b, display in reversed(MATH_MARKS):
            inner = F.substring(p, F.lit(len(a) + 1), F.length(p) - len(a) - len(b))
            whole = p.startswith(a) & p.endswith(b) & (F.length(p) >= len(a) + len(b))
            out = F.when(whole, F.struct(inner.alias("text"), F.lit(display).alias("display"))).otherwise(out)
        return out

    return F.transform(parts, span)


def asset_name(x: Column) -> Column:
    """'slug.ext' of a file name; the ending in lower case, .png where there is none. identity.unique_ids() makes it free of collisions."""
    ext = F.lower(F.regexp_extract(x, r"\.[A-Za-z0-9]+$", 0))
    return F.concat(slugify(F.regexp_replace(x, r"\.[^.]+$", "")), F.when(ext == "", ".png").otherwise(ext))
