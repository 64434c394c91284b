"""The style cascade of imported documents: defaults, chains of styles and direct formatting, property by property, and CSS of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import css_align, half_points_to_px, twips_to_px, valid_hex
from folioflow.operators.setops import inherited, string_map

#: Layers of a property, from the weakest on.
DEFAULT, STYLE, DIRECT = "default", "style", "direct"
#: Fonts of the theme slots where a theme names none (fixed values).
THEME_FONTS = {"major": "Cambria", "minor": "Calibri"}
VISUAL = "map<string,string>"
#: A relation is broadcast by hint only below so many rows.
BROADCAST_ROWS = 20_000


def number_text(x: Column) -> Column:
    """A number as CSS has it: without a fraction that is zero."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def _first(raw: Column, *names: str) -> Column:
    return F.coalesce(*[F.try_element_at(raw, F.lit(n)) for n in names])


def theme_font(raw: Column, themes: Column | None = None) -> Column:
    """The font a run names, else that of the theme slot which it names (major or minor), by a second lookup."""
    slot = F.lower(_first(raw, "asciiTheme", "hAnsiTheme"))
    of = lambda kind: F.coalesce(F.try_element_at(themes, F.lit(kind)) if themes is not None else F.lit(None), F.lit(THEME_FONTS[kind]))
    return F.coalesce(_first(raw, "ascii", "hAnsi", "cs", "eastAsia"), F.when(slot.contains("major"), of("major")).when(slot.contains("minor"), of("minor")))


def visual(raw: Column, themes: Column | None = None) -> Column:
    """What a layer's raw attributes (a map of Word's names, blanks are none) say in CSS terms: a map with the properties it sets.

    Lengths are twips and become pixels, font sizes are half points; a line of rule 'auto' is in 240ths, others are
    lengths; hanging goes before firstLine; colours other than six hex digits say nothing, 'auto' is black.
    """
    raw = string_map(F.coalesce(raw, F.create_map().cast(VISUAL)))
    length = lambda *names: number_text(twips_to_px(_first(raw, *names).try_cast("double")))
    line, auto = _first(raw, "line").try_cast("double"), F.coalesce(_first(raw, "lineRule"), F.lit("auto")) == "auto"
    color = F.coalesce(valid_hex(_first(raw, "color")), F.when(F.lower(_first(raw, "color")) == "auto", "#000000"))
    flag = lambda name: F.when(_first(raw, name).isNotNull(), F.when(F.lower(_first(raw, name)).isin("0", "false", "off", "no"), "false").otherwise("true"))
    hanging = _first(raw, "hanging").try_cast("double")
    said = {
        "fontFamily": theme_font(raw, themes), "fontSizePx": number_text(half_points_to_px(_first(raw, "sz").try_cast("double"))), "textColor": color,
        "highlight": F.coalesce(valid_hex(_first(raw, "runFill")), valid_hex(_first(raw, "highlight"))), "bold": flag("b"), "italic": flag("i"), "underline": flag("u"),
        "backgroundColor": valid_hex(_first(raw, "fill")), "align": _first(raw, "jc"), "marginTopPx": length("before"), "marginBottomPx": length("after"),
        "lineHeight": F.when(auto, number_text(line / 240)), "lineHeightPx": F.when(~auto, number_text(twips_to_px(line))), "marginLeftPx": length("left", "start"), "marginRightPx": length("right", "end"),
        "textIndentPx": F.coalesce(number_text(-twips_to_px(hanging)), length("firstLine")), "keepWithNext": flag("keepNext"), "keepTogether": flag("keepLines"), "pageBreakBefore": flag("pageBreakBefore"),
    }
    return string_map(F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in said.items()])))


def layer(props: Column, name: Column) -> Column:
    """A map of values with the layer that gives them."""
    return F.transform_values(props, lambda k, v: F.struct(v.alias("value"), name.alias("layer")))


def over(weak: Column, strong: Column) -> Column:
    """Two maps in one; the second wins."""
    return F.map_concat(F.map_filter(weak, lambda k, v: ~F.array_contains(F.map_keys(strong), k)), strong)


def cascade(paragraphs: DataFrame, styles: DataFrame, defaults: dict[str, str], style: str = "style_id", direct: str = "direct", default_style: str | None = None) -> DataFrame:
    """Adds resolved: map of property to (value, layer), by defaults < the style's chain, nearest first < direct formatting.

    styles: (style_id, based_on, props) and direct: maps as visual() makes them; defaults: the document's. layer is 'default',
    'style:' and the id of the style in the chain that set the value, or 'direct'. A paragraph without a style, or with one that
    is unknown, has default_style. Chains may be of any length and may run in circles (inherited()). Styles are broadcast
    when they are few; else a style that many paragraphs share is a skewed key, which adaptive joins divide.
    """
    own = styles.select("style_id", "based_on", layer(F.coalesce("props", F.create_map().cast(VISUAL)), F.concat(F.lit(f"{STYLE}:"), F.col("style_id").cast("string"))).alias("props"))
    chains = inherited(own)
    few = chains.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = chains.select(F.col("style_id").alias("_s"), F.col("props").alias("_chain"))
    rows = paragraphs.join(F.broadcast(known) if few else known, F.col(style) == F.col("_s"), "left").drop("_s")
    if default_style is not None:
        normal = chains.where(F.col("style_id") == default_style).select(F.first("props").alias("_normal"))
        rows = rows.crossJoin(F.broadcast(normal)).withColumn("_chain", F.coalesce("_chain", "_normal")).drop("_normal")
    kind = chains.schema["props"].dataType
    base = layer(F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]).cast(VISUAL) if defaults else F.create_map().cast(VISUAL), F.lit(DEFAULT)).cast(kind)
    formatted = layer(F.coalesce(F.col(direct), F.create_map().cast(VISUAL)), F.lit(DIRECT)).cast(kind)
    return rows.withColumn("resolved", over(over(base, F.coalesce("_chain", F.create_map().cast(kind))), formatted)).drop("_chain")


def values(resolved: Column) -> Column:
    return F.transform_values(resolved, lambda k, v: v["value"])


def css(props: Column, hyphenate: Column | bool = True) -> Column:
    """CSS text of a paragraph's properties, in a fixed order; text that nothing colours is black."""
    v = lambda name: F.try_element_at(props, F.lit(name))
    hyphens = F.when(hyphenate if isinstance(hyphenate, Column) else F.lit(hyphenate), "auto").otherwise("manual")
    align = css_align(v("align"))
    rule = lambda name, value, unit="": F.concat(F.lit(f"{name}:"), value, F.lit(unit))
    lines = [
        rule("text-align", align), F.when(align == "justify", "text-justify:inter-word"), rule("hyphens", hyphens), rule("-webkit-hyphens", hyphens), F.lit("overflow-wrap:break-word"), F.lit("word-break:normal"),
        rule("color", F.coalesce(v("textColor"), F.lit("#000000"))), rule("font-family", F.concat(F.lit('"'), v("fontFamily"), F.lit('"'))), F.when(v("fontSizePx") != "0", rule("font-size", v("fontSizePx"), "px")),
        F.coalesce(rule("line-height", v("lineHeight")), rule("line-height", v("lineHeightPx"), "px")),
        *[rule(name, v(key), "px") for key, name in (("marginTopPx", "margin-top"), ("marginBottomPx", "margin-bottom"), ("marginLeftPx", "margin-left"), ("marginRightPx", "margin-right"), ("textIndentPx", "text-indent"))],
        rule("background-color", v("backgroundColor")),
    ]
    return F.concat_ws(";", *lines)


def root_styled(html: Column, text: Column) -> Column:
    """HTML with CSS on its root: lists and tables take it themselves, other content gets a block around it."""
    trimmed = F.trim(F.coalesce(html, F.lit("")))
    quoted = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        quoted = F.replace(quoted, F.lit(char), F.lit(name))
    tag = F.regexp_extract(trimmed, r"(?is)^<((?:ul|ol|table)\b[^>]*)>", 1)
    own = F.concat(F.lit("<"), tag, F.lit(' style="'), quoted, F.lit('">'), F.substr(trimmed, F.length(tag) + 3))
    block = F.concat(F.lit('<span class="docx-paragraph-format" style="display:block;'), quoted, F.lit('">'), F.coalesce(html, F.lit("")), F.lit("</span>"))
    return F.when(tag != "", own).otherwise(block)


#: Properties of a paragraph's own style (fixed values), and those that a list leaves to its levels.
CANONICAL = (
    "fontFamily", "fontSizePx", "lineHeight", "lineHeightPx", "marginTopPx", "marginBottomPx", "marginLeftPx", "marginRightPx", "textIndentPx",
    "backgroundColor", "keepWithNext", "keepTogether", "pageBreakBefore", "contextualSpacing",
)
OF_LEVELS = ("marginLeftPx", "textIndentPx")


def canonical_style(props: Column, in_list: Column | bool = False, hyphenate: Column | bool = True) -> Column:
    """The style that an item keeps: align (left if it has none), hyphenate, the canonical properties that are set, and color.

    Word writes a list's indent into its paragraphs too; items of lists leave it out, since their level says it.
    """
    listed = in_list if isinstance(in_list, Column) else F.lit(in_list)
    hyphens = hyphenate if isinstance(hyphenate, Column) else F.lit(hyphenate)
    props = string_map(F.coalesce(props, F.create_map().cast(VISUAL)))
    kept = F.map_filter(props, lambda k, v: k.isin(*CANONICAL) & ~(listed & k.isin(*OF_LEVELS)))
    color = F.try_element_at(props, F.lit("textColor"))
    always = F.create_map(F.lit("align"), css_align(F.try_element_at(props, F.lit("align"))), F.lit("hyphenate"), F.when(F.coalesce(hyphens, F.lit(True)), "true").otherwise("false"))
    return F.map_concat(always, kept, F.when(color.isNotNull(), F.create_map(F.lit("color"), color)).otherwise(F.create_map().cast(VISUAL)))
