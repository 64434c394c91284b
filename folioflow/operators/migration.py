"""Migration of legacy page JSON (pages-v1) to the current schema, with a report counted in the same pass.

Items are variants; every rewrite rule is a row of data that names the field it fills, the legacy fields it reads, in
order of precedence, and the item types it is for. The new item is a struct written as JSON, and beside it stands the list
of the rules that took effect, so a report is a count over a column, or an observation while the new pages are written.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import html_text, normalize_id, slugify
from folioflow.model import ITEM_TYPES, NAV_DEFAULT_TYPES
from folioflow.operators import plainpages
from folioflow.operators.fold import fold_sorted_arrow
from folioflow.operators.identity import unique_ids
from folioflow.operators.paginate import PROSE
from folioflow.operators.validation import RICH_TEXT, SCHEMA_VERSION, array_at, is_kind, loose, scalars, text
from folioflow.session import stored

MEDIA = ("figure", "scene")


@dataclass(frozen=True)
class Move:
    """A field of the new item and the legacy fields it is read from when the new one is missing."""

    name: str
    to: str
    legacy: tuple[str, ...]
    types: tuple[str, ...]


#: Where legacy fields went (fixed values).
MOVES = [
    Move("scene-source", "src", ("singleSrc",), ("scene",)),
    Move("placement", "layout.placement", ("placement",), (*MEDIA, "side_note", "interactive_callout")),
    Move("width", "layout.widthPx", ("frameWidth",), (*MEDIA, "side_note", "interactive_callout")),
    Move("height", "layout.heightPx", ("frameHeight", "figureHeight", "sceneHeight"), (*MEDIA, "side_note", "interactive_callout")),
    Move("aspect", "layout.aspectRatio", ("aspectRatio", "sceneAspect", "aspect"), (*MEDIA, "side_note", "interactive_callout")),
    Move("wrap", "layout.wrap", ("wrapTight",), (*MEDIA, "side_note", "interactive_callout")),
    Move("float", "layout.floatInteraction", ("floatInteraction",), (*MEDIA, "side_note", "interactive_callout")),
    Move("nav-show", "nav.show", ("showInNav",), tuple(ITEM_TYPES)),
    Move("nav-label", "nav.label", ("navLabel",), tuple(ITEM_TYPES)),
    Move("heading-level", "level", ("sourceHeadingLevel",), ("section_heading",)),
]
#: Rules that are more than a move, in the order of reports.
OTHERS = ("html-body", "type-unknown", "id-normalised", "translation-dropped")
RULE_NAMES = [m.name for m in MOVES] + list(OTHERS)

#: Texts that items keep, by type (fixed values).
TEXTS = {
    "eyebrow": ("hero",), "subtitle": ("hero",), "title": ("hero", "part_title", "section_heading", "side_note", "figure", "scene", "interactive_callout", "nav_anchor", "dialogue"),
    "label": ("part_title", "note", "side_note"), "caption": ("figure", "scene", "equation"), "alt": ("figure",), "source": ("equation",), "mathml": ("equation",), "number": ("equation",), "intro": ("dialogue",),
}
#: Parts that are kept as they are.
WHOLE = {"rows": ("table", "dialogue"), "items": ("list",), "columns": ("table",), "ordered": ("list",), "start": ("list",), "sequenceSteps": ("interactive_callout",), "style": tuple(ITEM_TYPES), "sourceRef": tuple(ITEM_TYPES), "provenance": tuple(ITEM_TYPES), "extensions": tuple(ITEM_TYPES)}


def migrated_items(items: DataFrame, value: str = "value") -> DataFrame:
    """Adds item (struct of the current schema, without an id that is unique yet) and rules (names of those applied) to rows of legacy items (variants).

    Types that the model lacks become paragraphs. html becomes rich text of one run, and is kept as legacySourceHtml;
    rich text that is there stays. A field of the new name wins over legacy ones; of these the first does.
    Keys that end in _en are dropped. Values that are no objects, and null, become empty paragraphs.
    """
    v = F.col(value)
    # What is read of an item, once: the scalars that it and two of its objects hold. The rules then look fields up by name.
    own = items.columns
    parts = {"_own": scalars(v, "$"), "_layout": scalars(v, "$.layout"), "_nav": scalars(v, "$.nav")}
    read = {"_type": text(v, "$.type"), "_html": text(v, "$.html"), "_keys": F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>"))}
    read["_rich"] = F.coalesce(text(v, "$.body.format") == RICH_TEXT, F.lit(False)) & is_kind(v, "$.body.nodes", "array")
    items = items.withColumns(parts | read)

    def held(path: str) -> Column:
        *above, name = path.split(".")
        return F.try_element_at(F.col(f"_{above[0]}" if above else "_own"), F.lit(name))

    moved = {"_id": F.coalesce(held("id"), F.lit(""))}
    for n, m in enumerate(MOVES):
        moved |= {f"_new{n}": held(m.to), f"_old{n}": F.coalesce(*[held(p) for p in m.legacy])}
    items = items.withColumns(moved)
    raw_type, given_id, rich = F.col("_type"), F.col("_id"), F.col("_rich")
    known = F.coalesce(raw_type.isin(*ITEM_TYPES), F.lit(False))
    type_ = F.when(known, raw_type).otherwise("paragraph")
    at = {m.to: F.coalesce(f"_new{n}", f"_old{n}") for n, m in enumerate(MOVES)}
    media = type_.isin(*MEDIA)
    placement = F.coalesce(F.when(at["layout.placement"] != "", at["layout.placement"]), F.when(media, "float-right").otherwise("wide"))
    wrap = F.coalesce(at["layout.wrap"].try_cast("boolean"), media | placement.startswith("float-"))
    floats = F.coalesce(F.when(at["layout.floatInteraction"] != "", at["layout.floatInteraction"]), F.when(media & wrap, "wrap").otherwise(""))
    laid = type_.isin(*MEDIA, "side_note") | ((type_ == "interactive_callout") & F.coalesce(*[at[m.to] for m in MOVES if m.to.startswith("layout.")]).isNotNull())
    layout = F.struct(
        placement.alias("placement"), wrap.alias("wrap"), floats.alias("floatInteraction"),
        at["layout.widthPx"].try_cast("double").alias("widthPx"), at["layout.heightPx"].try_cast("double").alias("heightPx"),
        F.coalesce(at["layout.aspectRatio"], F.when(type_ == "scene", "16/9").otherwise("natural")).alias("aspectRatio"),
    )
    prose = type_.isin(*PROSE)
    plain = F.coalesce(html_text(F.col("_html")), F.lit(""))
    run = F.to_json(F.struct(F.lit(RICH_TEXT).alias("format"), F.when(plain != "", F.array(F.struct(F.lit("text_run").alias("type"), plain.alias("text")))).otherwise(F.array().cast("array<struct<type:string,text:string>>")).alias("nodes")))
    body = F.when(prose, F.when(rich, F.variant_get(v, "$.body", "variant")).otherwise(F.parse_json(run)))
    level = at["level"].try_cast("double")
    shown = lambda c: ~is_kind(v, f"$.visibility.{c}", "boolean") | F.coalesce(F.try_variant_get(v, f"$.visibility.{c}", "boolean"), F.lit(True))
    fields = [
        normalize_id(given_id).alias("id"), type_.alias("type"),
        F.struct(F.coalesce(at["nav.show"].try_cast("boolean"), type_.isin(*NAV_DEFAULT_TYPES)).alias("show"), F.coalesce(at["nav.label"], F.lit("")).alias("label")).alias("nav"),
        F.struct(shown("screen").alias("screen"), shown("print").alias("print")).alias("visibility"),
        *[F.when(type_.isin(*types), held(name)).alias(name) for name, types in TEXTS.items()],
        F.when(media, F.coalesce(F.when(type_ == "scene", at["src"]).otherwise(held("src")), F.lit(""))).alias("src"),
        F.when(type_ == "section_heading", F.coalesce(F.when(level != 0, level), F.lit(2.0)).cast("int")).alias("level"),
        F.when(laid, layout).alias("layout"), body.alias("body"),
        F.when(prose, F.coalesce(text(v, "$.legacySourceHtml"), F.col("_html"))).alias("legacySourceHtml"),
        *[F.when(type_.isin(*types), F.variant_get(v, f"$.{name}", "variant")).alias(name) for name, types in WHOLE.items()],
    ]
    english = F.filter("_keys", lambda k: k.endswith("_en"))
    applied = {m.name: type_.isin(*m.types) & F.col(f"_new{n}").isNull() & F.col(f"_old{n}").isNotNull() for n, m in enumerate(MOVES)}
    applied |= {"html-body": prose & ~rich & F.array_contains("_keys", "html"), "type-unknown": ~known, "id-normalised": (given_id != "") & (normalize_id(given_id) != given_id), "translation-dropped": F.size(english) > 0}
    # Joined and split again: a lambda over the rules would have them interpreted, not compiled.
    names = F.concat_ws(",", *[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in applied.items()])
    rules = F.when(names == "", F.array().cast("array<string>")).otherwise(F.split(names, ","))
    return items.select(*own, F.struct(*fields).alias("item"), rules.alias("rules"), english.alias("dropped"))


def exploded(pages: DataFrame, keys: list[str], page: str = "page", json: str = "json") -> DataFrame:
    """(keys, page, item_ord, value) of the items of legacy pages."""
    read = pages.select(*keys, F.col(page).cast("int").alias("page"), array_at(F.try_parse_json(json), "$.items").alias("_items"))
    # The outer form, filtered behind: for the inner one Spark filters by the size of the array, and so reads every page's JSON twice.
    return read.select(*keys, "page", F.posexplode_outer("_items").alias("item_ord", "value")).where("item_ord IS NOT NULL")


def _head(v: Column, page: Column) -> list[Column]:
    """What a legacy page keeps besides its items: headers and footers no longer inherit."""
    three = lambda side: F.struct(F.coalesce(F.try_variant_get(v, f"$.{side}.inherit", "boolean"), F.lit(False)).alias("inherit"), *[F.coalesce(loose(v, f"$.{side}.{c}"), F.lit("")).alias(c) for c in ("left", "center", "right")]).alias(side)
    number = F.struct(F.lit(True).alias("inherit"), F.lit(True).alias("enabled"), F.lit(0).alias("offset"), F.lit(False).alias("hide")).alias("pageNumbering")
    source = F.coalesce(*[loose(v, f"$.{c}") for c in ("sourcePage", "sourceDocxPage", "pdfPage")]).try_cast("int").alias("sourcePage")
    id_ = F.coalesce(F.when(loose(v, "$.id") != "", normalize_id(loose(v, "$.id"))), F.concat(F.lit("page-"), (page + 1).cast("string"))).alias("id")
    return [id_, source, three("header"), three("footer"), number, F.struct(F.lit(True).alias("screen"), F.lit(True).alias("print")).alias("visibility")]


def page_heads(pages: DataFrame, keys: list[str], page: str = "page", json: str = "json") -> DataFrame:
    """(keys, page, id, sourcePage, header, footer, pageNumbering, visibility) of legacy pages: headers and footers no longer inherit."""
    read = pages.select(*keys, F.col(page).cast("int").alias("page"), F.try_parse_json(json).alias("_v"))
    return read.select(*keys, "page", *_head(F.col("_v"), F.col("page")))


def summary(item: Column) -> Column:
    """What an item is called: its title, label, caption, the text of its only run, its source or its type."""
    said = F.try_variant_get(item["body"], "$.nodes[0].text", "string")
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in (item["title"], item["nav"]["label"], item["label"], item["caption"], said, item["src"], item["type"])], F.lit(""))


def _following(json: Column) -> Column:
    """The fields of a JSON object that is not empty, and its end, to stand behind an id."""
    return F.concat(F.lit(","), F.substring(json, F.lit(2), F.length(json)))


def rewritten(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page, _row, page_id, _head, _ids, _bases, _items, rules, dropped) of (keys, page, _row, _json): pages rewritten by expressions, whatever they hold.

    _ids: given ids of items, _bases: what theirs are to be if free, _items: JSON of items behind the id.
    """
    read = pages.withColumn("_v", F.try_parse_json("_json"))
    id_, *rest = _head(F.col("_v"), F.col("page"))
    own = [*keys, "page", "_row", "page_id", "_head"]
    read = read.select(*keys, "page", "_row", id_.alias("page_id"), F.to_json(F.struct(*rest)).alias("_head"), array_at(F.col("_v"), "$.items").alias("_items"))
    rows = migrated_items(read.select(*own, F.posexplode_outer("_items").alias("item_ord", "value")))
    flat = rows.select(*own, "item_ord", F.col("item.id").alias("id"), F.col("item.type").alias("_type"), slugify(summary(F.col("item")), 24).alias("_slug"), _following(F.to_json(F.col("item").dropFields("id"))).alias("json"), "rules", "dropped")
    # Moved before they are gathered: what an aggregate collects is not compiled, so it gets finished columns.
    flat = flat.repartition("_row")
    named = F.when(F.col("id") != "", F.col("id")).otherwise(F.concat_ws("-", "page_id", "_type", "_slug", (F.col("item_ord") + 1).cast("string")))
    mine = lambda x: F.when(F.col("item_ord").isNotNull(), x)
    whole = flat.groupBy(*keys, "page", "_row").agg(
        F.first("page_id").alias("page_id"), F.first("_head").alias("_head"), F.array_sort(F.collect_list(mine(F.struct("item_ord", "id", named.alias("base"), "json")))).alias("_all"),
        F.flatten(F.collect_list(mine(F.col("rules")))).alias("rules"), F.flatten(F.collect_list(mine(F.col("dropped")))).alias("dropped"),
    )
    return whole.select(*own, F.col("_all.id").alias("_ids"), F.col("_all.base").alias("_bases"), F.col("_all.json").alias("_items"), "rules", "dropped")


REWRITTEN = "page_id string, _head string, _ids array<string>, _bases array<string>, _items array<string>, rules array<string>, dropped array<string>, _odd string"


def _all_rewritten(given: DataFrame, keys: list[str]) -> DataFrame:
    """rewritten() of (keys, page, _json), stored: plain pages in Arrow batches, the others by expressions."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*keys, "page").schema.fields), REWRITTEN])
    made = stored(given.mapInArrow(lambda it: plainpages.rewritten_batches(it, plainpages.rewriter(MOVES, TEXTS, WHOLE), keys), schema).withColumn("_row", F.monotonically_increasing_id()))
    plain = made.where("_odd IS NULL").drop("_odd")
    odd = made.where("_odd IS NOT NULL").select(*keys, "page", "_row", F.col("_odd").alias("_json"))
    return plain.unionByName(stored(rewritten(odd, keys))) if odd.limit(1).count() else plain


def _unique(whole: DataFrame, keys: list[str]) -> DataFrame:
    """(_row, _unique, assigned) of rewritten(): the ids of a page and its items, probed in document order within each book; how many are not as given."""

    def fold(part: pa.Table, bounds: list[tuple[int, int]]) -> pa.Table:
        pages, ids = part.column("page_id").to_pylist(), part.column("_ids").combine_chunks()
        given, bases = ids.flatten().to_pylist(), part.column("_bases").combine_chunks().flatten().to_pylist()
        ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
        found: list[list[str]] = []
        changed: list[int] = []
        for lo, hi in bounds:
            new = iter(unique_ids(x for i in range(lo, hi) for x in (pages[i], *bases[ends[i] : ends[i + 1]])))
            for i in range(lo, hi):
                was = (pages[i], *given[ends[i] : ends[i + 1]])
                found.append([next(new) for _ in was])
                changed.append(sum(x != y for x, y in zip(found[-1], was, strict=True)))
        return part.append_column("_unique", pa.array(found, pa.list_(pa.string()))).append_column("assigned", pa.array(changed, pa.int64()))

    fields = [T.StructField("_unique", T.ArrayType(T.StringType())), T.StructField("assigned", T.LongType())]
    return fold_sorted_arrow(whole.select(*keys, "page", "_row", "page_id", "_ids", "_bases"), keys, ["page", "page_id", "_row"], fields, fold).select("_row", "_unique", "assigned")


def migrate(pages: DataFrame, keys: list[str], page: str = "page", json: str = "json") -> DataFrame:
    """(keys, page, json, rules, dropped, assigned) of legacy pages: JSON of the current schema with ids that are unique in each book.

    rules: the names of the rules applied to the page's items, one for each item and rule; dropped: keys of translations; assigned:
    the number of ids that were made up or changed to be unique. A page is read and rewritten once, in one place, and stored without
    its ids; these are probed in document order by a fold over each book's ids alone. Pages whose JSON cannot be read become
    empty ones; pages without a book or a number go; of rows with one number each is a page.
    """
    given = pages.select(*keys, F.col(page).cast("int").alias("page"), F.col(json).alias("_json")).where(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, "page"]))
    whole = _all_rewritten(given, keys)
    # An id holds nothing that JSON would escape.
    opening = lambda x: F.concat(F.lit('{"id":"'), x, F.lit('"'))
    items = F.array_join(F.zip_with(F.slice("_unique", 2, F.size("_items")), "_items", lambda o, i: F.concat(opening(o), i)), ",")
    head = F.concat(opening(F.col("_unique")[0]), _following(F.col("_head")))
    made = F.concat(F.left(head, F.length(head) - 1), F.lit(',"items":['), items, F.lit("]}"))
    return whole.join(_unique(whole, keys), "_row").select(*keys, "page", made.alias("json"), "rules", "dropped", "assigned")


def applied_rules(pages: DataFrame, keys: list[str], page: str = "page", json: str = "json") -> DataFrame:
    """(keys, rules) of every item of the pages that migrate() keeps: for a report alone, which needs no ids and no new pages."""
    return migrated_items(exploded(pages, keys, page, json)).where(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, "page"])).select(*keys, "rules")


def report(migrated: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, n): how often each rule of migrate() or applied_rules() was applied in a book; rules that were not do not show."""
    return migrated.select(*keys, F.explode_outer("rules").alias("rule")).where("rule IS NOT NULL").groupBy(*keys, "rule").agg(F.count("*").alias("n"))


def observed(migrated: DataFrame, name: str = "migration") -> tuple[DataFrame, Observation]:
    """The same table and an observation of its counts, filled by the action that writes it: a count for each rule, pages, dropped and assigned."""
    seen = Observation(name)
    uses = lambda rule: F.coalesce(F.sum(F.size(F.filter("rules", lambda r: r == rule))), F.lit(0)).alias(rule)
    counts = [F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.size("dropped")), F.lit(0)).alias("dropped"), F.coalesce(F.sum("assigned"), F.lit(0)).alias("assigned")]
    return migrated.observe(seen, *counts, *[uses(r) for r in RULE_NAMES]), seen


def migrated_head(heads: DataFrame, keys: list[str], json: str = "json", language: str = "el") -> DataFrame:
    """(keys, json): a legacy book's head in the current schema; its title, library data and navigation stay, translations go."""
    v = F.try_parse_json(json)
    names = ("projectId", "fileName", "title", "subtitle", "eyebrow", "createdAt", "updatedAt", "appHref")
    defaults = {"projectId": "book", "fileName": "book.json", "title": "Νέο βιβλίο"}
    meta = F.struct(*[F.coalesce(F.when(loose(v, f"$.meta.{n}") != "", loose(v, f"$.meta.{n}")), F.lit(defaults.get(n, ""))).alias(n) for n in names], F.lit(language).alias("defaultLanguage"))
    group = "array<struct<title:string,target:string,entries:array<struct<title:string,target:string>>>>"
    nav = F.struct(
        F.coalesce(loose(v, "$.nav.mode"), F.lit("auto")).alias("mode"), F.coalesce(F.try_variant_get(v, "$.nav.showApp", "boolean"), F.lit(True)).alias("showApp"),
        F.coalesce(F.try_variant_get(v, "$.nav.showPrint", "boolean"), F.lit(True)).alias("showPrint"), F.coalesce(F.try_variant_get(v, "$.nav.groups", group), F.array().cast(group)).alias("groups"),
    )
    return heads.select(*keys, F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(1).alias("schemaRevision"), meta.alias("meta"), nav.alias("nav"))).alias("json"))
