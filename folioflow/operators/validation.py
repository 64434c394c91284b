"""Validation by a rule table: documents become elements with their paths, every rule is a row of data, one pass gives all messages.

A book comes as JSON, whole or as a head and one row for each page. Its elements are the book, its pages, their
items, and the nodes of rich text at every depth, each with the path that names it. Rules look at one element; ids and
references, which need the whole book, are a window over the ids and an anti join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.model import ITEM_TYPES
from folioflow.operators.paginate import PROSE
from folioflow.session import stored

SCHEMA_VERSION = "bookwriter-v4"
SCHEMAS = (SCHEMA_VERSION, "pages-v1")
RICH_TEXT = "rich-text-v1"
#: Node types of rich text (fixed values).
INLINE_TYPES = ("text_run", "math_inline", "link", "line_break")
#: Levels of links inside links that are walked; what lies deeper is reported as such.
DEPTH = 4

Test = Callable[[Column], Column]


#: What a variant's schema begins with, by kind of value; of numbers it may begin with anything else.
KINDS = {"object": "OBJ", "array": "ARR", "string": "STR", "boolean": "BOO", "null": "VOI", "missing": "non"}


def is_kind(v: Column, path: str, *kinds: str) -> Column:
    """Whether the value at a path is an 'object', 'array', 'string', 'boolean', 'number', 'null', or 'missing'.

    Kinds that a cast tells are not asked by schema, which would be derived from everything that stands below the path.
    """
    tests = {
        "object": lambda: F.try_variant_get(v, path, "map<string,variant>").isNotNull(), "array": lambda: F.try_variant_get(v, path, "array<variant>").isNotNull(),
        "missing": lambda: F.variant_get(v, path, "variant").isNull(),
    }
    if all(k in tests for k in kinds):
        return reduce(Column.__or__, [tests[k]() for k in kinds])
    begin = F.coalesce(F.left(F.schema_of_variant(F.variant_get(v, path, "variant")), F.lit(3)), F.lit("non"))
    if "number" in kinds:
        return ~begin.isin(*[code for name, code in KINDS.items() if name not in kinds])
    return begin.isin(*[KINDS[k] for k in kinds])


def text(v: Column, path: str) -> Column:
    """The string at a path; null where there is none or something else."""
    return F.when(is_kind(v, path, "string"), F.try_variant_get(v, path, "string"))


def loose(v: Column, path: str) -> Column:
    """What stands at a path as text, numbers and booleans too; null for null, objects and arrays."""
    return F.when(is_kind(v, path, "string", "number", "boolean"), F.try_variant_get(v, path, "string"))


def scalars(v: Column, path: str) -> Column:
    """The fields of the object at a path that are texts, numbers or booleans, as a map to texts: loose() of every field there is, in one go. Empty where there is no object."""
    fields = F.map_entries(F.coalesce(F.try_variant_get(v, path, "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    said = F.transform(fields, lambda e: F.struct(e["key"].alias("key"), loose(e["value"], "$").alias("value")))
    return F.map_from_entries(said)


def blank(path: str) -> Test:
    return lambda v: F.coalesce(F.trim(text(v, path)), F.lit("")) == ""


def isnt(path: str, *kinds: str) -> Test:
    return lambda v: ~is_kind(v, path, *kinds)


def outside(path: str, *values: str) -> Test:
    return lambda v: ~F.coalesce(text(v, path).isin(*values), F.lit(False))


def of(types: tuple[str, ...], test: Test) -> Test:
    """test of elements of some types, which facts() has as a column."""
    return lambda v: F.coalesce(F.col("_type").isin(*types), F.lit(False)) & test(v)


def object_and(test: Test) -> Test:
    return lambda v: is_kind(v, "$", "object") & test(v)


def inside(path: str, test: Test) -> Test:
    """test where the path holds an object."""
    return lambda v: is_kind(v, path, "object") & test(v)


def given(path: str, test: Test) -> Test:
    """test where the path is there at all."""
    return lambda v: ~is_kind(v, path, "missing") & test(v)


def both(a: Test, b: Test) -> Test:
    return lambda v: a(v) & b(v)


def true(path: str) -> Test:
    return lambda v: F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False))


def number(path: str, test: Test) -> Test:
    """test of the number at a path; missing or other values fail it not."""
    return lambda v: F.coalesce(is_kind(v, path, "number") & test(F.try_variant_get(v, path, "double")), F.lit(False))


def no_rich_text(path: str) -> Test:
    return lambda v: ~is_kind(v, path, "object") | outside(f"{path}.format", RICH_TEXT)(v) | ~is_kind(v, f"{path}.nodes", "array")


def not_mathml(v: Column) -> Column:
    return ~F.coalesce(F.trim(text(v, "$.mathml")).rlike(r"(?i)^<math[\s>]"), F.lit(False))


@dataclass(frozen=True)
class Rule:
    """severity and code of a message about elements of a level for which `fails` holds; at is added to the element's path."""

    level: str
    severity: str
    code: str
    fails: Test
    at: str = ""


RULES = [
    Rule("book", "error", "book-not-object", isnt("$", "object")),
    Rule("book", "error", "schema-version", outside("$.schemaVersion", SCHEMA_VERSION), "schemaVersion"),
    Rule("book", "warning", "schema-unknown", given("$.schemaVersion", outside("$.schemaVersion", *SCHEMAS)), "schemaVersion"),
    Rule("book", "error", "meta-missing", isnt("$.meta", "object"), "meta"),
    Rule("book", "error", "meta-title", inside("$.meta", isnt("$.meta.title", "string")), "meta.title"),
    Rule("book", "error", "nav-missing", isnt("$.nav", "object"), "nav"),
    Rule("book", "error", "nav-mode", inside("$.nav", outside("$.nav.mode", "auto", "manual")), "nav.mode"),
    Rule("book", "error", "nav-groups", inside("$.nav", isnt("$.nav.groups", "array")), "nav.groups"),
    Rule("book", "error", "orientation", given("$.layoutDefaults.orientation", outside("$.layoutDefaults.orientation", "portrait", "landscape")), "layoutDefaults.orientation"),
    Rule("book", "error", "page-height", given("$.layoutDefaults.pageHeightPx", isnt("$.layoutDefaults.pageHeightPx", "number")), "layoutDefaults.pageHeightPx"),
    Rule("page", "error", "page-not-object", isnt("$", "object")),
    Rule("page", "error", "page-id-missing", object_and(blank("$.id")), ".id"),
    Rule("page", "error", "page-items-missing", object_and(isnt("$.items", "array")), ".items"),
    Rule("page", "error", "page-header", given("$.header", isnt("$.header", "object")), ".header"),
    Rule("page", "error", "source-page", given("$.sourcePage", isnt("$.sourcePage", "number", "null")), ".sourcePage"),
    Rule("page", "error", "numbering-offset", given("$.pageNumbering.offset", isnt("$.pageNumbering.offset", "number")), ".pageNumbering.offset"),
    Rule("item", "error", "item-not-object", isnt("$", "object")),
    Rule("item", "error", "type-missing", both(lambda v: F.coalesce(F.trim("_type"), F.lit("")) == "", isnt("$", "array", "string", "boolean", "number", "null", "missing")), ".type"),
    Rule("item", "error", "type-unknown", lambda v: (F.coalesce(F.trim("_type"), F.lit("")) != "") & ~F.col("_type").isin(*ITEM_TYPES), ".type"),
    Rule("item", "error", "item-id-missing", object_and(blank("$.id")), ".id"),
    Rule("item", "error", "body-invalid", of(PROSE, no_rich_text("$.body")), ".body"),
    Rule("item", "warning", "figure-without-src", of(("figure",), blank("$.src")), ".src"),
    Rule("item", "warning", "figure-without-alt", of(("figure",), blank("$.alt")), ".alt"),
    Rule("item", "warning", "scene-without-src", of(("scene",), blank("$.src")), ".src"),
    Rule("item", "error", "dialogue-rows", of(("dialogue",), isnt("$.rows", "array")), ".rows"),
    Rule("item", "error", "table-rows", of(("table",), isnt("$.rows", "array")), ".rows"),
    Rule("item", "error", "table-columns", of(("table",), number("$.columns", lambda n: n < 1)), ".columns"),
    Rule("item", "error", "list-items", of(("list",), isnt("$.items", "array")), ".items"),
    Rule("item", "error", "list-ordered", of(("list",), given("$.ordered", isnt("$.ordered", "boolean"))), ".ordered"),
    Rule("item", "warning", "equation-empty", of(("equation",), both(blank("$.source"), blank("$.mathml")))),
    Rule("item", "error", "heading-level", of(("section_heading",), given("$.level", isnt("$.level", "number"))), ".level"),
    Rule("item", "error", "nav-show", given("$.nav.show", isnt("$.nav.show", "boolean")), ".nav.show"),
    Rule("item", "error", "print-expand", given("$.print.expand", outside("$.print.expand", "none", "per-step")), ".print.expand"),
    Rule("item", "error", "steps-not-array", of(("interactive_callout",), given("$.sequenceSteps", isnt("$.sequenceSteps", "array"))), ".sequenceSteps"),
    Rule("node", "error", "node-unknown", lambda v: ~F.coalesce(F.col("_type").isin(*INLINE_TYPES), F.lit(False))),
    Rule("node", "error", "text-not-string", of(("text_run",), isnt("$.text", "string")), ".text"),
    Rule("node", "error", "super-and-sub", of(("text_run",), both(true("$.superscript"), true("$.subscript")))),
    Rule("node", "warning", "math-empty", of(("math_inline",), both(blank("$.source"), blank("$.mathml")))),
    Rule("node", "warning", "math-root", of(("math_inline",), both(lambda v: ~blank("$.mathml")(v), not_mathml))),
    Rule("node", "error", "href-empty", of(("link",), blank("$.href")), ".href"),
    Rule("node", "error", "children-not-array", of(("link",), given("$.children", isnt("$.children", "array"))), ".children"),
    Rule("deep", "error", "links-too-deep", of(("link",), lambda v: is_kind(v, "$.children", "array")), ".children"),
]
NODES = "array<struct<path:string,value:variant>>"


def array_at(v: Column, path: str) -> Column:
    """The array of variants at a path, empty where there is none."""
    return F.coalesce(F.when(is_kind(v, path, "array"), F.try_variant_get(v, path, "array<variant>")), F.array().cast("array<variant>"))


def page_elements(pages: DataFrame, keys: list[str], page: str = "page", json: str = "json") -> DataFrame:
    """(keys, page, level, path, item, value) of pages, each the JSON of one page with its ordinal (from 0); JSON that cannot be read is an element without value.

    Nodes of links are walked to DEPTH levels below the first; the links that are left then show once more, at level 'deep'.
    """
    read = pages.select(*keys, F.col(page).cast("int").alias("page"), F.try_parse_json(json).alias("_v"))
    numbered = F.transform(array_at(F.col("_v"), "$.items"), lambda v, k: F.struct(k.cast("int").alias("item"), v.alias("value")))
    # The page itself stands among its items, as number -1. No array is empty here; the outer form keeps Spark from making each twice, once to filter by its size.
    rows = read.select(*keys, "page", F.explode_outer(F.concat(F.array(F.struct(F.lit(-1).alias("item"), F.col("_v").alias("value"))), numbered)).alias("_e")).select(*keys, "page", "_e.*")
    v, is_item = F.col("value"), F.col("item") >= 0
    at = F.concat(F.lit("pages["), F.col("page").cast("string"), F.lit("]"))
    rows = rows.withColumn("path", F.when(is_item, F.concat(at, F.lit(".items["), F.col("item").cast("string"), F.lit("]"))).otherwise(at))
    none = F.array().cast(NODES)
    nodes = lambda values, path: F.transform(values, lambda n, k: F.struct(F.concat(path, F.lit("["), k.cast("string"), F.lit("]")).alias("path"), n.alias("value")))
    prose = is_item & F.coalesce(text(v, "$.type").isin(*PROSE), F.lit(False)) & ~no_rich_text("$.body")(v)
    rows = rows.withColumn("_n0", F.when(prose, nodes(array_at(v, "$.body.nodes"), F.concat("path", F.lit(".body.nodes")))).otherwise(none))
    # A column for each level, so that every level is taken from the one above it once.
    for depth in range(DEPTH):
        links = F.filter(f"_n{depth}", lambda e: F.coalesce(text(e["value"], "$.type") == "link", F.lit(False)))
        below = F.flatten(F.transform(links, lambda e: nodes(array_at(e["value"], "$.children"), F.concat(e["path"], F.lit(".children")))))
        rows = rows.withColumn(f"_n{depth + 1}", F.when(F.size(f"_n{depth}") > 0, below).otherwise(none))
    named = lambda level, found: F.transform(found, lambda e: F.struct(F.lit(level).alias("level"), e["path"].alias("path"), e["value"].alias("value")))
    own = F.array(F.struct(F.when(is_item, "item").otherwise("page").alias("level"), F.col("path"), v.alias("value")))
    every = F.concat(own, *[named("node", F.col(f"_n{d}")) for d in range(DEPTH + 1)], named("deep", F.col(f"_n{DEPTH}")))
    return rows.select(*keys, "page", "item", F.explode_outer(every).alias("_e")).select(*keys, "page", "_e.level", "_e.path", "item", "_e.value")


def head_elements(heads: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """The elements of books' heads: JSON of a book, whose pages are not looked at."""
    return heads.select(*keys, F.lit(-1).alias("page"), F.lit("book").alias("level"), F.lit("").alias("path"), F.lit(-1).alias("item"), F.try_parse_json(json).alias("value"))


def split_books(books: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """(keys, page, json) of every page of whole books, for page_elements()."""
    read = books.select(*keys, F.try_parse_json(json).alias("_value"))
    return read.select(*keys, F.posexplode(array_at(F.col("_value"), "$.pages")).alias("page", "_page")).select(*keys, "page", F.to_json("_page").alias("json"))


def facts(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page, item, level, path, id, targets, failed) of the elements that matter to a message: what one pass over the documents finds.

    id: of pages and items; targets: (path, code, target) of links within the book and of navigation; failed: the numbers of
    the rules that an element fails, joined by commas. Nodes that have neither are left out.
    """
    v, level = F.col("value"), F.col("level")
    typed = elements.withColumn("_type", F.when(level.isin("item", "node", "deep"), text(v, "$.type")))
    # Joined text and no array that is filtered: a lambda would have all rules interpreted, not compiled.
    failed = F.lit("")
    for name in ("book", "page", "item", "node", "deep"):
        own = [F.when(F.coalesce(r.fails(v), F.lit(False)), F.lit(str(n))) for n, r in enumerate(RULES) if r.level == name]
        failed = F.when(level == name, F.concat_ws(",", *own)).otherwise(failed)
    href = text(v, "$.href")
    link = F.when(F.coalesce(href.startswith("#"), F.lit(False)), F.array(F.struct(F.concat("path", F.lit(".href")).alias("path"), F.lit("link-broken").alias("code"), F.expr("substring(try_variant_get(value, '$.href', 'string'), 2)").alias("target"))))
    aim = lambda at, x: F.struct(F.concat(at, F.lit("].target")).alias("path"), F.lit("nav-broken").alias("code"), F.regexp_replace(text(x, "$.target"), "^#", "").alias("target"))
    groups = F.transform(array_at(v, "$.nav.groups"), lambda g, i: F.concat(F.array(aim(F.concat(F.lit("nav.groups["), i.cast("string")), g)), F.transform(array_at(g, "$.entries"), lambda e, j: aim(F.concat(F.lit("nav.groups["), i.cast("string"), F.lit("].entries["), j.cast("string")), e))))
    targets = F.when((level == "node") & (F.col("_type") == "link"), link).when(level == "book", F.flatten(groups))
    found = typed.select(*keys, "page", "item", "level", "path", F.when(level.isin("page", "item"), text(v, "$.id")).alias("id"), targets.alias("targets"), failed.alias("failed"))
    # Through an array of one, below which Spark cannot move the filter: it would run every rule twice.
    found = found.withColumn("failed", F.explode_outer(F.array("failed")))
    return found.where(level.isin("book", "page", "item") | (F.col("failed") != "") | (F.coalesce(F.size("targets"), F.lit(0)) > 0))


def told(rows: DataFrame, keys: list[str], messages: Column, path: Column) -> DataFrame:
    """A row (keys, page, item, severity, path, code) for each message of an array."""
    found = rows.select(*keys, "page", "item", path.alias("_path"), F.explode(messages).alias("_m"))
    return found.select(*keys, "page", "item", F.col("_m.severity").alias("severity"), F.concat("_path", "_m.at").alias("path"), F.col("_m.code").alias("code"))


def rule_messages(found: DataFrame, keys: list[str]) -> DataFrame:
    """What the rules say about facts()."""
    table = F.array(*[F.struct(F.lit(r.severity).alias("severity"), F.lit(r.at).alias("at"), F.lit(r.code).alias("code")) for r in RULES])
    each = found.where("failed <> ''").select(*keys, "page", "item", "path", F.explode(F.split("failed", ",")).alias("_n"))
    return told(each, keys, F.array(F.element_at(table, F.col("_n").cast("int") + 1)), F.col("path"))


def id_messages(found: DataFrame, keys: list[str]) -> DataFrame:
    """Ids of pages and items that occur before in the book, in document order: an error for any, further ones for pages and items among themselves."""
    ids = found.where("trim(id) <> ''").select(*keys, "page", "item", "path", "level", "id")
    before = W.partitionBy(*keys, "id").orderBy("page", "item").rowsBetween(W.unboundedPreceding, -1)
    page, item = F.col("level") == "page", F.col("level") == "item"
    ids = ids.withColumn("_pages", F.count_if(page).over(before)).withColumn("_items", F.count_if(item).over(before))
    say = lambda severity, code: F.struct(F.lit(severity).alias("severity"), F.lit(".id").alias("at"), F.lit(code).alias("code"))
    again = F.filter(
        F.array(F.when(F.col("_pages") + F.col("_items") > 0, say("error", "id-duplicate")), F.when(page & (F.col("_pages") > 0), say("error", "page-id-repeated")), F.when(item & (F.col("_items") > 0), say("warning", "item-id-repeated"))),
        lambda m: m.isNotNull(),
    )
    return told(ids, keys, again, F.col("path"))


def reference_messages(found: DataFrame, keys: list[str]) -> DataFrame:
    """Warnings for internal links and navigation targets that no page or item of the book answers."""
    ids = found.where("id <> ''").select(*keys, F.col("id").alias("target")).distinct()
    named = found.select(*keys, "page", "item", F.explode("targets").alias("_t")).select(*keys, "page", "item", F.lit("warning").alias("severity"), "_t.path", "_t.code", "_t.target")
    return named.where("target <> ''").join(ids, [*keys, "target"], "left_anti").select(*keys, "page", "item", "severity", "path", "code")


def page_count_messages(found: DataFrame, keys: list[str]) -> DataFrame:
    """An error for each book (a head) without any page."""
    counts = found.groupBy(*keys).agg(F.count_if(F.col("level") == "page").alias("_pages"), F.count_if(F.col("level") == "book").alias("_heads"))
    return counts.where("_pages = 0 AND _heads > 0").select(*keys, F.lit(-1).alias("page"), F.lit(-1).alias("item"), F.lit("error").alias("severity"), F.lit("pages").alias("path"), F.lit("pages-missing").alias("code"))


def validate(heads: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """All messages about books: (keys, page, item, severity, path, code); ordinals are -1 where a message is not about a page or an item.

    heads: (keys, json) of a book without its pages, pages: (keys, page, json); split_books() makes both out of whole books.
    The documents are read once: what that finds is stored without them, and messages are drawn from it.
    A book, page or item that is no JSON object has the message that says so and those of a lack of everything.
    Equal messages of repeated rows stay. Keys of null are a book of their own, but link to nothing. Empty tables give no message.
    """
    found = stored(facts(head_elements(heads, keys).unionByName(page_elements(pages, keys)), keys))
    return reduce(DataFrame.unionByName, [f(found, keys) for f in (rule_messages, id_messages, reference_messages, page_count_messages)])


def statistics(heads: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of pages, items, internal and external links, assets and scenes of each book, as rows (keys, pages, items, ...)."""
    v = F.col("value")
    href, type_ = F.coalesce(text(v, "$.href"), F.lit("")), text(v, "$.type")
    link, src = (F.col("level") == "node") & (type_ == "link"), (F.col("level") == "item") & (F.coalesce(text(v, "$.src"), F.lit("")) != "")
    counts = {
        "pages": F.col("level") == "page", "items": F.col("level") == "item", "internal_links": link & href.startswith("#"), "external_links": link & ~href.startswith("#"),
        "assets": src & (type_ == "figure"), "scenes": src & (type_ == "scene"),
    }
    elements = head_elements(heads, keys).unionByName(page_elements(pages, keys))
    return elements.groupBy(*keys).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()])
