"""Item-level expressions: splitting units, continuation rows, bullets, sequence steps, anchors, editors of array fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import atoms, first_nonblank, normalize_id, slugify

STRUCTURAL = ["hero", "part_title", "section_heading", "scene", "interactive_callout", "nav_anchor", "figure", "table", "dialogue"]


def splittable_units(type_: Column, placement: Column, text: Column, rows: Column) -> Column:
    """Atoms of flowing text, entries of lists, rows of tables and dialogues; 0 for what cannot be split."""
    wide = F.coalesce(placement, F.lit("wide")) == "wide"
    flows = type_.isin("paragraph", "note") | ((type_ == "side_note") & wide)
    return F.when(flows, F.size(atoms(F.coalesce(text, F.lit(""))))).when(type_.isin("list", "table", "dialogue"), F.greatest(F.coalesce(F.size(rows), F.lit(0)), F.lit(0))).otherwise(0)


def split_rows(items: DataFrame, n: Column, part: int = 2, rows: str = "rows", header_rows: str = "header_rows", start: str = "start", ordered: str = "ordered", id_: str = "id") -> DataFrame:
    """Splits lists, tables and dialogues at n entries: two rows, of which the second continues.

    An ordered list goes on counting, a table repeats its header rows, the
    continuation's id ends in --cont-<part>. Items that n does not divide stay one row.
    """
    cut = items.withColumn("_n", n).withColumn("_cut", (F.col("_n") > 0) & (F.col("_n") < F.size(rows)))
    first = cut.withColumn(rows, F.when(F.col("_cut"), F.slice(rows, F.lit(1), F.col("_n"))).otherwise(F.col(rows))).withColumn("split_part", F.lit(1))
    rest = cut.where("_cut")
    heads = F.slice(rows, F.lit(1), F.least(F.coalesce(header_rows, F.lit(0)), F.col("_n")))
    tail = F.slice(rows, F.col("_n") + 1, F.size(rows))
    rest = rest.withColumn(rows, F.when(F.col("type") == "table", F.concat(heads, tail)).otherwise(tail))
    rest = rest.withColumn(start, F.when(F.coalesce(ordered, F.lit(False)), F.coalesce(start, F.lit(1)) + F.col("_n")).otherwise(F.col(start)))
    rest = rest.withColumn(id_, F.concat(id_, F.lit(f"--cont-{part}"))).withColumn("split_part", F.lit(part))
    return first.unionByName(rest).drop("_n", "_cut")


def bullets(values: Column) -> Column:
    """array<struct(level, text)> of bullet lines: each leading ↳ is a level, one bullet mark goes, blanks go, the least level is 0."""
    parsed = F.transform(
        values,
        lambda v: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(F.trim(v), r"^((?:↳\s*)*)", 1), r"[^↳]", "")).alias("level"),
            F.regexp_replace(F.trim(F.regexp_replace(F.trim(v), r"^(?:↳\s*)+", "")), r"^[•*-]\s+", "").alias("text"),
        ),
    )
    kept = F.filter(parsed, lambda e: F.coalesce(e["text"], F.lit("")) != "")
    least = F.array_min(F.transform(kept, lambda e: e["level"]))
    return F.transform(kept, lambda e: F.struct((e["level"] - least).alias("level"), e["text"].alias("text")))


def bullets_text(entries: Column) -> Column:
    """Lines with one ↳ for each level, four at most."""
    return F.array_join(F.transform(entries, lambda e: F.concat(F.repeat(F.lit("↳ "), F.least(e["level"], F.lit(4)).cast("int")), e["text"])), "\n")


def step_callouts(callouts: DataFrame, keys: list[str], fields: list[str], steps: str = "steps", id_: str = "id") -> DataFrame:
    """One callout for each step: a step's non-blank fields override the callout's; ids end in -step-<n>."""
    each = callouts.select(*keys, id_, *fields, F.posexplode(steps).alias("step_ord", "_s"))
    name = F.concat_ws("-step-", F.coalesce(F.col(id_), F.lit("callout")), (F.col("step_ord") + 1).cast("string"))
    return each.select(*keys, name.alias(id_), "step_ord", *[F.coalesce(first_nonblank(F.col(f"_s.{f}"), F.col(f)), F.lit("")).alias(f) for f in fields])


def query_value(x: Column) -> Column:
    """true is 1, false is 0, null is ''."""
    s = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(s == "true", "1").when(s == "false", "0").otherwise(s)


def anchor_id(id_: Column, type_: Column, page_id: Column, page_ord: Column, item_ord: Column, title: Column) -> Column:
    """The explicit id, else for structural items page, number and slug; '' for others."""
    page = first_nonblank(normalize_id(F.coalesce(page_id, F.lit(""))), F.concat(F.lit("page-"), (page_ord + 1).cast("string")))
    made = normalize_id(F.concat_ws("-", page, (item_ord + 1).cast("string"), slugify(F.coalesce(title, type_), 48, "anchor")))
    explicit = normalize_id(F.coalesce(id_, F.lit("")))
    return F.when(explicit != "", explicit).when(type_.isin(STRUCTURAL), made).otherwise("")


def available_height(height: Column, top: Column, bottom: Column) -> Column:
    return F.greatest(F.lit(1.0), height - F.coalesce(top, F.lit(0.0)) - F.coalesce(bottom, F.lit(0.0)))


def is_hard_break(flag: Column, page_break: Column) -> Column:
    """Whether an item begins a page: its pagination flag, or the page break of its style. Its type has no say."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(page_break, F.lit(False))


def clean_extra(entry: Column) -> Column:
    """Defaults of an extras entry; answer lines from 0 to 12."""
    text = lambda n, d="": F.coalesce(entry[n], F.lit(d)).alias(n)
    return F.struct(text("type", "question"), text("label"), text("text"), text("answer"), F.greatest(F.lit(0), F.least(F.lit(12), F.coalesce(entry["answerLines"], F.lit(0)))).alias("answerLines"))


def copy_title(title: Column, mark: str = "παραλλαγή", new: str = "Νέο ") -> Column:
    t = F.trim(title)
    return F.when(t.startswith(new) | t.contains(mark), t).otherwise(F.concat_ws(" - ", t, F.lit(mark)))


def list_entry(line: Column) -> Column:
    return F.struct(F.lit(0).alias("level"), F.trim(line).alias("text"))


def set_at(values: Column, at: int, value: Column) -> Column:
    """An array with the entry at `at` (from 0) replaced; other places stay."""
    return F.transform(values, lambda v, i: F.when(i == at, value).otherwise(v))


def remove_at(values: Column, at: int) -> Column:
    return F.filter(values, lambda v, i: i != at)


def insert_at(values: Column, at: int, value: Column) -> Column:
    return F.concat(F.slice(values, 1, at), F.array(value), F.slice(values, at + 1, F.greatest(F.size(values), F.lit(1))))


def move_at(values: Column, at: int, by: int) -> Column:
    """Moves an entry, clamped to the ends."""
    n = F.size(values)
    to = F.least(F.greatest(F.lit(at + by), F.lit(0)), n - 1)
    moved = F.transform(values, lambda v, i: F.struct(F.when(i == at, to + F.lit(0.5 if by > 0 else -0.5)).otherwise(i.cast("double")).alias("k"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(moved), lambda e: e["v"])


def value_at(document: Column, path: str, kind: str = "string") -> Column:
    """A value of a JSON document by a path such as $.a[0].b; null where there is none."""
    return F.try_variant_get(F.try_parse_json(document), path, kind)
