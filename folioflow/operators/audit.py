"""Integrity: statistics, duplicate ids, reference edges, broken and incoming references, messages as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators.setops import spread_join, url_origin


def stats_by_type(items: DataFrame, keys: list[str], type_: str = "type") -> DataFrame:
    return items.groupBy(*keys, type_).agg(F.count("*").alias("n"))


def duplicate_ids(ids: DataFrame, keys: list[str]) -> DataFrame:
    """Ids that occur more than once, and how many repeats each has."""
    return ids.groupBy(*keys).agg((F.count("*") - 1).alias("repeats")).where(F.col("repeats") > 0)


def nested(nodes: Column, schema: T.DataType, child: str = "children") -> list[Column]:
    """The arrays of nodes at every depth that the schema has, the outermost first."""
    out = [nodes]
    kind = schema.elementType
    while child in kind.names:
        nodes = F.flatten(F.transform(nodes, lambda n: F.coalesce(n[child], F.array().cast(kind[child].dataType))))  # noqa: B023
        kind = kind[child].dataType.elementType
        out.append(nodes)
    return out


def field_type(df: DataFrame, path: str) -> T.DataType:
    kind: T.DataType = df.schema
    for part in path.split("."):
        kind = kind[part].dataType
    return kind


def reference_edges(items: DataFrame, keys: list[str], body: str = "body.nodes") -> DataFrame:
    """(keys, kind, target): links of rich-text bodies at any depth, sources of figures and scenes; one row for each reference.

    A link whose href starts with '#' is an internal-link to what follows; every
    other, an empty one too, is an external-link. target, the name of a window,
    has no say. Links of null bodies and null hrefs of links are '' targets.
    """
    kind, links = field_type(items, body).elementType, []
    for level in nested(F.col(body), field_type(items, body)):
        if "href" in kind.names:
            own = F.filter(level, lambda n: n["type"] == "link")
            links.append(F.coalesce(F.transform(own, lambda n: F.coalesce(n["href"], F.lit(""))), F.array().cast("array<string>")))
        kind = kind["children"].dataType.elementType if "children" in kind.names else kind
    href = F.col("href")
    found = items.select(*keys, F.explode(F.concat(*links)).alias("href"))
    internal = href.startswith("#")
    out = found.select(*keys, F.when(internal, "internal-link").otherwise("external-link").alias("kind"), F.when(internal, F.substring(href, 2, 1 << 30)).otherwise(href).alias("target"))
    src = items.where(F.col("type").isin("figure", "scene") & (F.coalesce("src", F.lit("")) != ""))
    return out.unionByName(src.select(*keys, F.when(F.col("type") == "scene", "scene").otherwise("asset").alias("kind"), F.col("src").alias("target")))


def nav_edges(groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, target) of navigation groups (target, entries: array<struct<target>>): a nav-target for each that has one."""
    every = F.concat(F.array("target"), F.coalesce(F.transform("entries", lambda e: e["target"]), F.array().cast("array<string>")))
    found = groups.select(*keys, F.explode(every).alias("target")).where("target <> ''")
    return found.select(*keys, F.lit("nav-target").alias("kind"), F.regexp_replace("target", "^#", "").alias("target"))


def broken_references(refs: DataFrame, ids: DataFrame, target: str = "target", id_: str = "id") -> DataFrame:
    """References with a target that no id answers: a left anti join. Of edges with a kind, internal links and navigation targets alone count."""
    named = refs.where(F.coalesce(F.trim(target), F.lit("")) != "")
    if "kind" in refs.columns:
        named = named.where(F.col("kind").isin("internal-link", "nav-target"))
    return named.join(ids.select(F.col(id_).alias(target)), target, "left_anti")


def incoming_references(refs: DataFrame, target: str = "target") -> DataFrame:
    return refs.groupBy(target).agg(F.count("*").alias("incoming"))


def source_range(rows: DataFrame, keys: list[str], page: str) -> DataFrame:
    """'min' or 'min-max' of the source pages."""
    lo, hi = F.min(page), F.max(page)
    return rows.groupBy(*keys).agg(F.when(lo == hi, lo.cast("string")).otherwise(F.concat_ws("-", lo.cast("string"), hi.cast("string"))).alias("source_range"))


def messages(items: DataFrame, keys: list[str], known_types: list[str]) -> DataFrame:
    """(keys, severity, code): checks on items, evaluated in one pass over the rows."""
    checks = [
        ("error", "missing-id", F.coalesce(F.trim("id"), F.lit("")) == ""),
        ("error", "unknown-type", ~F.coalesce(F.col("type").isin(known_types), F.lit(False))),
        ("warning", "figure-without-alt", (F.col("type") == "figure") & (F.coalesce(F.trim("alt"), F.lit("")) == "")),
        ("warning", "media-without-source", F.col("type").isin("figure", "scene") & (F.coalesce(F.trim("src"), F.lit("")) == "")),
    ]
    found = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"))) for sev, code, cond in checks])
    return items.select(*keys, F.explode(F.filter(found, lambda m: m.isNotNull())).alias("m")).select(*keys, "m.severity", "m.code")


def headings_for_entries(headings: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """Headings up to a depth that share page and (id or source paragraph) with a selected entry: a union of two semi-joins."""
    shallow = headings.where(F.col("level") <= depth)
    by_id = shallow.join(entries.select("page", "id"), ["page", "id"], "left_semi")
    by_paragraph = shallow.join(entries.select("page", "source_paragraph"), ["page", "source_paragraph"], "left_semi")
    return by_id.unionByName(by_paragraph).distinct()


def duplicate_evidence(entries: DataFrame, existing: DataFrame, keys: list[str], signature: list[str]) -> DataFrame:
    """Import evidence: hits among existing signatures, and whether they reach max(2, ceil(0.7 n)). A signature that many entries share is no hot key."""
    known = existing.select(*signature).distinct().withColumn("_hit", F.lit(1))
    met = spread_join(entries, known, signature)
    out = met.groupBy(*keys).agg(F.count("*").alias("n"), F.count("_hit").alias("hits"))
    return out.withColumn("duplicate", F.col("hits") >= F.greatest(F.lit(2), F.ceil(F.col("n") * 0.7)))


def local_scenes(items: DataFrame, keys: list[str], origin: str, type_: str = "type", src: str = "src") -> DataFrame:
    """(keys, src) of the distinct scenes that the given server delivers: those to be asked for before a book is printed."""
    named = items.where((F.col(type_) == "scene") & (url_origin(F.trim(src)) == origin.lower()))
    return named.select(*keys, F.trim(src).alias("src")).distinct()
