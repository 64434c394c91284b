"""Lab presets: search and status filter, discovery from scenes and steps, layered queries, save, archive, restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import first_nonblank
from folioflow.operators.setops import canonical_url, layered, query_map, suppress_overlaps, url_origin


def visible(presets: DataFrame, status_class: Column, query: str = "", status: str = "") -> DataFrame:
    """Archived presets hide unless asked for; the status is equal and the joined text, the query map as JSON among it, contains the query."""
    out = presets.where(status_class == status if status else status_class != "archived")
    q = query.strip().lower()
    if not q:
        return out
    text = F.lower(F.concat_ws(" ", "lab_id", "title", "preset_id", "description", "status", F.to_json("query"), "url"))
    return out.where(text.contains(q))


def full_query(default: Column, preset: Column, state: Column | None = None, printed: Column | None = None) -> Column:
    """default < preset < state < print; a blank deletes a key."""
    maps = [m for m in (default, preset, state, printed) if m is not None]
    empty = F.create_map().cast("map<string,string>")
    return layered(*[F.coalesce(m, empty) for m in maps])


def discover(scenes: DataFrame, labs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Presets out of scene urls: the first lab with the url's origin, the url's query, one for each canonical url.

    scenes: (ord, title, src); labs: (lab_id, lab_ord, base_url); known: presets (lab_id, compare_keys) that labs have already.
    """
    first = labs.select(url_origin(F.col("base_url")).alias("origin"), F.struct("lab_ord", "lab_id").alias("l")).groupBy("origin").agg(F.min("l").alias("l"))
    rows = scenes.where(F.coalesce(F.trim("src"), F.lit("")) != "").withColumn("origin", url_origin(F.col("src"))).join(first, "origin")
    query = query_map(F.regexp_extract("src", r"\?([^#]*)", 1))
    found = rows.select("ord", F.col("l.lab_id").alias("lab_id"), first_nonblank(F.col("title"), F.col("src")).alias("title"), query.alias("query"), canonical_url(F.col("src")).alias("url"))
    offered = found.withColumn("compare_keys", F.array("url")).withColumn("_new", F.lit(True))
    if known is not None:
        offered = offered.unionByName(known.select("lab_id", "compare_keys", F.lit(False).alias("_new")), allowMissingColumns=True)
    return suppress_overlaps(offered, ["lab_id"], "compare_keys", ["_new", "ord"]).where("_new").drop("_new")


def archive(presets: DataFrame, where: Column) -> DataFrame:
    """Archives matching presets and keeps the status they had."""
    hit = F.coalesce(where, F.lit(False)) & (F.col("status") != "archived")
    return presets.withColumn("previous_status", F.when(hit, F.col("status")).otherwise(F.col("previous_status"))).withColumn("status", F.when(hit, "archived").otherwise(F.col("status")))


def restore(presets: DataFrame, where: Column) -> DataFrame:
    """Gives archived presets their former status back; 'ready' where none is known."""
    hit = F.coalesce(where, F.lit(False)) & (F.col("status") == "archived")
    return presets.withColumn("status", F.when(hit, F.coalesce("previous_status", F.lit("ready"))).otherwise(F.col("status"))).withColumn("previous_status", F.when(hit, F.lit(None).cast("string")).otherwise(F.col("previous_status")))
