"""Where the entries of a map come from: three-way merges, edits of query parameters, scenes inserted with their provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.mutate import renumber
from folioflow.operators.setops import layered, map_changed, map_removed, string_map

#: Origins of an entry of a three-way merge.
BASE, APPLIED, LOCAL, SAME, CONFLICT = "base", "applied", "local", "both", "conflict"
ENTRY = "array<struct<key:string,value:string,origin:string>>"


def three_way(base: Column, applied: Column, local: Column) -> Column:
    """Merges two descendants of a map: sorted entries (key, value, origin), keys that were deleted too, with a null value.

    A side that left an entry as in `base` yields to the other. origin is base (both left it), applied or local (that side
    changed, added or deleted it), both (they did the same), conflict (they did different things: local wins). Blank
    values are no entries; null maps are empty.
    """
    empty = F.create_map().cast("map<string,string>")
    b, a, l = (string_map(F.coalesce(m, empty)) for m in (base, applied, local))
    keys = F.array_sort(F.array_union(F.array_union(F.map_keys(b), F.map_keys(a)), F.map_keys(l)))

    def entry(k: Column) -> Column:
        was, left, right = (F.try_element_at(m, k) for m in (b, a, l))
        origin = (
            F.when(left.eqNullSafe(was) & right.eqNullSafe(was), BASE).when(right.eqNullSafe(was), APPLIED)
            .when(left.eqNullSafe(was), LOCAL).when(left.eqNullSafe(right), SAME).otherwise(CONFLICT)
        )
        return F.struct(k.alias("key"), F.when(right.eqNullSafe(was), left).otherwise(right).alias("value"), origin.alias("origin"))

    return F.transform(keys, entry)


def merged(entries: Column) -> Column:
    """The map that a three-way merge leaves."""
    kept = F.filter(entries, lambda e: e["value"].isNotNull())
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))


def rebased(base: Column, now: Column, applied: Column) -> Column:
    """The query of a scene whose preset has changed from `base` to `now` since it was applied: local changes stay, what was left alone follows."""
    return merged(three_way(base, now, applied))


def with_parameter(query: Column, key: Column, value: Column) -> Column:
    """A query map with a parameter set to the trimmed value, or taken out where that is blank or null."""
    return layered(query, F.create_map(key, F.trim(F.coalesce(value, F.lit("")))))


def provenance(base: Column, applied: Column) -> Column:
    """struct(applied_query, local_query, removed_keys): what a scene has, what it has of its own, what of its preset it lacks."""
    return F.struct(string_map(applied).alias("applied_query"), map_changed(base, applied).alias("local_query"), map_removed(base, applied).alias("removed_keys"))


def insert_scenes(items: DataFrame, scenes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Items with scenes inserted next to their anchors; a sequence callout right before a scene is linked to it.

    items: (keys, order, id, type, scene_id); scenes: (keys, id, anchor, placement 'after' or 'before', base, applied), at most one
    for each anchor. A scene whose anchor is missing or null stands last, with placement 'before' first. A callout that is
    an anchor with placement 'after' takes the scene's id as scene_id if it has none. Adds source (provenance(), null for items that were there).
    """
    shape = items.select(*keys, order, "id", "type", "scene_id")
    anchors = shape.select(*keys, F.col("id").alias("anchor"), F.col(order).alias("_at"))
    placed = scenes.withColumn("_before", F.coalesce(F.col("placement") == "before", F.lit(False))).join(anchors, [*keys, "anchor"], "left")
    ends = shape.groupBy(*keys).agg(F.max(order).alias("_last"))
    placed = placed.join(ends, keys)
    side = F.when(F.col("_before"), F.lit(-1)).otherwise(1)
    at = F.coalesce("_at", F.when(F.col("_before"), F.lit(-1)).otherwise(F.col("_last") + 1))
    new = placed.select(*keys, at.cast("double").alias("_place"), side.alias("_side"), F.col("id"), F.lit("scene").alias("type"), F.lit(None).cast("string").alias("scene_id"), provenance(F.col("base"), F.col("applied")).alias("source"))
    linked = placed.where(~F.col("_before") & F.col("_at").isNotNull()).select(*keys, F.col("anchor").alias("id"), F.col("id").alias("_scene"))
    old = shape.join(linked, [*keys, "id"], "left")
    takes = (F.col("type") == "interactive_callout") & (F.coalesce("scene_id", F.lit("")) == "")
    old = old.withColumn("scene_id", F.when(takes & F.col("_scene").isNotNull(), F.col("_scene")).otherwise(F.col("scene_id")))
    old = old.select(*keys, F.col(order).cast("double").alias("_place"), F.lit(0).alias("_side"), "id", "type", "scene_id", F.lit(None).cast(new.schema["source"].dataType).alias("source"))
    both = old.unionByName(new).withColumn(order, F.lit(0).cast(items.schema[order].dataType))
    return renumber(both, keys, [F.col("_place"), F.col("_side"), F.col("id")], order).drop("_place", "_side")
