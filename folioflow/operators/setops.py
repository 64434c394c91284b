"""Maps and sets: parameter maps, differences, overlaps, lookups with a default, priority lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators.fold import fold_sorted
from folioflow.session import checkpointed


def string_map(m: Column) -> Column:
    """A map without null and blank values."""
    return F.map_filter(m, lambda k, v: F.coalesce(v, F.lit("")) != "")


def map_changed(base: Column, applied: Column) -> Column:
    """Entries of `applied` that `base` lacks or has with another value; blanks are dropped from both first."""
    b, a = string_map(base), string_map(applied)
    return F.map_filter(a, lambda k, v: ~F.coalesce(F.try_element_at(b, k) == v, F.lit(False)))


def map_removed(base: Column, applied: Column) -> Column:
    """Sorted keys of `base` that `applied` lacks."""
    return F.array_sort(F.array_except(F.map_keys(string_map(base)), F.map_keys(string_map(applied))))


def layered(*maps: Column) -> Column:
    """Later maps override earlier ones; a null or blank value deletes the key."""
    out = maps[0]
    for m in maps[1:]:
        over = m
        kept = F.map_from_entries(F.filter(F.map_entries(out), lambda e: ~F.array_contains(F.map_keys(over), e["key"])))  # noqa: B023
        out = F.map_concat(kept, over)
    return string_map(out)


def query_map(query: Column) -> Column:
    """'a=1&b&c=x%20y' as a map: keys and values decoded, a bare key is '1', the last of repeated keys wins."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    decode = lambda s: F.coalesce(F.try_url_decode(s), s)
    key = lambda p: decode(F.regexp_extract(p, "^([^=]*)", 1))
    value = lambda p: F.when(p.contains("="), decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1))).otherwise("1")
    entries = F.transform(pairs, lambda p: F.struct(key(p).alias("key"), value(p).alias("value")))
    n = F.size(entries)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def lines_map(text: Column) -> Column:
    """'k=v' lines as a map; the first '=' divides, a bare key is '1'."""
    lines = F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != ""), "&")
    return query_map(lines)


def canonical_url(url: Column) -> Column:
    """Query pairs sorted by key then value, the fragment dropped."""
    bare = F.regexp_replace(url, "#.*$", "")
    base, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    pairs = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.when(pairs != "", F.concat_ws("?", base, pairs)).otherwise(base)


def url_origin(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^([a-z][a-z0-9+.\-]*://[^/?#]*)", 1)


def priority_top(m: Column, order: list[str], n: int = 6) -> Column:
    """The first n entries by a priority list (what it lacks comes last), then by key, as 'key: value' joined by ' · '."""
    names = F.array(*[F.lit(x) for x in order])
    rank = lambda k: F.when(F.array_contains(names, k), F.array_position(names, k) - 1).otherwise(999)
    ranked = F.array_sort(F.transform(F.map_entries(string_map(m)), lambda e: F.struct(rank(e["key"]).alias("r"), e["key"].alias("k"), e["value"].alias("v"))))
    return F.array_join(F.transform(F.slice(ranked, 1, n), lambda e: F.concat_ws(": ", e["k"], e["v"])), " · ")


def _matched(rows: DataFrame, lookup: DataFrame, on: list[str], pick) -> DataFrame:
    rest = [c for c in lookup.columns if c not in on]
    found = lookup.groupBy(*on).agg(pick(F.struct(*rest)).alias("_m"))
    return rows.join(found, on, "left").select("*", *[F.col(f"_m.{c}").alias(c) for c in rest]).drop("_m")


def first_match(rows: DataFrame, lookup: DataFrame, on: list[str], order: str) -> DataFrame:
    """Left join with the first lookup row of each key, null orders before all; a key's rows are reduced before they are shuffled."""
    return _matched(rows, lookup, on, lambda row: F.min_by(row, F.struct(order)))


def last_match(rows: DataFrame, lookup: DataFrame, on: list[str], order: str) -> DataFrame:
    """Left join with the last lookup row of each key: what a map built in order would answer."""
    return _matched(rows, lookup, on, lambda row: F.max_by(row, F.struct(order)))


def with_default(rows: DataFrame, registry: DataFrame, on: str, key: str, out: str) -> DataFrame:
    """rows with the registry entry that column `on` names as `out`, else the registry's first key; null in an empty registry. One key goes through the driver."""
    first = registry.agg(F.min(key).alias("_k")).first()["_k"]
    known = registry.select(F.col(key).alias("_key")).distinct()
    return rows.join(known, F.col(on) == F.col("_key"), "left").withColumn(out, F.coalesce("_key", F.lit(first))).drop("_key")


def spread_join(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """rows left-joined with found, one row for each key of rows; no task gets all rows of a key that many have.

    Keys that more than a thousandth of rows have are at most a thousand; they are broadcast, the others are shuffled.
    The keys with what they find are checkpointed, so they are counted once. Null keys find nothing.
    """
    rest = [c for c in found.columns if c not in on]
    counts = checkpointed(rows.groupBy(*on).agg(F.count("*").alias("_n")).join(found, on, "left"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.col("_n") * 1000 > max(total, 1_000_000)
    heavy = F.broadcast(counts.where(hot).select(*on, *rest))
    light = counts.where(~hot).select(*on, *rest)
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(*on), on, "left_anti").join(light, on, "left"))


def suppress_overlaps(presets: DataFrame, lab: list[str], key_set: str, order: list[str], id_: str | None = None) -> DataFrame:
    """Presets that a lab takes, offered in order: one goes that shares a compare key, or its id, with one the lab has already.

    A preset that goes takes nothing with it: its other keys stay free. Known
    presets are offered first, by `order`. The fold holds the keys taken by one lab; rows without a lab go.
    """

    def fold(rows: pd.DataFrame, bounds: list[tuple[int, int]]) -> pd.DataFrame:
        taken = np.zeros(len(rows), dtype=bool)
        keys = [frozenset() if k is None else frozenset(k) for k in rows[key_set]]
        names = [str(i or "").strip() for i in rows[id_]] if id_ else [""] * len(rows)
        for lo, hi in bounds:
            seen_keys, seen_names = set(), set()
            for i in range(lo, hi):
                if keys[i] & seen_keys or (names[i] and names[i] in seen_names):
                    continue
                taken[i] = True
                seen_keys |= keys[i]
                seen_names.add(names[i])
        return rows.assign(_taken=taken)

    return fold_sorted(presets, lab, order, [T.StructField("_taken", T.BooleanType())], fold).where("_taken").drop("_taken")


def object_diff(base: Column, applied: Column) -> Column:
    """Entries of the map `applied` whose value, as JSON, is not that of `base`; what base alone has is no change."""
    same = lambda k, v: F.map_contains_key(base, k) & F.try_element_at(base, k).eqNullSafe(v)
    return F.when(base.isNull(), applied).otherwise(F.map_filter(applied, lambda k, v: ~F.coalesce(same(k, v), F.lit(False))))


def parameter_keys(rows: DataFrame, keys: list[str], order: list[str], params: str) -> DataFrame:
    """Distinct parameter keys in the order first seen."""
    seen = rows.select(*keys, *order, F.posexplode(F.map_keys(params)).alias("_p", "param"))
    return seen.groupBy(*keys, "param").agg(F.min(F.struct(*order, "_p")).alias("first")).select(*keys, "param", "first")


def resolve_styles(styles: DataFrame) -> DataFrame:
    """Style inheritance along based_on: the nearest ancestor's value of each property wins, at any depth. See inherited()."""
    return inherited(styles.withColumn("props", string_map(F.col("props"))))


def inherited(styles: DataFrame) -> DataFrame:
    """(style_id, props): maps completed along based_on by the nearest ancestor that has the key; values may be of any type.

    styles: (style_id, based_on, props map). Each round doubles the length of the chains that are followed and is
    checkpointed. A style that is based on itself has no parent. Once a round closes no chain, those left run into cycles;
    they hold no more ids than there are such rows, so after as many steps an id would repeat.
    """
    up = F.when(F.col("based_on") != F.col("style_id"), F.col("based_on"))
    kind = styles.schema["props"].dataType
    cur = checkpointed(styles.select("style_id", up.alias("up"), "props"))
    steps, before, left = 1, None, cur.where("up is not null").count()
    while left and not (left == before and steps >= left):
        parent = cur.select(F.col("style_id").alias("up"), F.col("up").alias("_next"), F.col("props").alias("_props"))
        joined = cur.where("up is not null").join(parent, "up", "left")
        own = F.coalesce("_props", F.create_map().cast(kind))
        rest = F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys("props"), k))
        grown = joined.select("style_id", F.col("_next").alias("up"), F.map_concat("props", rest).alias("props"))
        cur = checkpointed(cur.where("up is null").union(grown))
        steps, before, left = steps * 2, left, cur.where("up is not null").count()
    return cur.select("style_id", "props")
