"""Greedy pagination of units with given heights: a fold over each book's ordered units."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators.fold import fold_sorted


def greedy(heights: list[float], headings: list[bool], breaks: list[bool], available: float) -> list[int]:
    """The page (from 0) of each unit.

    A unit that does not fit opens a page, and takes a heading that stands last
    on a page with more than itself along; a heading alone stays with its
    successor even over the limit. A hard break opens a page unless one is just open.
    """
    pages: list[int] = []
    page, used, on_page = 0, 0.0, 0
    for i, raw in enumerate(heights):
        h = max(1.0, raw or 1.0)
        if breaks[i] and on_page:
            page, used, on_page = page + 1, 0.0, 0
        if on_page and used + h > available and not (headings[i - 1] and on_page == 1):
            page += 1
            used, on_page = 0.0, 0
            if headings[i - 1]:
                pages[-1] = page
                used, on_page = max(1.0, heights[i - 1] or 1.0), 1
        pages.append(page)
        used, on_page = used + h, on_page + 1
    return pages


def paginate(units: DataFrame, keys: list[str], order: list[str], height: str, heading: str, hard_break: str, available: float) -> DataFrame:
    """Adds `page` to the units of each book; units without a book go."""

    def fold(rows: pd.DataFrame, bounds: list[tuple[int, int]]) -> pd.DataFrame:
        h = rows[height].fillna(1.0).to_numpy(dtype=float).tolist()
        hd, br = (rows[c].fillna(False).astype(bool).tolist() for c in (heading, hard_break))
        pages = [p for lo, hi in bounds for p in greedy(h[lo:hi], hd[lo:hi], br[lo:hi], available)]
        return rows.assign(page=np.array(pages, dtype=np.int32))

    return fold_sorted(units, keys, order, [T.StructField("page", T.IntegerType())], fold)


def most_that_fit(parts: list[float], room: float) -> int:
    """How many leading parts fit, by binary search over their running sums."""
    ends = np.cumsum(parts)
    return int(np.searchsorted(ends, room + 1e-9, side="right"))


#: Types of running text (fixed values), and the parts that a split of them leaves on either side.
PROSE = ("paragraph", "note", "side_note")
PROSE_LEAST = 3


def repaired(parts: list[list[float]], headings: list[bool], available: float, leasts: list[int] | None = None) -> list[tuple[int, int, int, int]]:
    """(unit, page, first part, last part + 1): units that do not fit are split where most of their parts fit.

    A split of a unit leaves at least `leasts` of its parts on either side, else the unit moves whole; a unit
    that is higher than a page and cannot be split stands alone; a heading last on
    its page moves on with what follows.
    """
    out: list[tuple[int, int, int, int]] = []
    page, room = 0, available

    def turn() -> None:
        nonlocal page, room
        page, room = page + 1, available

    for u, own in enumerate(parts):
        at, least = 0, leasts[u] if leasts else PROSE_LEAST
        while at < len(own):
            rest = own[at:]
            if sum(rest) <= room:
                n = len(rest)
            else:
                n = most_that_fit(rest, room)
                n = min(n, len(rest) - least)
                if n < least:
                    if room < available:
                        move = out and out[-1][1] == page and headings[out[-1][0]] and sum(1 for x in out if x[1] == page) > 1
                        turn()
                        if move:
                            unit, _, a, b = out.pop()
                            out.append((unit, page, a, b))
                            room -= sum(parts[unit][a:b])
                            if room >= sum(rest):
                                continue
                        if sum(rest) <= room or most_that_fit(rest, room) >= least:
                            continue
                    n = len(rest)
            out.append((u, page, at, at + n))
            room -= sum(rest[:n])
            at += n
            if at < len(own):
                turn()
        if room <= 0 and u + 1 < len(parts):
            turn()
    return out


def paginate_split(units: DataFrame, keys: list[str], order: list[str], part_heights: str, heading: str, available: float, type_: str | None = None) -> DataFrame:
    """Places units by the heights of their parts (array<double>), splitting those that do not fit.

    Paragraphs and notes keep PROSE_LEAST parts on either side of a split, other types (lists, tables) one; without a type
    column all units are prose. Adds page, from_part and to_part (exclusive); a split unit has a row for each page.
    """

    def fold(rows: pd.DataFrame, bounds: list[tuple[int, int]]) -> pd.DataFrame:
        heads = rows[heading].fillna(False).astype(bool).tolist()
        parts = [[max(0.0, float(h or 0)) for h in x] if x is not None and len(x) else [1.0] for x in rows[part_heights]]
        leasts = [PROSE_LEAST if type_ is None or t in PROSE else 1 for t in (rows[type_] if type_ else heads)]
        placed = [(lo + u, p, a, b) for lo, hi in bounds for u, p, a, b in repaired(parts[lo:hi], heads[lo:hi], available, leasts[lo:hi])]
        at, page, first, last = (np.array(c, dtype=np.int32) for c in zip(*placed, strict=True))
        return rows.iloc[at].reset_index(drop=True).assign(page=page, from_part=first, to_part=last)

    fields = [T.StructField(n, T.IntegerType()) for n in ("page", "from_part", "to_part")]
    return fold_sorted(units, keys, order, fields, fold)


def overflow_pages(placed: DataFrame, keys: list[str], height: str, available: float, tolerance: float = 1.0) -> DataFrame:
    """Pages whose units are higher than what is available, by how much."""
    used = placed.groupBy(*keys, "page").agg(F.sum(F.greatest(F.lit(1.0), F.coalesce(height, F.lit(1.0)))).alias("used"))
    return used.where(F.col("used") - available > tolerance).withColumn("overflow", F.col("used") - available)


def pagination_report(placed: DataFrame, keys: list[str], unit: list[str], type_: str, hard_break: Column) -> DataFrame:
    """Counters of paginate_split() results by book: pages made, units split, the cuts by type, units that begin a page by force.

    unit: the columns that name a unit within its book; a unit on n pages has been cut n - 1 times.
    """
    units = placed.groupBy(*keys, *unit).agg(F.first(type_).alias("_type"), F.count("*").alias("_pages"), F.max(hard_break).alias("_hard"))
    cuts = units.where("_pages > 1").groupBy(*keys, "_type").agg(F.sum(F.col("_pages") - 1).alias("n"), F.count("*").alias("units"))
    split = cuts.groupBy(*keys).agg(F.sum("units").alias("split_units"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("_type", "n")))).alias("splits_by_type"))
    pages = placed.groupBy(*keys).agg(F.count_distinct("page").alias("pages"))
    hard = units.groupBy(*keys).agg(F.count_if("_hard").alias("hard_breaks"))
    none = F.create_map().cast("map<string,bigint>")
    out = pages.join(hard, keys, "left").join(split, keys, "left")
    return out.select(*keys, "pages", F.coalesce("hard_breaks", F.lit(0)).alias("hard_breaks"), F.coalesce("split_units", F.lit(0)).alias("split_units"), F.coalesce("splits_by_type", none).alias("splits_by_type"))
