"""Pagination with feedback: the pages of a first, estimated packing are measured, and what does not fit is mended until it does.

Every book is a fold over its ordered units. Heights are columns, as everywhere in this library: `parts` has
the height of each part a unit may be cut between, `widths` the heights that a captioned figure has when it is
set wider. A page measures the sum of what stands on it and a gap between neighbours.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators.fold import fold_sorted_arrow
from folioflow.operators.paginate import PROSE, PROSE_LEAST, greedy

#: How much wider a captioned figure may be set, tried in this order (fixed values).
WIDER = (1.2, 1.4, 1.65, 2.0)


def figure_widths(current: Column, content: Column) -> Column:
    """The widths to try for a figure of width `current` (80 at least, 340 if unknown): each wider than it, none wider than the text."""
    now = F.greatest(F.lit(80.0), F.coalesce(current, F.lit(340.0)))
    text = F.greatest(now, content)
    tried = F.array(*[F.least(text, F.floor(now * f + 0.5).cast("double")) for f in WIDER])
    return F.array_distinct(F.filter(tried, lambda w: w > now))


@dataclass(slots=True)
class Unit:
    """What a fold knows of one unit; ends are running sums of its parts' heights."""

    type: str
    heading: bool
    pair: bool
    ends: list[float]
    widths: list[tuple[float, float]]


@dataclass(slots=True)
class Piece:
    """Parts first..last of a unit; width is the number of the chosen width, or None."""

    unit: int
    first: int
    last: int
    width: int | None = None


@dataclass
class Mending:
    """The pages of one book while they are mended."""

    units: list[Unit]
    room: float
    gap: float
    pages: list[tuple[list[Piece], float]] = field(default_factory=list)

    def height(self, piece: Piece) -> float:
        unit = self.units[piece.unit]
        if piece.width is not None:
            return unit.widths[piece.width][1]
        return unit.ends[piece.last] - unit.ends[piece.first]

    def measure(self, page: list[Piece]) -> float:
        return sum(map(self.height, page)) + self.gap * max(0, len(page) - 1)

    def widened(self, piece: Piece) -> Piece | None:
        unit = self.units[piece.unit]
        if piece.width is None:
            return next((Piece(piece.unit, piece.first, piece.last, k) for k, (_, h) in enumerate(unit.widths) if h <= self.room), None)
        return None

    def cut(self, piece: Piece, above: float) -> tuple[Piece, Piece] | None:
        """As much of a piece as fits under what stands above it, and the rest; None where too little of it would stay."""
        unit, parts = self.units[piece.unit], piece.last - piece.first
        if unit.pair or parts < 2:
            return None
        fits = bisect_right(unit.ends, unit.ends[piece.first] + self.room - above, piece.first + 1, piece.last) - piece.first - 1
        least = min(PROSE_LEAST, parts - 1) if unit.type in PROSE else 1
        at = piece.first + fits
        return (Piece(piece.unit, piece.first, at, piece.width), Piece(piece.unit, at, piece.last, piece.width)) if fits >= least else None

    def shed(self, page: list[Piece]) -> tuple[list[Piece], list[Piece]] | None:
        """(page, what goes on to the next one) after one step, or None where nothing can be done."""
        *above, last = page
        led = len(above) == 1 and self.units[above[0].unit].heading
        if not above and not self.units[last.unit].pair and (wide := self.widened(last)):
            return [wide], []
        if (not above or led) and (halves := self.cut(last, self.measure(above) + self.gap if above else 0.0)):
            return [*above, halves[0]], [halves[1]]
        if not above or led:
            return None
        if self.units[above[-1].unit].heading:
            return above[:-1], [above[-1], last]
        return above, [last]

    def run(self, first: list[list[Piece]]) -> list[tuple[list[Piece], float]]:
        waiting = deque(first)
        while waiting:
            page = waiting.popleft()
            while page and self.measure(page) > self.room and (step := self.shed(page)):
                page, rest = step
                if rest:
                    if not waiting:
                        waiting.append([])
                    waiting[0][:0] = rest
            if page:
                self.pages.append((page, max(0.0, self.measure(page) - self.room)))
        return self.pages


def listed(column: pa.ChunkedArray, values: Callable[[pa.Array], list]) -> list[list]:
    """A list for each row of a column of arrays, all elements made by one call of `values`; null is empty."""
    own = column.combine_chunks()
    flat = values(own.flatten())
    ends = [0, *accumulate(own.value_lengths().fill_null(0).to_pylist())]
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def paginate_repaired(
    units: DataFrame, keys: list[str], order: list[str], available: float, gap: float = 0.0, tolerance: float = 1.0,
    parts: str = "parts", type_: str = "type", heading: str = "heading", hard_break: str = "hard_break", pair: str = "pair", widths: str = "widths",
) -> DataFrame:
    """Places units on pages: packed by their own heights, then measured with gaps and mended page by page.

    parts: array<double>, the heights of a unit's parts (null or empty: one part of height 1; null or negative
    heights count 0); widths: array<struct<width, height>>, the wider settings of a captioned figure in the order
    in which they are tried (null: none). A page that is too high by more than `tolerance`
    - with one unit: sets a figure to the first width at which it fits, else keeps as many of the unit's leading
      parts as fit and sends the rest on. Prose keeps PROSE_LEAST parts, or all but one if it has no more; other
      types one. A pair is never cut. What can be neither widened nor cut stays and is too high (`overflow`).
    - with a heading and one unit: cuts the unit under its heading, else stays too high; a heading is not left alone.
    - with more: sends its last unit on, with the heading right above it.
    What is sent on stands first on the next page, which is measured in its turn.

    Adds page (from 0), from_part, to_part (exclusive), width (null unless it was changed) and overflow (null on
    pages that fit). A cut unit has a row for each page. Units without a book go; null flags are false; a null type is no
    prose. An empty table gives an empty one. One book is one fold: its units' heights are in a task's memory, its texts are not.
    """

    def fold(rows: pa.Table, bounds: list[tuple[int, int]]) -> pa.Table:
        flags = {c: rows[c].fill_null(False).to_pylist() for c in (heading, hard_break, pair)}
        types = rows[type_].to_pylist()
        heights = [h or [1.0] for h in listed(rows[parts], lambda own: np.fmax(np.nan_to_num(own.cast(pa.float64()).fill_null(0.0).to_numpy(), nan=0.0, posinf=np.inf), 0.0).tolist())]
        wider = listed(rows[widths], lambda own: list(zip(*(c.cast(pa.float64()).to_pylist() for c in own.flatten()[:2]), strict=True)))
        out: list[tuple] = []
        for lo, hi in bounds:
            book = [Unit(types[i], flags[heading][i], flags[pair][i], [0.0, *accumulate(heights[i])], wider[i]) for i in range(lo, hi)]
            packed = greedy([u.ends[-1] for u in book], flags[heading][lo:hi], flags[hard_break][lo:hi], available)
            first: list[list[Piece]] = [[] for _ in range(packed[-1] + 1)]
            for u, page in enumerate(packed):
                first[page].append(Piece(u, 0, len(book[u].ends) - 1))
            for page, (pieces, over) in enumerate(Mending(book, available + tolerance, gap).run(first)):
                for p in pieces:
                    width = book[p.unit].widths[p.width][0] if p.width is not None else None
                    out.append((lo + p.unit, page, p.first, p.last, width, over + tolerance if over else None))
        at, *columns = zip(*out, strict=True)
        placed = rows.take(pa.array(at, pa.int64()))
        for f, values in zip(fields, columns, strict=True):
            placed = placed.append_column(f.name, pa.array(values, pa.float64() if f.dataType == T.DoubleType() else pa.int32()))
        return placed

    fields = [T.StructField(n, T.IntegerType()) for n in ("page", "from_part", "to_part")]
    fields += [T.StructField(n, T.DoubleType()) for n in ("width", "overflow")]
    return fold_sorted_arrow(units, keys, order, fields, fold)


def repair_report(placed: DataFrame, keys: list[str], unit: list[str], type_: str = "type") -> DataFrame:
    """Counters of paginate_repaired() by book: pages, cuts made, figures set wider, units too high, and cuts by type.

    unit: columns that name a unit in its book; a unit on n pages was cut n - 1 times. A page that is too high
    counts once. Counts are added up by book and type first, so a book is one short row for each type.
    """
    high = F.collect_set(F.when(F.col("overflow").isNotNull(), F.col("page"))).alias("_high")  # in the same pass: placed is a fold, which a second one would repeat
    pieces = placed.groupBy(*keys, *unit).agg(F.first(type_).alias("_type"), (F.count("*") - 1).alias("_cuts"), F.count("width").alias("_wide"), F.max("page").alias("_page"), high)
    by_type = pieces.groupBy(*keys, "_type").agg(F.sum("_cuts").alias("cuts"), F.sum("_wide").alias("wide"), F.max("_page").alias("page"), F.array_distinct(F.flatten(F.collect_list("_high"))).alias("_high"))
    splits = F.array_sort(F.filter(F.collect_list(F.struct(F.col("_type").alias("type"), F.col("cuts"))), lambda s: s["cuts"] > 0))
    over = F.size(F.array_distinct(F.flatten(F.collect_list("_high")))).cast("long").alias("oversize_items")
    return by_type.groupBy(*keys).agg((F.max("page") + 1).cast("long").alias("pages"), F.sum("cuts").alias("split_items"), F.sum("wide").alias("resized_figures"), over, splits.alias("splits_by_type"))


def oversize(placed: DataFrame, keys: list[str], unit: list[str], pair: str = "pair", type_: str = "type") -> DataFrame:
    """The units that stand last on a page that is too high: (keys, unit, type, overflow), pairs named as such."""
    high = placed.where("overflow IS NOT NULL").groupBy(*keys, "page").agg(F.max_by(F.struct(*unit, F.when(F.coalesce(pair, F.lit(False)), "sequence_pair").otherwise(F.col(type_)).alias("type")), F.struct(*unit)).alias("_u"), F.max("overflow").alias("overflow"))
    return high.select(*keys, *[F.col(f"_u.{c}").alias(c) for c in unit], F.col("_u.type").alias("type"), F.round("overflow", 1).alias("overflow"))
