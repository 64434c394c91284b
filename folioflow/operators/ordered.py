"""Order-dependent operators as window functions; every window ends its order with an ordinal that makes it total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.session import checkpointed

ROWS_SO_FAR = (W.unboundedPreceding, W.currentRow)


def running(flag: Column, keys: list[str], order: list[str]) -> Column:
    return F.sum(flag.cast("int")).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(*ROWS_SO_FAR))


def list_numbering(entries: DataFrame, keys: list[str], order: list[str], level: str, start: str | None = None, levels: int = 9, out: str = "value") -> DataFrame:
    """Ordered-list numbers: each level counts on from `start` and begins anew after a shallower entry."""
    begun = F.lit(0)
    for k in range(1, levels):
        begun = F.when(F.col(level) == k, running(F.col(level) < k, keys, order)).otherwise(begun)
    rows = entries.withColumn("_epoch", begun)
    w = W.partitionBy(*keys, level, "_epoch").orderBy(*order)
    first = F.first(start).over(w.rowsBetween(*ROWS_SO_FAR)) if start else F.lit(1)
    return rows.withColumn(out, (first + F.row_number().over(w) - 1).cast("int")).drop("_epoch")


def pages_from_breaks(blocks: DataFrame, keys: list[str], order: list[str], is_break: Column, out: str = "page") -> DataFrame:
    """Page number: one more than the breaks so far."""
    return blocks.withColumn(out, running(is_break, keys, order) + 1)


def islands(rows: DataFrame, keys: list[str], order: list[str], same: list[str], joins: Column, out: str = "island") -> DataFrame:
    """Numbers runs of rows that may join (`joins`) and agree with their predecessor in `same`; other rows are runs of one."""
    w = W.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_j", joins)
    new = ~(F.col("_j") & F.coalesce(F.lag("_j").over(w), F.lit(False)))
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = marked.withColumn("_new", F.coalesce(new, F.lit(True)))
    return marked.withColumn(out, running(F.col("_new"), keys, order)).drop("_j", "_new")


def merge_islands(rows: DataFrame, keys: list[str], order: list[str], same: list[str], joins: Column, text: str, sep: str = "\n") -> DataFrame:
    """One row for each island: first ordinal, count and the texts joined in order."""
    runs = islands(rows, keys, order, same, joins)
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t"))))
    return runs.groupBy(*keys, "island", *same).agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda p: p["t"]), sep).alias("text"))


def lookahead(rows: DataFrame, keys: list[str], order: list[str], takes: Column, given: Column, value: str, out: str) -> DataFrame:
    """A row that `takes` swallows the next row if that is `given`: it gets its value, and the swallowed row goes."""
    w = W.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_t", takes).withColumn("_g", given)
    got = F.col("_t") & F.coalesce(F.lead("_g").over(w), F.lit(False))
    gone = F.col("_g") & F.coalesce(F.lag("_t").over(w), F.lit(False))
    marked = marked.withColumn(out, F.when(got, F.lead(value).over(w))).withColumn("_gone", gone)
    return marked.where(~F.col("_gone")).drop("_t", "_g", "_gone")


def contextual_spacing(rows: DataFrame, keys: list[str], order: list[str], style: str, flag: str, margin: str) -> DataFrame:
    """The bottom margin is 0 before a row of the same style if both are flagged."""
    w = W.partitionBy(*keys).orderBy(*order)
    same = (F.lead(style).over(w) == F.col(style)) & F.lead(flag).over(w) & F.col(flag)
    return rows.withColumn("margin_bottom", F.when(F.coalesce(same, F.lit(False)), F.lit(0.0)).otherwise(F.col(margin)))


def stable_ids(rows: DataFrame, keys: list[str], order: list[str], base: str, out: str = "stable_id") -> DataFrame:
    """base, base-2, base-3 ... in order."""
    n = F.row_number().over(W.partitionBy(*keys, base).orderBy(*order))
    return rows.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), n.cast("string"))))


def nav_groups(rows: DataFrame, keys: list[str], order: list[str], opens: Column) -> DataFrame:
    """group_ord and entry_ord: a group begins at each opening row and at the first row."""
    w = W.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    marked = rows.withColumn("_open", opens | first)
    marked = marked.withColumn("group_ord", running(F.col("_open"), keys, order)).drop("_open")
    return marked.withColumn("entry_ord", F.row_number().over(W.partitionBy(*keys, "group_ord").orderBy(*order)) - 1)


def toc_rows(headings: DataFrame, keys: list[str], level: str, title: str) -> DataFrame:
    """Contents lines: four blanks for each level below the least one of the document; the least level is bold."""
    least = F.min(level).over(W.partitionBy(*keys))
    indent = F.repeat(F.lit(" "), ((F.col(level) - least) * 4).cast("int"))
    return headings.withColumn("toc_text", F.concat(indent, F.col(title))).withColumn("bold", F.col(level) == least)


def section_ends(rows: DataFrame, keys: list[str], order: str, level: str, levels: int = 9) -> DataFrame:
    """For headings (level not null): the ordinal before the next heading of the same or a smaller level, or the last row."""
    # Read backwards the frame only grows, so each running minimum is kept instead of being taken again for every row.
    w = W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
    nxt = F.lit(None).cast("long")
    for k in range(1, levels + 1):
        nxt = F.when(F.col(level) == k, F.min(F.when(F.col(level) <= k, F.col(order))).over(w)).otherwise(nxt)
    last = F.max(order).over(W.partitionBy(*keys))
    return rows.withColumn("section_end", F.when(F.col(level).isNotNull(), F.coalesce(nxt - 1, last)))


def entries_in_range(rows: DataFrame, keys: list[str], order: str, key: str, start: str | None, end: str | None) -> DataFrame:
    """Inclusive range between two keys; a missing start is the first row, a missing end the start, a reversed range is turned around."""
    at = lambda k: F.min(F.when(F.col(key) == k, F.col(order))).over(W.partitionBy(*keys)) if k is not None else F.lit(None).cast("long")
    first = F.min(order).over(W.partitionBy(*keys))
    marked = rows.withColumn("_a", F.coalesce(at(start), first))
    marked = marked.withColumn("_b", F.coalesce(at(end), F.col("_a")))
    return marked.where(F.col(order).between(F.least("_a", "_b"), F.greatest("_a", "_b"))).drop("_a", "_b")


def estimated_heights(rows: DataFrame, keys: list[str], order: list[str], top: str, own: str) -> DataFrame:
    """At least 1, the way to the next top, and the own height."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("height", F.greatest(F.lit(1.0), F.coalesce(F.lead(top).over(w) - F.col(top), F.lit(0.0)), F.coalesce(own, F.lit(0.0))))


def pair_adjacent(rows: DataFrame, keys: list[str], order: list[str], left: Column, right: Column) -> DataFrame:
    """Pairs each `left` row with the next row if that is `right`; unit numbers the pairs and single rows."""
    w = W.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_l", left).withColumn("_r", right)
    joins = F.col("_r") & F.coalesce(F.lag("_l").over(w), F.lit(False))
    marked = marked.withColumn("_join", joins)
    return marked.withColumn("unit", running(~F.col("_join"), keys, order)).withColumn("paired", F.count("*").over(W.partitionBy(*keys, "unit")) > 1).drop("_l", "_r", "_join")


def positional_zip(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The k-th row of `left` with the value of the k-th row of `right`, by key; extra left rows get null."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    values = right.withColumn("_k", nth).select(*keys, "_k", F.col(value).alias(out))
    return left.withColumn("_k", nth).join(values, [*keys, "_k"], "left").drop("_k")


def keep_last(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key: a bounded history."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def best_per_group(rows: DataFrame, keys: list[str], score: Column, order: list[str], caption: str) -> DataFrame:
    """The best row of each group, first among equals, at the place of the group's first row; a blank caption is filled from the group."""
    w = W.partitionBy(*keys)
    best = F.row_number().over(w.orderBy(F.desc("_score"), *order))
    place = F.min(order[0]).over(w)
    text = F.first(F.when(F.trim(caption) != "", F.col(caption)), ignorenulls=True).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    out = rows.withColumn("_score", score).withColumn("_n", best).withColumn("place", place)
    out = out.withColumn("filled_caption", F.coalesce(F.when(F.trim(caption) != "", F.col(caption)), text))
    return out.where(F.col("_n") == 1).drop("_n", "_score")


def first_per_key(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The value of the first row of each key."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, F.col(value).alias("_v"))).getField("_v").alias(value))


def distinct_in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def positions(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Place of every row, from 1, in a total order: ranges are counted, and each numbers its rows on from those before it.

    The ranges are checkpointed, since another run would sample other bounds.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    begins, n = [], 0
    for r in dealt.groupBy("_part").count().orderBy("_part").collect():
        begins.append((r["_part"], n))
        n += r["count"]
    begun = rows.sparkSession.createDataFrame(begins, "_part int, _begun long")
    own = dealt.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return own.join(F.broadcast(begun), "_part").withColumn(out, F.col("_begun") + F.col("_n")).drop("_part", "_begun", "_n")


def leading_run(rows: DataFrame, keys: list[str], order: str, flag: Column, out: str = "leading") -> DataFrame:
    """(keys, out) how many rows of each key stand before the first whose flag does not hold, such as the header rows of a table; order counts from 1 without gaps."""
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(~F.coalesce(flag, F.lit(False)), F.col(order))) - 1, F.max(order)).alias(out))


def list_formats(paragraphs: DataFrame, nums: DataFrame, levels: DataFrame, overrides: DataFrame, num: str = "num_id", level: str = "level") -> DataFrame:
    """Paragraphs with the format and the start of their list level: numbering instance, its definition's level, its own override.

    nums: (num_id, abstract_id); levels: (abstract_id, level, num_fmt, start); overrides: (num_id, level, start). An instance without
    a definition, or a definition without the level, is decimal from 1; an override's start comes first. Paragraphs outside lists (null num_id)
    stay, with nulls. Definitions are put together before paragraphs meet them, in one join on (num_id, level).
    """
    own = nums.join(levels, "abstract_id").select(num, level, "num_fmt", "start")
    said = own.join(overrides.select(num, level, F.col("start").alias("_over")), [num, level], "full").select(num, level, "num_fmt", F.coalesce("_over", "start").alias("start"))
    met = paragraphs.join(said, [num, level], "left")
    listed = F.col(num).isNotNull()
    return met.withColumn("num_fmt", F.when(listed, F.coalesce("num_fmt", F.lit("decimal")))).withColumn("start", F.when(listed, F.coalesce("start", F.lit(1))))
