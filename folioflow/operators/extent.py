"""How far a page's boxes reach down: offsets of a nested layout add up, the deepest bottom is an argmax."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import checkpointed


def absolute_tops(boxes: DataFrame, keys: list[str], id_: str = "box", parent: str = "parent", top: str = "top") -> DataFrame:
    """Adds absolute_top: a box's own offset and those of all boxes around it.

    Every round doubles the way that the sums reach, so a nesting of n levels takes log2(n) joins, each checkpointed. A parent that
    is missing, null or the box itself is the page. Boxes whose parents run in a circle lie on no page and go.
    """
    up = F.when(F.col(parent) != F.col(id_), F.col(parent))
    cur = checkpointed(boxes.withColumn("_up", up).withColumn("absolute_top", F.coalesce(F.col(top), F.lit(0)).cast("double")))
    steps, before, left = 1, None, cur.where("_up IS NOT NULL").count()
    # Once a round ends no way, what is left runs in circles, which are no longer than there are such boxes.
    while left and not (left == before and steps >= left):
        around = cur.select(*keys, F.col(id_).alias("_up"), F.col("_up").alias("_next"), F.col("absolute_top").alias("_more"))
        grown = cur.where("_up IS NOT NULL").join(around, [*keys, "_up"], "left")
        grown = grown.withColumn("_up", F.col("_next")).withColumn("absolute_top", F.col("absolute_top") + F.coalesce("_more", F.lit(0.0)))
        cur = checkpointed(cur.where("_up IS NULL").unionByName(grown.select(*cur.columns)))
        steps, before, left = steps * 2, left, cur.where("_up IS NOT NULL").count()
    return cur.where("_up IS NULL").drop("_up")


def visual_extent(boxes: DataFrame, keys: list[str], order: str, available: float, id_: str = "box", flow: str = "flow_height", tolerance: float = 1.0, floats: str = "float") -> DataFrame:
    """(keys, used, available, overflow, fits, overflow_kind, culprit, culprit_bottom) of each page.

    boxes: absolute_tops() rows with width, height, margin and float, and the page's flow_height on each of its rows. Boxes without
    any size have no say. The culprit is the box that reaches deepest, the first in order among equals; a page of nothing but
    such boxes has none. used is the larger of the flow's height and the culprit's bottom.
    """
    sized = (F.coalesce("width", F.lit(0)) != 0) | (F.coalesce("height", F.lit(0)) != 0)
    bottom = F.col("absolute_top") + F.coalesce("height", F.lit(0)) + F.coalesce("margin", F.lit(0))
    rank = F.when(sized, F.struct(bottom.alias("bottom"), (-F.col(order)).alias("first")))
    pages = boxes.groupBy(*keys).agg(F.max(F.coalesce(flow, F.lit(0.0))).alias("_flow"), F.max_by(F.struct(F.col(id_).alias("box"), F.coalesce(F.col(floats), F.lit("none")).alias("float"), bottom.alias("bottom")), rank).alias("_c"))
    used = F.greatest("_flow", F.coalesce("_c.bottom", "_flow"))
    over = F.greatest(F.lit(0.0), F.col("used") - available)
    pages = pages.withColumn("used", used).withColumn("overflow", over)
    floating = F.coalesce(F.col("_c.float") != "none", F.lit(False))
    return pages.select(
        *keys, "used", F.lit(available).alias("available"), "overflow", (F.col("overflow") <= tolerance).alias("fits"),
        F.when(floating, "float-bottom").otherwise("document-flow").alias("overflow_kind"), F.col("_c.box").alias("culprit"), F.col("_c.bottom").alias("culprit_bottom"),
    )
