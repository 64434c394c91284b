"""Every query of the library by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.operators import catalog
from folioflow.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Adds a query under its name, and its SQL where SQL can state it."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


@register(
    "catalog_search",
    """SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part
       WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'gear') AND p_type = 'ECONOMY'""",
)
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faceted search and natural sort: both filters reach the scan, only the found rows are sorted."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    found = catalog.facet_search(part, ["p_name", "p_brand", "p_type"], " Gear ", {"p_type": "ECONOMY"})
    return catalog.sort_catalog(found, "p_size", descending=True, title="p_name", ordinal="p_partkey", numeric=True)
