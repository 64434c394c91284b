"""Book catalogs and lab registries out of JSON files: explicit schemas, and a bad file is a row with an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import model


def scan_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(folder, path, book, error, updated) of every <root>/<folder>/book.json.

    Folders that start with a dot or an underscore are passed over; a file that is no
    JSON object becomes a row with an error instead of failing the scan.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "book.json").option("recursiveFileLookup", "true").load(root)
    text = F.decode("content", "UTF-8")
    rows = files.select(F.regexp_extract("path", r"/([^/]+)/book\.json$", 1).alias("folder"), "path", F.col("modificationTime").alias("updated"), text.alias("text"))
    rows = rows.where((F.col("folder") != "") & ~F.col("folder").rlike(r"^[._]"))
    return parse_books(rows)


def parse_books(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds book (a struct of model.BOOK) and error to rows with JSON text."""
    return (
        rows.withColumn("book", F.from_json(text, model.struct(model.BOOK)))
        .withColumn("error", F.when(F.try_parse_json(text).isNull() | F.col("book").isNull(), "invalid JSON"))
        .withColumn("book", F.when(F.col("error").isNull(), F.col("book")))
        .drop(text)
    )


def pages_of(books: DataFrame, key: str = "folder") -> DataFrame:
    """(key, page_ord, page_id, source_page, visibility) of normalised books."""
    return books.select(key, F.posexplode("book.pages").alias("page_ord", "p")).select(key, "page_ord", F.col("p.id").alias("page_id"), F.col("p.sourcePage").alias("source_page"), F.col("p.visibility").alias("visibility"))


def items_of(books: DataFrame, key: str = "folder") -> DataFrame:
    """Items with all ordinals; unknown types become paragraphs, levels default to 2, media float to the right."""
    pages = books.select(key, F.posexplode("book.pages").alias("page_ord", "p"))
    rows = pages.select(key, "page_ord", F.posexplode("p.items").alias("item_ord", "i")).select(key, "page_ord", "item_ord", "i.*")
    return normalize_items(rows)


def normalize_items(items: DataFrame) -> DataFrame:
    known = F.when(F.col("type").isin(model.ITEM_TYPES), F.col("type")).otherwise("paragraph")
    level = F.when(F.coalesce("level", F.lit(0)) == 0, F.lit(2)).otherwise(F.col("level"))
    media = F.col("type").isin("figure", "scene")
    return (
        items.withColumn("type", known)
        .withColumn("level", F.when(F.col("type") == "section_heading", level).otherwise(F.col("level")))
        .withColumn("nav_show", F.coalesce("nav.show", F.col("type").isin(model.NAV_DEFAULT_TYPES)))
        .withColumn("placement", F.coalesce("layout.placement", F.when(media, "float-right").otherwise("wide")))
    )


def read_labs(spark: SparkSession, path: str) -> DataFrame:
    """(lab_ord, lab) of a registry file; a registry without labs fails."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", model.struct(model.LABS)).alias("r"))
    checked = text.select(F.when(F.size("r.labs") > 0, F.col("r.labs")).otherwise(F.raise_error(F.lit("the registry has no labs"))).alias("labs"))
    return checked.select(F.posexplode("labs").alias("lab_ord", "lab"))


def presets_of(labs: DataFrame) -> DataFrame:
    """(lab_id, preset_ord, preset fields), archived by its own status."""
    return labs.select(F.col("lab.id").alias("lab_id"), F.posexplode("lab.presets").alias("preset_ord", "p")).select("lab_id", "preset_ord", "p.*")


def preset_status(status: Column, discovered: Column, custom: Column) -> Column:
    """discovered, then custom, archived, planned, ready."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(F.coalesce(discovered, F.lit(False)), "discovered").when(F.coalesce(custom, F.lit(False)), "custom").when(s.contains("archiv"), "archived").when(s.contains("plan"), "planned").otherwise("ready")
