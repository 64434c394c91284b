"""Directory listings in HTML to the addresses of the books they name; the pages themselves are fetched elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: An anchor's address: attributes before it are read whole, so a > in quotes ends nothing.
HREF = r"""(?is)<a(?:\s+[^\s=>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?){0,50}?\s+href\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""


def hrefs(html: Column) -> Column:
    """The addresses of a page's anchors, in order, as they stand; entities of & are read."""
    quoted = F.regexp_extract_all(html, F.lit(HREF), 1)
    return F.transform(quoted, lambda q: F.replace(F.regexp_replace(q, r"""^["']|["']$""", ""), F.lit("&amp;"), F.lit("&")))


def folder_of(url: Column) -> Column:
    """The folder that an address lies in, with its slash; without query and fragment. A bare host is its own root."""
    base = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(base.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*$"), F.concat(base, F.lit("/"))).otherwise(F.regexp_replace(base, r"[^/]*$", ""))


def resolved(href: Column, root: Column) -> Column:
    """An address against the folder it stands in (folder_of()): whole addresses, those from the server's root, and those from the folder on."""
    href = F.regexp_replace(href, r"^(\./)+", "")
    origin = F.regexp_extract(root, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*)", 1)
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(origin, r"^([^:]*:)", 1), href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(root, href))


def listed_books(listings: DataFrame, keys: list[str], root: str = "url", html: str = "html") -> DataFrame:
    """(keys, ord, name, folder_url, book_url) of the folders below each listing's own that it links to.

    Links that begin with ? or #, are empty or hold '..', lead elsewhere or to no folder, and folders with a leading _ are
    left out. name is the folder's, percent signs read. Null HTML lists nothing; a folder linked twice shows twice.
    """
    at = listings.select(*keys, folder_of(F.col(root)).alias("_root"), F.posexplode(hrefs(F.col(html))).alias("ord", "_href"))
    at = at.where((F.col("_href") != "") & ~F.col("_href").startswith("?") & ~F.col("_href").startswith("#") & ~F.col("_href").contains(".."))
    at = at.withColumn("folder_url", F.regexp_replace(resolved(F.col("_href"), F.col("_root")), r"[?#].*$", ""))
    at = at.where(F.col("folder_url").startswith(F.col("_root")) & F.col("folder_url").endswith("/") & (F.col("folder_url") != ""))
    last = F.regexp_extract("folder_url", r"([^/]*)/$", 1)
    at = at.withColumn("name", F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last))
    return at.where(~F.col("name").startswith("_")).select(*keys, "ord", "name", "folder_url", F.concat("folder_url", F.lit("book.json")).alias("book_url"))
