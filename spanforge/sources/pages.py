"""Links of HTML pages, and the roles that they play: titles, redirects, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANCHOR = r'<a href="([^"]*)"[^>]*>(.*?)</a>'


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, lang, pos, href, text) of each link; pos counts from 1 within the page."""
    # pages are searched once; what a match holds is then read from it alone
    both = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))
    lang = F.regexp_extract("html", r'<html lang="(\w+)"', 1).alias("lang")
    rows = pages.select("page_id", lang, F.posexplode(both).alias("pos", "a"))
    return rows.select("page_id", "lang", (F.col("pos") + 1).cast("long").alias("pos"), F.regexp_extract("a", ANCHOR, 1).alias("href"), F.regexp_extract("a", ANCHOR, 2).alias("text"))


def href_title(href: Column | str = "href") -> Column:
    """The page that a link leads to, before redirects."""
    return F.regexp_replace(F.col(href) if isinstance(href, str) else href, "^/", "")


def redirects(links: DataFrame) -> DataFrame:
    """(src, dest): titles that lead to another one, in lower case and without marks at the end."""
    pairs = links.select(href_title().alias("src")).distinct().withColumn("dest", F.lower(F.regexp_replace("src", "[.,]+$", "")))
    return pairs.filter("src <> dest")


def resolve(rows: DataFrame, title: str, moved: DataFrame) -> DataFrame:
    """``rows`` with ``title`` replaced by its destination, if it has one. Redirects hold a source once."""
    hop = moved.select(F.col("src").alias("__src"), F.col("dest").alias("__dest"))
    return rows.join(hop, F.col(title) == F.col("__src"), "left").withColumn(title, F.coalesce("__dest", title)).drop("__src", "__dest")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, lang, pos, text, title) of each link, redirects resolved."""
    found = anchors(pages)
    return resolve(found.withColumn("title", href_title()), "title", redirects(found)).select("page_id", "lang", "pos", "text", "title")
