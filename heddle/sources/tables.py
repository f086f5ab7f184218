"""Reading tables and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import fixed


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def absolute(base: Column, href: Column) -> Column:
    """The link's target from the page's URL, without dot segments."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)[^/?#]*", 1)
    bare = F.regexp_extract(base, r"^([^?#]*)", 1)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(bare, href))
        .otherwise(F.concat(F.when(F.length(folder) > F.length(scheme) + 2, folder).otherwise(F.concat(origin, F.lit("/"))), href))
    )


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, position, href, anchor) of the first links of each page that lead to http targets."""
    href, inner = (F.regexp_extract_all(F.col(html_col), F.lit(fixed.LINK), F.lit(k)) for k in (1, 2))
    found = pages.select(F.col(id_col), F.col(url_col).alias("__base"), F.posexplode(F.arrays_zip(href, inner)).alias("__at", "__link"))
    target = absolute(F.col("__base"), F.btrim(F.col("__link.0"), F.lit(" \n\t\r")))
    words = F.btrim(F.regexp_replace(F.regexp_replace(F.col("__link.1"), "<[^>]+>", " "), r"\s+", " "))
    links = found.select(id_col, F.col("__at").alias("at"), target.alias("href"), F.substring(words, 1, fixed.MAX_ANCHOR).alias("anchor")).where(F.col("href").startswith("http"))
    kept = F.slice(F.array_sort(F.collect_list(F.struct("at", "href", "anchor"))), 1, fixed.MAX_LINKS)
    rows = links.groupBy(id_col).agg(kept.alias("links")).select(id_col, F.posexplode("links").alias("position", "l"))
    return rows.select(id_col, "position", "l.href", "l.anchor")


def page_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, with single spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " "))
