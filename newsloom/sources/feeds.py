"""Feed documents -> rows: RSS, Atom and OPML texts, parsed by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text

ITEMS_MOST, SUMMARY_CHARS = 60, 650


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, xml)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("xml"))


def tag(block: Column, *names: str) -> Column:
    """The text of the first of these tags that isn't empty."""
    found = [F.trim(F.regexp_replace(F.regexp_extract(block, rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1), r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")) for n in names]
    return F.coalesce(*[F.when(f != "", f) for f in found], F.lit(""))


def attribute(block: Column, name: str, key: str) -> Column:
    return F.regexp_extract(block, rf"""(?is)<{name}\b[^>]*\b{key}=["']([^"']*)["']""", 1)


def parse_feeds(documents: DataFrame) -> DataFrame:
    """(path, xml) -> path, place, title, url, summary, published_at (null if it can't be read), source: the first items of each feed."""
    items = F.regexp_extract_all("xml", F.lit(r"(?is)<item\b.*?</item>"), F.lit(0))
    entries = F.regexp_extract_all("xml", F.lit(r"(?is)<entry\b.*?</entry>"), F.lit(0))
    cut = documents.select("path", F.posexplode(F.slice(F.when(F.size(items) > 0, items).otherwise(entries), 1, ITEMS_MOST)).alias("place", "block"))
    block = F.col("block")
    link = attribute(block, "link", "href")
    url = F.coalesce(F.when(tag(block, "link") != "", tag(block, "link")), F.when(link != "", link), tag(block, "guid", "id"))
    raw = tag(block, "pubDate", "published", "updated", "dc:date")
    plain = F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", "")
    at = F.coalesce(F.try_to_timestamp(raw), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")))
    source = text.strip_html(tag(block, "source", "dc:creator", "author"))
    rows = cut.select("path", "place", text.strip_html(tag(block, "title")).alias("title"), F.trim(text.decode_entities(url)).alias("url"), F.substring(text.strip_html(tag(block, "description", "summary", "content:encoded", "content")), 1, SUMMARY_CHARS).alias("summary"), at.alias("published_at"), F.when(source != "", source).otherwise("Source").alias("source"))
    return rows.where("title <> '' and url <> ''")


def parse_opml(documents: DataFrame) -> DataFrame:
    """(path, xml) -> path, title, url of every outline with a feed address, nested ones too."""
    cut = documents.select("path", F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<outline\b[^>]*>"), F.lit(0))).alias("block"))
    get = lambda key: text.decode_entities(attribute(F.col("block"), "outline", key))
    title = F.coalesce(F.when(get("title") != "", get("title")), get("text"))
    return cut.select("path", title.alias("title"), get("xmlUrl").alias("url")).where("url <> ''")
