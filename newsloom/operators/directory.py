"""The directory of sources: what articles come from, and what a reader has added, in alphabetical order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text, urls
from newsloom.operators.selection import ranked

#: Names of feeds without a title, by where they come from.
FEED, ADDED_FEED = "Flux", "Flux ajouté"


def domain(x: Column) -> Column:
    """The host of an address, with or without its protocol, in lower case and without www."""
    own = F.trim(F.coalesce(x, F.lit("")))
    return urls.host(F.when(F.regexp_like(own, F.lit("(?i)^https?://")), own).when(own != "", F.concat(F.lit("https://"), own)).otherwise(""))


def source_directory(articles: DataFrame, configured: DataFrame, *, language: str = "fr") -> DataFrame:
    """articles (ord, source, url, feed_url, feed_title) and configured sources (ord, title, url, html_url) -> key, name, count,
    domains, feeds (a map of addresses to titles) and place, by the language's collation.

    A source is its normalised name, called as it was first; a configured one may have no article, and adds its feed and
    domain. Of a feed's titles the last counts.
    """
    blank = F.lit("")
    filled = lambda c: F.trim(F.coalesce(c, blank))
    feed = lambda url, title, default: F.when(filled(url) != "", F.struct(filled(url).alias("url"), F.coalesce(F.nullif(filled(title), blank), F.lit(default)).alias("title")))
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1)), r"^www\.", "")
    told = articles.select(F.lit(0).alias("part"), "ord", filled(F.coalesce(F.nullif(F.col("source"), blank), F.col("feed_title"))).alias("name"), host.alias("domain"), feed(F.col("feed_url"), F.col("feed_title"), FEED).alias("feed"))
    name = F.coalesce(F.nullif(filled(F.col("title")), blank), domain(F.col("url")))
    added = configured.select(F.lit(1).alias("part"), "ord", name.alias("name"), domain(F.coalesce(F.nullif(F.col("html_url"), blank), F.col("url"))).alias("domain"), feed(F.col("url"), F.col("title"), ADDED_FEED).alias("feed"))
    rows = told.unionByName(added).where("name <> ''").withColumn("key", text.normalise(F.col("name")))
    # one row of each source and feed first, so that a source of many articles is few rows
    feeds = rows.where("feed is not null").groupBy("key", "feed.url").agg(F.max_by("feed.title", F.struct("part", "ord")).alias("title"))
    listed = feeds.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("url", "title")))).alias("feeds"))
    sources = rows.groupBy("key").agg(F.min_by("name", F.struct("part", "ord")).alias("name"), F.count_if(F.col("part") == 0).alias("count"))
    hosts = rows.where("domain <> ''").select("key", "domain").distinct().groupBy("key").agg(F.array_sort(F.collect_list("domain")).alias("domains"))
    whole = sources.join(hosts, "key", "left").join(listed, "key", "left").withColumn("domains", F.coalesce("domains", F.array().cast("array<string>")))
    return ranked(whole.withColumn("_name", F.collate("name", language)), [F.col("_name"), F.col("key")], "place").drop("_name")
