"""HTML extraction over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.storage import cut

PARAGRAPH = r"(?is)<p\b[^>]*>(.*?)</p>"


def title_tag(html: Column) -> Column:
    return text.clean(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def meta_content(html: Column, key: str) -> Column:
    """The content of the meta tag of that name or property, with either order of attributes; empty if there is none."""
    one = F.regexp_extract(html, rf"""(?is)<meta[^>]+(?:name|property)=["']{key}["'][^>]*content=["']([^"']*)["']""", 1)
    other = F.regexp_extract(html, rf"""(?is)<meta[^>]+content=["']([^"']*)["'][^>]*(?:name|property)=["']{key}["']""", 1)
    return F.when(one != "", one).otherwise(other)


def paragraphs(pages: DataFrame, *, least: int = 55, most: int = 14_000) -> DataFrame:
    """page_id, place and text of the paragraphs that are long enough, first ones of equal beginnings, until most characters have come."""
    raw = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(PARAGRAPH), F.lit(1))).alias("place", "raw"))
    plain = raw.select("page_id", "place", text.strip_html(F.col("raw")).alias("text")).where(F.length("text") >= least)
    first = Window.partitionBy("page_id", F.lower(F.substring("text", 1, 140))).orderBy("place")
    kept = plain.withColumn("_copy", F.row_number().over(first)).where("_copy = 1").drop("_copy")
    before = Window.partitionBy("page_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn("_before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("_before") <= most).drop("_before")


LD_SCRIPT = r"""(?is)<script\b[^>]*type=["']application/ld\+json[^"']*["'][^>]*>(.*?)</script>"""
LD_BODY, LD_DESCRIPTION = 14_000, 1_800


#: Depths of objects that are read for bodies and for images, types of articles, and keys of images.
BODY_DEPTH, IMAGE_DEPTH = 8, 7
ARTICLE_TYPE, IMAGE_KEY = "(?i)Article", "(?i)^(image|thumbnailUrl|contentUrl)$"


def json_nodes(pages: DataFrame, *, depth: int = BODY_DEPTH) -> DataFrame:
    """page_id, script, depth, key, parent_key, in_array and node (VARIANT) of all values of the pages' JSON-LD scripts, to depth + 2.

    Scripts that are no JSON have none. A round takes all values one level down; it ends where no objects or arrays are left.
    """
    scripts = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LD_SCRIPT), F.lit(1))).alias("script", "raw"))
    none = F.lit(None).cast("string")
    level = cut(scripts.select("page_id", "script", F.lit(0).alias("depth"), none.alias("key"), none.alias("parent_key"), F.lit(False).alias("in_array"), F.try_parse_json("raw").alias("node")).where("node is not null"))
    spark, levels = pages.sparkSession, [level]
    for _ in range(depth + 2):
        kind = F.schema_of_variant("node")
        nested = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY")).select("page_id", "script", "depth", F.col("key").alias("above"), kind.startswith("ARRAY").alias("array"), "node")
        below = nested.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        level = cut(below.select("page_id", "script", (F.col("depth") + 1).alias("depth"), below["key"], F.col("above").alias("parent_key"), F.col("array").alias("in_array"), below["value"].alias("node")))
        if not level.limit(1).count():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def _string_of(node: str, path: str) -> Column:
    """A field of an object if it is a string."""
    own = F.try_variant_get(node, path, "variant")
    return F.when(F.schema_of_variant(own) == "STRING", own.cast("string"))


def json_ld(pages: DataFrame) -> DataFrame:
    """page_id, body and description: the longest cleaned articleBody (or text) and description of all JSON-LD objects, empty without one."""
    objects = json_nodes(pages).where(F.schema_of_variant("node").startswith("OBJECT"))
    field = lambda name: F.coalesce(_string_of("node", f"$.{name}"), F.lit(""))
    body = F.when(field("articleBody") != "", field("articleBody")).otherwise(field("text"))
    told = objects.select("page_id", text.strip_html(body).alias("body"), text.strip_html(field("description")).alias("description"))
    longest = lambda c, most: F.substring(F.max(F.struct(F.length(c), c))[c], 1, most).alias(c)
    found = told.groupBy("page_id").agg(longest("body", LD_BODY), longest("description", LD_DESCRIPTION))
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("description", F.lit("")).alias("description"))


def article_bodies(nodes: DataFrame) -> DataFrame:
    """json_nodes() -> page_id, script and body of the objects that are articles by their type, or have none, and have a body."""
    kind = F.try_variant_get("node", "$['@type']", "variant")
    named = F.when(F.schema_of_variant(kind).startswith("ARRAY"), F.array_join(kind.try_cast("array<string>"), " ")).otherwise(kind.try_cast("string"))
    body = text.clean(_string_of("node", "$.articleBody"))
    own = nodes.where((F.col("depth") <= BODY_DEPTH) & F.schema_of_variant("node").startswith("OBJECT")).select("page_id", "script", body.alias("body"), F.coalesce(F.nullif(named, F.lit("")), F.lit("Article")).alias("type"))
    return own.where((F.col("body") != "") & F.col("type").rlike(ARTICLE_TYPE)).select("page_id", "script", "body")


def json_images(nodes: DataFrame) -> DataFrame:
    """json_nodes() -> page_id and url: the distinct image addresses, given as strings, in arrays, or as objects with an address."""
    said = nodes.where(F.schema_of_variant("node") == "STRING").select("page_id", "depth", "key", "parent_key", "in_array", F.col("node").cast("string").alias("url"))
    own = ~F.col("in_array") & F.col("key").rlike(IMAGE_KEY) & (F.col("depth") <= IMAGE_DEPTH + 1)
    within = F.col("parent_key").rlike(IMAGE_KEY) & (F.col("depth") <= IMAGE_DEPTH + 2) & (F.col("in_array") | F.col("key").isin("url", "contentUrl"))
    return said.where(F.coalesce(own, F.lit(False)) | F.coalesce(within, F.lit(False))).select("page_id", "url").distinct()


#: Anchors of a result page's titles, how far a result reaches, and its attachments.
RESULT_TITLE = r"""(?i)<a\b[^>]*class=["'][^"']*\bJtKRv\b[^"']*["'][^>]*>([\s\S]{1,2200}?)</a>"""
RESULT_REACH, ATTACHMENT, PREFERRED_SIZE = 12_000, r"""/api/attachments/[^"'\s,]+""", "(?i)-w400-h224-"
SIZE_TAIL, SIZE = r"(?i)-w\d+-h\d+-p-df(?:-rw)?$", "-w400-h224-p-df"


def match_places(pages: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """page_id, i, start (from 0, in characters) and found of all matches of pattern in html: parts between matches and matches add up."""
    html = F.coalesce("html", F.lit(""))
    sizes = pages.select("page_id", F.posexplode(F.arrays_zip(F.split(html, pattern).alias("part"), F.regexp_extract_all(html, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(html, F.lit(pattern), F.lit(group)).alias("found"))).alias("i", "m"))
    narrow = sizes.select("page_id", "i", F.length("m.part").alias("before"), F.length("m.whole").alias("size"), F.col("m.found").alias("found"))
    ahead = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = narrow.withColumn("start", F.sum("before").over(ahead) + F.sum(F.coalesce("size", F.lit(0))).over(ahead) - F.coalesce("size", F.lit(0)))
    return placed.where("size is not null").select("page_id", "i", "start", "found")


def result_visuals(pages: DataFrame, base: str) -> DataFrame:
    """page_id, i, title and url of each result's image: the attachment of the preferred size, or the last, between the midpoints to its neighbours."""
    order = Window.partitionBy("page_id").orderBy("i")
    near = match_places(pages, RESULT_TITLE).withColumns({"title": text.strip_html(F.col("found")), "last": F.lag("start").over(order), "next": F.lead("start").over(order)})
    low = F.coalesce(F.floor((F.col("last") + F.col("start")) / 2), F.greatest(F.lit(0), F.col("start") - RESULT_REACH))
    high = F.coalesce(F.floor((F.col("start") + F.col("next")) / 2), F.col("start") + RESULT_REACH)
    spans = near.where("title <> ''").groupBy("page_id").agg(F.collect_list(F.struct("i", "title", low.alias("low"), high.alias("high"))).alias("spans"))  # a page's results
    sliced = lambda x: F.struct(x["i"].alias("i"), x["title"].alias("title"), F.regexp_extract_all(F.substring(F.col("html"), (x["low"] + 1).cast("int"), (x["high"] - x["low"]).cast("int")), F.lit(ATTACHMENT), F.lit(0)).alias("links"))
    each = pages.join(spans, "page_id").select("page_id", F.explode(F.transform("spans", sliced)).alias("r")).select("page_id", "r.*").where(F.size("links") > 0)
    links = F.transform("links", text.decode_entities)
    chosen = F.coalesce(F.get(F.filter(links, lambda x: x.rlike(PREFERRED_SIZE)), F.lit(0)), F.element_at(links, -1))
    return each.select("page_id", "i", "title", F.concat(F.lit(base), F.regexp_replace(chosen, SIZE_TAIL, SIZE)).alias("url"))
