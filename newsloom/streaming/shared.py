"""Tables shared between runs: an upsert that may be repeated, and a write only if something has changed.

A table is a folder of hash buckets in Parquet. A batch rewrites the buckets that it touches as files of its own
version, then commits by a small manifest that says which version each bucket has. So readers see whole batches, a
batch that is replayed finds its manifest and does nothing, and one that died writes the same files again. Folders are
reached through Spark only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from newsloom.functions import text
from newsloom.functions.digests import signatures
from newsloom.operators.groups import useful_summary

#: Days until a row expires, and the longest values of its columns.
EXPIRY_DAYS = 30
LONGEST = {"title": 1000, "source": 300, "image_url": 4096, "summary": 12000, "category": 100, "event_key": 256}
FEED_SUMMARY_CHARS = 55


def _cut(x: Column, name: str) -> Column:
    return F.substring(text.clean(x), 1, LONGEST[name])


def article_rows(articles: DataFrame, now: Column) -> DataFrame:
    """articles (url, title, source, image, summary, category, event_key) with a web address -> rows of the cache: every column."""
    image, said = text.clean(F.col("image")), text.clean(F.col("summary"))
    web = F.regexp_like(F.col("url"), F.lit("(?i)^https?://"))
    long = F.length(said) >= FEED_SUMMARY_CHARS
    return articles.where(F.coalesce(web, F.lit(False))).select(
        F.sha2("url", 256).alias("cache_key"),
        F.col("url").alias("article_url"),
        _cut(F.col("title"), "title").alias("title"),
        _cut(F.col("source"), "source").alias("source"),
        F.when(F.regexp_like(image, F.lit("(?i)^https?://")), F.substring(image, 1, LONGEST["image_url"])).otherwise("").alias("image_url"),
        F.when(image != "", "known").otherwise("").alias("image_status"),
        F.when(long, F.substring(said, 1, LONGEST["summary"])).otherwise("").alias("summary"),
        F.when(long, "feed").otherwise("").alias("summary_status"),
        _cut(F.col("category"), "category").alias("category"),
        _cut(F.col("event_key"), "event_key").alias("event_key"),
        now.alias("updated_at"),
        (now + F.make_dt_interval(days=F.lit(EXPIRY_DAYS))).alias("expires_at"),
    )


def summary_rows(articles: DataFrame, now: Column, status: str = "validated") -> DataFrame:
    """articles (url, title, source, summary) with a useful summary -> rows that leave the cache's other columns as they are."""
    good = articles.where((F.coalesce("url", F.lit("")) != "") & useful_summary(F.col("summary")))
    return good.select(F.sha2("url", 256).alias("cache_key"), F.col("url").alias("article_url"), _cut(F.col("title"), "title").alias("title"), _cut(F.col("source"), "source").alias("source"), _cut(F.col("summary"), "summary").alias("summary"), F.lit(status).alias("summary_status"), now.alias("updated_at"), (now + F.make_dt_interval(days=F.lit(EXPIRY_DAYS))).alias("expires_at"))


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """batch, bucket and version of all commits; None before the first."""
    try:
        return spark.read.schema("batch bigint, bucket int, version bigint").parquet(f"{path}/manifest")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def _live(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame | None:
    """bucket and the columns of each bucket's last version (of commits before a batch)."""
    told = _manifest(spark, path)
    if told is None:
        return None
    last = told.where(F.col("batch") < before if before is not None else F.lit(True)).groupBy("bucket").agg(F.max("version").alias("version"))
    rows = spark.read.schema(schema.add("bucket", IntegerType()).add("version", LongType())).parquet(f"{path}/rows")
    return rows.join(F.broadcast(last), ["bucket", "version"], "left_semi").drop("version")  # a row a bucket


def upsert(spark: SparkSession, path: str, rows: DataFrame, batch: int, schema: str, now: Column, *, key: str = "cache_key", at: str = "updated_at", expires: str = "expires_at", buckets: int = 16) -> bool:
    """Merges rows into the table of that schema; False if the batch has been committed before.

    Of rows with one key the latest counts (the largest, if tied). Columns that rows lack keep their values; rows that
    have expired by now go when their bucket is rewritten, and read() leaves them out.
    """
    kind = StructType.fromDDL(schema)
    told = _manifest(spark, path)
    if told is not None and told.where(F.col("batch") == batch).limit(1).count():
        return False
    own = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *[c for c in rows.columns if c not in (key, at)])).alias("new")).select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), key, "new")
    old = _live(spark, path, StructType.fromDDL(schema), batch)
    others = [f.name for f in kind.fields if f.name != key]
    given = set(rows.columns)
    if old is None:
        merged = own.select("bucket", key, *[(F.col(f"new.{c}") if c in given else F.lit(None)).cast(kind[c].dataType).alias(c) for c in others])
    else:
        touched = own.select("bucket").distinct()
        known = old.join(F.broadcast(touched), "bucket", "left_semi").select(key, F.col("bucket").alias("old_bucket"), F.struct(*others).alias("old"))
        both = own.join(known, key, "full_outer")
        value = lambda c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in given else F.col(f"old.{c}")
        merged = both.select(F.coalesce("bucket", "old_bucket").alias("bucket"), key, *[value(c).cast(kind[c].dataType).alias(c) for c in others])
    alive = merged.where(F.col(expires).isNull() | (F.col(expires) > now)).withColumn("version", F.lit(batch).cast("bigint"))
    (alive.repartition(buckets, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(f"{path}/rows"))
    committed = own.select("bucket").distinct().select(F.lit(batch).cast("bigint").alias("batch"), "bucket", F.lit(batch).cast("bigint").alias("version"))
    committed.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return True


def read(spark: SparkSession, path: str, schema: str, now: Column, *, expires: str = "expires_at") -> DataFrame:
    """The table's rows that haven't expired."""
    live = _live(spark, path, StructType.fromDDL(schema))
    if live is None:
        return spark.createDataFrame([], schema)
    return live.drop("bucket").where(F.col(expires).isNull() | (F.col(expires) > now))


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, schema: str, now: Column, **options):
    """stream, upserted batch by batch; a batch that is run again changes nothing."""
    return stream.writeStream.foreachBatch(lambda rows, batch: upsert(rows.sparkSession, path, rows, batch, schema, now, **options) and None).option("checkpointLocation", checkpoint)


def swap_if_changed(rows: DataFrame, path: str, columns: list[str], order: list[Column]) -> bool:
    """Replaces the table in path by rows if the digest of its ordered rows differs; whether it has."""
    spark = rows.sparkSession
    own = rows.withColumn("_all", F.lit(0))
    signature = lambda df: signatures(df, columns, order, "_all").collect()  # noqa: E731  one row
    try:
        before = signature(spark.read.schema(rows.schema).parquet(path).withColumn("_all", F.lit(0)))
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        before = None
    if before == signature(own):
        return False
    rows.write.mode("overwrite").parquet(path)
    return True
