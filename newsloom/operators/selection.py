"""Quotas, caps, round robins and samples, by windows whose row limits Spark prunes before the shuffle; ranks of all rows by range-cut blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.storage import cut


def top_and_daily(df: DataFrame, day: str, order: list[Column], *, id_col: str = "doc_id", top: int = 160, daily: int = 12, cap: int = 700) -> DataFrame:
    """The first `top` rows, then the first `daily` of each day, newest day first, up to cap rows; adds phase and day_rank."""
    own = cut(df)  # both choices read it, and what its rows cost is paid once
    first = own.orderBy(*order).limit(top)
    ranked = own.withColumn("day_rank", F.row_number().over(Window.partitionBy(day).orderBy(*order))).where(F.col("day_rank") <= daily)
    rest = ranked.join(first.select(id_col), id_col, "left_anti").withColumn("phase", F.lit(1))
    both = first.withColumn("day_rank", F.lit(0)).withColumn("phase", F.lit(0)).unionByName(rest)
    return both.orderBy("phase", F.when(F.col("phase") == 1, F.col(day)).desc(), F.col("day_rank"), *order).limit(cap)


def ranked(df: DataFrame, order: list[Column], name: str, group: str | None = None) -> DataFrame:
    """df and name: each row's place in its group (None: among all), from 1.

    Rows are cut by ranges of group and order into blocks, ranked within them, and moved on by the sizes of the group's
    earlier blocks, so a group of any size isn't one task. The blocks are stored: both uses must see the same cuts.
    """
    own = df.withColumn("_group", F.struct(F.col(group) if group else F.lit(0)))
    blocks = cut(own.repartitionByRange("_group", *order).withColumn("_block", F.spark_partition_id()))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.groupBy("_group", "_block").agg(F.count("*").alias("_n")).select("_group", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_group", "_block").orderBy(*order))
    return blocks.withColumn("_within", within).join(offsets, ["_group", "_block"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_group", "_block", "_before", "_within")


def day_order(df: DataFrame, day: str, order: list[Column], quotas: tuple[int, ...] = (24, 16, 8)) -> DataFrame:
    """All rows with day_rank (newest day first), rank within the day and overflow; by overflow, day_rank, rank they are in order.

    The first day's quota is the first of quotas, and so on; the last holds for all later days.
    """
    days = df.select(day).distinct().withColumn("day_rank", F.row_number().over(Window.orderBy(F.desc(day))))
    places = F.broadcast(days.withColumnRenamed(day, "_day"))  # a row for each day
    quota = F.get(F.array(*map(F.lit, quotas)), F.least(F.col("day_rank"), F.lit(len(quotas))) - 1)
    return ranked(df, order, "rank", day).join(places, F.col(day).eqNullSafe(F.col("_day"))).drop("_day").withColumn("overflow", F.col("rank") > quota)


def round_robin(df: DataFrame, group: str, order: list[Column], most: int | None = None) -> DataFrame:
    """Rows as groups take turns, a row each, in the order of the groups' best rows; adds turn.

    With most, the first `most` rows in order. Without, all rows and place, the place of a row's group: turn, place is the order.
    """
    if most is None:
        turns = cut(ranked(df, order, "turn", group))
        places = ranked(turns.where("turn = 1"), order, "place").select(F.struct(group).alias("_group"), "place")
        return turns.withColumn("_group", F.struct(group)).join(places, "_group").drop("_group")
    own = Window.partitionBy(group).orderBy(*order)
    turns = df.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= most)
    best = turns.where("turn = 1").orderBy(*order).limit(most)  # later groups have no turn among the first `most`
    places = best.withColumn("_place", F.row_number().over(Window.orderBy(*order))).select(F.col(group).alias("_group"), "_place")
    return turns.join(places, F.col(group).eqNullSafe(F.col("_group"))).orderBy("turn", "_place").limit(most).drop("_group", "_place")


def flood_cap(df: DataFrame, order: list[Column], *, source: str = "source", custom: str = "custom_source", per_source: int = 20, custom_each: int = 4, custom_all: int = 10) -> DataFrame:
    """At most custom_each custom rows of a source and custom_all of all, then at most per_source rows of a source."""
    own = Window.partitionBy(source).orderBy(*order)
    chosen = df.where(F.col(custom)).withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= custom_each).drop("_rank").orderBy(*order).limit(custom_all)
    both = df.where(~F.col(custom)).unionByName(chosen)
    return both.withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= per_source).drop("_rank")


def stratified(df: DataFrame, strata: list[str], order: list[Column], each: int = 1) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("_rank") <= each).drop("_rank")


def audit_sample(df: DataFrame, strata: list[Column], order: list[Column], limit: int, *, id_col: str = "doc_id") -> DataFrame:
    """The sample of a pass over strata: of each the first row of every value that isn't chosen yet, values by their first
    rows, then the first rows of all; `limit` rows, with pick (from 1).

    order has ascending columns and ends in what tells rows apart. A stratum is two aggregations by its values; chosen rows
    are `limit` at most, so they are broadcast.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    own = cut(df.select(F.col(id_col).alias("_id"), key.alias("_key"), *[s.alias(f"_s{i}") for i, s in enumerate(strata)]))
    chosen = df.sparkSession.createDataFrame([], own.select("_id").withColumn("pick", F.lit(0)).schema)
    for i in range(len(strata) + 1):
        have = chosen.count()
        if have >= limit:
            break
        left = own.join(F.broadcast(chosen.select("_id")), "_id", "left_anti")
        if i < len(strata):
            first = own.groupBy(f"_s{i}").agg(F.min("_key").alias("_first"))
            best = left.groupBy(f"_s{i}").agg(F.min_by("_id", "_key").alias("_id"))
            found = first.join(best, first[f"_s{i}"].eqNullSafe(best[f"_s{i}"])).select("_id", F.col("_first").alias("_place"))
        else:
            found = left.select("_id", F.col("_key").alias("_place"))
        some = found.orderBy("_place").limit(limit - have)
        chosen = cut(chosen.unionByName(some.select("_id", (F.row_number().over(Window.orderBy("_place")) + have).alias("pick"))))
    return df.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).drop("_id")


def running_cut(df: DataFrame, key: str, order: list[Column], size: Column, most: int) -> DataFrame:
    """Rows of each key as long as the sum of their sizes stays within most."""
    total = F.sum(size).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", total).where(F.col("running") <= most)
