"""Greedy choices in rounds: what a loop over sorted rows would pick, by aggregations over all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.storage import cut


def pick(df: DataFrame, group: str, order: list[Column], most: int, *, id_col: str = "doc_id", caps: dict[str, int] | None = None, conflict: Callable[[Column, Column], Column] | None = None, backfill_to: int = 0) -> DataFrame:
    """The rows of each group that a pass in order picks, `most` at most; adds pick (from 1).

    A row is passed over if a value of one of the columns in caps has had its number of picks, or if conflict(picked,
    row) holds for a picked row. Then groups with fewer than backfill_to picks take the first rows passed over.
    order has ascending columns (numbers negated to descend) and must end in what tells rows apart. Each of the `most` rounds takes the first open row of every group, a
    partial aggregation, and closes what it rules out; so a group is never gathered. A null group is a group.
    """
    caps = caps or {}
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    row = F.struct(*df.columns)
    pool = cut(df.select(F.col(group).alias("_group"), key.alias("_key"), row.alias("_row"), *[F.lit(0).alias(f"_n{i}") for i in range(len(caps))]))
    every, picks = pool.select("_group", "_key", "_row"), None
    for place in range(1, most + 1):
        best = cut(pool.groupBy("_group").agg(F.min_by(F.struct("_key", "_row"), "_key").alias("_best")).withColumn("pick", F.lit(place)))
        if not best.limit(1).count():
            break
        picks = best if picks is None else picks.unionByName(best)
        met = pool.join(best.select(F.col("_group").alias("_g"), "_best"), F.col("_group").eqNullSafe(F.col("_g"))).where(F.col("_key") > F.col("_best._key"))
        taken, own = F.col("_best._row"), F.col("_row")
        for i, c in enumerate(caps):
            met = met.withColumn(f"_n{i}", F.col(f"_n{i}") + taken[c].eqNullSafe(own[c]).cast("int"))
        for i, n in enumerate(caps.values()):
            met = met.where(F.col(f"_n{i}") < n)
        if conflict is not None:
            met = met.where(~F.coalesce(conflict(taken, own), F.lit(False)))
        pool = cut(met.drop("_g", "_best"))
    if picks is None:
        return df.where("false").withColumn("pick", F.lit(0))
    chosen = picks.select("_group", F.col("_best._key").alias("_key"), F.col("_best._row").alias("_row"), "pick")
    if backfill_to:
        have = chosen.groupBy(F.col("_group").alias("_g")).agg(F.max("pick").alias("_have"))
        left = every.join(chosen.select(F.col("_row")[id_col].alias("_id")), F.col("_row")[id_col] == F.col("_id"), "left_anti")
        fill = left.join(have.where(F.col("_have") < backfill_to), F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")
        place = F.row_number().over(Window.partitionBy("_group").orderBy("_key"))
        filled = fill.withColumn("_place", place).where(F.col("_place") <= backfill_to).withColumn("pick", F.col("_have") + F.col("_place")).where(F.col("pick") <= backfill_to)
        chosen = chosen.unionByName(filled.select("_group", "_key", "_row", "pick"))
    return chosen.select("_row.*", "pick")


def first_seen(df: DataFrame, keys: list[str], order: Column, *, id_col: str = "doc_id") -> DataFrame:
    """The rows that a pass in order keeps when it drops each row that shares a key with a kept one.

    A row is kept once no earlier open row shares a key with it, and dropped once a kept one does; each round is an
    aggregation for each key. Null and empty keys are shared by no one.
    """
    state = cut(df.select(F.col(id_col).alias("id"), order.alias("ord"), *[F.when(F.col(k) != "", F.col(k).cast("string")).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(None).cast("boolean").alias("kept")))
    names = [f"k{i}" for i in range(len(keys))]
    while state.where("kept is null").limit(1).count():
        new = state
        for k in names:
            live = state.where(F.col(k).isNotNull() & F.coalesce("kept", F.lit(True)))
            first = live.groupBy(F.col(k).alias("_k")).agg(F.min("ord").alias(f"first_{k}"), F.min(F.when(F.col("kept"), F.col("ord"))).alias(f"taken_{k}"))
            new = new.join(first, F.col(k) == F.col("_k"), "left").drop("_k")
        shared = F.greatest(*[F.coalesce(F.col(f"taken_{k}") < F.col("ord"), F.lit(False)) for k in names], F.lit(False))
        ahead = F.greatest(*[F.coalesce(F.col(f"first_{k}") < F.col("ord"), F.lit(False)) for k in names], F.lit(False))
        verdict = F.when(F.col("kept").isNotNull(), F.col("kept")).when(shared, False).when(~ahead, True)
        state = cut(new.select("id", "ord", *names, verdict.alias("kept")))
    return df.join(state.where("kept").select(F.col("id").alias(id_col)), id_col, "left_semi")


def merge_history(df: DataFrame, order: Column, *, url: str = "url_key", title: str = "title_key", at: str = "published_at", hours: int = 48, id_col: str = "doc_id") -> DataFrame:
    """The rows that a pass in order keeps when it drops a row whose url a kept one has, or whose title the latest kept
    row of that title has had within `hours`.

    Each round finds, for every title, the first open row that its latest kept row doesn't rule out; open rows before
    it go, and it stays once no earlier row of its url is open. Null and empty urls or titles are shared by no one, nor
    are titles of rows without a date. Rounds are as many as one title has kept rows, and chains of shared urls.
    """
    dated = F.when((F.col(title) != "") & F.col(at).isNotNull(), F.concat(F.lit("t"), F.col(title)))
    state = cut(df.select(F.col(id_col).alias("id"), order.alias("ord"), F.unix_millis(at).alias("at"), F.when(F.col(url) != "", F.col(url)).alias("url"), F.coalesce(dated, F.concat(F.lit("i"), F.col(id_col).cast("string"))).alias("title"), F.lit(None).cast("boolean").alias("kept")))
    while state.where("kept is null").limit(1).count():
        live = state.where(F.coalesce("kept", F.lit(True)))
        urls = live.where("url is not null").groupBy(F.col("url").alias("_u")).agg(F.min(F.when(F.col("kept"), F.col("ord"))).alias("taken"), F.min(F.when(F.col("kept").isNull(), F.col("ord"))).alias("open_url"))
        last = live.where("kept").groupBy(F.col("title").alias("_t")).agg(F.max_by("at", "ord").alias("last_at"))
        seen = state.where("kept is null").join(urls, F.col("url") == F.col("_u"), "left").join(last, F.col("title") == F.col("_t"), "left").drop("_t")
        used = F.coalesce(F.col("taken") < F.col("ord"), F.lit(False))
        recent = F.coalesce(F.abs(F.col("at") - F.col("last_at")) <= hours * 3_600_000, F.lit(False))
        seen = seen.withColumn("used", used).withColumn("gone", used | recent)
        first = seen.where(~F.col("gone")).groupBy(F.col("title").alias("_t")).agg(F.min("ord").alias("next"))
        placed = seen.join(first, F.col("title") == F.col("_t"), "left")
        stays = (F.col("ord") == F.col("next")) & ~F.coalesce(F.col("open_url") < F.col("ord"), F.lit(False))
        goes = F.col("used") | (F.col("gone") & (F.col("next").isNull() | (F.col("ord") < F.col("next"))))
        state = cut(state.where("kept is not null").unionByName(placed.select("id", "ord", "at", "url", "title", F.when(goes, False).when(stays, True).alias("kept"))))
    return df.join(state.where("kept").select(F.col("id").alias(id_col)), id_col, "left_semi")
