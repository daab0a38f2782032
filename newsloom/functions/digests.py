"""Digests of ordered tables, and the client's article id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text, urls
from newsloom.operators.selection import ranked

#: Multiplier and seeds of the client's hashes.
PRIME, SEEDS = 16777619, (2166136261, 0x9E3779B1)
_MASK = 0xFFFFFFFF


def hash32(x: Column, seed: int) -> Column:
    """A fold over the UTF-16 code units of x in 32 bits that wrap; a bigint from 0 on."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(x, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), lambda u: F.conv(u, 16, 10).cast("bigint"))

    def step(h: Column, u: Column) -> Column:
        product = (h.bitwiseXOR(u) * F.lit(PRIME)).bitwiseAND(F.lit(_MASK))
        return product.bitwiseXOR(F.shiftright(product, 13))

    return F.aggregate(units, F.lit(seed).cast("bigint"), step)


def client_article_id(url: Column, title: Column) -> Column:
    """a- and both hashes of the canonical address and the normalised title, as hexadecimal digits."""
    key = F.concat_ws("|", urls.canonical(url), text.normalise(title))
    return F.concat(F.lit("a-"), *[F.lpad(F.lower(F.hex(hash32(key, s))), 8, "0") for s in SEEDS])


def row_part(columns: list[str]) -> Column:
    """The row's columns as one string; nulls are empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def signatures(df: DataFrame, columns: list[str], order: list[Column], group: str) -> DataFrame:
    """group, n and signature: a digest of each group's rows in order.

    A row's digest is that of its place and its columns, and digests are summed: partitions sum their own, sums merge in
    any way, and yet two rows that change places change the result.
    """
    placed = ranked(df.select(group, *columns, *[c for c in df.columns if c not in (group, *columns)]), order, "_place", group)
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("_place").cast("string"), row_part(columns)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    more = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("_place").cast("string"), row_part(columns)), 256), 16, 15), 16, 10).cast("decimal(38,0)")
    return placed.groupBy(group).agg(F.count("*").alias("n"), F.concat_ws("-", F.sum(row).cast("string"), F.sum(more).cast("string")).alias("signature"))
