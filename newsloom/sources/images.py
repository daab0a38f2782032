"""Images as rows: files with their kinds and sizes, from the bytes at their heads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Markers of JPEG frames, kinds that are images of articles, and how many bytes and pixels these have.
FRAMES = frozenset((0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF))
KINDS = r"(?i)^image/(?:jpeg|png|webp|avif)"
LEAST_BYTES, MOST_BYTES, LEAST_WIDTH, LEAST_HEIGHT, LEAST_PIXELS, SQUARE_MOST, SQUARE_WITHIN = 3_500, 7_000_000, 180, 100, 45_000, 260, 25


def head_size(head: bytes, kind: str) -> tuple[int, int]:
    """(width, height) from a PNG's header or a JPEG's frame; (0, 0) if there is none."""
    if "png" in kind.lower() and len(head) >= 24 and head[1:4] == b"PNG":
        return int.from_bytes(head[16:20], "big"), int.from_bytes(head[20:24], "big")
    if "jpeg" in kind.lower() or "jpg" in kind.lower() or head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(head):
            if head[at] != 0xFF:
                at += 1
            elif head[at + 1] in FRAMES:
                return int.from_bytes(head[at + 7 : at + 9], "big"), int.from_bytes(head[at + 5 : at + 7], "big")
            else:
                size = int.from_bytes(head[at + 2 : at + 4], "big")
                if not size:
                    break
                at += 2 + size
    return 0, 0


def with_sizes(images: DataFrame, content: str = "content", kind: str = "kind") -> DataFrame:
    """images with bytes, width and height (0 where the head doesn't tell)."""

    @F.pandas_udf("width int, height int")
    def sizes(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for heads, kinds in parts:
            yield pd.DataFrame([head_size(h or b"", k or "") for h, k in zip(heads, kinds, strict=True)], columns=["width", "height"])

    told = images.withColumn("_size", sizes(F.col(content), F.col(kind)))
    return told.withColumns({"bytes": F.octet_length(content), "width": F.col("_size.width"), "height": F.col("_size.height")}).drop("_size")


def useful(kind: Column, n_bytes: Column, width: Column, height: Column) -> Column:
    """Whether an image is one of an article: its kind, its bytes, and, where its size is known, not too small and no small square."""
    known = (width > 0) & (height > 0)
    large = (width >= LEAST_WIDTH) & (height >= LEAST_HEIGHT) & (width.cast("long") * height >= LEAST_PIXELS)
    square = (width <= SQUARE_MOST) & (height <= SQUARE_MOST) & (F.abs(width - height) < SQUARE_WITHIN)
    return F.coalesce(kind.rlike(KINDS) & n_bytes.between(LEAST_BYTES, MOST_BYTES) & (~known | (large & ~square)), F.lit(False))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, kind (by the name's ending), bytes, width, height and useful of the image files below path, however deep."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.concat(F.lit("image/"), F.when(ending == "jpg", "jpeg").otherwise(ending))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", kind.alias("kind"), "content")
    sized = with_sizes(files).drop("content")
    return sized.withColumn("useful", useful(F.col("kind"), F.col("bytes"), F.col("width"), F.col("height")))
