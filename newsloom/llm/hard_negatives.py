"""Hard negatives: for each anchor and positive the best rows of other labels whose scores lie within a window.

Vectors become integers (floor of SCALE times a component), and a score is their inner product, exact. Rows are dealt
into blocks of about CELL_ROWS, each block builds a ball tree over its vectors, and anchors meet every block in parts of
about CELL_ANCHORS: a stated set of queries against all rows. For an anchor q a node with centre c and radius r bounds
q.x from above and from below, q.c + |q| r and q.c - |q| r. A node is left out for a window if its rows lie wholly
outside of it, or are strictly beneath the k-th score found so far (equal scores stay, as a smaller id may win), or are
all of a label that doesn't count. The first search gives an anchor's positives (the same label, no window), the second
the negatives of each positive; what blocks find is merged by a window of at most k rows a block.

Defined cases: rows with a null id, label or vector, with null or non-finite components, with another length than the
most frequent one (the longer, if tied), or with components so large that a score might not fit a long, take no part;
rows with the anchor's id aren't others to it; of several rows that share an anchor's id the one with the smallest label
and vector is the anchor; positives that share id and score are one; scores tie to the smaller id; repeated rows are dealt by place, not by id; a negative positive
score leaves an empty window; an anchor without positives or negatives gives no rows; an empty table gives an empty
result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import bounded_batches, materialise

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LOW_PERCENT, HIGH_PERCENT = 30, 90
CELL_ROWS, CELL_ANCHORS = 1 << 15, 1 << 12
LEAF_ROWS = 128
#: Windows that go down a tree together: their buffers are bounded.
TILE_WINDOWS = 1 << 12

_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max
#: A product of doubles is exact below this.
_EXACT = 1 << 53


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: by floating point where no sum can pass 53 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


@dataclass(frozen=True)
class Node:
    low: int  # rows low to high of the tree's order
    high: int
    centre: np.ndarray
    radius: float
    label: int | None  # of all its rows, if they share one
    children: tuple[Node, ...]


class BallTree:
    """Rows of integer vectors in balls: halves along the line through two far rows, by rank, so equal vectors split too."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.lexsort((ids, labels))
        self.leaf_rows = leaf_rows
        points = vectors.astype(np.float64)
        self.root = self._ball(points, labels, 0, len(ids)) if len(ids) else None
        self.ids, self.labels, self.vectors = ids[self.order], labels[self.order], vectors[self.order]

    def _ball(self, points: np.ndarray, labels: np.ndarray, low: int, high: int) -> Node:
        own = self.order[low:high]
        inside = points[own]
        centre = inside.mean(axis=0)
        radius = float(np.sqrt(((inside - centre) ** 2).sum(axis=1).max()))
        first = labels[own]
        label = int(first[0]) if (first == first[0]).all() else None
        if high - low <= self.leaf_rows:
            return Node(low, high, centre, radius, label, ())
        one = inside[((inside - centre) ** 2).sum(axis=1).argmax()]
        other = inside[((inside - one) ** 2).sum(axis=1).argmax()]
        half = (high - low) // 2
        self.order[low:high] = own[np.argpartition(inside @ (other - one), half)]
        return Node(low, high, centre, radius, label, (self._ball(points, labels, low, low + half), self._ball(points, labels, low + half, high)))

    def search(self, anchors: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, asks: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, id, score) of the k best rows of each window: window w asks for scores from low[w] to high[w] with anchor asks[w], among rows of the same label or of others."""
        found = [self._search(anchors, anchor_ids, anchor_labels, asks, low, high, k, same, np.arange(at, min(at + TILE_WINDOWS, len(asks)))) for at in range(0, len(asks), TILE_WINDOWS)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def _search(self, anchors, anchor_ids, anchor_labels, asks, low, high, k, same, windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        norms = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
        least = np.full(len(asks), _NONE)  # the k-th score so far
        best = (np.zeros(0, np.int64),) * 3
        stack = [(self.root, windows[low[windows] <= high[windows]])] if self.root else []
        while stack:
            node, asked = stack.pop()
            if node.label is not None:
                asked = asked[(anchor_labels[asks[asked]] == node.label) == same]
            if not len(asked):
                continue
            upper, lower = self._bounds(node, anchors, norms, asks[asked])
            asked = asked[(upper >= low[asked]) & (lower <= high[asked]) & (upper >= least[asked])]
            if not len(asked):
                continue
            if node.children:
                near = sorted(node.children, key=lambda c: float(self._bounds(c, anchors, norms, asks[asked])[0].mean()))
                stack += [(child, asked) for child in near]  # the more promising one comes off first
                continue
            own, at = np.unique(asks[asked], return_inverse=True)
            score = products(anchors[own], self.vectors[node.low : node.high])
            fits = ((anchor_labels[own][:, None] == self.labels[node.low : node.high]) == same) & (anchor_ids[own][:, None] != self.ids[node.low : node.high])
            score, fits = score[at], fits[at]
            fits &= (score >= np.maximum(low, least)[asked][:, None]) & (score <= high[asked][:, None])
            w, c = np.nonzero(fits)
            if not len(w):
                continue
            best = _top(np.concatenate([best[0], asked[w]]), np.concatenate([best[1], self.ids[node.low : node.high][c]]), np.concatenate([best[2], score[w, c]]), k)
            last = np.flatnonzero(_places(best[0]) == k - 1)
            least[best[0][last]] = best[2][last]
        return best

    def _bounds(self, node: Node, anchors: np.ndarray, norms: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest and the smallest score that a row of the node may have, with room for rounding."""
        own, at = np.unique(asks, return_inverse=True)
        middle = anchors[own].astype(np.float64) @ node.centre
        size = norms[own] * (node.radius + np.sqrt((node.centre**2).sum()) * 1e-9) * (1 + 1e-9) + 1e-3
        return (middle + size)[at], (middle - size)[at]


def _places(keys: np.ndarray) -> np.ndarray:
    """The place of each row within its run of equal (sorted) keys."""
    return np.arange(len(keys)) - np.searchsorted(keys, keys)


def _top(window: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, window))
    window, ids, score = window[order], ids[order], score[order]
    keep = _places(window) < k
    return window[keep], ids[keep], score[keep]


def usable(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """(id, label, vector of integers) rows that take part, and their dimension (0: none)."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes or not sizes[0]["d"]:
        return rows, 0
    dimension = sizes[0]["d"]
    most = int(((1 << 62) // dimension) ** 0.5)
    whole = rows.where(F.size("vector") == dimension).withColumn("vector", F.transform("vector", lambda x: F.floor(F.lit(float(SCALE)) * x)))
    return whole.where(F.forall("vector", lambda x: x.between(-most, most))), dimension


def _matrix(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.int64).reshape(-1, dimension)


def _cells(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _search_blocks(rows: DataFrame, asked: DataFrame, dimension: int, blocks: int, parts: int, k: int, same: bool) -> DataFrame:
    """anchor_id, positive_id, positive_score, id, score of the k best in each block; asked has windows: positive_id, score, low and high."""
    left = rows.select(F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int").alias("block"), _cells(parts).alias("part"), "id", "label", "vector")
    right = asked.select(_cells(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.col("id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("vector").alias("anchor"), "windows")

    def search(own: pa.Table, anchors: pa.Table) -> pa.Table:
        names = ["anchor_id", "positive_id", "positive_score", "id", "score"]
        if not own.num_rows or not anchors.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5, names=names)
        tree = BallTree(own.column("id").to_numpy(), own.column("label").to_numpy(), _matrix(own.column("vector"), dimension))
        ids, windows = anchors.column("anchor_id").to_numpy(), anchors.column("windows").combine_chunks()
        asks = np.repeat(np.arange(len(ids)), windows.value_lengths().to_numpy(zero_copy_only=False))
        each = {name: np.asarray(windows.flatten().field(name), np.int64) for name in ("positive_id", "score", "low", "high")}
        w, found, score = tree.search(_matrix(anchors.column("anchor"), dimension), ids, anchors.column("anchor_label").to_numpy(), asks, each["low"], each["high"], k, same)
        return pa.table([pa.array(x) for x in (ids[asks[w]], each["positive_id"][w], each["score"][w], found, score)], names=names)

    cell = ["block", "part"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, "anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint")


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every row for which is_anchor (of
    column id) holds. label: the label to go by, of the columns id and label, where it isn't the given one."""
    spark = vectors.sparkSession
    rows, dimension = usable(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col)
    if not dimension:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    bounded_batches(spark)
    if label is not None:
        rows = rows.withColumn("label", label.cast("long"))
    rows = materialise(rows.withColumn("place", F.monotonically_increasing_id()), "vectors")
    anchors = materialise(rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("own")).select("id", "own.*"), "anchors")
    blocks, parts = max(1, -(-rows.count() // CELL_ROWS)), max(1, -(-anchors.count() // CELL_ANCHORS))

    window = lambda score, low, high, own: F.struct(own.cast("long").alias("positive_id"), score.cast("long").alias("score"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    all_scores = anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(int(_NONE)), F.lit(int(_LAST)), F.lit(0))))
    near = _search_blocks(rows, all_scores, dimension, blocks, parts, positives, True)
    told = materialise(_first(near, positives, "anchor_id").select("anchor_id", "id", "score"), "positives")
    # decimals: percentages of a long are exact
    share = F.col("score").cast("decimal(25,0)")
    low, high = F.ceil(share * LOW_PERCENT / 100), F.floor(share * HIGH_PERCENT / 100)
    windows = told.groupBy("anchor_id").agg(F.collect_set(window(F.col("score"), low, high, F.col("id"))).alias("windows"))  # positives of an anchor: a few
    asked = materialise(anchors.join(windows.withColumnRenamed("anchor_id", "id"), "id"), "windows")
    far = _search_blocks(rows, asked, dimension, blocks, parts, negatives, False)
    ranked = _first(far, negatives, "anchor_id", "positive_id", "positive_score")
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
