"""Approximate nearest neighbours by largest inner product: inverted lists with an adaptive scan of dimensions.

Vectors get one more component that makes all norms equal (so the largest inner product is the smallest distance), and
a random rotation spreads their energy evenly over the columns. There are about as many lists as the square root of the
rows, from k-means on a bounded sample; every row is indexed. Within a probed list, candidates are compared in blocks of
columns: after each block a hypothesis test on the scaled partial distance abandons those that are very unlikely to come
under the query's current k-th distance; who remains gets the exact double-precision inner product of the original
vectors. While many pairs are left a block is one product of matrices, and then pair by pair. A query's nearest list is
searched first; what it finds is the bound for its other lists, and lists whose nearest possible row lies beyond it are
left out. Lists and their queries are cut into blocks of bounded size, so that neither a crowded list nor one vector
that makes up a third of all rows lands in a single task.

The test's strictness and the number of probed lists are calibrated together on the sample against brute force within
it (TEST_GOAL, RECALL_GOAL). Queries that then have fewer than k rows go through twice as many lists, without abandoning
anyone, until each has k or has seen all.

Defined cases: rows with a null id, a null or zero vector, null or non-finite components, or another length than the
most frequent one (the longer, if tied) take no part; ties go to the smaller id; rows with the query's id aren't its
candidates; of several rows with one id each is a candidate, and the smallest vector is the query; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import bounded_batches, bounded_sample, materialise

#: Bounds of the fit: components of all vectors of the sample, lists, and queries of the calibration.
SAMPLE_VALUES = 1 << 21
MOST_LISTS = 4096
CALIBRATION_QUERIES = 400
#: Of the sample's true neighbours: how many the test has to let pass, and how many have to be found in all.
TEST_GOAL = 0.98
RECALL_GOAL = 0.94
#: The test: columns of a block, and how many standard errors of the partial distance count as very unlikely.
BLOCK_COLUMNS = 16
EPSILONS = (1.0, 1.3, 1.6, 1.9, 2.2, 2.5, 3.0)
#: Rows of one task's block of a list, and of its queries; both are looked through in tiles.
CELL_ROWS = 1 << 15
CELL_QUERIES = 1 << 13
_QUERY_TILE, _ROW_TILE = 256, 2048
#: Above this share of pairs left a block is done for all.
DENSE = 0.06


@dataclass(frozen=True)
class Index:
    dimension: int
    norm2: float  # the largest squared norm
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    epsilon: float = EPSILONS[-1]

    def tests(self) -> list[tuple[int, float]]:
        """Where blocks of columns end, and the share of the squared radius that a partial distance may have there."""
        columns = len(self.rotation)
        ends = [*range(BLOCK_COLUMNS, columns - BLOCK_COLUMNS // 2, BLOCK_COLUMNS), columns]
        return [(d, (1 + self.epsilon / np.sqrt(d)) ** 2 * d / columns if d < columns else 1.0) for d in ends]

    def rotate(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        """Vectors with the evening component (0 for queries), rotated."""
        extra = np.zeros(len(vectors)) if queries else np.sqrt(np.maximum(0.0, self.norm2 - (vectors * vectors).sum(axis=1)))
        return np.column_stack([vectors, extra]) @ self.rotation

    def list_distances(self, rotated: np.ndarray) -> np.ndarray:
        """Squared distances of rows to the centroids."""
        return np.maximum((rotated**2).sum(axis=1)[:, None] + (self.centroids**2).sum(axis=1) - 2 * rotated @ self.centroids.T, 0.0)

    def nearest_lists(self, rotated: np.ndarray, most: int) -> np.ndarray:
        distance = self.list_distances(rotated)
        if most == 1:
            return distance.argmin(axis=1)[:, None]
        return np.argsort(distance, axis=1, kind="stable")[:, :most]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, vector) rows that take part, and their dimension (0: none)."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, good), F.lit(False)) & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return rows, 0
    return rows.where(F.size("vector") == sizes[0]["d"]), sizes[0]["d"]


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), float).reshape(-1, dimension)


def fit(rows: DataFrame, dimension: int, seed: int = 3) -> Index:
    """Rotation, lists, probes and the test's strictness from at most SAMPLE_VALUES components of sampled rows."""
    total = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("norm2")).first()
    sample = bounded_sample(rows, ["id", "vector"], max(1, SAMPLE_VALUES // dimension)).toArrow()
    vectors = _matrix(sample.column("vector"), dimension)
    vectors = vectors[np.lexsort((*vectors.T[:2], sample.column("id").to_numpy()))]
    rng = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(rng.standard_normal((dimension + 1, dimension + 1)))
    lists = max(1, min(MOST_LISTS, round(total["n"] ** 0.5), len(vectors) // 8))
    index = Index(dimension, total["norm2"] * (1 + 1e-12), rotation, np.zeros((1, dimension + 1)), 1)
    rotated = index.rotate(vectors)
    index = replace(index, centroids=rotated[rng.choice(len(rotated), lists, replace=False)], probes=lists)
    for _ in range(10):
        own = _own_lists(index, rotated)
        sums = np.zeros_like(index.centroids)
        np.add.at(sums, own, rotated)
        counts = np.bincount(own, minlength=lists)
        index = replace(index, centroids=np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], index.centroids))
    return _calibrate(index, vectors, rng)


def _own_lists(index: Index, rotated: np.ndarray) -> np.ndarray:
    return np.concatenate([index.nearest_lists(rotated[low : low + 4096], 1)[:, 0] for low in range(0, len(rotated), 4096)])


def _nearest(vectors: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k rows of the largest inner products with each of the rows `at`, but itself."""
    score = vectors[at] @ vectors.T
    score[np.arange(len(at)), at] = -np.inf
    return np.argpartition(score, score.shape[1] - k, axis=1)[:, -k:]


def _calibrate(index: Index, vectors: np.ndarray, rng: np.random.Generator, k: int = 20) -> Index:
    """The strictest test that lets TEST_GOAL of the sample's own k nearest pass at their k-th distance, and with it the
    fewest probes that find RECALL_GOAL of them."""
    at = rng.choice(len(vectors), min(CALIBRATION_QUERIES, len(vectors)), replace=False)
    k = min(k, max(1, len(vectors) - 1))
    best = np.concatenate([_nearest(vectors, at[low : low + 25], k) for low in range(0, len(at), 25)])
    data, asked = index.rotate(vectors), index.rotate(vectors[at], queries=True)
    partial = np.cumsum((data[best] - asked[:, None, :]) ** 2, axis=2)
    radius2 = partial[:, :, -1].max(axis=1, keepdims=True) * (1 + 1e-9)
    for epsilon in EPSILONS:
        index = replace(index, epsilon=epsilon)
        passed = np.all([partial[:, :, d - 1] <= radius2 * share for d, share in index.tests()], axis=0)
        if passed.mean() >= TEST_GOAL:
            break
    own = _own_lists(index, data)
    order = np.argsort(index.nearest_lists(asked, len(index.centroids)), axis=1)
    needed = np.where(passed, np.take_along_axis(order, own[best], axis=1), len(index.centroids) - 1)
    needed = np.sort(needed.ravel())
    return replace(index, probes=int(needed[min(len(needed) - 1, int(np.ceil(RECALL_GOAL * len(needed))))]) + 1)


def scan_cell(index: Index, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's k best here with a score of bounds or more; exact: only the impossible are abandoned."""
    data, asked = index.rotate(vectors).astype(np.float32), index.rotate(queries, queries=True).astype(np.float32)
    tests = [(d, 1.0) for d, _ in index.tests()] if exact else index.tests()
    norms = (queries * queries).sum(axis=1) + index.norm2
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low in range(0, len(queries), _QUERY_TILE):
        part = slice(low, low + _QUERY_TILE)
        own, own_ids, first_bound = asked[part], query_ids[part], bounds[part]
        best = np.full((len(own), k), -np.inf)  # scores so far
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start in range(0, len(ids), _ROW_TILE):
            tile = slice(start, start + _ROW_TILE)
            rows, row_ids = data[tile], ids[tile]
            bound = np.maximum(first_bound, best.min(axis=1))
            # single precision is off by less than this, so no test abandons anyone by rounding
            radius2 = (np.maximum(norms[part] - 2 * bound, 0.0) + 1e-5 * norms[part]).astype(np.float32)
            q, c = _survivors(rows, own, radius2, tests)
            stay = own_ids[q] != row_ids[c]
            q, c = q[stay], c[stay]
            score = (vectors[tile][c] * queries[part][q]).sum(axis=1)
            stay = score >= bound[q]
            q, c, score = q[stay], c[stay], score[stay]
            if not len(q):
                continue
            kept.append((q, row_ids[c], score))
            columns, c = np.unique(c, return_inverse=True)
            more = np.full((len(own), len(columns)), -np.inf)
            more[q, c] = score
            more = np.concatenate([best, more], axis=1)
            best = np.partition(more, more.shape[1] - k, axis=1)[:, -k:]
        if not kept:
            continue
        q, candidate, score = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((candidate, -score, q))
        q, candidate, score = q[order], candidate[order], score[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((own_ids[q[top]], candidate[top], score[top]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _survivors(rows: np.ndarray, own: np.ndarray, radius2: np.ndarray, tests: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that no test abandons; block by block for all pairs while many are left, then pair by pair."""
    start, partial, pairs = 0, 0.0, None
    for end, share in tests:
        a, b = own[:, start:end], rows[:, start:end]
        start = end
        if pairs is None:
            partial = partial + ((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T)
            alive = partial <= (radius2 * np.float32(share))[:, None]
            left = np.count_nonzero(alive)
            if left <= DENSE * alive.size:
                pairs = np.nonzero(alive)
                partial = partial[pairs]
            elif end < len(rows[0]):
                partial[~alive] = np.inf
        else:
            q, c = pairs
            partial = partial + ((b[c] - a[q]) ** 2).sum(axis=1)
            stay = partial <= radius2[q] * np.float32(share)
            pairs, partial = (q[stay], c[stay]), partial[stay]
    return np.nonzero(alive) if pairs is None else pairs


def _cells(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _search_lists(index: Index, listed: DataFrame, asked: DataFrame, blocks: dict[int, int], k: int, exact: bool = False) -> DataFrame:
    """query_id, vec_id, score of the k best in each cell; asked has query_id, vector, bound and list."""
    spark = listed.sparkSession
    shared = spark.sparkContext.broadcast(index)
    counts = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row per list, MOST_LISTS at most
    many = lambda x, size: -(-x // size)
    parts = F.create_map(*[F.lit(x) for item in {key: max(1, many(counts.get(key, 0), CELL_QUERIES)) for key in blocks}.items() for x in item])
    cuts = F.create_map(*[F.lit(x) for item in blocks.items() for x in item])
    left = listed.where(F.col("list").isin(*counts)).select("list", F.pmod(F.xxhash64("id"), cuts[F.col("list")]).cast("int").alias("block"), _cells(parts[F.col("list")]).alias("part"), "id", "vector")
    right = asked.where(F.col("list").isin(*blocks)).select("list", _cells(cuts[F.col("list")]).alias("block"), F.pmod(F.xxhash64("query_id"), parts[F.col("list")]).cast("int").alias("part"), "query_id", "vector", "bound")

    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        own = shared.value
        if not candidates.num_rows or not queries.num_rows:
            result = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            result = scan_cell(own, candidates.column("id").to_numpy(), _matrix(candidates.column("vector"), own.dimension), queries.column("query_id").to_numpy(), _matrix(queries.column("vector"), own.dimension), queries.column("bound").to_numpy(), k, exact)
        return pa.table([pa.array(x) for x in result], names=["query_id", "vec_id", "score"])

    key = ["list", "block", "part"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id bigint, vec_id bigint, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which is_query (of column id) holds."""
    spark = vectors.sparkSession
    rows, dimension = usable(vectors, id_col, vector_col)
    if not dimension:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    bounded_batches(spark)
    index = fit(rows, dimension)
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf("list int, distance double")
    def own_list(vector: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in vector:
            own = shared.value
            distance = own.list_distances(own.rotate(_matrix(batch, own.dimension)))
            at = distance.argmin(axis=1)
            yield pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.sqrt(distance[np.arange(len(at)), at]))], names=["list", "distance"])

    def lists_of(probes: int):
        @F.arrow_udf("array<int>")
        def nearest(vector: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in vector:
                own = shared.value
                near = own.nearest_lists(own.rotate(_matrix(batch, own.dimension), queries=True), probes)
                yield pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))

        return nearest

    listed = materialise(rows.select("id", "vector", own_list("vector").alias("at")).select("id", "vector", "at.list", "at.distance"), "lists")
    sizes = {r["list"]: (r["n"], r["radius"]) for r in listed.groupBy("list").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}  # MOST_LISTS at most
    blocks = {key: max(1, -(-n // CELL_ROWS)) for key, (n, _) in sizes.items()}
    radii = np.full(len(index.centroids), -1.0)  # -1: no rows
    radii[list(sizes)] = [r for _, r in sizes.values()]

    @F.arrow_udf("array<int>")
    def reachable(vectors: pa.Array, bounds: pa.Array) -> pa.Array:
        """The probed lists but the nearest that may hold a row with a score of the bound."""
        own = shared.value
        asked = own.rotate(_matrix(vectors, own.dimension), queries=True)
        distance = own.list_distances(asked)
        order = np.argsort(distance, axis=1, kind="stable")[:, : own.probes]
        reach = np.sqrt(np.maximum((asked**2).sum(axis=1) + own.norm2 - 2 * np.asarray(bounds, float), 0.0)) * (1 + 1e-9)
        near = np.sqrt(np.take_along_axis(distance, order, axis=1)) - radii[order] <= np.where(np.isfinite(reach), reach, np.inf)[:, None]
        near &= radii[order] >= 0
        near[:, 0] = False
        return pa.array([o[n].astype(np.int32) for o, n in zip(order, near, strict=True)], pa.list_(pa.int32()))

    asked = materialise(rows.where(is_query).groupBy(F.col("id").alias("query_id")).agg(F.min("vector").alias("vector")), "queries")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    near = asked.select("query_id", "vector", F.lit(float("-inf")).alias("bound"), F.explode(lists_of(1)("vector")).alias("list"))
    first = materialise(top(_search_lists(index, listed, materialise(near, "near-queries"), blocks, k)), "nearest-lists")
    found = first.select("query_id", "vec_id", "score")
    if index.probes > 1:
        bound = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
        far = asked.join(bound, "query_id", "left").select("query_id", "vector", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
        far = far.select("query_id", "vector", "bound", F.explode(reachable("vector", "bound")).alias("list"))
        found = found.unionByName(_search_lists(index, listed, materialise(far, "far-queries"), blocks, k))
    result, lists = materialise(top(found).select("query_id", "rank", "vec_id", "score"), "found"), index.probes
    while lists:
        counts = result.groupBy("query_id").agg(F.count("*").alias("n"))
        short = materialise(asked.select("query_id", "vector").join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).drop("n"), "short-queries")
        if not short.limit(1).count():
            break
        lists = min(2 * lists, len(index.centroids))
        wide = short.select("query_id", "vector", F.lit(float("-inf")).alias("bound"), F.explode(lists_of(lists)("vector")).alias("list"))
        again = top(_search_lists(index, listed, materialise(wide, "wide-queries"), blocks, k, exact=True)).select("query_id", "rank", "vec_id", "score")
        result = materialise(result.join(short.select("query_id"), "query_id", "left_anti").select(result.columns).unionByName(again), "found")
        lists = 0 if lists == len(index.centroids) else lists
    return result
