"""Groups by any member against the loop, ids and digests on stated values, upserts that are repeated or die."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions import digests
from newsloom.operators import editorial, groups
from newsloom.streaming import shared

ROWS = "key string, name string, told string, updated_at timestamp, expires_at timestamp"


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_the_loop(spark, seed):
    r = random.Random(seed)
    n = 60
    edges = [(a, b) for a in range(n) for b in range(a) if r.random() < (0.02, 0.05, 0.1)[seed]]
    order = r.sample(range(n), n)  # ids aren't in order
    edges = [(order[a], order[b]) if r.random() < 0.5 else (order[b], order[a]) for a, b in edges]
    near = {frozenset(e) for e in edges}
    found: list[list[int]] = []
    for x in order:
        own = next((g for g in found if any(frozenset((x, y)) in near for y in g)), None)
        own.append(x) if own else found.append([x])
    want = {x: g[0] for g in found for x in g}
    nodes = spark.createDataFrame([(x, k) for k, x in enumerate(order)], "id long, ord int")
    got = groups.any_member_groups(nodes, spark.createDataFrame(edges, "a long, b long"))
    assert {x["id"]: x["group"] for x in got.groups.collect()} == want
    assert got.rounds <= n


def test_equal_keys_reach_all_earlier_rows_in_few_rounds(spark):
    """150 rows of one key, of which one in the middle tells an older story too: all later ones follow it."""
    nodes = spark.range(-1, 150).select("id", F.col("id").alias("ord"), F.when(F.col("id") >= 0, "k").otherwise("").alias("key"))
    edges = groups.key_edges(nodes, "key")
    assert edges.count() < 150 * 8
    got = groups.any_member_groups(nodes.select("id", "ord"), edges.unionByName(spark.createDataFrame([(75, -1)], "a long, b long")))
    assert {r["id"]: r["group"] for r in got.groups.collect()} == {k: -1 if k == -1 or k >= 75 else 0 for k in range(-1, 150)}
    assert got.rounds <= 12


def test_alike_titles_give_few_pairs_and_the_same_groups(spark):
    """Short titles that are part of many: pairs grow with rows, and what can be reached is the same as by all pairs."""
    r = random.Random(7)
    words = [f"mot{k}" for k in range(30)]
    rows = []
    for k in range(900):
        own = r.sample(words, r.choice((0, 1, 1, 2, 3, 5, 8)))
        rows.append((k, -k, r.choice(("Politique", "International", "", None)), None if r.random() < 0.01 else 1_700_000_000 - k * 1000, ["seisme", "japon", "bilan", "province", "centrale"][: r.choice((3, 4, 5))] + own))
    frame = spark.createDataFrame(rows, "id long, neg long, category string, s long, tokens array<string>").select("id", F.struct(-F.col("s").alias("t"), "id").alias("ord"), "category", F.timestamp_seconds("s").alias("published_at"), "tokens")
    order = sorted(rows, key=lambda x: (x[3] is not None, -(x[3] or 0), x[0]))
    place, families = {x[0]: k for k, x in enumerate(order)}, [set(f) for f in editorial.FAMILIES]

    def linked(a, b):
        common = len(set(a[4]) & set(b[4]))
        fits = not a[2] or not b[2] or a[2] == b[2] or any({a[2], b[2]} <= f for f in families)
        near = a[3] is None or b[3] is None or abs(a[3] - b[3]) <= 72 * 3600
        least, union = min(len(a[4]), len(b[4])), len(a[4]) + len(b[4]) - common
        return fits and near and (common >= 5 and common / least >= 0.68 and common / union >= 0.44 or common >= 4 and common / least >= 0.8)

    pairs, label = {(a[0], b[0]) for k, a in enumerate(order) for b in order[:k] if linked(a, b)}, {}
    for a in order:
        found = [label[b[0]] for b in order[: place[a[0]]] if (a[0], b[0]) in pairs]
        label[a[0]] = min(found, key=place.get) if found else a[0]
    edges = groups.alike_edges(frame)
    got = {(x["a"], x["b"]) for x in edges.collect()}
    assert all((a, b) in pairs or (b, a) in pairs for a, b in got)
    assert len(got) < len(pairs) / 2
    assert {x["id"]: x["group"] for x in groups.any_member_groups(frame.select("id", "ord"), edges).groups.collect()} == label


def looped_hash(x: str, seed: int) -> int:
    raw, h = x.encode("utf-16-be"), seed
    for k in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[k : k + 2], "big")) * 16777619) & 0xFFFFFFFF
        h ^= h >> 13
    return h


def test_client_ids(spark):
    texts = ["", "a", "été", "\U0001f600", "https://x.org/|un titre", "￿" * 300]
    for seed in digests.SEEDS:
        got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", digests.hash32(F.col("t"), seed).alias("h")).collect()
        assert [r["h"] for r in sorted(got)] == [looped_hash(t, seed) for t in texts]
    one = spark.range(1).select(digests.client_article_id(F.lit("HTTPS://X.org/a/?utm_source=1#z"), F.lit("Été !"))).first()[0]
    assert one == "a-" + "".join(f"{looped_hash('https://x.org/a|ete', s):08x}" for s in digests.SEEDS)


def test_signatures_know_order_not_partitions(spark):
    rows = [(k, f"t{k}", "g") for k in range(40)]
    sign = lambda rows, parts: digests.signatures(spark.createDataFrame(rows, "k int, t string, g string").repartition(parts), ["t"], [F.col("k")], "g").collect()
    first = sign(rows, 1)
    assert first == sign(rows[::-1], 7)
    swapped = [(k, f"t{ {3: 4, 4: 3}.get(k, k) }", "g") for k in range(40)]
    assert first != sign(swapped, 1) and first != sign(rows[:-1], 1) and first != sign([(k, t + " ", g) for k, t, g in rows], 1)


def test_upserts(spark, tmp_path):
    path, at = str(tmp_path / "t"), lambda n: F.lit(f"2024-01-{n:02d}").cast("timestamp")
    make = lambda rows, days=30: spark.createDataFrame([(k, n, t, None, None) for k, n, t in rows], ROWS).withColumns({"updated_at": at(1), "expires_at": at(1) + F.make_dt_interval(days=F.lit(days))})
    held = lambda n=2: {(r["key"], r["name"], r["told"]) for r in shared.read(spark, path, ROWS, at(n)).collect()}
    put = lambda rows, batch, now=2: shared.upsert(spark, path, rows, batch, ROWS, at(now), key="key", buckets=4)
    assert held() == set()
    assert put(make([(f"k{k}", "n", "old") for k in range(20)] + [("k1", "n", "zzz"), (None, "n", "x")]), 0)
    assert put(make([("k3", "n", "new"), ("k99", "m", "new")]), 1)
    want = {(f"k{k}", "n", {1: "zzz", 3: "new"}.get(k, "old")) for k in range(20)} | {("k99", "m", "new")}
    assert held() == want
    # a replay does nothing, even with other rows; a batch that died before its commit is written again
    assert not put(make([("k3", "n", "other")]), 1) and held() == want
    orphan = make([("k5", "n", "half")]).select(F.pmod(F.xxhash64("key"), F.lit(4)).cast("int").alias("bucket"), "*").withColumn("version", F.lit(2).cast("long"))
    orphan.write.mode("append").partitionBy("version", "bucket").parquet(f"{path}/rows")
    assert held() == want
    # columns that rows lack stay
    assert put(make([("k5", "n", "whole"), ("k7", "n", "seven")]).drop("name"), 2)
    want = {w for w in want if w[0] not in ("k5", "k7")} | {("k5", "n", "whole"), ("k7", "n", "seven")}
    assert held() == want
    # expired rows are left out, and go when their bucket is rewritten
    assert put(make([("k11", "n", "short")], 4), 3) and ("k11", "n", "short") in held(4) and ("k11", "n", "short") not in held(6)


def test_upsert_stream_and_swap(spark, tmp_path):
    path, folder = str(tmp_path / "t"), str(tmp_path / "in")
    now = F.lit("2024-01-02").cast("timestamp")
    kind = "key string, told string, updated_at timestamp, expires_at timestamp"
    for k in range(2):
        spark.createDataFrame([(f"k{j}", f"v{k}") for j in range(k, 4)], "key string, told string").withColumns({"updated_at": now, "expires_at": now + F.make_dt_interval(days=F.lit(9))}).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)
    shared.upsert_stream(stream, path, str(tmp_path / "c"), kind, now, key="key").trigger(availableNow=True).start().awaitTermination()
    assert {(r["key"], r["told"]) for r in shared.read(spark, path, kind, now).collect()} == {("k0", "v0"), ("k1", "v1"), ("k2", "v1"), ("k3", "v1")}
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    swap = lambda df: shared.swap_if_changed(df, str(tmp_path / "s"), ["t"], [F.col("k")])
    assert swap(rows) and not swap(rows.orderBy(F.desc("k"))) and swap(spark.createDataFrame([(1, "b"), (2, "a")], "k int, t string"))


def test_merged_group_shows_its_best(spark):
    rows = [(1, "A", "x" * 60, False, False, "repeat", 9.0), (2, "B", "y" * 80, False, False, "development", 5.0), (3, "A", "Résumé indisponible " * 9, True, False, None, 1.0), (4, "C", "seul", False, True, "new", 2.0)]
    own = spark.createDataFrame(rows, "id long, source string, summary string, saved boolean, essential boolean, novelty string, score double").withColumns({"published_at": F.lit("2024-01-01").cast("timestamp"), "sources": F.array(F.lit("D"))})
    got = {r["group"]: r for r in groups.merge_groups(own, spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id long, group long")).collect()}
    assert (got[1]["lead"], got[1]["summary"], got[1]["score"], got[1]["copies"], got[1]["n_sources"], got[1]["merged_count"]) == (3, "y" * 80, 9.0, 3, 3, 3)
    assert (got[4]["lead"], got[4]["summary"], got[4]["corroborated"]) == (4, "seul", True)
