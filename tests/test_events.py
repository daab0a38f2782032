"""Event clustering against its sequential form."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import clustering, events, groups, support
from newsloom.plans import registry
from newsloom.storage import cut

SF = "/root/testdata/sf0.001"

NOON = datetime(2026, 8, 30, 12)
#: title, hours before noon, source, score
HEADLINES = [
    ("Islande : les électeurs rejettent la réouverture des négociations avec l'UE", 0, "A", 90.0),
    ("Référendum en Islande : le non l'emporte sur l'adhésion à l'Union européenne", 1, "B", 95.0),
    ("Les Islandais disent non aux négociations d'adhésion avec l'Union européenne", 2, "facebook.com", 80.0),
    ("Islande : le gouvernement réagit au non des électeurs à l'UE", 3, "C", 70.0),
    ("Naufrage d'un ferry au large de la Grèce : 12 morts", 0, "A", 60.0),
    ("Un ferry chavire au large de la Grèce, au moins 12 morts", 1, "B", 50.0),
    ("Naufrage d'un ferry au large de la Grèce : 19 morts et 3 blessés", 5, "C", 55.0),
    ("Fusillade à Lyon : deux blessés près de la gare", 0, "D", 40.0),
    ("Coups de feu à Lyon près de la gare, deux blessés", 60, "D", 40.0),
    ("Crue", 0, "E", 10.0),
    (None, 0, None, None),
]


def sequential(order, near, bonus, score):
    """founder and whether a row stood for its cluster, going through rows one by one."""
    clusters, found = [], {}
    for i in order:
        hit = next((c for c in clusters if near(c["rep"], i)), None)
        if hit is None:
            clusters.append({"rep": i, "founder": i, "score": score[i]})
            found[i] = (i, True)
            continue
        wins = bonus[i] + score[i] * 0.1 > bonus[hit["rep"]] + hit["score"] * 0.1
        hit["score"] = max(hit["score"], score[i])
        if wins:
            hit["rep"] = i
        found[i] = (hit["founder"], wins)
    return found


@pytest.mark.parametrize(("n", "density", "falling", "seed"), [(24, 0.15, False, 1), (30, 0.08, True, 2), (12, 0.6, False, 3), (12, 1.0, True, 4)])
def test_clusters_are_the_sequential_form(spark, n, density, falling, seed):
    rng = random.Random(seed)
    score = {i: float(n - i if falling else rng.randint(0, 50)) for i in range(n)}
    bonus = {i: float(rng.choice([-25, 0, 4, 8, 12])) for i in range(n)}
    edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < density}
    nodes = spark.createDataFrame([(i, i, bonus[i], score[i]) for i in range(n)], "id long, ord long, bonus double, score double")
    got = events.evolving_clusters(nodes, spark.createDataFrame(sorted(edges), "a long, b long")).collect()
    assert {r["id"]: (r["founder"], r["rep"]) for r in got} == sequential(range(n), lambda r, i: (r, i) in edges, bonus, score)


def headlines(spark):
    rows = [(k, t, t, s, NOON - timedelta(hours=h), x) for k, (t, h, s, x) in enumerate(HEADLINES)]
    return spark.createDataFrame(rows, "doc_id long, title string, summary string, source string, published_at timestamp, score double")


def test_tokens_and_claims(spark):
    rows = {r["id"]: r for r in events.event_view(headlines(spark)).collect()}
    assert rows[1]["tokens"] == ["vote", "islande", "outcome", "negotiation", "ue"]
    assert rows[3]["markers"] == ["reaction"] and rows[5]["claims"] == ["12:casualty"] and rows[6]["claims"] == ["19:casualty", "3:casualty"]
    assert rows[2]["bonus"] == 4 - 25 and rows[4]["bonus"] == 4 + 8 + 5 and rows[10]["bonus"] == -20 and rows[10]["tokens"] == []
    assert spark.range(1).select(events.slots(F.array(*map(F.lit, ["election", "elections", "vote"]))).alias("s")).first()["s"] == ["elect*#0", "elect*#1", "vote#0"]


def test_events_merge(spark):
    got = {r["doc_id"]: r for r in events.merge_events(headlines(spark)).collect()}
    member = {frozenset(r["sources"]): r["merged_count"] for r in got.values()}
    assert member[frozenset({"A", "B", "facebook.com"})] == 3  # the reaction, and the social copy's poor quality, stay apart
    assert got[4]["merged_count"] == 2 and got[6]["merged_count"] == 1  # a later, different toll
    assert got[7]["merged_count"] == got[8]["merged_count"] == 1  # more than 36 hours apart
    assert events.merge_events(headlines(spark).limit(0)).count() == 0


def test_edges_are_all_pairs_of_one_event(spark):
    view = events.event_view(headlines(spark)).join(headlines(spark).select(F.col("doc_id").alias("id")), "id")
    order = view.select("id", F.col("id").alias("ord"))
    rows = view.select("id", F.struct(*[c for c in view.columns if c != "id"]).alias("row"))
    every = rows.toDF("a", "a_row").crossJoin(rows.toDF("b", "b_row")).where("a < b").where(events.same_event("a_row", "b_row"))
    assert sorted(map(tuple, events.event_edges(view, order).collect())) == sorted(map(tuple, every.select("a", "b").collect()))


def test_copies_and_merged_sources_count(spark):
    title = "Naufrage d'un ferry au large de la Grèce : 12 morts"
    other = "Un navire coule au large de la Grèce, au moins 12 morts selon Athènes"
    rows = [(k, title, "court" if k else "bref", "BACDEFGB"[k], NOON - timedelta(minutes=k), 60.0) for k in range(8)]
    rows[6] = (*rows[6][:2], "le plus long des textes de toutes les copies", *rows[6][3:])
    rows.append((8, other, "moyen", "Z", NOON - timedelta(hours=1), 10.0))
    df = spark.createDataFrame(rows, "doc_id long, title string, summary string, source string, published_at timestamp, score double")
    leaders = {r["doc_id"]: r for r in clustering.lexical_merge(df).collect()}
    assert leaders.keys() == {0, 8} and leaders[0]["sources"] == ["B", "A", "C", "D", "E"] and leaders[0]["summary"] == rows[6][2]
    (story,) = events.merge_events(clustering.lexical_merge(df)).collect()
    assert (story["doc_id"], story["merged_count"], story["merged_rows"], story["summary"]) == (0, 6, 2, rows[6][2])
    assert story["sources"] == ["A", "B", "C", "D", "E", "Z"]
    given = df.where("doc_id in (0, 8)").withColumn("sources", F.when(F.col("doc_id") == 0, F.array(*map(F.lit, "ABC")))).withColumn("merged_count", F.when(F.col("doc_id") == 8, 5))
    (story,) = events.merge_events(given).collect()
    assert story["merged_count"] == 3 + 5 and story["sources"] == ["A", "B", "C", "Z"]


def test_what_grows_is_never_broadcast(spark, monkeypatch):
    """Spark takes exploded rows for no larger than the files behind them, and would send them through the driver."""
    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for module in (clustering, events, groups, support):
        monkeypatch.setattr(module, "cut", lambda df: cut(planned(df)))
    planned(registry.event_merge(spark, SF))
    assert len(plans) > 10 and all("Broadcast" not in p for p in plans)
    plans.clear()
    for name in ("contradictions", "story_groups"):
        planned(registry.queries()[name](spark, SF))
    met = [x for p in plans for x in p.splitlines() if "Join" in x and "token#" in x]
    assert met and all("SortMergeJoin" in x for x in met)
