"""Signals of headlines and greedy choices against their sequential forms."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import extract, greedy, selection, significance

#: title, signal, reasons
HEADLINES = [
    ("Séisme au Japon : au moins 12 morts et 30 blessés", 38, ["bilan humain", "événement majeur", "faits chiffrés"]),
    ("Le Parlement adopte la réforme des retraites ce mardi", 10, ["décision publique"]),
    ("Comparatif : les meilleures enceintes pour la maison", -16, ["contenu pratique/achat"]),
    ("Tennis : Sinner réagit après un match très disputé", -29, ["réaction", "sport léger"]),
    ("Guerre commerciale : ce que prépare la filière du vin ?", -4, []),
    ("La guerre reprend dans la région frontalière du nord", 15, ["événement majeur"]),
    ("Piratage : fuite de données de 3 millions de clients", 13, ["cybersécurité"]),
    ("Vigilance orange dans huit départements du sud-est", 6, ["utilité publique"]),
    ("Le CAC 40 chute après les attaques de drones en mer", 0, []),
    ("Ces 5 astuces pour bien dormir pendant la canicule", -16, ["contenu pratique/achat"]),
    ("-- ", -34, ["titre pauvre"]),
    (None, -34, ["titre pauvre"]),
]


def test_signals(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(HEADLINES)], "doc_id long, title string")
    got = {r["doc_id"]: (r["signal"], r["reasons"]) for r in significance.with_signal(rows).collect()}
    assert [got[i] for i in range(len(HEADLINES))] == [(s, r) for _, s, r in HEADLINES]


@pytest.mark.parametrize("backfill", [0, 4])
def test_picks_are_the_sequential_form(spark, backfill):
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice(["s", "t", None]), rng.randint(0, 9), rng.randint(0, 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, day string, source string, score long, story long")
    want = {}
    for day in ("x", "y", None):
        own, picked = sorted((r for r in rows if r[1] == day), key=lambda r: (-r[3], r[0])), []
        for r in own:
            if len(picked) < 4 and sum(p[2] == r[2] for p in picked) < 2 and not any(p[4] == r[4] for p in picked):
                picked.append(r)
        picked += [r for r in own if r not in picked][: max(0, backfill - len(picked))]
        want |= {r[0]: k for k, r in enumerate(picked, 1)}
    got = greedy.pick(df, "day", [-F.col("score"), F.col("doc_id")], 4, caps={"source": 2}, conflict=lambda a, b: a["story"] == b["story"], backfill_to=backfill)
    assert {r["doc_id"]: r["pick"] for r in got.collect()} == want
    assert greedy.pick(df.limit(0), "day", [F.col("doc_id")], 2).count() == 0


def test_first_seen_is_the_sequential_form(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["", None, *"abcdefgh"]), rng.choice(["", None, *"pqrstuvw"])) for i in range(60)]
    urls, titles, want = set(), set(), []
    for i, u, t in sorted(rows, reverse=True):
        if (u and u in urls) or (t and t in titles):
            continue
        urls.add(u), titles.add(t), want.append(i)
    got = greedy.first_seen(spark.createDataFrame(rows, "doc_id long, url string, title string"), ["url", "title"], -F.col("doc_id"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)


def test_history_is_the_sequential_form(spark):
    rng, start = random.Random(7), datetime(2024, 1, 1)
    rows = [(i, rng.choice(["", None, *"abcdefghijklmnop"]), rng.choice(["", None, "x", "y", "z"]), rng.choice([None, *[start + timedelta(hours=h) for h in range(0, 400, 7)]])) for i in range(60)]
    urls, titles, want = set(), {}, []
    for i, u, t, at in rows:
        if (u and u in urls) or (t and at and t in titles and abs(at - titles[t]) <= timedelta(hours=48)):
            continue
        want.append(i)
        if u:
            urls.add(u)
        if t and at:
            titles[t] = at
    df = spark.createDataFrame(rows, "doc_id long, url_key string, title_key string, published_at timestamp")
    assert sorted(r["doc_id"] for r in greedy.merge_history(df, F.col("doc_id")).collect()) == want


def test_json_ld(spark):
    script = '<script type="application/ld+json">{}</script>'
    html = script.format('{"@graph": [{"@type": "NewsArticle", "articleBody": "<b>Le  corps</b> long", "x": {"text": "court"}}, {"description": "Une phrase"}]}') + script.format("{broken")
    got = {r["page_id"]: (r["body"], r["description"]) for r in extract.json_ld(spark.createDataFrame([(1, html), (2, "<p>x</p>"), (3, None)], "page_id long, html string")).collect()}
    assert got == {1: ("Le corps long", "Une phrase"), 2: ("", ""), 3: ("", "")}


def test_day_order_loses_nothing(spark):
    rng, start = random.Random(8), datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=rng.choice([rng.randint(0, 23), rng.randint(24, 47), rng.randint(72, 95), rng.randint(96, 119)]))) for i in range(150)]
    days = {}
    for i, at in sorted(rows, key=lambda r: (-r[1].timestamp(), r[0])):
        days.setdefault(str(at.date()), []).append(i)
    first, rest = [], []
    for k, own in enumerate(days.values()):
        quota = 24 if k == 0 else 16 if k == 1 else 8
        first += own[:quota]
        rest += own[quota:]
    df = spark.createDataFrame(rows, "doc_id long, published_at timestamp").withColumn("day", F.date_format("published_at", "yyyy-MM-dd"))
    got = selection.day_order(df, "day", [F.desc("published_at"), F.col("doc_id")]).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["overflow"], r["day_rank"], r["rank"]))] == first + rest
    assert sum(not r["overflow"] for r in got) == len(first) and len(got) == len(rows)


def test_round_robin_of_all_rows(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["x", "x", "x", "y", "z", None]), rng.randint(0, 40)) for i in range(200)]
    queue, want = {}, []
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        queue.setdefault(r[1], []).append(r[0])
    waiting = list(queue.values())
    while waiting:
        own = waiting.pop(0)
        want.append(own.pop(0))
        if own:
            waiting.append(own)
    df = spark.createDataFrame(rows, "doc_id long, source string, at long")
    got = selection.round_robin(df, "source", [F.desc("at"), F.col("doc_id")]).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["turn"], r["place"]))] == want
    assert selection.round_robin(df.limit(0), "source", [F.col("doc_id")]).count() == 0
