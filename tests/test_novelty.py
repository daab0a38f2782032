"""Novelty rules on stated pairs, and deltas."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.operators import novelty

NOON = datetime(2026, 8, 30, 12)
KIND = "title string, published_at timestamp, facts array<string>, actions array<string>, entities array<string>"
BEFORE = ("Crue dans le Gard", NOON, ["3 morts"], ["évacue"], ["Gard"])
#: title, minutes later (None: no date), facts, actions, entities, state, delta
CASES = [
    ("Crue dans le Gard : ce que l’on sait", 300, ["9 morts"], ["évacue"], ["Gard"], "repeat", -24),
    ("Crue : enquête ouverte", 10, None, None, None, "development", 16),
    ("Crue : enquête ouverte", -10, None, None, None, "repeat", -16),
    ("Crue : enquête ouverte", None, None, None, None, "development", 16),
    ("Crue dans le Gard", 60, ["5 morts"], ["évacue"], ["Gard"], "development", 18),
    ("Crue dans le Gard", 90, ["3 morts"], ["ferme"], ["Gard"], "development", 14),
    ("Crue dans le Gard", 90, ["3 morts"], ["annonce"], ["Gard"], "repeat", -16),
    ("Crue dans le Gard", 59, ["5 morts"], [], [], "minor-update", 5),
    ("Crue dans le Gard", 120, ["3 Morts"], [], ["Hérault", "Lozère"], "minor-update", 5),
    ("Crue dans le Gard", 5, ["5 morts"], [], [], "repeat", -20),
    (None, None, None, None, None, "repeat", -16),
]


def test_novelty(spark):
    rows = [(i, BEFORE, (t, NOON + timedelta(minutes=m) if m is not None else None, f, a, e)) for i, (t, m, f, a, e, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, f"id long, previous struct<{KIND}>, current struct<{KIND}>".replace("string,", "string,"))
    got = {r["id"]: (r["state"], r["delta"]) for r in novelty.novelty(df).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[-2:] for c in CASES]


def test_delta_and_change(spark):
    old = "La rivière monte encore dans la vallée ce matin."
    new = "La rivière monte encore dans la vallée ce matin. Plusieurs villages seront évacués avant la nuit par les pompiers."
    one = lambda x: spark.range(1).select(x.alias("y")).first()["y"]
    assert one(novelty.sentence_delta(F.lit(new), F.lit(old))) == "Plusieurs villages seront évacués avant la nuit par les pompiers."
    assert one(novelty.sentence_delta(F.lit(old), F.lit(old))) == "" and one(novelty.sentence_delta(F.lit(None).cast("string"), F.lit(old))) == ""
    words = lambda s: F.split(F.lit(s), " ")
    assert one(novelty.meaningful_change(words("a b c d"), words("a b x y"), F.lit("repeat"))) is True
    assert one(novelty.meaningful_change(words("a b"), words("b a"), F.lit("development"))) is False
    assert one(novelty.revision(words("a b"), words("a b"), words("3"), words("4"))) == "correction"
    assert one(novelty.revision(words("a b"), words("c d"), words("3"), words("3"))) == "updated"


def test_retention(spark):
    rows = [(i, f"s{i % 3}", NOON - timedelta(days=i)) for i in range(30)]
    kept = novelty.retain(spark.createDataFrame(rows, "id long, story string, at timestamp"), "story", "at", F.lit(NOON), days=14, stories=2, each=3)
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 3, 4, 6, 7]
