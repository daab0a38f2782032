"""Paid sources, access reasons and audit samples on stated rows and against the loop."""

import random

from pyspark.sql import functions as F

from newsloom.operators import access, selection

ARTICLES = "id long, title string, source string, url string, summary string"


def test_free_only(spark):
    rows = [(1, "a", "Le Monde", "https://x.org/1", "s"), (2, "a", "X", "https://abonnes.lemonde.fr/1", "s"), (3, "a", "X", "https://notlemonde.fr/1", "s"), (4, "a", "X", None, "Article réservé aux abonnés"), (5, "a", "X", "https://x.org/5", "s"), (6, None, None, None, None), (7, "a", "Nice-Matin & cie", "", "")]
    hidden = spark.createDataFrame([(5, 1), (3, 9), (3, 0), (99, 8)], "id long, at int")
    got = {r["id"]: r["reason"] for r in access.free_only(spark.createDataFrame(rows, ARTICLES), hidden).collect()}
    assert got == {1: "subscription-source", 2: "subscription-source", 3: "hidden", 4: "explicit-paywall-marker", 5: "hidden", 6: None, 7: "subscription-source"}
    assert {r["id"] for r in access.newest_hidden(hidden, 2).collect()} == {3, 99}


def test_access_reasons(spark):
    rows = [("Le Monde", "Un texte entier.", "full-text", "article", 5000, 0, None), ("Le Monde", "Un texte…", "full-text", "article", 500, 0, "paid-source-truncated-teaser"), ("Le Monde", "x", "rss", "", 0, 0, "paid-source-without-full-text"), ("Le Monde", "x", None, None, None, None, None), ("X", "x", "rss", "none", 1, 1, None), ("X", "Déjà abonné ? Lisez", "", "", 0, 0, "explicit-paywall-marker")]
    own = spark.createDataFrame([(k, "t", s, "", said, m, how, n, o) for k, (s, said, m, how, n, o, _) in enumerate(rows)], "k int, title string, source string, url string, summary string, material string, method string, content_chars int, source_chars int")
    assert [r["y"] for r in own.select("k", access.access_reason(own).alias("y")).orderBy("k").collect()] == [r[-1] for r in rows]


def test_audit_sample_equals_the_loop(spark):
    for seed, limit in ((1, 100), (2, 9), (3, 25)):
        r = random.Random(seed)
        rows = [(k, r.choice("abcd"), r.choice(["x", "y", None]), r.choice("mn")) for k in range(60)]
        used: list[int] = []
        for d in (1, 2, 3):
            for value in dict.fromkeys(x[d] for x in rows):
                own = next((x[0] for x in rows if x[d] == value and x[0] not in used), None)
                if own is not None and len(used) < limit:
                    used.append(own)
        used += [x[0] for x in rows if x[0] not in used][: limit - len(used)]
        df = spark.createDataFrame(rows, "doc_id long, s string, t string, u string")
        got = selection.audit_sample(df, [F.col(c) for c in "stu"], [F.col("doc_id")], limit).orderBy("pick").collect()
        assert [x["doc_id"] for x in got] == used and [x["pick"] for x in got] == list(range(1, len(used) + 1))
