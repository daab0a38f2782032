"""Story functions on stated titles; memory against the loop, as a table and as a stream that is stopped and started again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions import stories
from newsloom.operators import memory
from newsloom.streaming.memory import refined_stream

SCHEMA = "id bigint, scope string, refresh date, title string, published_at timestamp, tokens array<string>, facts array<string>, actions array<string>, entities array<string>"
_FIRST = dt.date(2024, 1, 1)


def made_articles(n=90, days=6):
    r = random.Random(7)
    words = [f"mot{c}{d}" for c in "abcdef" for d in "xyz"]
    rows = []
    for i in range(n):
        day = i * days // n
        own = r.sample(words, r.randrange(0, 7)) if i % 3 else [*words[i % 5 : i % 5 + 4], r.choice(words[10:])]
        title = " ".join(own)
        at = dt.datetime(2024, 1, 1 + day, r.randrange(24), r.randrange(60))
        rows.append((i, "fr" if i % 4 else "en", _FIRST + dt.timedelta(days=day), title, at, own, r.sample(["12", "40 km", "3 mars"], r.randrange(3)), r.sample(["annonce", "bilan"], r.randrange(3)), r.sample(["Paris", "Lyon", "Nasa"], r.randrange(4))))
    return rows


def looped_best(rows, like, most, days, within=None):
    out, held = {}, {}
    for day in sorted({r[2] for r in rows}):
        batch = sorted(r for r in rows if r[2] == day)
        for i, scope, _, _, at, tokens, *_ in batch:
            best = None
            for old in held.get(scope, []):
                if (day - old[2]).days > days or (within and abs(at - old[4]) > dt.timedelta(days=within)):
                    continue
                common = len(set(tokens) & set(old[5]))
                if len(tokens) < like.least_tokens or common < like.common:
                    continue
                coverage, jaccard = common / min(len(tokens), len(old[5])), common / len({*tokens, *old[5]})
                score = coverage * like.by_coverage + jaccard * like.by_jaccard
                if (coverage >= like.coverage or jaccard >= like.jaccard) and (best is None or score > best[1]):
                    best = old[0], score
            if best:
                out[i] = best[0]
        for r in batch:
            held.setdefault(r[1], []).append(r)
            held[r[1]] = held[r[1]][-most:]
    return out


@pytest.mark.parametrize(("most", "days", "within"), [(320, 10, None), (5, 10, 2), (7, 1, None)])
def test_best_earlier_equals_the_loop(spark, most, days, within):
    rows = made_articles()
    got = memory.best_earlier(spark.createDataFrame(rows, SCHEMA), memory.REFINED, most, days=days, within_days=within).collect()
    want = looped_best(rows, memory.REFINED, most, days, within)
    assert {r["id"]: r["previous_id"] for r in got} == want and len(want) > 5


def test_stream_equals_table(spark, tmp_path):
    """Six refreshes, a micro-batch each; the stream ends after two, and goes on from its checkpoint."""
    rows = made_articles()
    table = spark.createDataFrame(rows, SCHEMA)
    want = {r["id"]: tuple(r[c] for c in ("previous_id", "state", "delta", "reason", "confidence")) for r in memory.refine(table, most=6, days=2).collect()}
    folder = str(tmp_path)

    def run():
        stream = refined_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), most=6, days=2)
        write = lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/out/{k}")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()

    for days in (range(2), range(2, 6)):
        for day in days:
            table.where(F.col("refresh") == F.lit(_FIRST + dt.timedelta(days=day))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run()
    got = {r["id"]: tuple(r[c] for c in ("previous_id", "state", "delta", "reason", "confidence")) for r in spark.read.parquet(f"{folder}/out/*").collect()}
    assert got == want
    assert {v[1] for v in want.values()} == {"new", "development", "minor-update", "repeat"}


def test_what_a_headline_tells(spark):
    rows = [
        (1, "Ukraine : 12 morts et 3,5 % de hausse à Kiev - Le Monde", "Le 3 mars 2024, Emmanuel Macron annonce 40 euros"),
        (2, "La Nasa et Thomas Pesquet observent Mars", None),
        (3, None, ""),
    ]
    own = spark.createDataFrame(rows, "id int, title string, summary string")
    head, said = F.col("title"), F.col("summary")
    got = {r[0]: r[1:] for r in own.select("id", stories.story_tokens(head), stories.facts(head, said), stories.actions(head, said), stories.entities(head)).collect()}
    # a % is no word character, so no word border follows it
    assert got[1] == (["ukraine", "12", "morts", "3", "5", "hausse", "kiev"], ["12", "3 5", "3", "2024", "40 euros", "3 mars 2024"], ["annonce", "bilan"], ["Ukraine", "Kiev"])
    assert got[2][0] == ["nasa", "thomas", "pesquet", "observent", "mars"] and got[2][3] == ["Nasa", "Thomas Pesquet", "Mars"]
    assert got[3] == ([], [], [], [])
    key = own.select(stories.event_key(F.lit("Économie"), stories.story_tokens(head))).first()[0]
    assert key == "economie:12-3-5-hausse-morts-ukraine"


def test_memory_keeps_the_newest_of_each_scope(spark):
    rows = made_articles()
    got = memory.remember(spark.createDataFrame(rows, SCHEMA), most=5, days=3, now=F.lit("2024-01-06").cast("date")).select("scope", "id").collect()
    young = [r for r in rows if (dt.date(2024, 1, 6) - r[2]).days <= 3]
    want = {(s, r[0]) for s in ("fr", "en") for r in sorted((r for r in young if r[1] == s), key=lambda r: (r[2], r[0]))[-5:]}
    assert {tuple(r) for r in got} == want


def test_texts_are_read_once(spark):
    """Memories and verdicts read stored facts: no pattern is looked for again by their uses."""
    from newsloom.plans import registry

    for name in ("story_memory", "story_novelty"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan, name
