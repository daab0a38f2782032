"""Functions, feed parsing and streams."""

import tempfile

from pyspark.sql import functions as F

from newsloom.functions import text, urls
from newsloom.operators import extract, filters, selection
from newsloom.sources import feeds
from newsloom.streaming import state

RSS = """<rss><channel>
<item><title><![CDATA[Crue &amp; vent]]></title><link>https://a.example/x?utm_source=b&amp;id=1</link><description>&lt;b&gt;Gras&lt;/b&gt; texte</description><pubDate>Tue, 30 Jan 2024 10:00:00 GMT</pubDate><source>Journal</source></item>
<item><title>Sans lien</title><guid>https://a.example/y</guid><pubDate>hier</pubDate></item>
<item><title></title><link>https://a.example/z</link></item></channel></rss>"""
ATOM = """<feed><entry><title>Un titre</title><link rel="alternate" href="https://b.example/1"/><published>2024-01-29T08:00:00Z</published><summary>Court</summary><author>Ana</author></entry></feed>"""
OPML = """<opml><body><outline text="Dossier"><outline text="A" title="Titre A" xmlUrl="https://a.example/rss"/><outline text="B" xmlUrl="https://b.example/rss?x=1&amp;y=2"/></outline></body></opml>"""


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("y")).first()["y"]


def test_text(spark):
    x = F.col("x")
    assert one(spark, text.normalise(x), "  L’Été à  Œ-vre, 100% ") == "l ete a vre 100"
    assert one(spark, text.strip_html(x), "&lt;b&gt;a&lt;/b&gt; <script>no</script><p>b&nbsp;c</p>") == "a b c"
    assert one(spark, text.strip_publisher(x), "Un titre - Le Journal") == "Un titre"
    assert one(spark, text.tokens(x, 4, ("avec",), 2), "Avec crue crue vent pluie") == ["crue", "vent"]
    assert one(spark, text.sentences(x), "Un. Deux! Trois") == ["Un.", "Deux!", "Trois"]
    assert one(spark, text.numeric_claims(x), "12 morts, 3,5 % et 7") == ["12 morts", "3,5", "7"]  # no word border after %
    assert one(spark, F.regexp_like(x, F.lit(text.js_regex(r"\bélection\b"))), "une élection") is False
    assert one(spark, text.normalise(x), None) == ""


def test_urls(spark):
    x = F.col("x")
    assert one(spark, urls.canonical(x), "https://a.example/p/?b=2&utm_source=z&a=1#top") == "https://a.example/p?b=2&a=1"
    assert one(spark, urls.host(x), "https://WWW.A.example:80/p") == "a.example"
    assert [one(spark, urls.private_address(x), ip) for ip in ("10.1.1.1", "172.20.0.1", "192.168.1.1", "8.8.8.8")] == [True, True, True, False]


def test_feeds(spark):
    docs = spark.createDataFrame([("r", RSS), ("a", ATOM), ("none", "<rss/>")], "path string, xml string")
    rows = {r["title"]: r for r in feeds.parse_feeds(docs).collect()}
    assert rows.keys() == {"Crue & vent", "Sans lien", "Un titre"}
    first = rows["Crue & vent"]
    assert (first["summary"], first["source"], str(first["published_at"])) == ("Gras texte", "Journal", "2024-01-30 10:00:00")
    assert first["url"] == "https://a.example/x?utm_source=b&id=1"
    assert rows["Sans lien"]["url"] == "https://a.example/y" and rows["Sans lien"]["published_at"] is None
    assert rows["Un titre"]["url"] == "https://b.example/1"
    found = feeds.parse_opml(spark.createDataFrame([("o", OPML)], "path string, xml string")).collect()
    assert [(r["title"], r["url"]) for r in found] == [("Titre A", "https://a.example/rss"), ("B", "https://b.example/rss?x=1&y=2")]


def test_watch_rules(spark):
    for rule, exclude, hit in (("crue + vent", "", True), ("crue + neige | vent", "", True), ("crue", "vent", False), ("", "", False), ("neige", "", False)):
        assert one(spark, filters.watch_rule(F.col("x"), rule, exclude), "la crue et le vent") is hit


def test_meta(spark):
    assert one(spark, extract.meta_content(F.col("x"), "og:title"), '<meta content="T" property="og:title">') == "T"
    assert one(spark, extract.meta_content(F.col("x"), "og:title"), '<meta property="og:title" content="U">') == "U"


def test_selection_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, day string, source string, custom_source boolean, score double")
    order = [F.desc("score"), F.col("doc_id")]
    assert selection.top_and_daily(empty, "day", order).count() == selection.round_robin(empty, "source", order, 5).count() == selection.flood_cap(empty, order).count() == 0


def test_stream_and_batch_windows_agree(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = tempfile.mkdtemp(prefix="spark-stream-")
    events.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    run = state.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda df: sorted((r["window_start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("windows")) == key(state.windowed_counts(events))


def test_candidates_are_not_shuffled(spark):
    """A pair of sets is judged where it meets: nothing is made distinct afterwards, and each pair is given once."""
    from newsloom.operators import clustering

    sets = {k: {f"w{x}" for x in (k % 7, k % 5 + 7, k % 3 + 12, k + 20, 99)[: k % 4 + 2]} for k in range(120)}
    frame = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, tokens array<string>")
    got = clustering.similar_sets(frame, 60)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 60 * min(len(sets[a]), len(sets[b])))
    assert sorted(map(tuple, got.collect())) == want
