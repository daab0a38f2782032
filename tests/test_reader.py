"""What a reader sees: stated cases, with nulls and odd addresses."""

from datetime import datetime

from pyspark.sql import functions as F

from newsloom.functions import text, times, urls
from newsloom.operators import filters, reader


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_titles_lose_their_source(spark):
    cut = lambda title, source: text.display_title(F.lit(title), F.lit(source))
    assert one(spark, cut("Un titre - Le (Monde).fr", "Le (Monde).fr"), cut("Un titre | ÉCHOS", "échos"), cut("Un titre", None), cut(None, "x")) == ["Un titre", "Un titre", "Un titre", ""]
    story = lambda title: text.story_title(F.lit(title), F.lit("x"))
    assert one(spark, story("Un titre - journal.fr"), story("Un titre - Journal du soir")) == ["Un titre", "Un titre - Journal du soir"]


def test_addresses(spark):
    of = lambda u: urls.sorted_canonical(F.lit(u))
    got = one(spark, of("HTTPS://Ex.org/A/?b=2&utm_x=1&a=1&a=0#h"), of("https://ex.org"), of(" no address "), of(None), of("https://ex.org/?fbclid"))
    assert got == ["https://ex.org/A?a=1&a=0&b=2", "https://ex.org/", "no address", "", "https://ex.org/"]
    agrees = lambda u, s: urls.source_agrees(F.lit(u).cast("string"), F.lit(s).cast("string"))
    assert one(spark, agrees("https://www.lemonde.fr/a", "Le Monde"), agrees("https://www.lemonde.fr/a", "Figaro"), agrees(None, "x"), agrees("https://x.fr", None)) == [True, False, False, False]
    assert one(spark, urls.title_key(F.lit("S"), F.lit(" ")), urls.article_key(F.lit(""), F.lit("É"), F.lit("Un T")), urls.aggregator_id(F.lit("https://news.google.com/rss/articles/CB1?x"))) == ["", "text:e|un t", "CB1"]


def test_summaries_images_and_videos(spark):
    null = F.lit(None).cast("string")
    long = "Une phrase assez longue pour être utile à qui la lit ce matin"
    assert one(spark, reader.useful_summary(F.lit(long)), reader.useful_summary(null), reader.visibly_cut(F.lit(long + " …")), reader.visibly_cut(null), reader.cut_short(F.lit(long)), reader.cut_short(null)) == [True, False, True, False, False, True]
    assert one(spark, reader.bad_image(F.lit("https://x.fr/logo.png")), reader.bad_image(F.lit("https://x.fr/blogometer.png")), reader.bad_image(null), reader.generic_image(F.lit("https://a.gstatic.com/x"))) == [True, False, True, True]
    video = lambda title, url: reader.video_only(F.lit(title), F.lit("y" * 300), F.lit(url), null)
    assert one(spark, video("x", "https://m.youtube.com/1"), video("Vidéo : x", "https://x.fr/video/1"), video("Vidéo : x", "https://x.fr/a"), video(None, None)) == [True, True, False, False]


def test_numbers_and_dates(spark):
    of = lambda x: text.bounded(F.lit(x).cast("string"), 5.0, 1.0, 50.0)
    assert one(spark, of("7"), of("x"), of(None), of("NaN"), of("Infinity"), of(""), of("99")) == [7, 5, 5, 5, 5, 1, 50]
    now = datetime(2024, 3, 10, 12, 0)
    label = lambda *at: times.time_label(F.lit(datetime(*at)), F.lit(now))
    assert one(spark, label(2024, 3, 10, 11, 59, 45), label(2024, 3, 10, 11, 1), label(2024, 3, 10, 2, 30), label(2024, 3, 9, 9, 5), label(2024, 2, 1, 9, 5)) == ["À l’instant", "Il y a 59 min", "Il y a 9 h", "Hier, 09:05", "1 févr."]


def test_short_watch_words_are_whole_words(spark):
    rule = lambda hay: filters.watch_rule(F.lit(hay), "IA + vélo | Séisme", "sport")
    assert one(spark, rule("une ia et un velo"), rule("une piano et un velo"), rule("seismes"), rule("seisme et sports"), rule("")) == [True, False, True, False, False]
