"""Digests, diversified order, image heads and the directory on stated rows and against loops."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from newsloom.operators import digest, directory, diversity, extract
from newsloom.sources import images


@pytest.mark.parametrize("seed", range(2))
def test_diversified_order_equals_the_loop(spark, seed):
    r = random.Random(seed)
    rows = [(k, r.choice(["a", "b", None]), r.choice("xyz"), r.choice("stu"), r.random() < 0.1, float(r.randrange(0, 100, 7))) for k in range(200)]
    want = {}
    for g in ("a", "b", None):
        pool, shown = [x for x in rows if x[1] == g], []
        while pool:
            values = []
            for k, x in enumerate(pool[:5]):
                if k and pool[0][5] - x[5] > 28:
                    continue
                v = -7 * k - 18 * (bool(shown) and x[2] == shown[-1][2]) - 7 * (len(shown) > 1 and x[2] == shown[-2][2]) - 11 * (bool(shown) and x[3] == shown[-1][3]) + 4 * x[4]
                values.append((v, -k))
            shown.append(pool.pop(-max(values)[1]))
        want |= {x[0]: (g, p) for p, x in enumerate(shown, 1)}
    own = spark.createDataFrame(rows, "doc_id long, g string, category string, source string, essential boolean, importance double")
    got = {x["doc_id"]: (x["g"], x["place"]) for x in diversity.diversified(own, "g", [F.col("doc_id")]).collect()}
    assert got == want


def test_digest(spark):
    body = "Connectez vous pour lire la suite de cet article réservé. Le gouvernement annonce une hausse des pensions de 3 millions de retraités dès janvier prochain. Le gouvernement annonce une hausse des pensions de 3 millions de retraités dès janvier. Les syndicats contestent cette décision devant le Conseil constitutionnel depuis plusieurs semaines. Il pleut. La Bourse de Paris recule pourtant après cette décision inattendue du ministre concerné."
    rows = [(1, "Hausse des pensions", body), (2, "x", "Trop court."), (3, "x", "mot " * 120), (4, None, None)]
    got = {r["doc_id"]: r["digest"] for r in digest.digests(spark.createDataFrame(rows, "doc_id long, title string, summary string")).collect()}
    parts = got[1].split(". ")
    assert parts[0].startswith("Le gouvernement annonce") and len(parts) == 3 and got[1].count("gouvernement") == 1 and "Connectez" not in got[1]
    assert (got[2], got[3], got[4]) == ("Trop court.", "", "")


def test_image_heads(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 360)
    segment = lambda marker, data: b"\xff" + bytes([marker]) + struct.pack(">H", len(data) + 2) + data
    jpeg = b"\xff\xd8" + segment(0xE0, b"x" * 40) + segment(0xC4, b"y" * 9) + segment(0xC2, b"\x08" + struct.pack(">HH", 200, 210) + b"z" * 9)
    cases = {"a.png": png + b"0" * 4000, "b.jpg": jpeg + b"0" * 4000, "deep/c.jpeg": jpeg[:20], "d.webp": b"RIFF" + b"0" * 5000, "e.gif": b"GIF" + b"0" * 5000, "f.png": b"\x89PNG", "g.jpg": b"\xff\xd8\xff\xe0\x00\x00" + b"0" * 4000}
    for name, data in cases.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"], r["useful"]) for r in images.read_images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (640, 360, True), "b.jpg": (210, 200, False), "c.jpeg": (0, 0, False), "d.webp": (0, 0, True), "e.gif": (0, 0, False), "f.png": (0, 0, False), "g.jpg": (0, 0, True)}


def test_directory_sorts_as_the_language_does(spark):
    articles = spark.createDataFrame([(1, "Été", "https://www.Ete.fr/a", "", ""), (2, "ete", "https://b.fr/1", "f", "T"), (3, "Zèbre", None, None, None), (4, "", "https://c.fr", "g", "Par flux"), (5, "", "x", "", "")], "ord int, source string, url string, feed_url string, feed_title string")
    added = spark.createDataFrame([(1, "Écran", "ecran.fr/rss", ""), (2, "", "WWW.Autre.org/x", None), (3, "zebre", "z.fr", "https://www.z.fr/")], "ord int, title string, url string, html_url string")
    got = sorted(directory.source_directory(articles, added).collect(), key=lambda r: r["place"])
    assert [r["name"] for r in got] == ["autre.org", "Écran", "Été", "Par flux", "Zèbre"]
    assert got[2]["count"] == 2 and got[2]["domains"] == ["b.fr", "ete.fr"] and got[2]["feeds"] == {"f": "T"} and got[4]["feeds"] == {"z.fr": "zebre"}


def test_json_of_any_depth(spark):
    deep = '{"a":' * 8 + '{"articleBody": "au fond", "image": ["u", 1, {"url": "no"}]}' + "}" * 8
    too_deep = '{"a":' * 9 + '{"articleBody": "plus bas"}' + "}" * 9
    script = lambda x: f'<script type="application/ld+json">{x}</script>'
    pages = spark.createDataFrame([(1, script(deep) + script("oops") + script(too_deep)), (2, script('[{"@type": ["Thing"], "articleBody": "non"}, {"@type": "", "articleBody": " oui "}, [{"contentUrl": "c", "image": {"url": "d", "contentUrl": 4}}]]')), (3, None)], "page_id long, html string")
    nodes = extract.json_nodes(pages)
    assert {(r["page_id"], r["script"], r["body"]) for r in extract.article_bodies(nodes).collect()} == {(1, 0, "au fond"), (2, 0, "oui")}
    assert {(r["page_id"], r["url"]) for r in extract.json_images(nodes).collect()} == {(2, "c"), (2, "d")}


def test_sentences_are_worked_out_once(spark):
    """Rounds read stored sentences: none of them cuts up or scores texts again."""
    rows = spark.createDataFrame([(1, "Un titre", "Une phrase assez longue pour compter ici. Une autre phrase tout aussi longue que la première.")], "doc_id long, title string, summary string")
    plan = digest.digests(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "posexplode(regexp" not in plan
