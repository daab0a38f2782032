"""Queries of structured data and images in pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import extract
from newsloom.plans.adapters import read, sql_decoded, sql_stripped
from newsloom.plans.registry import query

#: Scripts of JSON-LD that the tables' pages lack, made of their addresses and first paragraphs, as expressions that Spark and DuckDB read alike.
_SAID = "substring(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<p[^>]*>(.*?)</p>', 1), '[^A-Za-z0-9 .,]', ' '{g}), ' +', ' '{g}), 1, 900)"
_FORMS = (
    "concat('{\"@graph\": [{\"@type\": [\"NewsArticle\", \"Thing\"], \"articleBody\": \"<b>', {said}, '</b>\", \"image\": [\"https://a.example/', page_id, '.jpg\", {\"url\": \"https://b.example/1.png\"}, 7]}, {\"text\": \"court\", \"description\": \"Chapeau ', page_id, '\"}]}')",
    "concat('[{\"a\": {\"b\": [{\"c\": {\"@type\": \"ReportageNewsArticle\", \"articleBody\": \"', {said}, ' &eacute;\", \"Thumbnailurl\": \"https://c.example/t\", \"image\": {\"contentUrl\": \"https://d.example/c\", \"url\": 3}}}]}}, {\"@type\": \"Organization\", \"articleBody\": \"non', page_id, '\"}]')",
    "concat('{\"articleBody\": \"sans type ', page_id, '\", \"description\": \"', {said}, '\", \"image\": \"https://e.example/', page_id, '\", \"x\": null}')",
    "'{\"articleBody\": broken'",
)
_TAG = "<script type=\"application/ld+json\">"
_HTML = "CASE page_id % 5 " + " ".join(f"WHEN {i} THEN concat(html, '{_TAG}', {f}, '</script>')" for i, f in enumerate(_FORMS)) + f" ELSE concat('<p>', html, '{_TAG}', {_FORMS[2]}, '</script> {_TAG}', {_FORMS[0]}, '</script>') END"
_SPARK_HTML = _HTML.replace("{said}", _SAID.replace("{g}", ""))
_SQL_PAGES = "marked AS (SELECT page_id, " + _HTML.replace("{said}", _SAID.replace("{g}", ", 'g'")) + " AS html FROM pages)"
_SCRIPT = extract.LD_SCRIPT.replace("'", "''")
_TREE = rf"""WITH {_SQL_PAGES},
    scripts AS (SELECT page_id, unnest(regexp_extract_all(html, '{_SCRIPT}', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '{_SCRIPT}', 1), 1) - 1 AS script FROM marked),
    nodes AS (SELECT s.page_id, s.script, t.key, t.value, t.type, t.id, t.parent FROM (SELECT * FROM scripts WHERE json_valid(raw)) s, json_tree(s.raw) t)"""


def _pages(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.expr(_SPARK_HTML).alias("html"))


_FIELD = lambda name: f"CASE WHEN json_type(value, '$.{name}') = 'VARCHAR' THEN json_extract_string(value, '$.{name}') ELSE '' END"


@query(
    _TREE
    + f""", o AS (SELECT page_id, {_FIELD("articleBody")} AS a, {_FIELD("text")} AS b, {_FIELD("description")} AS d FROM nodes WHERE type = 'OBJECT'),
    t AS (SELECT page_id, CASE WHEN a <> '' THEN a ELSE b END AS body, d FROM o), c AS (SELECT page_id, {sql_stripped("body")} AS body, {sql_stripped("d")} AS d FROM t),
    m AS (SELECT page_id, arg_max(body, (length(body), body)) AS body, arg_max(d, (length(d), d)) AS d FROM c GROUP BY page_id)
    SELECT p.page_id, substring(coalesce(body, ''), 1, {extract.LD_BODY}) AS body, substring(coalesce(d, ''), 1, {extract.LD_DESCRIPTION}) AS description FROM pages p LEFT JOIN m ON m.page_id = p.page_id""",
    articles_view=False,
)
def json_ld(spark, sf):
    """The longest body and description of all objects of a page's scripts, at any depth."""
    return extract.json_ld(_pages(spark, sf))


@query(
    _TREE
    + r""", b AS (SELECT page_id, script, trim(regexp_replace(CASE WHEN json_type(value, '$.articleBody') = 'VARCHAR' THEN json_extract_string(value, '$.articleBody') ELSE '' END, '\s+', ' ', 'g')) AS body,
        CASE WHEN json_type(value, '$."@type"') = 'ARRAY' THEN array_to_string(json_extract_string(value, '$."@type"[*]'), ' ') ELSE json_extract_string(value, '$."@type"') END AS kind FROM nodes WHERE type = 'OBJECT')
    SELECT page_id, CAST(script AS INTEGER) AS script, sha256(body) AS body_sha256 FROM b WHERE body <> '' AND regexp_matches(coalesce(nullif(kind, ''), 'Article'), '(?i)Article')""",
    articles_view=False,
)
def article_bodies(spark, sf):
    found = extract.article_bodies(extract.json_nodes(_pages(spark, sf)))
    return found.select("page_id", "script", F.sha2("body", 256).alias("body_sha256"))


@query(
    _TREE
    + """, k AS (SELECT n.page_id, n.script, n.id, n.type, n.parent, n.value, lower(n.key) AS key, p.type AS above, lower(p.key) AS parent_key FROM nodes n LEFT JOIN nodes p ON p.page_id = n.page_id AND p.script = n.script AND p.id = n.parent)
    SELECT DISTINCT page_id, json_extract_string(value, '$') AS url FROM k WHERE type = 'VARCHAR' AND (above = 'OBJECT' AND key IN ('image', 'thumbnailurl', 'contenturl') OR above = 'ARRAY' AND parent_key IN ('image', 'thumbnailurl', 'contenturl'))
    UNION SELECT k.page_id, json_extract_string(k.value, '$') FROM k JOIN k o ON o.page_id = k.page_id AND o.script = k.script AND o.id = k.parent WHERE k.type = 'VARCHAR' AND k.key IN ('url', 'contenturl') AND o.above = 'OBJECT' AND o.key IN ('image', 'thumbnailurl', 'contenturl')""",
    articles_view=False,
)
def json_images(spark, sf):
    return extract.json_images(extract.json_nodes(_pages(spark, sf)))


#: Result pages: a page's paragraphs are results, with attachments of several sizes between them.
_RESULT = r'<div><img srcset="/api/attachments/a\1-w200-h112-p-df 1x, /api/attachments/b-w400-h224-p-df-rw 2x"></div><a class="x JtKRv y" href="./read/1">\1</a><img src=''/api/attachments/c&amp;d-w100-h100-p-df''>'
_SPARK_RESULT = _RESULT.replace(r"\1", "$1").replace("''", "'")
_PARAGRAPH = r"(?is)<p[^>]*>([^<]{1,60})[^<]*</p>"
_BASE = "https://news.example.org"


def _result_pages(spark, sf):
    own = read(spark, sf, "pages").select("page_id", F.regexp_replace("html", _PARAGRAPH, _SPARK_RESULT).alias("html"))
    return own.withColumn("html", F.when(F.col("page_id") % 4 == 0, F.replace("html", F.lit("w400-h224"), F.lit("w300-h168"))).otherwise(F.col("html")))


_R = extract.RESULT_TITLE.replace("'", "''").replace("{1,2200}?", "+?")  # DuckDB's patterns repeat 1,000 times at most; titles here are shorter
_A = extract.ATTACHMENT.replace("'", "''")


@query(
    rf"""WITH made AS (SELECT page_id, regexp_replace(html, '{_PARAGRAPH}', '{_RESULT}', 'g') AS html FROM pages),
    own AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN replace(html, 'w400-h224', 'w300-h168') ELSE html END AS html FROM made),
    matches AS (SELECT page_id, html, regexp_split_to_array(html, '{_R}') AS parts, regexp_extract_all(html, '{_R}', 0) AS wholes, regexp_extract_all(html, '{_R}', 1) AS found FROM own),
    each AS (SELECT page_id, html, unnest(range(len(wholes))) AS i, parts, wholes, found FROM matches),
    placed AS (SELECT page_id, html, i, found[i + 1] AS found, list_sum(list_transform(parts[1:i + 1], lambda p: length(p))) + coalesce(list_sum(list_transform(wholes[1:i], lambda w: length(w))), 0) AS start FROM each),
    near AS (SELECT *, lag(start) OVER w AS last, lead(start) OVER w AS next FROM placed WINDOW w AS (PARTITION BY page_id ORDER BY i)),
    cut AS (SELECT page_id, i, {sql_stripped("found")} AS title, CAST(coalesce(floor((last + start) / 2), greatest(0, start - {extract.RESULT_REACH})) AS BIGINT) AS low, CAST(coalesce(floor((start + next) / 2), start + {extract.RESULT_REACH}) AS BIGINT) AS high, html FROM near),
    links AS (SELECT page_id, i, title, list_transform(regexp_extract_all(substring(html, low + 1, high - low), '{_A}'), lambda x: {sql_decoded("x")}) AS l FROM cut WHERE title <> '')
    SELECT page_id, CAST(i AS INTEGER) AS i, title, '{_BASE}' || regexp_replace(coalesce(list_filter(l, lambda x: regexp_matches(x, '(?i)-w400-h224-'))[1], l[-1]), '(?i)-w\d+-h\d+-p-df(?:-rw)?$', '-w400-h224-p-df') AS url FROM links WHERE len(l) > 0""",
    articles_view=False,
)
def result_visuals(spark, sf):
    """Each result's image by its position in the page: between the midpoints to the results before and after it."""
    return extract.result_visuals(_result_pages(spark, sf), _BASE)
