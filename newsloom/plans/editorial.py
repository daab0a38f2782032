"""Queries of editorial values and page regions, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import editorial, reader
from newsloom.plans.adapters import read, teasers
from newsloom.plans.reader import _clean, _is
from newsloom.plans.registry import _norm, query

#: What the tables lack, as expressions that Spark and DuckDB read alike.
_MADE = {
    "title": "CASE doc_id % 5 WHEN 0 THEN concat('Le ministre réagit : ', title) WHEN 1 THEN concat(title, ' ?') WHEN 2 THEN concat('Le Sénat adopte 3 textes et 12,5 % de hausse. ', title) ELSE title END",
    "score": "doc_id % 100",
    "sources": "doc_id % 6",
    "essential": "doc_id % 17 = 0",
    "importance": "doc_id * 7 % 97",
    "novelty": "CASE doc_id % 7 WHEN 0 THEN 'development' WHEN 1 THEN 'new' WHEN 2 THEN 'minor-update' WHEN 3 THEN 'repeat' ELSE '' END",
    "support": "CASE doc_id % 3 WHEN 0 THEN 'weak' ELSE 'strong' END",
}
_OTHER = "CASE doc_id * 3 % 11 WHEN 0 THEN 'Europe' WHEN 1 THEN 'IA' WHEN 2 THEN '' WHEN 3 THEN 'Énergie' WHEN 4 THEN 'Santé' WHEN 5 THEN 'Politique' WHEN 6 THEN 'VR' WHEN 7 THEN 'Environnement' WHEN 8 THEN 'Culture' WHEN 9 THEN 'Automobile' ELSE category_hint END"
_HTML = """CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN replace(replace(html, '<article', '<main'), '</article>', '</main>')
    WHEN 2 THEN concat('<article>short</article>', replace(html, '</p>', '</p><aside>see <b>also</b></aside><div class="share-box">send</div><script>var x = 1</script>'))
    WHEN 3 THEN replace(replace(html, '<article', '<div'), '</article>', '</div><form>mail<nav>on</nav></form>') ELSE concat(html, '<article> </article>') END"""
_MARKED = """CASE page_id % 6 WHEN 0 THEN concat(html, '<p>Abonnez-vous pour lire</p>') WHEN 1 THEN concat('<div class="box paywall top">', html) WHEN 2 THEN concat(html, 'Cet article est réservé aux abonnés') WHEN 3 THEN concat(html, '<i data-paywall="1">') ELSE html END"""
_ADDRESS = "CASE page_id % 7 WHEN 0 THEN concat(url, '/login?next=1') ELSE url END"


def _valued(spark, sf):
    own = teasers(spark, sf)
    return editorial.information(own.withColumns({name: F.expr(x) for name, x in _MADE.items()}))


_INFORMATION = f"""WITH m AS (SELECT doc_id, category_hint, summary, {", ".join(f"{x} AS {name}" for name, x in _MADE.items())} FROM teasers),
    c AS (SELECT *, {_clean("title")} AS t, {_clean("summary")} AS s FROM m),
    f AS (SELECT *, len(list_distinct(list_filter(list_transform(regexp_extract_all(concat(t, ' ', s), '(?i){editorial.NUMBERS}'), lambda n: {_norm("n")}), lambda n: n <> ''))) AS numbers,
        {_is("concat(t, ' ', s)", editorial.ACTION)} AS acts, {_is("concat(t, ' ', s)", editorial.REACTION)} AS reacts FROM c),
    v AS (SELECT *, 42 + CASE WHEN essential THEN 26 WHEN importance >= 80 THEN 10 ELSE 0 END
        + CASE novelty WHEN 'development' THEN 15 WHEN 'new' THEN 8 WHEN 'minor-update' THEN 3 WHEN 'repeat' THEN -18 ELSE 0 END
        + CASE WHEN sources >= 2 THEN least(12, 4 + (sources - 2) * 2) ELSE 0 END
        + CASE WHEN length(s) >= 180 THEN 8 WHEN length(s) >= 90 THEN 4 WHEN length(s) < 55 THEN -8 ELSE 0 END
        + least(12, numbers * 3) + CASE WHEN acts THEN 9 ELSE 0 END - CASE WHEN support = 'weak' THEN 8 ELSE 0 END - CASE WHEN t LIKE '%?' THEN 4 ELSE 0 END
        - CASE WHEN NOT reacts THEN 0 WHEN numbers > 0 OR acts THEN 12 ELSE 24 END AS raw FROM f),
    i AS (SELECT *, CAST(greatest(0, least(100, CASE WHEN reacts AND numbers = 0 AND NOT acts THEN least(raw, 34) WHEN NOT reacts AND sources >= 2 AND numbers > 0 AND acts THEN greatest(raw, 68) ELSE raw END)) AS INTEGER) AS information FROM v),
    r AS (SELECT *, information < 38 AS low_information, score + CASE WHEN essential OR importance >= 90 OR score >= 94 THEN 0 WHEN information < 28 THEN -22 WHEN information < 42 THEN -10 WHEN information >= 82 THEN 6 ELSE 0 END AS informed_score FROM i)"""


@query(f"{_INFORMATION} SELECT doc_id, information, low_information, informed_score FROM r")
def information_values(spark, sf):
    """With sources, novelty, support, importance and scores made of the ids, and titles that react, ask and tell of acts."""
    return _valued(spark, sf).select("doc_id", "information", "low_information", "informed_score")


@query(
    f"""{_INFORMATION} SELECT CAST(floor(avg(information) + 0.5) AS BIGINT) AS average_information, count(*) FILTER (low_information) AS low,
        (SELECT count(DISTINCT category_hint) FROM (SELECT category_hint FROM r ORDER BY informed_score DESC, doc_id LIMIT 8)) AS first_categories FROM r"""
)
def information_summary(spark, sf):
    """Mean information, low rows, and the categories of the first eight rows (the report's own limit)."""
    own = _valued(spark, sf).select("doc_id", "category_hint", "information", "low_information", "informed_score")
    first = own.orderBy(F.desc("informed_score"), "doc_id").limit(8).agg(F.count_distinct("category_hint").alias("first_categories"))
    told = own.agg(F.floor(F.avg("information") + 0.5).alias("average_information"), F.count_if("low_information").alias("low"))
    return told.withColumn("first_categories", first.scalar())


_FAMILY = " OR ".join("category_hint IN ({0}) AND other IN ({0})".format(", ".join(map(repr, f))) for f in editorial.FAMILIES)
_TOLD = _norm("concat_ws(' ', title, summary)")
_POINTS_HOST = "regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/:?#]+)', 1)), '^www\\.', '')"


@query(
    f"""WITH t AS (SELECT *, {_OTHER} AS other, {_TOLD} AS told, {_clean("summary")} AS s, {_POINTS_HOST} AS host FROM teasers)
    SELECT doc_id, other = '' OR other = category_hint OR {_FAMILY} AS compatible,
        CASE WHEN category_hint IN ('International', 'Europe') OR regexp_matches(told, '{editorial.WORLD}') AND NOT regexp_matches(told, '{editorial.FRANCE}') THEN 'world' ELSE 'france' END AS zone,
        NOT regexp_matches(host, '{editorial.POINTER_HOST}') AS direct,
        CASE WHEN length(s) >= 55 AND NOT {_is("s", reader.UNAVAILABLE)} THEN 10 ELSE 0 END + CASE WHEN length(s) >= 180 THEN 5 ELSE 0 END + CASE WHEN length(s) >= 350 THEN 3 ELSE 0 END
        + CASE WHEN regexp_matches(host, '{editorial.POINTER_HOST}') THEN -5 ELSE 7 END + CASE WHEN {_clean("image")} <> '' THEN 4 ELSE 0 END
        + CASE WHEN length({_clean("title")}) >= 45 THEN 2 ELSE 0 END + CASE WHEN custom_source THEN 3 ELSE 0 END AS quality FROM t"""
)
def editorial_marks(spark, sf):
    """Whether another category goes with the article's, its zone, whether its address is the publisher's own, points of quality."""
    title, summary, url, category = (F.col(c) for c in ("title", "summary", "url", "category_hint"))
    return teasers(spark, sf).select(
        "doc_id",
        editorial.compatible_categories(category, F.expr(_OTHER)).alias("compatible"),
        editorial.brief_zone(category, title, summary).alias("zone"),
        editorial.direct_publisher(url).alias("direct"),
        editorial.quality_points(title, summary, url, F.col("image"), F.col("custom_source")).alias("quality"),
    )


def _longest(tag: str) -> str:
    found = f"regexp_extract_all(h, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1)"
    return f"list_extract(list_sort(list_transform({found}, lambda x, i: {{'n': -length(x), 'i': i, 'x': x}})), 1).x"


def _without(x: str, *patterns: str) -> str:
    for p in patterns:
        x = "regexp_replace({}, '{}', ' ', 'g')".format(x, p.replace("'", "''"))
    return x


_CLEANED = _without("region", *(rf"(?is)<{t}\b.*?</{t}>" for t in ("script", "style", "noscript", *editorial.APART)), "(?i)" + editorial.NOISE)


@query(
    f"""WITH p AS (SELECT page_id, {_HTML} AS h FROM pages), r AS (SELECT page_id, coalesce({_longest("article")}, {_longest("main")}, h) AS region FROM p)
    SELECT page_id, length(region) AS chars, sha256({_CLEANED}) AS cleaned_sha256 FROM r""",
    articles_view=False,
)
def article_regions(spark, sf):
    """Pages in forms with several article elements, main ones, none, and parts apart."""
    own = read(spark, sf, "pages").select("page_id", editorial.article_region(F.expr(_HTML)).alias("region"))
    return own.select("page_id", F.length("region").cast("long").alias("chars"), F.sha2(editorial.cleaned_region(F.col("region")), 256).alias("cleaned_sha256"))


@query(
    f"""SELECT page_id, CASE WHEN {_is(_ADDRESS, editorial.RESTRICTED)} THEN 'restricted-url' WHEN {_is(_MARKED, "|".join(editorial.MARKERS))} THEN 'paywall-marker' ELSE '' END AS signal FROM pages""",
    articles_view=False,
)
def paywall_signals(spark, sf):
    """Pages in forms with and without markers."""
    return read(spark, sf, "pages").select("page_id", editorial.paywall_signal(F.expr(_MARKED), F.expr(_ADDRESS)).alias("signal"))
