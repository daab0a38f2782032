"""Queries of sentence digests and of the directory of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import digest, directory, diversity
from newsloom.plans.adapters import headlines, read, reports
from newsloom.plans.registry import query


def _clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(strip_accents(lower({_clean(x)})), '[^a-z0-9]+', ' ', 'g'))"


_STOP = ", ".join(f"'{w}'" for w in text.SUMMARY_STOP)
_WORDS = lambda x: f"list_filter(string_split({_norm(x)}, ' '), lambda w: length(w) >= 4 AND w NOT IN ({_STOP}))"
_D = digest
_LIKE = lambda a, b: f"len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))"
_NONE = " OR ".join(f"contains(norm, '{t}')" for t in _D.SAYS_NOTHING)


@query(
    rf"""WITH own AS (SELECT doc_id, title, {_clean("summary")} AS body FROM reports),
    cut AS (SELECT doc_id, title, list_filter(list_transform(regexp_extract_all(body, '{text.SENTENCE}'), lambda s: trim(s)), lambda s: s <> '') AS l FROM own),
    said AS (SELECT doc_id, title, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS place, len(l) AS total FROM cut),
    w AS (SELECT *, {_WORDS("s")} AS w, {_WORDS("title")} AS t, {_norm("s")} AS norm, length({_clean("s")}) AS chars FROM said),
    scored AS (SELECT doc_id, place, s, list_distinct(w) AS w, len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) AS n,
        len(list_filter(w, lambda x: list_contains(t, x))) * 7 + least(len(list_distinct(w)), 18) * 0.45::DOUBLE + CASE WHEN regexp_matches(s, '[0-9]') THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(s, '(?i){_D.TELLING}') THEN 2.5::DOUBLE ELSE 0 END
        + CASE WHEN regexp_matches(s, '{_D.NAMED.replace("'", "''")}') THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN chars BETWEEN 65 AND 230 THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN chars > 300 THEN -2.0::DOUBLE ELSE 0 END + CASE WHEN place >= ceil(total / 2) THEN 0.8::DOUBLE ELSE 0 END AS score
        FROM w WHERE len(w) >= 5 AND norm <> '' AND NOT ({_NONE})),
    one AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) = 1),
    two AS (SELECT s.* FROM scored s JOIN one a ON a.doc_id = s.doc_id WHERE a.n < 85 AND s.place <> a.place AND {_LIKE("a.w", "s.w")} < 0.72 QUALIFY row_number() OVER (PARTITION BY s.doc_id ORDER BY s.score DESC, s.place) = 1),
    three AS (SELECT s.* FROM scored s JOIN one a ON a.doc_id = s.doc_id JOIN two b ON b.doc_id = s.doc_id WHERE a.n + b.n < 85 AND a.n + b.n + s.n <= 110 AND s.place NOT IN (a.place, b.place) AND {_LIKE("a.w", "s.w")} < 0.72 AND {_LIKE("b.w", "s.w")} < 0.72 QUALIFY row_number() OVER (PARTITION BY s.doc_id ORDER BY s.score DESC, s.place) = 1),
    rest AS (SELECT doc_id, string_agg(s, ' ' ORDER BY place) AS rest FROM (SELECT * FROM two UNION ALL SELECT * FROM three) GROUP BY doc_id)
    SELECT o.doc_id, sha256(trim(CASE WHEN a.s IS NOT NULL THEN a.s || ' ' || coalesce(r.rest, '') WHEN length(o.body) <= 420 THEN o.body ELSE '' END)) AS digest_sha256 FROM own o LEFT JOIN one a ON a.doc_id = o.doc_id LEFT JOIN rest r ON r.doc_id = o.doc_id"""
)
def sentence_digests(spark, sf):
    """Of whole texts."""
    return digest.digests(reports(spark, sf)).select("doc_id", F.sha2("digest", 256).alias("digest_sha256"))


#: Articles' feeds and names in other letters, and sources that a reader has added, which the tables lack.
_NAMES = "CASE WHEN doc_id % 9 = 0 THEN upper(source) WHEN doc_id % 11 = 0 THEN '' ELSE source END"
_FEED_URL = "CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('https://feeds.example.org/', source, '/', lang) END"
_FEED_TITLE = "CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('Flux ', lang, ' ', doc_id % 3) END"
_ADDED = "n_nationkey AS ord, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS title, concat('www.', lower(replace(n_name, ' ', '-')), '.example.net/rss') AS url, CASE WHEN n_nationkey % 2 = 0 THEN concat('https://WWW.', lower(replace(n_name, ' ', '')), '.example.com/') ELSE '' END AS html_url"


@query(
    f"""WITH told AS (SELECT 0 AS part, row_number() OVER (ORDER BY published_at DESC, doc_id) AS ord, trim(coalesce(nullif({_NAMES}, ''), {_FEED_TITLE})) AS name, source || '.example.com' AS domain, {_FEED_URL} AS feed, coalesce(nullif({_FEED_TITLE}, ''), 'Flux') AS feed_title FROM articles),
    added AS (SELECT ord, title, url, html_url FROM (SELECT {_ADDED} FROM nation)),
    more AS (SELECT 1 AS part, ord, coalesce(nullif(trim(title), ''), regexp_replace(split_part(url, '/', 1), '^www\\.', '')) AS name, regexp_replace(lower(CASE WHEN html_url <> '' THEN regexp_extract(html_url, '^https://([^/]+)', 1) ELSE split_part(url, '/', 1) END), '^www\\.', '') AS domain, url AS feed, coalesce(nullif(title, ''), 'Flux ajouté') AS feed_title FROM added),
    rows AS (SELECT *, {_norm("name")} AS key FROM (SELECT * FROM told UNION ALL SELECT * FROM more) WHERE name <> ''),
    feeds AS (SELECT key, feed, arg_max(feed_title, (part, ord)) AS title FROM rows WHERE feed <> '' GROUP BY key, feed),
    listed AS (SELECT key, string_agg(feed || '=' || title, '|' ORDER BY feed) AS feeds FROM feeds GROUP BY key),
    hosts AS (SELECT key, string_agg(domain, '|' ORDER BY domain) AS domains FROM (SELECT DISTINCT key, domain FROM rows WHERE domain <> '') GROUP BY key),
    s AS (SELECT key, arg_min(name, (part, ord)) AS name, count(*) FILTER (WHERE part = 0) AS n FROM rows GROUP BY key)
    SELECT s.key, s.name, s.n, coalesce(domains, '') AS domains, coalesce(feeds, '') AS feeds, row_number() OVER (ORDER BY lower(s.name), s.key) AS place FROM s LEFT JOIN hosts h ON h.key = s.key LEFT JOIN listed l ON l.key = s.key"""
)
def source_directory(spark, sf):
    """Sources of articles and those that a reader has added, with their domains and feeds, in French alphabetical order."""
    own = headlines(spark, sf).select(F.struct((-F.unix_millis("published_at")).alias("a"), F.col("doc_id").alias("b")).alias("ord"), F.expr(_NAMES).alias("source"), "url", F.expr(_FEED_URL).alias("feed_url"), F.expr(_FEED_TITLE).alias("feed_title"))
    added = read(spark, sf, "nation").selectExpr(*[x.strip() for x in _ADDED.replace(", CASE", ",\nCASE").replace(", concat('www", ",\nconcat('www").split(",\n")])
    found = directory.source_directory(own, added.withColumn("ord", F.struct(F.col("ord").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))))
    feeds = F.array_join(F.transform(F.map_entries(F.coalesce("feeds", F.create_map().cast("map<string,string>"))), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|")
    return found.select("key", "name", F.col("count").alias("n"), F.array_join("domains", "|").alias("domains"), feeds.alias("feeds"), "place")


@query()
def diversified_order(spark, sf):
    """Each day's articles so that neighbours differ in category and source; tested against the loop."""
    own = headlines(spark, sf).select("doc_id", F.date_format("published_at", "yyyy-MM-dd").alias("day"), "published_at", F.col("category_hint").alias("category"), F.substring(text.normalise(F.col("source")), 1, 120).alias("source"), (F.col("doc_id") % 50 == 0).alias("essential"), (F.lit(100.0) - F.hour("published_at")).alias("importance"))
    return diversity.diversified(own, "day", [F.desc("published_at"), F.col("doc_id")])
