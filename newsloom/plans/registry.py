"""The named queries over whole tables, each with DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import text, times, urls
from newsloom.operators import categories, classify, clustering, events, extract, filters, greedy, novelty, scoring, selection, significance, support
from newsloom.plans.adapters import ARTICLES_SQL, AS_OF, FETCHED_SQL, INTERACTIONS_SQL, articles, fetched, headlines, interactions, now, read, reports, sql_decoded, sql_stripped
from newsloom.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

STOP = ("the", "and", "und", "los", "les")
KEYWORDS = ["inst", "esthtion", "ouchan", "zuungge"]
PREFERRED = ["Science", "Tech"]
TERMS = [(1, "Science", "inst"), (1, "Science", "esthtion"), (2, "Tech", "thonre"), (2, "Tech", "rend"), (3, "Santé", "ouchan"), (3, "Santé", "treai"), (4, "Culture", "zuungge"), (4, "Culture", "hend"), (5, "Politique", "ardo"), (5, "Politique", "erin")]
SUFFIXES = ("s", "ed", "ion")

#: DuckDB forms of text.normalise and of tokens.
_NORM = "trim(regexp_replace(strip_accents(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))), '[^a-z0-9]+', ' ', 'g'))"
_ORDER = "published_at DESC, doc_id"


def _norm(x: str) -> str:
    return _NORM.format(x)


def _tokens(x: str, least: int = 4, stop: tuple[str, ...] = ()) -> str:
    banned = f" AND t NOT IN ({','.join(repr(s) for s in stop)})" if stop else ""
    return f"list_filter(string_split({_norm(x)}, ' '), lambda t: length(t) >= {least}{banned})"


def query(sql: str | None = None, articles_view: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            _SQL[f.__name__] = body if not articles_view else f"WITH {ARTICLES_SQL}{',' + body[4:] if body.startswith('WITH') else ' ' + body}"
        return f

    return add


def _newest():
    return [F.desc("published_at"), F.col("doc_id")]


@query("SELECT doc_id, title, summary, source, url, published_at, category_hint, custom_source FROM articles")
def article_view(spark, sf):
    return articles(spark, sf).select("doc_id", "title", "summary", "source", "url", "published_at", "category_hint", "custom_source")


@query(f"SELECT doc_id, published_at FROM articles WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def history_filter(spark, sf):
    return articles(spark, sf).where(F.col("published_at") >= now() - F.make_dt_interval(days=F.lit(7))).select("doc_id", "published_at")


@query(f"SELECT doc_id, {_norm('title')} AS topic FROM articles")
def normalise_topic(spark, sf):
    return articles(spark, sf).select("doc_id", text.normalise(F.col("title")).alias("topic"))


@query(f"SELECT doc_id, t.token, count(*) AS n FROM articles, unnest(list_distinct({_tokens('title', 4, STOP)})) AS t(token) GROUP BY ALL")
def title_tokens(spark, sf):
    return articles(spark, sf).select("doc_id", F.explode(text.tokens(F.col("title"), 4, STOP)).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


_WEB = r"(?i)^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


@query(
    f"""WITH {FETCHED_SQL},
    parts AS (SELECT page_id, trim(url) AS u, lower(regexp_extract(trim(url), '{_WEB}', 1)) AS scheme, lower(regexp_extract(trim(url), '{_WEB}', 2)) AS host, regexp_extract(trim(url), '{_WEB}', 3) AS path,
                list_filter(string_split(regexp_extract(trim(url), '{_WEB}', 4), '&'), lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid')) AS kept FROM fetched)
    SELECT page_id, CASE WHEN scheme = '' THEN u ELSE scheme || '://' || host || coalesce(nullif(CASE WHEN ends_with(path, '/') THEN left(path, length(path) - 1) ELSE path END, ''), '/') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM parts""",
    articles_view=False,
)
def canonical_url(spark, sf):
    return fetched(spark, sf).select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host FROM pages", articles_view=False)
def page_hosts(spark, sf):
    return read(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@query("SELECT doc_id, 'a-' || substring(sha256(url || '|' || title), 1, 16) AS article_id FROM articles")
def server_article_id(spark, sf):
    return articles(spark, sf).select("doc_id", urls.article_id(F.col("url"), F.col("title")).alias("article_id"))


@query(f"SELECT CASE WHEN h < 12 THEN '<12h' WHEN h < 48 THEN '12-48h' WHEN h < 168 THEN '2-7d' ELSE '8-31d' END AS bucket, count(*) AS n FROM (SELECT epoch_ms(TIMESTAMP '{AS_OF}' - published_at) / 3600000.0 AS h FROM (SELECT *, epoch_ms(TIMESTAMP '{AS_OF}') AS _ FROM articles)) GROUP BY ALL".replace(f"epoch_ms(TIMESTAMP '{AS_OF}' - published_at)", f"(epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(published_at))"))
def age_buckets(spark, sf):
    return articles(spark, sf).groupBy(times.age_bucket(F.col("published_at"), now()).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT CAST(epoch_ms(published_at) // 259200000 AS BIGINT) AS bucket, source, count(*) AS n FROM articles GROUP BY ALL")
def story_bucket_72h(spark, sf):
    return articles(spark, sf).groupBy(times.story_bucket(F.col("published_at")).alias("bucket"), "source").agg(F.count("*").alias("n"))


_HAY = _norm("concat_ws(' ', title, summary)")
_MATCHES = f"list_filter({KEYWORDS!r}, lambda k: contains({_HAY}, k))"


@query(f"SELECT doc_id, array_to_string(m, '|') AS matches FROM (SELECT doc_id, {_MATCHES} AS m FROM reports) WHERE len(m) > 0")
def keyword_matches(spark, sf):
    found = reports(spark, sf).select("doc_id", filters.keyword_matches(filters.haystack(F.col("title"), F.col("summary")), KEYWORDS).alias("m"))
    return found.where(F.size("m") > 0).select("doc_id", F.array_join("m", "|").alias("matches"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {_HAY} AS h FROM reports) WHERE (contains(h, 'inst') AND contains(h, 'thonre') OR contains(h, 'ouchan')) AND NOT contains(h, 'hend') AND NOT contains(h, 'treai')")
def watch_rule_match(spark, sf):
    return reports(spark, sf).where(filters.watch_rule(filters.haystack(F.col("title"), F.col("summary")), "inst + thonre | ouchan", "hend, treai")).select("doc_id")


@query(f"SELECT doc_id FROM reports WHERE source NOT IN ('src1', 'src2') AND NOT contains({_HAY}, 'rend')")
def blocked_filter(spark, sf):
    blocked = spark.createDataFrame([("src1",), ("src2",)], "source string")
    return reports(spark, sf).join(blocked, "source", "left_anti").where(~filters.watch_rule(filters.haystack(F.col("title"), F.col("summary")), "rend")).select("doc_id")


_TERM_ROWS = ", ".join(f"({r}, '{c}', '{t}')" for r, c, t in TERMS)
_CLASSIFIED = f"""WITH terms(rule, category, base) AS (VALUES {_TERM_ROWS}),
    expanded AS (SELECT rule, category, base, base || e AS token FROM terms, (VALUES (''), {", ".join(f"('{s}')" for s in SUFFIXES)}) AS x(e) WHERE e = '' OR length(base) >= 5),
    words AS (SELECT doc_id, unnest(list_distinct(string_split({_norm("title")}, ' '))) AS token, 10 AS points FROM articles
              UNION ALL SELECT doc_id, unnest(list_distinct(string_split({_norm("summary")}, ' '))), 3 FROM articles),
    best AS (SELECT doc_id, rule, category, base, max(points) AS points FROM words JOIN expanded USING (token) GROUP BY ALL),
    scored AS (SELECT doc_id, rule, category, CAST(sum(points) AS BIGINT) + CASE WHEN category = category_hint THEN 2 ELSE 0 END AS score, count(*) FILTER (WHERE points = 10) AS title_hits
               FROM best JOIN articles USING (doc_id) GROUP BY doc_id, rule, category, category_hint),
    placed AS (SELECT *, row_number() OVER w AS place, score - coalesce(lead(score) OVER w, 0) AS margin FROM scored WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, title_hits DESC, rule)),
    top AS (SELECT *, CASE WHEN title_hits >= 2 AND margin >= 4 OR score >= 20 AND margin >= 6 THEN 'high' WHEN score >= 10 AND margin >= 4 THEN 'medium' ELSE 'low' END AS level FROM placed WHERE place = 1 AND score >= 6)"""


def _classified(spark, sf):
    return classify.classify(articles(spark, sf), spark.createDataFrame(TERMS, "rule int, category string, term string"), suffixes=SUFFIXES)


@query(_CLASSIFIED + " SELECT a.doc_id, coalesce(t.category, a.category_hint, 'Société') AS category, coalesce(score, 0) AS score, coalesce(title_hits, 0) AS title_hits, coalesce(margin, 0) AS margin, coalesce(level, 'low') AS level FROM articles a LEFT JOIN top t ON a.doc_id = t.doc_id")
def category_score(spark, sf):
    return _classified(spark, sf)


@query(_CLASSIFIED + " SELECT coalesce(t.category, a.category_hint, 'Société') AS category, coalesce(level, 'low') AS level, count(*) AS n FROM articles a LEFT JOIN top t ON a.doc_id = t.doc_id GROUP BY ALL")
def category_levels(spark, sf):
    return _classified(spark, sf).groupBy("category", "level").agg(F.count("*").alias("n"))


def _scored(spark, sf):
    own = articles(spark, sf)
    matches = filters.keyword_matches(filters.haystack(F.col("title"), F.col("summary")), KEYWORDS)
    return own.withColumn("score", times.rounded(scoring.core_rank(F.col("published_at"), now(), F.col("category_hint"), PREFERRED, matches, F.col("custom_source")), 3)).withColumn("day", times.day_key(F.col("published_at")))


_SCORED = f"""WITH scored AS (SELECT *, strftime(published_at, '%Y-%m-%d') AS day,
    floor((100.0 - least((epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(published_at)) / 3600000.0, 96.0) + CASE WHEN category_hint IN ('Science', 'Tech') THEN 26.0 ELSE 0.0 END + 28.0 * len({_MATCHES}) + CASE WHEN custom_source THEN 35.0 ELSE 0.0 END + CASE WHEN category_hint IN ('Politique', 'International', 'Économie', 'Santé') THEN 6.0 ELSE 0.0 END) * 1000 + 0.5) / 1000 AS score FROM articles)"""


@query(_SCORED + " SELECT doc_id, score FROM scored")
def core_rank(spark, sf):
    return _scored(spark, sf).select("doc_id", "score")


@query(
    _SCORED
    + """, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, published_at DESC, doc_id) AS g, row_number() OVER (PARTITION BY day ORDER BY score DESC, published_at DESC, doc_id) AS d FROM scored),
    phased AS (SELECT *, CASE WHEN g <= 160 THEN 0 ELSE 1 END AS phase FROM ranked WHERE g <= 160 OR d <= 12)
    SELECT doc_id, day, score, phase FROM phased ORDER BY phase, CASE WHEN phase = 1 THEN day END DESC, CASE WHEN phase = 1 THEN d ELSE 0 END, score DESC, published_at DESC, doc_id LIMIT 700"""
)
def catalogue_quota(spark, sf):
    return selection.top_and_daily(_scored(spark, sf).select("doc_id", "day", "score", "published_at"), "day", [F.desc("score"), F.desc("published_at"), F.col("doc_id")]).select("doc_id", "day", "score", "phase")


@query(
    f"""WITH turns AS (SELECT doc_id, source, published_at, row_number() OVER (PARTITION BY source ORDER BY {_ORDER}) AS turn FROM articles),
    places AS (SELECT source, row_number() OVER (ORDER BY {_ORDER}) AS place FROM turns WHERE turn = 1)
    SELECT doc_id, turns.source, turn, place FROM turns JOIN places ON turns.source IS NOT DISTINCT FROM places.source"""
)
def source_round_robin(spark, sf):
    """All rows in the order turn, place."""
    own = articles(spark, sf).select("doc_id", "source", "published_at")
    return selection.round_robin(own, "source", _newest()).select("doc_id", "source", "turn", "place")


@query(
    f"""WITH named AS (SELECT doc_id, published_at, coalesce(nullif({_norm('source')}, ''), 'source') AS source FROM articles),
    turns AS (SELECT doc_id, source, published_at, row_number() OVER (PARTITION BY source ORDER BY {_ORDER}) AS turn FROM named),
    places AS (SELECT source, row_number() OVER (ORDER BY {_ORDER}) AS place FROM turns WHERE turn = 1)
    SELECT doc_id, source, turn, place FROM turns JOIN places USING (source)"""
)
def source_turns(spark, sf):
    """All rows in the order turn, place, by normalised sources."""
    own = articles(spark, sf).select("doc_id", "published_at", F.coalesce(F.nullif(text.normalise(F.col("source")), F.lit("")), F.lit("source")).alias("source"))
    return selection.round_robin(own, "source", _newest()).select("doc_id", "source", "turn", "place")


@query(f"SELECT doc_id, category_hint, turn FROM (SELECT *, row_number() OVER w AS turn, first_value(published_at) OVER w AS best_at, first_value(doc_id) OVER w AS best_id FROM articles WINDOW w AS (PARTITION BY category_hint ORDER BY {_ORDER})) ORDER BY turn, best_at DESC, best_id LIMIT 24")
def category_round_robin(spark, sf):
    return selection.round_robin(articles(spark, sf), "category_hint", _newest(), 24).select("doc_id", "category_hint", "turn")


@query(
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_ORDER}) AS r FROM articles WHERE custom_source),
    c10 AS (SELECT * EXCLUDE (r) FROM c WHERE r <= 4 ORDER BY {_ORDER} LIMIT 10),
    u AS (SELECT * FROM articles WHERE NOT custom_source UNION ALL BY NAME SELECT * FROM c10)
    SELECT doc_id, source, custom_source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_ORDER}) AS r FROM u) WHERE r <= 20"""
)
def flood_cap(spark, sf):
    return selection.flood_cap(articles(spark, sf), _newest()).select("doc_id", "source", "custom_source")


@query(
    f"""SELECT doc_id, day, day_rank, rank FROM (SELECT doc_id, day, dense_rank() OVER (ORDER BY day DESC NULLS LAST) AS day_rank, row_number() OVER (PARTITION BY day ORDER BY {_ORDER}) AS rank FROM (SELECT *, strftime(published_at, '%Y-%m-%d') AS day FROM articles))
    WHERE rank <= CASE day_rank WHEN 1 THEN 24 WHEN 2 THEN 16 ELSE 8 END"""
)
def home_day_quota(spark, sf):
    """The rows within the day quotas 24, 16 and 8; home_order has all rows."""
    return home_order(spark, sf).where("not overflow").select("doc_id", "day", "day_rank", "rank")


@query(
    f"""SELECT doc_id, day, day_rank, rank, rank > CASE day_rank WHEN 1 THEN 24 WHEN 2 THEN 16 ELSE 8 END AS overflow
    FROM (SELECT doc_id, day, dense_rank() OVER (ORDER BY day DESC NULLS LAST) AS day_rank, row_number() OVER (PARTITION BY day ORDER BY {_ORDER}) AS rank FROM (SELECT *, strftime(published_at, '%Y-%m-%d') AS day FROM articles))"""
)
def home_order(spark, sf):
    """All rows in the order overflow, day_rank, rank; home_day_quota has only those within the quotas."""
    own = articles(spark, sf).select("doc_id", "published_at", times.day_key(F.col("published_at")).alias("day"))
    return selection.day_order(own, "day", _newest()).select("doc_id", "day", "day_rank", "rank", "overflow")


@query(f"SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY {_ORDER}) AS r FROM articles) WHERE r <= 1")
def stratified_sample(spark, sf):
    return selection.stratified(articles(spark, sf), ["source", "lang"], _newest()).select("doc_id", "source", "lang")


_COVER = f"coalesce(len(list_intersect(list_distinct({_tokens('title')}), list_distinct({_tokens('summary')}))) / nullif(least(len(list_distinct({_tokens('title')})), len(list_distinct({_tokens('summary')}))), 0), 0.0)"


@query(f"WITH s AS (SELECT *, {_COVER} AS c FROM articles) SELECT CASE WHEN length(summary) < 32 THEN 'missing' WHEN c >= 0.85 AND length(summary) <= 1.8 * length(title) THEN 'title_like' ELSE 'usable' END AS state, count(*) AS n FROM s GROUP BY ALL")
def summary_state_counts(spark, sf):
    own = articles(spark, sf)
    cover = text.containment(text.tokens(F.col("title")), text.tokens(F.col("summary")))
    return own.groupBy(scoring.information_state(F.col("summary"), cover, F.length("title")).alias("state")).agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, any_value(n) AS n, round(max(value) FILTER (WHERE p = CAST(floor((n - 1) * 0.5) AS BIGINT) + 1), 6) AS median, round(max(value) FILTER (WHERE p = CAST(floor((n - 1) * 0.95) AS BIGINT) + 1), 6) AS p95 FROM r GROUP BY event_type""",
    articles_view=False,
)
def latency_quantiles(spark, sf):
    """Nearest rank: rows are ranked in range-cut blocks, so a frequent event type is never gathered in one task."""
    own = read(spark, sf, "events").select("event_type", "value").where("event_type is not null")
    total = own.groupBy("event_type").agg(F.count("*").alias("n"))  # a row per type
    placed = selection.ranked(own, [F.col("value")], "place", "event_type").join(total, "event_type")
    at = lambda q: F.round(F.max(F.when(F.col("place") == F.floor((F.col("n") - 1) * q) + 1, F.col("value"))), 6)
    return placed.groupBy("event_type").agg(F.max("n").alias("n"), at(0.5).alias("median"), at(0.95).alias("p95"))


@query(f"SELECT doc_id, len(c) AS n_claims, array_to_string(c, '|') AS claims FROM (SELECT doc_id, regexp_extract_all(trim(regexp_replace(summary, '\\s+', ' ', 'g')), '(?i){text.NUMBER}') AS c FROM reports) WHERE len(c) > 0")
def numeric_claims(spark, sf):
    return reports(spark, sf).select("doc_id", text.numeric_claims(F.col("summary")).alias("c")).where(F.size("c") > 0).select("doc_id", F.size("c").cast("long").alias("n_claims"), F.array_join("c", "|").alias("claims"))


_SENTENCES = f"list_filter(list_transform(regexp_extract_all(summary, '{text.SENTENCE}'), lambda s: trim(s)), lambda s: s <> '')"


@query(f"SELECT doc_id, len({_SENTENCES}) AS n_sentences, substring(array_to_string(list_filter({_SENTENCES}, lambda s: length(s) >= 36)[1:5], ' '), 1, 1000) AS digest FROM reports")
def extractive_summary(spark, sf):
    return reports(spark, sf).select("doc_id", F.size(text.sentences(F.col("summary"))).cast("long").alias("n_sentences"), text.extractive_summary(F.col("summary")).alias("digest"))


@query(
    f"""WITH {FETCHED_SQL}, p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1), 1) - 1 AS place FROM fetched),
    t AS (SELECT page_id, place, {sql_stripped("raw")} AS text FROM p),
    f AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(substring(text, 1, 140)) ORDER BY place) AS c FROM t WHERE length(text) >= 55),
    r AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY page_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f WHERE c = 1)
    SELECT page_id, CAST(place AS INTEGER) AS place, text FROM r WHERE b <= 14000""",
    articles_view=False,
)
def paragraph_extract(spark, sf):
    return extract.paragraphs(fetched(spark, sf)).select("page_id", "place", "text")


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages", articles_view=False)
def page_titles(spark, sf):
    return read(spark, sf, "pages").select("page_id", extract.title_tag(F.col("html")).alias("title"))


@query(
    f"WITH {INTERACTIONS_SQL} SELECT doc_id, CAST(i AS BIGINT) AS impressions, CAST(o AS BIGINT) AS opens, CAST(least(52, least(46, 7 * i + 15 * o) + CASE WHEN epoch_ms(latest) - epoch_ms(last_at) < 7200000 THEN 7 ELSE 0 END) AS BIGINT) AS penalty FROM (SELECT doc_id, count(*) FILTER (WHERE action = 'impression') AS i, count(*) FILTER (WHERE action = 'open') AS o, max(ts) AS last_at FROM interactions WHERE action IN ('impression', 'open') GROUP BY doc_id), (SELECT max(ts) AS latest FROM events)",
    articles_view=False,
)
def seen_penalty(spark, sf):
    """As of the last event."""
    told = interactions(spark, sf).where(F.col("action").isin("impression", "open"))
    seen = told.groupBy("doc_id").agg(F.count_if(F.col("action") == "impression").alias("impressions"), F.count_if(F.col("action") == "open").alias("opens"), F.max(F.col("ts").cast("timestamp")).alias("last_at"))
    latest = read(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    return seen.select("doc_id", "impressions", "opens", scoring.seen_penalty(F.col("impressions"), F.col("opens"), F.col("last_at"), latest).cast("long").alias("penalty"))


@query("SELECT a.doc_id, a.source, l.quality, l.toxic FROM articles a LEFT JOIN labels l ON a.doc_id = l.doc_id")
def audit_join(spark, sf):
    return articles(spark, sf).join(read(spark, sf, "labels"), "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@query(f"WITH {INTERACTIONS_SQL} SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.doc_id = d.doc_id AND i.action = 'open')", articles_view=False)
def unopened(spark, sf):
    opened = interactions(spark, sf).where("action = 'open'").select("doc_id")
    return read(spark, sf, "documents").join(opened, "doc_id", "left_anti").select("doc_id")


@query("SELECT conv_id, turn, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_chars FROM conversations", articles_view=False)
def previous_snapshot(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.lag(F.length("text").cast("long")).over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous_chars"))


@query("SELECT conv_id, turn, running FROM (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS running FROM conversations) WHERE running <= 500", articles_view=False)
def running_length_cut(spark, sf):
    return selection.running_cut(read(spark, sf, "conversations"), "conv_id", [F.col("turn")], F.length("text").cast("long"), 500).select("conv_id", "turn", "running")


@query(f"SELECT doc_id, source, lead FROM (SELECT doc_id, source, first_value(doc_id) OVER (PARTITION BY {_norm('title')} ORDER BY {_ORDER}) AS lead FROM articles)")
def lead_in_group(spark, sf):
    own = articles(spark, sf).withColumn("key", text.normalise(F.col("title")))
    leads = own.groupBy("key").agg(F.min_by("doc_id", F.struct(-F.unix_millis("published_at"), "doc_id")).alias("lead"))
    return own.join(leads, "key").select("doc_id", "source", "lead")


@query("SELECT time_bucket(INTERVAL 72 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", articles_view=False)
def event_windows(spark, sf):
    return state.windowed_counts(read(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query(
    f"""WITH toks AS (SELECT doc_id, published_at, list_sort(list_distinct({_tokens("regexp_replace(title, '\\s+-\\s+[^-]{2,45}$', '')", 4, STOP)})) AS k FROM articles)
    SELECT array_to_string(k, ' ') AS token_set, count(*) AS n, arg_min(doc_id, (-epoch_ms(published_at), doc_id)) AS head FROM toks WHERE len(k) > 0 GROUP BY k"""
)
def title_classes(spark, sf):
    keyed = articles(spark, sf).select("doc_id", "published_at", F.array_sort(text.tokens(text.strip_publisher(F.col("title")), 4, STOP)).alias("k")).where("size(k) > 0")
    return keyed.groupBy(F.array_join("k", " ").alias("token_set")).agg(F.count("*").alias("n"), F.min_by("doc_id", F.struct(-F.unix_millis("published_at"), "doc_id")).alias("head"))


def _quoted(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


# DuckDB's patterns have no look-around: wars of trade are taken out of the title first
_TRADE_WAR = r"de guerre|guerre\s+(?:économique|commerciale|tarifaire|technologique|des? prix)\b"
_WAR = significance.PATTERNS | {"event": significance.PATTERNS["event"].replace(r"(?<!de )guerre(?!\s+(?:économique|commerciale|tarifaire|technologique|des? prix)\b)", "guerre")}
_FLAGS = ", ".join(f"regexp_matches({'w' if k == 'event' else 't'}, {_quoted(p)}) AS f_{k}" for k, p in _WAR.items())
_SIGNAL = f"""WITH titles AS (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM articles),
    flags AS (SELECT *, {_FLAGS}, len(regexp_extract_all(t, {_quoted(significance.NUMBERS)})) AS numbers FROM (SELECT *, regexp_replace(t, {_quoted(_TRADE_WAR)}, '~', 'g') AS w FROM titles)),
    told AS (SELECT *, length(t) < 18 OR regexp_matches(t, '{significance.MALFORMED}') AS malformed,
               (f_event OR f_missile OR f_sanctions) AND NOT (f_sports AND f_quake AND NOT f_human) AND NOT (f_market AND NOT f_human) AS major,
               f_policy OR f_specific OR (f_institution AND f_action) OR (f_effect AND f_context) AS decision,
               f_utility AND NOT f_consumer AND NOT f_listicle AS utility FROM flags),
    base AS (SELECT *, CAST(0 AS INTEGER) + CASE WHEN malformed THEN -34 ELSE 0 END + CASE WHEN f_human THEN 24 ELSE 0 END + CASE WHEN major THEN 15 ELSE 0 END + CASE WHEN decision THEN 10 ELSE 0 END
               + CASE WHEN utility THEN 6 ELSE 0 END + CASE WHEN f_cyber THEN 11 ELSE 0 END + CASE WHEN f_science THEN 7 ELSE 0 END AS b,
               NOT (f_human OR major OR decision OR utility OR f_cyber) AS light FROM told),
    signals AS (SELECT *, CAST(greatest(-34, least(38, b + CASE WHEN b > 0 AND numbers >= 2 THEN 5 WHEN b > 0 AND numbers = 1 THEN 2 ELSE 0 END
               + CASE WHEN light AND (f_consumer OR f_listicle) THEN -16 ELSE 0 END + CASE WHEN light AND f_reaction THEN -13 ELSE 0 END + CASE WHEN light AND f_sports THEN -16 ELSE 0 END
               + CASE WHEN light AND f_celebrity THEN -11 ELSE 0 END + CASE WHEN light AND t LIKE '%?' THEN -4 ELSE 0 END)) AS INTEGER) AS signal FROM base)"""


@query(_SIGNAL + " SELECT doc_id, signal FROM signals")
def home_signal(spark, sf):
    return significance.with_signal(articles(spark, sf)).select("doc_id", "signal")


def _ranked(spark, sf):
    own = significance.with_signal(_scored(spark, sf))
    return own.withColumn("catalogue_score", significance.catalogue_score(F.col("score"), F.col("signal")))


_RANKED = _SIGNAL + _SCORED.replace("WITH scored", ", scored", 1) + ", ranked AS (SELECT s.*, floor((s.score + g.signal) * 10 + 0.5) / 10 AS catalogue_score FROM scored s JOIN signals g ON s.doc_id = g.doc_id)"


@query(
    _RANKED
    + """, placed AS (SELECT *, row_number() OVER (ORDER BY catalogue_score DESC, published_at DESC, doc_id) AS g, row_number() OVER (PARTITION BY day ORDER BY catalogue_score DESC, published_at DESC, doc_id) AS d FROM ranked),
    phased AS (SELECT *, CASE WHEN g <= 120 THEN 0 ELSE 1 END AS phase FROM placed WHERE g <= 120 OR d <= 10)
    SELECT doc_id, day, catalogue_score, phase FROM phased ORDER BY phase, CASE WHEN phase = 1 THEN day END DESC, CASE WHEN phase = 1 THEN d ELSE 0 END, catalogue_score DESC, published_at DESC, doc_id LIMIT 620"""
)
def signal_quota(spark, sf):
    return selection.top_and_daily(_ranked(spark, sf).select("doc_id", "day", "catalogue_score", "published_at"), "day", [F.desc("catalogue_score"), F.desc("published_at"), F.col("doc_id")], top=120, daily=10, cap=620).select("doc_id", "day", "catalogue_score", "phase")


_TITLE_KEY = f"substring({_norm('title')}, 1, 180)"


@query(f"SELECT doc_id FROM (SELECT doc_id, {_TITLE_KEY} AS k, row_number() OVER (PARTITION BY {_TITLE_KEY} ORDER BY {_ORDER}) AS r FROM articles) WHERE r = 1 OR k = ''")
def first_seen(spark, sf):
    """Newest first; articles have urls of their own, so the SQL needs titles only."""
    own = articles(spark, sf).withColumn("url_key", F.regexp_replace("url", r"(?s)[?#].*$", "")).withColumn("title_key", F.substring(text.normalise(F.col("title")), 1, 180))
    return greedy.first_seen(own, ["url_key", "title_key"], F.struct(-F.unix_millis("published_at"), "doc_id")).select("doc_id")


@query()
def history_merge(spark, sf):
    """Tested against the sequential form."""
    own = articles(spark, sf).withColumn("url_key", urls.canonical(F.col("url"))).withColumn("title_key", text.normalise(F.col("title")))
    return greedy.merge_history(own, F.struct(-F.unix_millis("published_at"), "doc_id")).select("doc_id")


def _brief_order():
    return [-F.col("score"), -F.unix_millis("published_at"), F.col("doc_id")]


def _brief_scored(spark, sf):
    own = headlines(spark, sf).where(F.col("published_at") >= times.history_start(now()))
    score = scoring.brief_score(F.concat_ws(" ", "title", "summary"), F.col("published_at"), now(), F.col("category_hint"), F.lit(1))
    words = text.tokens(F.col("title"), 4, scoring.BRIEF_STOP)
    return own.select("doc_id", times.day_key(F.col("published_at")).alias("day"), "source", "category_hint", words.alias("words"), times.rounded(score, 6).alias("score"), "published_at")


def _same_story(a, b):
    return scoring.same_brief_event(a["words"], b["words"])


@query()
def brief_day_picks(spark, sf):
    """Five of each day, two of a source at most, no two of one event, then filled up; tested against the sequential form."""
    return greedy.pick(_brief_scored(spark, sf), "day", _brief_order(), 5, caps={"source": 2}, conflict=_same_story, backfill_to=5).select("doc_id", "day", "source", "pick")


_TOLD = "title || ' ' || summary"


@query(
    f"""SELECT doc_id, floor((100.0 + CASE WHEN category_hint IN ({", ".join(f"'{c}'" for c in scoring.BRIEF_CATEGORIES)}) THEN 55 ELSE -35 END + CASE WHEN regexp_matches({_TOLD}, '(?i){scoring.MAJOR}') THEN 70 ELSE 0 END
      - CASE WHEN regexp_matches({_TOLD}, '(?i){scoring.MINOR}') THEN 240 ELSE 0 END - least(1.6 * (epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(published_at)) / 3600000.0, 100.0)) * 1000000 + 0.5) / 1000000 AS score FROM headlines"""
)
def brief_scores(spark, sf):
    return _brief_scored(spark, sf).select("doc_id", "score")


@query()
def essential_picks(spark, sf):
    """Six of the last 40 hours, two of a category and of a source at most."""
    recent = _brief_scored(spark, sf).where(F.col("published_at") >= now() - F.make_dt_interval(hours=F.lit(40))).withColumn("brief", F.lit("all"))
    return greedy.pick(recent, "brief", _brief_order(), 6, caps={"category_hint": 2, "source": 2}, conflict=_same_story, backfill_to=4).select("doc_id", "category_hint", "source", "pick")


@query()
def event_merge(spark, sf):
    """Of leaders of lexical copies with all that their members give; tested against the sequential form.

    merged_count is the number of leaders, merged_total what they stand for by their sources.
    """
    found = events.merge_events(clustering.lexical_merge(_scored(spark, sf), stop=STOP))
    return found.select("doc_id", F.col("merged_rows").alias("merged_count"), F.col("merged_count").alias("merged_total"), F.array_join("sources", ",").alias("sources"), F.length("summary").cast("long").alias("summary_chars"), "score")


_MEANING = "list_filter(regexp_extract_all(strip_accents(lower({0})), '[a-z0-9]{{5,}}'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in support.STOP_MEANING) + "))"


@query(f"""WITH m AS (SELECT doc_id, {_MEANING.format("title")} AS a, {_MEANING.format("summary")} AS b FROM reports)
    SELECT doc_id, CAST(len(a) AS BIGINT) AS n, len(a) >= 8 AND len(b) > 0 AND len(list_filter(a, lambda t: list_contains(b, t))) >= 0.28 * len(a) AS supported FROM m""")
def title_support(spark, sf):
    own = reports(spark, sf)
    return own.select("doc_id", F.size(support.meaningful(F.col("title"))).cast("long").alias("n"), support.token_share_supported(F.col("title"), F.col("summary")).alias("supported"))


_STOP_NEWS = ", ".join(f"'{w}'" for w in support.STOP_NEWS)



def _plain(x: str) -> str:
    return f"regexp_replace(strip_accents(lower({sql_decoded(x)})), '[’'']', ' ', 'g')"


def _key(x: str) -> str:
    return f"trim(regexp_replace({_plain(x)}, '[^a-z0-9]+', ' ', 'g'))"


def _news_tokens(key: str) -> str:
    return f"list_distinct(list_filter(string_split({key}, ' '), lambda t: length(t) >= 4 AND t NOT IN ({_STOP_NEWS})))"


_BOILER = "(" + "|".join(p.replace("'", "''") for p in support.BOILERPLATE) + ")"
_SAID = r"list_filter(list_transform(regexp_extract_all(trim(regexp_replace(summary, '\s+', ' ', 'g')), '" + text.SENTENCE + "'), lambda s: trim(s)), lambda s: s <> '')"


@query(
    rf"""WITH s AS (SELECT doc_id, title, list_transform(list_filter({_SAID}, lambda s: length(s) >= {support.SENTENCE_CHARS} AND NOT regexp_matches(lower({sql_decoded('s')}), '{_BOILER}')), lambda s: {{'s': s, 'key': {_key('s')}}}) AS e FROM reports),
    t AS (SELECT doc_id, title, list_transform(list_filter(e, lambda x: x.key <> ''), lambda x: [{{'s': x.s, 'key': x.key, 't': {_news_tokens('x.key')}}}]) AS e FROM s),
    k AS (SELECT doc_id, title, coalesce(list_reduce(e, lambda kept, x: CASE WHEN len(list_filter(kept, lambda o: o.key = x[1].key OR len(o.t) > 0 AND len(x[1].t) > 0 AND len(list_intersect(o.t, x[1].t)) >= {support.SAME_SENTENCE} * least(len(o.t), len(x[1].t)))) > 0 THEN kept ELSE list_concat(kept, x) END), []) AS kept FROM t WHERE len(e) > 0
          UNION ALL SELECT doc_id, title, [] FROM t WHERE len(e) = 0),
    c AS (SELECT doc_id, title, array_to_string(list_transform(kept, lambda x: x.s), ' ') AS clean FROM k),
    m AS (SELECT *, trim(regexp_replace({sql_decoded('clean')}, '(?i)^(?:résumé|synthèse)\s*:\s*', '')) AS own, trim({sql_decoded('title')}) AS head, {_news_tokens(_key('clean'))} AS told FROM c),
    n AS (SELECT *, {_news_tokens(_key('own'))} AS a, {_news_tokens(_key('head'))} AS b FROM m),
    r AS (SELECT doc_id, clean, CASE WHEN length(clean) < {support.SUMMARY_CHARS} THEN 'too-short-or-boilerplate'
        WHEN own <> '' AND head <> '' AND (regexp_matches(own, '(?i){support.INTRODUCTION.replace("'", "''")}') OR len(b) >= 4 AND len(a) >= 3 AND len(list_intersect(a, b)) >= {support.RESTATED} * len(b) AND len(list_filter(a, lambda x: NOT list_contains(b, x))) <= 3 AND length(own) <= greatest(190, 1.65 * length(head))) THEN 'title-restatement'
        WHEN len(told) < {support.NEWS_TOKENS} AND length(clean) < {support.NEWS_CHARS} THEN 'low-information' END AS reason FROM n)
    SELECT doc_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS quality, reason, CAST(CASE WHEN reason IS NULL THEN len({_SAID.replace("regexp_replace(summary,", "regexp_replace(clean,")}) ELSE 0 END AS BIGINT) AS n_sentences, sha256(CASE WHEN reason IS NULL THEN clean ELSE '' END) AS summary_sha256 FROM r"""
)
def summary_gate(spark, sf):
    """Of whole texts."""
    return support.final_gate(reports(spark, sf).select("doc_id", "title", "summary")).select("doc_id", "quality", "reason", "n_sentences", F.sha2("final_summary", 256).alias("summary_sha256"))


#: Every seventh report begins with a toll that reports disagree on.
_CLAIM = "CASE WHEN doc_id % 7 = 0 THEN concat('Le séisme du Japon a fait ', CAST(doc_id % 3 + 12 AS STRING), ' morts dans la province centrale. ', summary) ELSE summary END"


@query(
    f"""WITH claims AS (SELECT * REPLACE ({_CLAIM} AS summary) FROM reports), parts AS (SELECT doc_id, source, CAST(epoch_ms(published_at) // 259200000 AS BIGINT) AS story, regexp_extract_all(trim(regexp_replace(summary, '\\s+', ' ', 'g')), '{support.PART.replace("'", "''")}') AS parts FROM claims),
    each AS (SELECT doc_id, source, story, parts, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM parts),
    ctx AS (SELECT doc_id, source, story, replace(regexp_replace(part, '[ .]', '', 'g'), ',', '.') AS value,
              string_split({_norm("array_to_string(parts[greatest(i - 6, 1):i + 6], ' ')")}, ' ') AS words FROM each WHERE regexp_matches(part, '^[0-9]')),
    kept AS (SELECT doc_id, source, story, value, list_filter(words, lambda w: length(w) >= 4 AND NOT regexp_matches(w, '^[0-9]') AND w NOT IN ({_STOP_NEWS})) AS k FROM ctx),
    firsts AS (SELECT doc_id, source, story, value, list_sort(list_filter(k, lambda x, j: list_position(k, x) = j)[1:0 + 1000]) AS s, list_filter(k, lambda x, j: list_position(k, x) = j)[1:10] AS f FROM kept),
    c AS (SELECT DISTINCT story, source, value, doc_id, f FROM firsts WHERE len(f) >= 3),
    p AS (SELECT a.story, a.value AS value_a, b.value AS value_b, a.source AS source_a, b.source AS source_b, a.doc_id AS id_a, b.doc_id AS id_b FROM c a JOIN c b ON a.story = b.story AND a.source <> b.source AND a.value < b.value
          WHERE len(list_intersect(a.f, b.f)) >= 3 AND len(list_intersect(a.f, b.f)) >= 0.52 * least(len(a.f), len(b.f)))
    SELECT story, value_a, value_b, source_a, source_b, min(id_a) AS id_a, min(id_b) AS id_b FROM p GROUP BY ALL"""
)
def contradictions(spark, sf):
    own = reports(spark, sf).withColumns({"story": times.story_bucket(F.col("published_at")), "summary": F.expr(_CLAIM)})
    return support.contradictions(support.numeric_contexts(own, "story", "source", "summary"))


def _stories(spark, sf):
    return articles(spark, sf).withColumn("story", text.normalise(F.col("title")))


@query(
    f"""WITH s AS (SELECT doc_id, published_at, {_norm('title')} AS story FROM articles WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY),
    n AS (SELECT story FROM s GROUP BY story ORDER BY max(row(published_at, doc_id)) DESC, story LIMIT 180)
    SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY published_at DESC, doc_id DESC) AS r FROM s SEMI JOIN n USING (story)) WHERE r <= 7"""
)
def story_retention(spark, sf):
    return novelty.retain(_stories(spark, sf), "story", "published_at", now(), id_col="doc_id").select("doc_id")


def _terms(spark):
    return spark.createDataFrame(TERMS, "rule int, category string, term string")


@query(
    f"""WITH terms(rule, category, term) AS (VALUES {_TERM_ROWS}),
    words AS (SELECT doc_id, unnest(list_distinct(string_split({_HAY}, ' '))) AS term FROM articles),
    counted AS (SELECT doc_id, rule, category, count(*) AS hits FROM words JOIN terms USING (term) GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, rule) AS r FROM counted) WHERE r = 1)
    SELECT a.doc_id, coalesce(b.category, 'Société') AS category, coalesce(hits, 0) AS hits FROM articles a LEFT JOIN best b ON a.doc_id = b.doc_id"""
)
def fast_category(spark, sf):
    return classify.fast_category(articles(spark, sf), _terms(spark))


@query(
    f"""WITH terms(rule, category, term) AS (VALUES {_TERM_ROWS}),
    texts AS (SELECT doc_id, category_hint, {_norm("title")} AS a, {_norm("summary")} AS b FROM articles),
    hits AS (SELECT doc_id, rule, category, count(*) FILTER (WHERE contains(a, term)) AS ta, count(*) FILTER (WHERE contains(b, term)) AS tb FROM texts, terms GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY 6 * ta + least(tb, 3) DESC, rule) AS r FROM hits WHERE ta > 0)
    SELECT t.doc_id, coalesce(b.category, t.category_hint) AS category FROM texts t LEFT JOIN best b ON t.doc_id = b.doc_id AND b.r = 1"""
)
def repaired_category(spark, sf):
    return articles(spark, sf).select("doc_id", classify.repaired_category(F.col("title"), F.col("summary"), F.col("category_hint"), TERMS).alias("category"))


@query(f"WITH s AS (SELECT *, {_norm('title')} AS story FROM articles) SELECT doc_id, max(published_at > TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY) OVER (PARTITION BY story) AS fresh FROM s")
def fresh_stories(spark, sf):
    """Whether any report of an article's story came after the last visit, three days ago."""
    told = _stories(spark, sf)
    fresh = told.groupBy("story").agg(F.max(F.col("published_at") > now() - F.make_dt_interval(days=F.lit(3))).alias("fresh"))
    return told.join(fresh, "story").select("doc_id", "fresh")


@query(
    f"""WITH s AS (SELECT {_norm('title')} AS story, published_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS late, count(*) AS n FROM articles GROUP BY ALL)
    SELECT coalesce(a.story, b.story) AS story, CASE WHEN b.story IS NULL THEN 'new' WHEN a.story IS NULL THEN 'gone' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS change
    FROM (SELECT * FROM s WHERE late) a FULL JOIN (SELECT * FROM s WHERE NOT late) b ON a.story = b.story"""
)
def snapshot_diff(spark, sf):
    """Stories of the last week against those before: one aggregation, no join."""
    late = F.col("published_at") > now() - F.make_dt_interval(days=F.lit(7))
    per = _stories(spark, sf).groupBy("story").agg(F.count_if(late).alias("a"), F.count_if(~late).alias("b"))
    return per.select("story", F.when(F.col("b") == 0, "new").when(F.col("a") == 0, "gone").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("change"))


@query()
def lexical_dedup(spark, sf):
    """Tested row for row against the sequential form."""
    return clustering.lexical_dedup(articles(spark, sf), stop=STOP)


def _feedback_events(spark, sf):
    topics = articles(spark, sf).select("doc_id", F.array("category_hint", "source", "lang").alias("topics"))
    return interactions(spark, sf).join(topics, "doc_id")


@query()
def feedback_weights(spark, sf):
    """Tested against the sequential form."""
    return state.feedback(_feedback_events(spark, sf))


_WEIGHT = "CASE action " + " ".join(f"WHEN '{a}' THEN {w}" for a, w in state.WEIGHTS.items()) + " END"


@query(
    f"WITH {INTERACTIONS_SQL}, w AS (SELECT *, {_WEIGHT} AS w FROM interactions WHERE action IN ('more', 'less', 'follow', 'not')) SELECT event_id, round(CAST(w AS DOUBLE) - coalesce(CAST(lag(w) OVER (PARTITION BY user_id, doc_id ORDER BY ts, event_id) AS DOUBLE), 0), 6) AS delta FROM w QUALIFY abs(delta) >= 0.001",
    articles_view=False,
)
def feedback_deltas(spark, sf):
    """What each action changes once it takes the place of the user's one before on the article."""
    return state.feedback_deltas(_feedback_events(spark, sf)).select("event_id", F.round("delta", 6).alias("delta"))


def _sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


_TERMS_NORM = "trim(regexp_replace(strip_accents(lower(replace(replace(replace(replace({0}, 'œ', 'oe'), 'Œ', 'oe'), 'æ', 'ae'), 'Æ', 'ae'))), '[^a-z0-9]+', ' ', 'g'))"
_RULE_CASE = " ".join(f"WHEN regexp_matches(t, '(?i){p}'){' AND hint <> ' + repr(categories.INCIDENT_HINT) if r == categories.INCIDENT else ''} THEN {i}" for i, (r, _, _, p) in enumerate(categories.TITLE_RULES))
_HEAD = r"regexp_replace(title, '\s+-\s+[^-]{2,45}$', '')"
_DETAILED = f"""WITH terms(rule, category, term, a, b) AS (VALUES {", ".join(f"({i}, '{c}', '{t}', {a}, {b})" for i, c, t, a, b in categories.normalised_terms())}),
    rules(met, reason, category, confidence) AS (VALUES {", ".join(f"({i}, '{r}', '{c}', {n})" for i, (r, c, n, _) in enumerate(categories.TITLE_RULES))}),
    own AS (SELECT *, CASE {_RULE_CASE} END AS met FROM (SELECT doc_id, trim(coalesce(category_hint, '')) AS hint, custom_source AS strict, ' ' || {_TERMS_NORM.format(_HEAD)} || ' ' AS t, ' ' || {_TERMS_NORM.format("summary")} || ' ' AS s FROM headlines)),
    tokens AS (SELECT doc_id, 0 AS scope, unnest(list_distinct(string_split(trim(t), ' '))) AS token FROM own UNION ALL SELECT doc_id, 1, unnest(list_distinct(string_split(trim(s), ' '))) FROM own),
    words AS (SELECT rule, term, a, b, term || e AS token FROM terms, (VALUES (''), {", ".join(f"('{e}')" for e in categories.ENDINGS)}) AS x(e) WHERE NOT contains(term, ' ') AND term NOT IN ({_sql_list(categories.STEMS)}) AND (e = '' OR length(term) >= 5)),
    phrases AS (SELECT rule, term, a, b, CASE WHEN term IN ({_sql_list(categories.STEMS)}) THEN ' ' || term ELSE ' ' || term || ' ' END AS p FROM terms WHERE contains(term, ' ') OR term IN ({_sql_list(categories.STEMS)})),
    hits AS (SELECT doc_id, scope, rule, term, CASE scope WHEN 0 THEN a ELSE b END AS points FROM tokens JOIN words USING (token)
             UNION ALL SELECT doc_id, 0, rule, term, a FROM own, phrases WHERE contains(t, p) UNION ALL SELECT doc_id, 1, rule, term, b FROM own, phrases WHERE contains(s, p)),
    best AS (SELECT doc_id, rule, term, min(scope) AS scope, max(points) AS points FROM hits GROUP BY ALL),
    evidence AS (SELECT doc_id, rule, sum(points) AS score, count(*) FILTER (WHERE scope = 0) AS title_hits FROM best GROUP BY ALL),
    cats AS (SELECT DISTINCT rule, category FROM terms),
    scored AS (SELECT o.doc_id, c.rule, c.category, coalesce(e.score, 0) AS found, coalesce(e.title_hits, 0) AS title_hits, coalesce(e.score, 0) + CASE WHEN c.category = o.hint THEN CASE WHEN o.strict THEN 4 ELSE 2 END ELSE 0 END AS score
               FROM own o CROSS JOIN cats c LEFT JOIN evidence e ON e.doc_id = o.doc_id AND e.rule = c.rule),
    placed AS (SELECT *, row_number() OVER w AS place, score - lead(score) OVER w AS gap FROM scored WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, title_hits DESC, rule)),
    top AS (SELECT * FROM placed WHERE place = 1 AND score >= 6 AND found > 0)
    SELECT o.doc_id, coalesce(r.category, p.category, nullif(o.hint, ''), 'Société') AS category,
           CAST(coalesce(r.confidence, p.score, CASE WHEN o.hint = '' THEN 0 WHEN o.strict THEN 4 ELSE 2 END) AS BIGINT) AS confidence,
           CASE WHEN r.met IS NOT NULL THEN 'high' WHEN p.doc_id IS NULL THEN CASE WHEN o.hint = '' THEN 'none' ELSE 'low' END
                WHEN p.title_hits >= 2 AND p.gap >= 4 OR p.score >= 20 AND p.gap >= 6 THEN 'high' WHEN p.score >= 10 AND p.gap >= 4 THEN 'medium' ELSE 'low' END AS level,
           coalesce(r.reason, CASE WHEN p.doc_id IS NOT NULL THEN 'content' WHEN o.hint <> '' THEN 'feed-hint' ELSE 'fallback' END) AS reason,
           CAST(coalesce(r.confidence, p.gap, CASE WHEN o.hint = '' THEN 0 WHEN o.strict THEN 4 ELSE 2 END) AS BIGINT) AS margin
    FROM own o LEFT JOIN rules r ON o.met = r.met LEFT JOIN top p ON o.doc_id = p.doc_id AND r.met IS NULL"""


@query(_DETAILED)
def detailed_category(spark, sf):
    """The news classifier with all its terms and title rules; followed sources have strict hints."""
    own = headlines(spark, sf).withColumn("strict_category", F.col("custom_source"))
    return categories.classify_detailed(own).select("doc_id", "category", "confidence", "level", "reason", "margin")


@query(_SIGNAL.replace("FROM articles", "FROM headlines") + " SELECT doc_id, signal FROM signals")
def headline_signal(spark, sf):
    return significance.with_signal(headlines(spark, sf)).select("doc_id", "signal")


_AGE = f"greatest(0.0, (epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(published_at)) / 3600000.0)"


@query(f"SELECT doc_id, CAST(floor(120 - least({_AGE}, 96) + CASE WHEN category_hint IN ('Science', 'Tech') THEN 16 ELSE 0 END + 0.5) AS BIGINT) AS score FROM articles")
def fast_rank(spark, sf):
    return articles(spark, sf).select("doc_id", scoring.fast_rank(F.col("published_at"), now(), F.col("category_hint"), PREFERRED).alias("score"))


@query(f"SELECT doc_id, CASE WHEN {_AGE} <= 2 THEN 22 WHEN {_AGE} <= 6 THEN 17 WHEN {_AGE} <= 12 THEN 12 WHEN {_AGE} <= 24 THEN 7 WHEN {_AGE} <= 40 THEN 3 ELSE -10 END AS points FROM articles")
def freshness_scores(spark, sf):
    return articles(spark, sf).select("doc_id", times.freshness(F.col("published_at"), now()).alias("points"))


@query(
    f"""SELECT label, count(*) AS n FROM (SELECT CASE date_diff('day', CAST(published_at AS DATE), DATE '{AS_OF[:10]}') WHEN 0 THEN 'Aujourd’hui' WHEN 1 THEN 'Hier' WHEN 2 THEN 'Avant-hier' ELSE strftime(published_at, '%Y-%m-%d') END AS label FROM articles
        WHERE published_at >= date_trunc('month', TIMESTAMP '{AS_OF}') - INTERVAL 1 MONTH) GROUP BY label"""
)
def day_labels(spark, sf):
    """Articles of the history by the label of their day."""
    own = articles(spark, sf).where(F.col("published_at") >= times.history_start(now()))
    return own.groupBy(times.day_label(F.col("published_at"), now()).alias("label")).agg(F.count("*").alias("n"))


@query(
    " UNION ALL ".join(
        f"SELECT '{p}' AS period, doc_id FROM articles WHERE {c}"
        for p, c in {
            "today": f"published_at >= date_trunc('day', TIMESTAMP '{AS_OF}')",
            "yesterday": f"published_at >= date_trunc('day', TIMESTAMP '{AS_OF}') - INTERVAL 1 DAY AND published_at < date_trunc('day', TIMESTAMP '{AS_OF}')",
            "week": f"published_at >= date_trunc('day', TIMESTAMP '{AS_OF}') - INTERVAL 6 DAY",
            "month": f"published_at >= date_trunc('day', TIMESTAMP '{AS_OF}') - INTERVAL 29 DAY",
        }.items()
    )
)
def period_articles(spark, sf):
    """The articles of each period in one pass; one that is of several periods has a row for each."""
    periods = ("today", "yesterday", "week", "month")
    within = F.filter(F.array(*[F.when(times.in_period(F.col("published_at"), now(), p), F.lit(p)) for p in periods]), lambda p: p.isNotNull())
    return articles(spark, sf).select(F.explode(within).alias("period"), "doc_id")


@query(f"SELECT source, count(DISTINCT strftime(published_at, '%Y-%m-%d')) >= 3 AS ready FROM articles GROUP BY source")
def brief_readiness(spark, sf):
    return articles(spark, sf).groupBy("source").agg((F.countDistinct(times.day_key(F.col("published_at"))) >= 3).alias("ready"))


@query(_SCORED + f", b AS (SELECT *, len({_MATCHES}) > 0 AS tagged FROM scored) SELECT CASE WHEN custom_source THEN 'Source suivie' WHEN tagged THEN 'À suivre' WHEN score >= 130 THEN 'Important' ELSE 'Nouveau' END AS badge, count(*) AS n FROM b GROUP BY 1")
def card_badges(spark, sf):
    tagged = F.size(filters.keyword_matches(filters.haystack(F.col("title"), F.col("summary")), KEYWORDS)) > 0
    return _scored(spark, sf).groupBy(scoring.badge(F.col("custom_source"), tagged, F.col("score")).alias("badge")).agg(F.count("*").alias("n"))


@query(_SIGNAL.replace("FROM articles", "FROM headlines") + " SELECT count(*) AS candidates, count(*) FILTER (WHERE signal > 0) AS positive, count(*) FILTER (WHERE signal < 0) AS negative, count(DISTINCT source) AS sources FROM signals")
def catalogue_stats(spark, sf):
    told = significance.with_signal(headlines(spark, sf))
    return told.agg(F.count("*").alias("candidates"), F.count_if(F.col("signal") > 0).alias("positive"), F.count_if(F.col("signal") < 0).alias("negative"), F.countDistinct("source").alias("sources"))


_DOMAIN = (*categories.TERMS, "À suivre")


@query(f"SELECT d.category, count(a.doc_id) AS n FROM (VALUES {', '.join(f'({c!r})' for c in _DOMAIN)}) AS d(category) LEFT JOIN articles a ON a.category_hint = d.category GROUP BY d.category")
def category_histogram(spark, sf):
    """Counts over a stated domain: categories without articles have 0, others than these don't count."""
    domain = spark.createDataFrame([(c,) for c in _DOMAIN], "category string")
    counted = articles(spark, sf).groupBy("category_hint").agg(F.count("*").alias("n"))
    return domain.join(counted, F.col("category") == F.col("category_hint"), "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"""SELECT category_hint AS category, sha256(array_to_string(list_filter(list(summary ORDER BY {_ORDER}), lambda s: s <> '')[1:3], ' ')) AS brief_sha256
    FROM (SELECT *, row_number() OVER (PARTITION BY category_hint ORDER BY {_ORDER}) AS r FROM articles) WHERE r <= 5 GROUP BY category_hint"""
)
def category_briefs(spark, sf):
    """The first three summaries that say something, of each category's first five articles."""
    first = articles(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("category_hint").orderBy(*_newest()))).where("r <= 5")
    told = first.groupBy("category_hint").agg(F.sort_array(F.collect_list(F.struct("r", "summary"))).alias("rows"))  # five rows at most
    joined = F.array_join(F.slice(F.filter(F.transform("rows", lambda x: x["summary"]), lambda s: s != ""), 1, 3), " ")
    return told.select(F.col("category_hint").alias("category"), F.sha2(joined, 256).alias("brief_sha256"))


@query(
    f"""SELECT doc_id, day, rank FROM (SELECT doc_id, strftime(published_at, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(published_at, '%Y-%m-%d') ORDER BY {_ORDER}) AS rank
        FROM (SELECT *, {_norm("concat_ws(' ', title, summary)")} AS h FROM headlines) WHERE contains(h, 'sanctions') OR contains(h, 'vaccin') AND contains(h, 'essai')) WHERE rank <= 30"""
)
def watch_groups(spark, sf):
    """What a watch rule matches, by day, thirty of a day at most (the view's own limit)."""
    own = headlines(spark, sf).where(filters.watch_rule(filters.haystack(F.col("title"), F.col("summary")), "sanctions | vaccin + essai")).select("doc_id", "published_at", times.day_key(F.col("published_at")).alias("day"))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(*_newest()))).where("rank <= 30").select("doc_id", "day", "rank")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, scored, deduplicated and selected."""
    leaders = clustering.lexical_dedup(articles(spark, sf_dir), stop=STOP).where("doc_id = leader").select("doc_id")
    return selection.top_and_daily(_scored(spark, sf_dir).join(leaders, "doc_id", "left_semi"), "day", [F.desc("score"), F.desc("published_at"), F.col("doc_id")]).select("doc_id", "title", "source", "day", "score", "phase")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from newsloom.plans import access, digests, editorial, groups, pages, reader, stories  # noqa: E402, F401  (add their queries)
