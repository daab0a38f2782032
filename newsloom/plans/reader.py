"""Queries of what a reader sees: titles, addresses, summaries, images, access and labels, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.functions import text, times, urls
from newsloom.operators import filters, reader
from newsloom.plans.adapters import AS_OF, INTERACTIONS_SQL, interactions, now, read, teasers, sql_decoded, sql_stripped
from newsloom.plans.registry import _norm, query

COLUMN = F.col
BLOCKED_SOURCES, BLOCKED_TERMS = ["src1", "src2"], ["rend", "vaccin"]
WATCHED, EXCLUDED = "vr | sanctions + russie | Séisme", "blesses, treai"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def _quoted(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _is(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_quoted(pattern)})"


def _ordered(items: str) -> str:
    """Distinct items in order of first sight."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def _words(x: str, least: int, stop) -> str:
    return f"list_distinct(list_filter(string_split({_norm(x)}, ' '), lambda t: length(t) >= {least} AND t NOT IN ({', '.join(map(repr, stop))})))"


def _keep(x: str) -> str:
    return _norm(x).replace("[^a-z0-9]+", "[^a-z0-9%€$]+")


_ESCAPED = r"regexp_replace({0}, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g')".format(_clean("source"))
_WITHOUT = f"CASE WHEN {_clean('source')} = '' THEN {_clean('title')} ELSE trim(regexp_replace({_clean('title')}, '(?i)\\s*[-–—|·:]\\s*' || {_ESCAPED} || '\\s*$', '')) END"


@query(f"SELECT doc_id, {_WITHOUT} AS title FROM teasers")
def display_titles(spark, sf):
    return teasers(spark, sf).select("doc_id", text.display_title(COLUMN("title"), COLUMN("source")).alias("title"))


@query(
    f"""WITH d AS (SELECT doc_id, {_WITHOUT} AS own FROM teasers), t AS (SELECT *, regexp_extract(own, '\\s+[-–—|]\\s+[^–—|]{{2,42}}$') AS tail FROM d),
    s AS (SELECT doc_id, CASE WHEN {_is('tail', text.SITE_ENDS)} THEN trim(substring(own, 1, length(own) - length(tail))) ELSE own END AS title FROM t)
    SELECT doc_id, title, array_to_string(list_sort(list_distinct(regexp_extract_all({_norm('title')}, '\\b[0-9]+\\b'))), ' ') AS numbers FROM s"""
)
def story_titles(spark, sf):
    own = teasers(spark, sf).select("doc_id", text.story_title(COLUMN("title"), COLUMN("source")).alias("told"), text.title_numbers(COLUMN("title"), COLUMN("source")).alias("n"))
    return own.select("doc_id", COLUMN("told").alias("title"), F.array_join(F.array_sort("n"), " ").alias("numbers"))


_LONG_TITLE = f"substring(regexp_replace({_clean('title')}, '\\s+[-–—|]\\s+[^-–—|]{{2,60}}$', ''), 1, 220)"
_SOME = f"list_filter(string_split({_norm('plain')}, ' '), lambda w: w <> '' AND w NOT IN ({', '.join(map(repr, text.QUERY_STOP))}) AND (length(w) >= 4 OR regexp_matches(w, '[0-9]')))"


@query(
    f"""WITH p AS (SELECT doc_id, {_LONG_TITLE} AS plain FROM teasers), w AS (SELECT doc_id, plain, list_filter(string_split(plain, ' '), lambda x: x <> '') AS words, {_SOME} AS picked FROM p),
    v AS (SELECT doc_id, list_filter(['"' || plain || '"', plain, CASE WHEN len(words) > 10 THEN array_to_string(words[1:9], ' ') ELSE '' END, array_to_string({_ordered('picked')}[1:8], ' ')], lambda x: x <> '') AS ways FROM w)
    SELECT doc_id, array_to_string({_ordered('ways')}, chr(10)) AS ways FROM v"""
)
def query_variants(spark, sf):
    return teasers(spark, sf).select("doc_id", F.array_join(text.query_variants(COLUMN("title")), "\n").alias("ways"))


@query(
    f"""WITH p AS (SELECT doc_id, substring(regexp_replace({sql_stripped('title')}, '\\s+[-–—]\\s+[^-–—]{{2,90}}$', ''), 1, 240) AS own FROM teasers),
    t AS (SELECT doc_id, own, list_filter(list_transform(regexp_split_to_array(own, '\\s*[:：]\\s*'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM p),
    l AS (SELECT doc_id, own, CASE WHEN len(parts) > 1 THEN parts[-1] ELSE own END AS tail FROM t)
    SELECT doc_id, CASE WHEN len(list_filter(string_split(tail, ' '), lambda x: x <> '')) >= 6 THEN tail ELSE own END AS subject FROM l"""
)
def search_subjects(spark, sf):
    return teasers(spark, sf).select("doc_id", text.search_subject(COLUMN("title")).alias("subject"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM teasers")
def escaped_titles(spark, sf):
    return teasers(spark, sf).select("doc_id", text.escape_html(COLUMN("title")).alias("escaped"))


@query(
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({sql_decoded('summary')}, '\\s{{2,}}'), lambda x: {_clean('x')}), lambda x: x <> '') AS parts FROM teasers)
    SELECT doc_id, array_to_string(list_filter(parts, lambda x, i: i % 2 = 1)[1:5], chr(10)) AS titles FROM p WHERE len(parts) >= 4"""
)
def aggregate_titles(spark, sf):
    """Summaries that are made of several titles, and the titles."""
    own = teasers(spark, sf).select("doc_id", text.aggregate_headlines(COLUMN("summary")).alias("t"))
    return own.where(F.size("t") > 0).select("doc_id", F.array_join("t", "\n").alias("titles"))


@query(f"SELECT doc_id, CASE WHEN {_is(_clean('summary'), text.PLACEHOLDER)} THEN '' ELSE {_clean('summary')} END AS summary FROM teasers")
def known_summaries(spark, sf):
    return teasers(spark, sf).select("doc_id", text.without_placeholder(COLUMN("summary")).alias("summary"))


def _told(chars: int) -> str:
    return _keep(f"coalesce(title, '') || '|' || substring(coalesce(summary, ''), 1, {chars})")


@query(f"SELECT doc_id, sha256({_told(1200)}) AS content, sha256({_told(420)}) AS snapshot FROM teasers")
def text_fingerprints(spark, sf):
    digest = lambda n: F.sha2(text.fingerprint(COLUMN("title"), COLUMN("summary"), n), 256)
    return teasers(spark, sf).select("doc_id", digest(1200).alias("content"), digest(420).alias("snapshot"))


_WEB = "'(?i)^(https?)://([^/?#]+)([^?#]*)(?:\\?([^#]*))?(?:#.*)?$'"


def _sorted(x: str) -> str:
    parts = f"string_split(regexp_extract({x}, {_WEB}, 4), '&')"
    kept = f"list_sort(list_filter(list_transform({parts}, lambda p, i: {{'n': split_part(p, '=', 1), 'i': i, 'p': p}}), lambda s: s.p <> '' AND NOT regexp_matches(s.p, {_quoted(urls.CAMPAIGN)})))"
    query_part = f"array_to_string(list_transform({kept}, lambda s: s.p), '&')"
    path = f"regexp_replace(regexp_extract({x}, {_WEB}, 3), '/$', '')"
    return f"CASE WHEN regexp_matches({x}, {_WEB}) THEN lower(regexp_extract({x}, {_WEB}, 1)) || '://' || lower(regexp_extract({x}, {_WEB}, 2)) || CASE {path} WHEN '' THEN '/' ELSE {path} END || CASE {query_part} WHEN '' THEN '' ELSE '?' || {query_part} END ELSE {x} END"


_TITLE_KEY = f"{_norm('source')} || '|' || {_norm('title')}"
_HOST = "regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)"


def _site(x: str) -> str:
    return f"regexp_replace(regexp_replace(strip_accents(lower({_clean(x)})), '{urls.SOURCE_NOISE}', ' ', 'g'), '[^a-z0-9]+', '', 'g')"


@query(
    f"""WITH k AS (SELECT *, {_sorted('trim(url)')} AS canonical, {_sorted('trim(image)')} AS picture FROM teasers)
    SELECT doc_id, canonical, CASE WHEN {_norm('title')} = '' THEN '' ELSE {_TITLE_KEY} END AS title_key, CASE WHEN canonical <> '' THEN 'url:' || canonical ELSE 'text:' || {_TITLE_KEY} END AS article_key,
           sha256('photo-v1|' || CASE WHEN canonical <> '' THEN canonical WHEN picture <> '' THEN picture ELSE source || '|' || title END) AS photo_key,
           regexp_extract(url, '^https?://news[.]google[.]com/(?:[^?#]*/)?(?:articles|read)/+([^/?#]+)', 1) AS aggregator_id,
           {_site('source')} <> '' AND {_HOST} <> '' AND (contains({_site(_HOST)}, {_site('source')}) OR contains({_site('source')}, {_site(_HOST)})) AS source_agrees FROM k"""
)
def article_keys(spark, sf):
    """Identities of an article; photo keys are those of rows without an id."""
    url, source, title = COLUMN("url"), COLUMN("source"), COLUMN("title")
    return teasers(spark, sf).select(
        "doc_id",
        urls.sorted_canonical(url).alias("canonical"),
        urls.title_key(source, title).alias("title_key"),
        urls.article_key(url, source, title).alias("article_key"),
        urls.photo_key(url, F.lit(""), COLUMN("image"), source, title).alias("photo_key"),
        urls.aggregator_id(url).alias("aggregator_id"),
        urls.source_agrees(url, source).alias("source_agrees"),
    )


@query(f"SELECT doc_id, TRY_CAST(nullif(trim(dated), '') AS TIMESTAMP) AS known_at, coalesce(TRY_CAST(nullif(trim(dated), '') AS TIMESTAMP), TIMESTAMP '{AS_OF}') AS at FROM teasers")
def safe_dates(spark, sf):
    dated = COLUMN("dated")
    return teasers(spark, sf).select("doc_id", times.safe_date(dated).alias("known_at"), times.safe_date(dated, now()).alias("at"))


_MINUTES = f"CAST(floor((epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(published_at)) / 60000.0 + 0.5) AS BIGINT)"


@query(
    f"""SELECT doc_id, CASE WHEN m < 1 THEN 'À l’instant' WHEN m < 60 THEN 'Il y a ' || m || ' min' WHEN m < 1440 THEN 'Il y a ' || m // 60 || ' h' WHEN m < 2880 THEN 'Hier, ' || strftime(published_at, '%H:%M')
        ELSE day(published_at) || ' ' || list_extract({list(times.MONTHS)!r}, CAST(month(published_at) AS INTEGER)) END AS label, m < 30 AS fresh FROM (SELECT *, {_MINUTES} AS m FROM teasers)"""
)
def time_labels(spark, sf):
    at = COLUMN("published_at")
    return teasers(spark, sf).select("doc_id", times.time_label(at, now()).alias("label"), times.fresh_within(at, now()).alias("fresh"))


_SUMMARY = _clean("summary")
_CUT = f"({_is(_SUMMARY, reader.CUT_SIGNS)} OR {_is(_SUMMARY, reader.CUT_WORDS)} OR {_is(_SUMMARY, reader.CUT_MARK)})"


@query(
    f"""SELECT doc_id, length({_SUMMARY}) >= 55 AND NOT {_is(_SUMMARY, reader.UNAVAILABLE)} AS useful, {_CUT} AS visibly_cut, length({_SUMMARY}) < 55 OR {_CUT} OR {_is(_SUMMARY, reader.NO_SUMMARY)} AS cut_short,
        {_is(f"{_clean('title')} || ' ' || {_SUMMARY}", reader.PAYWALL)} AS paywalled FROM teasers"""
)
def summary_states(spark, sf):
    summary = COLUMN("summary")
    return teasers(spark, sf).select("doc_id", reader.useful_summary(summary).alias("useful"), reader.visibly_cut(summary).alias("visibly_cut"), reader.cut_short(summary).alias("cut_short"), reader.paywalled(COLUMN("title"), summary).alias("paywalled"))


_PAGE = "'^https?://([^/:?#]+)(?::[0-9]+)?([^?#]*)(\\?[^#]*)?'"
_SITE, _PATH = f"regexp_replace(lower(regexp_extract(url, {_PAGE}, 1)), '^www\\.', '')", f"lower(regexp_extract(url, {_PAGE}, 2))"
_VIDEO = f"({_is(_SITE, reader.VIDEO_HOST)} OR {_is('trim(source)', reader.VIDEO_SOURCE)} OR {_is('trim(title)', reader.VIDEO_TITLE)} AND ({_is(_PATH, reader.VIDEO_PATH)} OR length({_SUMMARY}) < 220))"


@query(f"SELECT doc_id FROM teasers WHERE {_VIDEO}")
def video_only(spark, sf):
    return teasers(spark, sf).where(reader.video_only(COLUMN("title"), COLUMN("summary"), COLUMN("url"), COLUMN("source"))).select("doc_id")


_TOLD = f"lower(regexp_extract(image, {_PAGE}, 1) || regexp_extract(image, {_PAGE}, 2) || regexp_extract(image, {_PAGE}, 3))"
_NO_WEB = "NOT regexp_matches(image, '^https?://[^/:?#]+')"
_STATE = "CASE WHEN custom_source THEN 'ready' WHEN trim(image) <> '' THEN 'candidate' ELSE 'missing' END"


@query(f"SELECT doc_id, {_NO_WEB} OR {_is(_TOLD, reader.BAD_PATH)} OR {_is(_TOLD, reader.BAD_IMAGE)} AS bad, {_NO_WEB} OR {_is(_TOLD, reader.GENERIC_IMAGE)} OR {_is(f'regexp_extract(image, {_PAGE}, 1)', reader.GENERIC_HOST)} AS generic FROM teasers")
def image_checks(spark, sf):
    return teasers(spark, sf).select("doc_id", reader.bad_image(COLUMN("image")).alias("bad"), reader.generic_image(COLUMN("image")).alias("generic"))


@query(f"SELECT {_STATE} AS state, count(*) AS n, replace(printf('%.1f', 100.0 * count(*) / (SELECT count(*) FROM teasers)), '.', ',') AS share FROM teasers GROUP BY 1")
def image_states(spark, sf):
    """Images by state, with their share in per cent; rows with images of their own sources count as ready."""
    counted = teasers(spark, sf).groupBy(reader.image_state(COLUMN("custom_source"), COLUMN("image")).alias("state")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # of three rows
    return counted.select("state", "n", F.replace(F.format_number(100.0 * F.col("n") / total, 1), F.lit("."), F.lit(",")).alias("share"))


_TOPIC = _norm("concat_ws(' ', title, summary, category_hint, source)")
_LAST = "last AS (SELECT doc_id, arg_max(action, (ts, event_id)) AS action FROM interactions GROUP BY doc_id)"
_SHOWN = f"""{INTERACTIONS_SQL}, {_LAST}, shown AS (SELECT * FROM teasers WHERE published_at >= date_trunc('month', TIMESTAMP '{AS_OF}') - INTERVAL 1 MONTH AND NOT {_VIDEO}
    AND {_norm('source')} NOT IN ({', '.join(map(repr, BLOCKED_SOURCES))}) AND NOT ({' OR '.join(f"contains({_TOPIC}, '{t}')" for t in BLOCKED_TERMS)})
    AND doc_id NOT IN (SELECT doc_id FROM last WHERE action = 'not'))"""


def _shown(spark, sf):
    told = interactions(spark, sf).select("doc_id", "action", COLUMN("ts").alias("at"), "event_id")
    return reader.visible(teasers(spark, sf), times.history_start(now()), told, BLOCKED_SOURCES, BLOCKED_TERMS)


@query(f"WITH {_SHOWN} SELECT doc_id, published_at FROM shown")
def visible_articles(spark, sf):
    return _shown(spark, sf).select("doc_id", "published_at")


@query(
    f"""WITH {_SHOWN}, told AS (SELECT *, ' ' || {_TOPIC} || ' ' AS h FROM shown)
    SELECT count(*) AS watched, count(*) FILTER (WHERE published_at > TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY) AS new FROM told
    WHERE (contains(h, ' vr ') OR contains(h, 'sanctions') AND contains(h, 'russie') OR contains(h, 'seisme')) AND NOT contains(h, 'blesses') AND NOT contains(h, 'treai')"""
)
def watch_counts(spark, sf):
    """Visible articles that a watch rule matches, and those since it was last looked at."""
    hay = filters.haystack(COLUMN("title"), COLUMN("summary"), COLUMN("category_hint"), COLUMN("source"))
    own = _shown(spark, sf).where(filters.watch_rule(hay, WATCHED, EXCLUDED))
    return own.agg(F.count("*").alias("watched"), F.count_if(COLUMN("published_at") > now() - F.make_dt_interval(days=F.lit(2))).alias("new"))


@query(
    f"""WITH w AS (SELECT doc_id, {_words('summary', 3, text.VISUAL_STOP)} AS vf, {_words('title', 3, text.VISUAL_STOP)} AS vw, {_words('summary', 3, text.NEWS_STOP)} AS nf, {_words('title', 3, text.NEWS_STOP)} AS nw,
        {_words('summary', 3, text.PHOTO_STOP)} AS pf, {_words('title', 3, text.PHOTO_STOP)} AS pw FROM teasers),
    h AS (SELECT *, CAST(len(list_intersect(vw, vf)) AS BIGINT) AS v, CAST(len(list_intersect(nw, nf)) AS BIGINT) AS n, CAST(len(list_intersect(pw, pf)) AS BIGINT) AS p FROM w)
    SELECT doc_id, v AS visual_hits, coalesce(round(v / nullif(greatest(len(vw), len(vf)), 0), 6), 0.0) AS visual_score, n AS headline_hits,
           coalesce(round(n / nullif(least(len(nw), len(nf)), 0), 6), 0.0) AS shorter_coverage, coalesce(round(n / nullif(CASE WHEN len(nf) > 0 THEN len(nw) ELSE 0 END, 0), 6), 0.0) AS expected_coverage,
           coalesce(p / nullif(CASE WHEN len(pf) > 0 THEN len(pw) ELSE 0 END, 0), 0.0) >= 0.68 AND p >= least(4, len(pw)) OR p >= 5 AND coalesce(p / nullif(least(len(pw), len(pf)), 0), 0.0) >= 0.52 OR p >= 4 AND coalesce(p / nullif(least(len(pw), len(pf)), 0), 0.0) >= 0.66 AS same_event FROM h"""
)
def headline_agreements(spark, sf):
    """How far each summary speaks of its title: for images, for headlines and for photos."""
    words = lambda name, stop: text.tokens(COLUMN(name), 3, stop)
    agreed = lambda stop: text.agreement(words("summary", stop), words("title", stop))
    own = teasers(spark, sf).select("doc_id", agreed(text.VISUAL_STOP).alias("v"), agreed(text.NEWS_STOP).alias("n"), agreed(text.PHOTO_STOP).withField("wanted", F.size(words("title", text.PHOTO_STOP))).alias("p"))
    return own.select("doc_id", COLUMN("v.hits").alias("visual_hits"), F.round("v.of_longer", 6).alias("visual_score"), COLUMN("n.hits").alias("headline_hits"), F.round("n.of_shorter", 6).alias("shorter_coverage"), F.round("n.of_wanted", 6).alias("expected_coverage"), reader.same_photo_event(COLUMN("p")).alias("same_event"))


def _long_words(x: str) -> str:
    return f"list_filter(string_split({_norm(x)}, ' '), lambda t: length(t) >= 4 AND t NOT IN ({', '.join(map(repr, text.SUMMARY_STOP))}))[1:70]"


@query(
    f"""WITH w AS (SELECT doc_id, {_long_words('title')} AS a, {_long_words('summary')} AS b FROM teasers)
    SELECT doc_id, CASE WHEN len(a) < 5 OR len(list_distinct(b)) < 5 THEN 0.0 ELSE round(len(list_filter(a, lambda x: list_contains(b, x))) / len(a), 6) END AS ratio,
           coalesce(round(len(list_intersect(list_distinct(da), list_distinct(db))) / nullif(len(list_distinct(list_concat(da, db))), 0), 6), 0.0) AS jaccard
    FROM (SELECT w.*, {_long_words('title').removesuffix('[1:70]')} AS da, {_long_words('summary').removesuffix('[1:70]')} AS db FROM w JOIN teasers USING (doc_id))"""
)
def overlap_ratios(spark, sf):
    """Words of the title in the summary, by first words and by sets of all words."""
    title, summary = COLUMN("title"), COLUMN("summary")
    sets = [text.tokens(x, 4, text.SUMMARY_STOP) for x in (title, summary)]
    return teasers(spark, sf).select("doc_id", F.round(text.overlap_ratio(title, summary), 6).alias("ratio"), F.round(text.jaccard(*sets), 6).alias("jaccard"))


@query("SELECT event_id, greatest(1.0, least(50.0, CASE WHEN isfinite(v) THEN v ELSE 5.0 END)) AS bounded FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)", articles_view=False)
def bounded_values(spark, sf):
    """Values of events between 1 and 50; every seventh is a word and counts as 5."""
    raw = F.when(COLUMN("event_id") % 7 == 0, "many").otherwise(COLUMN("value").cast("string"))
    return read(spark, sf, "events").select("event_id", text.bounded(raw, 5.0, 1.0, 50.0).alias("bounded"))


_RANK, _NOVELTY, _SOURCES = "doc_id % 50", "CASE WHEN doc_id % 3 = 0 THEN 'development' ELSE 'new' END", "doc_id % 4"


@query(
    f"""WITH r AS (SELECT doc_id, {_RANK} AS rank, {_NOVELTY} AS novelty, {_SOURCES} AS sources FROM documents), e AS (SELECT *, rank >= 42 OR novelty = 'development' AND rank >= 34 OR sources >= 3 AND rank >= 36 AS essential FROM r)
    SELECT doc_id, essential, essential OR doc_id % 100 >= 94 AS protected FROM e""",
    articles_view=False,
)
def essential_flags(spark, sf):
    """With ranks, novelty, sources and scores made of the ids."""
    own = read(spark, sf, "documents").select("doc_id", reader.essential(F.expr(_RANK), F.expr(_NOVELTY), F.expr(_SOURCES)).alias("essential"))
    return own.withColumn("protected", reader.protected(COLUMN("essential"), F.lit(0), F.col("doc_id") % 100))
