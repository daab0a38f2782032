"""What a reader sees: video, summaries, images and access, as predicates over columns; the visible articles as a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import clean, js_regex, normalise, plain_topic

#: Hosts, paths, titles and sources of videos.
VIDEO_HOST = r"(^|\.)(youtube\.com|youtu\.be|dailymotion\.com|vimeo\.com|tiktok\.com|twitch\.tv)$"
VIDEO_PATH = r"/(?:video|videos|watch)(?:/|$)"
VIDEO_TITLE = r"^(?:vid[eé]o|en vid[eé]o|regardez|à voir en vid[eé]o|watch)\b"
VIDEO_SOURCE = r"^(?:youtube|dailymotion|vimeo|tiktok|twitch)$"
#: How a summary tells that it is missing or cut, and how a page tells that it has to be paid for.
UNAVAILABLE = r"résumé (?:détaillé )?momentanément indisponible|résumé indisponible|en cours de préparation|ouvrez? l[’']article|consultez? les? détails"
CUT_SIGNS = r"(?:\.{3}|…)\s*[»”\"']?\s*$"
CUT_WORDS = r"\b(?:lire la suite|read more|en savoir plus)\s*[.!…]*$"
CUT_MARK = r"[-–—,:;/(]\s*$"
NO_SUMMARY = r"résumé (?:ia )?(?:momentanément )?indisponible"
PAYWALL = r"(?:réservé(?:e)?\s+aux?\s+abonnés?|contenu\s+(?:est\s+)?réservé|article\s+réservé|accès\s+réservé|pour\s+lire\s+la\s+suite[^.]{0,60}(?:abonn|connect)|abonnez[- ]?vous\s+pour\s+(?:lire|accéder|continuer)|déjà\s+abonné|offre\s+d['’]abonnement|premium\s+(?:article|content)|subscribers?\s+only|members?\s+only|cet\s+article\s+est\s+réservé)"
#: Images that aren't of an article.
BAD_PATH = r"/api/(?:article-thumbnail|exact-news-thumbnail)(?:\?|$)"
BAD_IMAGE = r"(favicon|(?:^|[/_\-.])logo(?:[/_\-.]|$)|avatar|sprite|wordmark|brandmark|site-logo|tracking|pixel|badge|emoji|author[-_]?photo|profile[-_]?photo)"
GENERIC_IMAGE = r"(favicon|/logo(?:[._/-]|$)|logo[-_.]|icon[-_.]|/icon(?:[._/-]|$)|avatar|sprite|wordmark|brandmark|site-logo|google[-_ ]?news|googlenews|google_actualites|google-actualites)"
GENERIC_HOST = r"^(?:news\.google\.com|www\.google\.com|.*\.gstatic\.com|.*\.googleusercontent\.com)$"
_WEB = r"^https?://([^/:?#]+)(?::[0-9]+)?([^?#]*)(\?[^#]*)?"


def _is(x: Column, pattern: str) -> Column:
    return F.coalesce(x.rlike("(?iu)" + js_regex(pattern)), F.lit(False))


def video_only(title: Column, summary: Column, url: Column, source: Column) -> Column:
    """Of a video host or source, or with a video's title and either its path or a short summary."""
    site = F.regexp_replace(F.lower(F.regexp_extract(url, _WEB, 1)), r"^www\.", "")
    path = F.lower(F.regexp_extract(url, _WEB, 2))
    short = F.length(clean(summary)) < 220
    return _is(site, VIDEO_HOST) | _is(F.trim(source), VIDEO_SOURCE) | (_is(F.trim(title), VIDEO_TITLE) & (_is(path, VIDEO_PATH) | short))


def useful_summary(summary: Column) -> Column:
    own = clean(summary)
    return (F.length(own) >= 55) & ~_is(own, UNAVAILABLE)


def visibly_cut(summary: Column) -> Column:
    own = clean(summary)
    return _is(own, CUT_SIGNS) | _is(own, CUT_WORDS) | _is(own, CUT_MARK)


def cut_short(summary: Column) -> Column:
    own = clean(summary)
    return (F.length(own) < 55) | visibly_cut(summary) | _is(own, NO_SUMMARY)


def paywalled(*texts: Column) -> Column:
    """Whether title, summary or detail say that reading has to be paid for."""
    return _is(F.concat_ws(" ", *[F.nullif(clean(t), F.lit("")) for t in texts]), PAYWALL)


def bad_image(url: Column) -> Column:
    """A logo, a portrait, a pixel or no web address."""
    told = F.lower(F.concat(*[F.regexp_extract(url, _WEB, k) for k in (1, 2, 3)]))
    return ~_is(url, _WEB) | _is(told, BAD_PATH) | _is(told, BAD_IMAGE)


def generic_image(url: Column) -> Column:
    """A logo or icon, of the aggregator's hosts, or no web address."""
    told = F.lower(F.concat(*[F.regexp_extract(url, _WEB, k) for k in (1, 2, 3)]))
    return ~_is(url, _WEB) | _is(told, GENERIC_IMAGE) | _is(F.lower(F.regexp_extract(url, _WEB, 1)), GENERIC_HOST)


def image_state(verified: Column, image: Column) -> Column:
    return F.when(F.coalesce(verified, F.lit(False)), "ready").when(clean(image) != "", "candidate").otherwise("missing")


def protected(essential: Column, importance: Column, score: Column) -> Column:
    return F.coalesce(essential, F.lit(False)) | F.coalesce(importance >= 90, F.lit(False)) | F.coalesce(score >= 94, F.lit(False))


def essential(rank: Column, novelty: Column, sources: Column) -> Column:
    """By rank: 42, 34 for a development, 36 with three sources."""
    return (rank >= 42) | (F.coalesce(novelty == "development", F.lit(False)) & (rank >= 34)) | ((sources >= 3) & (rank >= 36))


def same_photo_event(words: Column) -> Column:
    """Of text.agreement() with the number of wanted words: most of them, or enough of the shorter title's."""
    return ((words["of_wanted"] >= 0.68) & (words["hits"] >= F.least(F.lit(4), words["wanted"]))) | ((words["hits"] >= 5) & (words["of_shorter"] >= 0.52)) | ((words["hits"] >= 4) & (words["of_shorter"] >= 0.66))


def visible(articles: DataFrame, since: Column, feedback: DataFrame, blocked_sources: list[str], blocked_terms: list[str]) -> DataFrame:
    """Articles since a time that aren't video only, whose last feedback isn't `not`, and that no blocked source or term meets.

    feedback has doc_id, action and the order at, event_id of actions. Terms of one character don't block.
    """
    last = feedback.groupBy("doc_id").agg(F.max_by("action", F.struct("at", "event_id")).alias("action")).where("action = 'not'").select("doc_id")
    told = normalise(F.concat_ws(" ", "title", "summary", "category_hint", "source"))
    shown = articles.where((F.col("published_at") >= since) & ~video_only(F.col("title"), F.col("summary"), F.col("url"), F.col("source")))
    shown = shown.where(~normalise(F.col("source")).isin(*blocked_sources)) if blocked_sources else shown
    terms = [t for t in map(plain_topic, blocked_terms) if len(t) >= 2]
    shown = shown.where(~told.rlike("|".join(terms))) if terms else shown
    return shown.join(last, "doc_id", "left_anti")
