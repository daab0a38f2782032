"""Scores of articles by column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.times import age_hours


#: Points of a preferred category, a matched keyword, a followed source, and the categories that get a few more.
PREFERRED, KEYWORD, CUSTOM, GENERAL_POINTS = 26.0, 28.0, 35.0, 6.0
GENERAL = ("Politique", "International", "Économie", "Santé")


def core_rank(at: Column, now: Column, category: Column, preferred: list[str], matches: Column, custom: Column) -> Column:
    """100, less an hour's point up to 96, plus what category, keywords and a followed source add."""
    points = lambda met, n: F.when(F.coalesce(met, F.lit(False)), n).otherwise(0.0)
    return F.lit(100.0) - F.least(age_hours(at, now), F.lit(96.0)) + points(category.isin(*preferred), PREFERRED) + KEYWORD * F.size(matches) + points(custom, CUSTOM) + points(category.isin(*GENERAL), GENERAL_POINTS)


def fast_rank(at: Column, now: Column, category: Column, preferred: list[str]) -> Column:
    """120, less an hour's point up to 96, plus 16 for a preferred category, rounded half up."""
    return F.floor(F.lit(120.0) - F.least(age_hours(at, now), F.lit(96.0)) + F.when(category.isin(*preferred), 16.0).otherwise(0.0) + 0.5).cast("long")


#: What a brief holds for major and for minor news, its categories, and its points.
MAJOR = "guerre|attaque|cessez-le-feu|élection|gouvernement|président|premier ministre|attentat|catastrophe|séisme|inondation|incendie|crise|accord|sommet|justice|budget|déficit|croissance|inflation|chômage|épidémie|climat|diplomatie|nucléaire|sanctions|traité|banque centrale|récession|pandémie"
MINOR = r"\bpsg\b|ligue 1|football|match|mercato|tennis|formule 1|promotion|bon plan|soldes?|réduction|console|smartphone|gta|jeu vidéo|people|célébrité|télé-réalité"
BRIEF_CATEGORIES = ("International", "Europe", "Politique", "Économie", "Société", "Santé", "Environnement", "Science")
BRIEF_STOP = ("avec", "apres", "avant", "dans", "depuis", "direct", "entre", "leurs", "nouveau", "nouvelle", "pour", "plus", "selon", "sont", "cette", "comme", "tout", "tous", "toute", "vers")
BRIEF_SHARED, BRIEF_SHARE = 2, 0.28


def brief_score(told: Column, at: Column, now: Column, category: Column, sources: Column) -> Column:
    """Of title and summary, age, category and the number of sources."""
    part = lambda met, yes, no=0.0: F.when(F.coalesce(met, F.lit(False)), yes).otherwise(no)
    return F.lit(100.0) + part(category.isin(*BRIEF_CATEGORIES), 55.0, -35.0) + 34.0 * F.greatest(sources - 1, F.lit(0)) + part(told.rlike(f"(?iu){MAJOR}"), 70.0) + part(told.rlike(f"(?iu){MINOR}"), -240.0) - F.least(1.6 * age_hours(at, now), F.lit(100.0))


def same_brief_event(a: Column, b: Column) -> Column:
    """Whether two arrays of title words share two or more, and enough of the smaller."""
    shared = F.size(F.array_intersect(a, b))
    return (shared >= BRIEF_SHARED) & (shared >= BRIEF_SHARE * F.greatest(F.lit(1), F.least(F.size(a), F.size(b))))


def badge(custom: Column, tagged: Column, score: Column) -> Column:
    return F.when(custom, "Source suivie").when(tagged, "À suivre").when(score >= 130, "Important").otherwise("Nouveau")


def information_state(summary: Column, title_coverage: Column, title_length: Column) -> Column:
    """missing, title_like or usable."""
    n = F.length(F.coalesce(summary, F.lit("")))
    return F.when(n < 32, "missing").when((title_coverage >= 0.85) & (n <= 1.8 * title_length), "title_like").otherwise("usable")


def seen_penalty(impressions: Column, opens: Column, last_at: Column, now: Column) -> Column:
    """7 an impression and 15 an opening, 46 at most; 7 more within two hours, 52 at most."""
    recent = F.coalesce(F.unix_millis(now) - F.unix_millis(last_at) < 2 * 3_600_000, F.lit(False))
    return F.least(F.lit(52), F.least(F.lit(46), 7 * impressions + 15 * opens) + F.when(recent, 7).otherwise(0))
