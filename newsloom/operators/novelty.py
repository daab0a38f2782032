"""What an article adds to what is already known: novelty against a previous report, sentence deltas, revisions, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators.events import says

#: Recapitulations, and what a title says has newly happened.
RECAP = r"\b(ce que l['’]on sait|ce qu['’]il faut savoir|récap|retour sur|tout comprendre|en images|revivez)\b"
MARKERS = (
    ("investigation", r"\b(enquête (?:ouverte|lancée)|perquisition|audition judiciaire)\b"),
    ("custody", r"\b(mise en examen|placé en garde à vue|arrestation|interpellation)\b"),
    ("aid", r"\b(aide humanitaire|débloque?.{0,40}\b(?:fonds|millions?|milliards?)|fonds d['’]urgence)\b"),
    ("agreement", r"\b(accord (?:signé|conclu|trouvé)|cessez[- ]le[- ]feu (?:signé|accepté)|négociations? aboutissent?)\b"),
    ("sanctions", r"\b(nouvelles sanctions?|sanctions? (?:entrent|entrée) en vigueur|paquet de sanctions?)\b"),
    ("resignation", r"\b(démissionne|démission annoncée|quitte (?:son poste|le gouvernement))\b"),
    ("decision", r"\b(adopte|vote|rejette|valide|annule|interdit|autorise|condamne|acquitte)\b"),
    ("official", r"\b(officialise|confirmation officielle|entre en vigueur)\b"),
)
#: Actions that only announce; novelty states with their points.
ANNOUNCING = r"^(annonc|present|devoil|publi|lanc)"
REPEAT_RECAP, DEVELOPMENT, NEW_ACTION, MINOR, CONCURRENT, KNOWN = -24, 16, 14, 5, -20, -16
FACT_MINUTES, ACTION_MINUTES, MINOR_MINUTES, ENTITY_MINUTES, CONCURRENT_MINUTES = 60, 90, 30, 120, 30


def markers(title: Column) -> Column:
    own = text.clean(title)
    return F.filter(F.array(*[F.when(says(own, p), F.lit(name)) for name, p in MARKERS]), lambda x: x.isNotNull())


def _plain(values: Column) -> Column:
    return F.array_distinct(F.transform(values, lambda v: text.fold(text.clean(v))))


def _new(values: Column, previous: Column) -> Column:
    """Distinct values (cleaned, not empty) whose folded form previous doesn't hold."""
    own = F.array_distinct(F.filter(F.transform(values, text.clean), lambda v: v != ""))
    known = _plain(previous)
    return F.filter(own, lambda v: ~F.array_contains(known, text.fold(v)))


def novelty(pairs: DataFrame, current: str = "current", previous: str = "previous") -> DataFrame:
    """pairs with structs of title, published_at, facts, actions and entities -> with state, delta, reason, confidence and gap_minutes.

    A null array is empty; without both dates there is no gap, and rules that want one don't apply.
    """
    none = F.array().cast("array<string>")
    field = lambda side, name: F.coalesce(F.col(f"{side}.{name}"), none)
    fresh = lambda name: _new(field(current, name), field(previous, name))
    told = pairs.withColumn("_facts", fresh("facts")).withColumn("_actions", fresh("actions")).withColumn("_entities", fresh("entities"))
    told = told.withColumn("_markers", F.array_except(markers(F.col(f"{current}.title")), markers(F.col(f"{previous}.title"))))
    now, before = F.col(f"{current}.published_at"), F.col(f"{previous}.published_at")
    told = told.withColumn("gap_minutes", F.floor((F.unix_millis(now) - F.unix_millis(before)) / 60_000 + 0.5))
    gap, facts, entities = F.col("gap_minutes"), F.size("_facts"), F.size("_entities")
    after = lambda minutes: F.coalesce(gap >= minutes, F.lit(False))
    changed = (F.size(field(current, "facts")) > 0) & (F.size(field(previous, "facts")) > 0) & (F.array_sort(_plain(field(current, "facts"))) != F.array_sort(_plain(field(previous, "facts"))))
    acting = F.size(F.filter("_actions", lambda a: ~text.fold(a).rlike(ANNOUNCING))) > 0
    concurrent = F.coalesce(F.abs(gap) < CONCURRENT_MINUTES, F.lit(False)) & (changed | (facts > 0) | (entities > 0))
    verdict = lambda state, delta, reason, confidence: F.struct(F.lit(state).alias("state"), (delta if isinstance(delta, Column) else F.lit(delta)).cast("int").alias("delta"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"))
    rules = [
        (says(text.clean(F.col(f"{current}.title")), RECAP), verdict("repeat", REPEAT_RECAP, "Récapitulatif", "high")),
        ((F.size("_markers") > 0) & F.coalesce(gap > 0, F.lit(True)), verdict("development", DEVELOPMENT, "Nouveau développement vérifiable", "high")),
        (changed & (facts > 0) & after(FACT_MINUTES), verdict("development", F.least(F.lit(6), facts * 2) + DEVELOPMENT, "Mise à jour factuelle postérieure", "high")),
        (acting & after(ACTION_MINUTES), verdict("development", NEW_ACTION, "Nouvelle action postérieure", "medium")),
        ((facts >= 2) & after(ACTION_MINUTES), verdict("development", NEW_ACTION, "Nouveaux faits postérieurs", "medium")),
        (((facts == 1) & after(MINOR_MINUTES)) | ((entities >= 2) & after(ENTITY_MINUTES)), verdict("minor-update", MINOR, "Nouvel élément mesuré", "medium")),
        (concurrent, verdict("repeat", CONCURRENT, "Réécriture ou version concurrente", "high")),
    ]
    first, then = rules[0], rules[1:]
    chain = reduce(lambda c, rule: c.when(rule[0], rule[1]), then, F.when(*first)).otherwise(verdict("repeat", KNOWN, "Information déjà connue", "medium"))
    return told.withColumn("_verdict", chain).select("*", "_verdict.*").drop("_verdict", "_facts", "_actions", "_entities", "_markers")


def coverage(a: Column, b: Column) -> Column:
    """Shared tokens over those of the smaller array; 0 if one is empty."""
    return text.containment(a, b)


def meaningful_change(a: Column, b: Column, state: Column) -> Column:
    """Whether two arrays of tokens differ enough, given the novelty state of the later; equal ones don't."""
    moved = state.isin("development", "minor-update") & (text.containment(a, b) < 0.92)
    return (F.array_sort(a) != F.array_sort(b)) & (F.coalesce(moved, F.lit(False)) | (text.containment(a, b) < 0.80) | (text.jaccard(a, b) < 0.68))


def sentence_delta(current: Column, previous: Column, *, least: int = 28, tokens_least: int = 4, known: float = 0.68, most: int = 2, shortest: int = 55, chars: int = 420) -> Column:
    """The first sentences of current that no sentence of previous covers, joined; empty if they are too short."""
    cut = lambda x: F.filter(text.sentences(text.clean(x)), lambda s: F.length(s) >= least)
    old = F.transform(cut(previous), lambda s: text.tokens(s))
    is_new = lambda s: (F.size(text.tokens(s)) >= tokens_least) & F.forall(old, lambda o: text.containment(text.tokens(s), o) < known)
    joined = F.array_join(F.slice(F.filter(cut(current), is_new), 1, most), " ")
    return F.when(F.length(joined) >= shortest, F.substring(joined, 1, chars)).otherwise("")


def revision(a: Column, b: Column, numbers_a: Column, numbers_b: Column) -> Column:
    """correction if the numbers have changed, updated if the words have, else unchanged (a: now, b: as read)."""
    return F.when(F.array_sort(F.array_distinct(numbers_a)) != F.array_sort(F.array_distinct(numbers_b)), "correction").when((text.containment(a, b) < 0.78) & (text.jaccard(a, b) < 0.68), "updated").otherwise("unchanged")


def retain(snapshots: DataFrame, story: str, at: str, now: Column, *, days: int = 14, stories: int = 180, each: int = 7, id_col: str = "id") -> DataFrame:
    """The newest `each` snapshots, not older than days, of the `stories` stories with the newest ones; of equal times the larger id."""
    young = snapshots.where(F.col(at) >= now - F.make_dt_interval(days=F.lit(days)))
    newest = young.groupBy(story).agg(F.max(F.struct(at, id_col)).alias("_newest")).orderBy(F.desc("_newest"), story).limit(stories).select(story)
    order = Window.partitionBy(story).orderBy(F.desc(at), F.desc(id_col))
    return young.join(newest, story, "left_semi").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each).drop("_rank")
