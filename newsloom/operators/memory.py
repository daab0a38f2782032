"""Story memory: what an article adds to the stories that earlier refreshes remembered, and which remembered story it is.

A refresh judges all of its articles by the memory that the refreshes before it left, then adds them; a memory keeps
the newest `most` articles of a scope (a reader, a language) for so many days. So an article's memory is a run of the
places of all articles of its scope in order: those are ranked in blocks, memories are cut into slots of `most` places,
and an article looks into two slots, by its tokens. It meets `most` stories at most, whatever the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import novelty as precise
from newsloom.operators.editorial import compatible_categories
from newsloom.operators.selection import ranked
from newsloom.storage import cut


@dataclass(frozen=True)
class Likeness:
    """When two arrays of tokens tell one story, and how alike they are: by the share of the smaller and of the union."""

    common: int
    coverage: float
    jaccard: float | None  # None: only coverage counts
    by_coverage: float
    by_jaccard: float
    least_tokens: int

    def holds(self, common: Column, coverage: Column, jaccard: Column) -> Column:
        near = coverage >= self.coverage
        return (common >= self.common) & (near if self.jaccard is None else near | (jaccard >= self.jaccard))

    def score(self, coverage: Column, jaccard: Column) -> Column:
        return coverage * self.by_coverage + jaccard * self.by_jaccard


#: Likenesses of the three memories, what each keeps, and days within which stories compare.
REFINED = Likeness(3, 0.56, 0.36, 0.65, 0.35, 3)
RELATED = Likeness(3, 0.56, 0.38, 0.65, 0.35, 3)
LOOKED_UP = Likeness(4, 0.58, None, 0.7, 0.3, 4)
MEMORY_DAYS, REFINED_MOST, RELATED_MOST, RELATED_DAYS, STORY_DAYS = 10, 320, 260, 7, 14
NEW_POINTS = 8


def best_earlier(articles: DataFrame, like: Likeness, most: int, *, days: int = MEMORY_DAYS, within_days: int | None = None) -> DataFrame:
    """articles (id, scope, refresh, published_at, tokens; ids are unique) -> id, previous_id and likeness of those with a story in memory.

    Of stories that are equally alike the one remembered first counts. refresh is a date; within_days bounds the time
    between both publications.
    """
    places = ranked(articles.select("id", "scope", "refresh", "published_at", "tokens"), [F.col("refresh"), F.col("id")], "place", "scope")
    first = places.groupBy("scope", "refresh").agg((F.min("place") - 1).alias("before"))  # a row for each refresh of a scope
    each = places.withColumn("size", F.size("tokens"))
    stories = each.where("size > 0").select("scope", F.floor((F.col("place") - 1) / most).alias("slot"), F.explode("tokens").alias("token"), F.col("id").alias("previous_id"), F.col("place").alias("previous_place"), F.col("refresh").alias("previous_refresh"), F.col("published_at").alias("previous_at"), F.col("size").alias("previous_size"))
    asking = each.where(F.col("size") >= like.least_tokens).join(first, ["scope", "refresh"]).where("before > 0")
    last = F.floor((F.col("before") - 1) / most)
    asking = asking.select("id", "scope", "refresh", "published_at", "before", "size", F.explode("tokens").alias("token"), F.array_distinct(F.array(last, F.greatest(last - 1, F.lit(0)))).alias("slots")).withColumn("slot", F.explode("slots"))
    met = asking.join(stories, ["scope", "slot", "token"]).where((F.col("previous_place") <= F.col("before")) & (F.col("previous_place") > F.col("before") - most) & (F.datediff("refresh", "previous_refresh") <= days))
    if within_days is not None:
        met = met.where(F.abs(F.unix_millis("published_at") - F.unix_millis("previous_at")) <= within_days * 86_400_000)
    pairs = met.groupBy("id", "previous_id").agg(F.count("*").alias("common"), F.first("size").alias("size"), F.first("previous_size").alias("previous_size"), F.first("previous_place").alias("previous_place"))
    coverage, jaccard = F.col("common") / F.least("size", "previous_size"), F.col("common") / (F.col("size") + F.col("previous_size") - F.col("common"))
    near = pairs.where(like.holds(F.col("common"), coverage, jaccard)).withColumn("likeness", like.score(coverage, jaccard))
    best = F.max_by(F.struct("previous_id", "likeness"), F.struct("likeness", -F.col("previous_place")))
    return near.groupBy("id").agg(best.alias("best")).select("id", "best.*")


def refine(articles: DataFrame, *, most: int = REFINED_MOST, days: int = MEMORY_DAYS) -> DataFrame:
    """articles (id, scope, refresh, title, published_at, tokens, facts, actions, entities) -> id, previous_id, state, delta, reason, confidence."""
    own = cut(articles.select("id", "scope", "refresh", "title", "published_at", "tokens", "facts", "actions", "entities"))  # its patterns are looked for once
    return verdicts(own, best_earlier(own, REFINED, most, days=days))


def verdicts(articles: DataFrame, matched: DataFrame) -> DataFrame:
    """The novelty of each article: against the story that it matched, or new without one, or without enough tokens for any."""
    report = F.struct("title", "published_at", "facts", "actions", "entities")
    told = articles.select("id", F.size("tokens").alias("size"), report.alias("current"))
    previous = articles.select(F.col("id").alias("previous_id"), report.alias("previous"))
    pairs = told.join(matched.select("id", "previous_id"), "id").join(previous, "previous_id")
    judged = precise.novelty(pairs).select("id", "previous_id", "state", "delta", "reason", "confidence")
    return judged.unionByName(unmatched(told.join(matched.select("id"), "id", "left_anti")), allowMissingColumns=True)


def unmatched(rows: DataFrame) -> DataFrame:
    """id and size -> the verdict on what is in no memory."""
    enough = F.col("size") >= REFINED.least_tokens
    return rows.select("id", F.lit("new").alias("state"), F.when(enough, NEW_POINTS).otherwise(0).alias("delta"), F.when(enough, "Nouvelle information").otherwise("").alias("reason"), F.lit("legacy").alias("confidence"))


def related(articles: DataFrame) -> DataFrame:
    """articles as for best_earlier() -> id, previous_id, likeness: the as-of best match within RELATED_DAYS."""
    return best_earlier(articles, RELATED, RELATED_MOST, within_days=RELATED_DAYS)


def lexical_novelty(articles: DataFrame, matched: DataFrame) -> DataFrame:
    """articles (id, facts, specific) and related() -> id, state, score and new_facts, by facts and specific tokens that the story hadn't."""
    own = articles.select("id", "facts", "specific")
    old = articles.select(F.col("id").alias("previous_id"), F.col("facts").alias("old_facts"), F.col("specific").alias("old_specific"))
    told = own.join(matched.select("id", "previous_id"), "id", "left").join(old, "previous_id", "left")
    facts = F.when(F.col("previous_id").isNull(), F.size("facts")).otherwise(F.size(F.array_except("facts", "old_facts")))
    specific = F.size(F.array_except("specific", "old_specific"))
    verdict = lambda state, score: F.struct(F.lit(state).alias("state"), (score if isinstance(score, Column) else F.lit(score)).cast("int").alias("score"))
    found = F.when(F.col("previous_id").isNull(), verdict("new", 15)).when(facts >= 2, verdict("development", F.least(F.lit(30), 15 + facts * 4)))
    found = found.when((facts == 1) | (specific >= 3), verdict("development", 10)).when(specific >= 2, verdict("minor-update", 3)).otherwise(verdict("repeat", -20))
    return told.select("id", found.alias("v"), F.when(F.col("previous_id").isNull() | (facts >= 1), facts).otherwise(0).cast("long").alias("new_facts")).select("id", "v.*", "new_facts")


def remember(articles: DataFrame, *, most: int = REFINED_MOST, days: int = MEMORY_DAYS, now: Column) -> DataFrame:
    """The memory of each scope after the last refresh: of each id its newest row, of those the newest `most` that are young enough.

    Each block of a scope gives its newest rows first, so no scope is gathered.
    """
    newest = Window.partitionBy("scope", "id").orderBy(F.desc("refresh"))
    own = articles.where("id is not null").withColumn("_r", F.row_number().over(newest)).where(F.col("_r") == 1).where(F.datediff(now, "refresh") <= days)
    salted = own.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    keep = lambda rows, *keys: rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("refresh"), F.desc("id")))).where(F.col("_r") <= most)
    return keep(keep(salted, "scope", "_salt"), "scope").drop("_r", "_salt")


def find_story(articles: DataFrame, stories: DataFrame) -> DataFrame:
    """articles (id, key, category, tokens) and stories (story, key, category, tokens, place) -> id, story and how: key, alike or null.

    A story with the article's key is taken first; only articles without one are compared, with the stories that share
    tokens with them. Of equal ones the story with the largest place is taken.
    """
    exact = stories.groupBy("key").agg(F.max_by("story", "place").alias("story"))
    keyed = articles.join(exact, "key", "left")
    known = keyed.where("story is not null").select("id", "story", F.lit("key").alias("how"))
    rest = keyed.where("story is null").drop("story")
    words = stories.select("story", "place", F.col("category").alias("story_category"), F.size("tokens").alias("story_size"), F.explode("tokens").alias("token"))
    asking = rest.where(F.size("tokens") >= LOOKED_UP.least_tokens).select("id", "category", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    pairs = asking.join(words, "token").groupBy("id", "story").agg(F.count("*").alias("common"), *[F.first(c).alias(c) for c in ("category", "story_category", "size", "story_size", "place")])
    coverage, jaccard = F.col("common") / F.least("size", "story_size"), F.col("common") / (F.col("size") + F.col("story_size") - F.col("common"))
    near = pairs.where(LOOKED_UP.holds(F.col("common"), coverage, jaccard) & compatible_categories(F.col("story_category"), F.col("category")))
    best = near.groupBy("id").agg(F.max_by("story", F.struct(LOOKED_UP.score(coverage, jaccard), "place")).alias("story")).withColumn("how", F.lit("alike"))
    none = rest.join(best, "id", "left_anti").select("id", F.lit(None).cast(stories.schema["story"].dataType).alias("story"), F.lit(None).cast("string").alias("how"))
    return known.unionByName(best.select("id", "story", "how")).unionByName(none)


def story_key(event_key: Column, url: Column, tokens: Column, own_id: Column) -> Column:
    """event: and the event's key, or else url: and the address, or else title: and the first tokens (the id without any)."""
    event, words = text.normalise(event_key, "%€$"), F.array_join(F.slice(tokens, 1, 8), "-")
    named = F.coalesce(F.nullif(words, F.lit("")), own_id.cast("string"))
    return F.when(event != "", F.concat(F.lit("event:"), event)).when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("url:"), url)).otherwise(F.concat(F.lit("title:"), named))
