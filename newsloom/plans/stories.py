"""Queries of story memory: what headlines tell, what earlier stories they match, and what they add to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import stories, text
from newsloom.operators import editorial, memory, novelty
from newsloom.plans.adapters import AS_OF, headlines, now, reports
from newsloom.plans.registry import query
from newsloom.storage import cut

#: The last visit: what is older makes the stories that later articles are looked up in.
VISIT_DAYS, STORIES_MOST = 3, 180


def _clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(strip_accents(lower({_clean(x)})), '[^a-z0-9%€$]+', ' ', 'g'))"


def _quoted(pattern: str, flags: str = "(?i)") -> str:
    return "'" + flags + pattern.replace("'", "''") + "'"


def _first_sight(x: str) -> str:
    """Distinct values of a list in order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _marks(x: str, patterns) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, {_quoted(p)}) THEN '{name}' END" for name, p in patterns) + "], lambda v: v IS NOT NULL)"


_STOP = ", ".join(f"'{w}'" for w in stories.STORY_STOP)


def told_sql(source: str, columns: str) -> str:
    """CTEs that end in `told`: source (title, summary) with tokens, facts, actions and entities."""
    return rf"""
    cores AS (SELECT {columns}, title, trim(regexp_replace({_clean("title")}, '\s+[-–—|]\s+[^–—|]{{2,45}}$', '')) AS core, {_clean("summary")} AS said FROM {source}),
    words AS (SELECT *, concat_ws(' ', core, said) AS body, list_filter(string_split({_norm("core")}, ' '), lambda w: w <> '' AND w NOT IN ({_STOP}) AND (length(w) >= 4 OR regexp_matches(w, '[0-9]'))) AS raw FROM cores),
    found AS (SELECT *, {_first_sight("raw")}[1:{stories.TOKENS}] AS tokens,
        list_filter(list_transform(list_concat(regexp_extract_all(body, {_quoted(stories.FACT_NUMBER)}), regexp_extract_all(body, {_quoted(stories.FACT_DATE)})), lambda x: {_norm("x")}), lambda x: x <> '') AS raw_facts,
        {_marks("body", stories.ACTIONS)} AS actions,
        list_transform(list_filter(list_transform(regexp_extract_all(core, {_quoted(stories.ENTITY, "")}), lambda x: trim(regexp_replace(x, '(?i){stories.ENTITY_START}', ''))), lambda x: length(x) >= 4 AND x NOT IN ({", ".join(f"'{c}'" for c in stories.CATEGORIES)})), lambda x: {_clean("x")}) AS raw_entities FROM words),
    told AS (SELECT * EXCLUDE (raw, raw_facts, raw_entities), {_first_sight("raw_facts")}[1:{stories.FACTS}] AS facts, {_first_sight("raw_entities")}[1:{stories.ENTITIES}] AS entities,
        list_filter(tokens, lambda w: length(w) >= 6 OR regexp_matches(w, '[0-9]'))[1:14] AS specific FROM found)"""


_OWN = told_sql("headlines", "doc_id AS id, coalesce(lang, 'und') AS scope, CAST(published_at AS DATE) AS refresh, published_at, category_hint AS category")
_PLACED = _OWN + """,
    placed AS (SELECT *, len(tokens) AS size, row_number() OVER (PARTITION BY scope ORDER BY refresh, id) AS place, rank() OVER (PARTITION BY scope ORDER BY refresh) - 1 AS before FROM told),
    each AS (SELECT id, scope, refresh, published_at, size, place, before, unnest(tokens) AS token FROM placed)"""


def best_sql(like: memory.Likeness, most: int, within_days: int | None = None) -> str:
    """The CTE `best` after _PLACED: id, previous_id and likeness."""
    near = f"common / least(size, old_size) >= {like.coverage}" + (f" OR common / (size + old_size - common) >= {like.jaccard}" if like.jaccard else "")
    within = f" AND abs(epoch_ms(a.published_at) - epoch_ms(b.published_at)) <= {within_days * 86_400_000}" if within_days else ""
    return f""",
    met AS (SELECT a.id, b.id AS previous_id, any_value(a.size) AS size, any_value(b.size) AS old_size, any_value(b.place) AS old_place, count(*) AS common FROM each a JOIN each b ON a.scope = b.scope AND a.token = b.token
            WHERE a.size >= {like.least_tokens} AND b.place <= a.before AND b.place > a.before - {most} AND date_diff('day', b.refresh, a.refresh) <= {memory.MEMORY_DAYS}{within} GROUP BY a.id, b.id),
    near AS (SELECT *, common / least(size, old_size) * {like.by_coverage} + common / (size + old_size - common) * {like.by_jaccard} AS likeness FROM met WHERE common >= {like.common} AND ({near})),
    best AS (SELECT id, previous_id, likeness FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY likeness DESC, old_place) = 1)"""


def verdict_sql(pairs: str) -> str:
    """The CTE `judged` from pairs with c_ (current) and p_ (previous) columns: state, delta, reason and confidence."""
    fold = lambda x: f"strip_accents(lower({x}))"
    fresh = lambda name: f"list_filter(c_{name}, lambda v: NOT list_contains(list_transform(p_{name}, lambda o: {fold('o')}), {fold('v')}))"
    plain = lambda x: f"list_sort(list_distinct(list_transform({x}, lambda o: {fold('o')})))"
    say = lambda state, delta, reason, sure: f"{{'state': '{state}', 'delta': {delta}, 'reason': '{reason}', 'confidence': '{sure}'}}"
    n = novelty
    return f""",
    compared AS (SELECT *, CAST(floor((epoch_ms(c_at) - epoch_ms(p_at)) / 60000.0 + 0.5) AS BIGINT) AS gap, len({fresh("facts")}) AS facts, {fresh("actions")} AS acts, len({fresh("entities")}) AS entities,
        len(list_filter({_marks(_clean("c_title"), n.MARKERS)}, lambda m: NOT list_contains({_marks(_clean("p_title"), n.MARKERS)}, m))) AS marks,
        len(c_facts) > 0 AND len(p_facts) > 0 AND {plain("c_facts")} <> {plain("p_facts")} AS changed FROM {pairs}),
    judged AS (SELECT * , CASE
        WHEN regexp_matches({_clean("c_title")}, {_quoted(n.RECAP)}) THEN {say("repeat", n.REPEAT_RECAP, "Récapitulatif", "high")}
        WHEN marks > 0 AND gap > 0 THEN {say("development", n.DEVELOPMENT, "Nouveau développement vérifiable", "high")}
        WHEN changed AND facts > 0 AND gap >= {n.FACT_MINUTES} THEN {say("development", f"CAST(least(6, facts * 2) + {n.DEVELOPMENT} AS INTEGER)", "Mise à jour factuelle postérieure", "high")}
        WHEN len(list_filter(acts, lambda a: NOT regexp_matches({fold("a")}, '{n.ANNOUNCING}'))) > 0 AND gap >= {n.ACTION_MINUTES} THEN {say("development", n.NEW_ACTION, "Nouvelle action postérieure", "medium")}
        WHEN facts >= 2 AND gap >= {n.ACTION_MINUTES} THEN {say("development", n.NEW_ACTION, "Nouveaux faits postérieurs", "medium")}
        WHEN facts = 1 AND gap >= {n.MINOR_MINUTES} OR entities >= 2 AND gap >= {n.ENTITY_MINUTES} THEN {say("minor-update", n.MINOR, "Nouvel élément mesuré", "medium")}
        WHEN abs(gap) < {n.CONCURRENT_MINUTES} AND (changed OR facts > 0 OR entities > 0) THEN {say("repeat", n.CONCURRENT, "Réécriture ou version concurrente", "high")}
        ELSE {say("repeat", n.KNOWN, "Information déjà connue", "medium")} END AS v FROM compared)"""


_SIDE = lambda s: ", ".join(f"{s}.{c} AS {s}_{d}" for c, d in (("title", "title"), ("published_at", "at"), ("facts", "facts"), ("actions", "actions"), ("entities", "entities")))


def with_told(rows, title: str = "title", summary: str = "summary"):
    """rows with tokens, facts, actions, entities and specific."""
    head, said = F.col(title), F.col(summary)
    own = rows.withColumns({"tokens": stories.story_tokens(head), "facts": stories.facts(head, said), "actions": stories.actions(head, said), "entities": stories.entities(head)})
    return own.withColumn("specific", stories.specific_tokens(F.col("tokens")))


def _told(spark, sf):
    own = headlines(spark, sf).select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("und")).alias("scope"), F.to_date("published_at").alias("refresh"), "published_at", F.col("category_hint").alias("category"), "title", "summary")
    return with_told(own)


_KEY = rf"substring(concat_ws(':', {_norm('category')}, array_to_string(list_sort(list_filter(tokens, lambda w: length(w) >= 5 OR regexp_matches(w, '[0-9]'))[1:{stories.EVENT_TOKENS}]), '-')), 1, {stories.EVENT_CHARS})"


@query(f"WITH {_OWN} SELECT id AS doc_id, " + ", ".join(f"array_to_string({c}, '|') AS {c}" for c in ("tokens", "facts", "actions", "entities", "specific")) + f", {_KEY} AS event_key FROM told")
def story_facts(spark, sf):
    own = _told(spark, sf)
    return own.select(F.col("id").alias("doc_id"), *[F.array_join(c, "|").alias(c) for c in ("tokens", "facts", "actions", "entities", "specific")], stories.event_key(F.col("category"), F.col("tokens")).alias("event_key"))


@query(f"WITH {_PLACED}{best_sql(memory.RELATED, memory.RELATED_MOST, memory.RELATED_DAYS)} SELECT id AS doc_id, previous_id, round(likeness, 9) AS likeness FROM best")
def related_stories(spark, sf):
    """The most alike story that earlier days remembered, published within seven days of an article."""
    return memory.related(_told(spark, sf)).select(F.col("id").alias("doc_id"), "previous_id", F.round("likeness", 9).alias("likeness"))


@query(
    f"""WITH {_PLACED}{best_sql(memory.REFINED, memory.REFINED_MOST)},
    pairs AS (SELECT b.id, b.previous_id, {_SIDE('c')}, {_SIDE('p')} FROM best b JOIN told c ON c.id = b.id JOIN told p ON p.id = b.previous_id){verdict_sql("pairs")}
    SELECT t.id AS doc_id, j.previous_id, coalesce(v.state, 'new') AS state, CAST(coalesce(v.delta, CASE WHEN len(tokens) >= 3 THEN 8 ELSE 0 END) AS INTEGER) AS delta,
           coalesce(v.reason, CASE WHEN len(tokens) >= 3 THEN 'Nouvelle information' ELSE '' END) AS reason, coalesce(v.confidence, 'legacy') AS confidence FROM told t LEFT JOIN judged j ON j.id = t.id"""
)
def story_memory(spark, sf):
    """Each day judged by what the days before it remembered, by language: new, development, minor-update or repeat."""
    return memory.refine(_told(spark, sf)).withColumnRenamed("id", "doc_id")


@query(
    f"""WITH {_PLACED}{best_sql(memory.RELATED, memory.RELATED_MOST, memory.RELATED_DAYS)},
    c AS (SELECT t.id, b.previous_id, CASE WHEN p.id IS NULL THEN len(t.facts) ELSE len(list_filter(t.facts, lambda v: NOT list_contains(p.facts, v))) END AS facts, len(list_filter(t.specific, lambda v: NOT list_contains(p.specific, v))) AS specific
          FROM told t LEFT JOIN best b ON b.id = t.id LEFT JOIN told p ON p.id = b.previous_id)
    SELECT id AS doc_id, CASE WHEN previous_id IS NULL THEN 'new' WHEN facts >= 1 OR specific >= 3 THEN 'development' WHEN specific = 2 THEN 'minor-update' ELSE 'repeat' END AS state,
           CAST(CASE WHEN previous_id IS NULL THEN 15 WHEN facts >= 2 THEN least(30, 15 + 4 * facts) WHEN facts = 1 OR specific >= 3 THEN 10 WHEN specific = 2 THEN 3 ELSE -20 END AS INTEGER) AS score, CAST(facts AS BIGINT) AS new_facts FROM c"""
)
def lexical_novelty(spark, sf):
    own = _told(spark, sf)
    return memory.lexical_novelty(own, memory.related(own)).withColumnRenamed("id", "doc_id")


@query(f"SELECT coalesce(lang, 'und') AS scope, doc_id FROM headlines WHERE date_diff('day', CAST(published_at AS DATE), DATE '{AS_OF[:10]}') <= 10 QUALIFY row_number() OVER (PARTITION BY coalesce(lang, 'und') ORDER BY CAST(published_at AS DATE) DESC, doc_id DESC) <= {memory.REFINED_MOST}")
def remembered_stories(spark, sf):
    """What a memory by language holds after the last day: its newest 320 stories of ten days (the memory's own size)."""
    own = headlines(spark, sf).select(F.coalesce("lang", F.lit("und")).alias("scope"), F.col("doc_id").alias("id"), F.to_date("published_at").alias("refresh"))
    return memory.remember(own, now=now()).select("scope", F.col("id").alias("doc_id"))


_FAMILY_SQL = " OR ".join(f"(p.category IN ({', '.join(repr(c) for c in f)}) AND a.category IN ({', '.join(repr(c) for c in f)}))" for f in editorial.FAMILIES)


@query(
    f"""WITH {_OWN}, keyed AS (SELECT *, {_KEY} AS event_key FROM told),
    known AS (SELECT *, CASE WHEN {_norm("event_key")} <> '' THEN 'event:' || {_norm("event_key")} ELSE 'title:' || coalesce(nullif(array_to_string(tokens[1:8], '-'), ''), CAST(id AS VARCHAR)) END AS key FROM keyed),
    old AS (SELECT key, max(published_at) AS seen, arg_max(id, (published_at, id)) AS story FROM known WHERE published_at < TIMESTAMP '{AS_OF}' - INTERVAL {VISIT_DAYS} DAY GROUP BY key HAVING max(published_at) >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY),
    held AS (SELECT *, row_number() OVER (ORDER BY seen DESC, story DESC) AS place FROM old QUALIFY row_number() OVER (ORDER BY seen DESC, story DESC) <= {STORIES_MOST}),
    p AS (SELECT h.key, h.story, h.place, k.tokens, k.category FROM held h JOIN known k ON k.id = h.story),
    asked AS (SELECT * FROM known WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL {VISIT_DAYS} DAY),
    alike AS (SELECT a.id, p.story, p.place, len(list_intersect(a.tokens, p.tokens)) AS common, len(a.tokens) AS n, len(p.tokens) AS m FROM asked a JOIN p ON a.category = p.category OR {_FAMILY_SQL} WHERE len(a.tokens) >= 4),
    best AS (SELECT id, story FROM alike WHERE common >= 4 AND common / least(n, m) >= 0.58 QUALIFY row_number() OVER (PARTITION BY id ORDER BY common / least(n, m) * 0.7 + common / (n + m - common) * 0.3 DESC, place) = 1)
    SELECT a.id AS doc_id, coalesce(p.story, b.story) AS story, CASE WHEN p.story IS NOT NULL THEN 'key' WHEN b.story IS NOT NULL THEN 'alike' END AS how FROM asked a LEFT JOIN p ON p.key = a.key LEFT JOIN best b ON b.id = a.id"""
)
def story_lookup(spark, sf):
    """Articles since the last visit, looked up in the newest 180 stories before it (the store's own size): by event key, else by tokens."""
    own = _told(spark, sf)
    key = memory.story_key(stories.event_key(F.col("category"), F.col("tokens")), F.lit(""), F.col("tokens"), F.col("id"))
    known, visit = own.withColumn("key", key), now() - F.make_dt_interval(days=F.lit(VISIT_DAYS))
    newest = F.max_by(F.struct(F.col("id").alias("story"), "tokens", "category"), F.struct("published_at", "id"))
    old = known.where(F.col("published_at") < visit).groupBy("key").agg(F.max("published_at").alias("seen"), newest.alias("s")).where(F.col("seen") >= now() - F.make_dt_interval(days=F.lit(memory.STORY_DAYS)))
    held = old.select("key", "seen", "s.*").orderBy(F.desc("seen"), F.desc("story")).limit(STORIES_MOST)
    placed = held.withColumn("place", F.struct("seen", "story"))
    found = memory.find_story(known.where(F.col("published_at") >= visit).select("id", "key", "category", "tokens"), placed)
    return found.select(F.col("id").alias("doc_id"), "story", "how")




_STORY = r"trim(regexp_replace(strip_accents(lower(trim(regexp_replace(title, '\\s+', ' ', 'g')))), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""WITH {told_sql("reports", f"doc_id, published_at, {_STORY} AS story")},
    firsts AS (SELECT story, arg_min(doc_id, (published_at, doc_id)) AS first_id FROM told GROUP BY story),
    pairs AS (SELECT c.doc_id, p.doc_id AS first_id, {_SIDE("c")}, {_SIDE("p")} FROM told c JOIN firsts f ON f.story = c.story JOIN told p ON p.doc_id = f.first_id WHERE c.doc_id <> f.first_id){verdict_sql("pairs")}
    SELECT doc_id, first_id, gap AS gap_minutes, v.state AS state, v.delta AS delta, v.confidence AS confidence FROM judged"""
)
def story_novelty(spark, sf):
    """Each report of a story against its first one, by the facts, actions and entities of whole texts."""
    made = with_told(reports(spark, sf)).withColumn("story", text.normalise(F.col("title")))
    told = cut(made.select("doc_id", "story", "title", "published_at", "facts", "actions", "entities"))  # texts are read once
    report = F.struct("title", "published_at", "facts", "actions", "entities", "doc_id")
    first = told.groupBy("story").agg(F.min_by(report, F.struct("published_at", "doc_id")).alias("previous"))
    pairs = told.select("doc_id", "story", report.alias("current")).join(first, "story").where("doc_id <> previous.doc_id")
    return novelty.novelty(pairs).select("doc_id", F.col("previous.doc_id").alias("first_id"), "gap_minutes", "state", "delta", "confidence")
