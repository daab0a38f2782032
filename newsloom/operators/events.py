"""Event clustering: headlines of one event are merged behind a representative that may change.

Two titles are compared by their event tokens. A token stands for all of its first five letters if it is long, so
matching tokens one to one is set intersection once each token carries its place among those that look alike
(`slots`). All of it is column arithmetic; pairs come from an equi-join on rare slots and time buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators.clustering import by_rarity, meet
from newsloom.storage import cut

GAP_HOURS, UPDATE_HOURS = 36, 2
MOST_TOKENS = 24
LEAST_TOKENS = LEAST_COMMON = 3
LEAST_COVERAGE = 0.5

#: Words that don't identify an event.
STOP = tuple(
    "avec dans pour plus apres avant cette cet ces sont etre leur leurs tout tous mais sans vers entre une des les sur qui que aux par son ses est fait font comme dont elle elles ils nous vous notre votre aussi encore deja tres moins depuis alors chez contre lors peut peuvent avait avoir sera un le la du de au en et ou ce se sa ne pas actualite direct video photos photo selon annonce nouvelle nouveau nouvelles nouveaux article sous".split()
)
#: Phrases of a normalised title and the word that stands for them, in order.
PHRASES = (
    (r"\bunion europeenne\b", "ue"),
    (r"\btourne(?:nt)? le dos\b", "outcome"),
    (r"\b(?:dit|disent|dites) non\b", "outcome"),
    (r"\bclaquent? la porte\b", "outcome"),
    (r"\b(?:coups? de feu|tirs? mortels?|fusillade)\b", "shooting"),
    (r"\b(?:naufrage|chavire\w*|coule au large)\b", "shipwreck"),
    (r"\b(?:ferry|bateau|navire|croisiere|chalutier)\b", "vessel"),
    (r"\b(?:crue|crues|inondation|inondations|coulee de boue)\b", "flood"),
)
#: Words by their beginning and what stands for them, first match wins.
STEMS = (
    (r"^islandais", "islande"),
    (r"^(?:non$|rejet|refus|emport|impos)", "outcome"),
    (r"^(?:referend|scrutin|vot)", "vote"),
    (r"^(?:negoci|adhes|integr|reouvert)", "negotiation"),
    (r"^(?:mort|victim|bless|disparu)", "casualty"),
    (r"^(?:reag|reaction|declar|salu|condamn)", "reaction"),
)
#: What a title says has newly happened.
DEVELOPMENTS = (
    ("reaction", r"\b(réagit|réaction|déclare|salue|condamne|réponse de|prise de position)\b"),
    ("aid", r"\b(aide humanitaire|débloque? .{0,35}\bfonds|fonds d['’]urgence|livraison d['’]aide)\b"),
    ("investigation", r"\b(enquête (?:ouverte|lancée)|mise en examen|perquisition|arrestation)\b"),
    ("agreement", r"\b(accord (?:signé|conclu|trouvé)|cessez[- ]le[- ]feu (?:signé|accepté)|adopte? un accord)\b"),
    ("resignation", r"\b(démissionne|démission annoncée|quitte (?:son poste|le gouvernement))\b"),
    ("sanctions", r"\b(nouvelles sanctions?|sanctions? (?:entrent|entrée) en vigueur|paquet de sanctions?)\b"),
)
#: Claims of casualties, and what makes a title a good representative or a source a poor one.
CASUALTIES = r"\b(\d{1,5})\s+(morts?|décès|victimes?|blessés?|disparus?)\b"
TOLL = r"\b(?:\d{1,4}|un|une|deux|trois|quatre|cinq|six|sept|huit|neuf|dix|vingt|cent)\s+(?:morts?|victimes?|blessés?|disparus?)\b"
EVENT_WORD = r"\b(?:référendum|naufrage|fusillade|crue|inondation|séisme|élection|accord|sanctions?)\b"
SOCIAL = r"^(?:facebook\.com|x\.com|twitter\.com|tiktok\.com|instagram\.com)$"
OUTCOMES = ("outcome", "vote", "negotiation")


def headline(title: Column) -> Column:
    """title, one blank for white space, without a trailing publisher after a dash or bar."""
    return F.trim(F.regexp_replace(text.clean(title), r"\s+[-–—|]\s+[^–—|]{2,45}$", ""))


def says(x: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(x, F.lit("(?iu)" + text.js_regex(pattern))), F.lit(False))


def canonical_token(word: Column) -> Column:
    return F.coalesce(*[F.when(word.rlike(pattern), F.lit(token)) for pattern, token in STEMS], word)


def event_tokens(title: Column) -> Column:
    """The first MOST_TOKENS distinct tokens of a headline."""
    plain = reduce(lambda x, rule: F.regexp_replace(x, rule[0], f" {rule[1]} "), PHRASES, text.normalise(headline(title)))
    words = F.transform(F.split(plain, " +"), canonical_token)
    kept = F.filter(words, lambda w: ~w.isin(*STOP) & ((F.length(w) >= 4) | (w == "ue")))
    return F.slice(F.array_distinct(kept), 1, MOST_TOKENS)


def slots(tokens: Column) -> Column:
    """A key for each token: what it is alike with, and how many such tokens come before it."""
    like = F.transform(tokens, lambda t: F.when(F.length(t) >= 6, F.concat(F.substring(t, 1, 5), F.lit("*"))).otherwise(t))
    return F.transform(like, lambda k, i: F.concat(k, F.lit("#"), F.size(F.filter(F.slice(like, F.lit(1), i), lambda x: x == k)).cast("string")))


def developments(title: Column) -> Column:
    own = headline(title)
    return F.filter(F.array(*[F.when(says(own, pattern), F.lit(name)) for name, pattern in DEVELOPMENTS]), lambda x: x.isNotNull())


def casualty_claims(title: Column) -> Column:
    found = F.regexp_extract_all(headline(title), F.lit("(?iu)" + text.js_regex(CASUALTIES)), F.lit(0))
    claim = lambda x: F.concat(F.regexp_extract(x, r"^(\d+)", 1).cast("int").cast("string"), F.lit(":"), canonical_token(text.normalise(F.regexp_replace(x, r"^\d+\s+", ""))))
    return F.array_sort(F.array_distinct(F.transform(found, claim)))


def quality_bonus(title: Column, source: Column) -> Column:
    """What a title and its source add to a tenth of the score."""
    own, n = headline(title), F.length(headline(title))
    given = lambda condition, points: F.when(condition, points).otherwise(0)
    poor = (n < 24) | own.rlike(r"^[-–—\s]+")
    return given(n.between(45, 210), 4) + given(says(own, TOLL), 8) + given(says(own, EVENT_WORD), 5) - given(says(text.clean(source), SOCIAL), 25) - given(poor, 20)


def event_view(articles: DataFrame) -> DataFrame:
    """articles (doc_id, title, source, published_at, score) -> id, at (ms, 0 if unknown), tokens, slots, n, markers, claims, bonus, score."""
    own = articles.select(F.col("doc_id").alias("id"), F.coalesce(F.unix_millis("published_at"), F.lit(0)).alias("at"), event_tokens(F.col("title")).alias("tokens"), developments(F.col("title")).alias("markers"), casualty_claims(F.col("title")).alias("claims"), quality_bonus(F.col("title"), F.col("source")).cast("double").alias("bonus"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return own.withColumn("slots", slots(F.col("tokens"))).withColumn("n", F.size("tokens"))


def material_development(a: str, b: str) -> Column:
    """Whether one of two structs tells what the other doesn't yet know."""
    x, y = F.col(a), F.col(b)
    marked = (F.size(x["markers"]) + F.size(y["markers"]) > 0) & ~F.arrays_overlap(x["markers"], y["markers"])
    late = F.abs(x["at"] - y["at"]) >= UPDATE_HOURS * 3_600_000
    return marked | (late & (F.size(x["claims"]) > 0) & (F.size(y["claims"]) > 0) & (x["claims"] != y["claims"]))


def same_event(a: str, b: str) -> Column:
    """Whether two structs of event_view tell of one event; a is the representative."""
    x, y = F.col(a), F.col(b)
    apart = (x["at"] != 0) & (y["at"] != 0) & (F.abs(x["at"] - y["at"]) > GAP_HOURS * 3_600_000)
    hit = F.filter(x["tokens"], lambda t, i: F.array_contains(y["slots"], F.get(x["slots"], i)))
    common = F.size(hit)
    coverage = common / F.least(x["n"], y["n"])
    jaccard = common / (x["n"] + y["n"] - common)
    anchors = F.size(F.filter(hit, lambda t: ~t.isin(*OUTCOMES)))
    has = lambda word: F.array_contains(hit, word)
    rules = [
        (common >= 5) & (coverage >= 0.58) & (jaccard >= 0.30),
        (common >= 4) & (coverage >= 0.67) & (jaccard >= 0.32),
        (common >= 3) & (coverage >= 0.58) & has("outcome") & (anchors >= 2),
        (common >= 3) & (coverage >= 0.50) & has("reaction") & (anchors >= 2),
        (common >= 4) & (coverage >= 0.50) & has("shipwreck") & has("vessel"),
        (common >= 3) & (coverage >= 0.50) & has("shooting"),
        (common >= 4) & (coverage >= 0.55) & has("flood"),
    ]
    return (x["n"] >= LEAST_TOKENS) & (y["n"] >= LEAST_TOKENS) & ~apart & ~material_development(a, b) & reduce(lambda p, q: p | q, rules)


def event_edges(view: DataFrame, order: DataFrame) -> DataFrame:
    """view and order (id, ord) -> (a, b): b comes later and tells of a's event.

    Every rule wants half of the shorter title's tokens and three at least, so one of its rarest slots must be shared.
    """
    live = view.where(F.col("n") >= LEAST_TOKENS)
    held = cut(meet(by_rarity(live.select("id", F.col("slots").alias("tokens"))), live.select("id", "n", "at"), "id"))
    needed = F.greatest(F.lit(LEAST_COMMON), F.ceil(F.col("n") * LEAST_COVERAGE).cast("int"))
    bucket = F.floor(F.col("at") / (GAP_HOURS * 3_600_000))
    unknown = F.lit(-(1 << 40))
    shared = lambda last: F.explode(F.slice("tokens", F.col("lone") + 1, F.greatest(last - F.col("lone"), F.lit(0)))).alias("slot")  # noqa: E731  slots of one title alone meet nothing
    small = held.select(F.col("id").alias("small"), "tokens", F.col("n").alias("small_n"), "at", shared(F.col("n") - needed + 1), bucket.alias("bucket"))
    large = held.select(F.col("id").alias("large"), F.col("tokens").alias("others"), F.col("n").alias("large_n"), F.col("at").alias("large_at"), shared(F.col("n")), F.when(F.col("at") == 0, unknown).otherwise(bucket).alias("bucket"))
    dated = meet(small.where("at <> 0").withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1, unknown))), large, ["slot", "bucket"])
    undated = meet(small.where("at = 0").drop("bucket"), large.drop("bucket"), "slot")
    # a pair is judged where its first common slot meets, so it is found once and no candidates are shuffled
    enough = F.exists(F.array(F.array_intersect("tokens", "others")), lambda c: (F.get(c, F.lit(0)) == F.col("slot")) & (F.size(c) >= LEAST_COMMON) & (F.size(c) >= LEAST_COVERAGE * F.col("small_n")))
    near = f"(at = 0 or large_at = 0 or abs(at - large_at) <= {GAP_HOURS * 3_600_000}) and (small_n < large_n or small_n = large_n and small < large)"
    found = lambda met: met.where(near).where(enough).select(F.least("small", "large").alias("x"), F.greatest("small", "large").alias("y"))
    pairs = found(dated).unionByName(found(undated))
    rows = meet(live.select("id", F.struct("tokens", "slots", "n", "at", "markers", "claims").alias("row")), order, "id")
    of = lambda side: rows.select(F.col("id").alias(side), F.col("row").alias(f"{side}_row"), F.col("ord").alias(f"{side}_ord"))
    both = meet(meet(pairs, of("x"), "x"), of("y"), "y")
    first = F.col("x_ord") < F.col("y_ord")
    turned = both.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"), F.when(first, F.col("x_row")).otherwise(F.col("y_row")).alias("a_row"), F.when(first, F.col("y_row")).otherwise(F.col("x_row")).alias("b_row"))
    return turned.where(same_event("a_row", "b_row")).select("a", "b")


def evolving_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id, ord, bonus, score) and edges (a, b), b later -> id, ord, founder (an ord), rep (whether it ever stood for its cluster).

    The sequential rule: each row joins the oldest cluster whose present representative it is linked with, and takes its
    place if its quality (a tenth of the score and its bonus) is greater than that of the representative with the
    cluster's best score. Each round decides all rows whose outcome no open row can change: neither an open neighbour
    that may yet stand for an older cluster, nor an open earlier row that may displace a representative in question.
    The first open row can always be decided, so rounds end; what they hold is one row a node and the edges.
    """
    quality = lambda bonus, score: F.col(bonus) + F.col(score) * 0.1
    plain = nodes.select("id", "ord", "bonus", "score", quality("bonus", "score").alias("q"))
    of = lambda side: plain.select(F.col("id").alias(side), F.col("ord").alias(f"{side}_ord"), F.col("q").alias(f"{side}_q"), F.col("score").alias(f"{side}_score"))
    links = cut(meet(meet(edges, of("a"), "a"), of("b"), "b"))
    bold = links.groupBy(F.col("b").alias("id")).agg(F.max(F.col("b_q") > F.col("a_q")).alias("bold"))
    kind = nodes.schema["ord"].dataType
    state = cut(meet(plain, bold, "id", "left").select("*", F.lit(None).cast(kind).alias("founder"), F.lit(None).cast("boolean").alias("rep"), F.lit(None).cast(nodes.schema["id"].dataType).alias("joined"), F.lit(None).cast("double").alias("held")).fillna(False, ["bold"]))
    while state.where("founder is null").limit(1).count():
        done, still = state.where("founder is not null"), state.where("founder is null")
        after = done.where("joined is not null").groupBy(F.col("joined").alias("a")).agg(F.min(F.when(F.col("rep"), F.col("ord"))).alias("displaced"), F.max("score").alias("top"))
        reps = done.where("rep").select(F.col("id").alias("a"), "founder", F.col("bonus").alias("a_bonus"), "held")
        reps = meet(reps, after, "a", "left")
        ahead = meet(links, still.select(F.col("id").alias("b")), "b", "left_semi")
        near = meet(ahead, reps, "a").withColumn("matters", (F.col("b_q") > quality("a_bonus", "held")) | (F.col("b_score") > F.col("held")))
        first_open = near.where("matters").groupBy("a").agg(F.min("b_ord").alias("first_open"))
        alive = meet(near, first_open, "a", "left").where("displaced is null or displaced > b_ord")
        choice = F.struct("founder", "a", quality("a_bonus", "best").alias("bar"), "best")
        seen = alive.withColumn("best", F.greatest("held", "top")).groupBy(F.col("b").alias("id")).agg(F.max(F.coalesce(F.col("first_open") < F.col("b_ord"), F.lit(False))).alias("blocked"), F.min_by(choice, "founder").alias("pick"))
        waiting = meet(ahead, still.select(F.col("id").alias("a"), "bold"), "a").groupBy(F.col("b").alias("id")).agg(F.max("bold").alias("bold_before"), F.min("a_ord").alias("open_before"))
        joint = meet(meet(still.drop("founder", "rep", "joined", "held"), seen, "id", "left"), waiting, "id", "left")
        ready = ~F.coalesce("blocked", F.lit(False)) & ~F.coalesce("bold_before", F.lit(False)) & (F.col("open_before").isNull() | F.coalesce(F.col("pick.founder") < F.col("open_before"), F.lit(False)))
        alone = F.col("pick").isNull()
        decided = joint.select("id", "ord", "bonus", "score", "q", "bold", F.when(ready, F.coalesce("pick.founder", "ord")).alias("founder"), F.when(ready, alone | (F.col("q") > F.col("pick.bar"))).alias("rep"), F.when(ready, F.col("pick.a")).alias("joined"), F.when(ready, F.greatest("score", "pick.best")).alias("held"))
        state = cut(done.unionByName(decided))
    return state.select("id", "ord", "founder", "rep")


def merge_events(articles: DataFrame) -> DataFrame:
    """articles (doc_id, title, summary, source, published_at, score), newest first -> a row for each event.

    doc_id is the final representative's; the first eight sources by name, the longest summary (the earliest of equally
    long ones) and the best score come from all members. merged_rows is the number of members, merged_count the sum of
    what each stands for: its own merged_count or its number of sources, whichever is more, 1 at least. articles may
    have merged_count and sources (an array, in place of source). Give it rows without exact copies (lexical_merge):
    each row is a node.
    """
    view = cut(event_view(articles).withColumn("ord", F.struct((-F.col("at")).alias("t"), F.col("id").alias("doc_id"))))
    clusters = evolving_clusters(view.select("id", "ord", "bonus", "score"), cut(event_edges(view.drop("ord"), view.select("id", "ord"))))
    given = F.coalesce("sources", F.array("source")) if "sources" in articles.columns else F.array("source")
    told = F.filter(given, lambda s: s.isNotNull() & (s != ""))
    before = F.coalesce("merged_count", F.lit(0)) if "merged_count" in articles.columns else F.lit(0)
    own = articles.withColumn("_told", told).withColumn("_stands", F.greatest(F.lit(1), before, F.size("_told")).cast("long"))
    own = meet(own, clusters.withColumnRenamed("id", "doc_id"), "doc_id")
    longest = F.max_by("summary", F.struct(F.length("summary"), (-F.col("ord.t")).alias("t"), (-F.col("doc_id")).alias("d")))
    best = F.max_by("doc_id", F.when(F.col("rep"), F.col("ord")))
    merged = own.groupBy("founder").agg(best.alias("doc_id"), F.sum("_stands").alias("merged_count"), F.count("*").alias("merged_rows"), longest.alias("summary"), F.max("score").alias("score"))
    named = own.select("founder", F.explode("_told").alias("source")).distinct()
    first = named.withColumn("_place", F.row_number().over(Window.partitionBy("founder").orderBy("source"))).where("_place <= 8")
    sources = first.groupBy("founder").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    return meet(merged, sources, "founder", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
