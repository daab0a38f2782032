"""Whether a summary holds to its source: numbers, dates, names and words must be there; final gates with reasons."""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.storage import cut
from newsloom.operators.clustering import by_rarity, meet, tails
from newsloom.operators.events import says

#: Words that don't count as meaning, and as news.
STOP_MEANING = tuple("alors après avant avec avoir cette comme dans depuis devrait elles entre étaient faire leurs mais même moins notamment nous plus pour sans selon sont sous tout toute toutes tous très vers votre ainsi cela celui celle être fait faits".split())
STOP_NEWS = tuple("avec dans pour plus apres avant cette sont etre leur leurs tout mais sans vers entre une des les sur qui que aux par ses son ont est etats unis article direct".split())
#: Number words, and terms of dates.
NUMBER_WORDS = {"deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "six": "6", "sept": "7", "huit": "8", "neuf": "9", "dix": "10", "onze": "11", "douze": "12", "treize": "13", "quatorze": "14", "quinze": "15", "seize": "16", "vingt": "20", "trente": "30", "quarante": "40", "cinquante": "50", "soixante": "60", "cent": "100", "mille": "1000"}
DATE_TERMS = tuple("lundi mardi mercredi jeudi vendredi samedi dimanche janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre hier aujourdhui demain".split())
#: Capitalised words that name nothing.
NAMELESS = tuple("Le La Les Un Une Des Ce Cet Cette Ces Il Ils Elle Elles On Nous Vous Son Sa Ses Selon Apres Avant Dans Pour Par En Au Aux De Du Mais Plus Lors Alors Pourtant Ainsi Comme Quand Si Or Et A À".split())
#: Numbers, names, sentences that only introduce, and what isn't news at all.
FIGURE = r"\b\d{1,3}(?:[ .]\d{3})*(?:[,.]\d+)?\b|\b\d{4}\b"
NAME = r"(?U)\b\p{Lu}[\p{L}’'-]{2,}\b"
INTRODUCTION = r"^(?:cet article|l[’']article|ce texte|cette publication)\s+(?:porte sur|parle de|évoque|présente|explique|concerne)\b"
BOILERPLATE = (
    r"pour\s+(?:sauvegarder|enregistrer|mémoriser|partager|commenter|lire)\s+(?:(?:cet|cette|un|une|l[’']?)\s*)?article",
    r"partager\s+(?:la\s+)?publication|partager\s+cet(?:te)?\s+(?:publication|article)",
    r"connectez[- ]?vous|se connecter|identifiez[- ]?vous|connexion à votre compte",
    r"créez (?:votre|un) compte|créer (?:votre|un) compte",
    r"abonnez[- ]?vous|déjà abonné|offre d[’']abonnement|nos offres|accès abonnés?",
    r"newsletter|recevez (?:nos|les) actualités|inscrivez[- ]?vous à",
    r"acceptez les cookies|gestion des cookies|préférences de confidentialité|consentement",
    r"activez les notifications|notifications? pour ne rien manquer",
    r"partager sur|suivez[- ]?nous|retrouvez[- ]?nous sur",
    r"lire aussi|à lire aussi|voir aussi|à découvrir|sur le même sujet",
    r"ajouter (?:cet|l[’']?)?\s*article (?:à|dans) (?:vos|mes) favoris",
    r"ouvrez?\s+l[’']article|consultez?\s+(?:les?\s+)?détails|détails publiés par la source",
    r"résumé indisponible(?: pour cet article)?",
)
#: Each match of BOILERPLATE holds one of these, which are found much faster.
BOILERPLATE_PARTS = tuple("article|partager|conne|identifiez|compte|abonn|offres|newsletter|recevez|inscrivez|cookies|confidentialité|consentement|notification|suivez|retrouvez|aussi|découvrir|même sujet|détails|indisponible".split("|"))
SENTENCE_CHARS, SUMMARY_CHARS, NEWS_TOKENS, NEWS_CHARS = 18, 55, 8, 100
SAME_SENTENCE, RESTATED = 0.9, 0.84


def plain(x: Column) -> Column:
    """Entities decoded, lower case, no accents, blanks for apostrophes; other signs stay."""
    folded = lambda v: F.when(F.octet_length(v) == F.length(v), F.lower(v)).otherwise(text.fold(v))  # noqa: E731  ASCII has no accents to look up
    return F.regexp_replace(text._bound(text.decode_entities(F.coalesce(x, F.lit(""))), folded), "[’']", " ")


def meaningful(x: Column) -> Column:
    """Words of five signs or more, with repetitions."""
    return F.filter(F.regexp_extract_all(plain(x), F.lit("[a-z0-9]{5,}"), F.lit(0)), lambda t: ~t.isin(*STOP_MEANING))


def news_tokens(x: Column, least: int = 4) -> Column:
    return F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(plain(x), "[^a-z0-9]+", " ")), " "), lambda t: (F.length(t) >= least) & ~t.isin(*STOP_NEWS)))


def stem(t: Column) -> Column:
    return F.when(t.rlike(r"^\d+$") | (F.length(t) <= 6), t).when(F.length(t) >= 10, F.substring(t, 1, 6)).otherwise(F.substring(t, 1, 5))


def figures(x: Column) -> Column:
    """Distinct numbers, without their thousands' signs and with a decimal point."""
    found = F.regexp_extract_all(F.regexp_replace(plain(x), r"[\x{202F}\x{00A0}]", " "), F.lit(FIGURE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.replace(F.regexp_replace(n, "[ .]", ""), F.lit(","), F.lit("."))))


def names(x: Column) -> Column:
    found = F.filter(F.regexp_extract_all(text.decode_entities(F.coalesce(x, F.lit(""))), F.lit(NAME), F.lit(0)), lambda t: ~t.isin(*NAMELESS))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.regexp_replace(plain(t), r"\s+", "")), lambda t: F.length(t) >= 3))


def dates(x: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(plain(x), F.lit("[a-z]{3,}"), F.lit(0)), lambda t: t.isin(*DATE_TERMS)))


def _number_words(x: Column) -> Column:
    """Number words of x, as digits."""
    return F.filter(F.array(*[F.when(plain(x).rlike(rf"(?<!-)\b{w}\b(?!-)"), F.lit(n)) for w, n in NUMBER_WORDS.items()]), lambda v: v.isNotNull())


def _held(own: Column, theirs: Column, use=lambda x: x) -> Column:
    """How many of own are in theirs, repetitions counted; theirs is worked out once, not for each of own."""
    return text._bound(theirs, lambda v: F.size(F.filter(own, lambda t: F.array_contains(v, use(t)))))


def _share(n: Column, share: float, total: Column) -> Column:
    """n >= share * total, exactly: 0.28 * 25 is more than 7 in binary."""
    return 1000 * n >= round(1000 * share) * total


def _words_held(summary: Column, source: Column, own_least: int, source_least: int, exact_least: int, alike_least: int, exact_share: float, alike_share: float) -> Column:
    """Whether enough of summary's words with meaning, or of their stems, are in source, by number or by share."""
    own, theirs = meaningful(summary), meaningful(source)
    exact, alike = _held(own, theirs), _held(own, F.transform(theirs, stem), stem)
    n = F.size(own)
    return (n >= own_least) & (F.size(theirs) >= source_least) & ((exact >= exact_least) | (alike >= alike_least) | _share(exact, exact_share, n) | _share(alike, alike_share, n))


def _figures_held(summary: Column, source: Column) -> Column:
    return F.size(F.array_except(figures(summary), figures(source))) == 0


def supported(summary: Column, source: Column) -> Column:
    """Whether each number, date and name of summary is in source, and enough of its words are."""
    body = plain(source)
    counted = F.concat(figures(source), _number_words(source))
    told = _figures_held(summary, source) & (F.size(F.array_except(_number_words(summary), counted)) == 0)
    named = F.forall(F.concat(dates(summary), names(summary)), lambda t: F.contains(body, t))
    return told & named & _words_held(summary, source, 5, 2, 2, 3, 0.06, 0.12)


def supported_with_title(summary: Column, source: Column, title: Column) -> Column:
    """Whether summary is long enough, no boilerplate, and its numbers and enough of its words are in source or title."""
    own, material = text.clean(summary), F.concat_ws("\n", source, title)
    return (F.length(own) >= SUMMARY_CHARS) & ~is_boilerplate(own) & _figures_held(own, material) & _words_held(own, material, 7, 4, 3, 5, 0.12, 0.22)


def token_share_supported(summary: Column, source: Column, least: int = 8, share: float = 0.28) -> Column:
    """Whether summary has `least` words with meaning and that share of them, repetitions counted, is in source."""
    own, theirs = meaningful(summary), meaningful(source)
    return (F.size(own) >= least) & (F.size(theirs) > 0) & _share(_held(own, theirs), share, F.size(own))


def restates_title(summary: Column, title: Column) -> Column:
    own, head = F.trim(F.regexp_replace(text.decode_entities(F.coalesce(summary, F.lit(""))), r"(?iu)^(?:résumé|synthèse)\s*:\s*", "")), F.trim(text.decode_entities(F.coalesce(title, F.lit(""))))
    a, b = news_tokens(own), news_tokens(head)
    enough = (F.size(b) >= 4) & (F.size(a) >= 3)
    short = F.length(own) <= F.greatest(F.lit(190.0), F.length(head) * 1.65)  # first: words of long texts aren't looked at
    close = _share(F.size(F.array_intersect(a, b)), RESTATED, F.size(b)) & (F.size(F.array_except(a, b)) <= 3)
    return (own != "") & (head != "") & (says(own, INTRODUCTION) | (short & enough & close))


def is_boilerplate(x: Column) -> Column:
    likely = lambda v: reduce(lambda p, q: p | q, [F.contains(v, F.lit(part)) for part in BOILERPLATE_PARTS])
    said = lambda v: (v == "") | (likely(v) & v.rlike("|".join(f"(?:{p})" for p in BOILERPLATE)))  # noqa: E731  one pattern
    return text._bound(F.lower(text.decode_entities(F.coalesce(x, F.lit("")))), said)


def kept_places(keys: str) -> list[int]:
    """Places of the lines of keys (normalised sentences of one text) that neither repeat an earlier line nor a kept one's words.

    Two sentences that share SAME_SENTENCE of the smaller one's words share one of its rarest, so each looks up its rarest
    words among all words of kept ones, and its words among the rarest ones of those. Words of one line alone meet nothing.
    """
    said = keys.split("\n") if keys else []
    sets = [{w for w in set(key.split(" ")) if len(w) >= 4}.difference(STOP_NEWS) for key in said]
    times = Counter(chain.from_iterable(sets))
    rarity = {w: k for k, w in enumerate(sorted((w for w, n in times.items() if n > 1), key=times.__getitem__))}
    percent = round(100 * SAME_SENTENCE)
    kept, seen, shared, holds, rarest = [], set(), {}, defaultdict(list), defaultdict(list)
    for place, (key, own) in enumerate(zip(said, sets, strict=True)):
        if key in seen:
            continue
        seen.add(key)
        words = sorted(rarity[w] for w in own if w in rarity)
        needed = -(-percent * len(own) // 100)
        first, held = words[: max(0, len(words) - needed + 1)], set(words)
        near = {k for w in first for k in holds[w]} | {k for w in words for k in rarest[w]}
        if any(100 * len(held & shared[k]) >= percent * min(len(own), len(sets[k])) for k in near):
            continue
        kept.append(place)
        shared[place] = held
        for w in words:
            holds[w].append(place)
        for w in first:
            rarest[w].append(place)
    return kept


def distinct_sentences(summaries: DataFrame, summary: str = "summary") -> DataFrame:
    """summaries with kept: the sentences that are long enough, say something, and don't repeat a kept one's words, in order; of whole texts.

    A text is one row, so nothing is shuffled or written: its sentences' words go through `kept_places`, which looks up rare
    words instead of comparing all sentences with one another.
    """
    long_enough = F.filter(text.sentences(text.clean(F.col(summary))), lambda s: (F.length(s) >= SENTENCE_CHARS) & ~is_boilerplate(s))
    keyed = F.transform(long_enough, lambda s: F.struct(s.alias("s"), F.trim(F.regexp_replace(plain(s), "[^a-z0-9]+", " ")).alias("key")))
    said = summaries.withColumn("_said", F.filter(keyed, lambda x: x["key"] != ""))
    places = F.udf(kept_places, "array<int>", useArrow=False)  # a few texts at a time: Arrow's batches hold thousands
    placed = said.withColumn("_kept", places(F.array_join("_said.key", "\n")))
    return placed.withColumn("kept", F.transform("_kept", lambda k: F.get("_said.s", k))).drop("_said", "_kept")


def final_gate(summaries: DataFrame, *, summary: str = "summary", title: str = "title", aggregate_risk: Column | None = None) -> DataFrame:
    """summaries with final_summary (empty if rejected), quality (accepted or rejected), reason and n_sentences."""
    own = distinct_sentences(summaries, summary).withColumn("_clean", F.array_join("kept", " ")).drop("kept")
    low = (F.length("_clean") < NEWS_CHARS) & (F.size(news_tokens(F.col("_clean"))) < NEWS_TOKENS)
    reason = F.when(F.length("_clean") < SUMMARY_CHARS, "too-short-or-boilerplate").when(restates_title(F.col("_clean"), F.col(title)), "title-restatement")
    if aggregate_risk is not None:
        reason = reason.when(aggregate_risk, "ambiguous-google-aggregate")
    own = own.withColumn("reason", reason.when(low, "low-information"))
    good = F.col("reason").isNull()
    return own.select(*summaries.columns, F.when(good, F.col("_clean")).otherwise("").alias("final_summary"), F.when(good, "accepted").otherwise("rejected").alias("quality"), "reason", F.when(good, F.size(text.sentences(F.col("_clean")))).otherwise(0).cast("long").alias("n_sentences"))


def corroborated(claims: Column, evidence: Column, times: int = 2) -> Column:
    """Whether each claim is in `times` or more of the evidence's texts."""
    return F.forall(claims, lambda c: F.size(F.filter(evidence, lambda e: F.contains(e, c))) >= times)


#: Words, and numbers with thousands' signs, of a text in order.
PART = r"[A-Za-zÀ-ÖØ-öø-ÿ’'-]+|\d{1,3}(?:[ .]\d{3})*(?:[,.]\d+)?|\d{4}"
AROUND, CONTEXT_MOST, CONTEXT_LEAST, CONTEXT_SHARE = 6, 10, 3, 0.52


def numeric_contexts(items: DataFrame, story: str, source: str, body: str, *, id_col: str = "doc_id", stop: tuple[str, ...] = STOP_NEWS) -> DataFrame:
    """story, source, id_col, value and context: for each number the first distinct words of AROUND parts on either side."""
    parts = items.select(F.col(story).alias("story"), F.col(source).alias("source"), id_col, F.regexp_extract_all(F.regexp_replace(text.clean(F.col(body)), r"[\x{202F}\x{00A0}]", " "), F.lit(PART), F.lit(0)).alias("parts"))
    around = lambda i: F.slice("parts", F.greatest(i - AROUND, F.lit(0)) + 1, F.least(i, F.lit(AROUND)) + AROUND + 1)
    # a number takes its neighbours along, not the whole text
    told = F.filter(F.transform("parts", lambda p, i: F.when(p.rlike(r"^\d"), F.struct(p.alias("part"), F.array_join(around(i), " ").alias("around")))), lambda x: x.isNotNull())
    each = parts.select("story", "source", id_col, F.explode(told).alias("told")).select("story", "source", id_col, "told.*")
    window = F.col("around")
    words = F.filter(F.split(text.normalise(window), " "), lambda w: (F.length(w) >= 4) & ~w.rlike(r"^\d") & ~w.isin(*stop))
    value = F.replace(F.regexp_replace("part", "[ .]", ""), F.lit(","), F.lit("."))
    return each.select("story", "source", id_col, value.alias("value"), F.slice(F.array_distinct(words), 1, CONTEXT_MOST).alias("context")).where(F.size("context") >= CONTEXT_LEAST).distinct()


def contradictions(contexts: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """numeric_contexts() -> story, values, sources and ids: different values of two sources in like contexts, one row for each pair of values and sources.

    Equal contexts of one story are one node. Contexts of one size whose rarest possible common word begins the same tail
    are a hub: all of them are like each context that shares enough of the tail. So values and sources of a hub are
    gathered once on either side, and only those meet, not contexts.
    """
    told = cut(contexts.withColumn("context", F.array_sort("context")).groupBy("story", "context", "value", "source").agg(F.min(id_col).alias("first_id")))
    nodes = cut(by_rarity(told.select("story", F.col("context").alias("id"), F.col("context").alias("tokens")).distinct(), ["story"]).withColumn("n", F.size("tokens")))
    needed = F.greatest(F.lit(CONTEXT_LEAST), F.ceil(F.col("n") * round(100 * CONTEXT_SHARE) / 100).cast("int"))
    hubs = nodes.where(F.col("n") >= CONTEXT_LEAST).select("story", "n", F.explode(tails(F.col("tokens"), needed)).alias("tail")).distinct().withColumn("token", F.get("tail", F.lit(0)))
    others = nodes.select("story", F.col("id").alias("context"), F.col("tokens").alias("held"), F.col("n").alias("m"), F.explode("tokens").alias("token"))
    alike = F.exists(F.array(F.size(F.array_intersect("tail", "held"))), lambda c: (c >= CONTEXT_LEAST) & _share(c, CONTEXT_SHARE, F.col("n")))
    small = (F.col("n") == F.col("m")) & (F.slice("held", F.array_position("held", F.col("token")).cast("int"), F.col("m")) == F.col("tail"))
    met = meet(hubs, others, ["story", "token"]).where("n <= m").where(alike).select("story", F.md5(F.concat_ws("|", "n", F.array_join("tail", " ")).cast("binary")).alias("hub"), "context", small.alias("small"))
    sides = met.join(told, ["story", "context"]).groupBy("story", "hub", "value", "source").agg(F.min("first_id").alias("first_id"), F.min(F.when(F.col("small"), F.col("first_id"))).alias("small_id"))
    sides = cut(sides)
    a = sides.where("small_id is not null").select("story", "hub", F.struct("value", "source", F.col("small_id").alias("first_id")).alias("a"))
    both = a.join(sides.select("story", "hub", F.struct("value", "source", "first_id").alias("b")), ["story", "hub"]).where("a.value <> b.value and a.source <> b.source")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return both.select("story", low.alias("x"), high.alias("y")).groupBy("story", F.col("x.value").alias("value_a"), F.col("y.value").alias("value_b"), F.col("x.source").alias("source_a"), F.col("y.source").alias("source_b")).agg(F.min("x.first_id").alias("id_a"), F.min("y.first_id").alias("id_b"))
