"""The news classifier: ordered title rules first, then terms weighed by where they are found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text

#: Categories in the order that decides ties, with their terms as they are written.
TERMS = {
    "IA": ["intelligence artificielle", "ia", "openai", "chatgpt", "anthropic", "claude", "gemini", "llm", "modèle de langage", "agent ia", "machine learning", "deepseek", "ai factory"],
    "VR": ["réalité virtuelle", "casque vr", "quest 3", "quest 4", "steamvr", "pcvr", "virtual reality", "mixed reality", "réalité mixte"],
    "Smartphones": ["smartphone", "android", "iphone", "galaxy s", "pixel", "oppo", "xiaomi", "oneplus", "téléphone mobile"],
    "Automobile": ["voiture", "automobile", "véhicule électrique", "véhicule", "tesla", "renault", "peugeot", "bmw", "mercedes", "audi", "porsche", "suv", "batterie automobile"],
    "Énergie": ["énergie", "électricité", "énergie nucléaire", "centrale nucléaire", "réacteur nucléaire", "nucléaire civil", "epr", "solaire", "éolien", "batterie stationnaire", "hydrogène", "gaz", "gaz naturel"],
    "Politique": ["politique", "gouvernement", "assemblée nationale", "sénat", "élysée", "ministre", "élection", "président", "matignon"],
    "Économie": ["économie", "inflation", "croissance", "bce", "banque centrale", "taux directeur", "bourse", "marché financier", "emploi", "chômage", "entreprise", "facturation électronique"],
    "International": ["guerre", "ukraine", "russie", "chine", "états-unis", "gaza", "israël", "iran", "corée du nord", "corée du sud", "pyongyang", "otan", "onu", "international"],
    "Europe": ["union européenne", "ue", "commission européenne", "parlement européen", "bruxelles", "europe", "européen", "européenne"],
    "Santé": ["santé", "médecine", "hôpital", "maladie", "vaccin", "cancer", "traitement", "épidémie", "médicament", "rhume", "vitamine", "tension artérielle", "hypertension", "paludisme", "infection", "virus", "bactérie", "cardiopathie", "soins dentaires", "dentaire", "dentiste", "nutrition", "nutritionniste", "syndrome", "coeur artificiel", "carmat"],
    "Environnement": ["climat", "environnement", "biodiversité", "pollution", "réchauffement", "écologie", "météo", "canicule", "vague de chaleur", "inondation", "crue"],
    "Science": ["science", "scientifique", "chercheur", "recherche", "espace", "astronomie", "astrophys", "physique", "biologie", "archéologie", "nasa", "esa", "spacex", "fusée", "télescope", "spatial", "satellite", "cosmos"],
    "Culture": ["culture", "cinéma", "film", "série", "musique", "livre", "littérature", "musée", "artiste", "festival", "concert"],
    "Éducation": ["éducation", "école", "collège", "lycée", "université", "enseignant", "professeur", "rentrée scolaire", "élèves", "étudiant"],
    "Société": ["société", "justice", "police", "logement", "transport", "démographie", "famille"],
    "Tech": ["technologie", "tech", "informatique", "logiciel", "windows", "linux", "cybersécurité", "cyberattaque", "piratage", "fuite de données", "données volées", "ordinateur", "semi-conducteur", "puce", "dlss", "nvidia", "geforce", "gpu", "gaming", "jeu vidéo", "jeux vidéo", "playstation", "xbox", "nintendo", "vidéoprojecteur", "projecteur", "téléviseur", "apple", "supercalculateur"],
}
#: Terms of International that weigh less, terms that are stems, endings that a term of five letters may take.
WEAK = ("ukraine", "russie", "chine", "etats unis", "gaza", "israel", "iran")
STEMS = ("astrophys",)
ENDINGS = ("s", "es", "e", "ee", "ees", "er", "ers", "ere", "eres", "ien", "iens", "ienne", "iennes", "iel", "iels", "ielle", "ielles", "ique", "iques", "al", "ale", "aux", "ales", "l", "ls", "lle", "lles")
#: Points in titles and summaries, of usual and weak terms; of a feed's hint, usual and strict.
POINTS, WEAK_POINTS, HINT, STRICT_HINT, LEAST = (10, 3), (5, 1), 2, 4, 6
#: Rules on normalised titles, in order: reason, category, confidence, pattern.
TITLE_RULES = (
    ("sports-title", "Société", 14, r"\b(pogacar|marquez|motogp|ligue 1|ligue des champions|champions league|football|tennis|cyclisme|grand prix|formule 1|mercato|utmb|ultra trail|match|but|score|retraite internationale|met (?:un )?terme a sa carriere internationale|fin de (?:sa )?carriere internationale)\b"),
    ("cyber-title", "Tech", 14, r"\b(cyberattaque|cybercrimin\w*|hack(?:er|e|ers?)?|rancongiciel|zerobytes)\b|\bpirat\w*\b.*\b(donnees|site|plateforme|fisc|ministere)\b"),
    ("gaming-title", "Tech", 14, r"\b(playstation|xbox|nintendo|steam deck|gta\s*\d*|grand theft auto)\b"),
    ("food-health-title", "Santé", 14, r"\b(?:salmonell\w*|listeri\w*|contamin\w*)\b.*\b(?:rappel\w*|consomm\w*|aliment\w*|produit\w*)\b|\b(?:rappel\w*)\b.*\b(?:salmonell\w*|listeri\w*|contamin\w*)\b"),
    ("corporate-economy-title", "Économie", 14, r"\brapprochement strategique\b.{0,100}\b(?:cooperative|entreprise|groupe|societe|compagnie|decathlon|sport 2000)\b|\b(?:cooperative|entreprise|groupe|societe|compagnie|decathlon|sport 2000)\b.{0,100}\brapprochement strategique\b|\b(?:acquerir|acquisition)\b.*\b(?:entreprise|societe|groupe|compagnie|capital|actions?|tap air portugal)\b|\b(?:prend|prendre|nomme|nommee|devient)\b.{0,45}\b(?:direction des ressources humaines|drh)\b"),
    ("sovereign-economy-title", "Économie", 14, r"\b(?:fitch|moody s|standard poor s|agence de notation|note souveraine|notation souveraine)\b"),
    ("fuel-price-economy-title", "Économie", 14, r"\b(?:prix|tarifs?|hausse|flambee|augmentation)\b.{0,70}\b(?:carburants?|gazole|diesel|essence)\b|\b(?:carburants?|gazole|diesel|essence)\b.{0,70}\b(?:prix|tarifs?|hausse|flambee|augmentation)\b"),
    ("pensions-economy-title", "Économie", 14, r"\b(?:retraites?|pensions?)\b.{0,90}\b(?:sous indexation|desindexation|indexation|revalorisation|montant|pouvoir d achat|budget)\b|\b(?:sous indexation|desindexation|indexation|revalorisation)\b.{0,90}\b(?:retraites?|pensions?)\b"),
    ("work-society-title", "Société", 13, r"\b(?:licencie\w*|licenciement)\b.*\b(?:teletravail\w*|salarie\w*|employeur\w*|anciennete)\b|\bteletravail\w*\b.*\b(?:licencie\w*|licenciement)\b"),
    ("heritage-culture-title", "Culture", 13, r"\b(?:loto du patrimoine|monument historique|site patrimonial|patrimoine culturel)\b"),
    ("culture-exhibition-title", "Culture", 13, r"\b(?:exposition|retrospective)\b.{0,90}\b(?:musee|metropolitan museum|met de new york|artiste|createur|oeuvres?|mode)\b|\b(?:musee|metropolitan museum|met de new york|artiste|createur)\b.{0,90}\b(?:exposition|retrospective)\b"),
    ("war-ai-incidental-title", "International", 14, r"\b(?:guerre|frappe\w*|attaque\w*|hostilite\w*)\b.*\b(?:video|image\w*|contenu\w*)\b.{0,35}\b(?:genere\w* par ia|ia generative)\b"),
    ("military-crisis-title", "International", 14, r"\b(?:envoi\w*|deplo\w*|engage\w*)\b.{0,80}\b(?:avions? de combat|chasseurs?|troupes?|soldats?|forces? armees?|chars?)\b(?:.{0,100}\b(?:mutinerie|putsch|coup d etat|hostilites?|intervention militaire)\b|.{0,50}\b(?:au|aux|en|vers)\s+[a-z][a-z -]{2,35}\b)"),
    ("incident-title", "Société", 13, r"\b(fusillade|coups? de feu|tirs? mortels?|naufrage|chavir\w*|accident|grievement blesse\w*|portes? disparus?)\b"),
)
#: The rule that a feed's hint of this category suspends; what keywords and nothing at all give.
INCIDENT, INCIDENT_HINT, KEYWORD_CATEGORY, DEFAULT = "incident-title", "International", "À suivre", "Société"


def normalised_terms() -> list[tuple[int, str, str, int, int]]:
    """(rule, category, normalised term, points in a title, points in a summary) of every term."""
    plain = {c: text.plain_text(c) for own in TERMS.values() for c in own}
    return [(i, category, plain[t], *(WEAK_POINTS if category == "International" and plain[t] in WEAK else POINTS)) for i, (category, own) in enumerate(TERMS.items()) for t in own]


def word_dimension() -> list[tuple[int, str, int, int, str]]:
    """(rule, term, points in a title, points in a summary, token): single words with all endings they may take."""
    return [(i, t, a, b, t + end) for i, _, t, a, b in normalised_terms() if " " not in t and t not in STEMS for end in ("", *(ENDINGS if len(t) >= 5 else ()))]


def title_rule(title: Column, hint: Column) -> Column:
    """The first rule (reason, category, confidence) that a padded, normalised title meets; null without one."""
    found = None
    for reason, category, confidence, pattern in TITLE_RULES:
        met = title.rlike(f"(?i){pattern}")
        met = met & ~F.coalesce(hint == INCIDENT_HINT, F.lit(False)) if reason == INCIDENT else met
        told = F.struct(F.lit(reason).alias("reason"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))
        found = F.when(met, told) if found is None else found.when(met, told)
    return found


def classify_detailed(articles: DataFrame, keywords: tuple[str, ...] = ()) -> DataFrame:
    """articles (doc_id, title, summary, category_hint, strict_category) -> doc_id, category, confidence, level, margin, reason, title_hits, second.

    Words meet the term dimension by an equi-join (some thousands of rows, whatever the table; Spark broadcasts them by
    their size); phrases and stems are looked for in the text. A term that a title has doesn't count in the summary.
    second is the next category with points. ids must be distinct.
    """
    spark = articles.sparkSession
    hint = F.trim(F.coalesce("category_hint", F.lit("")))
    pad = lambda x: F.concat(F.lit(" "), text.normalise_terms(x), F.lit(" "))
    strict = F.coalesce(F.col("strict_category"), F.lit(False))
    own = articles.select("doc_id", hint.alias("hint"), strict.alias("strict"), pad(F.trim(text.strip_publisher(F.coalesce("title", F.lit(""))))).alias("t"), pad(F.col("summary")).alias("s"))
    named = own.withColumn("rule_met", title_rule(F.col("t"), F.col("hint")))
    dimension = spark.createDataFrame(word_dimension(), "rule int, term string, title_points int, summary_points int, token string")
    words = lambda c, scope: named.select("doc_id", F.explode(F.array_distinct(F.split(F.trim(F.col(c)), " "))).alias("token"), F.lit(scope).alias("scope"))
    single = words("t", 0).unionByName(words("s", 1)).join(dimension, "token").select("doc_id", "rule", "term", "scope", F.when(F.col("scope") == 0, F.col("title_points")).otherwise(F.col("summary_points")).alias("points"))
    entry = lambda i, t, p: F.struct(F.lit(i).alias("rule"), F.lit(t).alias("term"), F.lit(p).alias("points"))

    def phrases(c: str, scope: int) -> DataFrame:
        held = []
        for i, _, t, *points in normalised_terms():
            if " " in t or t in STEMS:
                held.append(F.when(F.contains(F.col(c), F.lit(f" {t}" + ("" if t in STEMS else " "))), entry(i, t, points[scope])))
        return named.select("doc_id", F.explode(F.filter(F.array(*held), lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.rule", "x.term", F.lit(scope).alias("scope"), "x.points")

    hits = single.unionByName(phrases("t", 0)).unionByName(phrases("s", 1))
    best = hits.groupBy("doc_id", "rule", "term").agg(F.min(F.struct("scope", "points")).alias("hit"))
    scored = best.groupBy("doc_id", "rule").agg(F.sum("hit.points").alias("score"), F.count_if(F.col("hit.scope") == 0).alias("title_hits"))
    names = F.array(*map(F.lit, TERMS))
    hinted = scored.join(named.select("doc_id", "hint", "strict"), "doc_id").withColumn("category", F.get(names, F.col("rule")))
    points = F.when(F.col("category") == F.col("hint"), F.when(F.col("strict"), STRICT_HINT).otherwise(HINT)).otherwise(0)
    # a hint's category without evidence is a rival with its points
    rival = named.where(F.array_contains(names, F.col("hint"))).select("doc_id", (F.array_position(names, F.col("hint")) - 1).cast("int").alias("rule"), F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("title_hits"), "hint", "strict", F.col("hint").alias("category"))
    rival = rival.join(scored.select("doc_id", "rule"), ["doc_id", "rule"], "left_anti")
    ranked = hinted.select("doc_id", "rule", "score", "title_hits", "hint", "strict", "category").unionByName(rival).withColumn("has", F.col("score") > 0).withColumn("score", F.col("score") + points)
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("title_hits"), "rule")
    top = ranked.withColumns({"place": F.row_number().over(order), "next": F.lead("score").over(order), "second": F.lead("category").over(order)}).where(f"place = 1 and score >= {LEAST} and has")
    top = top.select("doc_id", F.col("category").alias("found"), "score", "title_hits", (F.col("score") - F.coalesce("next", F.lit(0))).alias("gap"), "second")
    level = F.when((F.col("title_hits") >= 2) & (F.col("gap") >= 4) | (F.col("score") >= 20) & (F.col("gap") >= 6), "high").when((F.col("score") >= 10) & (F.col("gap") >= 4), "medium").otherwise("low")
    both = F.concat("t", "s")
    known = [k for k in map(text.plain_text, keywords) if k]
    keyed = F.exists(F.array(*map(F.lit, known)), lambda k: F.contains(both, k)) if known else F.lit(False)
    met, content, fed = F.col("rule_met").isNotNull(), F.col("found").isNotNull(), F.col("hint") != ""
    fixed = F.when(F.col("strict"), STRICT_HINT).otherwise(HINT)
    pick = lambda rule, found, feed, key, none: F.when(met, rule).when(content, found).when(fed, feed).when(keyed, key).otherwise(none)
    confidence = pick(F.col("rule_met.confidence"), F.col("score"), fixed, F.lit(2), F.lit(0)).cast("long")
    return named.join(top, "doc_id", "left").select(
        "doc_id",
        pick(F.col("rule_met.category"), F.col("found"), F.col("hint"), F.lit(KEYWORD_CATEGORY), F.lit(DEFAULT)).alias("category"),
        confidence.alias("confidence"),
        pick(F.lit("high"), level, F.lit("low"), F.lit("low"), F.lit("none")).alias("level"),
        F.when(met | ~content, confidence).otherwise(F.col("gap")).cast("long").alias("margin"),
        pick(F.col("rule_met.reason"), F.lit("content"), F.lit("feed-hint"), F.lit("keyword"), F.lit("fallback")).alias("reason"),
        F.when(~met & content, F.col("title_hits")).otherwise(0).cast("long").alias("title_hits"),
        F.when(~met & content, F.col("second")).alias("second"),
    )
