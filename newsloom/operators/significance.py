"""How much a headline tells: signals by patterns, added up by column arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.functions.times import rounded

#: The patterns of headlines, by what they tell.
PATTERNS = {
    "consumer": r"\b(comparatif|guide d['’]achat|bon plan|promo(?:tion)?|soldes?|code promo|meilleur(?:e|s)?|test(?:é|er)?|prise en main|avis|astuce|comment faire|sans débourser|gratuitement|abonnement|combien de jours|point vert|premier téléphone)\b",
    "listicle": r"\b(?:ces|les)\s+\d+\s+(?:aliments|astuces|conseils|raisons|signes|erreurs|choses|gestes)\b",
    "reaction": r"\b(réagit|réaction|se confie|confidences?|donne son avis|tacle|coup de gueule|s['’]indigne|buzz|polémique|réseaux sociaux|les internautes|se défend après|blague)\b",
    "sports": r"\b(ligue 1|ligue des champions|champions league|tour d['’]espagne|tour de france|pogacar|marquez|motogp|grand prix|formule 1|mercato|utmb|ultra[- ]trail|match|score final|entraîneur|but(?:s)?|vuelta|tennis|us open|roland[- ]garros|djokovic|alcaraz|sinner|eurosport)\b",
    "celebrity": r"\b(tapis rouge|tapis bleu|cheveux longs|barbe imposante|concerts? de|festival.*récompensé|star révèle|people)\b",
    "human": r"\b(?:au moins\s+)?(?:\d{1,5}|un|une|deux|trois|quatre|cinq|six|sept|huit|neuf|dix|onze|douze|treize|quatorze|quinze|seize|vingt|trente|quarante|cinquante|soixante|cent|plusieurs)\s+(?:morts?|décès|victimes?|blessés?|disparus?)\b",
    "event": r"\b(inondations?|crues?|séisme|tremblement de terre|ouragan|cyclone|naufrage|chavir(?:e|é|ent|ement)|ferry|catastrophe|(?<!de )guerre(?!\s+(?:économique|commerciale|tarifaire|technologique|des? prix)\b)|invasion|frappes?|attaques? de drones?|cessez[- ]le[- ]feu|attentat|fusillade|coups? de feu|tirs? mortels?|référendum|élections?|scrutin|état d['’]urgence|pénurie grave|piratage massif)\b",
    "missile": r"\b(?:(?:frappes?|attaques?|tirs?|salves?|lancements?)\s+(?:de |des |d['’])?missiles?|missiles?\s+(?:tirés?|lancés?|frappent?|s['’]abattent?|touchent?))\b",
    "sanctions": r"\b(paquet de sanctions?|sanctions? (?:économiques?|internationales?|européennes?|américaines?|onusiennes?)|sanctions? (?:contre|visant) (?:la |le |les |l['’])|sanctions? de l['’](?:ue|union européenne))\b",
    "market": r"\b(cac\s*40|bourse|marchés? financiers?|marchés?|indices? boursiers?|wall street|euro stoxx|stoxx 600|dax)\b",
    "policy": r"\b(loi|réforme|taxe|impôt|réglementation|décret|arrêté)\b",
    "institution": r"\b(gouvernement|parlement|cour suprême|conseil constitutionnel|commission européenne|union européenne|ue|banque centrale|bce|fed|état)\b",
    "action": r"\b(adopte|rejette|interdit|autorise|valide|annule|approuve|décide|impose|soumet|soumis|renforce|renforcées?|maintient|prolonge|supprime|réduit|augmente|suspend(?:re|u|ue|us|ues)?|officialise|entre en vigueur)\b",
    "effect": r"\b(entre en vigueur|dès le 1er septembre|à partir du 1er septembre|règles? changent?|devient obligatoire|règles? renforcées?|ne seront pas suspendues?)\b",
    "context": r"\b(aides?|retraites?|pensions?|chômage|indemnisation|allocations?|rsa|prime|taxe|impôt|facturation électronique|arrêts? maladie|dsa|budget|subventions?|salaires? des enseignants?)\b",
    "specific": r"\b(déblocage de .*fonds|accord pétrolier)\b",
    "utility": r"\b(alerte météo|vigilance (?:rouge|orange)|rappel de produits?|rappel massif|fermeture (?:des? )?(?:écoles?|routes?|gares?|aéroports?)|interruption (?:du |de la |des )?(?:trafic|réseau|service)|interdiction (?:des?|de la|du)|numéro d['’]urgence|consignes? de sécurité)\b",
    "science": r"\b(découverte|découvre|démontr|première mondiale|essai clinique|traitement|vaccin|mission spatiale|lancement spatial|télescope|nasa|esa|chiffrement quantique|chercheurs?)\b",
    "cyber": r"\b(pirat(?:age|é|er)|hackers?|cybercriminels?|fuite de données|vol de .*données|millions? de données|serveurs? compromis)\b",
    "quake": r"\bséisme\b",
}
#: A title of signs only; numbers are those of text.NUMBER.
MALFORMED = r"^\s*[-–—|:]+\s*(?:$|[^\p{L}\p{N}]{0,4})"
NUMBERS = text.NUMBER
#: Points of the signals, and the bounds of their sum.
POINTS = {"malformed": -34, "human": 24, "major": 15, "decision": 10, "utility": 6, "cyber": 11, "science": 7, "figures": 5, "figure": 2, "consumer": -16, "reaction": -13, "sports": -16, "celebrity": -11, "question": -4}
NAMES = {"malformed": "titre pauvre", "human": "bilan humain", "major": "événement majeur", "decision": "décision publique", "utility": "utilité publique", "cyber": "cybersécurité", "science": "science", "figures": "faits chiffrés", "consumer": "contenu pratique/achat", "reaction": "réaction", "sports": "sport léger", "celebrity": "people"}
LOWEST, HIGHEST, MOST_REASONS, SHORT_TITLE = -34, 38, 4, 18


def _flags(title: Column) -> Column:
    """A struct of whether each pattern is found."""
    return F.struct(*[F.regexp_like(title, F.lit("(?iu)" + text.js_regex(p))).alias(name) for name, p in PATTERNS.items()])


def decided_publicly(f: Column) -> Column:
    return f["policy"] | f["specific"] | (f["institution"] & f["action"]) | (f["effect"] & f["context"])


def with_signal(articles: DataFrame, title: str = "title") -> DataFrame:
    """articles with the columns signal (int) and reasons; a null title counts as an empty one."""
    own = text.clean(F.col(title))
    f = F.col("_flags")
    flagged = articles.withColumn("_title", own).withColumn("_flags", _flags(F.col("_title"))).withColumn("_numbers", F.size(F.regexp_extract_all("_title", F.lit("(?iu)" + text.js_regex(NUMBERS)), F.lit(0))))
    major = (f["event"] | f["missile"] | f["sanctions"]) & ~(f["sports"] & f["quake"] & ~f["human"]) & ~(f["market"] & ~f["human"])
    told = {
        "malformed": (F.length("_title") < SHORT_TITLE) | F.col("_title").rlike(MALFORMED),
        "human": f["human"],
        "major": major,
        "decision": decided_publicly(f),
        "utility": f["utility"] & ~f["consumer"] & ~f["listicle"],
        "cyber": f["cyber"],
        "science": f["science"],
    }
    flagged = flagged.withColumn("_told", F.struct(*[c.alias(k) for k, c in told.items()]))
    t = F.col("_told")
    add = lambda parts: reduce(lambda a, b: a + b, [F.when(c, POINTS[k]).otherwise(0) for k, c in parts.items()])
    base = add({k: t[k] for k in told})
    light = ~(t["human"] | t["major"] | t["decision"] | t["utility"] | t["cyber"])
    more = {
        "figures": (F.col("_base") > 0) & (F.col("_numbers") >= 2),
        "figure": (F.col("_base") > 0) & (F.col("_numbers") == 1),
        "consumer": light & (f["consumer"] | f["listicle"]),
        "reaction": light & f["reaction"],
        "sports": light & f["sports"],
        "celebrity": light & f["celebrity"],
        "question": light & F.col("_title").endswith("?"),
    }
    reasons = F.filter(F.array(*[F.when(c, F.lit(NAMES[k])) for k, c in ({k: t[k] for k in told} | more).items() if k in NAMES]), lambda x: x.isNotNull())
    scored = flagged.withColumn("_base", base).withColumn("signal", F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.col("_base") + add(more)))).withColumn("reasons", F.slice(reasons, 1, MOST_REASONS))
    return scored.drop("_title", "_flags", "_numbers", "_told", "_base")


def catalogue_score(score: Column, signal: Column) -> Column:
    """The score with its signal, to a tenth; a null score counts as 0."""
    return rounded(F.coalesce(score, F.lit(0.0)) + signal, 1)
