"""Views of the tables as articles, interactions and memory, with a fixed present."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
CATEGORIES = ("Politique", "International", "Économie", "Santé", "Science", "Tech", "Culture", "Société")

#: Headlines made up to meet the rules on titles, and some that meet none.
HEADS = (
    "Deux morts et cinq blessés dans une fusillade",
    "Le gouvernement présente le budget au Sénat",
    "Séisme de magnitude 6,1 : 40 morts et 300 blessés",
    "Bruxelles adopte des sanctions contre la Russie",
    "Une cyberattaque vise un hôpital et vole des données",
    "Prix des carburants : nouvelle hausse du gazole",
    "Le télescope de la Nasa observe une étoile",
    "Ligue 1 : le match de Lyon en direct",
    "Retraites : la revalorisation des pensions repoussée",
    "Vaccin contre le paludisme : un premier essai",
    "ChatGPT et Gemini : l’intelligence artificielle au bureau",
    "Canicule et inondation : le climat inquiète",
    "Le musée rouvre avec un concert de l’artiste",
    "Xiaomi lance un smartphone Android pliant",
    "Tesla rappelle une voiture électrique",
    "Guerre en Ukraine : des frappes sur Kiev",
    "Une salariée licenciée pour télétravail",
    "École : la rentrée scolaire des élèves de lycée",
    "Du saucisson contaminé à la salmonelle rappelé",
    "La bourse et l’inflation : la banque centrale hésite",
    "Nvidia présente une puce pour le jeu vidéo",
    "Réalité virtuelle : le casque VR Quest 4",
    "Facture de gaz et énergie solaire des ménages",
    "Rien de particulier ce matin",
)


def now():
    return F.lit(AS_OF).cast("timestamp")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: the first sentence (of 200 characters at most) is the title, the next 650 are the summary, as feeds give one."""
    return _as_articles(spark, sf_dir, 650)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """articles whose summaries are all that follows the title: for what reads texts, not feeds."""
    return _as_articles(spark, sf_dir, None)


def _as_articles(spark: SparkSession, sf_dir: str, most: int | None) -> DataFrame:
    head = F.regexp_extract("text", r"^[^.!?]{1,200}", 0)
    rest = F.substring(F.col("text"), F.length(head) + 1, F.lit(most + 1) if most else F.length("text"))
    said = F.regexp_replace(rest, r"^[.!?]", "")
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        F.trim(head).alias("title"),
        F.trim(F.substring(said, 1, most) if most else said).alias("summary"),
        "source",
        "lang",
        F.concat(F.lit("https://"), "source", F.lit(".example.com/a/"), F.col("doc_id").cast("string")).alias("url"),
        (now() - F.make_dt_interval(mins=(F.col("doc_id") * 37 % 44640).cast("int"))).alias("published_at"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("doc_id") % 8 + 1).cast("int")).alias("category_hint"),
        (F.col("doc_id") % 5 == 0).alias("custom_source"),
    )


#: Forms of titles, summaries, addresses, images and dates that the tables lack, as expressions that Spark and DuckDB read alike.
_FORMS = {
    "title": ("title", "concat(title, ' - ', source)", "concat(title, ' | ', upper(source))", "concat(title, ' – Journal du Nord')", "concat(title, ' - journal.fr')", "concat('Vidéo : <b>', title, '</b> & \"suite\"')"),
    "summary": ("''", "'Ouvrez l’article pour en savoir plus'", "substring(summary, 1, 45)", "concat(summary, '…')", "concat(summary, ' Lire la suite')", "'Résumé indisponible'", "title", "concat('Article réservé aux abonnés. ', summary)", "concat(substring(summary, 1, 200), ' —')", "concat(title, '  Journal  ', substring(summary, 1, 30), '  Revue  fin')", "summary"),
    "url": ("concat('https://www.youtube.com/watch?v=', doc_id)", "concat('https://www.example.org/video/', doc_id, '/')", "concat('https://news.google.com/rss/articles/CB', doc_id, '?hl=fr')", "concat('https://', source, '.fr/a/', doc_id, '?utm_source=x&b=2&a=1#haut')", "concat('https://Example.org/A/', doc_id, '/?fbclid=1')", "concat('no address ', doc_id)", "''", "concat('https://', source, '.com/?id=', doc_id)", "concat('https://www.example.org/watch/', doc_id)"),
    "image": ("''", "'https://cdn.example.org/favicon.ico'", "'https://cdn.example.org/photo.jpg'", "'https://cdn.example.org/site-logo.png'", "'no address'", "'https://lh3.googleusercontent.com/p'", "'https://cdn.example.org/a/b_logo.png?x=1'"),
    "dated": ("'2024-01-05T10:20:30Z'", "'hier'", "''", "'2024-01-07'"),
}
_T_TITLE, _T_SUMMARY, _T_URL, _T_IMAGE, _T_DATED = (f"CASE doc_id % {len(f)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(f)) + " END" for f in _FORMS.values())


ARTICLES_SQL = f"""
    articles AS (
        SELECT doc_id, trim(head) AS title, trim(substring(regexp_replace(substring(text, length(head) + 1), '^[.!?]', ''), 1, 650)) AS summary, source, lang,
               'https://' || source || '.example.com/a/' || doc_id AS url,
               TIMESTAMP '{AS_OF}' - to_minutes(CAST(doc_id * 37 % 44640 AS INTEGER)) AS published_at,
               list_extract(['{"','".join(CATEGORIES)}'], CAST(doc_id % 8 + 1 AS INTEGER)) AS category_hint,
               doc_id % 5 = 0 AS custom_source
        FROM (SELECT *, regexp_extract(text, '^[^.!?]{{1,200}}') AS head FROM documents)),
    reports AS (SELECT a.* REPLACE (trim(regexp_replace(substring(text, length(regexp_extract(text, '^[^.!?]{{1,200}}')) + 1), '^[.!?]', '')) AS summary) FROM articles a JOIN documents USING (doc_id)),
    headlines AS (SELECT * REPLACE (list_extract(['{"','".join(h.replace("'", "''") for h in HEADS)}'], CAST(doc_id % {len(HEADS)} + 1 AS INTEGER)) || ' ' || title AS title) FROM articles),
    teasers AS (SELECT * REPLACE ({_T_TITLE} AS title, {_T_SUMMARY} AS summary, {_T_URL} AS url), {_T_IMAGE} AS image, {_T_DATED} AS dated FROM headlines)"""


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """articles whose titles begin with one of HEADS: the tables' invented prose meets no rule on words."""
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("doc_id") % len(HEADS) + 1).cast("int"))
    return articles(spark, sf_dir).withColumn("title", F.concat(head, F.lit(" "), "title"))


def teasers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """headlines with titles, summaries, addresses, images and dates of _FORMS."""
    own = headlines(spark, sf_dir)
    made = {"title": _T_TITLE, "summary": _T_SUMMARY, "url": _T_URL, "image": _T_IMAGE, "dated": _T_DATED}
    return own.withColumns({name: F.expr(x) for name, x in made.items()})


#: Forms of addresses and marked-up paragraphs that the tables' pages lack, as expressions that Spark and DuckDB read alike.
_PAGE_URLS = ("url", "concat('https://Example.org/A/', page_id, '/?UTM_SOURCE=1&b=2&utm_source2=x&mc_foo=3&a=1#haut')", "concat('HTTPS://page', page_id, '.org')", "concat('https://example.org/p//?fbclid&gclid=', page_id)", "concat('  no address ', page_id, ' ')", "concat(url, '#a?b')")
_PAGE_HTML = ("html", "concat(html, '<p>Un &amp;lt;b&amp;gt;texte&amp;lt;/b&amp;gt; d&apos;&#233;t&#xE9; &AMP; &Nbsp;assez long pour un paragraphe, num&#00233;ro ', page_id, '</p>')", "concat(html, '<p><![CDATA[Un <i>autre</i> texte &quot;cit&eacute;&quot; &#39;assez long&#39;]]> <script>x()</script><STYLE>y</STYLE> pour un paragraphe &#65601;bien &#xZZ; &#;</p>')")
_CASES = lambda forms: f"CASE page_id % {len(forms)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(forms)) + " END"
FETCHED_SQL = f"fetched AS (SELECT page_id, {_CASES(_PAGE_URLS)} AS url, {_CASES(_PAGE_HTML)} AS html FROM pages)"


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with addresses and paragraphs of those forms."""
    return read(spark, sf_dir, "pages").select("page_id", F.expr(_CASES(_PAGE_URLS)).alias("url"), F.expr(_CASES(_PAGE_HTML)).alias("html"))


def sql_decoded(x: str) -> str:
    """DuckDB's form of text.decode_entities, written from the rule: CDATA, names, decimal and hexadecimal references."""
    x = rf"regexp_replace({x}, '(?s)<!\[CDATA\[(.*?)\]\]>', '\1', 'g')"
    for names, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "''"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"regexp_replace({x}, '{names}', '{sign}', 'gi')"
    for pattern, number in (("&#([0-9]+);", "CAST(z[2] AS HUGEINT)"), ("(?i)&#x([0-9a-f]+);", "CAST('0x' || z[2] AS BIGINT)")):
        x = f"array_to_string(list_transform(list_zip(regexp_split_to_array({x}, '{pattern}'), regexp_extract_all({x}, '{pattern}', 1)), lambda z: coalesce(z[1], '') || coalesce(chr(CAST({number} % 65536 AS INTEGER)), '')), '')"
    return x


def sql_stripped(x: str) -> str:
    x = sql_decoded(x)
    for pattern in ("<script.*?</script>", "<style.*?</style>", "<[^>]+>"):
        x = f"regexp_replace({x}, '(?is){pattern}', ' ', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as what users did with articles."""
    n_docs = read(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    kind = F.when(F.col("event_type") == "view", "impression").when(F.col("event_type") == "click", "open").when(F.col("event_type") == "signup", "more").when(F.col("event_type") == "purchase", "follow").otherwise("not")
    return read(spark, sf_dir, "events").select("event_id", "user_id", "ts", kind.alias("action"), (F.col("event_id") % n_docs).alias("doc_id"))


INTERACTIONS_SQL = """
    interactions AS (
        SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'open' WHEN 'signup' THEN 'more' WHEN 'purchase' THEN 'follow' ELSE 'not' END AS action,
               event_id % (SELECT count(*) FROM documents) AS doc_id FROM events)"""
