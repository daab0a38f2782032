"""Free articles only: sources that sell access, texts that say so, and what a reader's list hides."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text, urls
from newsloom.operators import reader

#: Hosts and names of sources that sell access.
PAID_HOSTS = (
    "lemonde.fr", "lesechos.fr", "lefigaro.fr", "liberation.fr", "mediapart.fr", "courrierinternational.com", "la-croix.com", "lepoint.fr", "lexpress.fr", "nouvelobs.com", "challenges.fr",
    "latribune.fr", "lejdd.fr", "lequipe.fr", "ouest-france.fr", "sudouest.fr", "letelegramme.fr", "lavoixdunord.fr", "republicain-lorrain.fr", "estrepublicain.fr", "dna.fr", "lalsace.fr",
    "leprogres.fr", "ledauphine.com", "bienpublic.com", "lejsl.com", "midilibre.fr", "ladepeche.fr", "lamontagne.fr", "nice-matin.fr", "varmatin.com", "leparisien.fr",
)
PAID_NAMES = (
    "le monde", "les echos", "le figaro", "liberation", "libération", "mediapart", "courrier international", "la croix", "le point", "l express", "l'express", "le nouvel obs", "nouvel obs", "challenges",
    "la tribune", "le jdd", "journal du dimanche", "l equipe", "l'équipe", "ouest france", "ouest-france", "sud ouest", "le telegramme", "le télégramme", "la voix du nord", "republicain lorrain",
    "républicain lorrain", "est republicain", "est républicain", "dernieres nouvelles d alsace", "dernières nouvelles d'alsace", "dna", "l alsace", "l'alsace", "le progres", "le progrès", "le dauphine",
    "le dauphiné", "le bien public", "journal de saone et loire", "journal de saône-et-loire", "midi libre", "la depeche", "la dépêche", "la montagne", "nice matin", "nice-matin", "var matin", "var-matin", "le parisien",
)
#: How much text is little, and how long a reader's list is.
CONTENT_CHARS, SOURCE_CHARS, HIDDEN_MOST = 950, 850, 500


def paid_source(source: Column, url: Column) -> Column:
    """Whether a source's name holds one of PAID_NAMES, or its host is one of PAID_HOSTS or below one."""
    quoted = lambda values: "|".join(re.escape(v) for v in values)
    names = sorted({text.fold_known(n, ".-") for n in PAID_NAMES})
    named = text.normalise(source, ".-").rlike(quoted(names))
    return F.coalesce(named, F.lit(False)) | F.coalesce(urls.host(url).rlike(rf"^(?:.*\.)?(?:{quoted(PAID_HOSTS)})$"), F.lit(False))


def access_reason(article: DataFrame) -> Column:
    """Why rows (title, source, url, summary, material, method, content_chars, source_chars) aren't free to read; null if they are,
    or if nothing was extracted that could tell."""
    c = F.col
    said = lambda name: text.clean(F.coalesce(c(name), F.lit("")))
    chars = lambda name: F.coalesce(c(name), F.lit(0))
    evidence = (said("material") != "") | (said("method") != "") | (chars("content_chars") > 0) | (chars("source_chars") > 0)
    weak = (said("material") != "full-text") | said("method").isin("page-metadata", "none")
    short = chars("content_chars").between(1, CONTENT_CHARS - 1) | chars("source_chars").between(1, SOURCE_CHARS - 1)
    paid = paid_source(c("source"), c("url")) & evidence
    return F.when(reader.paywalled(c("title"), c("summary")), "explicit-paywall-marker").when(paid & weak, "paid-source-without-full-text").when(paid & short & reader.visibly_cut(c("summary")), "paid-source-truncated-teaser")


def newest_hidden(hidden: DataFrame, most: int = HIDDEN_MOST) -> DataFrame:
    """hidden (id, at) -> the ids of the `most` hidden last: the list's own size."""
    return hidden.groupBy("id").agg(F.max("at").alias("at")).orderBy(F.desc("at"), F.desc("id")).limit(most).select("id")


def free_only(articles: DataFrame, hidden: DataFrame) -> DataFrame:
    """articles (id, title, source, url, summary) with reason: subscription-source, explicit-paywall-marker, hidden, or null for what stays."""
    own = F.when(paid_source(F.col("source"), F.col("url")), "subscription-source").when(reader.paywalled(F.col("title"), F.col("summary")), "explicit-paywall-marker")
    told = articles.withColumn("_own", own).join(newest_hidden(hidden).withColumn("_hidden", F.lit(True)), "id", "left")
    return told.withColumn("reason", F.coalesce("_own", F.when(F.col("_hidden"), "hidden"))).drop("_own", "_hidden")
