"""Queries of free articles, and of the sample for audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text, times
from newsloom.operators import access, reader, selection
from newsloom.plans.adapters import AS_OF, INTERACTIONS_SQL, headlines, interactions, now, teasers
from newsloom.plans.registry import query

#: Names and addresses of sources that sell access, which the tables lack, and what was extracted, as expressions that Spark and DuckDB read alike.
_SOURCE = "CASE doc_id % 13 WHEN 0 THEN 'Le Monde' WHEN 1 THEN 'Groupe Nice-Matin (édition)' WHEN 2 THEN 'L’Équipe' ELSE source END"
_URL = "CASE doc_id % 17 WHEN 0 THEN concat('https://www.lefigaro.fr/a/', doc_id) WHEN 1 THEN concat('https://abonnes.dna.fr/', doc_id) WHEN 2 THEN concat('https://notdna.fr/', doc_id) ELSE url END"
_MATERIAL = "CASE doc_id % 3 WHEN 0 THEN 'full-text' WHEN 1 THEN 'rss' ELSE '' END"
_METHOD = "CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'article' ELSE '' END"
_CHARS = "CASE WHEN doc_id % 5 < 2 THEN doc_id % 2000 ELSE 0 END"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9.-]+', ' ', 'g'))"


_NAMES = "|".join(sorted({text.fold_known(n, ".-") for n in access.PAID_NAMES}))
_HOSTS = "|".join(h.replace(".", "[.]") for h in access.PAID_HOSTS)
_SUBSCRIBERS = reader.PAYWALL.replace("'", "''")
_SAID = r"concat_ws(' ', nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(summary, '\s+', ' ', 'g')), ''))"
_MADE = rf"""made AS (SELECT * REPLACE ({_SOURCE} AS source, {_URL} AS url) FROM teasers),
    told AS (SELECT *, regexp_matches({_norm("source")}, '({_NAMES})') OR regexp_matches(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '^(.*[.])?({_HOSTS})$') AS paid, regexp_matches({_SAID}, '(?i){_SUBSCRIBERS}') AS marked FROM made)"""


def _made(spark, sf):
    return teasers(spark, sf).withColumns({"source": F.expr(_SOURCE), "url": F.expr(_URL), "id": F.col("doc_id")})


@query(
    f"""WITH {INTERACTIONS_SQL}, {_MADE},
    hidden AS (SELECT doc_id FROM interactions WHERE action = 'not' GROUP BY doc_id ORDER BY max(ts) DESC, doc_id DESC LIMIT {access.HIDDEN_MOST})
    SELECT doc_id, CASE WHEN paid THEN 'subscription-source' WHEN marked THEN 'explicit-paywall-marker' WHEN doc_id IN (SELECT doc_id FROM hidden) THEN 'hidden' END AS reason FROM told"""
)
def free_articles(spark, sf):
    """All articles with why they aren't shown (null: free); the reader's list of 500 hides those marked last."""
    hidden = interactions(spark, sf).where("action = 'not'").select(F.col("doc_id").alias("id"), F.col("ts").alias("at"))
    return access.free_only(_made(spark, sf), hidden).select("doc_id", "reason")


@query(
    rf"""WITH {_MADE}, m AS (SELECT *, {_MATERIAL} AS material, {_METHOD} AS method, {_CHARS} AS chars, trim(regexp_replace(summary, '\s+', ' ', 'g')) AS said FROM told)
    SELECT doc_id, CASE WHEN marked THEN 'explicit-paywall-marker' WHEN NOT paid OR (material = '' AND method = '' AND chars = 0) THEN NULL
        WHEN material <> 'full-text' OR method = 'none' THEN 'paid-source-without-full-text'
        WHEN chars BETWEEN 1 AND 949 AND (regexp_matches(said, '(?:\.{{3}}|…)\s*[»”"'']?\s*$') OR regexp_matches(said, '(?i)\b(?:lire la suite|read more|en savoir plus)\s*[.!…]*$') OR regexp_matches(said, '[-–—,:;/(]\s*$')) THEN 'paid-source-truncated-teaser' END AS reason FROM m"""
)
def access_reasons(spark, sf):
    own = _made(spark, sf).withColumns({"material": F.expr(_MATERIAL), "method": F.expr(_METHOD), "content_chars": F.expr(_CHARS), "source_chars": F.lit(0)})
    return own.select("doc_id", access.access_reason(own).alias("reason"))


_AGE = f"(epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(published_at)) / 3600000.0"
_STRATA = ("source", "category_hint", f"CASE WHEN {_AGE} < 12 THEN '<12h' WHEN {_AGE} < 48 THEN '12-48h' WHEN {_AGE} < 168 THEN '2-7d' ELSE '8-31d' END", "CASE doc_id % 3 WHEN 0 THEN 'a.example' WHEN 1 THEN lang ELSE source END")
SAMPLE = 48


def _passes() -> str:
    out, taken = "", []
    for i, s in enumerate(_STRATA):
        used = " AND ".join(f"doc_id NOT IN (SELECT doc_id FROM p{k})" for k in range(i)) or "true"
        have = " + ".join(f"(SELECT count(*) FROM p{k})" for k in range(i)) or "0"
        out += f""", g{i} AS (SELECT s{i} AS v, min(ord) AS first FROM o GROUP BY 1), b{i} AS (SELECT s{i} AS v, arg_min(doc_id, ord) AS doc_id FROM o WHERE {used} GROUP BY 1),
        r{i} AS (SELECT doc_id, row_number() OVER (ORDER BY first) AS r FROM g{i} JOIN b{i} ON g{i}.v IS NOT DISTINCT FROM b{i}.v), p{i} AS (SELECT doc_id, {have} + r AS pick FROM r{i} WHERE {have} + r <= {SAMPLE})"""
        taken.append(f"SELECT * FROM p{i}")
    used = " AND ".join(f"doc_id NOT IN (SELECT doc_id FROM p{k})" for k in range(len(_STRATA)))
    have = " + ".join(f"(SELECT count(*) FROM p{k})" for k in range(len(_STRATA)))
    out += f", rest AS (SELECT doc_id, {have} + row_number() OVER (ORDER BY ord) AS pick FROM o WHERE {used})"
    return out + " SELECT doc_id, CAST(pick AS INTEGER) AS pick FROM (" + " UNION ALL ".join([*taken, "SELECT * FROM rest"]) + f") WHERE pick <= {SAMPLE}"


@query(f"WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY published_at DESC, doc_id) AS ord, " + ", ".join(f"{s} AS s{i}" for i, s in enumerate(_STRATA)) + " FROM headlines)" + _passes())
def audit_sample(spark, sf):
    """48 articles (the sample's own size): the first of each source, category, age and host that isn't chosen yet, then the newest."""
    own = headlines(spark, sf)
    host = F.when(F.col("doc_id") % 3 == 0, "a.example").when(F.col("doc_id") % 3 == 1, F.col("lang")).otherwise(F.col("source"))
    strata = [F.col("source"), F.col("category_hint"), times.age_bucket(F.col("published_at"), now()), host]
    return selection.audit_sample(own, strata, [-F.unix_millis("published_at"), F.col("doc_id")], SAMPLE).select("doc_id", "pick")
