"""Rule-engine classification: a term table joined to tokens, scored, with margin and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text

#: Points of a term found in a title or a summary, of a feed's hint, and the least accepted score.
TITLE_POINTS, SUMMARY_POINTS, HINT_POINTS, LEAST_SCORE = 10, 3, 2, 6
DEFAULT_CATEGORY = "Société"


def classify(articles: DataFrame, terms: DataFrame, *, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """articles (doc_id, title, summary, category_hint), terms (rule, category, term) -> doc_id, category, score, title_hits, margin, level.

    terms is a dimension of some hundred rows, written out once for every suffix; Spark broadcasts it by its size.
    A term that a title has doesn't count again in the summary.
    """
    ends = F.explode(F.array(F.lit(""), *[F.when(F.length("term") >= 5, F.lit(s)) for s in suffixes]))
    expanded = terms.select("rule", "category", F.col("term").alias("base"), ends.alias("end")).where("end is not null").select("rule", "category", "base", F.concat("base", "end").alias("token"))
    words = lambda c, weight: articles.select("doc_id", F.explode(F.array_distinct(F.split(text.normalise(F.col(c)), " "))).alias("token"), F.lit(weight).alias("points"))
    hits = words("title", TITLE_POINTS).unionByName(words("summary", SUMMARY_POINTS)).join(expanded, "token")
    best = hits.groupBy("doc_id", "rule", "category", "base").agg(F.max("points").alias("points"))
    scored = best.groupBy("doc_id", "rule", "category").agg(F.sum("points").alias("score"), F.count_if(F.col("points") == TITLE_POINTS).alias("title_hits"))
    hinted = scored.join(articles.select("doc_id", "category_hint"), "doc_id").withColumn("score", F.col("score") + F.when(F.col("category") == F.col("category_hint"), HINT_POINTS).otherwise(0))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("title_hits"), "rule")
    top = hinted.withColumn("place", F.row_number().over(order)).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0))).where("place = 1 and score >= 6")
    level = F.when((F.col("title_hits") >= 2) & (F.col("margin") >= 4) | (F.col("score") >= 20) & (F.col("margin") >= 6), "high").when((F.col("score") >= 10) & (F.col("margin") >= 4), "medium").otherwise("low")
    found = top.select("doc_id", "category", "score", "title_hits", "margin", level.alias("level"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return articles.join(found, "doc_id", "left").select("doc_id", F.coalesce("category", "category_hint", F.lit(DEFAULT_CATEGORY)).alias("category"), zero("score"), zero("title_hits"), zero("margin"), F.coalesce("level", F.lit("low")).alias("level"))


def fast_category(articles: DataFrame, terms: DataFrame) -> DataFrame:
    """articles (doc_id, title, summary), terms (rule, category, term) of single words -> doc_id, category, hits: the category with most of its terms in the text, the first rule of equals."""
    words = articles.select("doc_id", F.explode(F.array_distinct(F.split(text.normalise(F.concat_ws(" ", "title", "summary")), " "))).alias("term"))
    counted = words.join(terms, "term").groupBy("doc_id", "rule", "category").agg(F.count("*").alias("hits"))
    best = counted.groupBy("doc_id").agg(F.min_by(F.struct("category", "hits"), F.struct(-F.col("hits"), "rule")).alias("best"))
    return articles.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("best.category", F.lit(DEFAULT_CATEGORY)).alias("category"), F.coalesce("best.hits", F.lit(0)).alias("hits"))


def repaired_category(title: Column, summary: Column, hint: Column, terms: list[tuple[int, str, str]]) -> Column:
    """hint, unless a category's terms are found inside the title: six points each and one for each of up to three in the summary; the first rule of equals."""
    a, b = text.normalise(title), text.normalise(summary)
    scores = []
    for rule, category in sorted({(r, c) for r, c, _ in terms}):
        own = F.array(*[F.lit(t) for r, _, t in terms if r == rule])
        inside = lambda x: F.size(F.filter(own, lambda t: F.contains(x, t)))  # noqa: B023, E731
        scores.append(F.struct(F.when(inside(a) > 0, 6 * inside(a) + F.least(inside(b), F.lit(3))).otherwise(0).alias("score"), F.lit(-rule).alias("rule"), F.lit(category).alias("category")))
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] >= LEAST_SCORE, best["category"]).otherwise(hint)
