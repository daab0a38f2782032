"""Filters: keyword matches, blocked terms and the watch-rule language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import text


def haystack(*columns: Column) -> Column:
    return text.normalise(F.concat_ws(" ", *columns))


def keyword_matches(hay: Column, keywords: list[str]) -> Column:
    """Those of keywords (not empty) that hay contains, in their order."""
    return F.filter(F.array(*[F.lit(k) for k in keywords if k]), lambda k: F.contains(hay, k))


def watch_rule(hay: Column, query: str, exclude: str = "") -> Column:
    """`|` parts alternatives, `+` parts what must all be there; no term of exclude (parted by `,` or `|`) may be there.

    One pattern of lookaheads, so that hay is worked out once. Terms are normalised as hay is, so they need no quoting. A wanted word of three characters or fewer has to be a whole word.
    """
    terms = lambda s, sign: [t for t in map(text.plain_topic, s.split(sign)) if t]
    whole = lambda t: f" {t} " if len(t) <= 3 and " " not in t else t
    groups = ["".join(f"(?=.*{whole(t)})" for t in terms(g, "+")) for g in query.split("|") if g.strip()]
    banned = "".join(f"(?!.*{t})" for t in terms(exclude.replace("|", ","), ","))
    return F.concat(F.lit(" "), hay, F.lit(" ")).rlike(f"^{banned}(?:{'|'.join(groups)})") if groups else F.lit(False)
