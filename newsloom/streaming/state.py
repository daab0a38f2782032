"""State across refreshes: feedback learning as an ordered fold, and stream forms of windows and deduplication."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of actions (others have none), shares of an article's first topics, and bounds of the store.
WEIGHTS = {"more": 0.35, "less": -0.3, "follow": 0.55, "not": -0.45}
TOPIC_SHARES = (1.0, 0.6, 0.35)
LIMIT, LEAST, MOST_TOPICS = 2.0, 0.01, 80
_THREE = Decimal("0.001")


def _move(weights: dict[str, float], topics: list[str], delta: float) -> None:
    """One event: each topic's weight moves by its share of delta, is clamped and rounded; tiny weights go, and of the
    others the MOST_TOPICS largest stay, older ones first where they are equal."""
    for topic, share in zip(topics, TOPIC_SHARES, strict=False):
        exact = Decimal(max(-LIMIT, min(LIMIT, weights.get(topic, 0.0) + delta * share)))
        new = float(exact.quantize(_THREE, ROUND_HALF_UP))
        if abs(new) < LEAST:
            weights.pop(topic, None)
        else:
            weights[topic] = new
    if len(weights) > MOST_TOPICS:
        kept = sorted(weights.items(), key=lambda x: -abs(x[1]))[:MOST_TOPICS]
        weights.clear()
        weights.update(kept)


def feedback_deltas(events: DataFrame) -> DataFrame:
    """events (user_id, doc_id, ts, event_id, action, topics) -> those that change something, with delta.

    An action takes the place of the user's previous one on that article: its weight counts less the other's.
    """
    weight = F.coalesce(F.create_map(*[F.lit(x) for item in WEIGHTS.items() for x in item])[F.col("action")], F.lit(0.0))
    own = events.where(F.col("action").isin(*WEIGHTS, "none")).withColumn("weight", weight)
    before = F.lag("weight").over(Window.partitionBy("user_id", "doc_id").orderBy("ts", "event_id"))
    told = own.withColumn("delta", F.col("weight") - F.coalesce(before, F.lit(0.0)))
    topics = F.slice(F.filter(F.array_distinct(F.transform("topics", lambda t: F.trim(t))), lambda t: t.isNotNull() & ~t.isin("", "À suivre")), 1, len(TOPIC_SHARES))
    return told.withColumn("topics", topics).where((F.abs("delta") >= 0.001) & (F.size("topics") > 0))


def feedback(events: DataFrame) -> DataFrame:
    """events (user_id, doc_id, ts, event_id, action, topics; action none takes one back) -> user_id, topic, weight.

    Every step clamps, rounds and drops, so the fold isn't a sum: a user's events are read in order by one task. They
    stream through it, and what is held is one user's MOST_TOPICS weights.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, weights, done = None, {}, []

        def end():
            done.extend((user, t, w) for t, w in sorted(weights.items()))
            weights.clear()

        for frame in frames:
            for own, topics, delta in zip(frame["user_id"], frame["topics"], frame["delta"], strict=True):
                if own != user:
                    end()
                    user = own
                _move(weights, list(topics), delta)
            yield pd.DataFrame(done, columns=["user_id", "topic", "weight"])
            done.clear()
        end()
        yield pd.DataFrame(done, columns=["user_id", "topic", "weight"])

    ordered = feedback_deltas(events.where("user_id is not null")).select("user_id", "ts", "event_id", "topics", "delta").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return ordered.mapInPandas(fold, "user_id bigint, topic string, weight double")


def windowed_counts(events: DataFrame, *, hours: int = 72, late_days: int = 62) -> DataFrame:
    """Counts and sums by tumbling window and event type; the same plan for a table and for a stream."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{late_days} days")
    return marked.groupBy(F.window("ts", f"{hours} hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def unseen(stream: DataFrame, key: str, at: str, late_days: int = 62) -> DataFrame:
    """The first row of each key within the time that late rows are taken."""
    return stream.withWatermark(at, f"{late_days} days").dropDuplicatesWithinWatermark([key])
