"""Story memory as a stream's state: a map of stories for each scope, that expire and are evicted.

Each micro-batch is one refresh of the scopes in it: articles are compared with the stories that earlier micro-batches
left, then remembered. What a scope holds is bounded (`most` stories, for `days` days), its articles stream through, and
only ids and times of the newest `most` of them are held until the batch ends. The state store has to be RocksDB.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsloom.operators import memory
from newsloom.operators import novelty as precise

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORY = "refresh date, title string, published_at timestamp, tokens array<string>, facts array<string>, actions array<string>, entities array<string>, place bigint"
_REPORT = "struct<title:string,published_at:timestamp,facts:array<string>,actions:array<string>,entities:array<string>>"
MATCHED = f"scope string, id bigint, size int, current {_REPORT}, previous_id bigint, previous {_REPORT}"
_FIELDS = ("title", "published_at", "facts", "actions", "entities")


class StoryMemory(StatefulProcessor):
    """Rows of articles -> MATCHED: each with the most alike story of the memory before its batch, if any."""

    def __init__(self, like: memory.Likeness = memory.REFINED, most: int = memory.REFINED_MOST, days: int = memory.MEMORY_DAYS):
        self.like, self.most, self.days = like, most, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stories = handle.getMapState("stories", "id bigint", _STORY)
        self.placed = handle.getValueState("placed", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        known = {own[0]: _plain(story) for own, story in self.stories.iterator()} if self.stories.exists() else {}
        by_token: dict[str, list[int]] = {}
        for own, story in known.items():
            for t in story["tokens"]:
                by_token.setdefault(t, []).append(own)
        newest: list[tuple] = []  # a heap of the newest `most` of this batch: (refresh, id, arrival, story)
        refresh, arrival = None, itertools.count()
        for frame in rows:
            out = []
            for row in frame.to_dict("records"):
                story = _plain(row)
                refresh = story["refresh"] if refresh is None else max(refresh, story["refresh"])
                best = self._best(row["id"], story, known, by_token)
                out.append((key[0], row["id"], len(story["tokens"]), {f: story[f] for f in _FIELDS}, best, None if best is None else {f: known[best][f] for f in _FIELDS}))
                item = (story["refresh"], row["id"], next(arrival), story)
                heapq.heappush(newest, item) if len(newest) < self.most else heapq.heappushpop(newest, item)
            yield pd.DataFrame(out, columns=["scope", "id", "size", "current", "previous_id", "previous"]).astype({"previous_id": "Int64"})
        self._keep(known, sorted(newest, key=lambda x: x[:3]), refresh)

    def _best(self, own: int, story: dict, known: dict, by_token: dict) -> int | None:
        size = len(story["tokens"])
        if size < self.like.least_tokens:
            return None
        found = []
        for other, common in Counter(o for t in story["tokens"] for o in by_token.get(t, ())).items():
            old = known[other]
            if other == own or (story["refresh"] - old["refresh"]).days > self.days:
                continue
            coverage, jaccard = common / min(size, len(old["tokens"])), common / (size + len(old["tokens"]) - common)
            near = coverage >= self.like.coverage or (self.like.jaccard is not None and jaccard >= self.like.jaccard)
            if common >= self.like.common and near:
                found.append((coverage * self.like.by_coverage + jaccard * self.like.by_jaccard, -old["place"], other))
        return max(found)[2] if found else None

    def _keep(self, known: dict, added: list[tuple], refresh) -> None:
        """Adds the batch's stories; those that are too old or too many go."""
        place = self.placed.get()[0] if self.placed.exists() else 0
        for _, own, _, story in added:
            place += 1
            known[own] = story | {"place": place}
            self.stories.updateValue((own,), tuple(known[own][c.split()[0]] for c in _STORY.split(", ")))
        self.placed.update((place,))
        order = sorted(known, key=lambda own: known[own]["place"])
        old = {own for own in order if (refresh - known[own]["refresh"]).days > self.days}
        for own in old | set(order[: max(0, len(order) - self.most)]):
            self.stories.removeKey((own,))

    def close(self) -> None:
        pass


def _plain(row) -> dict:
    own = dict(zip((c.split()[0] for c in _STORY.split(", ")), row, strict=True)) if not isinstance(row, dict) else dict(row)
    out = {f: list(own[f]) if own[f] is not None else [] for f in ("tokens", "facts", "actions", "entities")}
    at = own["published_at"]
    return {"refresh": pd.Timestamp(own["refresh"]).date(), "title": own["title"], "published_at": None if pd.isna(at) else pd.Timestamp(at).to_pydatetime(), "place": own.get("place"), **out}


def refined_stream(articles: DataFrame, *, most: int = memory.REFINED_MOST, days: int = memory.MEMORY_DAYS) -> DataFrame:
    """A stream of articles (scope, id, refresh, title, published_at, tokens, facts, actions, entities) -> as operators.memory.refine(), with scope."""
    articles.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    columns = ["scope", "id", "refresh", "title", "published_at", "tokens", "facts", "actions", "entities"]
    matched = articles.select(*columns).groupBy("scope").transformWithStateInPandas(StoryMemory(memory.REFINED, most, days), MATCHED, "Update", "None")
    judged = precise.novelty(matched)
    enough, old = F.col("size") >= memory.REFINED.least_tokens, F.col("previous_id").isNotNull()
    return judged.select(
        "scope",
        "id",
        "previous_id",
        F.when(old, F.col("state")).otherwise("new").alias("state"),
        F.when(old, F.col("delta")).when(enough, memory.NEW_POINTS).otherwise(0).alias("delta"),
        F.when(old, F.col("reason")).when(enough, "Nouvelle information").otherwise("").alias("reason"),
        F.when(old, F.col("confidence")).otherwise("legacy").alias("confidence"),
    )
