"""An order in which neighbours differ: the next row is the best of the first few that are left, by what came last.

The choice looks WINDOW rows ahead and depends on the last two rows, so it is a fold with a bounded state: a list's rows
stream through one task in order, which holds WINDOW rows and two. Lists (days, readers) are dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are looked at, how much less important than the first one a row may be, and points.
WINDOW, GAP = 5, 28
LATER, SAME_CATEGORY, CATEGORY_BEFORE, SAME_SOURCE, ESSENTIAL = -7, -18, -7, -11, 4


def _next(pool: list[tuple], last: tuple | None, before: tuple | None) -> int:
    """The place in pool of the row to come. Rows are (id, category, source, essential, importance)."""
    best, value = 0, float("-inf")
    for k, row in enumerate(pool):
        if k and pool[0][4] - row[4] > GAP:
            continue
        points = LATER * k
        if last is not None and row[1] == last[1]:
            points += SAME_CATEGORY
        if before is not None and row[1] == before[1]:
            points += CATEGORY_BEFORE
        if last is not None and row[2] == last[2]:
            points += SAME_SOURCE
        if row[3]:
            points += ESSENTIAL
        if points > value:
            best, value = k, points
    return best


def diversified(rows: DataFrame, group: str, order: list[Column], *, id_col: str = "doc_id") -> DataFrame:
    """rows (id_col, group, category, source, essential, importance) -> group, id_col and place (from 1) in each group's new order.

    A null group is a group; order has to end in what tells rows apart.
    """
    kind = rows.schema[group].dataType.simpleString()

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, pool, shown, place = None, [], [None, None], 0

        def take(out: list) -> None:
            nonlocal place
            row = pool.pop(_next(pool, shown[1], shown[0]))
            place += 1
            shown[:] = shown[1], row
            out.append((own[0], row[0], place))

        for frame in frames:
            out: list[tuple] = []
            for key, *row in zip(*(frame[c] for c in ("_group", "_id", "category", "source", "essential", "importance")), strict=True):
                now = (None if pd.isna(key) else key,)
                if now != own:
                    while pool:
                        take(out)
                    own, shown[:], place = now, [None, None], 0
                pool.append(tuple(row))
                if len(pool) == WINDOW:
                    take(out)
            yield pd.DataFrame(out, columns=[group, id_col, "place"])
        out = []
        while pool:
            take(out)
        yield pd.DataFrame(out, columns=[group, id_col, "place"])

    own = rows.withColumns({"_group": F.col(group), "_id": F.col(id_col)})
    dealt = own.repartition("_group").sortWithinPartitions(F.col("_group"), *order).select("_group", "_id", "category", "source", "essential", "importance")
    return dealt.mapInPandas(fold, f"{group} {kind}, {id_col} {rows.schema[id_col].dataType.simpleString()}, place bigint")
