"""How many of a user's own rows followed its last gift, kept as rows arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps several states of a key; set it before the query starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_ROW = "ts timestamp, row_id string, category string, gift boolean, own boolean"


class _Gifts(StatefulProcessor):
    """State of a user: rows that wait for the watermark; the category of the last gift
    and the own rows since; of each category whether gifts and others were seen."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.last = handle.getValueState("last", "category string, own long, applied long")
        self.seen = handle.getMapState("seen", "category string", "gifts boolean, others boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for b in rows:
            for r in b[["ts", "row_id", "category", "gift", "own"]].itertuples(index=False, name=None):
                self.waiting.appendValue(r)
                latest = max(latest, int(r[0].timestamp() * 1000))
        if latest:
            self.handle.registerTimer(latest)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        due = sorted((r for r in held if r[0].timestamp() * 1000 <= until), key=lambda r: (r[0], r[1]))
        rest = [tuple(r) for r in held if r[0].timestamp() * 1000 > until]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if not due:
            return iter([])
        category, own, applied = self.last.get() if self.last.exists() else (None, 0, 0)
        for _, _, of, gift, mine in due:
            if of is not None:
                old = self.seen.getValue((of,)) if self.seen.containsKey((of,)) else (False, False)
                self.seen.updateValue((of,), (bool(old[0]) or bool(gift), bool(old[1]) or not gift))
            if gift:
                category, own = of, 0
            elif mine:
                own += 1
        applied += len(due)
        self.last.update((category, own, applied))
        flags = self.seen.getValue((category,)) if category is not None and self.seen.containsKey((category,)) else None
        only = flags is not None and bool(flags[0]) and not flags[1]
        return iter([pd.DataFrame({"user_id": [key[0]], "category": [category if only else None], "bucket": pd.array([min(own, self.most) if only else None], dtype="Int32"), "applied": [applied]})])

    def close(self) -> None:
        pass


def gift_buckets(events: DataFrame, gift: Column, own: Column, most: int = 10, user: str = "user_id", category: str = "subcat", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """(user_id, category, bucket, applied) of a stream of rows (user, ts, row_id,
    category): a row whenever a user's rows have passed the watermark. What a user's row
    of most `applied` says is what the batch operator of the same name says of its rows
    up to then; category and bucket are null where it has no row (no gift, or the last
    one's category is not gifts only). Rows are applied in the order of ts and row_id,
    whatever the order of their arrival within `late`; later ones are dropped. Needs the
    state store STORE. Update mode."""
    rows = events.select(F.col(user).cast("string").alias("user_id"), F.col(ts).cast("timestamp").alias("ts"), F.col("row_id").cast("string").alias("row_id"), F.col(category).cast("string").alias("category"), F.coalesce(gift, F.lit(False)).alias("gift"), F.coalesce(own, F.lit(False)).alias("own"))
    keyed = rows.withWatermark("ts", late).groupBy("user_id")
    return keyed.transformWithStateInPandas(_Gifts(most), "user_id string, category string, bucket int, applied long", "Update", "EventTime")
