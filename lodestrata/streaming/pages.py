"""The page controller as a stateful stream: tells each crawl where to stop while its pages come in.

What a page says by itself (ends, dates before the cutoff, budgets) is worked out by the
expressions of the batch form, coverage.judged(), before the stream is grouped.  The state
of a crawl (source, keyword, context) is the next page, the streak of pages that
added nothing, and the pages that came before their turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.coverage import COMPLETE, KEY, PageOptions, judged

#: The state store that typed state needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_OUT = "source string, keyword string, context string, page long, reason string, coverage_complete boolean, oldest_date string"
_HEAD = "next long, streak int, stopped boolean"
_PAGE = "added int, stop string, cap string, repeats boolean, tolerance int, oldest_date string"


class PageController(StatefulProcessor):
    """Emits one row for each crawl, when it stops.

    Pages are numbered without gaps from `first`.  A page waits for those before it; pages behind
    the stop, and pages that come again, are passed over.  With `ttl_ms`, state that isn't touched for so
    long goes, so that crawls which broke off don't stay for ever; such a stream always has
    another batch to run, so it is for triggers by time, not for availableNow.
    """

    def __init__(self, first: int = 1, ttl_ms: int | None = None):
        self._first, self._ttl = first, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._head = handle.getValueState("head", _HEAD, self._ttl)
        self._waiting = handle.getMapState("waiting", "page long", _PAGE, self._ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at, streak, stopped = self._head.get() if self._head.exists() else (self._first, 0, False)
        came: dict[int, tuple] = {}
        for part in rows:
            if not stopped:
                for page, *values in part[["page", "added", "stop", "cap", "repeats", "tolerance", "oldest_date"]].astype(object).where(part.notna(), None).itertuples(index=False):
                    if page >= at:
                        came.setdefault(int(page), tuple(values))
        while not stopped:
            if at in came:
                page = came.pop(at)
            elif self._waiting.exists() and self._waiting.containsKey((at,)):
                page = self._waiting.getValue((at,))
                self._waiting.removeKey((at,))
            else:
                break
            added, stop, cap, repeats, tolerance, oldest = page
            streak = streak + 1 if added == 0 else 0
            reason = stop or ("repeated_page" if repeats and streak >= tolerance else None) or cap
            if reason:
                stopped = True
                yield pd.DataFrame([(*key, at, reason, reason in COMPLETE, oldest)], columns=[*KEY, "page", "reason", "coverage_complete", "oldest_date"])
            at += 1
        if stopped:
            self._waiting.clear()
        else:
            for page, values in came.items():
                if not self._waiting.containsKey((page,)):
                    self._waiting.updateValue((page,), values)
        self._head.update((at, streak, stopped))

    def close(self) -> None:
        pass


def stops(pages: DataFrame, o: PageOptions, first: int = 1, ttl_ms: int | None = None) -> DataFrame:
    """source, keyword, context, page, reason, coverage_complete, oldest_date of a stream of pages, as each crawl stops.

    The same rows as coverage.first_stop() of all pages, whatever micro-batches they come in and in which order.
    """
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    own = judged(pages, o).select(*KEY, F.col("page").cast("long").alias("page"), F.col("added").cast("int").alias("added"), F.col("_end").alias("stop"), F.col("_cap").alias("cap"), F.col("_repeats").alias("repeats"), F.col("_tolerance").cast("int").alias("tolerance"), "oldest_date")
    return own.groupBy(*KEY).transformWithStateInPandas(PageController(first, ttl_ms), _OUT, "Append", "ProcessingTime" if ttl_ms else "None")
