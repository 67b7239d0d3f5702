"""Rate windows over a stream of requests: what ``contexts.rate_windows`` says of a table, said as requests arrive.

Requests of a key wait until the watermark has passed them, so they are counted in
the order of their times however they arrive, and each is given out once. A key
keeps the requests of one window; when the watermark is a window past its last one,
a timer lets them go, so keys that fall silent leave no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STATE = "at long, id long, tokens long"


class _Windows(StatefulProcessor):
    def __init__(self, seconds: int, most_requests: int, most_tokens: int):
        self.span, self.most_requests, self.most_tokens = seconds * 1_000_000, most_requests, most_tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _STATE)
        self.past = handle.getListState("past", _STATE)

    def _timer(self, at: int) -> None:
        """A timer for when the watermark has passed a time in microseconds."""
        self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for r in rows:
            at = r["at"].tolist()
            self.waiting.appendList(list(zip(at, r["id"].tolist(), r["tokens"].tolist())))
            first = min(at) if first is None else min(first, *at)
        if first is not None:
            self._timer(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        edge = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        due, later = [x for x in waiting if x[0] < edge], [x for x in waiting if x[0] >= edge]
        past = [tuple(x) for x in self.past.get()] if self.past.exists() else []
        out, start, total = [], 0, sum(x[2] for x in past)
        for at, id_, tokens in due:
            while start < len(past) and past[start][0] <= at - self.span:
                total -= past[start][2]
                start += 1
            n = len(past) - start
            out.append((at, id_, tokens, n, total, n >= self.most_requests or total + tokens >= self.most_tokens))
            past.append((at, id_, tokens))
            total += tokens
        past = [x for x in past[start:] if x[0] > edge - self.span]
        for state, rows in ((self.waiting, later), (self.past, past)):
            state.put(rows) if rows else state.clear()
        if later:
            self._timer(later[0][0])
        elif past:
            self._timer(past[-1][0] + self.span)
        if out:
            yield pd.DataFrame(out, columns=["at", "id", "tokens", "requests_before", "tokens_before", "limited"]).assign(key=key[0])[["key", "at", "id", "tokens", "requests_before", "tokens_before", "limited"]]
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def rate_windows(requests: DataFrame, seconds: int = 60, most_requests: int = 450, most_tokens: int = 81_000, late: str = "10 seconds") -> DataFrame:
    """For a stream of (key, ts, id, tokens), whole numbers but for ts: requests and tokens of the last window before each, and whether a limit is reached.

    A request later than ``late`` behind the latest one is not counted. Requests with a null among them take no part.
    Needs a state store that keeps timers (RocksDB).
    """
    given = requests.filter("key is not null and ts is not null and id is not null and tokens is not null")
    given = given.withWatermark("ts", late).selectExpr("CAST(key AS long) AS key", "ts", "unix_micros(ts) AS at", "CAST(id AS long) AS id", "CAST(tokens AS long) AS tokens")
    schema = "key long, at long, id long, tokens long, requests_before long, tokens_before long, limited boolean"
    found = given.groupBy("key").transformWithStateInPandas(_Windows(seconds, most_requests, most_tokens), schema, "Append", "EventTime")
    return found.selectExpr("key", "timestamp_micros(at) AS ts", "id", "tokens", "requests_before", "tokens_before", "limited")
