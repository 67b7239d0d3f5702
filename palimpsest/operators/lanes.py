"""Calls to a model in lanes: each distinct prompt once, the whole at a bounded rate.

Prompts that are equal are one call. They are dealt to a fixed number of lanes, and
a lane is one task, so however many tasks made the prompts, no more lanes than that
call at once, each with its share of the allowance. A lane keeps a bounded window
of calls in flight and hands on replies in the order of its prompts.

Replies are stored in waves of prompts, by the hash of the prompt, in a table of the shared
folder, and joined back to the rows. What is stored is never sent again: not for a
second row with that prompt, not for a second use of the table, not when a later
step is computed anew. A lost executor costs the calls of its lane in the wave that
runs; a lane that starts again in the same worker finds the replies it has had.

The allowance outlives tasks. A limiter is one in each worker process, whatever the
number of tasks it comes to; what other workers have spent on a lane in the last
window stands in the stored table and is passed on; and a lane that starts again
after a failure, whose calls nobody has stored, waits as if its share were spent.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict, deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.model import Client, Limiter, Retrying, silent
from palimpsest.sources.batches import slices
from palimpsest.sources.shared import new_table, read_or_none

_STORED = "key string, reply string, error string, use string, lane int, worker string, at double, tokens long"
#: Replies that a worker remembers for a lane that starts again.
REMEMBERED = 10_000
#: Prompts of a wave, what is asked before replies are stored: where calls are rationed, and where they are not.
WAVE, FREE_WAVE = 10_000, 500_000
#: Seconds below which a call is quick, and how many such calls in a row there are before the next is made without a thread.
QUICK, QUICK_CALLS = 0.001, 16


def in_order(items: Iterable, call: Callable, window: int) -> Iterator:
    """(item, result, error) of a call for each item, in order, with at most ``window`` calls running or waiting to be handed on.

    Handing a call to a thread costs far more than a call that takes less than ``QUICK`` seconds. After some such calls in a
    row the next are made here, until one takes longer.
    """

    def timed(item):
        began = time.perf_counter()
        try:
            return call(item), None, time.perf_counter() - began
        except Exception as e:  # noqa: BLE001 - any failure belongs to its item
            return None, e, time.perf_counter() - began

    if window <= 1:
        for item in items:
            yield item, *timed(item)[:2]
        return
    flying: deque = deque()
    quick = 0

    def landed():
        nonlocal quick
        item, future = flying.popleft()
        result, e, took = future.result()
        quick = quick + 1 if took < QUICK else 0
        return item, result, e

    with ThreadPoolExecutor(window) as pool:
        for item in items:
            if quick >= QUICK_CALLS:
                while flying:
                    yield landed()
            if quick >= QUICK_CALLS:
                result, e, took = timed(item)
                quick = quick + 1 if took < QUICK else 0
                yield item, result, e
                continue
            if len(flying) == window:
                yield landed()
            flying.append((item, pool.submit(timed, item)))
        while flying:
            yield landed()


class _Memory:
    """Limiters and replies of this worker process, by use and lane."""

    def __init__(self):
        self.name = uuid.uuid4().hex
        self.lock = threading.Lock()
        self.limiters: dict[tuple, Limiter] = {}
        self.replies: OrderedDict[tuple, tuple] = OrderedDict()

    def limiter(self, key: tuple, make: Callable[[], Limiter]) -> Limiter:
        with self.lock:
            if key not in self.limiters:
                self.limiters[key] = make()
            return self.limiters[key]

    def remember(self, key: tuple, reply: tuple) -> None:
        with self.lock:
            self.replies[key] = reply
            while len(self.replies) > REMEMBERED:
                self.replies.popitem(last=False)


_MEMORY = _Memory()


def lane_client(client: Client, lane: int, lanes: int, allowance: Limiter | None, past: list[tuple[str, str, float, int]], again: bool) -> Client:
    """The client as a lane calls it: kept to the lane's share of the allowance by a limiter of this process.

    ``past`` has (worker, key, time, tokens) of calls of the last window; those of other workers count here too.
    """
    if allowance is None:
        return client

    def begun() -> Limiter:
        share = allowance.share(lanes)
        if again:
            share.spend()
        return share

    limiter, now = _MEMORY.limiter((allowance.name, lane, lanes), begun), time.time()
    limiter.remember({(worker, key): (now - at, tokens) for worker, key, at, tokens in past if worker != _MEMORY.name})
    return client.with_limiter(limiter) if isinstance(client, Retrying) else Retrying(client, attempts=1, jitter=(0.0, 0.0), limiter=limiter)


def serve(batches: Iterable[pa.RecordBatch], client: Client, use: str, lanes: int, window: int, allowance: Limiter | None, past: dict[int, list]) -> Iterator[pa.RecordBatch]:
    """What the task of a lane makes of its batches of (key, prompt)."""
    task = TaskContext.get()
    lane = task.partitionId()
    call = lane_client(client, lane, lanes, allowance, past.get(lane, []), task.attemptNumber() > 0)

    def once(item: tuple[str, str]) -> tuple:
        key, prompt = item
        if (had := _MEMORY.replies.get((use, key))) is not None:
            return had
        try:
            reply, error = call(prompt), None
        except Exception as e:  # noqa: BLE001 - any failure belongs to its prompt
            reply, error = None, str(e) or type(e).__name__
        got = key, reply, error, use, lane, _MEMORY.name, time.time(), len((reply or "").split()) + len(prompt.split())
        _MEMORY.remember((use, key), got)
        return got

    prompts = (item for b in slices(batches) for item in zip(b.column("key").to_pylist(), b.column("prompt").to_pylist()))
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int64())
    replies = (got for _, got, _ in in_order(prompts, once, window))
    while some := list(islice(replies, 64)):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some), kinds)], names=[c.split(" ")[0] for c in _STORED.split(", ")])


def answered(
    prompts: DataFrame, client: Client = silent, store: str | None = None, lanes: int = 8, window: int = 3, allowance: Limiter | None = None, wave: int | None = None
) -> DataFrame:
    """Adds ``reply`` and ``error`` to rows with a ``prompt``; the calls are made here, each distinct prompt once.

    ``store`` names a table of replies that outlives this use; without it there is one for this use alone. ``lanes``
    tasks call at once, each with ``window`` calls in flight; ``allowance`` is that of all lanes together and sets how
    many lanes there can be, a client that is ``Retrying`` brings its own. A null prompt is no call, a failing call is an
    error of all rows with its prompt, and is tried again in the next use of the store. Columns of these names are
    replaced.
    """
    spark = prompts.sparkSession
    rows = prompts.drop("reply", "error").withColumn("_key", F.sha2("prompt", 256))
    at, use = store or new_table(spark, "replies"), uuid.uuid4().hex
    allowance = allowance or (client.limiter if isinstance(client, Retrying) else None)
    wave = wave or (WAVE if allowance else FREE_WAVE)
    lanes = max(1, min(lanes, allowance.requests) if allowance else lanes)

    asked = new_table(spark, "prompts")
    # Distinct without a smallest text of each key, for which the engine would sort twice.
    rows.filter("prompt is not null").select(F.col("_key").alias("key"), "prompt").distinct().write.parquet(asked)
    asked = spark.read.parquet(asked)
    known = read_or_none(spark, at)
    left = asked if known is None else asked.join(known.filter("error is null").select("key"), "key", "left_anti")
    waves = -(-left.count() // wave)
    if waves > 1:
        # Each wave is a folder of its own, so a wave reads its prompts and not those of all.
        by_turn = new_table(spark, "waves")
        left.select("key", "prompt", F.pmod(F.xxhash64("key"), F.lit(waves)).cast("int").alias("turn")).repartition(F.col("turn"), F.pmod(F.xxhash64("prompt"), F.lit(lanes))).write.partitionBy("turn").parquet(by_turn)
    for turn in range(waves):
        past: dict[int, list] = {}
        if allowance is not None and (known := read_or_none(spark, at)) is not None:
            # The calls of one window, no more than the allowance has requests.
            for r in known.filter(F.col("at") > time.time() - allowance.seconds).select("lane", "worker", "key", "at", "tokens").collect():
                past.setdefault(r.lane % lanes, []).append((r.worker, r.key, r.at, r.tokens))
        served = partial(serve, client=client, use=use, lanes=lanes, window=window, allowance=allowance, past=past)
        own = left if waves == 1 else read_or_none(spark, f"{by_turn}/turn={turn}")
        if own is None:
            continue
        own.select("key", "prompt").repartition(lanes).mapInArrow(served, _STORED).write.mode("append").parquet(at)
    known = read_or_none(spark, at)
    if known is None:
        return rows.withColumn("reply", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string")).drop("_key")
    if store is not None:
        # Without one each prompt has been answered once.
        known = known.withColumn("_place", F.row_number().over(W.partitionBy("key").orderBy(F.col("error").isNotNull(), F.desc("at")))).filter("_place = 1")
    return rows.join(known.select(F.col("key").alias("_key"), "reply", "error"), "_key", "left").drop("_key")
