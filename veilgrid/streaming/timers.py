"""Throttle, debounce and change stamps over streams, with state by key and timers in event time.

Events are ``job_id, seq, t_ms`` with ``at``, the same time as a timestamp, on which the stream has a watermark.
What comes out is what the batch operators give for the same events, if none is later than the watermark allows.

Cases: events of one job and time go by ``seq``; late events beyond the watermark are dropped by
Spark; events of a micro-batch come in any order; an event of null job or time is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENT = "job_id bigint, t_ms bigint, seq bigint"


def timed(events: DataFrame, delay: str) -> DataFrame:
    """``job_id, seq, t_ms, at`` with a watermark ``delay`` behind."""
    at = F.timestamp_millis(F.col("t_ms"))
    whole = events.where("job_id is not null and t_ms is not null").select(F.col("job_id").cast("bigint"), F.col("seq").cast("bigint"), F.col("t_ms").cast("bigint"), at.alias("at"))
    return whole.withWatermark("at", delay)


class _Held(StatefulProcessor):
    """Events wait until the watermark has passed them; then they are settled in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t_ms bigint, seq bigint")
        self.taken = handle.getValueState("taken", "t_ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(rows)[["t_ms", "seq"]]
        self.waiting.appendList([tuple(map(int, r)) for r in new.itertuples(index=False)])
        for t in sorted({self.due(int(t)) for t in new["t_ms"]}):
            self.handle.registerTimer(t)
        yield self.frame(key, [])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        out, left = self.settle(waiting, now)
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        yield self.frame(key, out)

    def frame(self, key: tuple, rows: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], t, s) for t, s in rows], columns=["job_id", "t_ms", "seq"]).astype("int64")

    def due(self, t: int) -> int:
        """When an event can be settled."""
        raise NotImplementedError

    def settle(self, waiting: list[tuple[int, int]], now: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """The events that come out, and those that wait on."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Throttle(_Held):
    """An event is taken if the one taken before lies ``least_ms`` back."""

    def __init__(self, least_ms: int):
        self.least_ms = least_ms

    def due(self, t: int) -> int:
        return t + 1

    def settle(self, waiting: list[tuple[int, int]], now: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        last = self.taken.get()[0] if self.taken.exists() else None
        out = []
        for t, seq in waiting:
            if t < now and (last is None or t - last >= self.least_ms):
                out.append((t, seq))
                last = t
        if out:
            self.taken.update((last,))
        return out, [r for r in waiting if r[0] >= now]


class Debounce(_Held):
    """An event comes out once nothing else has come for ``wait_ms``; of events of one time only the last may."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def due(self, t: int) -> int:
        return t + self.wait_ms

    def settle(self, waiting: list[tuple[int, int]], now: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        out, left = [], []
        for k, (t, seq) in enumerate(waiting):
            following = waiting[k + 1][0] if k + 1 < len(waiting) else None
            if following is not None and following - t < self.wait_ms:
                continue  # another event takes its place
            if t + self.wait_ms <= now:
                out.append((t, seq))
            else:
                left.append((t, seq))
        return out, left


def throttle_stream(events: DataFrame, least_ms: int, delay: str = "2 seconds") -> DataFrame:
    """``operators.rates.throttle`` over a stream."""
    return timed(events, delay).groupBy("job_id").transformWithStateInPandas(Throttle(least_ms), EVENT, "Append", "EventTime")


def debounce_stream(events: DataFrame, wait_ms: int, delay: str = "2 seconds") -> DataFrame:
    """``operators.rates.debounce`` over a stream."""
    return timed(events, delay).groupBy("job_id").transformWithStateInPandas(Debounce(wait_ms), EVENT, "Append", "EventTime")


def current_results_stream(requests: DataFrame, results: DataFrame, longest_ms: int, delay: str = "2 seconds") -> DataFrame:
    """``operators.export.current_results`` over two streams: results that no newer request of their key came before.

    ``requests``: ``key, stamp, asked_ms``; ``results``: ``key, stamp, done_ms``, done ``longest_ms`` after they were asked for at most. A
    result joins the requests of its key that are newer and were made before it was done, by an interval; as a left
    join it comes out, once the watermark is past, only where there is none.
    """
    asked = requests.select(F.col("key").alias("of"), F.col("stamp").alias("newer"), F.timestamp_millis(F.col("asked_ms")).alias("asked_at")).withWatermark("asked_at", delay)
    done = results.select("key", "stamp", "done_ms", F.timestamp_millis(F.col("done_ms")).alias("done_at")).withWatermark("done_at", delay)
    within = (F.col("key") == F.col("of")) & (F.col("newer") > F.col("stamp")) & (F.col("asked_at") <= F.col("done_at")) & (F.col("asked_at") >= F.col("done_at") - F.expr(f"interval {longest_ms} milliseconds"))
    return done.join(asked, within, "leftOuter").where("newer is null").select("key", "stamp", "done_ms")


def upsert_stream(changes: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """A writer that keeps the latest row of each key in a folder of tables, each frame once, however often it is begun again.

    Every micro-batch writes a whole new generation beside the last one and then names it in one small file; a batch that
    is given again after a crash finds its number there, or writes the same generation anew.
    """
    from pyspark.sql import Window

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held, last = generation(path)
        if held is not None and number <= held:
            return
        rows = batch if last is None else spark.read.parquet(last).unionByName(batch)
        newest = Window.partitionBy(*keys).orderBy(F.desc(order))
        rows.withColumn("r__", F.row_number().over(newest)).where("r__ = 1").drop("r__").write.mode("overwrite").parquet(f"{path}/generation-{number}")
        name_generation(path, number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def generation(path: str) -> tuple[int | None, str | None]:
    """Number and folder of the generation that holds."""
    from veilgrid.sources.workspaces import local, read_json

    named = read_json(f"{local(path)}/current.json")
    return (named["number"], f"{path}/generation-{named['number']}") if named else (None, None)


def name_generation(path: str, number: int) -> None:
    from veilgrid.sources.workspaces import local, replace_json

    replace_json(f"{local(path)}/current.json", {"number": number})
