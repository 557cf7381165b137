"""Structured Streaming jobs; every one has a batch twin in ``operators``.

Event times are cast to TIMESTAMP first: a watermark refuses zone-less times. State is bounded
by watermarks, and results go to file sinks or ``foreachBatch`` merges that can be replayed.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.numbers import ratio
from ..operators import answers as answer_jobs
from ..operators import web
from ..session import shared_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, glob: str = "events*.parquet", max_files: int | None = None) -> DataFrame:
    """Landed events of a folder, or of one file. A backlog is read in one trigger.

    With ``max_files`` per trigger a backlog comes in arbitrary order, and rows behind the watermark of
    an earlier trigger would be dropped; set it only where files land in the order of their events.
    """
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def active_users(events: DataFrame, late: str = "10 minutes", length: str = "30 minutes", step: str = "5 minutes") -> DataFrame:
    """Users by page over sliding windows, counted exactly by two operators in a row.

    The first keeps one row per user, page and window, the second counts the rows that it closes. Windows end
    at different steps, so a tumbling window of one step around its end stands for each.
    """
    once = events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), "page", "user_id").agg(F.count("*").alias("n"))
    end = F.window(F.window_time("w"), step).alias("e")
    users = once.groupBy(end, "page").agg(F.count("user_id").alias("active_users"))
    start = F.unix_seconds(F.col("e.end")) - F.unix_seconds(F.lit(0).cast("timestamp") + F.expr(f"INTERVAL {length}"))
    return users.select(start.alias("window_start"), "page", "active_users")


def daily_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events and value per type and day, emitted once a day is complete."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(18,2)").alias("value"))
        .select(F.to_date("w.start").alias("day"), "event_type", "n", "value")
    )


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Closed sessions per user."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("s"), "user_id")
        .agg(F.count("*").alias("n_events"))
        .select("user_id", F.unix_micros("s.start").alias("start_us"), (F.unix_micros("s.end") - 30 * 60 * 1_000_000).alias("end_us"), "n_events")
    )


def dedupe(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """First arrival per key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def mentions(log: DataFrame, brand: list[str], competitors: list[str], domains: list[str], late: str = "1 hour") -> DataFrame:
    """Mention and citation rate per engine and day from the answer log."""
    a = answer_jobs.analyze(log.withWatermark("ts", late), brand, competitors, domains)
    ok = F.col("error").isNull()
    return (
        a.groupBy(F.window("ts", "1 day").alias("w"), "engine")
        .agg(
            F.count("*").alias("calls"),
            ratio(F.count_if(ok & F.col("brand_mentioned")), F.count_if(ok), 4).alias("mention_rate"),
            ratio(F.count_if(ok & F.col("our_url_cited")), F.count_if(ok), 4).alias("citation_rate"),
        )
        .select(F.to_date("w.start").alias("day"), "engine", "calls", "mention_rate", "citation_rate")
    )


def enrich(log: DataFrame, site_config: DataFrame, on: str = "site") -> DataFrame:
    """Stream-static join: the static side is planned as broadcast only when it is small."""
    return log.join(site_config, on, "left")


#: Setting of queries with state of their own.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Rows of a user that wait in one entry of its state.
CHUNK = 10_000


class FunnelSteps(StatefulProcessor):
    """How far each user is: rows wait until the watermark has passed them, and then move the user on in the order of event time.

    What is kept of a user is the last step with its time and the waiting rows, packed into one entry per micro-batch (or
    ``CHUNK`` rows), with one timer under the first of them. So the calls to the state store grow with users and
    micro-batches, not with rows.
    """

    def __init__(self, n_steps: int):
        self.n_steps = n_steps

    def init(self, handle) -> None:
        self.handle = handle
        self.reached = handle.getValueState("reached", "steps_done int, last_us bigint, due bigint")
        self.waiting = handle.getListState("waiting", "us binary, marks binary")

    def _state(self) -> tuple:
        return tuple(self.reached.get() or (0, -(1 << 62), None))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, told = None, ((r.us, r.mark) for r in rows if r.mark and r.us is not None)
        while chunk := list(islice(told, CHUNK)):
            us, marks = np.array(sorted({*chunk}), np.int64).T
            self.waiting.appendValue((us.tobytes(), marks.tobytes()))
            first = int(us[0]) if first is None else min(first, int(us[0]))
        if first is not None:
            done, last, due = self._state()
            if due is None or first // 1000 + 1 < due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self._wait(done, last, first)
        return iter(())

    def _wait(self, done: int, last: int, first: int) -> None:
        self.handle.registerTimer(first // 1000 + 1)
        self.reached.update((done, last, first // 1000 + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        done, last, _ = self._state()
        us, marks = (np.concatenate([np.frombuffer(x, np.int64) for x in column]) for column in zip(*self.waiting.get()))
        order = np.argsort(us, kind="stable")
        us, marks = us[order], marks[order]
        # no row of an earlier millisecond than the watermark's can still come
        past, at, got = int(np.searchsorted(us, timerValues.getCurrentWatermarkInMs() * 1000)), 0, {}
        while done < self.n_steps:
            at = max(at, int(np.searchsorted(us, last, "right")))
            hits = np.flatnonzero(marks[at:past] >> done & 1)
            if not len(hits):
                break
            done, last = done + 1, int(us[at + hits[0]])
            got[last // 1000] = (done, last)
        if past < len(us):
            self.waiting.put([(us[past:].tobytes(), marks[past:].tobytes())])
            self._wait(done, last, int(us[past]))
        else:
            self.waiting.clear()
            self.reached.update((done, last, None))
        for d, t in got.values():
            yield Row(user_id=key[0], steps_done=d, last_us=t)


def funnel_state(events: DataFrame, steps: list[str], late: str = "10 minutes") -> DataFrame:
    """``user_id, steps_done, last_us`` for every millisecond in which a user gets further, each step strictly after the one before.

    Equal to the batch funnel once the watermark has passed; runs with the settings ``ROCKS`` only.
    """
    bits = {s: sum(1 << i for i, x in enumerate(steps) if x == s) for s in steps}
    mark = F.coalesce(*[F.when(F.col("event_type") == s, F.lit(b)) for s, b in bits.items()], F.lit(0)).cast("bigint")
    timed = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts")).filter(F.col("event_type").isin(*steps, END_TYPE))
    return (
        timed.select("user_id", mark.alias("mark"), "us", "ts")
        .groupBy("user_id")
        .transformWithState(FunnelSteps(len(steps)), "user_id bigint, steps_done int, last_us bigint", "append", "eventTime")
    )


def funnel(reached: DataFrame, steps: list[str]) -> DataFrame:
    """Users per step and the rate against the step before, from the rows that ``funnel_state`` has given."""
    counts = reached.groupBy("user_id").agg(F.max("steps_done").alias("d"))
    counts = counts.agg(*[F.count_if(F.col("d") >= i).alias(f"n{i}") for i in range(1, len(steps) + 1)])
    return web.funnel_rates(counts, steps)


#: Event time of the row that ends a bounded stream (within what pandas can hold), and its type, which tells it from real rows.
THE_END, END_TYPE = "2200-01-01 00:00:00", "end of input"
#: Stateful operators in a row that are closed one after the other.
CHAIN = 2


def run_bounded(spark: SparkSession, folder: str, job: Callable[[DataFrame], DataFrame], glob: str = "events*.parquet", conf: dict | None = None) -> DataFrame:
    """Result of a streaming ``job`` over landed events that are complete: what is open at their end is closed.

    After everything has been read, one more row is taken in whose event time moves the watermark past any real row, so
    sessions, windows and days that wait for later rows come out. Its own groups never close, and no further event
    can follow. Each operator of a chain closes what the one before it has handed on in the batch before.
    """
    base = f"{shared_folder(spark)}/growthlens/stream-{uuid.uuid4().hex}"
    schema = spark.createDataFrame([], EVENTS)
    schema.write.parquet(f"{base}/end")

    def events() -> DataFrame:
        return read_events(spark, folder, glob).unionByName(read_events(spark, f"{base}/end", "*.parquet"))

    out, _ = run_available(job(events()), base, conf=conf)
    for _ in range(CHAIN):
        last = spark.createDataFrame([(END_TYPE,)], "event_type string").withColumn("ts", F.lit(THE_END).cast("timestamp_ntz"))
        schema.unionByName(last, allowMissingColumns=True).write.mode("append").parquet(f"{base}/end")
        out, _ = run_available(job(events()), base, conf=conf)
    return out


def run_available(df: DataFrame, out: str | None = None, timeout_s: int | None = None, conf: dict | None = None) -> tuple[DataFrame, StreamingQuery]:
    """Process everything that has landed, in append mode, and read the result table. ``conf`` holds for this query only."""
    spark = df.sparkSession
    base = out or f"{shared_folder(spark)}/growthlens/stream-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        query = (
            df.writeStream.outputMode("append")
            .format("parquet")
            .option("path", f"{base}/table")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if query.awaitTermination(timeout_s) is False:
        query.stop()
        raise TimeoutError("stream did not finish in time")
    return spark.read.schema(df.schema).parquet(f"{base}/table"), query


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark, summed over the stateful operators of all batches."""
    return sum(
        int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators
    )


# the state processor goes to the executors by value, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
