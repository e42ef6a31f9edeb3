"""Task events: batch forms, and the same as stateful streams.

Events have task, at (a time), status, and what else a task's snapshot holds. State is kept by task, bounded, and times
out, so a stream's memory follows the number of live tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FINISHED = ("completed", "cancelled", "failed")


# ---- batch forms

def survivors(n: Column, most: int = 150, drop: int = 30) -> Column:
    """How many of ``n`` log lines are left when the oldest ``drop`` go each time that there are more than ``most``."""
    return F.when(n <= most, n).otherwise(most + 1 - drop + F.pmod(n - most - 1, F.lit(drop)))


def bounded_log(lines: DataFrame, key: str = "task", order: str = "at", most: int = 150, drop: int = 30) -> DataFrame:
    """The lines of each task that its bounded log still holds."""
    from_end = F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc(), F.col("line_id").desc()))
    n = lines.groupBy(key).agg(F.count("*").alias("_n"))
    return lines.withColumn("_k", from_end).join(n, key).where(F.col("_k") <= survivors(F.col("_n"), most, drop)).drop("_k", "_n")


def latest(events: DataFrame, key: str = "task", order: tuple[str, ...] = ("at", "event_id")) -> DataFrame:
    """The last event of each task: an aggregate, in batch as in a stream (update mode)."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_e")).select(key, "_e.*")


def prune(tasks: DataFrame, now: Column, max_age_sec: int = 7200, keep: int = 30) -> DataFrame:
    """Tasks that stay: all that are not finished, and of the finished ones not older than the limit the newest."""
    done = F.col("status").isin(*FINISHED)
    old = now.cast("long") - F.col("at").cast("long") > max_age_sec
    rows = tasks.where(~done | ~old)
    newest = rows.where(done).orderBy(F.col("at").desc(), "task").limit(keep)
    return rows.where(~done).unionByName(newest)


def active(tasks: DataFrame, exclude: str | None = None, phase: str | None = None) -> DataFrame:
    """One row: how many tasks run or wait, without one of them, in one phase."""
    rows = tasks.where(F.col("status").isin("running", "pending"))
    rows = rows.where(F.col("task") != exclude) if exclude else rows
    return (rows.where(F.col("phase") == phase) if phase else rows).agg(F.count("*").alias("active"))


def active_of_project(tasks: DataFrame) -> DataFrame:
    """The newest active task of each project."""
    from seglume.operators.relational import pick

    return pick(tasks.where(F.col("status").isin("running", "pending")), ["project"], -F.col("at").cast("long"), "task")


def paced(requests: DataFrame, interval_ms: int = 4100, key: str = "project") -> DataFrame:
    """When each request may start, so that two of a key are ``interval_ms`` apart: t' = max(t, t' before + interval) is
    a prefix maximum."""
    w = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    step = F.col("seq") * interval_ms
    return requests.withColumn("run_ms", F.max(F.col("start_ms") - step).over(w) + step)


def progress(part: Column, low: float, high: float) -> Column:
    """A part's own per cent within the whole's."""
    return F.least(F.lit(high), F.greatest(F.lit(low), low + part * (high - low) / 100))


def poll_delay(errors: Column, interval_ms: int) -> Column:
    """Longer after errors, ten seconds at most; eight seconds once there are five."""
    grown = F.least(F.lit(10_000), F.round(interval_ms * F.pow(F.lit(1.8), errors)).cast("long"))
    return F.when(errors >= 5, F.lit(8000)).otherwise(grown)


# ---- streams

_LOG = "task string, lines array<string>"


def log_stream(lines: DataFrame, most: int = 150, drop: int = 30, idle_ms: int = 7_200_000) -> DataFrame:
    """The bounded log of each task after every batch; a task's log goes when it is idle."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        # a task's lines of one micro-batch may come in several Arrow batches: their order is that of all of them
        for line in pd.concat(list(batches)).sort_values(["at", "line_id"])["line"]:
            held.append(line)
            if len(held) > most:
                del held[:drop]
        state.update((held,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"task": [key[0]], "lines": [held]})

    return lines.groupBy("task").applyInPandasWithState(step, _LOG, "lines array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)


# ---- a gate that closes after failures

def gate(events: DataFrame, failures: int = 3, wait_ms: int = 60_000) -> DataFrame:
    """Each event (task, at_ms, event_id, status) with what the gate of its task says: failures (in a row, this event
    included), until_ms (how long the gate stays closed after it; 0: open), blocked (whether the gate was closed when the
    event came). It closes for ``wait_ms`` at each failure from some in a row on, and opens with a success."""
    order = W.partitionBy("task").orderBy("at_ms", "event_id")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    rows = events.withColumn("_island", F.count_if(F.col("status") == "completed").over(so_far))
    own = W.partitionBy("task", "_island").orderBy("at_ms", "event_id").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("failures", F.count_if(F.col("status") == "failed").over(own))
    closes = F.when((F.col("status") == "failed") & (F.col("failures") >= failures), F.col("at_ms") + wait_ms)
    rows = rows.withColumn("until_ms", F.coalesce(F.max(closes).over(own), F.lit(0)))
    return rows.withColumn("blocked", F.coalesce(F.col("at_ms") < F.lag("until_ms").over(order), F.lit(False))).drop("_island")


def keyed_state(spark: SparkSession) -> None:
    """The state store that timers, lists and expiry need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


_GATE = "task string, at_ms long, event_id long, failures int, until_ms long, blocked boolean, opened boolean"


class Gate(StatefulProcessor):
    """``gate`` as a stream; a timer opens a closed gate when its wait is over, without an event, and an idle task's state
    expires."""

    def __init__(self, failures: int, wait_ms: int, idle_ms: int) -> None:
        self.failures, self.wait_ms, self.idle_ms = failures, wait_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gate", "failures int, until_ms long", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  the interface's names
        bad, until = self.state.get() if self.state.exists() else (0, 0)
        at = 0
        for row in sorted(rows, key=lambda r: (r.at_ms, r.event_id)):
            at, blocked = row.at_ms, row.at_ms < until
            if row.status == "failed":
                bad += 1
                until = at + self.wait_ms if bad >= self.failures else until
            elif row.status == "completed":
                bad, until = 0, 0
            yield Row(task=key[0], at_ms=at, event_id=row.event_id, failures=bad, until_ms=until, blocked=blocked, opened=False)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if until > at:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + until - at)
        self.state.update((bad, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        bad, until = self.state.get() if self.state.exists() else (0, 0)
        self.state.update((bad, 0))
        yield Row(task=key[0], at_ms=until, event_id=None, failures=bad, until_ms=0, blocked=False, opened=True)

    def close(self) -> None:
        pass


def cooldown_gate(events: DataFrame, failures: int = 3, wait_ms: int = 60_000, idle_ms: int = 7_200_000) -> DataFrame:
    """``gate`` over a stream, with a row (opened) for each gate that opens by itself."""
    keyed_state(events.sparkSession)
    return events.groupBy("task").transformWithState(Gate(failures, wait_ms, idle_ms), _GATE, "Append", "ProcessingTime")


# ---- events for subscribers that may lag

def subscriptions(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """A row for each event (topic, at, event_id, payload) and subscriber (subscriber, topic) of its topic; polls are rows of
    the same kind, with ``poll``."""
    return events.join(subscribers, "topic").select("subscriber", "at", "event_id", "payload", F.lit(False).alias("poll"))


def deliveries(rows: DataFrame, most: int = 100, keep: str = "newest") -> DataFrame:
    """What each poll of a subscriber gets: subscriber, poll_id, event_ids (in order), dropped. Rows are events and polls
    (subscriber, at, event_id, poll). Between two polls a mailbox holds ``most`` events, the newest (older ones make room)
    or the ``oldest`` (full, it takes no more)."""
    order = W.partitionBy("subscriber").orderBy("at", "event_id")
    turn = F.count_if("poll").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("poll").cast("int")
    rows = rows.withColumn("_turn", turn)
    by = (F.col("at").desc(), F.col("event_id").desc()) if keep == "newest" else ("at", "event_id")
    # numbered among the events only: the poll that ends a turn stands apart
    place = F.row_number().over(W.partitionBy("subscriber", "_turn", "poll").orderBy(*by))
    kept = rows.withColumn("_place", place)
    took = F.sort_array(F.collect_list(F.when(~F.col("poll") & (F.col("_place") <= most), F.struct("at", "event_id"))))
    out = kept.groupBy("subscriber", "_turn").agg(F.max(F.when(F.col("poll"), F.col("event_id"))).alias("poll_id"), took.alias("_took"), F.greatest(F.lit(0), F.count_if(~F.col("poll")) - most).alias("dropped"))
    return out.where("poll_id is not null").select("subscriber", "poll_id", F.transform("_took", lambda x: x["event_id"]).alias("event_ids"), "dropped")


_DELIVERY = "subscriber string, poll_id long, event_ids array<long>, dropped long"


class Mailbox(StatefulProcessor):
    """``deliveries`` as a stream: the held events as a map from their number modulo the mailbox's size, so that an event
    writes one entry."""

    def __init__(self, most: int, keep: str, idle_ms: int) -> None:
        self.most, self.keep, self.idle_ms = most, keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("ring", "slot int", "event_id long", self.idle_ms)
        self.count = handle.getValueState("count", "n long", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        n = self.count.get()[0] if self.count.exists() else 0
        for row in sorted(rows, key=lambda r: (r.at, r.event_id)):
            if not row.poll:
                if n < self.most or self.keep == "newest":
                    self.ring.updateValue((n % self.most,), (row.event_id,))
                n += 1
                continue
            first = max(0, n - self.most) if self.keep == "newest" else 0
            took = [self.ring.getValue((i % self.most,))[0] for i in range(first, min(n, first + self.most))]
            yield Row(subscriber=key[0], poll_id=row.event_id, event_ids=took, dropped=max(0, n - self.most))
            self.ring.clear()
            n = 0
        self.count.update((n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        return iter(())

    def close(self) -> None:
        pass


def mailboxes(rows: DataFrame, most: int = 100, keep: str = "newest", idle_ms: int = 7_200_000) -> DataFrame:
    """``deliveries`` over a stream of events and polls."""
    keyed_state(rows.sparkSession)
    return rows.groupBy("subscriber").transformWithState(Mailbox(most, keep, idle_ms), _DELIVERY, "Append", "ProcessingTime")


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by status and window of event time; windows close when the watermark has passed them."""
    return events.withWatermark("at", late).groupBy(F.window("at", width), "status").agg(F.count("*").alias("n"))


def fan_out(events: DataFrame, sinks: list[Callable[[DataFrame], None]], checkpoint: str):
    """Every micro-batch goes to each sink, in turn; the checkpoint makes a batch come again after a failure, so sinks
    must take a batch twice."""

    def send(batch: DataFrame, _: int) -> None:
        batch.persist()  # or each sink reads the sources again
        try:
            for sink in sinks:
                sink(batch)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
