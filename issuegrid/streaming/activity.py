"""ST1, ST2: running per-issue roll-ups of the activity stream.

Both are keyed aggregates without a time window: the state is one row per issue.

* ST1 ``last_activity``: running max of touching events. ``max`` is order- and
  repeat-insensitive, so late or duplicated events are harmless and no
  watermark is needed.
* ST2 ``running_hours``: running total, worklog inserts add and deletes subtract.
  A sum is not repeat-insensitive, so events are de-duplicated on ``event_id``
  within a watermark (``dropDuplicatesWithinWatermark``); ``delay`` (no default) must
  exceed the worst lateness. An event behind the watermark would be left out of the
  sum, so :func:`run_until_caught_up` fails if any micro-batch of its run reports one,
  or if a micro-batch's report is missing.
* ST2 without a lateness limit, ``keyed_hours``: keyed state remembers every event id it
  counted, so a repeat is known however late it comes. An issue's events are dealt over
  ``SHARES`` keys by their id, so no issue is the state or the work of one task.

Results leave the stream through ``foreachBatch`` in update mode: each
micro-batch writes only the issues it changed, into its own ``epoch=N``
partition (dynamic partition overwrite, so a re-run of an epoch after a failure
replaces it instead of duplicating it). The current table is the newest epoch's
row per issue (:func:`current_table`); :func:`compact` folds the epochs written so
far into a base table so later reads only scan newer epochs.
"""

from __future__ import annotations

import os
import threading
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..schema import ACTIVITY, HOURS_SIGN, HOURS_SUM, TOUCHING_KINDS
from ..session import checkpoint_dir

REPORTS_S = 60           # seconds that the reports of a run may come in after its end
SHARES = 32              # keys that the events of one issue are dealt over in keyed state
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_activity(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None,
                  max_bytes_per_trigger: int | None = None) -> DataFrame:
    """A stream of activity events from Parquet files landing in ``directory``; a
    micro-batch takes files up to a number or, better, up to a size."""
    reader = spark.readStream.schema(ACTIVITY)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(directory)


def last_activity(events: DataFrame) -> DataFrame:
    """ST1: ``(issue_id, last_activity)`` running max over touching events."""
    return (events.filter(F.col("kind").isin(*TOUCHING_KINDS) & F.col("ts").isNotNull())
            .groupBy("issue_id").agg(F.max("ts").alias("last_activity")))


def running_hours(events: DataFrame, delay: str | None, dedupe: bool = True) -> DataFrame:
    """ST2: ``(issue_id, total_hours)`` running signed sum of worklog events."""
    src = events
    if dedupe:
        if not delay:
            raise ValueError("de-duplication needs a delay above the worst lateness")
        src = src.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    sign = F.coalesce(*[F.when(F.col("kind") == k, F.lit(s)) for k, s in HOURS_SIGN.items()], F.lit(0))
    return (src.filter(F.col("kind").isin(*HOURS_SIGN))
            .groupBy("issue_id").agg(F.sum(F.col("hours") * sign).cast(HOURS_SUM).alias("total_hours")))


class _HoursOnce(StatefulProcessor):
    """Signed hundredths of hours of one (issue, share), each event id counted once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._counted = handle.getMapState("counted", "event_id long", "cents long")
        self._total = handle.getValueState("total", "cents long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        total = self._total.get()[0] if self._total.exists() else 0
        for batch in rows:
            for event, cents in batch.drop_duplicates("event_id")[["event_id", "cents"]].itertuples(index=False):
                if not self._counted.containsKey((int(event),)):
                    self._counted.updateValue((int(event),), (int(cents),))
                    total += int(cents)
        self._total.update((total,))
        yield pd.DataFrame({"issue_id": [key[0]], "share": [key[1]], "cents": [total]})

    def close(self) -> None:
        pass


def keyed_hours(events: DataFrame, shares: int = SHARES) -> DataFrame:
    """ST2 on keyed state: ``(issue_id, share, total_hours)``, running signed sums that count
    each event id once however late its repeats come; an issue's total is the sum over its
    shares (:func:`total_of_shares`). No watermark: the state keeps every event id.

    Events without issue or id belong to no total that could be kept once and are left out;
    missing hours count as none. Needs the RocksDB state store (``STATE_STORE``).
    """
    sign = F.coalesce(*[F.when(F.col("kind") == k, F.lit(s)) for k, s in HOURS_SIGN.items()])
    signed = events.filter(F.col("kind").isin(*HOURS_SIGN) & F.col("issue_id").isNotNull() & F.col("event_id").isNotNull()).select(
        "issue_id", F.pmod(F.xxhash64("event_id"), F.lit(shares)).cast("int").alias("share"), "event_id",
        F.coalesce(F.col("hours") * 100 * sign, F.lit(0)).cast("long").alias("cents"))
    out = signed.groupBy("issue_id", "share").transformWithStateInPandas(
        _HoursOnce(), "issue_id int, share int, cents long", "Update", "None")
    return out.select("issue_id", "share", (F.col("cents").cast("decimal(20,0)") / 100).cast(HOURS_SUM).alias("total_hours"))


def total_of_shares(shares: DataFrame) -> DataFrame:
    """``(issue_id, total_hours)`` from the current rows of :func:`keyed_hours`."""
    return shares.groupBy("issue_id").agg(F.sum("total_hours").cast(HOURS_SUM).alias("total_hours"))


class _LateRows(StreamingQueryListener):
    """Rows that each micro-batch of each run dropped behind the watermark. Unlike a query's
    ``recentProgress``, it keeps every batch: one number each."""

    def __init__(self):
        self.dropped = defaultdict(dict)                     # run -> batch -> rows
        self.ended = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        batches = self.dropped[str(p.runId)]
        batches[p.batchId] = batches.get(p.batchId, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()                   # comes after all of the run's reports


def _epoch_writer(path: str, epochs: set[int] | None = None):
    def write(batch: DataFrame, epoch_id: int) -> None:
        if epochs is not None:
            epochs.add(epoch_id)
        (batch.withColumn("epoch", F.lit(epoch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch").parquet(path))
    return write


def start(agg: DataFrame, sink: str, checkpoint: str, available_now: bool = True,
          processing_time: str | None = None, epochs: set[int] | None = None, mode: str = "update"):
    """Start ``agg`` (a keyed streaming aggregate) in update mode, writing each
    micro-batch's changed keys to ``sink`` (epoch partitions); ``epochs`` takes the
    numbers of the micro-batches that ran. A join that gives each row once takes ``mode`` append."""
    writer = (agg.writeStream.outputMode(mode).foreachBatch(_epoch_writer(sink, epochs))
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def _latest(spark: SparkSession, sink: str, key: str | list[str], value_cols: list[str], base: str | None) -> DataFrame:
    """``(key, epoch, values)``: the newest written value per key (a
    partial-aggregated ``max(struct(epoch, values))``), over ``base`` if given."""
    keys = [key] if isinstance(key, str) else key
    df = spark.read.parquet(sink).select(*keys, "epoch", *value_cols)
    if base is not None:
        b = spark.read.parquet(base).select(*keys, "epoch", *value_cols)
        upto = b.select(F.max("epoch")).scalar()
        df = b.unionByName(df.filter(F.col("epoch") > upto))   # prunes folded epoch partitions
    latest = df.groupBy(*keys).agg(F.max(F.struct("epoch", *value_cols)).alias("__v"))
    return latest.select(*keys, F.col("__v.epoch").alias("epoch"), *[F.col(f"__v.{c}").alias(c) for c in value_cols])


def current_table(spark: SparkSession, sink: str, key: str | list[str], value_cols: list[str],
                  base: str | None = None) -> DataFrame:
    """The latest value per key across the written epochs. With ``base``
    (written by :func:`compact`) only epochs newer than the base are read from
    the sink — a partition filter on ``epoch`` — and folded over the base rows."""
    return _latest(spark, sink, key, value_cols, base).drop("epoch")


def compact(spark: SparkSession, sink: str, key: str | list[str], value_cols: list[str], base: str,
            previous: str | None = None) -> str:
    """Fold every epoch of ``sink`` (over an optional ``previous`` base) into one
    row per key, written to the new folder ``base`` with the epoch each value
    came from. Later reads pass ``base`` to :func:`current_table`; the folded
    epoch partitions may then be dropped by the sink's retention."""
    _latest(spark, sink, key, value_cols, previous).write.mode("overwrite").parquet(base)
    return base


def catch_up(spark: SparkSession, stream: DataFrame, base: str, delay: str | None, mode: str = "update") -> None:
    """Run ``stream`` over everything that has landed, into the ``sink`` beside its
    ``checkpoint`` under ``base``; fails if rows came too late for the watermark in any
    micro-batch of this run, or if a micro-batch's report is missing."""
    reports, epochs = _LateRows(), set()
    spark.streams.addListener(reports)
    try:
        q = start(stream, os.path.join(base, "sink"), os.path.join(base, "checkpoint"), epochs=epochs, mode=mode)
        q.awaitTermination()
        if q.exception():
            raise q.exception()
        reports.ended[q.runId].wait(REPORTS_S)
    finally:
        spark.streams.removeListener(reports)
    dropped = reports.dropped[q.runId]
    late = sum(dropped.values())
    if late:
        raise RuntimeError(f"{late} events came later than {delay}: run again from the start with a larger delay")
    if epochs - dropped.keys():
        raise RuntimeError(f"no report of micro-batches {sorted(epochs - dropped.keys())[:10]}: events may have come too late unseen")


def run_until_caught_up(spark: SparkSession, events_dir: str, which: str, work_dir: str | None = None,
                        delay: str | None = None, dedupe: bool = True,
                        max_files_per_trigger: int | None = None,
                        max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Run ST1 (``which="last_activity"``) or ST2 (``"running_hours"``, or ``"keyed_hours"``
    without a lateness limit) over everything in ``events_dir`` with ``availableNow`` and return the result
    table; fails if events came too late for the watermark in any micro-batch of this run.
    Sink and checkpoint live under ``work_dir`` (default: a new folder in the session's
    shared checkpoint folder)."""
    base = work_dir or os.path.join(checkpoint_dir(spark), f"stream-{which}-{uuid.uuid4().hex[:12]}")
    events = read_activity(spark, events_dir, max_files_per_trigger, max_bytes_per_trigger)
    key = "issue_id"
    if which == "last_activity":
        agg, values = last_activity(events), ["last_activity"]
    elif which == "keyed_hours":
        agg, key, values = keyed_hours(events), ["issue_id", "share"], ["total_hours"]
    elif which == "running_hours":
        agg, values = running_hours(events, delay, dedupe), ["total_hours"]
    else:
        raise ValueError(which)
    reports, epochs = _LateRows(), set()
    store = spark.conf.get(STATE_STORE)
    if which == "keyed_hours":
        spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        catch_up(spark, agg, base, delay)
    finally:
        spark.conf.set(STATE_STORE, store)
    table = current_table(spark, os.path.join(base, "sink"), key, values)
    return total_of_shares(table) if which == "keyed_hours" else table


def land_events(events: DataFrame, directory: str, files: int | None = None) -> None:
    """Write activity rows as Parquet files into ``directory`` — how events arrive for the
    stream (used to feed it from a table): one file for each partition of ``events``, or
    ``files`` of them."""
    rows = events.select("event_id", "ts", "user_id", "issue_id", "kind", "hours")
    (rows.repartition(files, "event_id") if files else rows).write.mode("append").parquet(directory)
