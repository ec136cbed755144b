"""Detection over an event stream, with suppression of repeats across batches."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lanternlog.model import TS
from lanternlog.operators.detect import LOOK_BACK_DAYS, Rule, as_documents, detect, look_back
from lanternlog.operators.suppress import Limits, key_of, suppress
from lanternlog.operators.views import DETECTIONS
from lanternlog.sources.store import Store

PERIOD = "5 seconds"


def alerts_of(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Stateless: every event is judged once, on arrival, however late it is."""
    return detect(events, rules)


def write_alerts(alerts: DataFrame, target: str, checkpoint: str) -> DataStreamWriter:
    """Append every hit to a parquet dataset, exactly once per event."""
    return (
        alerts.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
    )


def write_suppressed(
    alerts: DataFrame,
    target: str,
    checkpoint: str,
    window_seconds: int = 60,
    limits: Limits = Limits(),
    keep_seconds: int | None = None,
) -> DataStreamWriter:
    """Append the hits that survive suppression.

    Each batch runs the batch operator, which splits hot keys, from the kept times the
    previous batch left in ``state/``. Batch folders are overwritten on replay, so a
    restart neither loses nor repeats an alert. The state is a distributed table of kept times;
    with ``keep_seconds`` a time leaves it when it lies that much (and a window) before the latest
    one of all, and hits that come later than that are kept, not dropped. Only the last two states stay.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = "rule_id string, key string, last_us bigint"
        state = None
        if batch_id > 0:
            state = spark.read.schema(schema).parquet(f"{target}/state/batch={batch_id - 1}")
        kept_path = f"{target}/alerts/batch={batch_id}"
        suppress(batch, window_seconds, state, limits).write.mode("overwrite").parquet(kept_path)
        kept = spark.read.schema(batch.schema).parquet(kept_path)
        times = kept.select("rule_id", key_of(F.col("query_key")).alias("key"), F.unix_micros(TS).alias("last_us"))
        if state is not None:
            times = state.unionByName(times)
        if keep_seconds is not None:
            latest = times.agg(F.max("last_us")).scalar()
            times = times.where(F.col("last_us") >= latest - (keep_seconds + window_seconds) * 1_000_000)
        times.write.mode("overwrite").parquet(f"{target}/state/batch={batch_id}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/state/batch={batch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_alerts(spark, target: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{target}/alerts").drop("batch")


def detect_new(
    store: Store,
    base: str,
    rules: Sequence[Rule],
    stream: str = "",
    now: dt.datetime | None = None,
    days: int = LOOK_BACK_DAYS,
) -> bool:
    """Judge the documents a dataset got since the last call and add the alerts to the store, in one commit.

    The first call of a stream of rules looks ``days`` back; from then on every document is judged once, whatever
    wrote it and however late its time is. The commit holds how far the stream has come, so a call that is repeated
    after a crash adds nothing twice. False where there is nothing new.
    """
    stream = stream or f"detect {base}"
    last = store.progress(stream)
    if last is not None and not store.has_newer(base, last):
        return False
    docs, upto = store.since(base, last)
    at = F.lit(now or dt.datetime.now(dt.timezone.utc))
    alerts = as_documents(detect(look_back(docs, at, days) if last is None else docs, rules, at))
    parts = store.put(alerts.withColumn("_base", F.lit(DETECTIONS)), store.ticket())
    return store.publish(parts, [DETECTIONS], (stream, upto))


# Suppression with state per key --------------------------------------------------------


class _KeptTimes(StatefulProcessor):
    """Suppression of one (rule, key): the times of kept hits, and hits that wait for their turn.

    A kept hit covers the window from its time on. ``ordered``: hits wait until the watermark has passed them and are
    judged in the order of time; else they are judged on arrival, in order within a batch.
    """

    def __init__(self, window: int, ordered: bool) -> None:
        self.window, self.ordered = window, ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "times array<bigint>")
        self.waiting = handle.getListState("waiting", "us bigint, event_index string, event_id string, alert string")

    def _judged(self, hits: list[Row], watermark: int) -> Iterator[Row]:
        """Hits that are kept. Times that cover nothing later than the watermark leave the state."""
        times = list(self.kept.get()[0]) if self.kept.exists() else []
        for hit in sorted(hits, key=lambda h: (h["us"], h["event_index"] or "", h["event_id"] or "")):
            at = bisect_right(times, hit["us"]) - 1
            if at < 0 or hit["us"] >= times[at] + self.window:
                insort(times, hit["us"])
                yield Row(alert=hit["alert"])
        times = [t for t in times if t + self.window > watermark]
        if times:
            self.kept.update((times,))
            self.handle.registerTimer((times[-1] + self.window) // 1000 + 1)
        else:
            self.kept.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        if not self.ordered:
            yield from self._judged(list(rows), watermark)
            return
        for row in rows:
            self.waiting.appendValue((row["us"], row["event_index"], row["event_id"], row["alert"]))
            self.handle.registerTimer(row["us"] // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        names = ("us", "event_index", "event_id", "alert")
        held = [Row(**dict(zip(names, h))) for h in self.waiting.get()] if self.ordered and self.waiting.exists() else []
        due = [h for h in held if h["us"] < watermark]
        if due:
            rest = [tuple(h) for h in held if h["us"] >= watermark]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        yield from self._judged(due, watermark)

    def close(self) -> None:
        pass


def suppressed(alerts: DataFrame, window_seconds: int = 60, late_seconds: int = 3600, ordered: bool = False) -> DataFrame:
    """The alerts of a stream that survive suppression, with state per (rule, key) in Spark's state store.

    A hit is suppressed while a window that a kept hit opened covers its time, also when it comes late. State is the
    times of kept hits that can still cover something: at most one a window over ``late_seconds`` for a key, none for
    a key whose last window the watermark has passed. Hits more than ``late_seconds`` behind the latest one are
    dropped by the watermark (counted in the query's progress as rows dropped).

    On arrival, a hit that comes late and lies before all windows is kept, although one pass over all hits would then
    have suppressed a later one that is out already. With ``ordered`` hits wait ``late_seconds`` and the result is
    that of one pass whatever the order of arrival.
    """
    spark = alerts.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    whole = F.struct(*[F.unix_micros(c).alias(c) if t == "timestamp" else F.col(c) for c, t in alerts.dtypes])
    narrow = alerts.withWatermark(f"`{TS}`", f"{late_seconds} seconds").select(
        TS, "rule_id", key_of(F.col("query_key")).alias("key"), F.unix_micros(TS).alias("us"),
        "event_index", "event_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("alert"),
    )
    kept = narrow.groupBy("rule_id", "key").transformWithState(
        _KeptTimes(window_seconds * 1_000_000, ordered), "alert string", "Append", "EventTime"
    )
    ddl = ", ".join(f"`{c}` {'bigint' if t == 'timestamp' else t}" for c, t in alerts.dtypes)
    out = kept.select(F.from_json("alert", ddl).alias("a"))
    value = lambda c, t: F.timestamp_micros(F.col("a")[c]) if t == "timestamp" else F.col("a")[c]
    return out.select(*[value(c, t).alias(c) for c, t in alerts.dtypes])


def suppress_into(alerts: DataFrame, store: Store, checkpoint: str, stream: str = "suppressed") -> DataStreamWriter:
    """Writer of alerts into the store's detections, each batch once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        docs = as_documents(batch).withColumn("_base", F.lit(DETECTIONS))
        store.write_many(docs, bases=[DETECTIONS], once=(stream, batch_id))

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
