"""Continuous ingest of completed chunk files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from lanternlog.model import TS
from lanternlog.operators.parse import date_value
from lanternlog.operators.detect import Rule, as_documents, detect
from lanternlog.operators.views import DETECTIONS
from lanternlog.sources.lines import parse_events, promote
from lanternlog.sources.store import Store, by_day


def documents_of(lines: DataFrame, base: str, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Event lines -> (documents, quarantine). Together they hold every non-blank line."""
    parsed = parse_events(lines)
    leaf = F.try_variant_get(F.try_parse_json(F.col("fields")["timestamp"]), "$", "string")
    stamp = F.coalesce(date_value(leaf), F.current_timestamp() if now is None else now)
    docs = promote(parsed.where("status = 'event'"), base, stamp)
    return docs, parsed.where("status <> 'event'").select("status", "value")


def stream_chunks(spark: SparkSession, folder: str, files_per_batch: int = 100, pattern: str = "*") -> DataFrame:
    """Lines of files as they appear, oldest first, each file once.

    Producers write elsewhere and rename into the folder, so a file seen is complete. A
    failing batch stays at the head: the restarted query replays it from its checkpoint.
    """
    options: dict[str, Any] = {"maxFilesPerTrigger": files_per_batch, "latestFirst": "false", "pathGlobFilter": pattern}
    return spark.readStream.options(**options).text(folder)


def land(lines: DataFrame, base: str, target: str, checkpoint: str) -> DataStreamWriter:
    """Writer of two parquet datasets, ``documents`` by day and ``quarantine``.

    A batch overwrites its own ``batch=`` folder, so replaying it changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        docs, bad = documents_of(batch, base)
        by_day(docs, "_day").write.mode("overwrite").partitionBy("_day").parquet(f"{target}/documents/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{target}/quarantine/batch={batch_id}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def lander(store: Store, base: str, stream: str, rules: Sequence[Rule] = ()) -> Callable[[DataFrame, int], None]:
    """What a batch of event lines does to a store: documents, what the rules find in them, and quarantined lines.

    All of it is one commit that names the stream and the batch, so a batch that is replayed after a crash, whole or
    half written, changes nothing twice. Quarantined lines are in a folder of the batch, overwritten on replay.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = store.progress(stream)
        if done is not None and done >= batch_id:
            return
        ticket = store.ticket()
        docs, bad = documents_of(batch, base)
        parts = store.put(docs.withColumn("_base", F.lit(base)), ticket)
        if rules:
            found = as_documents(detect(store.stored(base, parts, fresh=True), rules))
            parts += store.put(found.withColumn("_base", F.lit(DETECTIONS)), ticket, 1)
        bad.write.mode("overwrite").parquet(f"{store.root}/quarantine/{stream}-{batch_id}")
        store.publish(parts, [base, *([DETECTIONS] if rules else [])], (stream, batch_id))

    return write


def land_in(
    lines: DataFrame, store: Store, base: str, checkpoint: str, stream: str = "", rules: Sequence[Rule] = ()
) -> DataStreamWriter:
    """Writer of a stream of event lines into a dataset of a store, each batch once; ``rules`` judge it on arrival."""
    write = lander(store, base, stream or f"ingest {base}", rules)
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def landed(spark: SparkSession, target: str) -> DataFrame:
    """Documents landed so far."""
    return spark.read.parquet(f"{target}/documents").withColumn(TS, F.col(TS)).drop("batch")
