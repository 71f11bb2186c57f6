"""Structured Streaming operators: bounded queue, staleness quota, running counters, resumable runs.

All are keyed, so state is spread over executors, and all survive a restart
from their checkpoint. ``replay`` runs a streaming query over stored files to
its end (trigger AvailableNow) and returns what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """A growing folder (or one file) of Parquet as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def replay(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs to the end of what is stored, exactly once per checkpoint, and reads the result.

    Complete and update modes keep the rows of the last batch."""
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(path)
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def bounded_queue(samples: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Per key a first-in-first-out queue of ``size``; a full queue drops its oldest.

    samples: key and order (both long). Emits, per key and micro-batch,
    received, dropped and the contents in order.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, received, dropped = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 0, 0)
        new = sorted(int(x) for b in batches for x in b[order])
        held += new
        received += len(new)
        dropped += max(0, len(held) - size)
        held = held[-size:]
        state.update((held, received, dropped))
        yield pd.DataFrame({key: [k[0]], "received": [received], "dropped": [dropped], "held": [held]})

    return samples.select(key, order).groupBy(key).applyInPandasWithState(
        step, f"{key} long, received long, dropped long, held array<long>", "held array<long>, received long, dropped long", "update", GroupStateTimeout.NoTimeout
    )


def staleness_quota(samples: DataFrame, required: int, threshold: float, sync_steps: int) -> DataFrame:
    """samples: version, n. Per parameter version the samples taken, its quota and whether the producer pauses."""
    quota = int(required * (threshold + 1) * sync_steps)
    taken = samples.groupBy("version").agg(F.sum("n").alias("taken"))
    return taken.select("version", "taken", F.lit(quota).cast("long").alias("quota"), (F.col("taken") >= quota).alias("paused"))


def running_accuracy(results: DataFrame, *keys: str) -> DataFrame:
    """results: answered, correct (booleans). Counters and accuracy per key; a complete-mode aggregate."""
    got = results.groupBy(*keys).agg(F.count_if("answered").alias("total_with_answer"), F.count_if("correct").alias("correct"))
    return got.withColumn("accuracy", F.coalesce(F.try_divide("correct", "total_with_answer"), F.lit(0.0)))


def windowed_metrics(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Event-time windows with a watermark (an addition of this engine): count and mean of value by event_type."""
    at = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drained(stream: DataFrame, path: str, checkpoint: str, ready: Column) -> DataFrame:
    """Drains a stream to its end: rows that are ready are merged by batch and appended, the others dropped; batch, generated and dropped of every batch."""
    spark = stream.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        # a batch that is tried again writes over itself, so its counters and rows are counted once
        held = batch.withColumn("ready", F.coalesce(ready, F.lit(False)))
        held.where("ready").drop("ready").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        counts = held.agg(F.count_if("ready").alias("generated"), F.count_if(~F.col("ready")).alias("dropped"))
        counts.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    return spark.read.parquet(f"{path}/counts").select(F.col("batch").cast("long").alias("batch"), "generated", "dropped")


def metric_state(steps: DataFrame, key: str) -> DataFrame:
    """Metrics of the steps between two versions: when a key's version moves on, what the last one gathered is sent out and its state is cleared.

    steps: key, version, step, value, samples (all long but value). Emits key, version, steps, samples, mean (weighted by
    samples), last and total. A version that no other has followed yet is still open and not sent.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, steps_, samples, weighted, last, total = state.get if state.exists else (None, 0, 0, 0.0, 0.0, 0.0)
        rows = pd.concat(batches).sort_values(["version", "step"])
        out = []
        for v, x, n in zip(rows["version"], rows["value"], rows["samples"], strict=True):
            if version is not None and v != version:
                out.append((k[0], version, steps_, samples, weighted / max(samples, 1), last, total))
                steps_, samples, weighted, total = 0, 0, 0.0, 0.0
            version, steps_, samples = int(v), steps_ + 1, samples + int(n)
            weighted, last, total = weighted + float(x) * int(n), float(x), total + float(x)
        state.update((version, steps_, samples, weighted, last, total))
        yield pd.DataFrame(out, columns=[key, "version", "steps", "samples", "mean", "last", "total"])

    return steps.select(key, "version", "step", "value", "samples").groupBy(key).applyInPandasWithState(
        step, f"{key} long, version long, steps long, samples long, mean double, last double, total double",
        "version long, steps long, samples long, weighted double, last double, total double", "append", GroupStateTimeout.NoTimeout,
    )


def resumable(planned: DataFrame, *keys: str) -> DataFrame:
    """Each key once, whatever is sent again; with a checkpoint an interrupted run goes on where it stopped."""
    return planned.dropDuplicates(list(keys))
