"""Event-driven forms: debounced writes, drafts, bounded retention, read-once slots. Each gives what its batch form gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators import tables


def debounced(events: DataFrame, key: str, ts: str, payload: str, gap: str = "400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """One row for each burst, once the watermark has passed it; a burst still open waits for later events."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.session_window(ts, gap)
    return rows.groupBy(key, w.alias("w")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_events"), F.max_by(payload, ts).alias(payload)).drop("w")


def newest(events: DataFrame, key: str, ts: str, n: int = 20) -> DataFrame:
    """After each batch, the n newest (ts, id) of the keys that it touched; state holds no more than that for a key. events: key, ts, event_id."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            held += [(int(t.timestamp() * 1e6), int(i)) for t, i in zip(batch[ts], batch["event_id"])]
            held = sorted(set(held), reverse=True)[:n]
        state.update(([t for t, _ in held], [i for _, i in held]))
        yield pd.DataFrame({key: [k[0]] * len(held), "event_id": [i for _, i in held], "rank": range(1, len(held) + 1)})

    grouped = events.select(key, F.col(ts).cast("timestamp").alias(ts), "event_id").groupBy(key)
    return grouped.applyInPandasWithState(step, f"{key} long, event_id long, rank long", "ts array<long>, id array<long>", "update", GroupStateTimeout.NoTimeout)


def upsert_into(spark: SparkSession, path: str, key: str, ts: str, payload: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the table of drafts at `path`, one version a batch. A batch that comes again writes the same version again."""

    def put(batch: DataFrame, epoch: int) -> None:
        now = batch.groupBy(key).agg(F.min(ts).alias("created"), F.max(ts).alias("updated"), *[F.max_by(c, ts).alias(c) for c in payload])
        before = f"{path}/v={epoch - 1}"
        if epoch:
            both = spark.read.parquet(before).unionByName(now)
            now = both.groupBy(key).agg(F.min("created").alias("created"), F.max("updated").alias("updated"), *[F.max_by(c, "updated").alias(c) for c in payload])
        now.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return put


def consumed_once(spark: SparkSession, folder: str, schema: str, checkpoint: str, take: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Files dropped into a folder, each taken once, then done."""
    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resumed(required: DataFrame, landed: DataFrame, key: str, order: str) -> DataFrame:
    """What a resumed job has still to fetch."""
    return tables.missing(required, landed, key, order)
