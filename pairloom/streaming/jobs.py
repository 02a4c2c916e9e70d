"""Streaming forms of bars, windows, sessions, deduplication and the position machine, and a runner that drains a stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pairloom.sources.tables import shared_path, table


STORE = "spark.sql.streaming.stateStore.providerClass"
#: Rows that one task writes to a file that arrives.
FILE_ROWS = 1_000_000


def landed(spark: SparkSession, folder: str, parts: int = 3, repeated: bool = False, late: bool = False) -> str:
    """Events as a folder of files that arrive in the order of time, so that state goes from batch to batch, and a last file
    with one row without symbol a month later, whose watermark closes all windows. repeated: each part has its rows twice;
    late: before the last file rows of the first hour arrive once more, long after the watermark has passed. A part of
    `files_of` files, whatever its size, is one batch of the stream; a task writes FILE_ROWS rows or so."""
    path = shared_path(spark, "landed")
    events = table(spark, folder, "events")
    first, last, total = events.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    n = files_of(total * (1 + repeated), parts)
    step = (last - first) / parts
    part = lambda i: events.where((F.col("ts") >= F.lit(first + i * step)) & (F.lit(i == parts - 1) | (F.col("ts") < F.lit(first + (i + 1) * step))))
    closing = events.limit(1).withColumns({"ts": F.lit(last + timedelta(days=31)), "event_type": F.lit(None).cast("string")})
    files = [part(i).unionByName(part(i)) if repeated else part(i) for i in range(parts)]
    files += [events.where(F.col("ts") < F.lit(first + timedelta(hours=1)))] * late + [closing]
    for number, rows in enumerate(files):  # one write after the other: a file's age is its place in the stream
        (rows.repartition(n) if number < parts else rows.coalesce(n)).write.mode("append").parquet(f"{path}/arrived={number}")
    return path


def files_of(rows: int, parts: int) -> int:
    """Files of each of so many parts of a table."""
    return max(1, -(-rows // (parts * FILE_ROWS)))


def arriving(spark: SparkSession, path: str, like: DataFrame, delay: str = "1 hour", files: int = 1) -> DataFrame:
    """The stream of a landed folder, so many files a batch, with a watermark."""
    stream = spark.readStream.schema(like.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(path)
    found = stream.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), "user_id").withWatermark("ts", delay)
    return found.where("symbol is not null or ts is null")  # ts keeps this after the watermark, which the closing row must move


def ticks(spark: SparkSession, folder: str, delay: str = "1 hour", parts: int = 3, repeated: bool = False, late: bool = False) -> DataFrame:
    """Events as a stream with a watermark; zone-less times become instants of the session's zone (UTC)."""
    events = table(spark, folder, "events")
    return arriving(spark, landed(spark, folder, parts, repeated, late), events, delay, files_of(events.count() * (1 + repeated), parts))


def drained(stream: DataFrame) -> DataFrame:
    """All that is there now, in append mode: windows leave the state as the watermark passes them. Each batch goes to
    Parquet in the shared folder, nothing to the driver; the sink's log makes a batch that runs again count once."""
    spark = stream.sparkSession
    path = shared_path(spark, "drained")
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # on disk, with timers
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return spark.read.schema(stream.schema).parquet(path)


def bars(source: DataFrame, every: str) -> DataFrame:
    w = F.window("ts", every)
    return source.groupBy("symbol", w.alias("w")).agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.count("*").alias("n")).select("symbol", F.col("w.start").cast("timestamp_ntz").alias("bar_ts"), "open", "high", "low", "close", "n")


def sliding(source: DataFrame, every: str, slide: str) -> DataFrame:
    w = F.window("ts", every, slide)
    return source.groupBy("symbol", w.alias("w")).agg(F.count("*").alias("n"), F.avg("price").alias("mean")).select("symbol", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"))


def sessions(source: DataFrame, gap: str) -> DataFrame:
    w = F.session_window("ts", gap)
    return source.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.sum("price").alias("total")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n", F.round("total", 6).alias("total"))


def first_seen(source: DataFrame, *keys: str) -> DataFrame:
    return source.dropDuplicatesWithinWatermark(list(keys))


def relation(source: DataFrame, every: str) -> DataFrame:
    """Correlation and slope of price on the hour of day in each window, by moments."""
    x = F.hour("ts").cast("double")
    w = F.window("ts", every)
    cov, vx, vy = F.covar_pop("price", x), F.var_pop(x), F.var_pop("price")
    return source.groupBy("symbol", w.alias("w")).agg(F.round(cov / F.nullif(F.sqrt(vx * vy), F.lit(0.0)), 6).alias("corr"), F.round(cov / F.nullif(vx, F.lit(0.0)), 6).alias("slope")).select("symbol", F.col("w.start").cast("timestamp_ntz").alias("start"), "corr", "slope")


class Machine(StatefulProcessor):
    """The hysteresis of positions() by event time. Rows wait in the state, in buckets of time, until the watermark passes
    their bucket; then the bucket is put in order and decided from the position that the one before left. So rows may come
    in any order within the watermark's delay, and no more than a symbol's bucket, or HELD_ROWS rows on their way to their
    buckets, is in memory at a time."""

    def __init__(self, entry: float, leave: float, seconds: int):
        self.entry, self.leave, self.width = entry, leave, 1000 * seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", "pos int")
        self.waiting = handle.getMapState("waiting", "bucket long, part int", "rows binary")
        self.parts = handle.getMapState("parts", "bucket long", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, n, counts = [], 0, {}
        for batch in rows:
            at = batch.ts.astype("datetime64[us]").astype("int64").to_numpy()
            held.append(np.rec.fromarrays([at, batch.seq.to_numpy(np.int64), batch.z.to_numpy(float)], dtype=WAITING))
            n += len(at)
            if n >= HELD_ROWS:
                self.keep(np.concatenate(held), counts)
                held, n = [], 0
        if held:
            self.keep(np.concatenate(held), counts)
        for bucket, parts in counts.items():
            self.parts.updateValue((bucket,), (parts,))
        yield from ()  # nothing is decided before the watermark

    def keep(self, rows: np.ndarray, counts: dict[int, int]) -> None:
        """Rows into their buckets, one write of the state a bucket; counts has the parts of the buckets met so far."""
        buckets = rows["at"] // (1000 * self.width)
        order = np.argsort(buckets, kind="stable")
        rows, buckets = rows[order], buckets[order]
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]).tolist()
        for start, stop in zip(starts, [*starts[1:], len(rows)], strict=True):
            bucket = int(buckets[start])
            if bucket not in counts:
                counts[bucket] = self.parts.getValue((bucket,))[0] if self.parts.containsKey((bucket,)) else 0
                if not counts[bucket]:
                    self.handle.registerTimer((bucket + 1) * self.width)
            self.waiting.updateValue((bucket, counts[bucket]), (rows[start:stop].tobytes(),))
            counts[bucket] += 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        over = expiredTimerInfo.getExpiryTimeInMs() // self.width
        if not self.parts.containsKey((over - 1,)):
            return  # decided at another timer, with all that the watermark had passed
        over = max(over, timerValues.getCurrentWatermarkInMs() // self.width)
        for bucket in sorted(b for (b,) in self.parts.keys() if b < over):
            n = self.parts.getValue((bucket,))[0]
            rows = np.concatenate([np.frombuffer(self.waiting.getValue((bucket, i))[0], WAITING) for i in range(n)])
            for i in range(n):
                self.waiting.removeKey((bucket, i))
            self.parts.removeKey((bucket,))
            rows = rows[np.lexsort((rows["seq"], rows["at"]))]
            z = rows["z"]
            said = np.where(z < -self.entry, 1, np.where(z > self.entry, -1, np.where(np.abs(z) < self.leave, 0, 2)))
            said[np.isnan(z)] = 2
            place = np.maximum.accumulate(np.where(said != 2, np.arange(len(said)), -1))
            pos = np.where(place >= 0, said[place], self.position.get()[0] if self.position.exists() else 0)
            self.position.update((int(pos[-1]),))
            yield pd.DataFrame({"symbol": pd.Series([key[0]] * len(rows), dtype=object), "ts": pd.Series(rows["at"].astype("datetime64[us]")), "seq": rows["seq"], "pos": pos.astype("int32")})


#: Rows of a symbol that a task holds before it writes them to the state: some 24 MB.
HELD_ROWS = 1_000_000
#: Rows of a bucket as they wait: microseconds, seq, z.
WAITING = np.dtype([("at", "i8"), ("seq", "i8"), ("z", "f8")])


def position_machine(signals: DataFrame, entry: float, leave: float, bucket_seconds: int = 3600) -> DataFrame:
    """symbol, ts, seq, z to symbol, ts, seq, pos: the hysteresis of positions(), in order of ts and seq whatever the order
    of arrival within the watermark's delay. A null z carries the position on. Needs a state store with timers: see
    `drained`."""
    rows = signals.select("symbol", "ts", "seq", F.col("z").cast("double").alias("z"))
    return rows.groupBy("symbol").transformWithStateInPandas(Machine(entry, leave, bucket_seconds), "symbol string, ts timestamp, seq long, pos int", "append", "eventTime")


def write_each_batch(stream: DataFrame, path: str) -> None:
    """A sink that writes every batch once: a batch that is run again replaces its own folder."""
    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", shared_path(stream.sparkSession, "stream")).trigger(availableNow=True).start().awaitTermination()
