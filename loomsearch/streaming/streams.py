"""Structured Streaming: indexing from files, windowed counts with late data, sessions and hysteresis as keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomsearch.operators.dedup import latest
from loomsearch.operators.index import Index
from loomsearch.sources import crawl_log
from loomsearch.sources.tables import discard, names_in, remove, saved, shared_dir


def files(spark: SparkSession, path: str, schema, per_trigger: int = 100, form: str = "parquet") -> DataFrame:
    """New files as they come, a bounded number for each trigger."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def tail(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Records of a crawl log as its files come in; a file is read once it has its final name, so none of its records is lost."""
    form = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(form).option("pathGlobFilter", "*.log").option("maxFilesPerTrigger", per_trigger).load(path)
    return crawl_log.records(raw.select("path", "content"), schema)


def index_into(stream: DataFrame, index: Index, checkpoint: str, time: str | None = None):
    """Commits every micro-batch to the index under its number, so one that is repeated counts once."""

    def commit(batch: DataFrame, number: int) -> None:
        index.commit(batch, f"batch{number:08d}", time)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)


def upsert(stream: DataFrame, target: str, checkpoint: str, key: str, time: str, tie: str, buckets: int = 64):
    """Keeps one row a key, the latest, in buckets of keys under target.

    A micro-batch rewrites the buckets that its keys fall into, as new versions, and then drops the versions
    before; a repeated one writes the same again. `state` reads the result.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = saved(batch.withColumn("_bucket", (F.crc32(F.col(key).cast("string").cast("binary")) % buckets).cast("int")), "upsert")
        for row in keyed.select("_bucket").distinct().collect():  # at most `buckets`
            place = f"{target}/bucket={row[0]}"
            old = [v for v in names_in(spark, place) if v.startswith("v") and int(v[1:]) < number]
            new = keyed.where(F.col("_bucket") == row[0]).drop("_bucket")
            if old:
                new = spark.read.schema(batch.schema).parquet(f"{place}/{old[-1]}").unionByName(new)
            latest(new, key, time, tie).write.mode("overwrite").parquet(f"{place}/v{number:08d}")
            for v in old[:-1]:
                remove(spark, f"{place}/{v}")
        discard(keyed)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def state(spark: SparkSession, target: str, schema) -> DataFrame:
    """What `upsert` keeps: the last version of each bucket."""
    paths = [f"{target}/{b}/{names_in(spark, f'{target}/{b}')[-1]}" for b in names_in(spark, target) if b.startswith("bucket=")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def windowed(stream: DataFrame, time: str, late: str, size: str, slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts in event-time windows; rows later than `late` are left out."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def session_windows(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    own = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return own.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def recent_queries(stream: DataFrame, session: str, time: str, text: str, tie: str, keep: int = 5, ttl_s: int = 1800) -> DataFrame:
    """For each query its session's last ones, newest first, and whether it rewords the one before; state is dropped when the watermark is ttl_s past the last query."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "tie"], kind="stable")
        out = []
        for t, tie in zip(rows["q"], rows["tie"], strict=True):
            reworded = False
            if known:
                a, b = set(t.split()), set(known[0].split())
                reworded = bool(a or b) and len(a & b) / max(len(a), len(b)) > 0.5
            known = [t, *known][:keep]
            out.append((key[0], tie, list(known), reworded))
        state.update((known,))
        state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + ttl_s * 1000)
        yield pd.DataFrame(out, columns=["session_id", "tie", "recent", "is_reformulation"])

    own = stream.select(F.col(session).cast("string").alias("session_id"), F.col(time).cast("timestamp").alias("at"), F.coalesce(F.col(text), F.lit("")).alias("q"), F.col(tie).cast("long").alias("tie")).withWatermark("at", f"{ttl_s} seconds")
    return own.groupBy("session_id").applyInPandasWithState(update, "session_id string, tie long, recent array<string>, is_reformulation boolean", "recent array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def paused(stream: DataFrame, key: str, time: str, percent: str, tie: str, pause: int = 50, resume: int = 30) -> DataFrame:
    """Hysteresis with the verdict as state."""

    def update(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(batches)).sort_values(["at", "tie"], kind="stable")
        out = []
        for tie, p in zip(rows["tie"], rows["p"], strict=True):
            now = p >= resume if now else p >= pause
            out.append((k[0], tie, bool(now)))
        state.update((bool(now),))
        yield pd.DataFrame(out, columns=["key", "tie", "paused"])

    own = stream.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("at"), F.col(percent).cast("double").alias("p"), F.col(tie).cast("long").alias("tie"))
    return own.groupBy("key").applyInPandasWithState(update, "key string, tie long, paused boolean", "paused boolean", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a table in the shared folder and reads it."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    # In complete mode each batch holds the whole result: the last one counts.
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    batches = sorted(names_in(spark, f"{base}/rows"), key=lambda n: int(n.partition("=")[2]))
    paths = [f"{base}/rows/{b}" for b in (batches[-1:] if mode == "complete" else batches)]
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)
