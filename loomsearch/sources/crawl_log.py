"""The crawl log: files of length-prefixed JSON records, as a Spark data source and writer; and table helpers."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomsearch.functions.vectorised import tune
from loomsearch.sources.tables import saved

ROTATE_BYTES = 256 << 20


def frame(records: Iterator[str]) -> bytes:
    """Each record after its length, four bytes, most significant first."""
    return b"".join(struct.pack(">I", len(b)) + b for b in (r.encode() for r in records))


def unframe(data: bytes) -> Iterator[str]:
    """Records up to the first cut one; those that are no JSON are skipped."""
    at = 0
    while at + 4 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        if at + 4 + size > len(data):
            return
        raw = data[at + 4 : at + 4 + size]
        at += 4 + size
        try:
            text = raw.decode()
            json.loads(text)
        except ValueError:
            continue
        yield text


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of all *.log files under path, through Spark's own file reader, so any file system will do."""
    return records(spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path).select("path", "content"), schema)


def records(files: DataFrame, schema: str) -> DataFrame:
    """Records of whole files (path, content)."""
    tune(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(unframe(bytes(content)))
                for s in range(0, len(rows), 5000):
                    yield pd.DataFrame({"file": name, "pos": range(s, s + len(rows[s : s + 5000])), "record": rows[s : s + 5000]})

    raw = files.mapInPandas(run, "file string, pos long, record string")
    return raw.select("file", "pos", F.from_json("record", schema).alias("r")).select("file", "pos", "r.*")


def _open(uri: str):
    """A file to write on an executor: shared folders by their path, other file systems through Arrow."""
    scheme, _, rest = uri.partition(":")
    if scheme == uri or scheme == "file":
        return open("/" + rest.lstrip("/") if scheme == "file" else uri, "xb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path)


def write(df: DataFrame, path: str, rotate_bytes: int = ROTATE_BYTES) -> None:
    """Appends records as files crawl-<number>.log of about rotate_bytes, numbered on from the highest there.

    Each task writes its own files into a folder beside the log; then the driver only renames them, so
    a failed task leaves nothing in the log.
    """
    spark = df.sparkSession
    tune(spark)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    taken = [int(n[6:14]) for n in (s.getPath().getName() for s in fs.listStatus(place)) if n.startswith("crawl-") and n.endswith(".log")]
    number = max(taken, default=-1) + 1
    new = jvm.org.apache.hadoop.fs.Path(place, f"_new-{uuid.uuid4().hex}")
    fs.mkdirs(new)
    folder = new.toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        names, out, size = [], None, 0
        for batch in batches:
            for record in batch.column(0).to_pylist():
                if out is None:
                    names.append(f"{task.partitionId():08d}-{len(names):06d}-{task.taskAttemptId()}")
                    out, size = _open(f"{folder}/{names[-1]}"), 0
                out.write(data := frame(iter((record,))))
                size += len(data)
                if size >= rotate_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    records = df.select(F.to_json(F.struct("*")).alias("r"))
    names = sorted(r.name for r in records.mapInArrow(run, "name string").collect())  # one a file
    for k, name in enumerate(names):
        fs.rename(jvm.org.apache.hadoop.fs.Path(new, name), jvm.org.apache.hadoop.fs.Path(place, f"crawl-{number + k:08d}.log"))
    fs.delete(new, True)


def with_ids(df: DataFrame, start: int = 0, order: str = "url") -> DataFrame:
    """Dense ids from start on, in this order.

    Rows are dealt by range and numbered within their partition, and written once: the counts of the
    partitions come from the same rows that get the ids.
    """
    spark = df.sparkSession
    parts = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order)
    own = saved(parts.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part, nth = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    # One row a partition.
    sizes = own.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return own.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("doc_id", F.col("_before") + nth + start).drop("_p", "_m", "_before")
