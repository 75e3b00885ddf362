"""Table loading, snapshots with retention, metrics."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsearch.schema import SnapshotError

#: Upper bounds of latency buckets, in seconds.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the warehouse where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that `saved` made, once nothing reads them any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place, fs, _ = _fs(df.sparkSession, path)
        fs.delete(place, True)


def state_of(df: DataFrame) -> str:
    """A digest of the files that df reads: their paths, sizes and times."""
    digest = hashlib.sha256()
    for path in sorted(df.inputFiles()):
        place, fs, _ = _fs(df.sparkSession, path)
        own = fs.getFileStatus(place)
        digest.update(f"{path} {own.getLen()} {own.getModificationTime()}\n".encode())
    return digest.hexdigest()[:32]


def remove(spark: SparkSession, path: str) -> None:
    place, fs, _ = _fs(spark, path)
    fs.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place, fs, _ = _fs(spark, path)
    return fs.exists(place)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files under path."""
    place, fs, _ = _fs(spark, path)
    return fs.getContentSummary(place).getLength()


def names_in(spark: SparkSession, path: str) -> list[str]:
    place, fs, _ = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a file or folder; False where the target is taken."""
    place, fs, _ = _fs(spark, source)
    goal, _, _ = _fs(spark, target)
    return not fs.exists(goal) and fs.rename(place, goal)


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], root: str, name: str, keep: int = 3) -> str:
    """Writes tables under root/snapshot_<name> and keeps the newest `keep` snapshots. Names that could leave the folder are refused."""
    for n in [name, *tables]:
        if not n or ".." in n or "/" in n or "\\" in n:
            raise SnapshotError(f"not a snapshot name: {n!r}")
    target = f"{root.rstrip('/')}/snapshot_{name}"
    for n, df in tables.items():
        df.write.mode("overwrite").parquet(f"{target}/{n}")
    place, fs, _ = _fs(spark, root)
    found = sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(place) if s.getPath().getName().startswith("snapshot_"))
    for _, old in found[:-keep]:
        fs.delete(_fs(spark, f"{root.rstrip('/')}/{old}")[0], True)
    return target


def disk_usage(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes used, capacity) of the file system that holds path."""
    place, fs, _ = _fs(spark, path)
    status = fs.getStatus(place)
    return status.getUsed(), status.getCapacity()


def init_dirs(spark: SparkSession, root: str, names: tuple[str, ...] = ("crawl", "index", "graph", "vectors", "snapshots")) -> None:
    for n in names:
        place, fs, _ = _fs(spark, f"{root.rstrip('/')}/{n}")
        fs.mkdirs(place)


def histogram(rows: DataFrame, seconds: str, bounds: tuple[float, ...] = LATENCY_BUCKETS) -> DataFrame:
    """(le, count): cumulative counts of a latency column up to each bound, the last without one."""
    sums = rows.agg(*[F.count_if(F.col(seconds) <= b).alias(f"b{k}") for k, b in enumerate(bounds)], F.count("*").alias("all"))
    each = F.explode(F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("count")) for k, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("count"))))
    return sums.select(each.alias("x")).select("x.*")


def health(docs: DataFrame, version: str) -> DataFrame:
    """(status, version, documents) as a health endpoint would report them."""
    return docs.agg(F.count("*").alias("documents")).select(F.lit("ok").alias("status"), F.lit(version).alias("version"), "documents")


#: Metric families: name, kind, and how a row of the log (endpoint, status, seconds, cached, answered) counts.
FAMILIES = {
    "search_requests_total": "count(*)",
    "search_errors_total": "count_if(status >= 400)",
    "cache_hits_total": "count_if(cached)",
    "cache_misses_total": "count_if(not cached)",
    "instant_answers_total": "count_if(answered)",
    "search_latency_seconds_sum": "sum(seconds)",
    "search_latency_seconds_max": "max(seconds)",
}


def metrics(log: DataFrame, by: str = "endpoint") -> DataFrame:
    """(by, metric, value): the metric families of a request log."""
    sums = log.groupBy(by).agg(*[F.expr(e).cast("double").alias(n) for n, e in FAMILIES.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in FAMILIES]))
    return sums.select(by, each.alias("x")).select(by, "x.*")
