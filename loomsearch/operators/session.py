"""Search sessions in batch form: recent queries and reformulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomsearch.functions.text import words


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct words against the larger set."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.size(F.array_intersect(x, y)) / F.nullif(F.greatest(F.size(x), F.size(y)), F.lit(0))


def is_reformulation(a: Column, b: Column) -> Column:
    return F.coalesce(overlap(a, b) > 0.5, F.lit(False))


def reformulations(queries: DataFrame, session: str, time: str, text: str) -> DataFrame:
    """Adds previous and is_reformulation against the query before."""
    before = F.lag(text).over(Window.partitionBy(session).orderBy(time))
    return queries.withColumn("previous", before).withColumn("is_reformulation", is_reformulation(F.col(text), F.col("previous")))


def recent(queries: DataFrame, session: str, time: str, text: str, keep: int = 5, ttl_s: int | None = None) -> DataFrame:
    """Adds recent: the last `keep` queries, newest first; a gap over ttl_s starts anew."""
    order = Window.partitionBy(session).orderBy(time)
    if ttl_s is not None:
        gap = F.unix_seconds(F.col(time).cast("timestamp")) - F.unix_seconds(F.lag(F.col(time).cast("timestamp")).over(order))
        queries = queries.withColumn("_part", F.sum(F.when(gap > ttl_s, 1).otherwise(0)).over(order))
        order = Window.partitionBy(session, "_part").orderBy(time)
    out = queries.withColumn("recent", F.reverse(F.collect_list(text).over(order.rowsBetween(1 - keep, 0))))
    return out.drop("_part")


def new_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("session_id", F.expr("uuid()"))
