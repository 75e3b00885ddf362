"""Link graph: edges, degrees, PageRank and topic PageRank as iterated joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomsearch.functions.urls import TOPICS, topic
from loomsearch.schema import Settings
from loomsearch.sources.tables import discard, saved


def edges(docs: DataFrame, url: str = "url", links: str = "outgoing_links") -> DataFrame:
    """(src, dst), distinct within a record; records of one source add up."""
    return docs.select(F.col(url).alias("src"), F.explode(F.array_distinct(F.transform(links, lambda x: x["url"]))).alias("dst"))


def nodes(edges_: DataFrame) -> DataFrame:
    return edges_.select(F.col("src").alias("id")).unionByName(edges_.select(F.col("dst").alias("id"))).distinct()


def degrees(edges_: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree)."""
    ins = edges_.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    outs = edges_.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    return ins.join(outs, "id", "full").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def pagerank(edges_: DataFrame, teleport: dict[str, Column] | None = None, settings: Settings = Settings(), iterations: int | None = None) -> DataFrame:
    """(id, one rank column for each entry of teleport); by default one column, pagerank, with even teleport.

    teleport: for each column, a boolean over id that marks its seeds (even where there is none).
    Dangling mass goes where teleport goes. All columns share one loop. Without a fixed number of
    iterations the loop ends when no column moves more than the tolerance in sum. Each round is saved
    once, and one pass over what was saved gives the dangling mass and the movement; the round before
    is then deleted. Ranks and edges are merged whatever their size: what is broadcast goes through the
    driver, in every round anew.
    """
    d = settings.damping
    names = list(teleport or {"pagerank": None})
    edges_ = saved(edges_.select("src", "dst"), "edges")
    out = edges_.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    base = nodes(edges_).hint("merge").join(out, "id", "left")
    seeds = {n: (teleport or {}).get(n) for n in names}
    base = saved(base.select("id", "out", *[(F.lit(1.0) if c is None else F.when(c, 1.0).otherwise(0.0)).alias(f"t_{n}") for n, c in seeds.items()]), "nodes")
    total = base.agg(F.count("*").alias("n"), *[F.sum(f"t_{n}").alias(f"t_{n}") for n in names]).first()
    if not total["n"]:
        return base.select("id", *[F.lit(0.0).alias(n) for n in names])
    share = {n: (F.col(f"t_{n}") / total[f"t_{n}"] if total[f"t_{n}"] else F.lit(1.0 / total["n"])) for n in names}
    ranks = saved(base.select("id", "out", *[share[n].alias(f"t_{n}") for n in names], *[F.lit(1.0 / total["n"]).alias(n) for n in names], *[F.lit(0.0).alias(f"d_{n}") for n in names]), "ranks")
    discard(base)
    measures = [F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col(n))), F.lit(0.0)).alias(n) for n in names] + [F.sum(f"d_{n}").alias(f"d_{n}") for n in names]
    for _ in range(iterations or settings.iterations):
        seen = ranks.agg(*measures).first()
        if iterations is None and _ and all(seen[f"d_{n}"] < settings.tolerance for n in names):
            break
        given = edges_.hint("merge").join(ranks.where("out is not null").select(F.col("id").alias("src"), *[(F.col(n) / F.col("out")).alias(f"g_{n}") for n in names]), "src").groupBy(F.col("dst").alias("id")).agg(*[F.sum(f"g_{n}").alias(f"g_{n}") for n in names])
        new = [((1 - d + d * seen[n]) * F.col(f"t_{n}") + d * F.coalesce(F.col(f"g_{n}"), F.lit(0.0))).alias(f"n_{n}") for n in names]
        moved = ranks.hint("merge").join(given, "id", "left").select("id", "out", *[f"t_{n}" for n in names], *names, *new)
        moved = moved.select("id", "out", *[f"t_{n}" for n in names], *[F.col(f"n_{n}").alias(n) for n in names], *[F.abs(F.col(f"n_{n}") - F.col(n)).alias(f"d_{n}") for n in names])
        before, ranks = ranks, saved(moved, "ranks")
        discard(before)
    discard(edges_)
    return ranks.select("id", *names)


def topic_pagerank(edges_: DataFrame, **how) -> DataFrame:
    """(id, pr_reference, pr_news, pr_commercial, pr_academic) with each topic's hosts as seeds."""
    return pagerank(edges_, {f"pr_{t.lower()}": topic(F.col("id")) == t for t in TOPICS}, **how)


def domain_authority(ranks: DataFrame, host: Column) -> DataFrame:
    """(domain, authority): PageRank of all a domain's pages."""
    return ranks.groupBy(host.alias("domain")).agg(F.sum("pagerank").alias("authority"))


def anchors(docs: DataFrame, most: int = 100) -> DataFrame:
    """(url, anchors): up to `most` distinct anchor texts of links to each URL, the most frequent first."""
    links = docs.select(F.explode("outgoing_links").alias("l")).select(F.col("l.url").alias("url"), F.col("l.anchor_text").alias("anchor")).where("anchor != ''")
    counted = links.groupBy("url", "anchor").agg(F.count("*").alias("n"))
    best = counted.withColumn("k", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("n"), "anchor"))).where(F.col("k") <= most)
    return best.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "anchor"))), lambda x: x["anchor"]).alias("anchors"))


def save(path: str, edges_: DataFrame, ranks: DataFrame) -> None:
    """Writes the graph as tables under path: edges, and ranks with all their columns."""
    edges_.select("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")
    ranks.write.mode("overwrite").parquet(f"{path}/ranks")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, ranks) as they were saved."""
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/ranks")


def ranks_of(ranks: DataFrame, urls: DataFrame, rank: str = "pagerank") -> DataFrame:
    """urls (column url) with their rank; 0 for unknown ones."""
    return urls.join(ranks.select(F.col("id").alias("url"), rank), "url", "left").withColumn(rank, F.coalesce(rank, F.lit(0.0)))
