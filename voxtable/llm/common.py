"""Reading tables, sizes and connected components for the corpus operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtable.functions.stage import stage

#: Rows of one identifier column that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of df whose identifier is among the (written) ids: a broadcast up to a checked size, else a shuffle."""
    if ids.count() <= BROADCAST_IDS:
        return df.join(F.broadcast(ids), on, "left_semi")
    return df.join(ids, on, "left_semi")


def without(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of df whose identifier is not among the (written) ids, in the same way. Rows without identifier stay."""
    if ids.count() <= BROADCAST_IDS:
        return df.join(F.broadcast(ids), on, "left_anti")
    return df.join(ids, on, "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a bigint, b bigint): one row (id, component) per linked id, component
    being the smallest id that can be reached.

    Alternates large-star and small-star: every round keeps at most as many links as it had, all pointing to
    smaller ids, until they form stars. Rounds grow with the logarithm of the longest path. Each round is written
    to the shared folder, so a lost executor costs one round at most, and a node of many links is a skewed join
    between written tables, which adaptive execution splits. Nothing is gathered on the driver but two counts.
    No links give no rows; links of an id to itself and repeated links are ignored; nulls are dropped."""
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    few = max(8, shuffle_partitions(edges.sparkSession) // 8)

    def kept_as(df: DataFrame, name: str) -> DataFrame:
        """Two numbers per row: an eighth of the usual partitions is enough."""
        return stage(df.coalesce(few), name)

    while True:
        # Large star: every larger neighbour of u points to the least of u and its neighbours.
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = kept_as(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = kept_as(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # Small star: every smaller neighbour of u, and u itself, points to the least of them.
        low = kept_as(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        kept = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = kept_as(kept.where("u <> v").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    heads = links.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(heads)
