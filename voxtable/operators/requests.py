"""Cost and latency of classifier requests."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.seq import fresh, running


def request_stats(requests: DataFrame) -> DataFrame:
    """Per clip: count, nearest-rank p50 and p95 latency, token sums, cost.

    Ranks come from running counts per latency value."""
    n = requests.groupBy("clip_id", "latency_ms").agg(F.count("*").alias("n"))
    r = running(n, "latency_ms", {"cum": ("sum", "n")}, size=10)
    t = requests.groupBy("clip_id").agg(F.count("*").alias("n_requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    r = r.join(fresh(t), "clip_id")
    at = lambda q: F.min(F.when(F.col("cum") > F.least(F.floor(F.col("n_requests") * q), F.col("n_requests") - 1), F.col("latency_ms")))
    p = r.groupBy("clip_id").agg(at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"))
    return t.join(fresh(p), "clip_id").withColumn("cost", F.col("input_tokens") / 1_000_000 * fixed.INPUT_PRICE_PER_MILLION)
