"""Request metrics: counts, rates, histograms and quantiles made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The upper bounds of the histogram's buckets.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def bucket_counts(df: DataFrame, keys: list[str], value: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """keys, le (upper bound, infinity last), n: how many values are at most le, one row for each key and bound; null values count for none."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(*(F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)), F.count("*").alias(f"_{len(bounds)}"))
    pairs = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate((*bounds, float("inf")))))
    return per.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.le", "x.n")


def histogram_quantile(df: DataFrame, keys: list[str], value: str, q: float, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """keys, quantile: the q-quantile read off the buckets, interpolated within the bucket it falls into.

    The first bucket begins at 0; a quantile beyond the last bound is that bound. Null without values.
    """
    buckets = bucket_counts(df, keys, value, bounds).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("le", "n"))).alias("b"))
    rank = q * F.element_at("b", -1)["n"]
    at = F.size(F.filter("b", lambda x: x["n"] < rank)) + 1
    here = F.element_at("b", at)
    prior = F.when(at > 1, F.element_at("b", F.greatest(at - 1, F.lit(1)))["le"]).otherwise(0.0)
    below = F.when(at > 1, F.element_at("b", F.greatest(at - 1, F.lit(1)))["n"]).otherwise(0)
    inside = prior + (here["le"] - prior) * (rank - below) / (here["n"] - below)
    return buckets.select(*keys, F.when(at > len(bounds), F.lit(float(bounds[-1]))).otherwise(inside).alias("quantile"))


def request_rate(df: DataFrame, keys: list[str], at: str, window: str = "1 minute", seconds: int = 60) -> DataFrame:
    """keys, start, n, rate: requests in each tumbling window that has any, and how many a second."""
    per = df.where(F.col(at).isNotNull()).groupBy(F.window(at, window).alias("w"), *keys).agg(F.count("*").alias("n"))
    return per.select(*keys, F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("rate"))


def exposition(df: DataFrame, name: str, labels: list[str], value: Column) -> DataFrame:
    """line STRING: each row as a line of the text exposition format, its labels in the given order; a null label is empty."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    parts = [F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels]
    head = F.concat(F.lit(f"{name}{{"), F.concat_ws(",", *parts), F.lit("} ")) if labels else F.lit(f"{name} ")
    return df.select(F.concat(head, value.cast("string")).alias("line"))
