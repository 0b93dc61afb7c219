"""Outcomes of fetching: classes, histograms, rates, diagnoses, rolling means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_class(status: Column) -> Column:
    return F.when(status == 429, "throttled").when(status.between(200, 299), "ok").when(status.isNull(), "failed").otherwise("other")


def found_metadata(title: Column, description: Column) -> Column:
    return (F.coalesce(title, F.lit("")) != "") | (F.coalesce(description, F.lit("")) != "")


def histogram(df: DataFrame, key: str, n: str = "n") -> DataFrame:
    """(key, n, pct) with the share of all rows, from one aggregation."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    total = counts.agg(F.sum(n).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, n, F.round(100 * F.col(n) / F.col("total"), 6).alias("pct"))


def request_stats(df: DataFrame, key: str, seconds: str, status: str, error: str, cache_hit: Column | None = None) -> DataFrame:
    """By key: answered and failed requests, 429s, errors by class, the mean time of the answered ones and, given whether each
    look-up was cached, the share of hits. What has a status counts as answered."""
    s, e = F.col(status), F.col(error)
    made = [
        F.count_if(s.isNotNull()).alias("answered"), F.count_if(s.isNull()).alias("failed"), F.count_if(s == 429).alias("throttled"),
        F.count_if(s.isNull() & (e == "Request")).alias("request_errors"), F.count_if(s.isNull() & (e == "Timeout")).alias("timeouts"),
        F.round(F.avg(F.when(s.isNotNull(), F.col(seconds))), 6).alias("mean_seconds"),
    ]
    if cache_hit is not None:
        made.append(F.round(F.coalesce(F.try_divide(100.0 * F.count_if(cache_hit), F.count(cache_hit)), F.lit(0.0)), 6).alias("cache_hit_pct"))
    return df.groupBy(key).agg(*made)


def diagnosis(mean_seconds: Column, answered: Column, failed: Column, throttled: Column, request_errors: Column, timeouts: Column) -> Column:
    """What is wrong, as an array; null if nothing was answered. The limits: 10 s, 70 % answered, and, of the answered requests' number,
    a tenth throttled, a tenth request errors, a fifth timeouts."""
    found = F.array(
        F.when(mean_seconds > 10, "slow responses"),
        F.when(100.0 * answered / (answered + failed) < 70, "low success rate"),
        F.when(throttled > answered * 0.1, "throttled"),
        F.when(request_errors > answered * 0.1, "request errors"),
        F.when(timeouts > answered * 0.2, "timeouts"),
    )
    return F.when(answered > 0, F.array_compact(found))


def resource_levels(cpu: Column, memory: Column, connections: Column, mb_per_s: Column) -> Column:
    """struct(cpu, memory, connections, throughput): low, normal or high."""
    level = lambda x, low, high: F.when(x < low, "low").when(x > high, "high").otherwise("normal")
    return F.struct(level(cpu, 40, 85).alias("cpu"), level(memory, 70, 90).alias("memory"), level(connections, 300, 800).alias("connections"), level(mb_per_s, 5, 50).alias("throughput"))


def bottleneck(cpu: Column, memory: Column, mb_per_s: Column) -> Column:
    """What most likely limits a machine: the first case that holds."""
    idle = (cpu < 50) & (memory < 70) & (mb_per_s < 20)
    return F.when(idle, "external").when(cpu > 80, "cpu").when(mb_per_s > 30, "network").otherwise("external, resources available")


def rolling(df: DataFrame, key: str, order: list[str], value: str, rows: int) -> DataFrame:
    """df with the mean and the maximum of the last `rows` values within a key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumns({"rolling_mean": F.round(F.avg(value).over(w), 8), "rolling_max": F.max(value).over(w)})


def deltas(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """df with the difference to the row before within a key, 0 at first."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("delta", F.round(F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)), 6))


def adapted_delay(delay: Column, status: Column) -> Column:
    """The next delay in seconds: times 1.5 up to 2 after 429, times 0.95 down to 0.05 after success."""
    return F.when(status == 429, F.least(delay * 1.5, F.lit(2.0))).when(status.between(200, 299), F.greatest(delay * 0.95, F.lit(0.05))).otherwise(delay)
