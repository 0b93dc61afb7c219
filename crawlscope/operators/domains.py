"""Domain counts, landing pages, text sizes, lookups and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.functions.urls import domain_of, is_domain_root, is_landing_page

# The canonical column order of flat records.
CANONICAL = ["f", "o", "s", "rs", "u", "c", "ts", "collection", "lang", "prob", "text", "seg_langs", "robotstxt", "id", "filter", "pii", "doc_scores"]


def with_domain(df: DataFrame, url: str) -> DataFrame:
    """Rows whose URL has a domain, with it; the URL column alone is needed from the scan."""
    return df.withColumn("domain", domain_of(F.col(url))).where(F.col("domain").isNotNull() & (F.col("domain") != ""))


def domain_counts(df: DataFrame, url: str) -> DataFrame:
    """(domain, count): one shuffle of what map-side counting leaves. Sort with ranked() to write a report."""
    return with_domain(df.select(url), url).groupBy("domain").agg(F.count(F.lit(1)).alias("count"))


def ranked(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("count"), F.asc("domain"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Counts of parts added up: counting parts and merging is counting the whole."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("domain").agg(F.sum("count").alias("count"))


def count_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count(F.lit(1)).alias("distinct_domains"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_occurrences"))


def landing_pages(df: DataFrame, url: str, roots: bool = True) -> DataFrame:
    """Rows on a landing path, and with `roots` those at a domain's root; not applied by the plain conversion."""
    hit = is_landing_page(F.col(url))
    return df.where(hit | is_domain_root(F.col(url)) if roots else hit)


def in_canonical_order(df: DataFrame, first: list[str] | None = None, last: str = "text_char_count") -> DataFrame:
    """Known columns in canonical order, others as they come, the derived one last."""
    first = first or CANONICAL
    known = [c for c in first if c in df.columns]
    return df.select(*known, *[c for c in df.columns if c not in known and c != last], *[c for c in df.columns if c == last])


def evolve(*parts: DataFrame, last: str = "text_char_count") -> DataFrame:
    """Union by name: columns that a part lacks are null there."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return in_canonical_order(whole, whole.columns, last)


def size_stats(df: DataFrame, n: str) -> DataFrame:
    """Mean, exact median, least, most, and how many texts are empty or not."""
    x = F.col(n)
    return df.agg(
        F.round(F.avg(x), 6).alias("mean_chars"),
        F.percentile(x, F.lit(0.5)).alias("median_chars"),
        F.min(x).alias("min_chars"),
        F.max(x).alias("max_chars"),
        F.count_if(x > 0).alias("with_text"),
        F.count_if(x == 0).alias("without_text"),
    )


def remaining(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those done: resumption that never repeats or skips a row, whatever their order."""
    return all_rows.join(done.select(key).distinct(), key, "left_anti")


def look_up_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    return rows.join(counts.withColumnRenamed("count", "domain_times"), "domain", "left")


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """(order, batch, done_pct): number of the batch of each row in order, and the share done with that row. order is an integer column.

    The row number comes from ranges of the column: rows are numbered within a range, and ranges are offset by the counts of
    those before them, so no task sees all rows."""
    lo, hi, n = df.agg(F.min(order), F.max(order), F.count(order)).first()
    width = max(1, -(-(int(hi) - int(lo) + 1) // max(1, n // 100_000))) if n else 1
    rows = df.select(order).where(F.col(order).isNotNull()).withColumn("p", F.floor((F.col(order) - F.lit(lo or 0)) / F.lit(width)).cast("long"))
    # Ranges are some 100,000 rows each where ids are dense; their table is small.
    sizes = rows.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    ahead = sizes.select("p", (F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("p")) - F.col("c")).alias("before"))
    place = F.row_number().over(Window.partitionBy("p").orderBy(order)) + F.col("before")
    out = rows.join(ahead, "p").withColumn("k", place)
    return out.select(order, F.floor((F.col("k") - 1) / F.lit(size)).cast("long").alias("batch"), F.round(100 * F.col("k") / F.lit(n), 6).alias("done_pct"))


def share(condition: Column, among: Column | None = None) -> Column:
    """Per cent of rows for which a condition holds, among those of another; null if there are none."""
    c = F.coalesce(condition, F.lit(False))
    a = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    return F.round(F.try_divide(100.0 * F.count_if(c & a), F.count_if(a)), 6)


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row: for each field the per cent of rows that lack it (null or empty)."""
    return df.agg(*[share(F.coalesce(F.col(f).cast("string"), F.lit("")) == "").alias(f"missing_{f}") for f in fields])


def agreement(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row: for each pair the per cent of equal values where both are present, and of the second present without the first."""
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return df.agg(*[
        x
        for a, b in pairs
        for x in (share(F.col(a).cast("string") == F.col(b).cast("string"), has(a) & has(b)).alias(f"same_{a}"), share(~has(a) & has(b)).alias(f"only_{b}"))
    ])


def restore_order(results: DataFrame, asked: DataFrame, key: str, position: str) -> DataFrame:
    """Results in the order in which they were asked for: by the least position of their key."""
    first = asked.groupBy(key).agg(F.min(position).alias(position))
    return results.join(first, key).orderBy(position)


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows in an order: a top-k from the other end, without a full sort."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def valid_share(df: DataFrame, text: Column) -> DataFrame:
    """One row: rows, those with a text that isn't blank, and their share."""
    ok = F.coalesce(F.trim(text), F.lit("")) != ""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_valid"), share(ok).alias("pct"))
