"""Mixing sources to target weights by Poisson replication, in DataFrame operations alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import save

#: Up to so many sources the table of rates is broadcast; beyond, the join is salted.
BROADCAST_SOURCES = 2_000
#: Up to this rate the distribution function is a table by source; beyond, each row sums its own, around the mean.
TABLE_RATE = 10_000.0
#: Copies that a row of many is exploded by at a time; its blocks are dealt to all tasks.
COPY_BLOCK = 4_096


def hash_uniform(seed: str, key: Column) -> Column:
    """A double in (0, 1) from the first 52 bits of an MD5: the same in any engine and on every retry."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def large_count(rate: Column, u: Column) -> Column:
    """The Poisson count of a large rate by inversion at u, over twelve standard deviations to either side of the mean.

    What lies below has less than 1e-30 of the distribution. The first probability is Stirling's series in the
    difference from the mean, which loses no digits; the others follow by ratios.
    """
    low = F.floor(rate - 12 * F.sqrt(rate) - 40)
    off = low - rate
    first = off - low * F.log1p(off / rate) - 0.5 * F.ln(2 * math.pi * low) - 1 / (12 * low)
    start = F.struct(first.alias("l"), F.exp(first).alias("c"), low.alias("k"))

    def step(s, j):
        log_p = s["l"] + F.ln(rate / (low + j))
        return F.when(s["c"] < u, F.struct(log_p.alias("l"), (s["c"] + F.exp(log_p)).alias("c"), (low + j).alias("k"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), (24 * F.sqrt(rate) + 80).cast("int")), start, step, lambda s: s["k"].cast("int"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    epochs: float = 1.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    max_rate: float | None = None,
) -> DataFrame:
    """docs replicated so that sources appear in proportion to weights; adds copy_no and n_copies (int), shuffle_key (string).

    With N rows in all, a source with share w of the weights and n rows has the mean repetition rate
    epochs * N * w / n. Each row draws its count from a Poisson distribution of that mean by inverting it at a
    uniform that hashes seed and id, and is exploded by the count; zero leaves it out, which is the sampling that
    this operator is for. Counts by source cover all rows. weights None: every source weighs the same; a source
    that a given dict doesn't list has weight 0. The null source is a source of its own (key None).

    The rows are shuffled globally in one exchange: partitioned and sorted by shuffle_key, an MD5 of seed, id and
    copy, so no source, however hot, meets in one task. Rows that repeat an id get equal counts and keys; a null id
    is hashed as the text "null". Rates have no bound; with max_rate, one over it is an error, never a cap. A rate over
    TABLE_RATE takes an exchange more, which deals the copies of a row to all tasks. An empty table gives an empty one.
    Columns of docs with the names of the added ones are replaced.
    """
    spark = docs.sparkSession
    src = F.col(f"`{source_col}`")
    sizes = docs.groupBy(src.alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sizes = sizes.withColumn("w", F.lit(1.0))
    else:
        total_weight = sum(weights.values())
        if total_weight <= 0 or min(weights.values()) < 0:
            raise ValueError("weights: none negative, and some positive")
        w = F.lit(weights.get(None, 0.0)) if None in weights else F.lit(0.0)
        pairs = [F.lit(x) for k, v in weights.items() if k is not None for x in (k, float(v))]
        if pairs:
            w = F.when(F.col("mix_source").isNull(), w).otherwise(F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce("mix_source", F.lit(""))), F.lit(0.0)))
        sizes = sizes.withColumn("w", w)
    sizes = save(sizes, "mix-sizes")  # one small row for each source
    n_sources, n_rows, weight, worst = sizes.agg(F.count(F.lit(1)), F.sum("n"), F.sum("w"), F.max(F.col("w") / F.col("n"))).first()
    scale = epochs * (n_rows or 0) / weight if weight else 0.0
    if max_rate is not None and worst and worst * scale > max_rate:
        raise ValueError(f"a source would repeat {worst * scale:.0f} times; max_rate is {max_rate:g}")
    rates = sizes.select("mix_source", (F.lit(scale) * F.col("w") / F.col("n")).alias("rate"))
    # The distribution function up to where it can't be told from 1 by 52 bits, summed in logarithms.
    steps = F.least(F.col("rate"), F.lit(TABLE_RATE))
    steps = (steps + 12 * F.sqrt(steps) + 40).cast("int")
    start = F.struct((-F.col("rate")).alias("l"), F.array(F.exp(-F.col("rate"))).alias("c"))
    grow = lambda s, k: F.struct(
        (s["l"] + F.ln(F.col("rate") / k)).alias("l"),
        F.concat(s["c"], F.array(F.element_at(s["c"], -1) + F.exp(s["l"] + F.ln(F.col("rate") / k)))).alias("c"),
    )
    cdf = F.aggregate(F.sequence(F.lit(1), steps), start, grow, lambda s: s["c"])
    table = F.when(F.col("rate") > TABLE_RATE, F.lit(None)).when(F.col("rate") > 0, cdf).otherwise(F.array(F.lit(1.0)))
    rates = rates.select("mix_source", "rate", table.alias("cdf"))
    large = bool(worst) and worst * scale > TABLE_RATE

    made = {"copy_no", "n_copies", "shuffle_key"}
    cols = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*cols).alias("row"), src.alias("s"), key.alias("key"))
    if n_sources <= BROADCAST_SOURCES:
        met = rows.join(F.broadcast(rates), F.col("s").eqNullSafe(F.col("mix_source")))
    else:
        salts = 16
        spread = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
        met = rows.join(spread, F.col("s").eqNullSafe(F.col("mix_source")) & (F.col("own") == F.col("salt")))
    u = hash_uniform(seed, F.col("key"))
    count = F.aggregate("cdf", F.lit(0), lambda k, c: k + F.when(c < F.col("u"), 1).otherwise(0))
    if large:
        count = F.when(F.col("cdf").isNull(), large_count(F.col("rate"), F.col("u"))).otherwise(count)
    drawn = met.select("row", "key", "rate", "cdf", u.alias("u")).select("row", "key", count.alias("n_copies")).where(F.col("n_copies") > 0)

    def exploded(rows, first, last):
        return rows.select("row", "key", "n_copies", F.explode(F.sequence(first, last)).alias("copy_no"))

    n_copies = F.col("n_copies")
    if large:
        copies = exploded(drawn.where(n_copies <= COPY_BLOCK), F.lit(1), n_copies)
        blocks = drawn.where(n_copies > COPY_BLOCK).select("row", "key", "n_copies", F.explode(F.sequence(F.lit(1), n_copies, F.lit(COPY_BLOCK))).alias("first"))
        blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "first")
        # The least of the differences, as a sum could pass the largest int.
        copies = copies.unionByName(exploded(blocks, F.col("first"), F.col("first") + F.least(F.lit(COPY_BLOCK - 1), n_copies - F.col("first"))))
    else:
        copies = exploded(drawn, F.lit(1), n_copies)
    out = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), "key", F.col("copy_no").cast("string"))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key").select("row.*", "copy_no", "n_copies", "shuffle_key")


def poisson_count(u: float, rate: float) -> int:
    """The count that mix_sources() draws at u: for tests."""
    k, log_p = 0, -rate
    c = math.exp(log_p)
    while c < u:
        k += 1
        log_p += math.log(rate / k)
        c += math.exp(log_p)
    return k


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs)


ORACLE = {
    "op3_mix_sources": r"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
total AS (SELECT sum(n) AS rows, count(*) AS sources FROM sizes),
rates AS (SELECT source, CAST(rows AS DOUBLE) / sources / n AS rate FROM sizes, total),
cdf(source, rate, k, lp, c, below) AS (
  SELECT source, rate, 0, -rate, exp(-rate), CAST(0 AS DOUBLE) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, lp + ln(rate / (k + 1)), c + exp(lp + ln(rate / (k + 1))), c
  FROM cdf WHERE k < rate + 12 * sqrt(rate) + 40),
draw AS (
  SELECT doc_id, source, text,
         (CAST(CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 13) AS UBIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
counted AS (
  SELECT d.doc_id, d.source, d.text, CAST(max(c.k) AS INTEGER) AS n_copies
  FROM draw d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.below < d.u
  GROUP BY d.doc_id, d.source, d.text),
copies AS (
  SELECT doc_id, source, text, n_copies, CAST(unnest(range(1, n_copies + 1)) AS INTEGER) AS copy_no
  FROM counted WHERE n_copies > 0)
SELECT doc_id, source, text, n_copies, copy_no,
       md5('mix-order:' || CAST(doc_id AS VARCHAR) || ':' || CAST(copy_no AS VARCHAR)) AS shuffle_key
FROM copies
"""
}
QUERIES = {"op3_mix_sources": op3_mix_sources}
