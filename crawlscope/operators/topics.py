"""Topics: reduction and clustering by pyspark.ml, terms by class-based TF-IDF, diverse keywords, names, ranks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.functions.text import topic_name

STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the this to was were will with".split()


def assign_topics(df: DataFrame, vector: str, n_topics: int = 10, dims: int = 5, min_size: int = 20, seed: int = 42) -> DataFrame:
    """df with topic: PCA to `dims`, k-means, and -1 for clusters of fewer than min_size rows. It stands in for manifold
    reduction and density clustering, which Spark doesn't have."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    small = PCA(k=dims, inputCol="_v", outputCol="_p").fit(rows).transform(rows)
    found = KMeans(k=n_topics, seed=seed, featuresCol="_p", predictionCol="topic").fit(small).transform(small)
    # There are n_topics rows at most to broadcast.
    large = found.groupBy("topic").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size).select(F.col("topic").alias("_t"))
    met = found.join(F.broadcast(large), F.col("topic") == F.col("_t"), "left")
    return met.select(*df.columns, F.coalesce("_t", F.lit(-1)).alias("topic"))


def terms(df: DataFrame, text: str, topic: str) -> DataFrame:
    """(topic, term, n, df): one- and two-word terms of letters, without stop words; df counts rows that hold the term."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}]+"), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))
    rows = df.select(F.col(topic).alias("topic"), words.alias("w"))
    # The last word has no next one, so its pair is null.
    pairs = F.transform("w", lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1)))
    # A row is one document: in order, equal terms stand together, and the first of them counts for df. Exploded by the outer kind, as
    # Spark puts a filter under the other that works out the whole array once more.
    rows = rows.select("topic", F.sort_array(F.concat("w", pairs)).alias("t"))
    each = rows.select("topic", "t", F.posexplode_outer("t").alias("i", "term")).where(F.col("term").isNotNull())
    first = F.when(F.get("t", F.col("i") - 1) == F.col("term"), 0).otherwise(1)
    # Both sums combine before the one exchange.
    return each.select("topic", "term", first.alias("first")).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("df"))


def weighted_terms(counts: DataFrame, n_rows: int, min_df: int = 3, max_df: float = 0.95, most: int = 5000) -> DataFrame:
    """(topic, term, weight): class-based TF-IDF of the `most` commonest terms that min_df rows and at most max_df of them hold."""
    # Every count has a df: the condition makes both uses of the counts need the same columns, so Spark makes them once.
    counts = counts.where(F.col("df") > 0)
    vocabulary = counts.groupBy("term").agg(F.sum("n").alias("all_n"), F.sum("df").alias("all_df")).where((F.col("all_df") >= min_df) & (F.col("all_df") <= max_df * n_rows))
    vocabulary = vocabulary.orderBy(F.desc("all_n"), "term").limit(most)
    kept = counts.join(F.broadcast(vocabulary), "term")
    size = kept.groupBy("topic").agg(F.sum("n").alias("size"))
    mean = size.agg(F.avg("size").alias("mean"))
    x = kept.join(F.broadcast(size), "topic").crossJoin(F.broadcast(mean))
    return x.select("topic", "term", F.round(F.col("n") / F.col("size") * F.ln(1 + F.col("mean") / F.col("all_n")), 9).alias("weight"))


def keywords(weights: DataFrame, embed, most: int = 8, pool: int = 24, diversity: float = 0.3) -> DataFrame:
    """(topic, all_keywords): `most` terms of the `pool` heaviest, chosen one by one for weight and against likeness to those chosen
    (maximal marginal relevance); likeness is the cosine of what `embed`, a column function as in providers, makes of terms."""
    w = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    heavy = weights.withColumn("k", F.row_number().over(w)).where(F.col("k") <= pool)
    rows = heavy.select("topic", "k", "term", "weight", embed(F.col("term")).alias("v"))

    def choose(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("k")
        v = np.stack(x["v"].to_list()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        like, gain = v @ v.T, (1 - diversity) * x["weight"].to_numpy() / max(x["weight"].max(), 1e-12)
        left, out = list(range(len(x))), []
        while left and len(out) < most:
            best = max(left, key=lambda i: (round(gain[i] - diversity * max((like[i, o] for o in out), default=0.0), 9), -i))
            out.append(best)
            left.remove(best)
        return pd.DataFrame({"topic": [x["topic"].iloc[0]], "all_keywords": [x["term"].iloc[out].tolist()]})

    # A group has `pool` rows at most.
    return rows.groupBy("topic").applyInPandas(choose, f"topic {weights.schema['topic'].dataType.simpleString()}, all_keywords array<string>")


def require_population(n: int, least: int = 50) -> int:
    """n, if there are enough texts to find topics in; else an error."""
    if n < least:
        raise ValueError(f"{n} texts; topics need at least {least}")
    return n


def outliers(df: DataFrame, topic: str = "topic") -> DataFrame:
    """One row: the number of topics (without the outlier topic -1), of rows outside any, and their share."""
    out = F.col(topic) == -1
    return df.agg(F.count_distinct(F.when(~out, F.col(topic))).alias("n_topics"), F.count_if(out).alias("n_outliers"), F.round(F.try_divide(100.0 * F.count_if(out), F.count(F.lit(1))), 6).alias("outlier_pct"))


def topic_table(sizes: DataFrame, words: DataFrame) -> DataFrame:
    """(topic_id, name, document_count, keywords, all_keywords, rank) without the outlier topic -1, largest first."""
    x = sizes.where(F.col("topic") != -1).join(words, "topic", "left")
    x = x.withColumn("all_keywords", F.coalesce("all_keywords", F.array().cast("array<string>")))
    # Topics are few: the rank needs them in one place.
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("document_count"), "topic"))
    return x.select(F.col("topic").alias("topic_id"), topic_name(F.col("all_keywords")).alias("name"), "document_count", F.slice("all_keywords", 1, 5).alias("keywords"), "all_keywords", rank.alias("rank"))
