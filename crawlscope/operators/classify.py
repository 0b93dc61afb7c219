"""Ensemble classification: similarity votes, rule boosts over a catalogue, scores, decisions, summaries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope.functions.text import cosine

OTHER = "Other"


@dataclass(frozen=True)
class Category:
    """A category's evidence. Lists, never sets: a repeated keyword counts twice."""

    name: str
    description: str
    keywords: tuple[str, ...]
    tlds: tuple[str, ...]
    domains: tuple[str, ...]


def _c(name: str, description: str, keywords: str, tlds: str, domains: str) -> Category:
    return Category(name, description, tuple(keywords.split()), tuple(tlds.split()), tuple(domains.split()))


# The names, which are the labels of the results.
#: Our own short catalogue; a larger one is handed in as rows of the same shape.
CATALOGUE = (
    _c("E-Commerce & Shopping", "shops and marketplaces", "shop store cart price order sale", ".shop .store", "shop store market buy"),
    _c("News & Media", "newspapers and broadcasters", "news press article editor daily", ".news", "news press times daily"),
    _c("Social Media & Community", "forums and networks", "forum community member profile chat", ".social", "forum social club"),
    _c("Technology & Software", "software, hosting, devices", "software cloud code app data host", ".io .dev", "tech soft cloud host"),
    _c("Entertainment & Media", "film, music, games", "movie music game show stream", ".tv .fm", "music game film"),
    _c("Education & Research", "schools and science", "school student course research lesson", ".edu", "school univ edu"),
    _c("Health & Medical", "clinics and medicine", "health doctor clinic medicine patient", ".health", "health clinic med"),
    _c("Government & Public Services", "authorities", "ministry citizen public law council", ".gov .gr", "gov city"),
    _c("Travel & Tourism", "hotels and journeys", "hotel travel tour flight beach", ".travel", "hotel travel tour"),
    _c("Finance & Banking", "banks and insurance", "bank loan insurance invest credit", ".bank", "bank finance"),
    _c("Sports & Recreation", "clubs and matches", "sport team match league player", ".football", "sport league"),
    _c(OTHER, "none of these", "various misc", "", ""),
)


def category_text(c: Category) -> str:
    """What a category's embedding is made from: name, description and its first 20 keywords."""
    return f"Category: {c.name}. Description: {c.description}. Keywords: {', '.join(c.keywords[:20])}"


def rule_boosts(text: Column, name: Column, tld: Column, catalogue=CATALOGUE) -> Column:
    """array<struct<category, rank, boost>> of the boosts above 0: 0.3 for each pattern in the domain's name, 0.2 for its TLD, and
    0.05 for each keyword in the text, 0.2 at most. The catalogue is bounded and becomes literals, so there is no join."""

    def count(holder: Column, needles: tuple[str, ...]) -> Column:
        return sum((F.contains(holder, F.lit(n)).cast("int") for n in needles), F.lit(0))

    rows = []
    for rank, c in enumerate(catalogue):
        if c.name == OTHER:
            continue
        top = F.when(tld.isin([t.lstrip(".") for t in c.tlds]) if c.tlds else F.lit(False), 0.2).otherwise(0.0)
        boost = 0.3 * count(name, c.domains) + top + F.least(F.lit(0.2), 0.05 * count(text, c.keywords))
        rows.append(F.struct(F.lit(c.name).alias("category"), F.lit(rank).alias("rank"), F.round(boost, 6).alias("boost")))
    return F.filter(F.array(*rows), lambda r: r["boost"] > 0)


def nearest(rows: DataFrame, vector: str, groups: DataFrame, group: str, group_vector: str, exclude: str | None = None) -> DataFrame:
    """rows with best and similarity: the group whose vector has the largest cosine, the least group among equals.

    groups is a catalogue: up to 10,000 rows, else an error; it travels as one array."""
    if groups.limit(10_001).count() > 10_000:
        raise ValueError("a catalogue of over 10,000 groups")
    some = groups if exclude is None else groups.where(F.col(group) != exclude)
    one = some.agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), F.col(group_vector).alias("v")))).alias("gs"))
    sims = F.transform("gs", lambda g: F.struct(F.round(cosine(F.col(vector), g["v"]), 9).alias("s"), g["g"].alias("g")))
    best = F.aggregate(F.col("sims"), F.col("sims")[0], lambda a, x: F.when(x["s"] > a["s"], x).otherwise(a))
    made = rows.crossJoin(F.broadcast(one)).withColumn("sims", sims).withColumn("best", best)
    return made.select(*rows.columns, F.col("best.g").alias("best"), F.col("best.s").alias("similarity"))


def nearest_in_catalogue(vector: Column, vectors: dict[str, list[float]]) -> Column:
    """struct(category, confidence): the category of a bounded catalogue whose vector has the largest cosine, the first among
    equals; null for a zero vector. One matrix product for each Arrow batch."""
    names = list(vectors)
    unit = np.array(list(vectors.values()), float)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)

    def pick(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_list()).astype(float) if len(v) else np.zeros((0, unit.shape[1]))
        norm = np.linalg.norm(x, axis=1)
        sims = np.round(x @ unit.T / np.maximum(norm, 1e-300)[:, None], 9)
        best = sims.argmax(axis=1)
        none = norm == 0
        return pd.DataFrame({
            "category": [None if z else names[b] for b, z in zip(best, none, strict=True)],
            "confidence": [None if z else float(r[b]) for r, b, z in zip(sims, best, none, strict=True)],
        })

    return F.pandas_udf(pick, "category string, confidence double")(vector)


def vote_counts(votes: DataFrame, key: str) -> DataFrame:
    """(key, n_votes, n_distinct, top, n_tied, mean_confidence): of votes (key, category, confidence)."""
    each = votes.groupBy(key, "category").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"))
    w = each.groupBy(key).agg(F.sum("n").alias("n_votes"), F.count(F.lit(1)).alias("n_distinct"), F.max("n").alias("top"), F.sum("c").alias("c"), F.collect_list("n").alias("ns"))
    tied = F.size(F.filter("ns", lambda n: n == F.col("top"))).cast("long")
    return w.select(key, "n_votes", "n_distinct", "top", tied.alias("n_tied"), F.round(F.col("c") / F.col("n_votes"), 6).alias("mean_confidence"))


def category_scores(votes: DataFrame, boosts: DataFrame, key: str) -> DataFrame:
    """(key, winner, score, confidence) from votes (key, model, category, confidence) and boosts (key, rank, category, boost).

    A category's score is the sum of its votes' confidences and its boost. The first to be named wins ties: votes by model,
    then boosts by rank. Confidence is the mean of the winner's votes, 0.5 if it has none, at most 1. Other gets no boost and no
    score from votes."""
    v = votes.where(F.col("category") != OTHER).select(key, "category", F.col("confidence").alias("points"), F.struct(F.lit(0).alias("k"), F.col("model").cast("long").alias("at")).alias("named"), F.col("confidence"))
    b = boosts.where(F.col("category") != OTHER).select(key, "category", F.col("boost").alias("points"), F.struct(F.lit(1).alias("k"), F.col("rank").cast("long").alias("at")).alias("named"), F.lit(None).cast("double").alias("confidence"))
    sums = v.unionByName(b).groupBy(key, "category").agg(F.round(F.sum("points"), 6).alias("score"), F.min("named").alias("named"), F.avg("confidence").alias("c"))
    order = F.struct((-F.col("score")).alias("s"), "named")
    top = sums.groupBy(key).agg(F.min_by(F.struct("category", "score", "c"), order).alias("w"))
    return top.select(key, F.col("w.category").alias("winner"), F.col("w.score").alias("score"), F.round(F.least(F.lit(1.0), F.coalesce(F.col("w.c"), F.lit(0.5))), 6).alias("confidence"))


def decide(text: Column, has_metadata: Column, n_votes: Column, n_distinct: Column, n_tied: Column, mean: Column, winner: Column, confidence: Column, tries_left: Column) -> Column:
    """struct(category, confidence, retry): no text, no metadata or no vote is Other at 0.1; a tie with tries left is to be retried;
    a vague vote (mean under 0.3 and 70 % of the votes distinct) is Other at the mean; a tie without tries left is marked by *."""
    none = (F.coalesce(text, F.lit("")) == "") | ~has_metadata | (F.coalesce(n_votes, F.lit(0)) == 0)
    tie = n_tied > 1
    vague = (mean < 0.3) & (n_distinct >= 0.7 * n_votes)
    name = F.when(none, OTHER).when(vague, OTHER).when(tie, F.concat(F.lit("*"), winner)).otherwise(winner)
    return F.struct(name.alias("category"), F.when(none, 0.1).when(vague, mean).otherwise(confidence).alias("confidence"), (~none & tie & (tries_left > 0)).alias("retry"))


# Words that are added to a tied text before it is embedded again.
RETRY_WORDS = ["domain", "website", "site", "content", "page", "portal"]


def retry_text(text: Column, key: Column, attempt: int) -> Column:
    """The text with two different words, drawn by a hash of key and attempt."""
    words = F.array(*[F.lit(w) for w in RETRY_WORDS])
    h = F.pmod(F.xxhash64(key, F.lit(attempt)), F.lit(30)).cast("int")
    a, b = F.floor(h / 5).cast("int"), F.pmod(h, F.lit(5)).cast("int")
    return F.concat_ws(" ", text, F.get(words, a), F.get(words, F.when(b >= a, b + 1).otherwise(b)))


def to_english(label: Column, names: dict[str, str]) -> Column:
    """A label in its English name; a leading * stays."""
    bare = F.ltrim(label, F.lit("*"))
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.concat(F.when(F.startswith(label, F.lit("*")), "*").otherwise(""), F.coalesce(F.try_element_at(pairs, bare), bare))


def summary(df: DataFrame, category: str = "category", confidence: str = "confidence") -> DataFrame:
    """(category, n, pct, mean_confidence, n_high, conflict, vague) by category."""
    each = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(confidence), 6).alias("mean_confidence"), F.count_if(F.col(confidence) > 0.7).alias("n_high"))
    total = each.agg(F.sum("n").alias("total"))
    out = each.crossJoin(F.broadcast(total))
    return out.select(category, "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("pct"), "mean_confidence", "n_high", F.startswith(F.col(category), F.lit("*")).alias("conflict"), (F.col(category) == OTHER).alias("vague"))

