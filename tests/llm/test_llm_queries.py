"""The registered queries on the given tables: against DuckDB where SQL can say it, else held-out accuracy and invariants."""

import hashlib
import os
from collections import Counter
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import brute_lines, brute_shingles, components

import corpus_pipeline
from crawlscope.llm import mixing, pieces, registry

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(repr, want))


def test_every_operator_has_a_query():
    assert {int(k[2:].split("_")[0]) for k in registry.queries()} == set(range(1, 11))


def test_language_held_out(spark):
    got = registry.queries()["op10_language_id"](spark, LARGER).join(spark.read.parquet(f"{LARGER}/documents.parquet"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_quality_held_out(spark):
    got = registry.queries()["op8_quality_classifier"](spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.97


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    good, lines, near, mixed, tokens = kept
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert good.join(labels.where("quality = 0"), "doc_id").count() <= 1 and good.join(labels.where("quality = 1"), "doc_id").count() == labels.where("quality = 1").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").count()
    assert lines.count() == good.count() and lines.where("n_chars <> char_length(text)").count() == 0
    # The stage's rule is Jaccard over five words, not the query's two bits over three: all pairs of texts tell the groups.
    sets = {r.doc_id: brute_shingles(r.text) for r in lines.select("doc_id", "text").collect()}
    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sorted(r.doc_id for r in near.select("doc_id").collect()) == sorted(set(components(sets, pairs).values()))
    ids = {r[0] for r in near.select("doc_id").collect()}
    assert {r[0] for r in mixed.select("doc_id").distinct().collect()} <= ids
    assert tokens.where("NOT exact").count() == 0
    assert tokens.where("sample = 0").count() == mixed.count()


def test_pipeline_run(spark, tmp_path):
    """run() against plain Python from the second stage on: lines, near copies, Poisson counts, texts that the pieces spell."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = [tuple(r) for r in corpus_pipeline.quality_classifier(spark, docs, SF).select("doc_id", "text", "source").collect()]
    source = {i: s for i, _, s in good}
    texts = {int(i): t for i, t in brute_lines([(i, t) for i, t, _ in good])}
    sets = {i: brute_shingles(t) for i, t in texts.items()}
    near = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = sorted(set(components(sets, near).values()))
    sizes = Counter(source[i] for i in kept)
    copies = {i: mixing.poisson_count((int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52, len(kept) / len(sizes) / sizes[source[i]]) for i in kept}
    got = corpus_pipeline.run(spark, SF)
    found = Counter((r.doc_id, r.sample) for r in got.select("doc_id", "sample").collect())
    assert {i: n for (i, k), n in found.items() if k == 0} == {i: n for i, n in copies.items() if n}
    assert all(found[i, 0] >= found[i, 1] for i in kept)
    told = pieces.decode_pieces(got.select("doc_id", "ids")).distinct().select("doc_id", "text").distinct().collect()
    assert {r.doc_id: r.text for r in told} == {i: texts[i] for i in kept if copies[i]} and len(told) == sum(n > 0 for n in copies.values())
