import os

import duckdb
import pytest

from crawlscope.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def shown(df):
    rows = [[None if isinstance(x, float) and x != x else round(x, 6) if isinstance(x, float) else x for x in r] for r in df]
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [[r[c] for c in cols] for r in df.collect()]
    assert len(df.columns) == len(set(df.columns))
    if name in ORACLE:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        cur = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})")
        assert shown(rows) == shown(cur.fetchall())


# Titles cut within an entity, names that only begin like one, entities of entities, and a title with none.
TITLES = ["of the&amp;&amp;&amp", "ver&am", "a &ampfoo; b &notit; c&lt", "&amp;lt;x&amp;amp", "a&nbsp;b&nbsp;", "R&D &quot;x&quot; &#39;y&#39;", "plain", ""]


@pytest.mark.parametrize("name", ["label_texts", "llm_labels", "metadata_extract", "page_titles", "text_features"])
def test_titles_cut_within_entities(spark, tmp_path, name):
    pages = [(i, f"https://www.site{i}.gr/p/{i}?q=1", f"<html><head><title>{t}</title></head><body>x &amp y</body></html>") for i, t in enumerate(TITLES)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert shown([[r[c] for c in cols] for r in df.collect()]) == shown(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall())


def test_topic_terms_are_dealt_evenly_and_counted_once(spark, tmp_path):
    # Documents that have a vector stand in the first of several files.
    spark.range(400).selectExpr("id AS vec_id", "transform(sequence(0, 7), i -> CAST(sin(id * (i + 1)) AS FLOAT)) AS embedding").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(2000).selectExpr("id AS doc_id", "concat_ws(' ', 'word', substr('abcdefgh', id % 7 + 1, 2), 'term') AS text").repartitionByRange(5, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["topic_discovery"](spark, str(tmp_path))
    assert 0 < sum(r.document_count for r in df.collect()) <= 400
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert final.count("posexplode") == 1 and "REPARTITION_BY_NUM" in final


def test_the_rest_lives_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "crawlscope"), tmp_path / "crawlscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'domain_counts' in e.queries() and not any(k[:2] == 'op' for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
