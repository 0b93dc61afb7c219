import gzip
import json
import time
from datetime import datetime

import pytest
import zstandard
from pyspark.sql import functions as F

from crawlscope.__main__ import main
from crawlscope.operators import domains as D
from crawlscope.sources.providers import Pace, ask_with_retry, fetch_pages, load_models
from crawlscope.sources.readers import FLAT_SCHEMA, files_in_order, line_counts, read_jsonl, rejected_lines
from crawlscope.sources.sinks import append, export_csv, export_json, overwrite, read_evolved, text_report
from crawlscope.streaming.ingest import ingest_domain_counts, process_once

LINES = '{"u":"http://a.gr/x"}\n{bad json\n[1,2]\n"str"\n\n{"u":5}\n{"u":null}\n{"u":"http://a.gr/","lang":3}\n{"text":"t"}\n{"u":"http://www.b.gr"}'


def test_bad_lines_are_skipped(spark, tmp_path):
    (tmp_path / "1.jsonl").write_text(LINES)
    with gzip.open(tmp_path / "2.jsonl.gz", "wt") as f:
        f.write('{"u":"http://b.gr"}\n')
    df = read_jsonl(spark, str(tmp_path), FLAT_SCHEMA, "*.jsonl*")
    assert {r["domain"]: r["count"] for r in D.domain_counts(df, "u").collect()} == {"a.gr": 2, "b.gr": 2}
    assert D.count_totals(D.domain_counts(df, "u")).first()[:] == (2, 4)
    assert sorted(r.lines for r in line_counts(spark, str(tmp_path)).collect()) == [1, 10]


def test_numeric_order(spark, tmp_path):
    for n in ("10.jsonl", "2.jsonl", "x.jsonl"):
        (tmp_path / n).write_text("{}\n")
    got = files_in_order(spark, str(tmp_path), "*.jsonl", numeric=True).orderBy("position").collect()
    assert [r.name for r in got] == ["2.jsonl", "10.jsonl", "x.jsonl"]


def test_ingestion_counts_each_file_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    (src / "1.jsonl").write_text('{"u":"http://a.gr"}\n')
    counts = lambda: {r["domain"]: r["count"] for r in spark.read.parquet(str(out)).collect()}
    ingest_domain_counts(spark, str(src), str(out), str(ck))
    assert counts() == {"a.gr": 1}
    (src / "2.jsonl").write_text('{"u":"http://a.gr"}\n{"u":"http://b.gr"}\n')
    for _ in range(2):
        ingest_domain_counts(spark, str(src), str(out), str(ck))
        assert counts() == {"a.gr": 2, "b.gr": 1}


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "t")
    overwrite(spark.range(2).select(F.col("id").alias("a")), p)
    append(spark.range(1).select(F.col("id").alias("b")), p)
    assert read_evolved(spark, p).count() == 3
    assert set(read_evolved(spark, p).columns) == {"a", "b"}
    export_csv(spark.createDataFrame([(1, ["x", "y"])], "i int, k array<string>"), str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().i == "1"


def test_fetch_ladder(spark):
    def fetcher(url):
        if url.startswith("https://b"):
            raise OSError
        if "c.gr" in url:
            raise TimeoutError
        return 200, url, 0, "x"

    got = {r.domain: (r.asked, r.status_code, r.error) for r in fetch_pages(spark.createDataFrame([("a.gr",), ("b.gr",), ("c.gr",), (None,), ("a.gr",)], "domain string"), fetcher, delay=None).collect()}
    assert got == {"a.gr": ("https://a.gr", 200, None), "b.gr": ("http://b.gr", 200, None), "c.gr": ("http://c.gr", None, "Timeout")}


def test_retry_waits():
    waits, tries = [], iter([RuntimeError("Quota"), RuntimeError("x"), None])

    def client(_):
        e = next(tries)
        if e:
            raise e
        return "ok"

    assert ask_with_retry(client, "p", sleep=waits.append) == "ok"
    assert waits == [5, 1]


def test_command_line(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "1.jsonl").write_text(LINES + '\n{"u":"http://c.gr/home","text":"four"}\n{"u":"http://c.gr/other"}\n')
    main(["domains", str(src), out])
    want = {"a.gr": 2, "b.gr": 1, "c.gr": 2}
    assert {r["domain"]: r["count"] for r in spark.read.parquet(out).collect()} == want
    for _ in range(2):
        main(["domains", str(src), out, "--checkpoint", str(tmp_path / "ck")])
        assert {r["domain"]: r["count"] for r in spark.read.parquet(out).collect()} == want
    (src / "w.zz").write_text('{"warc_headers":{"warc-target-uri":"http://www.d.gr/x"}}\n{"warc_headers":null}\n')
    main(["domains", str(src), out, "--warc", "--glob", "*.zz"])
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [("d.gr", 1)]
    main(["records", str(src), out, "--glob", "*.jsonl", "--landing"])
    got = spark.read.parquet(out)
    assert got.columns[:3] == ["f", "o", "s"] and got.columns[-1] == "text_char_count"
    assert {(r.u, r.text_char_count) for r in got.collect()} == {("http://a.gr/", 0), ("http://www.b.gr", 0), ("http://c.gr/home", 4)}


def test_requests_overlap(spark):
    def fetcher(url):
        time.sleep(0.2)
        return 200, url, 0, "x"

    df = spark.createDataFrame([(f"d{i}.gr",) for i in range(60)], "domain string").coalesce(1)
    seconds = {}
    for n in (1, 20):
        fetch_pages(df.limit(1), fetcher, partitions=1, in_flight=n, delay=None).collect()
        began = time.perf_counter()
        assert fetch_pages(df, fetcher, partitions=1, in_flight=n, delay=None).count() == 60
        seconds[n] = time.perf_counter() - began
    assert seconds[1] > 8 * seconds[20] - 6 and seconds[20] < 5 < 12 <= seconds[1]


def test_strict_ladder_and_error_classes(spark):
    def fetcher(url):
        if "c.gr" in url:
            raise ValueError
        return (200 if url.startswith("http://www.") and "a.gr" in url else 404), url + "/", 1, "page"

    ladder = lambda d: [p + d for p in ("https://", "http://", "https://www.", "http://www.")]
    df = spark.createDataFrame([("a.gr",), ("b.gr",), ("c.gr",)], "domain string")
    got = {r.domain: (r.asked, r.status_code, r.error, r.html) for r in fetch_pages(df, fetcher, ladder, accept=lambda s: s == 200, delay=None).collect()}
    assert got == {"a.gr": ("http://www.a.gr", 200, None, "page"), "b.gr": ("http://www.b.gr", 404, "Status", None), "c.gr": ("http://www.c.gr", None, "Other", None)}


def test_pace():
    waits = []
    pace = Pace(0.1, sleep=waits.append)
    for status in (429, 200, 404):
        pace.wait()
        pace.saw(status)
    for _ in range(20):
        pace.saw(429)
    pace.wait()
    assert [round(w, 6) for w in waits] == [0.1, 0.15, 0.1425, 2.0]


def test_model_chains():
    def broken():
        raise OSError("no file")

    assert load_models({"a": [broken, lambda: 1], "b": [broken]}) == {"a": 1}
    with pytest.raises(RuntimeError, match="b: no file"):
        load_models({"b": [broken]})


def test_reports(spark, tmp_path):
    rows = [(3, "Mixed Content", 1200, ["a", "b"], ["a", "b", "c"], 1), (5, "Data Related", 7, [], [], 2)]
    topics = spark.createDataFrame(rows, "topic_id int, name string, document_count long, keywords array<string>, all_keywords array<string>, rank int")
    when = datetime(2024, 5, 6, 7, 8, 9)
    export_json(topics, str(tmp_path / "t.json"), when)
    got = json.loads((tmp_path / "t.json").read_text())
    assert got["analysis_date"] == "2024-05-06T07:08:09" and got["total_categories"] == 2 and got["categories"][0] == {"topic_id": 3, "name": "Mixed Content", "document_count": 1200, "keywords": ["a", "b"], "all_keywords": ["a", "b", "c"]}
    text_report(topics, str(tmp_path / "t.txt"), when)
    assert (tmp_path / "t.txt").read_text().split("\n")[3:9] == ["Analysis Date: 2024-05-06 07:08:09", "Total Categories: 2", "", " 1. Mixed Content", "     Documents: 1,200", "     Keywords: a, b"]
    with pytest.raises(ValueError):
        text_report(topics, str(tmp_path / "t.txt"), when, most=1)


def test_zstandard_and_rejected_lines(spark, tmp_path):
    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.compress(LINES.encode()))
    assert D.count_totals(D.domain_counts(read_jsonl(spark, str(tmp_path), FLAT_SCHEMA, "*.zst"), "u")).first()[:] == (2, 3)
    (tmp_path / "b.txt").write_text(LINES)
    assert rejected_lines(spark, str(tmp_path / "b.txt")).first()[:] == (9, 3)
    assert files_in_order(spark, str(tmp_path), "*.txt").first().bytes == len(LINES)


def test_each_new_table_is_processed_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for k in range(2):
        spark.range(3).select((F.col("id") + 10 * k).alias("a")).write.mode("append").parquet(src)
        for _ in range(2):
            process_once(spark, src, "a long", lambda df: df.withColumn("b", F.col("a") + 1), out, ck)
        assert spark.read.parquet(out).count() == 3 * (k + 1)
