"""Sinks: Parquet overwrite and append with evolving columns, CSV and JSON exports, the text report."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Adds files; columns may differ from those there. Read with read_evolved()."""
    df.write.mode("append").parquet(path)


def read_evolved(spark, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Arrays are written as JSON."""
    flat = [F.to_json(c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_file(spark, path: str, data: str) -> None:
    """One file of any file system that Spark writes to, replacing what is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data.encode()))
    finally:
        out.close()


def _named(topics: DataFrame, most: int) -> list:
    rows = topics.orderBy("rank").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} topics")
    return rows


def export_json(topics: DataFrame, path: str, when: datetime, most: int = 10_000) -> None:
    """One object: when, how many topics there are, and each in order of rank. Over `most` topics are an error."""
    fields = ["topic_id", "name", "document_count", "keywords", "all_keywords"]
    rows = [{f: r[f] for f in fields} for r in _named(topics, most)]
    write_file(topics.sparkSession, path, json.dumps({"analysis_date": when.isoformat(), "total_categories": len(rows), "categories": rows}, indent=2))


def text_report(topics: DataFrame, path: str, when: datetime, most: int = 10_000) -> None:
    """The ranked report: a head, then three lines for each topic. Over `most` topics are an error."""
    rows = _named(topics, most)
    head = ["DISCOVERED DOMAIN CATEGORIES", "=" * 50, "", f"Analysis Date: {when:%Y-%m-%d %H:%M:%S}", f"Total Categories: {len(rows)}", ""]
    body = [x for r in rows for x in (f"{r['rank']:2d}. {r['name']}", f"     Documents: {r['document_count']:,}", f"     Keywords: {', '.join(r['keywords'])}", "")]
    write_file(topics.sparkSession, path, "\n".join([*head, *body, ""]))
