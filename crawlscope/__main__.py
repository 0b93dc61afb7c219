"""The command line: counts the domains of a corpus, or turns one into a table of records. Paths may be of any file system that Spark reads."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscope.functions.text import char_count
from crawlscope.operators import domains as D
from crawlscope.sources.readers import FLAT_SCHEMA, WARC_SCHEMA, read_jsonl
from crawlscope.sources.sinks import overwrite
from crawlscope.streaming.ingest import ingest_domain_counts


def count_domains(spark: SparkSession, source: str, out: str, warc: bool = False, glob: str | None = None) -> DataFrame:
    """Writes (domain, count) of all records at `source`, the commonest first; returns the totals."""
    url = "warc_headers.`warc-target-uri`" if warc else "u"
    lines = read_jsonl(spark, source, WARC_SCHEMA if warc else FLAT_SCHEMA, glob).select(F.col(url).alias("u"))
    overwrite(D.ranked(D.domain_counts(lines, "u")), out)
    return D.count_totals(spark.read.parquet(out))


def convert_records(spark: SparkSession, source: str, out: str, landing: bool = False, glob: str | None = None) -> DataFrame:
    """Writes the records at `source`, in canonical order with text_char_count, with `landing` those of landing pages alone; returns the
    statistics of their sizes. Lines that don't parse are left out."""
    lines = read_jsonl(spark, source, FLAT_SCHEMA, glob)
    rows = lines.where(F.coalesce(*[F.col(c).cast("string") for c in lines.columns]).isNotNull())
    rows = D.landing_pages(rows, "u") if landing else rows
    overwrite(D.in_canonical_order(rows.withColumn("text_char_count", char_count(rows))), out)
    return D.size_stats(spark.read.parquet(out).select("text_char_count"), "text_char_count")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="crawlscope", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("domains", "records"):
        command = commands.add_parser(name)
        command.add_argument("source")
        command.add_argument("out")
        command.add_argument("--glob")
    commands.choices["domains"].add_argument("--warc", action="store_true", help="WARC-style records")
    commands.choices["domains"].add_argument("--checkpoint", help="count only files that are new since the last run with this folder")
    commands.choices["records"].add_argument("--landing", action="store_true", help="landing pages alone")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("crawlscope").getOrCreate()
    if a.command == "records":
        convert_records(spark, a.source, a.out, a.landing, a.glob).show(truncate=False)
    elif a.checkpoint:
        url = "warc_headers.`warc-target-uri`" if a.warc else "u"
        ingest_domain_counts(spark, a.source, a.out, a.checkpoint, WARC_SCHEMA if a.warc else FLAT_SCHEMA, url, a.glob or "*.jsonl*")
        D.count_totals(spark.read.parquet(a.out)).show()
    else:
        count_domains(spark, a.source, a.out, a.warc, a.glob).show()


if __name__ == "__main__":
    main()
