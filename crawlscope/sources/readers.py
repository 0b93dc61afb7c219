"""Scans: JSON-Lines corpora under explicit schemas, file lists in order, line counts and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAIR = "struct<label:string,prob:double>"
_HEADERS = ("content-length", "warc-refers-to", "warc-identified-content-language", "warc-record-id", "content-type", "warc-target-uri", "warc-block-digest", "warc-date", "warc-type")
#: WARC-style records: the URL is warc_headers.`warc-target-uri`.
WARC_SCHEMA = (
    f"content string, warc_headers struct<{','.join(f'`{h}`:string' for h in _HEADERS)}>, metadata struct<identification:{_PAIR},harmful_pp:double,tlsh:string,"
    f"quality_warnings:array<string>,categories:array<string>,sentence_identifications:array<{_PAIR}>>"
)
#: Flat records: the URL is u. Column order is part of the format.
FLAT_SCHEMA = (
    "f string, o bigint, s bigint, rs bigint, u string, c string, ts string, collection string, lang array<string>, prob array<double>, text string, "
    "seg_langs array<string>, robotstxt string, id string, filter string, pii array<string>, doc_scores array<double>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str, glob: str | None = None) -> DataFrame:
    """JSON-Lines, plain or compressed by extension (gz, zst). Lines that don't parse become rows of nulls, which a later
    filter on the URL removes; a wrongly typed field nulls itself alone, so the result doesn't depend on the columns read."""
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE")
    return (reader.option("pathGlobFilter", glob) if glob else reader).json(path)


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines that are not blank, and those of them that are no JSON object."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    ok = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{") if hasattr(F, "try_parse_json") else F.trim("value").startswith("{")
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(~ok).alias("rejected"))


def files_in_order(spark: SparkSession, path: str, glob: str = "*", numeric: bool = False) -> DataFrame:
    """(path, name, bytes, position) of the files; by name, or by the number that a name starts with, others last."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    number = F.try_to_number(F.regexp_extract(name, r"^(\d+)\.", 1), F.lit("9" * 18)).cast("long") if numeric else F.lit(None).cast("long")
    rows = found.select("path", name.alias("name"), "bytes", number.alias("number"))
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct(F.col("number").isNull().alias("a"), "number", "name", "path", "bytes"))).alias("x"))
    return ordered.select(F.posexplode("x").alias("position", "r")).select("r.path", "r.name", "r.bytes", "position")


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("lines"))
