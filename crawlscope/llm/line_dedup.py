"""Line dedup: lines that many documents hold stay only in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import ASCII_SPACE, ascii_lower, save


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _stripped(line: Column) -> Column:
    """The line without ASCII white space at its ends; the usual line, where only spaces can stand there, takes a fast path."""
    rare = [F.contains(line, F.lit(c)) for c in ASCII_SPACE if c not in " \n"]
    return F.when(rare[0] | rare[1] | rare[2] | rare[3], F.btrim(line, F.lit(ASCII_SPACE))).otherwise(F.trim(line))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop repeated lines; returns the columns of docs with the kept text, and n_lines, n_dropped (long).

    Lines are what \\n separates. Their key has ASCII white space stripped at both ends and A-Z lower-cased. A key
    of at least min_chars code points found in at least min_docs documents loses all its lines but those in the
    document with the largest id. Exploded lines travel as 128-bit hashes with the id and a hash of the text,
    never as text; the positions to drop come back as one array for each document, and each text crosses the
    network once, to meet its array. Very common lines are counted with map-side combine, and the join on their
    hash is one that adaptive execution splits.

    Null text counts as empty: one empty line. Rows that repeat an id are one document for the count, and each is
    rebuilt from its own text. Rows without an id hold no line for the count, never are the largest, and lose the
    lines that others share. A document that loses every line keeps an empty text. Columns of docs named n_lines
    or n_dropped are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    src = docs.select(F.struct(*rest).alias("row"), F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("th"))

    # Two transforms, so that each stripped line is made once; outer, so that no filter evaluates the array again.
    keys = F.transform(F.transform(_lines(F.col("text")), _stripped), lambda x: F.when(F.char_length(x) >= min_chars, F.unhex(F.md5(ascii_lower(x)))))
    lines = src.select("id", "th", F.posexplode_outer(keys).alias("pos", "h")).where(F.col("h").isNotNull())
    # As a table of its own, its true size decides how it is joined, and adaptive execution can split a hot hash.
    hot = save(lines.groupBy("h").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs).select("h", "keep"), "hot-lines")
    drop = (
        lines.join(hot, "h")
        .where(~F.col("id").eqNullSafe(F.col("keep")))
        .groupBy(F.col("id").alias("drop_id"), F.col("th").alias("drop_th"))
        .agg(F.array_sort(F.collect_set("pos")).alias("at"))
    )
    met = src.join(drop, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("th") == F.col("drop_th")), "left")
    # Flags up to the last dropped line, made from the gaps between dropped positions, so in linear time.
    before = F.slice(F.concat(F.array(F.lit(-1)), F.col("at")), 1, F.size("at"))
    flags = F.flatten(F.zip_with("at", before, lambda x, p: F.concat(F.array_repeat(F.lit(False), x - p - 1), F.array(F.lit(True)))))
    kept = F.array_join(F.zip_with(_lines(F.col("text")), "flags", lambda x, f: F.when(F.coalesce(f, F.lit(False)), F.lit(None)).otherwise(x)), "\n")
    out = met.withColumn("flags", F.when(F.col("at").isNotNull(), flags)).select(
        "row",
        F.when(F.col("at").isNull(), F.col("text")).otherwise(kept).alias("kept"),
        F.size(_lines(F.col("text"))).cast("long").alias("lines"),
        F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("dropped"),
    )
    made = {text_col: F.col("kept"), "n_lines": F.col("lines"), "n_dropped": F.col("dropped")}
    low = {k.lower() for k in made}
    cols = [made[c].alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c == text_col or c.lower() not in low]
    return out.select(*cols, F.col("lines").alias("n_lines"), F.col("dropped").alias("n_dropped"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hot AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (h.key IS NOT NULL AND k.doc_id <> h.keep) AS bad
  FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(bad AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
QUERIES = {"op1_line_dedup": op1_line_dedup}
