"""What several operators share: tables in the shared folder, frames of a few rows in workers, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The ASCII white space of the text contracts, as one string of characters.
ASCII_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: By application, the folder that stands in for the cluster's where none is named; and the tables that save() has written.
_OWN_DIR: dict[str, str] = {}
_SAVED: list[DataFrame] = []
#: Whether the shuffle files of an execution go when it ends, and not when the driver's memory is next collected.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: spark.checkpoint.dir. Where it is unset, a local master (as in tests) gets
    a temporary one; on a cluster that is an error, as no other machine would see what one of them writes there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIR:
            _OWN_DIR[app] = f"file://{tempfile.mkdtemp(prefix='crawlscope-')}"
        found = _OWN_DIR[app]
    return found.rstrip("/")


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors.

    The table is deleted by discard(), at the end of the scratch() that it was written in, or when the driver exits. The shuffle files
    of writing it, which nothing reads again, are deleted at once, so disk doesn't depend on when memory is collected.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    _SAVED.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by save() that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _SAVED[:] = [x for x in _SAVED if x is not df]


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end the tables that save() wrote inside: for callers that have written the result by then."""
    before = set(map(id, _SAVED))
    try:
        yield
    finally:
        for df in [x for x in _SAVED if id(x) not in before]:
            discard(df)


@atexit.register
def _discard_all() -> None:
    for df in list(_SAVED):
        with contextlib.suppress(Exception):  # the session may be gone
            discard(df)


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into ones of at most `rows` rows, and of some `size` bytes where single rows allow it.

    Batches reach a worker bounded by the session (64 MB unless set otherwise); what an operator makes of them, often many times
    larger, is bounded here, so that operators whose plans run together don't share one setting.
    """
    for b in batches:
        step = max(1, min(rows, int(b.num_rows * size / max(b.nbytes, 1))))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def map_slices(df: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = 256) -> DataFrame:
    """df.mapInPandas(work, schema), but the frames have at most `rows` rows; see slices()."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for out in work(part.to_pandas() for part in slices(batches, rows)):
            yield pa.RecordBatch.from_pandas(out, schema=target, preserve_index=False)

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Give freed memory back to the system, where the C library can: workers live on between stages."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone. An all-ASCII text takes the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def crc32_of_id(c: Column) -> Column:
    """CRC-32 of an id written as text."""
    return F.crc32(c.cast("string").cast("binary"))


def connected_components(edges: DataFrame, tag: str = "components", max_rounds: int = 60) -> DataFrame:
    """(a, b) links to (node, component): the least node that is reachable. Nodes without links don't appear.

    Alternates large-star and small-star steps (Kiveris et al. 2014) over tables in the shared folder until
    nothing changes. All steps are aggregations with map-side combine and equi-joins, so a node with very
    many links is split by adaptive execution; nothing goes to the driver but a count and a checksum.
    """
    a, b = F.col("a"), F.col("b")
    now = save(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(a < b).distinct(), tag)
    seen = None
    for _ in range(max_rounds):
        # In whichever order the files are read, count and sum of the hashes name the set of links.
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(a, b).cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(b > a).join(least, "a").select(F.col("m").alias("a"), b).where(a < b).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").where(a > F.col("m")).select(F.col("m").alias("a"), a.alias("b"))
        after = save(small.unionByName(low.select(F.col("m").alias("a"), b)).distinct(), tag)
        discard(now)
        now = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    # At the fixed point each link leads from the least node of a component to another of its nodes.
    return now.select(b.alias("node"), a.alias("component")).unionByName(now.select(a.alias("node"), a.alias("component")).distinct())


def least_by(rows: DataFrame, key: str, value: str, tag: str = "least") -> DataFrame:
    """(key, least): the least value of each key, from map-side combine. As a written table its true size decides how it
    is joined, and rows of a key that holds a third of them all are split in that join."""
    return save(rows.groupBy(key).agg(F.min(value).alias("least")), tag)


def in_blocks(members: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """members dealt to cells (key, i, j) so that any two members of a key meet in one cell, and none has many more than
    2 * block members; adds i, j and side (0: of block i, 1: of block j; cells with i = j have side 0 alone).

    A key with n members falls into ceil(n / block) blocks by the hash of the member. Small keys stay one cell.
    """
    sizes = save(members.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("n_blocks")), "block-sizes")
    met = members.join(sizes, key).withColumn("own", F.pmod(F.xxhash64(F.lit(17), F.col(member)), F.col("n_blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    own, other = F.col("own"), F.col("other")
    return met.select(*members.columns, F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), (own > other).cast("int").alias("side"))


def forest(close: np.ndarray) -> tuple[list[int], list[int]]:
    """(parent, child) pairs of a breadth-first spanning forest of a symmetric boolean matrix."""
    left = np.ones(len(close), bool)
    parents, children = [], []
    for i in range(len(close)):
        if left[i]:
            left[i] = False
            front = [i]
            while front:
                p = front.pop()
                new = np.flatnonzero(close[p] & left)
                left[new] = False
                front += new.tolist()
                parents += [p] * len(new)
                children += new.tolist()
    return parents, children


def jaccard_links(cells: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect the members of each cell as all its pairs of sets at Jaccard `similarity` or more do.

    cells: those of in_blocks(), i, j and m, a list of (h, side, set); members of unlike sides alone are compared where i differs from j.
    """

    def verify(batches):
        for x in batches:
            a, b = [], []
            for i, j, m in zip(x["i"], x["j"], x["m"], strict=True):
                m = sorted(m, key=lambda r: r["h"])
                h = np.array([r["h"] for r in m])
                side = np.array([r["side"] for r in m])
                size = np.array([len(r["set"]) for r in m])
                vocabulary, col = np.unique(np.concatenate([r["set"] for r in m]), return_inverse=True)
                row = np.repeat(np.arange(len(m)), size)
                both = np.zeros((len(m), len(m)), np.float32)
                for lo in range(0, len(vocabulary), 4096):
                    mark = np.zeros((len(m), min(4096, len(vocabulary) - lo)), np.float32)
                    here = (col >= lo) & (col < lo + 4096)
                    mark[row[here], col[here] - lo] = 1
                    both += mark @ mark.T
                close = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-6
                np.fill_diagonal(close, False)
                if i != j:
                    close &= side[:, None] != side[None, :]
                p, c = forest(close)
                a += h[p].tolist()
                b += h[c].tolist()
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return map_slices(cells.select("i", "j", "m"), verify, "a long, b long", rows=8)  # a cell has up to two blocks of sets
