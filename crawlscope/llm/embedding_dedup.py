"""Embedding near-dedup: pivot-permutation index, inverted pivot lists, shared-pivot counts, exact cosine."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import connected_components, forest, in_blocks, save, slices


def pivot_count(n_vectors: int, least: int = 64, most: int = 32_768) -> int:
    """Reference points for so many vectors: they grow with the root of the number, and so do the lists; both the search for the nearest
    ones and the pairs that meet in lists then grow as its power 1.5. `most` bounds what workers are sent."""
    return min(n_vectors, most, max(least, 4 * math.isqrt(n_vectors)))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of an Arrow column of lists."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)


def embedding_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    emb_col: str = "embedding",
    label_col: str = "label",
    min_cos: float = 0.98,
    n_pivots: int | None = None,
    n_near: int = 12,
    min_shared: int = 4,
    block: int = 512,
) -> DataFrame:
    """(id, n_links, component, kept) for each row: other vectors of the same label at cosine min_cos or more.

    Reference points are n_pivots vectors, a bounded sample by hash; their number follows that of the vectors (pivot_count()). Each
    vector is described by its n_near nearest ones in order, and two are candidates if they share min_shared or more. Of two such sets,
    the n_near - min_shared + 1 pivots that the fewest vectors are near to always have one in common, so each vector enters
    the inverted lists of those alone. Lists hold keys and pivots; shared pivots are counted there, in blocks, and only members that
    have a candidate are met by their vectors and verified by the cosine in double precision, in the list of the
    first pivot that a pair shares. Lists longer than `block` are dealt as pairs of blocks, so every pair of a list still meets.
    Cells return counts and a spanning forest, never all pairs. All vectors are indexed. Recall against all pairs is measured in
    tests/llm, for cosines from min_cos on.

    Equal vectors of a label are one member with a weight. Vectors that are null, empty, zero or hold null or
    non-finite components, or whose label is null, link with nothing. Vectors of different lengths don't compare.
    Rows that repeat an id are vectors of their own; a null id never names a component, and is not kept. An empty table gives no rows.
    Building the result runs jobs.
    """
    emb = F.col(emb_col).cast("array<double>")
    good = F.exists(emb, lambda x: x != 0) & F.forall(emb, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col(label_col).isNotNull()
    # +0.0 makes negative zeros equal to zeros. Two 64-bit hashes of unlike seeds are the key.
    plain = F.transform(emb, lambda x: x + F.lit(0.0))
    label = F.col(label_col).cast("string")
    key = F.concat(F.hex(F.xxhash64(F.lit(1), label, plain)), F.lit("-"), F.hex(F.xxhash64(F.lit(2), label, plain)))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(good, key).alias("key"), label.alias("label"), emb.alias("emb"))
    kind = rows.schema["id"].dataType.simpleString()
    reps = rows.where(F.col("key").isNotNull()).groupBy("key")
    reps = save(reps.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("emb").alias("emb")), "vectors")
    n_pivots = n_pivots or pivot_count(reps.count())
    pivots = [np.array(r["emb"]) for r in reps.select("key", "emb").orderBy("key").limit(n_pivots).collect()]

    def nearest(emb: np.ndarray) -> np.ndarray:
        p = np.array([np.pad(x[: emb.shape[1]], (0, max(0, emb.shape[1] - len(x)))) for x in pivots])
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300)
        k = min(n_near, len(p))
        sims = np.round(emb @ p.T, 12)
        pick = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(p) else np.tile(np.arange(k), (len(emb), 1))
        return np.take_along_axis(pick, np.lexsort((pick, -np.take_along_axis(sims, pick, 1)), axis=1), 1)

    def describe(batches):
        for x in slices(batches, 2048):
            size, values = _matrix(x.column("emb"))
            begin = np.cumsum(size) - size
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                e = values[begin[at][:, None] + np.arange(d)].astype(float)
                e /= np.abs(e).max(axis=1, keepdims=True)  # first scaled, so that no square overflows
                e /= np.linalg.norm(e, axis=1, keepdims=True)
                pick = nearest(e).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, pick.size + 1, pick.shape[1]), pa.int32()), pa.array(pick.ravel()))
                place = pa.array(at)
                yield pa.RecordBatch.from_arrays([x.column("key").take(place), x.column("label").take(place), pa.array(np.full(len(at), d, np.int32)), lists], ["key", "label", "size", "near"])

    described = save(reps.select("key", "label", "emb").mapInArrow(describe, "key string, label string, size int, near array<int>"), "vector-pivots")
    # How many vectors each pivot is near to: as many numbers as pivots.
    often = dict(described.select(F.explode("near").alias("pivot")).groupBy("pivot").count().collect())
    rank = np.zeros(max(1, len(pivots)), np.int64)
    rank[sorted(range(len(pivots)), key=lambda q: (often.get(q, 0), q))] = np.arange(len(pivots))

    def enter(batches):
        for x in slices(batches, 4096):
            size, near = _matrix(x.column("near"))
            k = int(size[0])
            ranked = np.sort(rank[near.reshape(-1, k)], axis=1).astype(np.int32)  # the rarest pivots first
            n_lists = max(1, k - min_shared + 1)
            place = pa.array(np.repeat(np.arange(len(ranked)), n_lists))
            sets = pa.ListArray.from_arrays(pa.array(np.arange(0, ranked.size + 1, k), pa.int32()), pa.array(ranked.ravel()))
            yield pa.RecordBatch.from_arrays([*(x.column(c).take(place) for c in ("key", "label", "size")), pa.array(ranked[:, :n_lists].ravel()), sets.take(place)], ["key", "label", "size", "pivot", "near"])

    lists = described.mapInArrow(enter, "key string, label string, size int, pivot int, near array<int>").select("key", F.xxhash64("label", "size", "pivot").alias("list"), "pivot", "near")
    cells = in_blocks(lists, "list", "key", block)

    def candidates(near: np.ndarray, pivot: int, side: np.ndarray, apart: bool) -> np.ndarray:
        """Which members of a cell share enough pivots; a pair counts in the list of the first that it shares."""
        names, col = np.unique(near, return_inverse=True)
        mark = np.zeros((len(near), len(names)), np.float32)
        mark[np.arange(len(near))[:, None], col.reshape(near.shape)] = 1
        close = mark @ mark.T >= min(min_shared, near.shape[1])
        if close.sum() > len(near):
            earlier = mark[:, names < pivot]
            close &= earlier @ earlier.T == 0
        np.fill_diagonal(close, False)
        return close & (side[:, None] != side[None, :]) if apart else close

    def cells_of(x: pa.RecordBatch):
        """(its members' places in the flattened column m, whether only unlike sides meet, pivot, nears, sides) of each cell; and the column."""
        lists = x.column("m")
        m, ends = lists.flatten(), np.cumsum(np.diff(lists.offsets.to_numpy()))
        size, near = _matrix(m.field("near"))
        near, side, pivot = near.reshape(len(m), -1), m.field("side").to_numpy(), m.field("pivot").to_numpy()
        apart = x.column("i").to_numpy() != x.column("j").to_numpy()
        each = ((np.arange(b - n, b), a, int(pivot[b - 1]), near[b - n : b], side[b - n : b]) for a, b, n in zip(apart, ends.tolist(), np.diff(np.append(0, ends)).tolist(), strict=True))
        return m, each

    def count(batches):
        for x in slices(batches, 256):
            m, each = cells_of(x)
            cell, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, (at, apart, pivot, near, side) in enumerate(each):
                hit = at[candidates(near, pivot, side, apart).any(axis=1)]
                cell.append(np.full(len(hit), k))
                place.append(hit)
            cell, place = pa.array(np.concatenate(cell)), pa.array(np.concatenate(place))
            names = ["key", "pivot", "near", "side"]
            yield pa.RecordBatch.from_arrays([*(x.column(c).take(cell) for c in ("list", "i", "j")), *(m.field(c).take(place) for c in names)], ["list", "i", "j", *names])

    member = F.struct("key", "pivot", "near", "side")
    cells = cells.groupBy("list", "i", "j").agg(F.collect_list(member).alias("m")).where(F.size("m") > 1)
    few = cells.mapInArrow(count, "list long, i int, j int, key string, pivot int, near array<int>, side int")
    facts = reps.select("key", "n", F.col("least").cast("string").alias("least"), "emb")
    member = F.struct("key", "pivot", "near", "side", "n", "least", "emb")
    met = few.join(facts, "key").groupBy("list", "i", "j").agg(F.array_sort(F.collect_list(member)).alias("m"))

    def verify(batches):
        for x in slices(batches, 64):
            m, each = cells_of(x)
            size, values = _matrix(m.field("emb"))
            begin = np.cumsum(size) - size
            key, least, n = (m.field(c).to_numpy(zero_copy_only=False) for c in ("key", "least", "n"))
            out = []
            for at, apart, pivot, near, side in each:
                e = values[begin[at][:, None] + np.arange(size[at[0]])].astype(float)
                e /= np.abs(e).max(axis=1, keepdims=True)
                e /= np.linalg.norm(e, axis=1, keepdims=True)
                close = candidates(near, pivot, side, apart) & (e @ e.T >= min_cos)
                links, other = close @ n[at], np.full(len(at), -1)
                for p, c in zip(*forest(close), strict=True):
                    other[c] = at[p]
                out += [(key[a], least[a], k, *((key[o], least[o]) if o >= 0 else (None, None))) for a, k, o in zip(at.tolist(), links.tolist(), other.tolist(), strict=True) if k]
            yield pd.DataFrame(out, columns=["key", "least", "links", "other", "other_least"])

    target = pa.schema([("key", pa.string()), ("least", pa.string()), ("links", pa.int64()), ("other", pa.string()), ("other_least", pa.string())])
    to_arrow = lambda batches: (pa.RecordBatch.from_pandas(x, schema=target, preserve_index=False) for x in verify(batches))
    found = save(met.mapInArrow(to_arrow, "key string, least string, links long, other string, other_least string"), "vector-links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    # A vector's name begins with its least id, so the least name of a component has the least id; null ids come last.
    name = lambda i, k: F.struct(F.col(i).isNull().alias("z"), F.col(i).cast(kind).alias("id"), F.col(k).alias("key"))
    comps = connected_components(found.where(F.col("other").isNotNull()).select(name("least", "key").alias("a"), name("other_least", "other").alias("b")), "vector-components")
    comps = comps.select(F.col("node.key").alias("key"), F.col("component.id").alias("name"))
    facts = reps.select("key", "n", "least").join(comps, "key", "left").join(links, "key", "left")
    facts = facts.select("key", "n", F.coalesce("name", "least").alias("name"), F.coalesce("links", F.lit(0)).alias("links"))
    out = rows.select("id", "key").join(facts, "key", "left")
    comp = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("name"))
    return out.select(
        "id", F.coalesce(F.col("n") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"), comp.alias("component"), F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept")
    )


def op2_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return embedding_groups(vectors).select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


ORACLE = {
    "op2_embedding_near_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach(vec_id, c) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.vec_id),
comp AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM comp c LEFT JOIN deg d ON c.vec_id = d.a
"""
}
QUERIES = {"op2_embedding_near_dedup": op2_embedding_near_dedup}
