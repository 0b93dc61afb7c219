"""SimHash near-dedup: segment-popcount embedding, grid range-join, exact check."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import connected_components, in_blocks, jaccard_links, least_by, map_slices, save

#: Bit b of each byte value, the high bit first: fixed by the layout of a big-endian digest.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)

#: MinHash bands, and rows of each, that find near copies: at Jaccard 0.8 a pair meets with a chance of 1 - (1 - 0.8**4)**14 = 0.9994.
BANDS, ROWS = 14, 4
_SEEDS = np.random.default_rng(64).integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text as a signed integer; see simhash_groups()."""
    toks = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not toks:
        return 0
    digest, n = xxhash.xxh64_digest, max(1, len(toks) - words + 1)
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, n, 1 << 16):  # in blocks: memory stays bounded on very long texts
        part = toks[at : at + (1 << 16) + words - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if n > 1 or len(toks) >= words else [b" ".join(part)]
        h = np.frombuffer(b"".join([digest(g, seed) for g in grams]), np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[k] += np.bincount(h[:, k], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(ones.reshape(64) * 2 > n).tobytes(), "big", signed=True)


def row_key(id_col: str, text_col: str) -> Column:
    """Equal for rows of equal id and text, and only for them."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("|"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    def run(batches):
        for x in batches:
            yield pd.DataFrame({"id": x["id"], "row_key": x["row_key"], "fp": [fingerprint(t, words) for t in x["text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    # A null id must not turn a batch of integers into floats on its way through pandas.
    ids = docs.select(F.col(id_col).cast("string").alias("id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return map_slices(ids, run, "id string, row_key string, fp long").select(F.col("id").cast(kind).alias("id"), "row_key", "fp")


def _bits(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, max_bits: int = 2, large: int = 256) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs at max_bits (0 to 2) or fewer differing bits do.

    A fingerprint's 16 four-bit segments map to their bit counts, a point of a 16-dimensional grid. Manhattan
    distance between points is a lower bound of the Hamming distance, so two fingerprints within two bits lie in
    balls of radius one that share a cell of the grid: each fingerprint enters its own cell and those one step
    away, 33 at most, and an equi-join on cells finds every candidate. Candidates of a cell are then compared
    exactly. A cell yields a spanning forest of its links, not all pairs. Cells with more than `large` different
    fingerprints are refined to one-bit segments, 65 cells a fingerprint, where a cell's members are within two
    bits of each other by construction, at most 65 of them: no fingerprint is left out, and no task takes a large
    cell.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits: 0, 1 or 2")
    fp = F.col("fp")
    if max_bits == 0:
        return fps.select(fp.alias("a"), fp.alias("b")).limit(0)
    # The bit counts of the 16 segments side by side, four bits each: at most 0x4444..., a positive long.
    ones = [F.shiftrightunsigned(fp, k).bitwiseAND(F.lit(0x1111111111111111)) for k in range(4)]
    four = ones[0] + ones[1] + ones[2] + ones[3]
    seg = lambda i: F.shiftrightunsigned(F.col("p"), 4 * i).bitwiseAND(F.lit(15))
    cells = [F.col("p")]
    for i in range(16):
        cells += [F.when(seg(i) < 4, F.col("p") + F.lit(1 << 4 * i)), F.when(seg(i) > 0, F.col("p") - F.lit(1 << 4 * i))]
    balls = fps.select("fp", four.alias("p")).select("fp", F.explode(F.array_compact(F.array(*cells))).alias("cell"))

    full = save(balls.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where(F.col("n") > 1), "simhash-cells")
    near = _bits("a", "b") <= max_bits
    pairs = full.where((F.col("n") == 2) & near).select("a", "b")
    more = balls.join(full.where(F.col("n") > 2).select("cell", "n"), "cell")

    def forest(batches):
        for x in batches:
            a, b = [], []
            for members in x["members"]:
                f = np.sort(np.asarray(members, dtype=np.int64))
                close = np.bitwise_count(np.bitwise_xor(f[:, None], f[None, :])) <= max_bits
                left = np.ones(len(f), bool)
                for i in range(len(f)):  # breadth first from the least that is left
                    if left[i]:
                        left[i] = False
                        front = [i]
                        while front:
                            j = front.pop()
                            new = np.flatnonzero(close[j] & left)
                            left[new] = False
                            front += new.tolist()
                            a += [f[j]] * len(new)
                            b += f[new].tolist()
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    middle = map_slices(more.where(F.col("n") <= large).groupBy("cell").agg(F.collect_list("fp").alias("members")).select("members"), forest, "a long, b long")

    crowd = more.where(F.col("n") > large).select("fp").distinct()
    flips = F.array(fp, *[fp.bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    fine = crowd.select("fp", F.explode(flips).alias("cell"))
    # min() by cell first, with map-side combine; then each member meets its cell's least.
    least = fine.groupBy("cell").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    refined = fine.join(least.select("cell", "a"), "cell").select("a", fp.alias("b")).where((F.col("a") != F.col("b")) & near)
    return pairs.unionByName(middle).unionByName(refined).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, row_key, fp, component, root): each row's fingerprint and the least id that is reachable by links of max_bits or fewer.

    A-Z are lower-cased, words are what ASCII white space separates, shingles are `words` words (repeats included;
    a shorter text is one shingle) under XXH64 with seed 42; a bit is set where over half of the shingles set it.
    Null, empty and blank texts have fingerprint zero and are linked like any other. Equal fingerprints are one
    member of the join, so a group of copies costs one row there, whatever its size. Rows that repeat an id are
    rows of their own, with the same component only if their texts link; a null id never is the least, and a group of
    null ids alone has a null component. An empty table gives no rows; other columns of docs are ignored.
    """
    each = save(with_fingerprints(docs, id_col, text_col, words), "simhash-docs")
    fps = save(each.groupBy("fp").agg(F.min("id").alias("least")), "simhash-fps")
    found = connected_components(links(fps, max_bits), "simhash-components")
    group = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = least_by(group, "component", "least", "simhash-names").withColumnRenamed("least", "name")
    return each.join(group.drop("least").join(named, "component").select("fp", "name", F.col("component").alias("root")), "fp").select(
        "id", "row_key", "fp", F.col("name").alias("component"), "root"
    )


def dedup_simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """docs with one row for each group of simhash_groups(): that of the least id (null ids come last).

    Where several rows of a group share that id, the one whose key is least stays; wholly equal rows count as one.
    """
    return first_of_groups(docs, simhash_groups(docs, id_col, text_col, words, max_bits), id_col, text_col)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different hashes of a text's shingles, sorted. Words and shingles are those of fingerprint()."""
    toks = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, toks), np.uint64, len(toks))
    n, run = max(1, len(w) - words + 1), np.zeros(0, np.uint64)
    if len(w):
        run = np.full(n, min(len(w), words), np.uint64)
        for k in range(min(len(w), words)):
            run = (run ^ w[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
            run ^= run >> np.uint64(29)
    return np.unique(run)


def band_keys(shingles: np.ndarray) -> list[int]:
    """The MinHash band keys of a set of shingle hashes; none of an empty set."""
    if not len(shingles):
        return []
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 8192):
        x = (shingles[None, at : at + 8192] ^ _SEEDS[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        np.minimum(least, x.min(axis=1), out=least)
    return [xxhash.xxh3_64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, block: int = 64) -> DataFrame:
    """(id, row_key, root): rows of equal root are connected by pairs whose sets of `words`-word shingles have Jaccard `similarity` or more.

    Candidates are texts whose SimHash (of these shingles) is within two bits, and texts that share a MinHash band key:
    at Jaccard 0.8 some 10 of 64 bits differ, a radius within which unlike texts lie as well. Candidates are grouped by components, and
    all pairs of a group are compared exactly, in blocks; equal sets are one member. Texts without words are one group.
    Rows, ids and nulls are treated as by simhash_groups().
    """
    def sketch(batches):
        for x in batches:
            sets = [shingle_set(t, words) for t in x["text"]]
            member = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
            yield pd.DataFrame({"id": x["id"], "row_key": x["row_key"], "fp": [fingerprint(t, words) for t in x["text"]], "member": member, "keys": [band_keys(s) for s in sets]})

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("string").alias("id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    each = save(map_slices(texts, sketch, "id string, row_key string, fp long, member long, keys array<long>").withColumn("id", F.col("id").cast(kind)), "near-docs")

    keys = each.groupBy("member").agg(F.first("keys").alias("keys")).select("member", F.explode("keys").alias("key"))
    first = save(keys.groupBy("key").agg(F.min("member").alias("a"), F.max("member").alias("b")).where(F.col("a") < F.col("b")), "near-keys")
    by_band = keys.join(first.select("key", "a"), "key").select("a", F.col("member").alias("b"))
    prints = each.select("fp", "member").distinct()
    fps = save(prints.groupBy("fp").agg(F.min("member").alias("a")), "near-fps")
    by_print = prints.join(fps, "fp").select("a", F.col("member").alias("b"))
    pairs = links(fps.select("fp")).select(F.col("a").alias("fp"), F.col("b").alias("other")).join(fps, "fp")
    by_bits = pairs.select("a", F.col("other").alias("fp")).join(fps.withColumnRenamed("a", "b"), "fp").select("a", "b")
    edges = by_band.unionByName(by_print).unionByName(by_bits).where(F.col("a") != F.col("b"))
    group = save(connected_components(edges, "near-candidates"), "near-candidate-groups")

    need = save(each.select("member", "row_key").join(group.select(F.col("node").alias("member")), "member").groupBy("member").agg(F.min("row_key").alias("row_key")), "near-needs")

    def to_sets(batches):
        for x in batches:
            yield pd.DataFrame({"node": x["member"], "set": [shingle_set(t, words).view(np.int64) for t in x["text"]]})

    sets = map_slices(texts.select("row_key", "text").join(need, "row_key").select("member", "text"), to_sets, "node long, set array<long>")
    sets = save(sets.groupBy("node").agg(F.first("set").alias("set")), "near-sets")
    cells = in_blocks(group, "component", "node", block).join(sets, "node")
    cells = save(cells.groupBy("component", "i", "j").agg(F.collect_list(F.struct(F.col("node").alias("h"), "side", "set")).alias("m")), "near-cells")
    found = connected_components(jaccard_links(cells, similarity), "near-components").withColumnRenamed("node", "member")
    return each.join(found, "member", "left").select("id", "row_key", F.coalesce("component", "member").alias("root"))


def dedup_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row for each group of near_copies(), chosen as by dedup_simhash()."""
    return first_of_groups(docs, near_copies(docs, id_col, text_col, words, similarity), id_col, text_col)


def first_of_groups(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row_key"))
    keep = groups.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.row_key").alias("keep_key"))
    rows = docs.select(row_key(id_col, text_col).alias("keep_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # Rows equal in id and text may differ elsewhere: the least hash of the whole row decides, whatever order they come in.
    whole = F.struct(F.xxhash64("row").alias("h"), F.to_json("row").alias("text"))
    return rows.join(keep, "keep_key").withColumn("h", whole).groupBy("keep_key").agg(F.min_by("row", "h").alias("row")).select("row.*")


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_groups(docs).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


ORACLE: dict[str, str] = {}
QUERIES = {"op4_simhash_near_dedup": op4_simhash_near_dedup}
