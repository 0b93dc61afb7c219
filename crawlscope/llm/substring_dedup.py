"""Substring dedup: paragraph MinHash banding, exact Jaccard, removals by components."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from crawlscope.llm.common import connected_components, discard, in_blocks, jaccard_links, map_slices, save, slices

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words in a shingle.
SHINGLE = 5
#: A cut of the flat text stands before a word pair whose hash is the least among so many to either side; pieces have some 11 words.
REACH = 5
#: Lines of more words than LONG are cut in the same way, at pairs that are the least among FAR to either side.
LONG, FAR = 128, 24
#: Beyond a piece's ends, the words that are compared: in STEPS steps of STEP words, by hashes of BITS bits; both sides fit in one long.
STEP, STEPS, BITS = 6, 3, 10


def tune_bands(similarity: float, recall: float = 0.99, unlike: float = 0.3, false: float = 0.02, max_hashes: int = 64) -> tuple[int, int]:
    """(bands, rows): the fewest bands whose chance to collide is at least `recall` at `similarity`, and on average at most `false` over
    pairs of similarity 0 to `unlike`; so what is compared stays in proportion to what is alike, not to the square of the input."""
    for bands in range(1, max_hashes + 1):
        for rows in range(max_hashes // bands, 0, -1):
            collide = lambda s, rows=rows, bands=bands: 1 - (1 - s**rows) ** bands
            if collide(similarity) >= recall:  # the most rows that reach the recall have the fewest false candidates
                if np.mean(collide(np.linspace(0, unlike, 301))) <= false:
                    return bands, rows
                break
    raise ValueError("no bands within max_hashes")


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, on arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A factor for each place in a word; later places have theirs made when they are met.
_PLACES = _mixed(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def read_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words (which ASCII white space separates, A-Z lower-cased), and of each line that has any its first word and
    its document. A word's hash is a sum over its bytes, each by a factor of its place, so all are made at once."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    space = _SPACE[data]
    inside = ~space
    inside[1:] &= space[:-1]
    start = np.flatnonzero(inside)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(data)) - np.repeat(np.append(0, start), np.diff(np.append(np.append(0, start), len(data))))
    factor = _PLACES[np.minimum(at, len(_PLACES) - 1)]
    late = np.flatnonzero(at >= len(_PLACES))
    if len(late):
        factor[late] = _mixed(at[late].astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    value = (data.astype(np.uint64) + np.uint64(1)) * factor
    value[space] = 0
    words = _mixed(np.add.reduceat(value, start))
    line = np.searchsorted(np.flatnonzero(data == 10), start)
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    begin = np.cumsum([0, *[len(r) + 1 for r in raw[:-1]]])
    return words, first, np.searchsorted(begin, start[first], "right") - 1


def content_cuts(w: np.ndarray, begin: np.ndarray, reach: int) -> np.ndarray:
    """Where units of words, which start at `begin`, are cut: before word pairs whose hash is the least among `reach` to either side.

    The same words get the same cuts wherever they stand, but for the ones near their ends. No cut is within SHINGLE words of a unit's ends.
    """
    unit = np.zeros(len(w), np.int64)
    unit[begin[1:]] = 1
    unit = np.cumsum(unit)
    after = np.append(w[1:], np.uint64(0))
    after[begin[1:] - 1] = 0  # the last word of a unit has none
    pair = _mixed(w + np.uint64(3) * after)
    # Room between units, so that no neighbourhood reaches over an end.
    far = np.full(len(w) + reach * (len(begin) + 1), np.iinfo(np.uint64).max, np.uint64)
    place = np.arange(len(w)) + reach * (unit + 1)
    far[place] = pair
    least = far.copy()  # the least of the `reach` values from each place on
    width = 1
    while width < reach:
        step = min(width, reach - width)
        least[:-step] = np.minimum(least[:-step], least[step:])
        width += step
    cut = (pair < least[place - reach]) & (pair <= least[np.minimum(place + 1, len(far) - 1)])
    into = np.arange(len(w)) - begin[unit]
    to_go = np.append(begin[1:], len(w))[unit] - np.arange(len(w))
    cut &= (into >= SHINGLE) & (to_go >= SHINGLE)
    cut[begin] = True
    # Where no pair is the least, as in a word that is repeated over and over, cuts come at fixed distances.
    at = np.flatnonzero(cut)
    gap = np.diff(np.append(at, len(w)))
    extra = np.maximum(gap // (8 * reach) - 1, 0)
    cut[np.repeat(at, extra) + 8 * reach * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)] = True
    return cut


def positional_hash(w: np.ndarray, start: np.ndarray, size: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each run of words: start and size tile all of w."""
    at = np.arange(len(w)) - np.repeat(start, size)
    whole = np.add.reduceat(_mixed(w + np.uint64(0x9E3779B97F4A7C15) * (at + 1).astype(np.uint64)), start)
    return _mixed(whole ^ (size.astype(np.uint64) + np.uint64(salt << 32)))


def shingle_hashes(w: np.ndarray) -> np.ndarray:
    """The hash of the SHINGLE words from each word on; the last ones of w are of no use."""
    run = np.zeros(len(w), np.uint64)
    padded = np.append(w, np.zeros(SHINGLE, np.uint64))
    for k in range(SHINGLE):
        run = run * np.uint64(0x9FB21C651E98DF25) + padded[k : k + len(w)]
    return _mixed(run)


def band_keys(shingle: np.ndarray, start: np.ndarray, size: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The MinHash band keys of paragraphs of at least SHINGLE words, which tile all words: paragraphs x bands."""
    usable = np.arange(len(shingle)) - np.repeat(start, size) + SHINGLE <= np.repeat(size, size)
    out = np.zeros((len(start), bands), np.uint64)
    for i in range(bands):
        key = np.full(len(start), i + 1, np.uint64)
        for r in range(rows):
            seed = _mixed(np.array([(i * rows + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))
            h = (shingle ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            key = _mixed(key * np.uint64(31) + np.minimum.reduceat(np.where(usable, h, np.iinfo(np.uint64).max), start))
        out[:, i] = key
    return out.view(np.int64)


def beyond(w: np.ndarray, edge: np.ndarray, bound: np.ndarray, own: np.ndarray, sign: int) -> np.ndarray:
    """STEPS hashes of BITS bits side by side: of the STEP, 2 * STEP, ... words before (sign -1) or after (1) each edge.

    Where the document ends (bound), a hash of the document's own value stands in, which no other has.
    """
    some = np.zeros(len(w) + STEP, np.uint64)
    padded = np.append(w, np.zeros(2 * STEP, np.uint64))
    for k in range(STEP):
        some = some * np.uint64(0xD1342543DE82EF95) + padded[k : k + len(some)]
    chain, out = np.zeros(len(edge), np.uint64), np.zeros(len(edge), np.uint64)
    for j in range(STEPS):
        at = edge - STEP * (j + 1) if sign < 0 else edge + STEP * j
        inside = at >= bound if sign < 0 else at + STEP <= bound
        chain = _mixed(chain * np.uint64(31) + np.where(inside, some[np.clip(at, 0, len(w))], own))
        out |= (chain & np.uint64((1 << BITS) - 1)) << np.uint64(BITS * j)
    return out


def paragraph_rows(docs: DataFrame, bands: int, n_rows: int) -> DataFrame:
    """(doc, th, near, at, size, h, around, keys) of docs (doc, th, text), one row for each paragraph of each whole text.

    near: a line, or a part of one of over LONG words, with its MinHash band keys. Else a piece of the flat text, in which newlines are
    plain white space: it is the same wherever the passage around it stands, however its lines are broken; around tells what
    goes before and after. Paragraphs of fewer than SHINGLE words have no shingle and are left out.
    """
    tail = [StructField(c, IntegerType()) for c in ("near", "at", "size")] + [StructField(c, LongType()) for c in ("h", "around")]
    schema = StructType([docs.schema["doc"], docs.schema["th"], *tail, StructField("keys", ArrayType(LongType()))])
    target = to_arrow_schema(schema)

    def run(batches):
        for x in slices(batches, 512, 2 << 20):
            w, first, of = read_words(x.column("text").to_pylist())
            if not len(w):
                continue

            def batch(near, doc, at, size, h, around, keys, x=x):
                place, n = pa.array(doc), len(doc)
                ints = [pa.array(c, pa.int32()) for c in (np.full(n, near), at, size)] + [pa.array(c.view(np.int64)) for c in (h, around)]
                return pa.RecordBatch.from_arrays([x.column("doc").take(place), x.column("th").take(place), *ints, keys], schema=target)

            head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            begin, doc_of = first[head], of[head]  # the documents that have words

            start = np.flatnonzero(content_cuts(w, begin, REACH))
            size = np.diff(np.append(start, len(w)))
            d = np.searchsorted(begin, start, "right") - 1
            own = np.array([xxhash.xxh3_64_intdigest(str(x.column("doc")[i].as_py())) for i in doc_of.tolist()], np.uint64)[d]
            ends = np.append(begin[1:], len(w))[d]
            around = beyond(w, start, begin[d], own, -1) | beyond(w, start + size, ends, own, 1) << np.uint64(STEPS * BITS)
            h, k = positional_hash(w, start, size, 1), size >= SHINGLE
            yield batch(0, doc_of[d][k], (start - begin[d])[k], size[k], h[k], around[k], pa.nulls(int(k.sum()), pa.list_(pa.int64())))

            cut = np.zeros(len(w), bool)
            cut[first] = True
            n_line = np.diff(np.append(first, len(w)))
            if (n_line > LONG).any():
                inside = np.repeat(n_line > LONG, n_line)
                size = n_line[n_line > LONG]
                cut[inside] |= content_cuts(w[inside], np.cumsum(size) - size, FAR)
            start = np.flatnonzero(cut)
            size = np.diff(np.append(start, len(w)))
            k = size >= SHINGLE
            if not k.any():
                continue
            words = np.repeat(k, size)
            w, start_in, start, size = w[words], np.cumsum(size[k]) - size[k], start[k], size[k]
            d = np.searchsorted(begin, start, "right") - 1
            keys = band_keys(shingle_hashes(w), start_in, size, bands, n_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
            yield batch(1, doc_of[d], start - begin[d], size, positional_hash(w, start_in, size, 2), np.zeros(len(start), np.int64), lists)

    return docs.mapInArrow(run, schema)


def _words_alike(differ: Column, side: int) -> Column:
    """How many words are equal beyond a piece's left (0) or right (1) end, by steps of STEP, from the difference of two `around`
    (one step too many in one of 1,024 cases)."""
    out = F
    for j in range(STEPS):
        out = out.when(F.shiftrightunsigned(differ, BITS * (j + STEPS * side)).bitwiseAND(F.lit((1 << BITS) - 1)) != 0, STEP * j)
    return out.otherwise(STEP * STEPS)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, recall: float = 0.99, min_words: int = 40, block: int = 256
) -> DataFrame:
    """Passages that repeat in another document: (doc, th, at, n_words, kept_doc, cluster), a row for each to remove and each document that keeps it.

    Paragraphs are lines (parts of very long ones), and pieces of some 11 words of the flat text; see paragraph_rows(). Lines whose
    MinHash band keys collide are compared by the exact Jaccard similarity of their sets of five-word shingles; those at `similarity` or
    more are linked, and links make clusters by components. Lines and pieces that are equal are a cluster of their own. Of a cluster
    that reaches over several documents, the paragraphs in the least doc (kept_doc) stay, and all others repeat; a piece grows by the
    words that go before and after it in both documents. What repeats of a document makes stretches of words; those of
    min_words or more are the rows: from word `at`, n_words. So shared headings, license lines and other short lines are left alone. A
    passage of 51 words in the middle of unlike text is found with a chance of 0.998 (simulated).

    Keys are found with map-side combine (the least and largest document of a hash tell whether there are two), so a passage that a
    third of all documents hold is never gathered; lines of a key are compared in blocks. Texts are read once for the paragraphs,
    which are written as a table, and those with lines whose keys collide once more. Null and empty texts have no paragraphs. Rows
    without an id are left out; ids are of any type that has an order, and th is a hash of the text, so rows that repeat an id keep their own
    places. They are one document. An empty table gives no rows; other columns are ignored. Building the result runs jobs.
    """
    bands, n_rows = tune_bands(similarity, recall)
    src = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    rows = save(paragraph_rows(src, bands, n_rows), "paragraphs")

    least = F.min(F.struct("doc", "around")).alias("kept")
    shared = rows.groupBy("h").agg(least, F.max("doc").alias("hi")).where(F.col("kept.doc") < F.col("hi"))
    shared = save(shared.select(F.col("h").alias("cluster"), "kept"), "paragraphs-shared")

    each = rows.where("near = 1").groupBy("h").agg(F.min(F.struct("doc", "th", "at", "size")).alias("first"), F.max("doc").alias("hi"), F.first("keys").alias("keys"))
    each = save(each, "paragraphs-lines")
    keys = each.select("h", F.explode("keys").alias("key"))
    # A hash has a key once, so a count tells whether others have it. Written first, so that its shuffle is gone before the next.
    collide = save(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "paragraphs-keys")
    met = save(keys.join(collide, "key"), "paragraphs-members")
    discard(collide)
    some = each.join(met.select("h").distinct(), "h").select(F.col("first.doc").alias("doc"), F.col("first.th").alias("th"), F.struct("h", "first.at", "first.size").alias("p"))
    need = some.groupBy("doc", "th").agg(F.collect_list("p").alias("ps"))

    def shingles(batches):
        for x in batches:
            h, sets = [], []
            for text, ps in zip(x["text"], x["ps"], strict=True):
                run = shingle_hashes(read_words([text])[0])
                for p in ps:
                    h.append(p["h"])
                    sets.append(np.unique(run[p["at"] : p["at"] + p["size"] - SHINGLE + 1]).view(np.int64))
            yield pd.DataFrame({"h": np.array(h, np.int64), "set": sets})

    sets = map_slices(src.join(need, ["doc", "th"]).select("text", "ps"), shingles, "h long, set array<long>")
    sets = save(sets.groupBy("h").agg(F.first("set").alias("set")), "paragraphs-shingles")
    cells = in_blocks(met, "key", "h", block).join(sets, "h")
    cells = cells.groupBy("key", "i", "j").agg(F.collect_list(F.struct("h", "side", "set")).alias("m"))
    comps = connected_components(jaccard_links(cells, similarity), "paragraphs-components")
    discard(met)
    discard(sets)
    found = comps.join(each.select(F.col("h").alias("node"), F.col("first.doc").alias("lo"), "hi"), "node")
    group = save(found.groupBy("component").agg(F.min("lo").alias("kept_doc"), F.max("hi").alias("hi")).where(F.col("kept_doc") < F.col("hi")).drop("hi"), "paragraphs-clusters")
    discard(each)
    near = comps.join(group, "component").select(F.col("node").alias("h"), F.col("component").alias("cluster"), "kept_doc")

    hits = rows.select("doc", "th", "near", "at", "size", "h", "around").join(shared.withColumnRenamed("cluster", "h"), "h").where(F.col("doc") != F.col("kept.doc"))
    more = lambda side: F.when(F.col("near") == 0, _words_alike(F.col("around").bitwiseXOR(F.col("kept.around")), side)).otherwise(0)
    hits = hits.select("doc", "th", F.greatest(F.col("at") - more(0), F.lit(0)).alias("at"), (F.col("at") + F.col("size") + more(1)).alias("end"), F.col("kept.doc").alias("kept_doc"), F.col("h").alias("cluster"))
    like = rows.where("near = 1").select("doc", "th", "at", "size", "h").join(near, "h").where(F.col("doc") != F.col("kept_doc"))
    hits = hits.unionByName(like.select("doc", "th", "at", (F.col("at") + F.col("size")).alias("end"), "kept_doc", "cluster"))

    # Stretches: a hit starts a new one where it begins after all those before it have ended.
    order = Window.partitionBy("doc", "th").orderBy("at", "end", "kept_doc", "cluster")
    ahead = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("new", F.coalesce((F.col("at") > ahead).cast("int"), F.lit(0)))
    hits = hits.withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    by_doc = Window.partitionBy("doc", "th", "stretch")
    kept = hits.groupBy("doc", "th", "stretch", "kept_doc").agg(F.min("at").alias("at"), F.max("end").alias("end"), F.min("cluster").alias("cluster"))
    kept = kept.withColumns({"at": F.min("at").over(by_doc), "end": F.max("end").over(by_doc)}).where(F.col("end") - F.col("at") >= min_words)
    return kept.select("doc", "th", "at", (F.col("end") - F.col("at")).alias("n_words"), "kept_doc", "cluster")


def without_words(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without these runs (first word, number) of its words; a line that loses all its words goes with its newline."""
    cut = np.zeros(max((a + n for a, n in gone), default=0) + len(text), bool)
    for a, n in gone:
        cut[a : a + n] = True
    out, word = [], 0
    for line in text.split("\n"):
        at = [m.start() for m in _WORD.finditer(line)]
        mine = cut[word : word + len(at)]
        word += len(at)
        if not mine.any():
            out.append(line)
        elif not mine.all():
            ends = [*at[1:], len(line)]
            out.append((line[: at[0]] + "".join(line[a:b] for a, b, c in zip(at, ends, mine, strict=True) if not c)).rstrip(" \t"))
    return "\n".join(out)


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the texts that repeated_passages() leaves, and n_removed (long: passages), which replaces a column of that name.

    Texts without a removal are as they were, null ones too. Each text crosses the network once, to meet its list, by id and hash of the text.
    """
    found = repeated_passages(docs, id_col, text_col, **options).groupBy(F.col("doc").alias("gone_doc"), F.col("th").alias("gone_th"))
    gone = found.agg(F.collect_set(F.struct("at", "n_words")).alias("gone"))

    @F.pandas_udf("string")
    def rebuilt(texts: pd.Series, lists: pd.Series) -> pd.Series:
        one = lambda t, g: t if t is None or g is None else without_words(t, [(p["at"], p["n_words"]) for p in g])
        return pd.Series([one(t, g) for t, g in zip(texts, lists, strict=True)], dtype=object)

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.xxhash64(text_col).alias("own_th")).join(gone, (F.col("row")[id_col] == F.col("gone_doc")) & (F.col("own_th") == F.col("gone_th")), "left")
    text = rebuilt(F.col("row")[text_col], F.col("gone"))
    cols = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "n_removed"]
    return rows.select(*cols, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_passages(docs).drop("th").withColumnsRenamed({"doc": "doc_id", "at": "first_word", "kept_doc": "kept_doc_id", "cluster": "cluster_id"})


ORACLE: dict[str, str] = {}
QUERIES = {"op5_substring_dedup": op5_substring_dedup}
