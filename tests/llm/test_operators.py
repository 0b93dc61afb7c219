"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from crawlscope.llm import chat, common, embedding_dedup, gif, langid, line_dedup, mixing, pieces, quality, simhash, substring_dedup

DOC = "doc_id long, text string, source string, h string, n_lines int"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "extra", -1) for i, t, s in rows], DOC)


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n ", None), (None, "no id here at all, friend", "a"), (4, LONG, "b"), (5, "Same text twice.", "b"), (5, "Same text twice.", "b"), (6, "日本 é ▁ 🙂\x00", "b"), (7, "é   x", "b")]
    return docs(spark, rows)


def components(ids, pairs):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2200)]
    df = spark.createDataFrame([(b, a) for a, b in edges], "a long, b long")
    want = components({x for e in edges for x in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in common.connected_components(df).collect()} == want
    assert common.connected_components(df.limit(0)).count() == 0


# 1


def brute_lines(rows, least=20, docs_least=3):
    strip = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in strip(x))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least and i is not None:
                held[key(x)].add(i)
    hot = {k: max(v) for k, v in held.items() if len(v) >= docs_least}
    return sorted((repr(i), "\n".join(x for x in (t or "").split("\n") if hot.get(key(x), i) == i)) for i, t in rows)


def test_lines(spark):
    long = "The quick brown fox jumps over Äs"
    rows = [(1, f"{long}\nown\n\t{long.upper().replace('Ä', 'Ä')} \r"), (2, f" {long} \n"), (3, f"{long}\n{long}\nx"), (3, f"{long}\nz"), (None, f"{long}\nnull id"), (4, None), (5, ""), (6, "short\nshort"), (7, "short"), (8, "short"), (9, "\x0b" + "é" * 20 + "\nq\n"), (10, "é" * 20), (11, "é" * 20 + "\x0c"), (12, "é" * 19), (13, "a " + "b" * 20), (14, "a " + "b" * 20)]
    got = line_dedup.dedup_lines(docs(spark, [(i, t, "s") for i, t in rows]))
    assert got.columns == ["doc_id", "text", "source", "h", "n_lines", "n_dropped"]
    out = got.collect()
    assert sorted((repr(r.doc_id), r.text) for r in out) == brute_lines(rows)
    assert {r.n_lines for r in out if r.doc_id in (4, 5)} == {1}


def test_lines_odd(spark, odd):
    assert line_dedup.dedup_lines(odd).count() == odd.count()
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


# 2


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=16) * (0.05 if i % 3 else 0.12)
        rows.append((i, v.astype(np.float32).tolist(), i % 2 if i % 50 else None))
    rows += [(400 + k, rows[1][1], 1) for k in range(5)] + [(410, None, 1), (411, [0.0] * 16, 1), (412, [float("nan")] * 16, 1), (413, [None] * 16, 1), (414, [], 1), (415, [1.0, 2.0], 1), (416, [2.0, 4.0], 1), (417, [float("inf")] * 16, 1)]
    rows += [(None, rows[3][1], rows[3][2]), (None, [1.0, 2.0], 1), (None, None, 1), (7, rows[7][1], rows[7][2]), (7, rows[8][1], rows[8][2]), (None, [5.0, 5.0, 5.0], 3), (None, [5.0, 5.0, 5.1], 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, list string")
    got = embedding_dedup.embedding_groups(df, block=16, n_pivots=32, min_shared=2).collect()
    both = components(range(len(rows)), [(a, b) for a, b in combinations(range(len(rows)), 2) if linked(rows[a], rows[b])])
    name = defaultdict(list)
    for k, g in both.items():
        name[g] += [rows[k][0]] if rows[k][0] is not None else []
    want = sorted((str(i), sum(linked(rows[k], r) for j, r in enumerate(rows) if j != k), str(min(name[both[k]], default=None))) for k, (i, _, _) in enumerate(rows))
    assert sorted((str(r.id), r.n_links, str(r.component)) for r in got) == want
    assert all(r.kept == (r.id is not None and r.id == r.component) for r in got)
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0


def linked(a, b):
    ok = lambda r: r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    if not (ok(a) and ok(b) and a[2] == b[2] and len(a[1]) == len(b[1])):
        return False
    x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
    return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98


@pytest.mark.parametrize("n, dim", [(3_000, 64), (12_000, 32)])
def test_embedding_recall_and_work(spark, n, dim):
    """Against all pairs at two sizes: vectors with a near one at cosines from 0.98 on, the hardest to find."""
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n, dim)) + rng.normal(size=(5, dim))[rng.integers(0, 5, n)] * 0.7
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.normal(size=(n // 10, dim))
    off -= (off * base[: n // 10]).sum(1, keepdims=True) * base[: n // 10]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cos = rng.uniform(0.9801, 0.999, (n // 10, 1))
    x = np.concatenate([base, cos * base[: n // 10] + np.sqrt(1 - cos**2) * off])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist(), "label": 1}), "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.embedding_groups(df).agg(F.sum("n_links")).first()[0]
    want = sum(int(((x[i : i + 2000] @ x.T) >= 0.98).sum()) - len(x[i : i + 2000]) for i in range(0, len(x), 2000))
    assert want >= n // 5 and 0.99 * want <= got <= want


# 3


def test_mixing(spark, odd):
    rows = docs(spark, [(i, f"t{i}", "hot" if i % 3 else ("cold" if i % 2 else None)) for i in range(600)])
    got = mixing.mix_sources(rows, {"hot": 1.0, "cold": 1.0, None: 2.0}).collect()
    sizes = Counter("hot" if i % 3 else ("cold" if i % 2 else None) for i in range(600))
    rate = {s: 600 * w / 4 / sizes[s] for s, w in (("hot", 1), ("cold", 1), (None, 2))}
    want = Counter()
    for i in range(600):
        s = "hot" if i % 3 else ("cold" if i % 2 else None)
        u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        want[i] = mixing.poisson_count(u, rate[s])
    assert Counter(r.doc_id for r in got) == +want
    assert all(1 <= r.copy_no <= r.n_copies for r in got) and len({r.shuffle_key for r in got}) == len(got)
    assert abs(sum(r.source is None for r in got) - 300) < 60
    assert {r.source for r in mixing.mix_sources(rows, {"cold": 1.0}).collect()} == {"cold"}
    with pytest.raises(ValueError):
        mixing.mix_sources(rows, {"cold": 1.0}, max_rate=2)
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    assert mixing.mix_sources(odd).columns == [*odd.columns, "copy_no", "n_copies", "shuffle_key"]
    mean = np.mean([mixing.poisson_count(u, 900.0) for u in np.linspace(0.0005, 0.9995, 1000)])
    assert abs(mean - 900) < 1


def test_mixing_large_rates(spark):
    rows = docs(spark, [(i, f"t{i}", {0: None, 1: "rare"}.get(i, "hot")) for i in range(50)])
    weights = {None: 1.0, "rare": 20.0, "hot": 1.0}
    out = mixing.mix_sources(rows, weights, epochs=8_800.0)
    got = {r.doc_id: (r.n_copies, r.n, r.least, r.most, r.different) for r in out.groupBy("doc_id", "n_copies").agg(F.count(F.lit(1)).alias("n"), F.min("copy_no").alias("least"), F.max("copy_no").alias("most"), F.count_distinct("shuffle_key").alias("different")).collect()}
    want = {}
    for i in range(50):
        u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k = mixing.poisson_count(u, 8_800 * 50 / 22 * {0: 1, 1: 20}.get(i, 1 / 48))
        want[i] = (k, k, 1, k, k)
    assert got == want and want[0][0] > 19_000 and want[1][0] > 390_000
    uniforms = [(k + 0.5) / 200 for k in range(200)]
    counts = spark.createDataFrame([(u,) for u in uniforms], "u double").select("u", mixing.large_count(F.lit(1e9), F.col("u")).alias("k")).collect()
    sigmas = np.array([(r.k - 1e9) / 1e9**0.5 for r in sorted(counts)])
    assert abs(sigmas.mean()) < 0.01 and abs(sigmas.std() - 1) < 0.02 and abs(sigmas[0] + 2.807) < 0.01


def test_mixing_without_broadcast(spark, monkeypatch):
    rows = docs(spark, [(i, f"t{i}", f"s{i % 7}") for i in range(200)])
    key = lambda r: (r.doc_id, r.copy_no)
    want = sorted(mixing.mix_sources(rows).collect(), key=key)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(mixing.mix_sources(rows).collect(), key=key) == want


# 4


def brute_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprints():
    for t in (None, "", " \n", "One", "A b", "É a B c a b c", LONG[:3000], "x " * 70_000):
        assert simhash.fingerprint(t) % (1 << 64) == brute_fingerprint(t)


@pytest.mark.parametrize("large", [256, 2])
def test_links_keep_connectivity(spark, large):
    rng = np.random.default_rng(2)
    fps = {int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 40)}
    for x in list(fps):
        for _ in range(6):
            y = x % (1 << 64)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                y ^= 1 << int(b)
            fps.add(y - (1 << 64) if y >> 63 else y)
    fps |= {0, 1, 3, -1, -2, -(1 << 63)}
    near = [(a, b) for a, b in combinations(sorted(fps), 2) if ((a ^ b) % (1 << 64)).bit_count() <= 2]
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), large=large).collect()]
    assert components(fps, got) == components(fps, near)
    assert {tuple(sorted(x)) for x in got} <= set(near)


def test_simhash_groups_and_dedup(spark, odd):
    rows = [(1, None), (2, ""), (3, " \n"), (None, ""), (9, "one two three four"), (8, "One two  three four"), (8, "something else here"), (None, "only me"), (None, "only me")]
    df = docs(spark, [(i, t, "s") for i, t in rows])
    got = sorted((str(r.id), r.fp, r.component) for r in simhash.simhash_groups(df).collect())
    zero, four, else_, me = (simhash.fingerprint(t) for t in ("", "one two three four", "something else here", "only me"))
    assert got == sorted([("1", zero, 1), ("2", zero, 1), ("3", zero, 1), ("None", zero, 1), ("9", four, 8), ("8", four, 8), ("8", else_, 8), ("None", me, None), ("None", me, None)])
    kept = simhash.dedup_simhash(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", None), ("8", "One two  three four"), ("8", "something else here"), ("None", "only me")], key=str)
    assert simhash.simhash_groups(odd.limit(0)).count() == 0
    assert simhash.dedup_simhash(odd).count() == 6


def brute_shingles(text, words=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def test_pipeline_drops_near_copies(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):
        w = [f"{rng.integers(1e6)}" for _ in range(int(rng.integers(20, 300)))]
        rows.append((3 * k, " ".join(w), "s"))
        for j in (1, 2):  # at Jaccard from below 0.8 to nearly 1
            v = list(w)
            for at in rng.choice(len(w), int(rng.integers(1, max(2, len(w) // 30 + 1))), replace=False):
                v[at] = f"new{k}x{at}x{j}"
            rows.append((3 * k + j, " ".join(v), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (902, "Two words", "s"), (903, "two  words", "s"), (904, "two word", "s"), (None, rows[0][1], "s"), (905, "x " * 70_000, "s"), (906, "x " * 60_000, "s")]
    sets = {i: brute_shingles(t) for i, t, _ in rows if i is not None}
    near = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = set(components(sets, near).values())
    df = docs(spark, rows).withColumn("lang", F.lit("en")).withColumn("n_chars", F.char_length("text"))
    got = corpus_pipeline.simhash_near_dedup(spark, df, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    assert 70 < len(want) < 170  # some pairs are near copies, others not
    assert corpus_pipeline.simhash_near_dedup(spark, df.limit(0), "").count() == 0


# 5


def prose(rng, n):
    return [f"{rng.integers(1e6)}" for _ in range(n)]


def laid(words, sizes):
    return "\n".join(" ".join(words[sum(sizes[:k]) : sum(sizes[: k + 1])]) for k in range(len(sizes)))


def test_bands():
    assert substring_dedup.tune_bands(0.8) == (9, 4)
    for similarity, recall in ((0.8, 0.99), (0.9, 0.999), (0.7, 0.95)):
        b, r = substring_dedup.tune_bands(similarity, recall)
        assert 1 - (1 - similarity**r) ** b >= recall and np.mean([1 - (1 - s**r) ** b for s in np.linspace(0, 0.3, 100)]) <= 0.02


def test_words_are_those_of_a_plain_split():
    texts = ["Aa\x0bB  c\nÉ d", None, "", "\n \n", "a b", "x" * 5000 + " y", "aA\tbb", "x" * 4999 + "y y"]
    w, first, of = substring_dedup.read_words(texts)
    want = [(d, line) for d, t in enumerate(texts) for line in [[x for x in re.split("[\x20\x09-\x0d]+", part.replace("A", "a").replace("B", "b")) if x] for part in (t or "").split("\n")] if line]
    assert of.tolist() == [d for d, _ in want] and np.diff(np.append(first, len(w))).tolist() == [len(x) for _, x in want]
    names = [x for _, line in want for x in line]
    assert len(w) == len(names) and len(set(zip(w.tolist(), names, strict=True))) == len(set(names)) == len(set(w.tolist()))


def test_passages(spark, odd):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(prose(rng, n))
    rows, planted = [(i, f"{text(80)}\n{text(40)}", "s") for i in range(60)], {}
    for k in range(20):  # in the middle of a line, at another place in each document
        passage = prose(rng, 55)
        for i in (2 * k, 2 * k + 1):
            a = rows[i][1].split()
            cut = int(rng.integers(5, 60))
            rows[i] = (i, " ".join(a[:cut]) + " " + " ".join(passage) + " " + " ".join(a[cut:]), "s")
            planted[2 * k + 1, 2 * k] = cut
    heading = "A short heading line here\n"
    rows += [(103, heading + text(50), "s"), (104, heading + text(50), "s"), (None, rows[0][1], "s"), (105, None, "s"), (106, "", "s"), (107, "of " * 300, "s"), (108, "unlike " + "of " * 300, "s")]
    got = {(r.doc, r.kept_doc): r for r in substring_dedup.repeated_passages(docs(spark, rows)).collect()}
    assert set(got) <= set(planted) | {(108, 107)} and len(got) >= 20 and (108, 107) in got
    for pair, cut in planted.items():
        if pair in got:
            r = got[pair]
            # A part of a line may begin or end a few words farther out, at Jaccard 0.8.
            assert cut - 12 <= r.at <= cut + 15 and cut + 40 <= r.at + r.n_words <= cut + 67 and r.n_words >= 40
    assert substring_dedup.repeated_passages(odd.limit(0)).count() == 0
    assert substring_dedup.repeated_passages(odd).count() == 0


def test_passages_in_short_lines(spark):
    rng = np.random.default_rng(9)
    verse, mixed, broken = prose(rng, 120), prose(rng, 120), prose(rng, 120)
    rows = [(1, laid(verse, [3] * 40)), (2, laid(prose(rng, 9), [3] * 3) + "\n" + laid(verse, [3] * 40)), (3, laid(mixed, [7, 3] * 12)), (4, laid(prose(rng, 9), [9]) + "\n" + laid(mixed, [7, 3] * 12)), (5, laid(broken, [8] * 15)), (6, laid(broken, [6, 4] * 12)), (7, laid(prose(rng, 30), [3] * 10))]
    df = docs(spark, [(i, t, "s") for i, t in rows])
    assert {(r.doc, r.kept_doc) for r in substring_dedup.repeated_passages(df).collect()} == {(2, 1), (4, 3), (6, 5)}
    left = {r.doc_id: r.text.split() for r in substring_dedup.drop_repeated(df).collect()}
    for i, passage in ((2, verse), (4, mixed), (6, broken)):
        assert len(set(left[i]) & set(passage)) <= 8
    assert all(left[i] == t.split() for i, t in rows if i in (1, 3, 5, 7))


def test_lines_at_jaccard_by_all_pairs(spark):
    """All pairs of lines, by sets of word tuples: clusters by components, kept in the least document, long lines alone reported."""
    rng = np.random.default_rng(4)
    lines, texts = [prose(rng, int(rng.integers(5, 120))) for _ in range(40)], []
    for d in range(80):
        out = []
        for k in rng.choice(len(lines), 3, replace=False):
            w = list(lines[k])
            for at in rng.choice(len(w), int(rng.integers(0, 1 + len(w) // 25)), replace=False):
                w[at] = f"new{rng.integers(1e6)}"
            out.append(" ".join(w))
        texts.append("\n".join(out))
    grams = lambda w: frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    own = [(d, at, len(w), grams(w)) for d, t in enumerate(texts) for at, w in zip(np.cumsum([0, *[len(x.split()) for x in t.split("\n")]]).tolist(), [x.split() for x in t.split("\n")], strict=False)]
    pairs = [(i, j) for i, j in combinations(range(len(own)), 2) if len(own[i][3] & own[j][3]) >= 0.8 * len(own[i][3] | own[j][3]) > 0]
    group = components(range(len(own)), pairs)
    kept = defaultdict(lambda: 10**9)
    for i, g in group.items():
        kept[g] = min(kept[g], own[i][0])
    want = {(own[i][0], own[i][1], own[i][2], kept[g]) for i, g in group.items() if own[i][0] != kept[g]}
    got = substring_dedup.repeated_passages(docs(spark, [(d, t, "s") for d, t in enumerate(texts)]), min_words=5).collect()
    covered = {(r.doc, k) for r in got for k in range(r.at, r.at + r.n_words)}
    missed = [x for x in want if any((x[0], k) not in covered for k in range(x[1], x[1] + x[2]))]
    assert len(want) > 80 and len(missed) <= 0.02 * len(want)
    assert {(d, k) for d, _, _, k in want if not any(x[0] == d and x[3] == k for x in missed)} <= {(r.doc, r.kept_doc) for r in got}


def test_repeated_and_string_ids(spark):
    rng = np.random.default_rng(12)
    passage, a, b = " ".join(prose(rng, 60)), " ".join(prose(rng, 30)), " ".join(prose(rng, 9))
    rows = [("a", passage), ("b", f"{a}\n{passage}"), ("b", f"{passage}\n{b}"), ("b", b), ("b", b), ("c", None)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id string, text string, n_removed int")
    out = substring_dedup.drop_repeated(df)
    assert out.columns == ["doc_id", "text", "n_removed"]
    assert sorted((r.doc_id, str(r.text), r.n_removed) for r in out.collect()) == sorted([("a", passage, 0), ("b", a, 1), ("b", b, 1), ("b", b, 0), ("b", b, 0), ("c", "None", 0)])
    assert {(r.doc, r.kept_doc) for r in substring_dedup.repeated_passages(df).collect()} == {("b", "a")}


# 6


def reference_lzw(stream, size):
    clear, bits, pos, width, table, prev, out = 1 << size, int.from_bytes(stream, "little"), 0, size + 1, [], None, bytearray()
    while True:
        code = bits >> pos & ((1 << width) - 1)
        pos += width
        if code == clear:
            table, width, prev = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1, None
        elif code == clear + 1:
            return bytes(out)
        else:
            s = table[code] if code < len(table) else prev + prev[:1]
            if prev is not None and len(table) < 4096:
                table.append(prev + s[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            out += s
            prev = s


@pytest.mark.parametrize("n", [0, 1, 2, 300, 3837, 3838, 3839, 3840, 20_000])
def test_lzw(n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 256, n).astype(np.uint8), np.zeros(n, np.uint8), (np.arange(n) // 9 % 5).astype(np.uint8)):
        code = gif.lzw_encode(data.tobytes())
        assert reference_lzw(code, 8) == data.tobytes() == gif.lzw_decode(code, 8, n).tobytes()


def test_frames(spark):
    pal = bytes(range(256)) * 3
    a, b = np.full((2, 2), 1, np.uint8), np.array([[2]], np.uint8)
    raw = bytearray(gif.encode_gif([(a, 5), (b, 7)], pal, disposal=2))
    second = raw.rindex(b"\x21\xf9\x04")
    raw[second + 3] |= 1
    raw[second + 6] = 2  # the second frame's only pixel is transparent
    frames = list(gif.composed(bytes(raw)))
    assert [f.delay_ms for f, _ in frames] == [50, 70]
    assert frames[0][1][0, 0].tolist() == [3, 4, 5, 255] and frames[1][1].sum() == 0  # disposed of to nothing
    df = spark.createDataFrame([(1, bytes(raw), "x"), (2, None, "x"), (3, b"GIF89a", "x"), (4, bytes(raw[:-20]), "x")], "media_id long, data binary, error string")
    got = {(r.id, r.frame): r for r in gif.decode_gifs(df).collect()}
    assert got[1, 0].error is None and sum(got[1, 0].histogram) == 4 and got[2, 0].error == "no data" and got[3, 0].error
    assert got[4, 1].error and got[4, 0].error is None
    assert gif.decode_gifs(df.limit(0)).count() == 0


def plain_codes(values, size):
    """LZW that never uses its table: a clear code before every other literal."""
    clear, bits, at = 1 << size, 0, 0
    for k, v in enumerate(values):
        for code in ([clear] if k % 2 == 0 else []) + [int(v)]:
            bits |= code << at
            at += size + 1
    bits |= (clear + 1) << at
    raw = bits.to_bytes((at + size + 8) // 8, "little")
    return bytes([size]) + b"".join(bytes([len(raw[i : i + 255])]) + raw[i : i + 255] for i in range(0, len(raw), 255)) + b"\0"


def rendered(w, h, frames):
    """What a viewer shows, pixel by pixel: frames (values, x, y, palette, disposal, transparent) in order."""
    canvas, out = [[(0, 0, 0, 0)] * w for _ in range(h)], []
    for values, x, y, palette, disposal, clear in frames:
        before = [list(r) for r in canvas]
        for i, row in enumerate(values):
            for j, v in enumerate(row):
                if v != clear and y + i < h and x + j < w:
                    canvas[y + i][x + j] = (*palette[v], 255)
        out.append([list(r) for r in canvas])
        if disposal == 2:
            for i in range(len(values)):
                for j in range(len(values[0])):
                    if y + i < h and x + j < w:
                        canvas[y + i][x + j] = (0, 0, 0, 0)
        if disposal == 3:
            canvas = before
    return out


def test_frames_against_a_plain_renderer(spark):
    rng = np.random.default_rng(6)
    colours = lambda: [tuple(int(c) for c in rng.integers(0, 256, 3)) for _ in range(8)]
    shared, frames, data = colours(), [], b""
    w, h = 13, 11
    for k in range(12):
        fw, fh, x, y = (int(v) for v in (rng.integers(1, 10), rng.integers(1, 10), rng.integers(0, 9), rng.integers(0, 9)))
        values, own, disposal, clear, delay = rng.integers(0, 8, (fh, fw)).tolist(), colours() if k % 3 == 0 else None, k % 4, int(rng.integers(8)) if k % 2 else None, 3 * k
        order = [i for s, d in ((0, 8), (4, 8), (2, 4), (1, 2)) for i in range(s, fh, d)] if k % 2 else range(fh)
        data += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + delay.to_bytes(2, "little") + bytes([clear or 0, 0])
        data += b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, fw, fh)) + bytes([(0x82 if own else 0) | (0x40 if k % 2 else 0)]) + (bytes(c for q in own for c in q) if own else b"")
        data += plain_codes([v for i in order for v in values[i]], 3)
        frames.append((values, x, y, own or shared, disposal, clear))
    head = b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + bytes([0x82, 0, 0]) + bytes(c for q in shared for c in q)
    want = rendered(w, h, frames)
    huge = b"GIF89a" + b"\xff\xff\xff\xff" + head[10:] + data + b";"
    bomb = gif.lzw_encode(bytes(2_000_000))
    big = head[:6] + (500).to_bytes(2, "little") * 2 + head[10:] + b"\x2c\0\0\0\0" + (500).to_bytes(2, "little") * 2 + b"\0\x08" + gif._blocks(bomb) + b";"
    df = spark.createDataFrame([(1, head + b"!\xfe\x03abc\0" + data + b";"), (2, huge), (3, big)], "media_id long, data binary")
    got = {(r.id, r.frame): r for r in gif.decode_gifs(df).collect()}
    for k, canvas in enumerate(want):
        r = got[1, k]
        assert bytes(r.rgba) == bytes(c for row in canvas for q in row for c in q) and r.delay_ms == 30 * k and r.error is None
        seen = Counter((q[0] >> 6) * 16 + (q[1] >> 6) * 4 + (q[2] >> 6) for row in canvas for q in row if q[3])
        assert r.histogram == [seen[b] for b in range(64)]
    assert "canvas of 65535" in got[2, 0].error and got[3, 0].error is None and len(got[3, 0].rgba) == 1_000_000


def test_feature_follows_the_palette():
    media, _ = gif.text_to_gif("some text " * 40)
    at = 13
    other = media[:at] + bytes(reversed(media[at : at + 768])) + media[at + 768 :]
    assert gif.gif_payload(media)[1] != gif.gif_payload(other)[1] and gif.gif_payload(media)[0] != gif.gif_payload(other)[0]
    assert gif.gif_payload(media)[1].startswith("frames=1;ms=40;")


def test_texts_as_media(spark, odd):
    out = gif.texts_as_gifs(odd).collect()
    assert len(out) == odd.count()
    texts = {1: "", 2: "", 3: " \n ", 4: LONG, 6: "日本 é ▁ 🙂\x00"}
    for r in out:
        if r.id in texts:
            raw = texts[r.id].encode()
            pay = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
            assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
            assert b"".join(f.indices.tobytes() for f in gif.read_frames(bytes(r.media))) == pay


# 7


def test_preferences(spark):
    s = "pair_id long, turn long, role string, text string, reply string"
    chosen = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "yes", ""), (2, 0, "user", "q", ""), (2, 1, "assistant", "same", ""), (3, 0, "user", "only", ""), (4, 1, None, None, ""), (None, 0, "user", "x", ""), (5, None, "user", "x", ""), (1, 0, "user", "hi", "again")]
    rejected = [(1, 0, "user", "hi", ""), (1, 1, "assistant", f"no {chat.OPEN}é", ""), (1, 2, "user", "why", ""), (2, 1, "assistant", "same", ""), (2, 0, "user", "q", ""), (6, 0, "assistant", "alone", "")]
    got = {r.pair_id: r for r in chat.format_preferences(spark.createDataFrame(chosen, s), spark.createDataFrame(rejected, s)).collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    one = got[1]
    assert one.n_shared == 1 and one.prompt == "<|im_start|>user\nhi<|im_end|>\n" and one.chosen == "<|im_start|>assistant\nyes<|im_end|>\n"
    assert [one.chosen[a:b] for a, b in one.chosen_spans] == ["yes<|im_end|>"] and [one.rejected[a:b] for a, b in one.rejected_spans] == ["no <im_start>é<|im_end|>"]
    assert got[2].n_shared == 2 and got[2].chosen == got[2].rejected == "" and got[2].chosen_spans == []
    assert got[3].rejected == "" and got[6].chosen == "" and got[4].chosen == "<|im_start|>\n<|im_end|>\n"
    bad = [(1, 0, "user<|im_end|>\n<|im_start|>assistant", "hi", ""), (1, 1, "assistant", "x<|im_end|>\n<|im_start|>user\n", "")]
    r = chat.format_preferences(spark.createDataFrame(bad, s), spark.createDataFrame(bad[:1], s)).first()
    assert r.prompt == "<|im_start|>user<im_end> <im_start>assistant\nhi<|im_end|>\n" and r.chosen.count("<|im_start|>") == r.chosen.count("<|im_end|>") == 1
    assert [r.chosen[a:b] for a, b in r.chosen_spans] == ["x<im_end>\n<im_start>user\n<|im_end|>"]
    empty = spark.createDataFrame([], s)
    assert chat.format_preferences(empty, empty).count() == 0


# 8


def plain_score(m, text):
    """The model's score with loops over passages, ids and hidden places."""
    ids, first_id, first, shape = quality.passages([text])
    assert first.tolist() == [0]
    p, bags, ends = m.p, [], [*first_id[1:].tolist(), len(ids)]
    for k, (lo, hi) in enumerate(zip(first_id.tolist(), ends, strict=True)):
        x = [sum(p["E"][i][d] for i in ids[lo:hi]) / (hi - lo) for d in range(p["E"].shape[1])]
        x += [min(6, max(-6, (v - a) / b)) for v, a, b in zip(shape[k], m.mean, m.std, strict=True)]
        h = [np.tanh(sum(x[i] * p["W"][i][j] for i in range(len(x))) + p["b"][j]) for j in range(len(p["b"]))]
        gate = [np.tanh(sum(h[i] * p["V"][i][j] for i in range(len(h)))) / (1 + np.exp(-sum(h[i] * p["U"][i][j] for i in range(len(h))))) for j in range(len(p["w"]))]
        bags.append((sum(g * w for g, w in zip(gate, p["w"], strict=True)), h))
    total = sum(np.exp(e) for e, _ in bags)
    z = [sum(np.exp(e) / total * h[j] for e, h in bags) for j in range(len(p["b"]))]
    return 1 / (1 + np.exp(-sum(a * b for a, b in zip(z, p["c"], strict=True)) - p["c0"][0]))


WORDS = "The quick brown fox jumps over THE lazy dog | 42 times!! ça va là bas und so weiter".split()


def some_texts(n):
    rng = np.random.default_rng(n)
    return [" ".join(rng.choice(WORDS, int(rng.integers(1, 200)))) for _ in range(n)]


def test_forward_pass_and_gradient():
    texts, y = [*some_texts(5), "", None], np.array([0.0, 1, 1, 0, 1, 0, 0])
    m = quality.AttentionMIL(seed=3)
    m.mean, m.std = np.full(quality.N_SHAPE, 0.1), np.full(quality.N_SHAPE, 0.4)
    assert np.allclose(m.score(texts), [plain_score(m, t) for t in texts], atol=1e-9)
    ids, first_id, first, shape = quality.passages(texts)
    found = m.gradient(ids, first_id, first, shape, y)

    def loss():
        s = m.forward(m.encode(ids, first_id, shape), first)["s"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    rng = np.random.default_rng(1)
    for k, g in found.items():
        for _ in range(12):
            at = (ids[rng.integers(len(ids))], rng.integers(8)) if k == "E" else tuple(rng.integers(d) for d in g.shape)
            kept = m.p[k][at]
            m.p[k][at] = kept + 1e-5
            up = loss()
            m.p[k][at] = kept - 1e-5
            slope = (up - loss()) / 2e-5
            m.p[k][at] = kept
            assert abs(slope - g[at]) < 1e-6 + 1e-3 * abs(slope)


def test_passages_of_texts():
    texts = [*some_texts(20), "", None, " \n ", "one", LONG]
    ids, first_id, first, shape = quality.passages(texts)
    k, ends = 0, np.append(first_id[1:], len(ids))
    for d, t in enumerate(texts):
        assert first[d] == k
        w = (t or "").split()
        for at in range(0, max(1, len(w)), quality.PASSAGE):
            part = w[at : at + quality.PASSAGE]
            mine = ids[first_id[k] : ends[k]]
            assert len(mine) == (sum(len(x.encode()) for x in part) + len(part) if part else 1)
            if part:
                joined = "".join(part)
                top = Counter(part).most_common(1)[0][1]
                letters = [c for c in joined if c.isalpha()]
                got = shape[k]
                assert np.allclose(got[3:5], [len(set(part)) / len(part), top / len(part)]) and np.isclose(got[6], sum(a == b for a, b in zip(part, part[1:], strict=False)) / len(part))
                if joined.isascii() and letters:
                    marks = [c for c in joined if not c.isalnum()]
                    assert np.allclose(got[:3], [sum(c.isupper() for c in letters) / len(letters), sum(c.isdigit() for c in joined) / len(joined), len(marks) / len(joined)])
            else:
                assert mine.tolist() == [0] and not shape[k].any()
            k += 1
    assert k == len(first_id)
    alone = quality.passages([texts[3]])
    assert np.array_equal(alone[0], ids[first_id[first[3]] : first_id[first[4]]])


def test_fit_takes_texts_by_parts():
    texts = [" \n ", *some_texts(20), "", None, " \n ", " lead", "one", LONG, "", "\tlast "]
    for size in (1, 300, 5000, 1 << 30):
        for a, b in zip(quality.passages_by_parts(texts, size), quality.passages(texts), strict=True):
            assert a.dtype == b.dtype and np.array_equal(a, b)
    # The driver's memory: what is made of the sample at once doesn't take many times its size.
    many = some_texts(2000) * 5
    tracemalloc.start()
    quality.AttentionMIL().fit(many, np.arange(len(many)) % 2.0, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * sum(len(t.encode()) for t in many)


def test_quality(spark, odd):
    clean = lambda i: " ".join(f"word{chr(97 + (i + k) % 26)}" for k in range(120)) + "."
    junk = lambda i: clean(i)[:300] + " @@@ ### !!! " * 60
    df = docs(spark, [(i, junk(i) if i % 4 == 0 else clean(i), "s") for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)] + [(1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(df, labels, ~quality.held_out())
    got = quality.score_quality(df.unionByName(odd), model).collect()
    assert all((r.score >= 0.3) == (r.doc_id % 4 != 0) for r in got if r.text in (clean(r.doc_id or 0), junk(r.doc_id or 0)))
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 300 + odd.count()
    none = quality.fit_quality(df, labels.limit(0), ~quality.held_out())
    assert {r.score for r in quality.score_quality(odd, none).collect()} == {0.5}
    assert quality.score_quality(odd.limit(0), model).count() == 0
    assert len(quality.passages([LONG])[1]) == -(-30_000 // quality.PASSAGE)


# 9


def test_round_trips():
    v = pieces.vocabulary(pieces.MODEL)
    for t in ("Hello  world\n▁x é", "a", "", None, " ", " \n ", "日本語🙂 and", "\x00\t", "x" * 500, "🙂" * 60, "end  ", LONG[:20_000]):
        got = pieces.sample_segmentations(v, [t], [7], 4)[0]
        assert all(v.decode(ids) == (t or "") for ids, *_ in got)
        assert len({tuple(ids.tolist()) for ids, *_ in got}) == len(got)
        assert all(a[2] >= b[2] for a, b in zip(got, got[1:], strict=False))


def all_segmentations(v, text):
    lat = pieces.Lattice(v, [text])
    out, todo = {}, [(0, (), 0.0)]
    while todo:
        node, ids, log = todo.pop()
        if lat.end[node]:
            out[ids] = np.exp(log)
            continue
        for e in range(lat.edges):
            if lat.trie[node, e]:
                edge = node * lat.edges + e
                todo.append((node + int(v.length[lat.trie[node, e]]), ids + tuple(lat.ids(v, np.array([edge])).tolist()), log + np.log(lat.chance[node, e])))
    return out


def test_sampling_is_without_replacement_from_the_lattice():
    v = pieces.vocabulary(pieces.MODEL)
    exact = all_segmentations(v, "thing")
    assert abs(sum(exact.values()) - 1) < 1e-5
    n = 4000
    got = pieces.sample_segmentations(v, ["thing"] * n, list(range(n)), 3)
    first = Counter(tuple(g[0][0].tolist()) for g in got)
    for ids, p in exact.items():
        assert abs(first[ids] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3
    top = max(exact, key=exact.get)
    after = [tuple(g[1][0].tolist()) for g in got if tuple(g[0][0].tolist()) == top]
    second = Counter(after)
    for ids, p in exact.items():
        q = p / (1 - exact[top])
        if ids != top:
            assert abs(second[ids] / len(after) - q) < 5 * np.sqrt(q * max(0, 1 - q) / len(after)) + 1e-2
    # Inclusion scores make weighted sums of probabilities unbiased: here, of their total.
    assert abs(np.mean([sum(np.exp(x[1] - x[3]) for x in g) for g in got]) - 1) < 0.02
    assert len(pieces.sample_segmentations(v, ["thing"], [1], 10_000)[0]) == len(exact)


def test_pieces(spark, odd):
    got = pieces.sample_pieces(odd)
    rows = got.collect()
    assert all(r.exact for r in rows) and {(r.id, r.sample) for r in rows} >= {(1, 0), (2, 0), (4, 0), (4, 1)}
    assert len({tuple(r.ids) for r in rows if r.id == 5 and r.sample == 0}) == 1
    again = {(r.id, r.sample): r.ids for r in pieces.sample_pieces(odd.repartition(5)).collect()}
    assert again == {(r.id, r.sample): r.ids for r in rows}
    back = pieces.decode_pieces(got.where(F.col("id") == 6)).first()
    assert back.text == "日本 é ▁ 🙂\x00"
    assert pieces.sample_pieces(odd.limit(0)).count() == 0


def test_pieces_query_gives_pieces_and_what_they_decode_to(spark, tmp_path):
    """The rows hold the ids themselves, which the library's own decoder turns into the whole text, and the digest of their decoding."""
    import sentencepiece

    texts = {1: "A plain text, and a  wider\n\tone. " * 300, 2: "日本 é 🙂", 3: None, 4: "", 5: "a"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = pieces.op9_sentencepiece_sampling(spark, str(tmp_path)).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert {(r.doc_id, r.sample) for r in rows} == {(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (4, 0), (5, 0), (5, 1)}
    for r in rows:
        text = texts[r.doc_id] or ""
        assert model.decode(r.ids) == text and len(r.ids) == r.n_pieces and r.exact
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


# 10


def test_language(spark, odd):
    en, de = "the quick fox and this thing over there with that", "der schnelle fuchs und das ding über die strasse mit"
    rows = [(i, " ".join(np.random.default_rng(i).permutation((en if i % 2 else de).split())), "en" if i % 2 else "de") for i in range(60)]
    df = spark.createDataFrame([*rows, (900, None, "xx"), (901, "12 !!", "en"), (902, en, None)], "doc_id long, text string, lang string")
    langs, protos = langid.fit_languages(df, "lang", "text")
    assert langs == ["de", "en"]
    enc = langid.Encoder(1024, 7)
    want = sum(enc.bundle(*enc.grams(t)) for _, t, y in rows if y == "de")
    assert np.array_equal(protos[0], want)
    got = {r.id: r for r in langid.identify_languages(df, langs, protos).collect()}
    assert all(got[i].lang_pred == y and 0 < got[i].score <= 1 for i, _, y in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "en"
    assert langid.identify_languages(odd, langs, protos).count() == odd.count()
    empty = langid.fit_languages(df.limit(0), "lang", "text")
    assert empty[0] == [] and {r.lang_pred for r in langid.identify_languages(odd, *empty).collect()} == {"und"}
    x = langid.Encoder(64, 1)
    assert np.array_equal(x.vectors(np.array([ord("a") << 42 | ord("b") << 21 | ord("c")]))[0], np.roll(x._letter(97), 2) * np.roll(x._letter(98), 1) * x._letter(99))


def plain_vector(text, dim, seed):
    """A text's hypervector, letter by letter: the sum over trigrams of the product of rotated letter vectors, with gaps at word ends."""
    letters, out = {0: "gap"}, np.zeros(dim)
    vector = lambda c: np.random.Generator(np.random.Philox(key=[seed, c])).integers(0, 2, dim) * 2 - 1
    codes = [0]
    for ch in text:
        c = ord(ch.lower()) if ch.isalpha() else 0
        if c or codes[-1]:
            codes.append(c)
    codes += [0] if codes[-1] else []
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out


def test_languages_by_hand(spark):
    texts = [("en", "the cat and the dog"), ("en", "that other thing"), ("de", "der hund und die katze"), ("de", "das andere ding"), ("fr", "le chien et le chat")]
    df = spark.createDataFrame([(i, t, y) for i, (y, t) in enumerate(texts)] + [(9, "the other dog", None), (10, "und die katze!", None), (11, "le chat 12", None)], "doc_id long, text string, lang string")
    langs, protos = langid.fit_languages(df, "lang", "text", dim=256)
    own = {y: sum(plain_vector(t, 256, 7) for z, t in texts if z == y) for y in ("de", "en", "fr")}
    assert langs == ["de", "en", "fr"] and all(np.array_equal(p, own[y]) for y, p in zip(langs, protos, strict=True))
    for r in langid.identify_languages(df, langs, protos).collect():
        v = plain_vector(dict(enumerate(t for _, t in texts)).get(r.id) or {9: "the other dog", 10: "und die katze!", 11: "le chat 12"}[r.id], 256, 7)
        cos = {y: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for y, p in own.items()}
        assert r.lang_pred == max(cos, key=cos.get) and abs(r.score - max(cos.values())) < 1e-6
    small = langid.Encoder(64, 1, cache=8, most_letters=3)
    keys, counts = small.grams("many different letters here, 日本語もある")
    assert np.array_equal(small.bundle(keys, counts), langid.Encoder(64, 1).bundle(keys, counts)) and len(small.letter) <= 3


def test_one_row_of_equal_id_and_text(spark):
    rows = [(1, "same text", "s", k) for k in range(8)]
    kept = {simhash.dedup_simhash(spark.createDataFrame(rows[::d], "doc_id long, text string, source string, n int").repartition(n)).first().n for n, d in ((1, 1), (5, -1))}
    assert len(kept) == 1


def test_two_lazy_operators_keep_their_bounds(spark, monkeypatch):
    """Frames are cut in the worker: what another operator does in between, or the session says, doesn't matter."""
    df = spark.range(1000).select(F.col("id"), F.col("id").cast("string").alias("text")).coalesce(1)
    sizes = lambda batches: (pd.DataFrame({"n": [len(x)]}) for x in batches)
    a, b = common.map_slices(df, sizes, "n int", rows=64), common.map_slices(df, sizes, "n int", rows=300)
    assert max(r.n for r in a.collect()) == 64 and max(r.n for r in b.collect()) == 300 and sum(r.n for r in a.collect()) == 1000
    before = len(common._SAVED)
    with common.scratch():
        saved = common.save(df, "scratch-test")
        assert saved.count() == 1000
    assert len(common._SAVED) == before
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FILE_NOT_EXIST"):
        saved.count()


def test_saved_tables_leave_no_shuffle_files(spark, tmp_path):
    """save() deletes the shuffle files of its write itself, whether or not memory was collected, and leaves the session's setting."""
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    with common.scratch():
        before = tracker.shuffleStatuses().size()
        saved = common.save(spark.range(200_000).groupBy((F.col("id") % 1009).alias("k")).count(), "shuffle-test")
        assert tracker.shuffleStatuses().size() <= before and saved.count() == 1009
    assert spark.conf.get(common._DROP_SHUFFLES) == "false"


def test_passages_keep_only_the_tables_that_the_result_reads(spark):
    rng = np.random.default_rng(11)
    shared = [" ".join(prose(rng, 60)) for _ in range(3)]
    near = [shared[0], shared[0] + " and"]
    df = docs(spark, [(i, f"{a}\n{b}", "s") for i, (a, b) in enumerate([(shared[1], near[0]), (shared[2], near[1]), (shared[1], "x")])])
    with common.scratch():
        before = len(common._SAVED)
        got = substring_dedup.repeated_passages(df)
        left = {x._saved_at.rsplit("/", 1)[1].rsplit("-", 1)[0] for x in common._SAVED[before:]}
        assert left == {"paragraphs", "paragraphs-shared", "paragraphs-components", "paragraphs-clusters", "block-sizes"}
        assert {(r.doc, r.kept_doc) for r in got.collect()} == {(1, 0), (2, 0)}


def test_removal_leaves_the_rest(spark):
    assert substring_dedup.without_words("a b c", []) == "a b c"
    assert substring_dedup.without_words("a b\nc d\n\ne  f", [(1, 3)]) == "a\n\ne  f"
    rng = np.random.default_rng(8)
    shared, own = " ".join(prose(rng, 60)), " ".join(prose(rng, 50))
    rows = [(1, shared, "s"), (2, f"{own}\n{shared}\n\n tail  of it", "s"), (3, None, "s")]
    out = {r.doc_id: r for r in substring_dedup.drop_repeated(docs(spark, rows)).collect()}
    assert out[1].text == shared and out[1].n_removed == 0 and out[3].text is None
    assert out[2].text == f"{own}\n\n tail  of it" and out[2].n_removed > 0
