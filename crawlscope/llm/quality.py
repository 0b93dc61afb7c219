"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm.common import crc32_of_id, save

#: Words in a passage.
PASSAGE = 48
#: Rows of the embedding: hashed trigrams of bytes take the lower half, hashed words the upper one; row 0 stands for no word at all.
BUCKETS = 1 << 11
#: Shares that tell of a passage's shape: capitals among letters, digits, marks of any kind, different words, the commonest word, word length, words repeated at once.
N_SHAPE = 7
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Of bytes: other letters, ASCII capitals, digits, marks, white space.
_KINDS = np.array([1 if chr(c).isascii() and chr(c).isupper() else 2 if chr(c).isascii() and chr(c).isdigit() else 0 if chr(c).isalnum() or c > 127 else 4 if _SPACE[c] else 3 for c in range(256)])


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first id of each passage, first passage of each text, shapes) of whole texts: hashed trigrams and words, in case and as they
    stand, and N_SHAPE shares of each passage. A text without words is one passage with the id 0."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n\n".join([*raw, b""]), np.uint8)  # so that no trigram reaches into the next text
    text = np.repeat(np.arange(len(raw)), [len(r) + 2 for r in raw])
    space = _SPACE[data]
    inside = ~space
    start = inside.copy()
    start[1:] &= space[:-1]
    at = np.flatnonzero(start)
    n_words = np.bincount(text[at], minlength=len(raw))
    n_passages = np.maximum(-(-n_words // PASSAGE), 1)
    begin = np.cumsum(n_passages) - n_passages
    if not len(at):
        return np.zeros(len(raw), np.int32), np.arange(len(raw)), begin, np.zeros((len(raw), N_SHAPE))
    word = np.maximum(np.cumsum(start) - 1, 0)  # of each byte; white space belongs to the word before it
    place = np.arange(len(at)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    of_word = begin[text[at]] + place // PASSAGE
    x = np.where(space, 32, data).astype(np.uint32)
    gram = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    gram = (gram ^ gram >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(22)
    used = inside[:-2]
    gram_of = of_word[word[:-2][used]]
    factor = (np.minimum(np.arange(len(data)) - at[word], 63).astype(np.uint32) * np.uint32(2) + np.uint32(1)) * np.uint32(0x9E3779B1)
    whole = np.add.reduceat(np.where(space, 0, (x ^ factor) * (factor ^ np.uint32(0x7FEB352D))).astype(np.uint32), at, dtype=np.uint32)
    named = (whole ^ whole >> np.uint32(16)) * np.uint32(0x45D9F3B) >> np.uint32(22)
    none = np.flatnonzero(n_words == 0)
    ids = np.concatenate([1 + gram[used] % (BUCKETS // 2 - 1), BUCKETS // 2 + named, np.zeros(len(none), np.uint32)]).astype(np.int32)
    of = np.concatenate([gram_of, of_word, begin[none]])
    ids = ids[np.argsort(of, kind="stable")]
    count = np.bincount(of, minlength=int(n_passages.sum()))
    n = len(count)
    kinds = np.bincount(of_word[word] * 5 + _KINDS[data], minlength=5 * n).reshape(n, 5)
    size = np.maximum(np.bincount(of_word, minlength=n), 1)
    pairs, often = np.unique(of_word << 32 | whole, return_counts=True)
    different, most = np.bincount(pairs >> 32, minlength=n), np.zeros(n)
    np.maximum.at(most, pairs >> 32, often)
    again = np.bincount(of_word[1:][(whole[1:] == whole[:-1]) & (of_word[1:] == of_word[:-1])], minlength=n)
    seen = np.maximum(kinds[:, :4].sum(1), 1)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    shape = np.stack([kinds[:, 1] / letters, kinds[:, 2] / seen, kinds[:, 3] / seen, different / size, most / size, seen / size / 10, again / size], 1)
    shape[begin[none]] = 0
    return ids, np.cumsum(count) - count, begin, shape


def passages_by_parts(texts: list[str | None], size: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """passages(), of texts with some `size` characters at a time: what it needs beside its result, some 75 times the texts' size, follows
    a part and not the whole list. Each text is read whole."""
    ends = np.cumsum([len(t or "") for t in texts], dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), len(texts)]
    parts, n_ids, n_passages = [], 0, 0
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        ids, first_id, begin, shape = passages(texts[lo:hi])
        parts.append((ids, first_id + n_ids, begin + n_passages, shape))
        n_ids, n_passages = n_ids + len(ids), n_passages + len(first_id)
    ids, first_id, begin, shape = (np.concatenate(x) for x in zip(*parts, strict=True))
    return ids, first_id, begin, shape


class AttentionMIL:
    """score = sigmoid(c . z + c0), z = sum a_k h_k, h_k = tanh(W x_k + b), a = softmax(w . (tanh(V h_k) * sigmoid(U h_k))).

    x_k, the encoding of passage k, is the mean of learned embeddings E of its hashed trigrams and words, beside its standardized shape.
    """

    def __init__(self, dim: int = 8, hidden: int = 16, gate: int = 8, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"E": rng.normal(0, 0.02, (BUCKETS, dim)), "W": draw(dim + N_SHAPE, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "c0": np.zeros(1)}
        self.mean, self.std = np.zeros(N_SHAPE), np.ones(N_SHAPE)
        self.constant: float | None = None
        self.seed = seed

    def standard(self, shape: np.ndarray) -> np.ndarray:
        return np.clip((shape - self.mean) / self.std, -6, 6)

    def encode(self, ids: np.ndarray, first: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """The passages' encodings, some at a time: what is in memory doesn't follow the texts' length."""
        ends, out = np.append(first[1:], len(ids)), np.zeros((len(first), self.p["E"].shape[1]))
        table = self.p["E"]
        for lo in range(0, len(first), 512):
            hi = min(lo + 512, len(first))
            a, b = first[lo], ends[hi - 1]
            out[lo:hi] = np.add.reduceat(table[ids[a:b]], first[lo:hi] - a) / (ends[lo:hi] - first[lo:hi])[:, None]
        return np.concatenate([out, self.standard(shape)], 1)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (v * u) @ p["w"]
        size = np.diff(np.append(first, len(x)))
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
        a /= np.repeat(np.add.reduceat(a, first), size)
        z = np.add.reduceat(a[:, None] * h, first)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -30, 30)))
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "s": s, "size": size}

    def gradient(self, ids: np.ndarray, first_id: np.ndarray, first: np.ndarray, shape: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of these texts, by each parameter."""
        p, n_ids = self.p, np.diff(np.append(first_id, len(ids)))
        place = np.repeat(np.arange(len(first_id)) * BUCKETS, n_ids) + ids
        share = (np.bincount(place, minlength=len(first_id) * BUCKETS).reshape(-1, BUCKETS) / n_ids[:, None]).astype(np.float32)
        x = np.concatenate([(share @ p["E"].astype(np.float32)).astype(float), self.standard(shape)], 1)
        f = self.forward(x, first)
        spread = lambda q: np.repeat(q, f["size"], axis=0)
        ds = (f["s"] - y) / len(y)
        dz = ds[:, None] * p["c"]
        da = (spread(dz) * f["h"]).sum(1)
        de = f["a"] * (da - spread(np.add.reduceat(f["a"] * da, first)))
        dv, du = de[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2), de[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
        dh = (f["a"][:, None] * spread(dz) + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        dx = (dh @ p["W"][: p["E"].shape[1]].T).astype(np.float32)
        return {
            "E": (share.T @ dx).astype(float), "W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du,
            "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ ds, "c0": ds.sum(keepdims=True),
        }

    def fit(self, texts: list[str | None], y: np.ndarray, epochs: int = 24, batch: int = 1024, rate: float = 0.02, decay: float = 1e-3) -> AttentionMIL:
        """Adam over batches of some `batch` passages; embeddings, of which there are many, take smaller steps."""
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        ids, first_id, begin, shape = passages_by_parts(texts)
        self.mean, self.std = shape.mean(0), np.maximum(shape.std(0), 1e-3)
        ends, bag_ends = np.append(first_id[1:], len(ids)), np.append(begin[1:], len(first_id))
        rng = np.random.default_rng(self.seed)
        m1, m2 = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            group = np.cumsum((bag_ends - begin)[order]) // batch
            for g in np.unique(group):
                some = order[group == g]
                n = bag_ends[some] - begin[some]
                rows = np.repeat(begin[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
                m = ends[rows] - first_id[rows]
                places = np.repeat(first_id[rows] - np.cumsum(m) + m, m) + np.arange(m.sum())
                grad = self.gradient(ids[places], np.cumsum(m) - m, np.cumsum(n) - n, shape[rows], y[some])
                t += 1
                for k, q in grad.items():
                    q = q + decay * self.p[k] * (k not in ("b", "c0"))
                    m1[k] += 0.1 * (q - m1[k])
                    m2[k] += 0.01 * (q * q - m2[k])
                    step = rate * 0.1 if k == "E" else rate
                    self.p[k] = self.p[k] - step * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)
        self.p["E"] = self.p["E"].astype(np.float32)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        ids, first_id, first, shape = passages(texts)
        return self.forward(self.encode(ids, first_id, shape), first)["s"]


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_docs: int = 4000,
    max_bytes: int = 6_000_000,
    seed: int = 11,
) -> AttentionMIL:
    """A model fitted on labelled documents for which `train`, a condition on the id, holds.

    The sample is bounded: of the max_docs documents whose hashed ids come first, those whose texts have max_bytes in all, in that
    order, without ones of over a hundredth of it. Documents with differing labels, or none, aren't in it. Its ids are
    broadcast to find the texts, and those, max_bytes at most, reach the driver.
    """
    each = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & train).groupBy(F.col(id_col).alias("id"))
    one = each.agg(F.min(label_col).alias("y"), F.max(label_col).alias("most")).where(F.col("y") == F.col("most"))
    few = one.select("id", "y").orderBy(F.md5(F.col("id").cast("string")), "id").limit(max_docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    met = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(few), "id").where(F.octet_length("text") <= max_bytes // 100)
    met = save(met.groupBy("id").agg(F.min(F.struct("text", "y")).alias("r")).select(F.md5(F.col("id").cast("string")).alias("k"), "id", "r.*"), "quality-sample")
    # At most max_docs rows: their lengths add up in one task.
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy("k", "id"))
    got = met.withColumn("so_far", so_far).where(F.col("so_far") <= max_bytes).orderBy("k", "id").select("text", "y").collect()
    return AttentionMIL(seed=seed).fit([r["text"] for r in got], np.array([float(r["y"]) for r in got]))


def score_quality(docs: DataFrame, model: AttentionMIL, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score (double, 0 to 1, higher: label 1 likelier) of each whole text.

    Null and empty texts are one passage without words, and get what the model says of that. A model without two
    classes to learn from gives the share of class 1, or 0.5. Equal texts get equal scores. A column that has the
    score's name is replaced.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        # Some texts at a time: what is made of them takes many times their size.
        parts = [model.score(texts.iloc[i : i + 128].to_list()) for i in range(0, len(texts), 128)]
        return pd.Series(np.round(np.concatenate(parts), 9) if parts else [], dtype=float)

    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != score_col.lower()]
    return docs.select(*rest, score(F.col(text_col)).alias(score_col))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(crc32_of_id(F.col(id_col)), F.lit(5)) == 0, F.lit(False))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit_quality(docs, labels, ~held_out())
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


ORACLE: dict[str, str] = {}
QUERIES = {"op8_quality_classifier": op8_quality_classifier}
