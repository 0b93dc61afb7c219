"""Language ID with hyperdimensional profiles: random letter vectors, permuted and bound into n-grams, bundled, compared by cosine."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import crc32_of_id, map_slices

#: Code points of a letter fit in 21 bits, so three of them fit in a 63-bit n-gram key; zero is the gap between words.
_BITS = 21


class Letters:
    """Code point to lower-case letter, or to the gap; filled in as code points are met."""

    def __init__(self) -> None:
        self.table = np.full(sys.maxunicode + 1, -1, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.table[codes]
        if (out < 0).any():
            for c in np.unique(codes[out < 0]).tolist():
                ch = chr(c)
                low = ch.lower()
                self.table[c] = 0 if not unicodedata.category(ch).startswith("L") else ord(low) if len(low) == 1 else c
            out = self.table[codes]
        return out


class Encoder:
    """Texts as bundles of n-gram vectors.

    Each letter has a random vector of +1 and -1, drawn from its code point and the seed. An n-gram of three is the
    product of its letters' vectors, the first rotated by two places and the second by one, so that order counts. A
    text's vector is the sum over its n-grams: integers, so the order of summing never matters.
    """

    def __init__(self, dim: int, seed: int, cache: int = 40_000, most_letters: int = 4_000) -> None:
        self.dim, self.seed, self.cache, self.most_letters = dim, seed, cache, most_letters
        self.letters = Letters()
        self.letter: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.rows = np.zeros((1024, dim), np.float32)

    def _letter(self, c: int) -> np.ndarray:
        if c not in self.letter:
            if len(self.letter) >= self.most_letters:
                self.letter.clear()
            self.letter[c] = (np.random.Generator(np.random.Philox(key=[self.seed, c])).integers(0, 2, self.dim) * 2 - 1).astype(np.float32)
        return self.letter[c]

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of the letter trigrams of the words with a gap around each; empty if there is no letter."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        x = self.letters(text).astype(np.int64)
        if not x.any():
            return none, none
        x = np.concatenate([[0], x, [0]])
        x = x[(x != 0) | np.concatenate([[True], x[:-1] != 0])]  # one gap between words
        return np.unique(x[:-2] << 2 * _BITS | x[1:-1] << _BITS | x[2:], return_counts=True)

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        place = self.place
        if len(place) + len(keys) > max(self.cache, len(keys)):
            place.clear()
        missing = [k for k in keys.tolist() if k not in place]
        if missing:
            need = len(place) + len(missing)
            if need > len(self.rows):
                grown = np.zeros((max(need, 2 * len(self.rows)), self.dim), np.float32)
                grown[: len(place)] = self.rows[: len(place)]
                self.rows = grown
            low = (1 << _BITS) - 1
            for k in missing:
                a, b, c = self._letter(k >> 2 * _BITS), self._letter(k >> _BITS & low), self._letter(k & low)
                self.rows[len(place)] = np.roll(a, 2) * np.roll(b, 1) * c
                place[k] = len(place)
        return self.rows[[place[k] for k in keys.tolist()]]

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the n-grams' vectors, in blocks so that a very long text needs no more memory."""
        out = np.zeros(self.dim)
        for i in range(0, len(keys), 4096):
            out += counts[i : i + 4096].astype(np.float32) @ self.vectors(keys[i : i + 4096])
        return out


def fit_languages(docs: DataFrame, lang_col: str, text_col: str, dim: int = 1024, seed: int = 7, max_langs: int = 1000) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes: the bundle of all their texts, from every row with a language and a letter.

    A task sends one vector for each language that it met; they are added by language and place with map-side
    combine. What reaches the driver is languages x dim numbers; more than max_langs languages are an error.
    """
    def run(batches):
        enc, total = Encoder(dim, seed), {}
        for x in batches:
            for lang, part in x.groupby("lang"):
                keys, counts = zip(*[enc.grams(t) for t in part["text"]], strict=True)
                keys, at = np.unique(np.concatenate(keys), return_inverse=True)
                if len(keys):
                    total.setdefault(lang, np.zeros(dim))
                    total[lang] += enc.bundle(keys, np.bincount(at, np.concatenate(counts)))
        for lang, v in total.items():
            yield pd.DataFrame({"lang": lang, "place": np.arange(dim, dtype=np.int32), "v": v})

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sums = map_slices(rows, run, "lang string, place int, v double").groupBy("lang", "place").agg(F.sum("v").alias("v"))
    whole = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("v"))
    found = sorted((r["lang"], r["v"]) for r in whole.limit(max_langs + 1).collect())
    if len(found) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    return [x for x, _ in found], np.array([v for _, v in found]).reshape(-1, dim)


def identify_languages(docs: DataFrame, langs: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """(id, lang_pred, score) for each row: the language whose prototype has the largest cosine with the text's vector.

    The score is the cosine, or 0 where it is negative. A null text, one without letters, and any text where nothing
    was learned are "und" with score 0. Equal cosines take the language first in order. Repeated rows get equal
    answers; other columns are ignored; an empty table gives no rows.
    """
    dim = prototypes.shape[1]
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = prototypes / np.where(norms > 0, norms, 1)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = Encoder(dim, seed)
        for x in batches:
            lang, score = [], []
            for t in x["text"]:
                keys, counts = enc.grams(t)
                if not len(keys) or not len(langs):
                    lang.append("und")
                    score.append(0.0)
                    continue
                v = enc.bundle(keys, counts)
                cos = np.round(unit @ v / max(np.linalg.norm(v), 1e-12), 9)
                lang.append(langs[int(np.argmax(cos))])
                score.append(float(np.clip(cos.max(), 0, 1)))
            yield pd.DataFrame({"id": x["id"], "lang_pred": lang, "score": score})

    cols = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return map_slices(cols, run, "id string, lang_pred string, score double").withColumn("id", F.col("id").cast(kind))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(3)) == 1, F.lit(False))
    langs, prototypes = fit_languages(docs.where(~held_out), "lang", "text")
    out = identify_languages(docs, langs, prototypes).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


ORACLE: dict[str, str] = {}
QUERIES = {"op10_language_id": op10_language_id}
