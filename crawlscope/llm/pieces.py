"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k over the lattice of pieces."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from crawlscope.llm.common import release_memory, slices

#: Where the public model file lies; a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters whose lattices are in a worker's memory at once.
CHARS = 250_000
_CODE = 21  # bits of a code point
#: About what a character costs, in log-probability: weights are scaled by it, so that sums over long words stay in range.
_PER_CHAR = 3.0


class Vocabulary:
    """Pieces of a SentencePiece model in a trie, each with a log-probability.

    The model stores merge ranks, no probabilities: a piece of rank r gets Zipf's law, 1 / (r + shift), normalized;
    bytes, which stand for characters without a piece, come after the last rank. A space stands for the meta
    symbol, so a meta symbol that is in a text is a character without a piece, and decoding gives it back.
    """

    def __init__(self, path: str, shift: float = 10.0) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        usable = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        usable.sort(key=lambda i: (-model.get_score(i), i))
        self.byte_id = np.zeros(256, np.int32)
        self.bytes_of: list[bytes] = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
        total = np.log(sum(1 / (r + shift) for r in range(len(usable) + 256)))
        self.byte_log = -np.log(len(usable) + shift) - total
        nodes: dict[tuple[int, int], int] = {}
        piece, log = [-1], [0.0]
        for r, i in enumerate(usable):
            text = model.id_to_piece(i).replace("▁", " ")
            self.bytes_of[i] = text.encode()
            if "\n" in text or " " in text.lstrip(" "):
                raise ValueError("a piece crosses a word's end: the lattice can't be cut at words")
            at = 0
            for ch in text:
                key = (at, ord(ch))
                if key not in nodes:
                    nodes[key] = len(piece)
                    piece.append(-1)
                    log.append(0.0)
                at = nodes[key]
            piece[at], log[at] = i, -np.log(r + shift) - total
        self.spelled = np.array([*self.bytes_of, b""], object)[:-1]
        self.packed = pa.array(self.bytes_of, pa.large_binary())
        # An open-addressed table: a key lies at its place or one of the `probes` next ones.
        self.shift = np.uint64(64 - 20)
        self.keys, self.child = np.full((1 << 20) + 64, -1, np.int64), np.zeros((1 << 20) + 64, np.int32)
        keys = np.array([a << _CODE | c for a, c in nodes], np.int64)
        self.probes = 0
        for key, place, child in zip(keys.tolist(), self.places(keys).tolist(), nodes.values(), strict=True):
            at = place
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.child[at] = key, child
            self.probes = max(self.probes, at - place + 1)
        # After the trie's own nodes come those of characters spelled in bytes: one for each ASCII byte, one for each longer width.
        self.n_trie = len(piece)
        length = np.zeros(len(piece) + 131)
        for (at, _), child in nodes.items():
            length[child] = length[at] + 1
        length[self.n_trie :] = 1
        self.length = length.astype(np.int64)
        self.piece = np.array([*piece, *self.byte_id[:128].tolist(), -1, -1, -1], np.int32)
        self.whole = self.piece >= 0
        log = np.array([*log, *[self.byte_log] * 128, *[k * self.byte_log for k in (2, 3, 4)]])
        self.weight = np.where(self.whole | (np.arange(len(log)) >= self.n_trie), np.exp(log + _PER_CHAR * length), 0.0).astype(np.float32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def step(self, trie: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the trie nodes have a child for their code, these children)."""
        key = trie.astype(np.int64) << _CODE | codes
        place = self.places(key)
        there = self.keys.take(place)
        found = there == key
        child = self.child.take(place)
        other = np.flatnonzero(~found & (there >= 0))
        for k in range(1, self.probes):
            if not len(other):
                break
            at = place[other] + k
            hit = self.keys[at] == key[other]
            found[other[hit]] = True
            child[other[hit]] = self.child[at[hit]]
            other = other[~hit & (self.keys[at] >= 0)]
        return found, child[found]

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids, exactly as it was; without the space that encoding puts first."""
        raw = b"".join(self.spelled[ids].tolist())
        return raw[1:].decode("utf-8", "surrogatepass")

    def decode_each(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """What decode() gives for each run of ids from one of `cuts` to the next, in UTF-8: the spelled pieces lie in one buffer."""
        _, ends, data = self.packed.take(pa.array(ids)).buffers()
        raw, at = memoryview(data or b""), np.frombuffer(ends, np.int64, len(ids) + 1)[cuts].tolist()
        return [bytes(raw[a + 1 : b]) for a, b in zip(at, at[1:], strict=False)]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from counters: SplitMix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(12)).astype(np.float64) * 2.0**-52 + 2.0**-53


def _base(seed: int, *parts: int) -> np.uint64:
    """Where a stream of counters begins: of a text's seed and what the stream is for."""
    return np.uint64(xxhash.xxh64_intdigest(np.array([seed, *parts], np.uint64).tobytes()))


#: Between the streams of neighbouring words.
_STRIDE = np.uint64(0x632BE59BD9B4E019)


def _streams(base: np.uint64, words: np.ndarray) -> np.ndarray:
    return base + words.astype(np.uint64) * _STRIDE


def _one(base: np.uint64) -> float:
    return float(_uniform(np.array([base]))[0])


class Lattice:
    """The lattices of different words, each with a space put first, side by side. A row of a matrix is a node, a column one of its edges, by length."""

    def __init__(self, v: Vocabulary, words: list[str]) -> None:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.start = np.cumsum(size + 1) - size - 1  # of each word: its first node; its last one is the end
        n = int((size + 1).sum())
        codes = np.zeros(n, np.int64)
        word = np.repeat(np.arange(len(words)), size)
        node = np.arange(len(word)) + word
        if words:
            codes[node] = np.frombuffer((" " + " ".join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes, self.end = codes, np.ones(n, bool)
        self.end[node] = False
        left = np.zeros(n, np.int64)
        left[node] = self.start[word] + size[word] - node
        found, at, trie, depth = [], node, np.zeros(len(node), np.int32), 0
        n_edges = np.zeros(n, np.int64)
        while len(at):
            hit, trie = v.step(trie, codes.take(at + depth))
            at = at[hit]
            depth += 1
            here = v.whole[trie]
            if depth == 1:  # characters without a piece of their own are spelled in bytes
                spelled = ~self.end
                spelled[at[here]] = False
                alone = np.flatnonzero(spelled)
                c = codes[alone]
                found.append((alone, n_edges[alone], v.n_trie + np.where(c < 128, c, 127 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))))
                n_edges[alone] += 1
            p = at[here]
            k = n_edges[p]
            found.append((p, k, trie[here]))
            n_edges[p] = k + 1
            more = left[at] > depth
            at, trie = at[more], trie[more]
        e = int(n_edges.max(initial=1))
        self.edges, self.v = e, v
        self.trie = np.zeros((n, e), np.int32)  # the trie's node says length, piece and weight; its root is no edge
        for p, k, t in found:
            self.trie.ravel()[p * e + k] = t
        # The sum over all ways to a word's end, nodes nearest to it first; then each edge's probability given its node.
        total, ones = np.ones(n, np.float32), np.ones(e, np.float32)
        self.chance = np.zeros((n, e), np.float32)
        order = node[np.argsort(left[node].astype(np.int32), kind="stable")]
        cuts = np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2))
        for far, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), 1):
            rows, w = order[a:b], min(e, far)  # no more edges than characters to go
            t = self.trie[rows, :w]
            x = v.weight.take(t) * total.take(rows[:, None] + v.length.take(t))
            some = x @ ones[:w]
            total[rows] = some
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                self.chance[rows, :w] = x / some[:, None]
        fine = (total[node] > 1e-30) & (total[node] < 1e30)
        if not fine.all():  # words too unlike the usual cost of a character: once more, in logarithms
            self._in_logs(np.unique(word[~fine]), size, left)
        self.upto = self.chance.copy()
        for k in range(1, e):
            self.upto[:, k] += self.upto[:, k - 1]
        last = np.arange(n) * e + np.maximum(n_edges - 1, 0)
        self.upto.ravel()[last] = 2
        self.upto[:, 1:][self.trie[:, 1:] == 0] = 2

    def _in_logs(self, words: np.ndarray, size: np.ndarray, left: np.ndarray) -> None:
        rows = np.concatenate([self.start[w] + np.arange(size[w]) for w in words.tolist()])
        rows = rows[np.argsort(left[rows], kind="stable")]
        total = np.zeros(len(self.end))
        cuts = np.searchsorted(left[rows], np.arange(1, int(left[rows].max()) + 2))
        with np.errstate(divide="ignore"):
            log = np.log(self.v.weight[self.trie[rows]].astype(np.float64))
        for a, b in zip(cuts, cuts[1:], strict=False):
            r = rows[a:b]
            x = log[a:b] + total[r[:, None] + self.v.length[self.trie[r]]]
            top = x.max(axis=1)
            p = np.exp(x - top[:, None])
            total[r] = top + np.log(p.sum(axis=1))
            self.chance[r] = p / p.sum(axis=1, keepdims=True)

    def walk(self, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random way to the end from each node: (edges of all ways one after the other, how many of each)."""
        node, count = node.copy(), np.zeros(len(node), np.int64)
        active, steps, k, flat = np.arange(len(node)), [], 0, self.trie.ravel()
        while len(active):
            at = node[active]
            u = _uniform(seed[active] + np.uint64(k))
            pick = (self.upto.take(at, axis=0) > u[:, None].astype(np.float32)).argmax(axis=1)
            edge = at * self.edges + pick
            steps.append((active, edge))
            count[active] += 1
            nxt = at + self.v.length.take(flat.take(edge))
            node[active] = nxt
            active = active[~self.end[nxt]]
            k += 1
        first = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int64)
        for k, (a, edge) in enumerate(steps):
            out[first[a] + k] = edge
        return out, count

    def ids(self, v: Vocabulary, edges: np.ndarray) -> np.ndarray:
        ids = v.piece.take(self.trie.ravel().take(edges))
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids
        parts, last = [], 0
        for i in odd.tolist():
            raw = chr(self.codes[edges[i] // self.edges]).encode("utf-8", "surrogatepass")
            parts += [ids[last:i], v.byte_id[np.frombuffer(raw, np.uint8)]]
            last = i + 1
        return np.concatenate([*parts, ids[last:]])


_WORDS = re.compile(r" *[^ ]+| +")


def _words(text: str) -> list[str]:
    """The words of a text with a space put first, each without its own first space."""
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [w[1:] for w in _WORDS.findall(f" {text}")]
    return text.split(" ")


class _Search:
    """The agenda of one text. A hypothesis is a place on a found way where another edge is to be taken; its priority is
    the perturbed log-probability of the best segmentation behind it."""

    def __init__(self, seed: int, nodes: np.ndarray) -> None:
        self.seed, self.nodes = seed, nodes
        self.ways: list[np.ndarray] = []  # edges
        self.word_of: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []
        self.value: list[float] = []  # perturbed log-probabilities
        self.free: list[np.ndarray] = []  # hypotheses before they are cut off at the way's value, which keeps their order
        self.again: dict[tuple[int, int], float] = {}  # those that were taken from before, and are cut off elsewhere
        self.taken: dict[tuple[int, int], list[int]] = {}

    def add(self, lat: Lattice, edges: np.ndarray, word_of: np.ndarray, value: float, since: int) -> None:
        """A way with its perturbed log-probability; hypotheses are opened from edge `since` on."""
        r = len(self.ways)
        chance = lat.chance.ravel().take(edges).astype(np.float64)
        log = np.log(chance)
        rest = 1 - chance[since:]
        close = np.flatnonzero(rest < 1e-3)  # there the difference is lost in rounding: add up the other edges
        if len(close):
            node, k = np.divmod(edges[since:][close], lat.edges)
            others = lat.chance[node].astype(np.float64)
            others[np.arange(len(k)), k] = 0
            rest[close] = others.sum(axis=1)
        u = _uniform(_base(self.seed, 2, r) + np.arange(len(rest), dtype=np.uint64))
        free = np.full(len(edges), -np.inf)
        with np.errstate(divide="ignore"):
            free[since:] = (np.cumsum(log) - log)[since:] + np.log(rest / -np.log(u))
        self.ways.append(edges)
        self.word_of.append(word_of)
        self.logs.append(log)
        self.value.append(value)
        self.free.append(free)

    def best(self) -> tuple[float, int, int]:
        """(priority, way, place) of the first hypothesis; place -1 if there is none."""
        top = (-np.inf, 0, -1)
        for r, free in enumerate(self.free):
            t = int(np.argmax(free))
            if free[t] > -np.inf:
                top = max(top, (float(-np.logaddexp(-self.value[r], -free[t])), r, t))
        for (r, t), value in self.again.items():
            top = max(top, (value, r, t))
        return top

    def branch(self, lat: Lattice, value: float, r: int, t: int) -> int:
        """Take another edge at place t of way r, and leave the rest of its siblings as a hypothesis below this value."""
        node, e = divmod(int(self.ways[r][t]), lat.edges)
        taken = self.taken.setdefault((r, t), [e])
        p = lat.chance[node].astype(np.float64)
        p[taken] = 0
        upto = np.cumsum(p)
        pick = int(np.searchsorted(upto, _one(_base(self.seed, 3, len(self.ways))) * upto[-1]))
        while p[pick] == 0:
            pick -= 1
        taken.append(pick)
        p[pick] = 0
        self.free[r][t] = -np.inf
        self.again.pop((r, t), None)
        if p.sum() > 0:
            free = self.logs[r][:t].sum() + np.log(p.sum() / -np.log(_one(_base(self.seed, 4, len(self.ways)))))
            self.again[r, t] = float(-np.logaddexp(-value, -free))
        return node * lat.edges + pick


def sample_segmentations(v: Vocabulary, texts: list[str | None], seeds: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k different segmentations: (piece ids, log-probability, perturbed one, log of its inclusion score).

    This draws without replacement from the distribution that the lattice gives whole texts, exactly: a search from the
    left in the order of Gumbel-perturbed log-probabilities (A* with the exact log-sums as its heuristic). The best
    way behind a hypothesis inherits its priority, so each search step completes one way at once, and each place
    on it keeps all the edges not taken as one hypothesis, whose priority is a Gumbel variable of their joint mass,
    cut off at the priority of the way. No word's segmentations are enumerated. Words are independent given their
    ends, as no piece crosses them, so the ways of all texts of a batch advance together.

    The inclusion score of a segmentation of probability p is 1 - exp(-p / exp(t)) with t the priority of the first one
    left out; 1 if none is. A text with fewer segmentations gives them all. None and "" give one without pieces.
    """
    index: defaultdict[str, int] = defaultdict()
    index.default_factory = index.__len__
    chunks = [list(map(index.__getitem__, _words(t))) if t else [] for t in texts]
    lat = Lattice(v, list(index))
    searches = [_Search(s, lat.start[np.array(c, np.int64)]) for s, c in zip(seeds, chunks, strict=True)]
    live = [s for s in searches if len(s.nodes)]

    def advance(starts: list[np.ndarray], seeds: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        if not starts:
            return []
        edges, count = lat.walk(np.concatenate(starts), np.concatenate(seeds))
        ends = np.cumsum(count)
        lens = np.cumsum([len(x) for x in starts])
        out = []
        for a, b in zip([0, *lens[:-1]], lens, strict=True):
            lo = int(ends[a - 1]) if a else 0
            hi = int(ends[b - 1]) if b > a else lo
            out.append((edges[lo:hi], count[a:b]))
        return out

    ways = advance([s.nodes for s in live], [_streams(_base(s.seed, 1, 0), np.arange(len(s.nodes))) for s in live])
    for s, (edges, count) in zip(live, ways, strict=True):
        gumbel = float(-np.log(-np.log(_one(_base(s.seed, 0)))))
        s.add(lat, edges, np.repeat(np.arange(len(count)), count), gumbel, 0)
    for r in range(1, k):
        todo = []
        for s in live:
            value, way, t = s.best()
            if t < 0 or len(s.ways) < r:
                continue
            edge = s.branch(lat, value, way, t)
            w = int(s.word_of[way][t])
            nxt = edge // lat.edges + int(v.length[lat.trie.ravel()[edge]])
            inside = [] if lat.end[nxt] else [nxt]
            words = np.arange(w + 1 - len(inside), len(s.nodes))
            todo.append((s, value, way, t, edge, w, words, np.concatenate([np.array(inside, np.int64), s.nodes[w + 1 :]])))
        ways = advance([x[7] for x in todo], [_streams(_base(x[0].seed, 1, r), x[6]) for x in todo])
        for (s, value, way, t, edge, w, words, _), (edges, count) in zip(todo, ways, strict=True):
            s.add(
                lat,
                np.concatenate([s.ways[way][:t], [edge], edges]),
                np.concatenate([s.word_of[way][:t], [w], np.repeat(words, count)]),
                value,
                t + 1,
            )
    out = []
    for s in searches:
        if not len(s.nodes):
            out.append([(np.zeros(0, np.int32), 0.0, 0.0, 0.0)])
            continue
        left = s.best()[0]
        got = []
        for edges, log, value in zip(s.ways, s.logs, s.value, strict=True):
            p = float(log.sum())
            with np.errstate(under="ignore"):
                x = p - left
                inclusion = 0.0 if left == -np.inf or x > 30 else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else x
            got.append((lat.ids(v, edges), p, value, inclusion))
        out.append(got)
    return out


def sample_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_samples: int = 2, model: str = MODEL, seed: int = 5, digest: bool = False
) -> DataFrame:
    """(id, sample, n_pieces, ids, log_prob, perturbed, log_inclusion, exact): n_samples distinct segmentations of each whole text.

    exact says that decoding the ids gives the text back. Samples are seeded by the id and `seed`, so a retry or another
    partitioning gives the same; rows that repeat an id and text get equal samples. A null or empty text has one
    sample without pieces; short texts may have fewer segmentations than n_samples. Other columns are ignored. With
    digest, ids_sha256, of the little-endian 32-bit form of ids, and decoded_sha256, of what they decode to in UTF-8, follow.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = "id string, sample int, n_pieces int, ids array<int>, log_prob double, perturbed double, log_inclusion double, exact boolean"
    schema += ", ids_sha256 string, decoded_sha256 string" if digest else ""

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        v = vocabulary(model)
        for x in slices(batches, 1024):
            keys, texts = x.column("id").to_pylist(), x.column("text").to_pylist()
            seeds = [xxhash.xxh64_intdigest(str(k), seed) for k in keys]
            # Texts of some CHARS at a time (a longer one alone), so that memory follows neither batches nor long texts' number.
            part = np.cumsum([len(t or "") for t in texts]) // CHARS
            for lo, hi in zip(cuts := np.unique(part, return_index=True)[1], [*cuts[1:], len(texts)], strict=True):
                found = sample_segmentations(v, texts[lo:hi], seeds[lo:hi], n_samples)
                rows = [(k, r, *s) for k, g in enumerate(found, lo) for r, s in enumerate(g)]
                of, sample, pieces, *scores = zip(*rows, strict=True)
                ids = np.concatenate(pieces).astype("<i4")
                ends = np.append(0, np.cumsum([len(p) for p in pieces]))
                told = v.decode_each(ids, ends)
                want = [(t or "").encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
                cols = [[keys[k] for k in of], sample, np.diff(ends).astype(np.int32), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), *scores]
                cols.append([t == want[k - lo] for t, k in zip(told, of, strict=True)])
                if digest:
                    cols += [[hashlib.sha256(r).hexdigest() for r in raw] for raw in (np.split(ids, ends[1:-1]), told)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)
                del found, rows, pieces, cols
            release_memory()

    cols = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(run, schema).withColumn("id", F.col("id").cast(kind))


def decode_pieces(pieces: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """pieces with the decoded text of ids_col (array<int>); null ids give null. A column that has the text's name is replaced."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        v = vocabulary(model)
        return ids.map(lambda i: None if i is None else v.decode(np.asarray(i, np.int64)))

    rest = [F.col(f"`{c}`") for c in pieces.columns if c.lower() != text_col.lower()]
    return pieces.select(*rest, decode(F.col(ids_col)).alias(text_col))


def op9_sentencepiece_sampling(spark, sf_dir: str) -> DataFrame:
    """Both halves: the pieces that encode each whole text, and whether and to what (as a digest) they decode."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sample_pieces(docs, digest=True).withColumnRenamed("id", "doc_id")


ORACLE: dict[str, str] = {}
QUERIES = {"op9_sentencepiece_sampling": op9_sentencepiece_sampling}
