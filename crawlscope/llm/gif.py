"""Media columns: GIF. Decodes frames with palettes, disposal and transparency; writes lossless 8-bit frames."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.common import map_slices

#: The largest canvas, and the largest frame, that is decoded, in pixels; a file that names a larger one gives an error.
MAX_PIXELS = 1 << 24
FRAME_SCHEMA = "frame int, delay_ms int, x int, y int, width int, height int, disposal int, rgba binary, histogram array<int>"


class GifError(ValueError):
    """The bytes are no whole GIF."""


# --- LZW ---------------------------------------------------------------------------------------------------------


def _width_starts(size: int) -> np.ndarray:
    """Code widths by place after a clear code: the table grows by one with each code but the first, and the width with it."""
    known = (1 << size) + 1 + np.arange(4096 - (1 << size) - 1)  # the table before the code at that place: at most 4095 entries
    return np.maximum(size + 1, np.frexp(known.astype(float))[1]).astype(np.int64)


def _packed(codes: list[int], widths: np.ndarray) -> bytes:
    """Codes one after the other, low bit first."""
    ends = np.cumsum(widths)
    start = ends - widths
    shifted = np.asarray(codes, np.int64) << (start & 7)
    out = np.zeros((int(ends[-1]) + 7 >> 3) + 2, np.float64)
    for k in range(3):  # a code reaches into three bytes at most; bits of different codes never overlap, so sums are unions
        out += np.bincount((start >> 3) + k, (shifted >> 8 * k) & 255, len(out))
    return out[:-2].astype(np.uint8).tobytes()


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """GIF LZW codes of data, whose values are below 1 << size; the table is cleared when it is full."""
    clear, end = 1 << size, (1 << size) + 1
    step, first = _width_starts(size), np.array([size + 1])
    codes, widths = [clear], [first]
    if not data:
        return _packed([clear, end], np.concatenate([first, first]))
    add, rest = codes.append, iter(data)
    now, done = next(rest), False
    while not done:
        before = len(codes)
        entry: dict[int, int] = {}
        known, code = entry.setdefault, end + 1
        for c in rest:
            found = known(now << 8 | c, code)
            if found != code:
                now = found
                continue
            add(now)
            now, code = c, code + 1
            if code == 4096:
                add(clear)
                break
        else:
            codes += [now, end]
            done = True
        widths.append(step[: len(codes) - before])
    return _packed(codes, np.concatenate(widths))


def lzw_decode(stream: bytes, size: int, n_pixels: int) -> np.ndarray:
    """The values that a GIF LZW stream stands for, n_pixels at most.

    Between two clear codes the width of each code depends on its place alone, so all codes of such a segment are
    cut out at once. Entry m of the table is the string of the segment's code m and the first value after it, which
    is a piece of the output itself: each code copies from an earlier place of the output, and following these
    places by doubling leads every value back to a literal.
    """
    if not 1 <= size <= 11:
        raise GifError(f"LZW minimum code size {size}")
    clear, end = 1 << size, (1 << size) + 1
    raw = np.zeros(len(stream) + 3, np.int64)
    raw[: len(stream)] = np.frombuffer(stream, np.uint8)
    total, step, out, have, at = 8 * len(stream), _width_starts(size), [], 0, 0
    while have < n_pixels and at + size + 1 <= total:
        pieces, stop = [], None
        w = step
        while stop is None:
            ends = at + np.cumsum(w)
            k = int(np.searchsorted(ends, total, "right"))
            start = ends[:k] - w[:k]
            i = start >> 3
            codes = ((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) >> (start & 7)) & ((1 << w[:k]) - 1)
            special = np.flatnonzero((codes == clear) | (codes == end))
            if len(special):
                pieces.append(codes[: special[0]])
                stop, at = int(codes[special[0]]), int(ends[special[0]])
            else:
                pieces.append(codes)
                if k < len(w):
                    stop = end  # cut short
                else:  # a full table keeps 12-bit codes until the encoder clears it, however late
                    at, w = int(ends[-1]), np.full(4096, 12)
        values = _expand(np.concatenate(pieces), clear, n_pixels - have)
        out.append(values)
        have += len(values)
        if stop == end:
            break
    found = np.concatenate(out) if out else np.zeros(0, np.uint8)
    return found[:n_pixels]


def _expand(codes: np.ndarray, clear: int, most: int) -> np.ndarray:
    """The values of a segment's codes, as far as the code that reaches `most` of them: a small stream can stand for any number."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint8)
    order = np.arange(n)
    source = np.where(codes > clear, codes - clear - 2, order)  # the code whose string an entry starts with
    if (source > order).any() or codes[0] >= clear or ((codes > clear) & (source >= order)).any():
        raise GifError("an LZW code refers to an entry that isn't there yet")
    length, back = (codes > clear).astype(np.int64), source
    while (back != back[back]).any():  # steps back to a literal, by doubling
        length, back = length + length[back], back[back]
    length += 1
    n = min(n, int(np.searchsorted(np.cumsum(length), most)) + 1)
    codes, source, length = codes[:n], source[:n], length[:n]
    start = np.cumsum(length) - length
    place = np.arange(int(length.sum()))
    origin = np.where(codes > clear, start[source] - start, 0)
    step = np.repeat(origin, length)
    ref = place + step
    while (ref[ref] != ref).any():
        ref = ref[ref]
    literal = np.zeros(len(place), np.uint8)
    literal[start[codes < clear]] = codes[codes < clear]
    return literal[ref]


# --- container ---------------------------------------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(frames: list[tuple[np.ndarray, int]], palette: bytes, disposal: int = 1) -> bytes:
    """A GIF89a of frames (8-bit indices as rows x columns, delay in hundredths of a second) at the upper left corner."""
    h, w = max(f.shape[0] for f, _ in frames), max(f.shape[1] for f, _ in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0xF7, 0, 0), palette]
    for f, delay in frames:
        out += [b"\x21\xf9\x04", struct.pack("<BHB", disposal << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, f.shape[1], f.shape[0], 0), b"\x08"]
        out.append(_blocks(lzw_encode(f.tobytes())))
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """One image of a GIF as stored: indices into its palette, and how it goes onto the canvas."""

    indices: np.ndarray
    palette: np.ndarray
    x: int
    y: int
    delay_ms: int
    disposal: int
    transparent: int | None
    screen: tuple[int, int]


def read_frames(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF87a or GIF89a, one at a time; GifError where the file is broken or cut short."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    at = 13

    def palette(bits: int) -> np.ndarray:
        nonlocal at
        n = 3 * (2 << bits)
        if at + n > len(data):
            raise GifError("cut short in a palette")
        at += n
        return np.frombuffer(data[at - n : at], np.uint8).reshape(-1, 3)

    def body() -> bytes:
        nonlocal at
        parts = []
        while True:
            if at >= len(data) or at + 1 + data[at] > len(data):
                raise GifError("cut short in a data block")
            n = data[at]
            at += 1 + n
            if not n:
                return b"".join(parts)
            parts.append(data[at - n : at])

    shared = palette(flags & 7) if flags & 0x80 else None
    delay, disposal, clear = 0, 0, None
    while True:
        if at >= len(data):
            raise GifError("no trailer")
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            at += 1
            ext = body()
            if label == 0xF9 and len(ext) >= 4:
                packed, hundredths, index = struct.unpack_from("<BHB", ext)
                delay, disposal, clear = 10 * hundredths, packed >> 2 & 7, index if packed & 1 else None
        elif kind == 0x2C:
            if at + 9 > len(data):
                raise GifError("cut short in an image")
            x, y, fw, fh, packed = struct.unpack_from("<HHHHB", data, at)
            at += 9
            colours = palette(packed & 7) if packed & 0x80 else shared
            if colours is None:
                raise GifError("an image without a palette")
            size = data[at] if at < len(data) else 0
            at += 1
            if fw * fh > MAX_PIXELS:
                raise GifError(f"an image of {fw} x {fh} pixels")
            values = lzw_decode(body(), size, fw * fh)
            if len(values) < fw * fh:
                raise GifError(f"{len(values)} of {fw * fh} pixels")
            rows = values.reshape(fh, fw)
            if packed & 0x40:
                order = np.concatenate([np.arange(s, fh, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                rows = rows[np.argsort(order)]
            yield Frame(rows, colours, x, y, delay, disposal, clear, (w, h))
            delay, disposal, clear = 0, 0, None
        else:
            raise GifError(f"block {kind:#x}")


def composed(data: bytes) -> Iterator[tuple[Frame, np.ndarray]]:
    """Each frame with the RGBA canvas that a viewer shows at its time."""
    canvas = None
    for f in read_frames(data):
        if canvas is None:
            if f.screen[0] * f.screen[1] > MAX_PIXELS:
                raise GifError(f"a canvas of {f.screen[0]} x {f.screen[1]} pixels")
            canvas = np.zeros((f.screen[1], f.screen[0], 4), np.uint8)
        rows, cols = slice(f.y, max(f.y, min(f.y + f.indices.shape[0], f.screen[1]))), slice(f.x, max(f.x, min(f.x + f.indices.shape[1], f.screen[0])))
        before = canvas.copy() if f.disposal == 3 else None
        part = f.indices[: rows.stop - rows.start, : cols.stop - cols.start]
        colours = np.full((256, 4), 255, np.uint8)
        colours[: len(f.palette), :3] = f.palette
        shown = part != f.transparent if f.transparent is not None else np.ones(part.shape, bool)
        canvas[rows, cols][shown] = colours[part[shown]]
        yield f, canvas.copy()
        if f.disposal == 2:
            canvas[rows, cols] = 0
        elif before is not None:
            canvas = before


def histogram(rgba: np.ndarray) -> list[int]:
    """Counts of the visible pixels by the two high bits of red, green and blue: 64 numbers."""
    red, green, blue, alpha = (rgba.reshape(-1, 4)[:, k] for k in range(4))
    # Bins of what is seen; all that isn't is counted apart.
    bins = np.where(alpha > 0, red >> 6 << 4 | green >> 6 << 2 | blue >> 6, 64)
    return np.bincount(bins, minlength=65)[:64].tolist()


def decode_gifs(media: DataFrame, id_col: str = "media_id", data_col: str = "data") -> DataFrame:
    """One row for each frame of each GIF: (id, error, *FRAME_SCHEMA): timed, composed RGBA pixels and their colour histogram.

    Null or empty data gives one row with the error "no data"; a broken file gives the frames before the break and a
    last row with the error, and so does one whose canvas or frame has over MAX_PIXELS. Rows of GIFs that repeat are decoded again; other
    columns are ignored. One frame's canvas is in memory at a time.
    """
    kind = media.schema[id_col].dataType.simpleString()
    names = ["id", "error", *(x.split()[0] for x in FRAME_SCHEMA.split(", "))]

    def rows(key, data):
        n = 0
        try:
            if not data:
                raise GifError("no data")
            for f, canvas in composed(bytes(data)):
                yield key, None, n, f.delay_ms, f.x, f.y, f.indices.shape[1], f.indices.shape[0], f.disposal, canvas.tobytes(), histogram(canvas)
                n += 1
        except GifError as e:
            yield key, str(e), n, 0, 0, 0, 0, 0, 0, None, None

    def run(batches):
        for x in batches:
            for key, data in zip(x["id"], x["data"], strict=True):
                for row in rows(key, data):
                    yield pd.DataFrame([row], columns=names)

    cols = media.select(F.col(id_col).cast("string").alias("id"), F.col(data_col).alias("data"))
    return map_slices(cols, run, f"id string, error string, {FRAME_SCHEMA}", rows=64).withColumn("id", F.col("id").cast(kind))


# --- texts as media ----------------------------------------------------------------------------------------------

#: Rows of 192 pixels in a frame; its 48 KiB are what is coded and decoded at a time.
FRAME_ROWS = 256
GREYS = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def text_to_gif(text: str | None, width: int = 192) -> tuple[bytes, int]:
    """(GIF, bytes of the text): the UTF-8 bytes, filled up with spaces to rows of `width`, as grey frames of 40 ms."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw + b" " * (max(width, -(-len(raw) // width) * width) - len(raw))
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    return encode_gif([(pixels[i : i + FRAME_ROWS], 4) for i in range(0, len(pixels), FRAME_ROWS)], GREYS), len(raw)


def gif_payload(media: bytes) -> tuple[bytes, str]:
    """(payload, feature) from the stored bytes: the grey pixels of each frame as a viewer shows them, and a description of the timed
    frames: their number and time, the colour bins of most pixels, and a digest of each frame's delay and colour histogram."""
    frames, time, counts, parts, digest = 0, 0, np.zeros(64, np.int64), [], hashlib.md5()
    for f, canvas in composed(media):
        frames, time, hist = frames + 1, time + f.delay_ms, np.array(histogram(canvas))
        counts += hist
        digest.update(struct.pack("<I64q", f.delay_ms, *hist))
        parts.append(canvas[f.y : f.y + f.indices.shape[0], f.x : f.x + f.indices.shape[1], 0].tobytes())
    top = np.argsort(-counts, kind="stable")[:4]
    return b"".join(parts), f"frames={frames};ms={time};top={','.join(map(str, top))};hist={digest.hexdigest()[:16]}"


def texts_as_gifs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """(id, n_bytes, media, payload facts): each text stored as a GIF, read back from the stored bytes and described.

    A null text is stored as an empty one, which is one row of spaces. Rows that repeat give equal rows; other
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media

    def run(batches):
        for x in batches:
            rows = []
            for key, text in zip(x["id"], x["text"], strict=True):
                media, n = text_to_gif(text)
                payload, feature = gif_payload(media)
                row = (key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                rows.append((*row, media) if keep_media else row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    cols = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return map_slices(cols, run, schema, rows=64).withColumn("id", F.col("id").cast(kind))


def op6_gif_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return texts_as_gifs(docs, keep_media=False).withColumnRenamed("id", "doc_id")


ORACLE: dict[str, str] = {}
QUERIES = {"op6_gif_media": op6_gif_media}
