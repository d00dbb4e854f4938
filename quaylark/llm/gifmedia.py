"""GIF media columns: writing samples as frames, and decoding any GIF into timed frames.

The decoder reads LZW code streams of any code size, global and local palettes,
interlacing, the four disposal methods and transparency, and keeps each composed frame
with its start, its duration and its histograms (brightness, and each colour channel).
A code that is not a literal repeats earlier output of its clear segment, so a stream is
expanded by array operations: lengths and sources follow chains of pointers that are
halved each step.

The writer stores 8-bit samples under a grey palette of 256 entries as LZW streams with
growing codes and a full table before each clear code.

Edge cases: a null or empty text is one row of 255s; media that are null or no GIF give
null frames and payload; equal texts give equal bytes; repeated rows give one row each;
a broken file, or one whose canvas exceeds ``MAX_PIXELS``, gives the frames before the
break and ``complete`` false; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, slices, texts_of

WIDTH, ROWS, FILL, DELAY_CS = 576, 64, 255, 10
BINS = 16
#: Greatest canvas that is decoded (a composed frame takes 4 bytes a pixel).
MAX_PIXELS = 1 << 24
#: Codes between two clear codes: the entry of the last of them fills the table of 4096.
RUN = 4096 - 258
FRAMES = "array<struct<start_ms:int,duration_ms:int,left:int,top:int,width:int,height:int,histogram:array<int>,colours:array<int>>>"


# --- LZW ---------------------------------------------------------------------


def _widths(size: int, codes: int) -> np.ndarray:
    """Bits of the first ``codes`` codes after a clear code, for a minimum code size."""
    room = np.maximum((1 << size) + 1 + np.arange(codes), 1)
    room[:1] = 1
    return np.minimum(12, np.maximum(size + 1, np.floor(np.log2(room)).astype(np.int64) + 1))


_SEGMENT = _widths(8, RUN + 1)


def lzw_write(samples: np.ndarray) -> bytes:
    """LZW stream (minimum code size 8): each code takes the longest entry of the table, a full table is cleared."""
    codes: list[int] = []
    table: dict[int, int] = {}
    free, word = 258, -1
    for c in samples.tobytes():
        if word < 0:
            word = c
            continue
        longer = table.get(word << 8 | c)
        if longer is not None:
            word = longer
            continue
        codes.append(word)
        if free == 4095:
            table, free = {}, 258
        else:
            table[word << 8 | c] = free
            free += 1
        word = c
    if word >= 0:
        codes.append(word)
    runs = max(1, -(-len(codes) // RUN))
    stream = np.insert(np.array(codes, np.int64), np.arange(1, runs) * RUN, 256)  # a clear code after each full segment
    widths = np.tile(_SEGMENT, runs)[: len(stream) + 1]  # the end code follows
    stream, widths = np.concatenate([[256], stream, [257]]), np.concatenate([[9], widths])
    at = np.cumsum(widths) - widths
    shifted, byte = stream << (at & 7), at >> 3
    size = -(-int(at[-1] + widths[-1]) // 8)
    out = np.zeros(size + 2)
    for i in range(3):  # codes do not share bits, so their sum is their union
        out += np.bincount(byte + i, (shifted >> (8 * i)) & 255, size + 2)
    return out[:size].astype(np.uint8).tobytes()


class _Bits:
    def __init__(self, data: bytes):
        self.n = 8 * len(data)
        self.bytes = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)

    def read(self, at: np.ndarray, widths: np.ndarray) -> np.ndarray:
        byte = at >> 3
        word = self.bytes[byte] | (self.bytes[byte + 1] << 8) | (self.bytes[byte + 2] << 16)
        return ((word >> (at & 7).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)).astype(np.int64)


def lzw_codes(data: bytes, size: int) -> Iterator[np.ndarray]:
    """Codes of each clear segment of a stream, without clear and end codes."""
    clear, end = 1 << size, (1 << size) + 1
    bits, at = _Bits(data), 0
    reach = 4096
    while True:
        widths = _widths(size, reach + 1)
        offsets = np.concatenate([[0], np.cumsum(widths)[:-1]])
        n = int(np.searchsorted(at + offsets + widths, bits.n, "right"))
        codes = bits.read(at + offsets[:n], widths[:n])
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stops):
            if n <= reach:  # no end code
                yield codes
                return
            reach *= 4
            continue
        stop = int(stops[0])
        yield codes[:stop]
        if codes[stop] == end:
            return
        span = int(offsets[stop] + widths[stop])
        at += span
        if stop:  # segments of the same length that follow are read at once
            more = (bits.n - at) // span
            if more > 1:
                block = bits.read(at + span * np.arange(more)[:, None] + offsets[None, : stop + 1], np.broadcast_to(widths[: stop + 1], (more, stop + 1)))
                alike = (block[:, -1] == clear) & (block[:, :-1] != clear).all(axis=1) & (block[:, :-1] != end).all(axis=1)
                rows = int(np.argmin(alike)) if not alike.all() else more
                yield from block[:rows, :-1]
                at += span * rows


def lzw_read(data: bytes, size: int, most: int | None = None) -> np.ndarray:
    """Palette indices of an LZW stream; with ``most``, not much more than that many of them."""
    segments = [s for s in lzw_codes(data, size) if len(s)]
    if not segments:
        return np.zeros(0, np.uint8)
    codes = np.concatenate(segments)
    literal = codes < (1 << size)
    if literal.all():
        return codes.astype(np.uint8)
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    n = np.arange(len(codes))
    back = np.where(literal, n, first + codes - (1 << size) - 2)  # the code that began the entry
    if ((back >= n) & ~literal).any():
        bad = int(np.flatnonzero((back >= n) & ~literal)[0])
        codes, literal, back, n = codes[:bad], literal[:bad], back[:bad], n[:bad]
    hops, jump = (~literal).astype(np.int64), back.copy()
    while (hops[jump] > 0).any():
        hops, jump = hops + hops[jump], jump[jump]
    sizes = hops + 1
    if most is not None and len(sizes):
        enough = int(np.searchsorted(np.cumsum(sizes), most)) + 1
        codes, literal, back, n, sizes = codes[:enough], literal[:enough], back[:enough], n[:enough], sizes[:enough]
    starts = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()))
    owner = np.repeat(n, sizes)
    source = np.where(literal[owner], place, starts[back[owner]] + place - starts[owner])
    while (source[source] != source).any():
        source = source[source]
    return codes[owner[source]].astype(np.uint8)


# --- files -------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    whole, rest = divmod(len(data), 255)
    body = np.empty((whole, 256), np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(data[: whole * 255], np.uint8).reshape(whole, 255)
    return body.tobytes() + (bytes([rest]) + data[whole * 255 :] if rest else b"") + b"\0"


def write_gif(samples: bytes, width: int = WIDTH, rows: int = ROWS) -> bytes:
    """Samples (a multiple of ``width``) as frames of up to ``rows`` rows under a grey palette."""
    grid = np.frombuffer(samples, np.uint8).reshape(-1, width)
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, len(grid)), 0xF7, 0, 0), grey]
    for at in range(0, len(grid), rows):
        frame = grid[at : at + rows]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY_CS, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(frame), 0) + b"\x08")
        out.append(_blocks(lzw_write(frame.reshape(-1))))
    return b"".join([*out, b"\x3b"])


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    n = 2 << (flags & 7)
    raw = data[at : at + 3 * n]
    return np.frombuffer(raw, np.uint8).reshape(n, 3) if len(raw) == 3 * n else None, at + 3 * n


def _row_order(height: int) -> np.ndarray:
    """Rows of an interlaced image in the order in which they are stored."""
    return np.concatenate([np.arange(start, height, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def read_gif(data: bytes) -> Iterator[dict]:
    """Timed frames of a GIF: the canvas (RGBA) after each frame, the frame's place on it and its palette indices.

    Returns after the last whole frame; the generator's value says whether the file ended as it should.
    """
    if data[:3] != b"GIF":
        raise ValueError("no GIF")
    if len(data) < 13:
        return False
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MAX_PIXELS:
        return False
    at, common = 13, None
    if flags & 0x80:
        common, at = _palette(data, at, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear, time = 0, 0, -1, 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, end = _joined(data, at + 2)
            if data[at + 1 : at + 2] == b"\xf9" and len(body) >= 4:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = (bits >> 2) & 7, index if bits & 1 else -1
            at = end
            continue
        if data[at] != 0x2C or at + 10 > len(data):
            return False
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        own = common
        if flags & 0x80:
            own, at = _palette(data, at, flags)
        if at >= len(data) or own is None or w * h > MAX_PIXELS or not 1 <= data[at] <= 11:
            return False
        stream, end = _joined(data, at + 1)
        index = lzw_read(stream, data[at], w * h)[: w * h]
        at = end
        if len(index) < w * h:
            return False
        index = index.reshape(h, w)
        if flags & 0x40:
            rows = np.empty_like(index)
            rows[_row_order(h)] = index
            index = rows
        before = canvas.copy() if disposal == 3 else None
        y, x = max(0, min(h, height - top)), max(0, min(w, width - left))
        index = index[:y, :x]
        shown = np.dstack([own[np.minimum(index, len(own) - 1)], np.full(index.shape, 255, np.uint8)])
        part = canvas[top : top + y, left : left + x]
        part[...] = np.where((index == clear)[..., None], part, shown)
        yield {"start_ms": time, "duration_ms": delay * 10, "left": left, "top": top, "width": x, "height": y, "canvas": canvas, "index": index}
        time += delay * 10
        if disposal == 2:
            canvas[top : top + y, left : left + x] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear = 0, 0, -1
    return at < len(data)


def _bins(values: np.ndarray) -> list[int]:
    return np.bincount(values.astype(np.int32) * BINS // 256, minlength=BINS).tolist()


def histogram(rgba: np.ndarray) -> list[int]:
    """Opaque pixels by brightness in ``BINS`` equal steps."""
    return _bins(rgba[..., :3].sum(axis=2, dtype=np.int32)[rgba[..., 3] > 0] // 3)


def colour_histogram(rgba: np.ndarray) -> list[int]:
    """Opaque pixels by red, then green, then blue, in ``BINS`` equal steps each."""
    opaque = rgba[rgba[..., 3] > 0]
    return [n for channel in range(3) for n in _bins(opaque[:, channel])]


# --- columns -----------------------------------------------------------------


def padded(raw: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of ``WIDTH``."""
    return raw + bytes([FILL]) * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a GIF."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            raw = [t.encode("utf-8", "replace") for t in texts_of(b)]
            media = [write_gif(padded(r)) for r in raw]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows, run, f"doc_id {kind}, n_bytes long, media binary")


def _frames(data: bytes) -> Iterator[dict | bool]:
    """Frames of ``read_gif``, and at last whether the file ended as it should."""
    yield (yield from read_gif(data))


def _decoded(data: bytes | None) -> dict:
    if not data or data[:3] != b"GIF":
        return dict.fromkeys(("payload", "frames", "histogram", "colours", "complete"))
    samples, frames, complete = [], [], False
    total, colours = np.zeros(BINS, np.int64), np.zeros(3 * BINS, np.int64)
    for f in _frames(data):
        if isinstance(f, bool):
            complete = f
            continue
        canvas = f.pop("canvas")
        part = canvas[f["top"] : f["top"] + f["height"], f["left"] : f["left"] + f["width"]]
        samples.append(f.pop("index").tobytes())
        f |= {"histogram": histogram(part), "colours": colour_histogram(part)}
        total += f["histogram"]
        colours += f["colours"]
        frames.append(f)
    return {"payload": b"".join(samples), "frames": frames, "histogram": total.tolist(), "colours": colours.tolist(), "complete": complete}


def from_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload, frames, histogram, colours, complete, media_bytes, media_sha256) of stored GIFs.

    The payload is the palette indices of all frames, one after another: the samples of
    ``to_media``. What a viewer sees is in ``composed``.
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    i32, i64 = pa.int32(), pa.int64()
    frame = pa.struct([*((n, i32) for n in ("start_ms", "duration_ms", "left", "top", "width", "height")), ("histogram", pa.list_(i32)), ("colours", pa.list_(i32))])
    kinds = {"payload": pa.binary(), "frames": pa.list_(frame), "histogram": pa.list_(i64), "colours": pa.list_(i64), "complete": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            found = [_decoded(m) for m in b.column("media").to_pylist()]
            made = {k: pa.array([f[k] for f in found], t) for k, t in kinds.items()}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes"), **made, "media_bytes": b.column("media_bytes"), "media_sha256": b.column("media_sha256")})

    rows = media.select("doc_id", "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    return in_batches(rows, run, f"doc_id {kind}, n_bytes long, payload binary, frames {FRAMES}, histogram array<long>, colours array<long>, complete boolean, media_bytes long, media_sha256 string")


def composed(media: DataFrame) -> DataFrame:
    """(doc_id, frame, start_ms, duration_ms, width, height, rgba): the whole canvas as each frame shows it, a row a frame."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            for place, data in enumerate(b.column("media").to_pylist()):
                if not data or data[:3] != b"GIF":
                    continue
                for n, f in enumerate(read_gif(data)):  # a batch a frame: canvases may be large
                    height, width = f["canvas"].shape[:2]
                    values = {"frame": n, "start_ms": f["start_ms"], "duration_ms": f["duration_ms"], "width": width, "height": height}
                    cols = [b.column("doc_id").slice(place, 1), *(pa.array([v], pa.int32()) for v in values.values()), pa.array([f["canvas"].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", *values, "rgba"])

    return in_batches(media.select("doc_id", "media"), run, f"doc_id {kind}, frame int, start_ms int, duration_ms int, width int, height int, rgba binary")


def report(read: DataFrame) -> DataFrame:
    """Digests of ``from_media`` rows."""
    size = F.octet_length("payload")
    return read.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -32, 32)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.array_join(F.col("histogram").cast("array<string>"), ",").alias("feature"),
        F.size("frames").cast("long").alias("n_frames"),
        F.array_join(F.col("colours").cast("array<string>"), ",").alias("colour_feature"),
    )
