"""Media columns: binary pictures decoded to arrays, resized by area, and kept as NPY tiles with difference hashes.

A media column holds one Netpbm (P1 to P6) or BMP file a row.  ``tiles`` decodes each to a numpy array of rows x columns (x 3), takes
its lightness, and resizes that by area: a tile's pixel is the exact mean of the rectangle it stands for, pixels cut by an edge counted in part.  The
rectangle sums come from an integral image, in whole numbers, taken in bands of rows, so that memory follows a band and not the picture.  The tile is
returned as the bytes of an NPY file.  The difference hash says for 8 x 8 places whether the mean to the right is larger.

``store`` writes byte strings as pictures, losslessly: a row of 64 eight-bit samples for each 64 bytes, as P5 or as a BMP of 256 greys, and ``payload`` reads
the bytes back from the decoded array.  All work is row by row, in Arrow batches, with no shuffle: copies and hot sources cost what other rows do.

Defined results: a null picture gives a null tile without an error; one that can't be decoded (cut short, of another format,
compressed) gives a null tile and its ``error`` in words, and the other rows stand; maxval below 255 is stretched to 255, 16 bits come down to 8; an
empty table gives an empty one; extra columns are ignored by the query and kept by ``tiles``, which sets its own names' namesakes aside.  A null text is the empty one, of 64 bytes zero.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import materialize, own, session, set_aside, table
from .words import texts_of

WIDTH, TILE, BAND = 64, (16, 16), 1 << 20
#: Weights of red, green and blue in lightness, out of 1,000 (ITU-R BT.601).
LIGHT = (299, 587, 114)


class Unreadable(ValueError):
    """A picture that can't be decoded."""


def _netpbm(raw: bytes) -> np.ndarray:
    kind, at = raw[1] - 48, 2
    numbers = []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*(\d+)").match(raw, at)
        if not m:
            raise Unreadable("header cut short")
        numbers.append(int(m.group(1)))
        at = m.end()
    w, h, top = numbers[0], numbers[1], numbers[2] if len(numbers) > 2 else 1
    if not (w > 0 and h > 0 and 0 < top < 65536):
        raise Unreadable("header out of range")
    deep = 3 if kind in (3, 6) else 1
    if kind in (1, 2, 3):
        body = re.sub(rb"#[^\r\n]*", b"", raw[at:])
        told = [bytes([c]) for c in body if c in b"01"] if kind == 1 else body.split()
        if len(told) < w * h * deep or not all(t.isdigit() for t in told[: w * h * deep]):
            raise Unreadable("samples cut short")
        x = np.array([int(t) for t in told[: w * h * deep]], np.int64)
    else:
        at += 1  # one white space ends the header
        row = (w + 7) // 8 if kind == 4 else w * deep * (2 if top > 255 else 1)
        if len(raw) - at < row * h:
            raise Unreadable("samples cut short")
        x = np.frombuffer(raw, np.uint8 if kind == 4 or top < 256 else ">u2", h * (row if kind == 4 or top < 256 else w * deep), at)
        if kind == 4:
            x = np.unpackbits(x.reshape(h, row), axis=1)[:, :w]
    if kind in (1, 4):
        x, top = 1 - x.astype(np.uint8), 1  # a one is black
    if top != 255:
        if int(x.max(initial=0)) > top:
            raise Unreadable("sample above the maximum")
        x = ((x.astype(np.int64) * 510 + top) // (2 * top)).astype(np.uint8)
    return x.astype(np.uint8, copy=False).reshape((h, w, 3) if deep == 3 else (h, w))


def _bmp(raw: bytes) -> np.ndarray:
    if len(raw) < 54:
        raise Unreadable("header cut short")
    start, head, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", raw, 10)
    used = struct.unpack_from("<I", raw, 46)[0]
    if head < 40 or w <= 0 or h == 0 or bits not in (1, 4, 8, 24, 32):
        raise Unreadable("header out of range")
    if packed not in (0, 3) or (packed == 3 and bits != 32):
        raise Unreadable("compressed")
    if packed == 3 and struct.unpack_from("<III", raw.ljust(66, b"\0"), 54) != (0xFF0000, 0xFF00, 0xFF):
        raise Unreadable("unusual colour masks")
    tall, row = abs(h), (w * bits + 31) // 32 * 4
    if len(raw) < start + row * tall:
        raise Unreadable("samples cut short")
    x = np.frombuffer(raw, np.uint8, row * tall, start).reshape(tall, row)
    if h > 0:
        x = x[::-1]  # rows run from the bottom up
    if bits >= 24:
        return x[:, : w * bits // 8].reshape(tall, w, bits // 8)[:, :, 2::-1]
    if bits < 8:
        x = np.unpackbits(x, axis=1)
        if bits == 4:
            x = x.reshape(tall, -1, 4) @ np.array([8, 4, 2, 1], np.uint8)
    n = used or 1 << bits
    if n > 256 or len(raw) < 14 + head + 4 * n:
        raise Unreadable("palette cut short")
    colours = np.frombuffer(raw, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1]
    at = x[:, :w]
    if int(at.max(initial=0)) >= n:
        raise Unreadable("colour outside the palette")
    grey = (colours == colours[:, :1]).all()
    return colours[:, 0][at] if grey else colours[at]


def decode(raw: bytes) -> np.ndarray:
    """rows x columns, or rows x columns x (red, green, blue), of eight bits."""
    if raw[:1] == b"P" and raw[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(raw)
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise Unreadable("neither Netpbm nor BMP")


def encode(x: np.ndarray, form: str) -> bytes:
    """A grey or coloured array of eight bits as ``netpbm`` (P5 or P6) or ``bmp`` (a palette of 256 greys, or 24 bits)."""
    h, w = x.shape[:2]
    if form == "netpbm":
        return b"P%d\n%d %d\n255\n" % (6 if x.ndim == 3 else 5, w, h) + x.tobytes()
    bits = 24 if x.ndim == 3 else 8
    row = (w * bits + 31) // 32 * 4
    flat = x[::-1, :, ::-1] if x.ndim == 3 else x[::-1]
    body = np.pad(flat.reshape(h, -1), ((0, 0), (0, row - w * bits // 8))).tobytes()
    colours = b"" if x.ndim == 3 else np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    if x.ndim == 2:
        colours[:, 3] = 0
        colours = colours.tobytes()
    start = 54 + len(colours)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", start + len(body), 0, 0, start, 40, w, h, 1, bits, 0, len(body), 2835, 2835, 256 if bits == 8 else 0, 0) + colours + body


def light(x: np.ndarray) -> np.ndarray:
    """Lightness of eight bits."""
    return x if x.ndim == 2 else ((x @ np.array(LIGHT, np.int64) + 500) // 1000).astype(np.uint8)


def area_sums(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Sums of ``x`` over a grid of rows x cols equal rectangles, times rows * cols, exactly.

    The integral image at the grid's lines, which may cut pixels, is interpolated between whole lines; its rows come in bands.
    """
    h, w = x.shape
    yq, yr = np.divmod(np.arange(rows + 1, dtype=np.int64) * h, rows)
    xq, xr = np.divmod(np.arange(cols + 1, dtype=np.int64) * w, cols)
    x1 = np.minimum(xq + 1, w)
    at = np.zeros((rows + 1, cols + 1), np.int64)
    band = max(1, BAND // w)
    above = np.zeros(cols + 1, np.int64)
    for top in range(0, h, band):
        part = np.cumsum(x[top : top + band], axis=1, dtype=np.int64)
        part = np.concatenate([np.zeros((len(part), 1), np.int64), part], axis=1)
        lines = part[:, xq] * (cols - xr) + part[:, x1] * xr  # columns first: only the grid's are kept
        lines = np.concatenate([above[None], above + np.cumsum(lines, axis=0)])
        mine = np.flatnonzero((yq >= top) & (yq < top + len(part)))
        at[mine] = lines[yq[mine] - top] * (rows - yr[mine])[:, None] + lines[yq[mine] - top + 1] * yr[mine][:, None]
        above = lines[-1]
    at[yq == h] = above * rows
    return np.diff(np.diff(at, axis=0), axis=1)


def resize(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means of the rectangles, rounded half up, of eight bits."""
    n = x.shape[0] * x.shape[1]
    return ((2 * area_sums(x, rows, cols) + n) // (2 * n)).astype(np.uint8)


def difference_hash(x: np.ndarray) -> str:
    """16 hexadecimal digits: 8 x 8 bits, set where a rectangle is lighter than the one to its left."""
    s = area_sums(x, 8, 9)
    return np.packbits(s[:, 1:] > s[:, :-1]).tobytes().hex()


def npy(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, x, allow_pickle=False)
    return out.getvalue()


def tiles(pictures: DataFrame, column: str = "media", size: tuple[int, int] = TILE) -> DataFrame:
    """``pictures`` with height, width, channels, tile (bytes of an NPY file of ``size``), dhash and error."""
    session(pictures.sparkSession)
    names = ["height", "width", "channels", "tile", "dhash", "error"]
    rows = set_aside(pictures, *names)
    kept = rows.columns
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema) + ", height int, width int, channels int, tile binary, dhash string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_tile(raw, size) for raw in texts_of(b.column(kept.index(column)))]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 6, types)]], [*kept, *names])

    return rows.select(*own(rows)).mapInArrow(run, schema)


def _tile(raw: bytes | None, size: tuple[int, int]) -> tuple:
    if raw is None:
        return (None,) * 6
    try:
        x = decode(raw)
    except Unreadable as why:
        return (None,) * 5 + (str(why),)
    g = light(x)
    return (*x.shape[:2], 3 if x.ndim == 3 else 1, npy(resize(g, *size)), difference_hash(g), None)


def padded(text: bytes, unit: int = WIDTH) -> bytes:
    return text + b"\0" * (max(unit, -(-len(text) // unit) * unit) - len(text))


def store(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, filled up with zeros to whole rows of ``width`` samples, as a picture.  Texts of an even checksum become P5, the others BMP."""
    session(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in texts_of(b.column(1))]
            rows = (np.frombuffer(padded(t, width), np.uint8).reshape(-1, width) for t in texts)
            media = [encode(x, "bmp" if zlib.crc32(t) & 1 else "netpbm") for t, x in zip(texts, rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def payload(raw: bytes) -> bytes:
    """The bytes that a grey picture holds, row by row."""
    return np.ascontiguousarray(decode(raw)).tobytes()


def digests(stored: DataFrame, size: tuple[int, int] = TILE) -> DataFrame:
    """One row for each stored picture: its payload, as read back, its own bytes and its features (difference hash and the tile's checksum)."""
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in texts_of(b.column(2)):
                back = payload(raw)
                _, _, _, tile, dhash, _ = _tile(raw, size)
                out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), f"{dhash}-{zlib.crc32(tile):08x}"))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op11_media(spark, sf_dir: str) -> DataFrame:
    return digests(materialize(store(table(spark, sf_dir, "documents")), "zstd"))
