"""Operator 3, media columns: PNG images in binary columns, written and read in numpy.

``encode`` lays a text's bytes out as an 8-bit grey image of 64 columns,
``decode_png`` takes a PNG apart (signature, chunk checksums, zlib stream with
its own checksum, all five row filters) and ``features`` hashes the lowest
frequencies of a cosine transform of the image, 64 bits in a binary column.

A null text is an empty text; an empty text is one row of 64 zero samples.
Equal texts give equal bytes. A file that fails a test raises in ``decode_png``
and is null in the ``decoded`` table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.llm.shared import text_buffer

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 1


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray) -> bytes:
    """A grey 8-bit PNG of a (height, width) array; rows are unfiltered, which suits text best."""
    height, width = pixels.shape
    lines = np.zeros((height, width + 1), np.uint8)
    lines[:, 1:] = pixels
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines, LEVEL)) + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters 0 to 4; step: bytes a pixel. Runs of rows of the kinds 0 to 2 at once, the others by anti-diagonals."""
    height, width = lines.shape
    out = np.zeros_like(lines)
    row = 0
    while row < height:
        kind, end = kinds[row], row + 1
        while end < height and kinds[end] == kind:
            end += 1
        part = lines[row:end]
        above = out[row - 1] if row else np.zeros(width, np.uint8)
        if kind == 0:
            out[row:end] = part
        elif kind == 1:
            n = -(-width // step) * step
            wide = np.zeros((end - row, n), np.uint8)
            wide[:, :width] = part
            out[row:end] = np.add.accumulate(wide.reshape(end - row, -1, step), axis=1, dtype=np.uint8).reshape(end - row, n)[:, :width]
        elif kind == 2:
            out[row:end] = np.add.accumulate(np.concatenate([above[None], part]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            _diagonals(out, part, above, row, end, step, int(kind))
        else:
            raise ValueError(f"filter {kind}")
        row = end
    return out


def _diagonals(out: np.ndarray, part: np.ndarray, above: np.ndarray, row: int, end: int, step: int, kind: int) -> None:
    """Average and Paeth: a pixel needs its left, upper and upper left ones, all on earlier anti-diagonals."""
    n, width = part.shape
    columns = -(-width // step)
    grid = np.zeros((n + 1, columns + 1, step), np.int32)
    flat = np.zeros((n, columns * step), np.int32)
    flat[:, :width] = part
    part = flat.reshape(n, columns, step)
    top = np.zeros(columns * step, np.int32)
    top[:width] = above
    grid[0, 1:] = top.reshape(columns, step)
    for d in range(n + columns - 1):
        r = np.arange(max(0, d - columns + 1), min(n, d + 1))
        c = d - r
        left, up, corner = grid[r + 1, c], grid[r, c + 1], grid[r, c]
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            a, b, x = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((a <= b) & (a <= x), left, np.where(b <= x, up, corner))
        grid[r + 1, c + 1] = (part[r, c] + guess) & 255
    out[row:end] = grid[1:, 1:].reshape(n, -1)[:, :width]


def decode_png(file: bytes) -> np.ndarray:
    """The samples of an 8-bit PNG without interlacing: (height, width * channels)."""
    if file[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    view, at, header, data, ended = memoryview(file), 8, None, [], False
    while at + 12 <= len(file) and not ended:
        (size,) = struct.unpack_from(">I", file, at)
        kind, body = bytes(view[at + 4 : at + 8]), view[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(file) or struct.unpack_from(">I", file, at + 8 + size)[0] != zlib.crc32(view[at + 4 : at + 8 + size]):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + size
    if header is None or not ended:
        raise ValueError("incomplete PNG")
    width, height, depth, colour, _, _, interlaced = header
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or channels is None:
        raise ValueError("only 8-bit samples without interlacing")
    raw = zlib.decompress(b"".join(data))
    line = width * channels
    if len(raw) != height * (line + 1):
        raise ValueError("wrong number of samples")
    lines = np.frombuffer(raw, np.uint8).reshape(height, line + 1)
    kinds = lines[:, 0]
    return lines[:, 1:] if not kinds.any() else unfilter(kinds, lines[:, 1:], channels)


def _cosines(n: int, kept: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None] + 1) * np.arange(kept)[:, None] / (2 * n))


SIDE, KEPT = 32, 8
COSINES = _cosines(SIDE, KEPT)


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the image, scaled to 32 x 32, exceed their median."""
    height, width = pixels.shape
    rows = np.linspace(0, height, SIDE + 1).astype(np.int64)
    columns = np.linspace(0, width, SIDE + 1).astype(np.int64)
    sums = np.zeros((height + 1, width), np.int64)
    np.cumsum(pixels, axis=0, out=sums[1:])
    lo, hi = np.minimum(rows[:-1], height - 1), np.maximum(rows[1:], np.minimum(rows[:-1], height - 1) + 1)
    strips = (sums[hi] - sums[lo]) / (hi - lo)[:, None]
    lo, hi = np.minimum(columns[:-1], width - 1), np.maximum(columns[1:], np.minimum(columns[:-1], width - 1) + 1)
    wide = np.zeros((SIDE, width + 1))
    np.cumsum(strips, axis=1, out=wide[:, 1:])
    small = (wide[:, hi] - wide[:, lo]) / (hi - lo)
    low = np.round(COSINES @ small @ COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low)).tobytes()


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: id_col, n_bytes of the text, png."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for i in range(0, len(batch), 512):
                files = []
                for a, b in zip(offsets[i:-1][:512].tolist(), offsets[i + 1 :][:512].tolist(), strict=True):
                    image = np.zeros(max(WIDTH, -(-(b - a) // WIDTH) * WIDTH), np.uint8)
                    image[: b - a] = data[a:b]
                    files.append(encode_png(image.reshape(-1, WIDTH)))
                n = len(files)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(np.diff(offsets[i : i + n + 1])), pa.array(files, pa.binary())], [id_col, "n_bytes", "png"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(run, f"`{id_col}` long, n_bytes long, png binary")


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, cosine_hash binary"


def decoded(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_bytes and what the stored files hold: size, digests and the hash; nulls where a file is broken."""
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column(2):
                png = file.as_py()
                try:
                    pixels = decode_png(png)
                except (ValueError, TypeError, struct.error, zlib.error):
                    rows.append((None,) * len(names))
                    continue
                payload = np.ascontiguousarray(pixels).reshape(-1)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:].tobytes()), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(pixels)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [id_col, "n_bytes", *names])

    return media.select(id_col, "n_bytes", "png").mapInArrow(run, f"`{id_col}` long, n_bytes long, {DIGEST}")
