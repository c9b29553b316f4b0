"""What only the bytes of a file can tell: dates in image and video containers, pixels, safe names.

These are pandas UDFs over binary columns; a value that can't be read gives null.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tags of the original, digitised and changed time; pointer to further tags; names that a file must not have.
DATE_TAGS, POINTER = (36867, 36868, 306), 34665
RESERVED = frozenset(["con", "prn", "aux", "nul", *(f"{p}{i}" for p in ("com", "lpt") for i in range(1, 10))])
LONGEST_NAME, DEEPEST = 100, 12
SEARCHED = 8 << 20
_MAC = datetime(1904, 1, 1, tzinfo=timezone.utc)


def _entries(block: bytes, order: str, at: int) -> Iterator[tuple[int, int, int, int]]:
    """tag, type, count, value of one directory of a TIFF block."""
    if not 0 <= at < len(block) - 2:
        return
    (n,) = struct.unpack_from(f"{order}H", block, at)
    for place in range(at + 2, min(at + 2 + 12 * n, len(block) - 11), 12):
        yield struct.unpack_from(f"{order}HHII", block, place)


def tiff_date(block: bytes) -> datetime | None:
    """The best date among a TIFF block's directories; those of a pointer are followed twice."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8 or struct.unpack_from(f"{order}H", block, 2)[0] != 42:
        return None
    said: dict[int, bytes] = {}
    todo = [(struct.unpack_from(f"{order}I", block, 4)[0], 0)]
    while todo:
        at, depth = todo.pop(0)
        for tag, kind, count, value in _entries(block, order, at):
            if tag == POINTER and depth < 2:
                todo.insert(0, (value, depth + 1))
            elif tag in DATE_TAGS and kind == 2 and count >= 19 and len(block) >= value + 19:
                said.setdefault(tag, block[value : value + 19])
    for tag in DATE_TAGS:
        try:
            return datetime.strptime(said[tag].decode("ascii", "ignore"), "%Y:%m:%d %H:%M:%S")
        except (KeyError, ValueError):
            continue
    return None


def _jpeg_block(raw: bytes) -> bytes:
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] not in (0xD8, 0xD9, 0xDA):
        (size,) = struct.unpack_from(">H", raw, at + 2)
        body = raw[at + 4 : at + 2 + size]
        if raw[at + 1] == 0xE1 and body.startswith(b"Exif\0\0"):
            return body[6:]
        at += 2 + size
    return b""


def plausible(when: datetime | None, this_year: int) -> bool:
    return when is not None and 1970 < when.year <= this_year + 1


def image_date(raw: bytes, ext: str, this_year: int) -> datetime | None:
    """Date of a JPEG, of a TIFF or raw file, or of the first TIFF block with a plausible date in a HEIC container."""
    if raw[:2] == b"\xff\xd8":
        return tiff_date(_jpeg_block(raw))
    if raw[:2] in (b"II", b"MM"):
        return tiff_date(raw[: 256 << 10])
    if ext in ("heic", "heif"):
        near = raw[:SEARCHED]
        for magic in (b"MM\0*", b"II*\0"):
            for hit in re.finditer(re.escape(magic), near):
                if plausible(when := tiff_date(near[hit.start() :]), this_year):
                    return when
    return None


def _atom(raw: bytes, name: bytes, start: int, end: int) -> tuple[int, int] | None:
    while start < end - 8:
        size, kind, head = *struct.unpack_from(">I4s", raw, start), 8
        if size == 1:
            (size,), head = struct.unpack_from(">Q", raw, start + 8), 16
        size = size or end - start
        if size < 8:
            return None
        if kind == name:
            return start + head, min(end, start + size)
        start += size
    return None


def video_date(raw: bytes) -> datetime | None:
    """Creation time of a movie header, in UTC."""
    movie = _atom(raw, b"moov", 0, len(raw))
    header = movie and _atom(raw, b"mvhd", *movie)
    if not header:
        return None
    wide = raw[header[0]] == 1
    (seconds,) = struct.unpack_from(">Q" if wide else ">I", raw, header[0] + 4)
    return (_MAC + timedelta(seconds=seconds)).replace(tzinfo=None) if seconds else None


def embedded(raw: bytes | None, ext: str, videos: tuple[str, ...], this_year: int) -> tuple[datetime | None, str | None]:
    """Plausible date and its label from a file's own bytes."""
    for label, read in (("exif", lambda: image_date(raw, ext, this_year)), ("quicktime", lambda: video_date(raw) if ext in videos else None)):
        try:
            when = read()
        except (struct.error, IndexError, OverflowError, TypeError, ValueError):
            when = None
        if plausible(when, this_year):
            return when, label
    return None, None


def embedded_date(videos: tuple[str, ...], this_year: int):
    """A function of (content, ext) to a struct of time and label."""

    @F.pandas_udf(T.StructType([T.StructField("at", T.TimestampNTZType()), T.StructField("label", T.StringType())]))
    def read(content: pd.Series, ext: pd.Series) -> pd.DataFrame:
        said = [embedded(raw, e or "", videos, this_year) for raw, e in zip(content, ext, strict=True)]
        return pd.DataFrame({"at": pd.Series([x for x, _ in said], dtype="datetime64[us]"), "label": [x for _, x in said]})

    return read


def png_pixels(raw: bytes) -> np.ndarray:
    """Rows x columns x channels of an 8-bit PNG without interlacing: grey, RGB, either with alpha."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head = 8, [], b""
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        if kind == b"IHDR":
            head = raw[at + 8 : at + 8 + size]
        elif kind == b"IDAT":
            data.append(raw[at + 8 : at + 8 + size])
        at += size + 12
    width, height, depth, colour, _, _, woven = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or woven or channels is None:
        raise ValueError("this kind of PNG is not read")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, width + 1, channels), np.int64)  # a border of zeros above and on the left
    for y, line in enumerate(lines):
        kind, x = line[0], line[1:].astype(np.int64).reshape(width, channels)
        up = out[y, 1:]
        if kind == 0:
            out[y + 1, 1:] = x
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(x, 0) % 256
        elif kind == 2:
            out[y + 1, 1:] = (x + up) % 256
        else:
            for i in range(width):
                a, b, c = out[y + 1, i], out[y, i + 1], out[y, i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
                out[y + 1, i + 1] = (x[i] + guess) % 256
    return out[1:, 1:].astype(np.uint8)


def grey_grid(pixels: np.ndarray, columns: int = 9, rows: int = 8) -> list[int]:
    """Grey values of a grid of cells, rows first; a cell is the mean of its pixels."""
    p = pixels.astype(np.int64)
    grey = (299 * p[..., 0] + 587 * p[..., 1] + 114 * p[..., 2]) // 1000 if p.shape[2] >= 3 else p[..., 0]
    cut = lambda n, parts: [(i * n // parts, max(i * n // parts + 1, (i + 1) * n // parts)) for i in range(parts)]
    return [int(grey[a:b, c:d].mean()) for a, b in cut(grey.shape[0], rows) for c, d in cut(grey.shape[1], columns)]


@F.pandas_udf(T.StructType([T.StructField("grid", T.ArrayType(T.IntegerType())), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def image_grid(content: pd.Series) -> pd.DataFrame:
    """Grid and dimensions of PNG bytes; null where they can't be read."""
    out = []
    for raw in content:
        try:
            pixels = png_pixels(raw)
            out.append((grey_grid(pixels), pixels.shape[1], pixels.shape[0]))
        except (ValueError, struct.error, zlib.error, TypeError):
            out.append((None, None, None))
    return pd.DataFrame(out, columns=["grid", "width", "height"]).astype({"width": "Int32", "height": "Int32"})


def safe_name(name: str) -> str:
    """A name of letters, digits, dot, underscore and hyphen only, of bounded length and none that a system reserves."""
    out = re.sub(r"[^A-Za-z0-9._-]+", "_", unicodedata.normalize("NFKD", name)).strip("._") or "file"
    if out.partition(".")[0].lower() in RESERVED:
        out = f"_{out}"
    if len(out) <= LONGEST_NAME:
        return out
    stem, _, ext = out.rpartition(".")
    room = LONGEST_NAME - len(ext) - 1
    return f"{stem[:room]}.{ext}" if stem and room > 0 else out[:LONGEST_NAME]


def safe_path(raw: str | None) -> str | None:
    """A relative path that can't leave its folder, or None for one that tries to."""
    if not raw or "\0" in raw or raw[0] in "/\\" or re.match("[A-Za-z]:", raw):
        return None
    steps = [x for x in re.split(r"[\\/]+", raw) if x not in ("", ".")]
    return None if not steps or ".." in steps else "/".join(map(safe_name, steps[-DEEPEST:]))


@F.pandas_udf(T.StringType())
def safe_relative_path(raw: pd.Series) -> pd.Series:
    return raw.map(safe_path)
