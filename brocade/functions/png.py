"""PNG bytes to and from pixel arrays, as Arrow-batched functions; zlib does the compression.

A picture is a struct of width, height, mode and its pixels' bytes in reading order, one, three or four to a pixel (modes
L, RGB, RGBA), or an error text where there is no picture to have.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PICTURE = "width int, height int, mode string, pixels binary, error string"

#: Fixed values of the format: signature; samples of a pixel by colour type; depths allowed for each; start and step of the interlacing passes (x, y, dx, dy).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
CHANNELS = {"L": 1, "RGB": 3, "RGBA": 4}
#: Pixels of a picture at most, so that a forged header makes no worker run out of memory.
MOST_PIXELS = 1 << 28
#: Pixels that are worked on at a time, of pictures of one size; a larger picture goes alone.
CELLS = 1 << 18


class Bad(ValueError):
    """Bytes that hold no picture; the text says why."""


def chunks(data: bytes) -> dict[bytes, bytes]:
    """The parts of a file by type, those of one type joined; each is checked against its sum."""
    if data[:8] != SIGNATURE:
        raise Bad("not a PNG")
    out: dict[bytes, bytes] = {}
    at = 8
    while b"IEND" not in out:
        if at + 12 > len(data):
            raise Bad("truncated")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise Bad("truncated")
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise Bad("wrong checksum")
        out[kind] = out.get(kind, b"") + body
        at += 12 + size
    return out


def unfiltered(rows: np.ndarray, pixel: int) -> np.ndarray:
    """Scan lines (height, 1 + bytes) to bytes, with each line's filter undone; pixel: bytes from a byte to the one left of it.

    Filters that need the line above and the bytes to the left at once go by diagonals: all bytes of one are known to depend on earlier ones only.
    """
    kind, out = rows[:, 0], rows[:, 1:].copy()
    if kind.max(initial=0) > 4:
        raise Bad("unknown filter")
    h, wide = out.shape
    out = np.pad(out, ((0, 0), (0, -wide % pixel))).reshape(h, -1, pixel)
    if not (kind >= 3).any():
        last = np.zeros(out.shape[1:], np.uint8)
        for y in range(h):
            if kind[y] == 1:
                np.cumsum(out[y], axis=0, dtype=np.uint8, out=out[y])
            elif kind[y] == 2:
                out[y] += last
            last = out[y]
        return out.reshape(h, -1)[:, :wide]
    w = out.shape[1]
    one, two = (np.zeros((h + 1, pixel), np.int16) for _ in range(2))  # the last two diagonals by line, from the one above the first
    for d in range(w + h - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        a, b, c = one[y + 1], one[y], two[y]
        p = a + b - c
        near = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        k = kind[y][:, None]
        now = (out[y, d - y] + np.select([k == 1, k == 2, k == 3, k == 4], [a, b, (a + b) >> 1, near], 0)) & 255
        out[y, d - y] = now
        two[y + 1] = now
        one, two = two, one
    return out.reshape(h, -1)[:, :wide]


def samples(data: bytes, width: int, height: int, depth: int, each: int) -> tuple[np.ndarray, int]:
    """(samples of shape (height, width, each), bytes read) of one pass of scan lines."""
    line = -(-width * each * depth // 8)
    need = height * (line + 1)
    if len(data) < need:
        raise Bad("truncated")
    raw = unfiltered(np.frombuffer(data, np.uint8, need).reshape(height, line + 1), max(1, each * depth // 8))
    if depth == 16:
        values = np.ascontiguousarray(raw).view(">u2").astype(np.int32)
    elif depth == 8:
        values = raw
    else:
        bits = np.unpackbits(raw, axis=1).reshape(height, -1, depth)
        values = np.packbits(np.pad(bits, ((0, 0), (0, 0), (8 - depth, 0))), axis=2)[:, :, 0]
    return values[:, : width * each].reshape(height, width, each), need


def inflated(data: bytes | None) -> tuple[tuple[int, ...], dict[bytes, bytes], bytes]:
    """Header (width, height, depth, colour, interlacing), parts and scan lines of a file. Bad says what is wrong with other bytes."""
    if data is None:
        raise Bad("no bytes")
    parts = chunks(data)
    if len(parts.get(b"IHDR", b"")) != 13:
        raise Bad("no header")
    width, height, depth, colour, packing, filtering, laced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if not width or not height or width * height > MOST_PIXELS or depth not in DEPTHS.get(colour, ()) or packing or filtering or laced > 1:
        raise Bad("unknown header")
    need = sum(h * (1 - (-w * SAMPLES[colour] * depth // 8)) for *_, w, h in passes(width, height, laced))
    try:
        flat = zlib.decompressobj().decompress(parts.get(b"IDAT", b""), need)
    except zlib.error:
        raise Bad("damaged data") from None
    if len(flat) < need:
        raise Bad("truncated")
    return (width, height, depth, colour, laced), parts, flat


def passes(width: int, height: int, laced: int) -> list[tuple[int, ...]]:
    """Start, step, width and height of each pass of a picture."""
    return [(x, y, dx, dy, -((x - width) // dx), -((y - height) // dy)) for x, y, dx, dy in (PASSES if laced else ((0, 0, 1, 1),)) if width > x and height > y]


def pixels_of(header: tuple[int, ...], parts: dict[bytes, bytes], flat: bytes, mode: str) -> np.ndarray:
    width, height, depth, colour, laced = header
    each = SAMPLES[colour]
    values = np.empty((height, width, each), np.int32)
    at = 0
    for x, y, dx, dy, w, h in passes(width, height, laced):
        part, used = samples(flat[at:], w, h, depth, each)
        values[y::dy, x::dx] = part
        at += used
    return converted(values, depth, colour, parts, mode)


def decode(data: bytes | None, mode: str) -> np.ndarray:
    """Pixels (height, width, channels) in the wanted mode. Bad says what is wrong with other bytes."""
    return pixels_of(*inflated(data), mode)


def size(data: bytes | None) -> int:
    """How many pixels a file says it has, 0 where that can't be read."""
    return int.from_bytes(data[16:20]) * int.from_bytes(data[20:24]) if data is not None else 0


def blocks(sizes: Iterable[int], most: int = CELLS) -> Iterator[tuple[int, int]]:
    """Begin and end of stretches of so many pixels in all at most, or of one picture."""
    begin = total = 0
    end = -1
    for end, n in enumerate(sizes):
        if end > begin and (total + n > most or end - begin >= most):
            yield begin, end
            begin, total = end, 0
        total += n
    if end >= 0:
        yield begin, end + 1


def decoded(data: list[bytes | None], mode: str) -> Iterator[tuple[list[int], np.ndarray | str]]:
    """Places and pixels (n, height, width, channels) of some pictures of one size at a time, or a place and what is wrong with its bytes.

    Whole-byte pictures without interlacing, whose lines need no bytes of both the left and the line above, are unfiltered together.
    """
    for begin, end in blocks(map(size, data)):
        alike = defaultdict(list)
        for i in range(begin, end):
            try:
                header, parts, flat = inflated(data[i])
                width, height, depth, colour, laced = header
                plain = depth == 8 and not laced and colour != 3 and b"tRNS" not in parts and max(flat[:: 1 + width * SAMPLES[colour]]) < 3
                if plain:
                    alike[header].append((i, flat))
                else:
                    yield [i], pixels_of(header, parts, flat, mode)[None]
            except Bad as wrong:
                yield [i], str(wrong)
        for (width, height, depth, colour, _), own in alike.items():
            each = SAMPLES[colour]
            lines = np.frombuffer(b"".join(flat for _, flat in own), np.uint8).reshape(len(own), height, 1 + width * each)
            kind, values = lines[:, :, 0], lines[:, :, 1:].reshape(len(own), height, width, each).copy()
            for y in range(height):
                left, above = np.flatnonzero(kind[:, y] == 1), np.flatnonzero(kind[:, y] == 2)
                if len(left):
                    values[left, y] = np.cumsum(values[left, y], axis=1, dtype=np.uint8)
                if y and len(above):
                    values[above, y] += values[above, y - 1]
            shown = converted(values.reshape(-1, width, each), depth, colour, {}, mode)
            yield [i for i, _ in own], shown.reshape(len(own), height, width, -1)


def converted(values: np.ndarray, depth: int, colour: int, parts: dict[bytes, bytes], mode: str) -> np.ndarray:
    """Samples of a colour type as 8-bit pixels of a mode; grey from colours by the weights of ITU-R 601, opacity dropped where the mode has none."""
    clear = parts.get(b"tRNS", b"")
    if colour == 3:
        table = np.frombuffer(parts.get(b"PLTE", b""), np.uint8)
        if len(table) % 3 or values.max(initial=0) >= len(table) // 3:
            raise Bad("no palette")
        rgb = table.reshape(-1, 3)[values[:, :, 0]]
        alpha = np.frombuffer(clear.ljust(256, b"\xff"), np.uint8)[values[:, :, 0]]
    else:
        eight = (values >> 8 if depth == 16 else values * (255 // ((1 << depth) - 1))).astype(np.uint8)
        rgb = eight[:, :, :1] if colour in (0, 4) else eight[:, :, :3]
        alpha = eight[:, :, -1] if colour in (4, 6) else np.full(values.shape[:2], 255, np.uint8)
        if clear and colour in (0, 2) and len(clear) == 2 * values.shape[2]:
            alpha = np.where((values == np.frombuffer(clear, ">u2")).all(axis=2), 0, 255).astype(np.uint8)
    if mode == "L":
        return rgb[:, :, :1] if rgb.shape[2] == 1 else ((rgb @ np.array([19595, 38470, 7471]) + 0x8000) >> 16).astype(np.uint8)[:, :, None]
    rgb = np.broadcast_to(rgb, (*rgb.shape[:2], 3))
    return rgb if mode == "RGB" else np.dstack([rgb, alpha])


def encode(pixels: np.ndarray, level: int = 6) -> bytes:
    """PNG bytes of (height, width, 1, 3 or 4) 8-bit pixels; each line has the filter of none, left and above whose bytes are least in sum."""
    return encoded(pixels[None], level)[0]


def encoded(pixels: np.ndarray, level: int = 6) -> list[bytes]:
    """PNG bytes of each picture of a stack (n, height, width, channels)."""
    n, h, w, each = pixels.shape
    flat = pixels.reshape(n, h, -1)
    left, above = flat.copy(), flat.copy()
    left[:, :, each:] -= flat[:, :, :-each]
    above[:, 1:] -= flat[:, :-1]
    kind = np.stack([np.abs(t.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64) for t in (flat, left, above)]).argmin(axis=0)
    lines = np.empty((n, h, 1 + w * each), np.uint8)
    lines[:, :, 0] = kind
    lines[:, :, 1:] = np.where((kind == 0)[:, :, None], flat, np.where((kind == 1)[:, :, None], left, above))
    colour = {1: 0, 3: 2, 4: 6}[each]

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    before, after = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)), chunk(b"IEND", b"")
    return [before + chunk(b"IDAT", zlib.compress(own.tobytes(), level)) + after for own in lines]


def array_of(width: int, height: int, mode: str, pixels: bytes) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width, CHANNELS[mode])


def picture_row(pixels: np.ndarray | None, mode: str | None, error: str | None = None) -> tuple:
    """A picture's struct, as a row of PICTURE."""
    if pixels is None:
        return None, None, None, None, error
    return pixels.shape[1], pixels.shape[0], mode, np.ascontiguousarray(pixels).tobytes(), None


def picture_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["width", "height", "mode", "pixels", "error"], dtype=object)
    return out.astype({"width": "Int32", "height": "Int32"})


def picture(data: Column, mode: str = "RGB") -> Column:
    """The picture that PNG bytes hold, in a mode; bytes that hold none, and nulls, give the reason in `error`."""

    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                rows.append(picture_row(decode(v, mode), mode))
            except Bad as wrong:
                rows.append(picture_row(None, None, str(wrong)))
        return picture_frame(rows)

    return F.pandas_udf(run, PICTURE)(data)


def png(shown: Column, level: int = 6) -> Column:
    """PNG bytes of pictures; null where there is none."""

    def run(values: pd.DataFrame) -> pd.Series:
        rows = zip(values["width"], values["height"], values["mode"], values["pixels"], strict=True)
        return pd.Series([None if p is None else encode(array_of(int(w), int(h), m, p), level) for w, h, m, p in rows], dtype=object)

    return F.pandas_udf(run, "binary")(shown)


def embedded(cell: Column, mode: str = "RGB") -> Column:
    """The picture of an embedded cell, a struct with `bytes`."""
    return picture(cell["bytes"], mode)
