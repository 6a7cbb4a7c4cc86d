"""GeoTIFF and PNG bytes to and from numpy, for the layouts that tools commonly write."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# TIFF field types (size, struct code) and the tags that are read.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_BYTES, EXTRA, FORMAT = 317, 322, 323, 324, 325, 338, 339
SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
KIND = {1: "u", 2: "i", 3: "f"}


@dataclass
class Raster:
    """Bands x height x width samples with their six-number transform."""

    data: np.ndarray
    gt: list[float] = field(default_factory=lambda: [0.0, 1.0, 0.0, 0.0, 0.0, 1.0])
    epsg: int | None = None
    nodata: float | None = None


def _lzw(data: bytes) -> bytes:
    """TIFF's most-significant-bit-first LZW with early change of code width."""
    out, table, width, bits, n, last = bytearray(), [], 9, 0, 0, b""
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    table = list(start)
    for byte in data:
        bits, n = bits << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code = bits >> n
        bits &= (1 << n) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(start), 9, b""
            continue
        if code > len(table) or code == len(table) and not last:
            raise ValueError("broken LZW data")
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
        out += entry
        last = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


class _Bytes:
    """Bytes that are at hand, read like a file."""

    def __init__(self, blob: bytes):
        self.blob = blob

    def __call__(self, at: int, size: int) -> bytes:
        return self.blob[at : at + size]


def _tags(read) -> tuple[str, dict[int, list]]:
    """(byte order, tags) of a classic or a Big TIFF's first image; ``read(at, size)`` gives its bytes."""
    if isinstance(read, bytes):
        read = _Bytes(read)
    head = read(0, 16)
    end = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack_from(end + "H", head, 2)[0] if end and len(head) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("no TIFF")
    big = magic == 43
    (at,) = struct.unpack_from(end + ("Q" if big else "I"), head, 8 if big else 4)
    (n,) = struct.unpack(end + ("Q" if big else "H"), read(at, 8 if big else 2))
    entry, room, at = (20, 8, at + 8) if big else (12, 4, at + 2)
    directory = read(at, n * entry)
    tags: dict[int, list] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(end + ("HHQ" if big else "HHI"), directory, entry * k)
        if kind not in TYPES:
            continue
        size, code = TYPES[kind]
        place = entry * k + entry - room
        body = directory[place : place + room]
        if size * count > room:
            body = read(struct.unpack(end + ("Q" if big else "I"), body)[0], size * count)
        tags[tag] = [body[:count]] if code == "s" else list(struct.unpack_from(end + code * count, body))
    return end, tags


def header(blob) -> tuple[int, int, int, str, list[float] | None, int | None, float | None]:
    """(width, height, bands, dtype, transform, epsg, nodata) without decoding samples; of bytes, or of a function that reads ranges."""
    end, t = _tags(blob)
    kind = KIND[t.get(FORMAT, [1])[0]]
    dtype = f"{end}{kind}{t[BITS][0] // 8}"
    gt = None
    if TRANSFORM in t:
        m = t[TRANSFORM]
        gt = [m[3], m[0], m[1], m[7], m[4], m[5]]
    elif SCALE in t and TIEPOINT in t:
        (sx, sy), p = t[SCALE][:2], t[TIEPOINT]
        gt = [p[3] - p[0] * sx, sx, 0.0, p[4] + p[1] * sy, 0.0, -sy]
    keys = t.get(GEO_KEYS, [])
    epsg = next((keys[k + 3] for want in (3072, 2048) for k in range(4, len(keys) - 3, 4) if keys[k] == want and keys[k + 1] == 0), None)
    nodata = float(t[NODATA][0].rstrip(b"\0 ")) if NODATA in t else None
    return t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, [1])[0], dtype, gt, epsg, nodata


def _unpredicted(raw: bytes, kind: np.dtype, rows: int, columns: int, per: int, predictor: int) -> np.ndarray:
    """Samples (rows, columns, per) of a block, its predictor undone."""
    native = kind.newbyteorder("=")
    if predictor == 3:  # differences of bytes, the most significant ones of a row first
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, per), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, columns * per)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, columns, per).astype(native)
    block = np.frombuffer(raw, kind).reshape(rows, columns, per).astype(native)
    return np.cumsum(block, axis=1, dtype=native) if predictor == 2 else block


def decode(blob, window: tuple[int, int, int, int] | None = None) -> Raster:
    """Samples of the first image: strips or tiles, plain, deflate or LZW, horizontal or floating-point predictor.

    ``blob`` is bytes, or a function ``read(at, size)``. Of a window (y, x, height,
    width; cut to the image) only the blocks that meet it are read and decoded.
    """
    read = _Bytes(blob) if isinstance(blob, bytes) else blob
    end, t = _tags(read)
    w, h, bands, dtype, gt, epsg, nodata = header(read)
    kind, planar, squeeze = np.dtype(dtype), t.get(PLANAR, [1])[0], t.get(COMPRESSION, [1])[0]
    unpack = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress}.get(squeeze)
    predictor = t.get(PREDICTOR, [1])[0]
    if unpack is None:
        raise ValueError(f"compression {squeeze} is not covered")
    if predictor not in (1, 2, 3) or predictor == 3 and kind.kind != "f":
        raise ValueError(f"predictor {predictor} is not covered")
    tiled = TILE_AT in t
    bw, bh = (t[TILE_W][0], t[TILE_H][0]) if tiled else (w, min(h, t.get(STRIP_ROWS, [h])[0]))
    at, size = (t[TILE_AT], t[TILE_BYTES]) if tiled else (t[STRIP_AT], t[STRIP_BYTES])
    across, down, deep = -(-w // bw), -(-h // bh), bands if planar == 2 else 1
    per = 1 if planar == 2 else bands
    top, left, high, wide = window or (0, 0, h, w)
    high, wide = max(0, min(high, h - top)), max(0, min(wide, w - left))
    out = np.zeros((bands, high, wide), kind.newbyteorder("="))
    for k in range(across * down * deep):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * bh, rest % across * bw
        if y >= top + high or x >= left + wide or y + bh <= top or x + bw <= left or not size[k]:  # no bytes: a sparse block
            continue
        rows = bh if tiled else min(bh, h - y)
        block = _unpredicted(unpack(read(at[k], size[k]))[: rows * bw * per * kind.itemsize], kind, rows, bw, per, predictor)
        y0, x0, y1, x1 = max(y, top), max(x, left), min(y + rows, top + high), min(x + bw, left + wide)
        part = block[y0 - y : y1 - y, x0 - x : x1 - x].transpose(2, 0, 1)
        out[slice(plane, plane + 1) if planar == 2 else slice(None), y0 - top : y1 - top, x0 - left : x1 - left] = part
    gt = gt or [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    gt = [gt[0] + left * gt[1] + top * gt[2], gt[1], gt[2], gt[3] + left * gt[4] + top * gt[5], gt[4], gt[5]]
    return Raster(out, gt, epsg, nodata)


def _lzw_packed(data: bytes) -> bytes:
    """TIFF's LZW: codes most significant bit first, the width changing one code early."""
    table: dict[bytes, int] = {bytes([k]): k for k in range(256)}
    out, bits, n, width, word = bytearray(), 0, 0, 9, b""

    def put(code: int) -> None:
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
        bits &= (1 << n) - 1

    put(256)
    following = 258
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = following
        following += 1
        if following == 4094:
            put(256)
            table, following, width = {bytes([j]): j for j in range(256)}, 258, 9
        else:
            width = 12 if following >= 2048 else 11 if following >= 1024 else 10 if following >= 512 else 9
        word = data[k : k + 1]
    if word:
        put(table[word])
        following += 1
        width = 12 if following >= 2048 else 11 if following >= 1024 else 10 if following >= 512 else 9
    put(257)
    if n:
        out.append(bits << 8 - n & 255)
    return bytes(out)


#: Bytes of samples beyond which ``encode`` writes a Big TIFF unless told.
BIG_BYTES = 2_000_000_000


def encode(r: Raster, deflate: bool = True, strip_rows: int = 64, tile: int | None = None, lzw: bool = False, big: bool | None = None) -> bytes:
    """Little-endian strips, or square tiles of ``tile`` pixels (a multiple of 16); plain, deflate or LZW.

    Keeps transform, EPSG code and nodata. Beyond BIG_BYTES of samples (or if
    ``big``) the file is a Big TIFF.
    """
    data = np.ascontiguousarray(r.data if r.data.ndim == 3 else r.data[None])
    bands, h, w = data.shape
    data = data.astype(data.dtype.newbyteorder("<"))
    big = data.nbytes > BIG_BYTES if big is None else big
    pack = _lzw_packed if lzw else (lambda b: zlib.compress(b, 6)) if deflate else bytes
    if tile:
        if tile % 16:
            raise ValueError("tiles are a multiple of 16 pixels")
        padded = np.zeros((bands, -(-h // tile) * tile, -(-w // tile) * tile), data.dtype)
        padded[:, :h, :w] = data
        blocks = [pack(padded[:, y : y + tile, x : x + tile].transpose(1, 2, 0).tobytes()) for y in range(0, h, tile) for x in range(0, w, tile)]
    else:
        blocks = [pack(data[:, y : y + strip_rows].transpose(1, 2, 0).tobytes()) for y in range(0, h, strip_rows)]
    blocks = blocks or [b""]
    fmt, place_type = {"u": 1, "i": 2, "f": 3}[data.dtype.kind], 16 if big else 4
    at_tag, size_tag = (TILE_AT, TILE_BYTES) if tile else (STRIP_AT, STRIP_BYTES)
    tags: list[tuple[int, int, list]] = [
        (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [data.dtype.itemsize * 8] * bands), (COMPRESSION, 3, [5 if lzw else 8 if deflate else 1]),
        (PHOTOMETRIC, 3, [2 if bands >= 3 and data.dtype.itemsize == 1 else 1]), (at_tag, place_type, [0] * len(blocks)), (SAMPLES, 3, [bands]),
        (size_tag, place_type, [len(s) for s in blocks]), (PLANAR, 3, [1]), (FORMAT, 3, [fmt] * bands),
    ]
    tags += [(TILE_W, 3, [tile]), (TILE_H, 3, [tile])] if tile else [(STRIP_ROWS, 4, [strip_rows])]
    if bands == 4 and data.dtype.itemsize == 1:
        tags.append((EXTRA, 3, [2]))  # the fourth is alpha
    g = r.gt
    if g[2] == g[4] == 0 and g[5] < 0 < g[1]:
        tags += [(SCALE, 12, [g[1], -g[5], 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, g[0], g[3], 0.0])]
    else:
        tags += [(TRANSFORM, 12, [g[1], g[2], 0.0, g[0], g[4], g[5], 0.0, g[3], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
    if r.epsg:
        tags.append((GEO_KEYS, 3, [1, 1, 0, 2, 1024, 0, 1, 1 if r.epsg != 4326 else 2, 3072 if r.epsg != 4326 else 2048, 0, 1, r.epsg]))
    if r.nodata is not None:
        tags.append((NODATA, 2, [f"{r.nodata:.17g}".encode() + b"\0"]))
    tags.sort()
    entry, room, count_code = (20, 8, "Q") if big else (12, 4, "I")
    at = (16 + 8 if big else 8 + 2) + entry * len(tags) + (8 if big else 4)
    extra, packed = b"", []
    for tag, kind, values in tags:
        size, code = TYPES[kind]
        body = values[0] if kind == 2 else struct.pack("<" + code * len(values), *values)
        packed.append([tag, kind, len(body) if kind == 2 else len(values), body, at + len(extra)])
        if len(body) > room:
            extra += body + b"\0" * (len(body) % 2)
    first = at + len(extra)
    places = np.cumsum([first] + [len(s) for s in blocks[:-1]]).tolist()
    directory = b""
    for tag, kind, n, body, place in packed:
        if tag == at_tag:
            body = struct.pack(f"<{n}{TYPES[kind][1]}", *places)
            if len(body) > room:
                extra = extra[: place - at] + body + extra[place - at + len(body) :]
        directory += struct.pack("<HH" + count_code, tag, kind, n) + (body.ljust(room, b"\0") if len(body) <= room else struct.pack("<" + count_code, place))
    head = b"II+\0" + struct.pack("<HHQQ", 8, 0, 16, len(tags)) if big else b"II*\0" + struct.pack("<IH", 8, len(tags))
    return head + directory + b"\0" * room + extra + b"".join(blocks)


def encode_png(data: np.ndarray) -> bytes:
    """8-bit gray, RGB or RGBA (height x width x 1, 3 or 4) as PNG."""
    data = data[..., None] if data.ndim == 2 else data
    h, w, n = data.shape
    rows = b"".join(b"\0" + data[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def image_size(blob: bytes) -> tuple[int, int] | None:
    """(width, height) of PNG, JPEG, GIF, BMP or TIFF bytes from their headers; None if unknown."""
    if blob[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack_from(">II", blob, 16)
    if blob[:3] == b"GIF":
        return struct.unpack_from("<HH", blob, 6)
    if blob[:2] == b"BM":
        w, h = struct.unpack_from("<ii", blob, 18)
        return w, abs(h)
    if blob[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(blob) and blob[at] == 255:
            if 0xC0 <= blob[at + 1] <= 0xCF and blob[at + 1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack_from(">HH", blob, at + 5)
                return w, h
            at += 2 + struct.unpack_from(">H", blob, at + 2)[0]
        return None
    try:
        return header(blob)[:2]
    except (ValueError, struct.error, KeyError):
        return None
