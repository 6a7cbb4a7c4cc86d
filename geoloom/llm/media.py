"""Media columns: baseline JPEG written and read with numpy alone.

``encode_media`` stores bytes losslessly: the format's unit is the quantised DC
coefficient of an 8 x 8 block, so with a DC quantiser of 8 each block's mean is
one payload byte, and the image's DC-only luminance thumbnail is the payload, 24
blocks to a row. Every row of blocks is a restart interval. Payloads beyond one
image's height go on in further images, back to back.

``decode_jpegs`` reads any baseline JPEG: it parses the markers, Huffman-decodes
the scans (all restart segments of a batch in step, one symbol each), and
reconstructs the luminance thumbnail from DC coefficients. ``media_features``
stores dimensions and thumbnail hashes.

A null text is stored as the empty one. Texts are padded with bytes 255 to a
positive multiple of 576. Bytes that are no baseline JPEG give a null feature
and the reason in ``error``. Rows are answered on their own; further columns are
ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAD, UNIT, ROW = 255, 576, 24
#: Blocks of an image's height: 8 rows of pixels each, below the format's 65,535.
MAX_ROWS = 8184
#: Payload bytes that are coded together.
GROUP_BYTES = 2 << 20
# Numbers of Huffman codes by length, as in the format's example table for DC luminance.
DC_BITS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
AC_BITS = [1] + [0] * 15
RESTART, SCAN_END = re.compile(rb"\xff[\xd0-\xd7]"), re.compile(rb"\xff+[^\xff\x00\xd0-\xd7]")


def canonical(bits: list[int]) -> list[tuple[int, int]]:
    """(code, length) of each symbol, in the table's order."""
    out, code = [], 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((code, length))
            code += 1
        code <<= 1
    return out


def _diff_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and lengths that stand for a DC difference of -255 to 255 and the end of its block."""
    table, codes, lengths = canonical(DC_BITS), [], []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = table[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        codes.append((code << size | extra) << 1)
        lengths.append(length + size + 1)
    return np.array(codes, np.uint32), np.array(lengths, np.int64)


CODES, LENGTHS = _diff_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    tables = _segment(0xDB, b"\0" + b"\x08" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + b"\x01\x11\0")
    tables += _segment(0xC4, b"\0" + bytes(DC_BITS) + bytes(range(12))) + _segment(0xC4, b"\x10" + bytes(AC_BITS) + b"\0")
    return b"\xff\xd8" + tables + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, b"\x01\x01\0\0\x3f\0")


def _encode_images(rows: np.ndarray, heights: list[int]) -> list[bytes]:
    """One JPEG for each run of ``heights`` rows of a (n, 24) array of bytes."""
    dc = rows.astype(np.int16) - 128
    diff = np.diff(dc, axis=1, prepend=np.int16(0)).astype(np.int32) + 255
    code, length = CODES[diff], LENGTHS[diff]
    total = length.sum(axis=1)
    start = np.cumsum(length, axis=1) - length
    n, width = len(rows), int(total.max()) // 8 + 4
    packed = np.zeros(n * width, np.uint8)
    base = np.arange(n, dtype=np.int64) * width
    for j in range(ROW):
        at = base + (start[:, j] >> 3)
        value = code[:, j] << (24 - length[:, j] - (start[:, j] & 7)).astype(np.uint32)
        packed[at] |= (value >> 16).astype(np.uint8)
        packed[at + 1] |= (value >> 8 & 255).astype(np.uint8)
        packed[at + 2] |= (value & 255).astype(np.uint8)
    used = (total + 7) >> 3
    packed[base + used - 1] |= ((1 << (used * 8 - total)) - 1).astype(np.uint8)
    heights_, first = np.asarray(heights), np.cumsum([0, *heights[:-1]])
    number = np.arange(n) - np.repeat(first, heights_)  # of the row in its image
    last = np.repeat(heights_, heights_) - 1 == number
    packed = packed.reshape(n, width)
    column = np.arange(width)
    marker = (column == used[:, None]) | (column == used[:, None] + 1)
    packed[np.arange(n), used] = 255
    packed[np.arange(n), used + 1] = 0xD0 | number & 7
    keep = (column < used[:, None]) | (marker & ~last[:, None])
    data, marks = packed[keep], marker[keep]
    stuffed = (data == 255) & ~marks
    place = np.cumsum(stuffed) - stuffed + np.arange(len(data))
    out = np.zeros(len(data) + int(stuffed.sum()), np.uint8)
    out[place] = data
    ends = np.cumsum(keep.sum(axis=1))[first + heights_ - 1]
    ends = ends + np.cumsum(stuffed)[ends - 1]
    flat, images, begin = out.tobytes(), [], 0
    for h, end in zip(heights, ends.tolist()):
        images.append(_header(h) + flat[begin:end] + b"\xff\xd9")
        begin = end
    return images


def pad(data: bytes) -> bytes:
    return data + bytes([PAD]) * (-len(data) % UNIT or (0 if data else UNIT))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload (a positive multiple of 576 bytes)."""
    pieces = [(k, p[i : i + MAX_ROWS * ROW]) for k, p in enumerate(payloads) for i in range(0, len(p), MAX_ROWS * ROW)]
    out: list[list[bytes]] = [[] for _ in payloads]
    while pieces:
        size, n = 0, 0
        while n < len(pieces) and size < GROUP_BYTES:
            size += len(pieces[n][1])
            n += 1
        group, pieces = pieces[:n], pieces[n:]
        rows = np.frombuffer(b"".join(p for _, p in group), np.uint8).reshape(-1, ROW)
        for (k, _), image in zip(group, _encode_images(rows, [len(p) // ROW for _, p in group])):
            out[k].append(image)
    return [b"".join(x) for x in out]


class Image:
    """The parts of one baseline JPEG that its luminance thumbnail needs."""

    def __init__(self, data: bytes, at: int):
        self.quant, huff, self.restart, frame = {}, {}, 0, None
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        self.scan = None
        while True:
            if data[at : at + 1] != b"\xff":
                raise ValueError("a marker is missing")
            while data[at + 1 : at + 2] == b"\xff":
                at += 1
            marker = data[at + 1] if at + 1 < len(data) else 0xD9
            if marker == 0xD9:
                at += 2
                break
            if marker == 0x01 or 0xD0 <= marker <= 0xD7:
                at += 2
                continue
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + bool(wide)) :]
            elif marker == 0xC4:
                while body:
                    bits = list(body[1:17])
                    huff[body[0]] = (tuple(bits), bytes(body[17 : 17 + sum(bits)]))
                    body = body[17 + sum(bits) :]
            elif marker in (0xC0, 0xC1):
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise ValueError("samples are not of 8 bits")
                frame = {body[6 + 3 * i]: (i, body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xDD:
                (self.restart,) = struct.unpack_from(">H", body)
            elif marker == 0xDA:
                found = SCAN_END.search(data, at)
                end = found.start() if found else len(data)
                scan = [(frame[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
                if self.scan is None and any(c[0] == 0 for c, _ in scan):
                    self._plan(frame, scan, huff, data[at:end])
                at = end
        self.end = at
        if self.scan is None:
            raise ValueError("no luminance scan")

    def _plan(self, frame, scan, huff, data: bytes) -> None:
        most_h, most_v = max(c[1] for c in frame.values()), max(c[2] for c in frame.values())
        _, h, v, q = next(c for c in frame.values() if c[0] == 0)
        self.q = self.quant[q]
        self.wide, self.high = -(-self.width * h // (8 * most_h)), -(-self.height * v // (8 * most_v))
        if len(scan) == 1:
            h = v = 1
            self.mcus = self.wide, self.high
        else:
            self.mcus = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        self.h, self.v = h, v
        blocks = []
        for (i, ch, cv, _), tables in scan:
            blocks += [(i, huff[tables >> 4], huff[16 | tables & 15])] * (ch * cv if len(scan) > 1 else 1)
        self.scan = tuple(blocks)
        total = self.mcus[0] * self.mcus[1]
        step = self.restart or total
        self.counts = [min(step, total - k) for k in range(0, total, step)]
        parts = RESTART.split(data) if self.restart else [data]
        if len(parts) < len(self.counts):
            raise ValueError("the scan is cut short")
        self.parts = [p.replace(b"\xff\x00", b"\xff") for p in parts[: len(self.counts)]]


def _lookup(table: tuple[tuple[int, ...], bytes]) -> np.ndarray:
    """By the next 16 bits: length of the code << 8 | symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.uint64)
    for (code, length), symbol in zip(canonical(list(table[0])), table[1]):
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


def _decode_scans(images: list[Image]) -> list[np.ndarray]:
    """Luminance DC coefficients, in the order of the scan, of images with one scan plan."""
    counts = np.array([n for x in images for n in x.counts])
    parts = [p for x in images for p in x.parts]
    sizes = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts) + b"\0" * 8, np.uint8)
    window = np.zeros(len(data) - 7, np.uint64)  # the 8 bytes from each place on
    for k in range(8):
        window |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    order = np.argsort(-counts, kind="stable")
    counts_, limit = counts[order], (np.cumsum(sizes) * 8)[order]
    pos = ((np.cumsum(sizes) - sizes) * 8)[order].astype(np.int64)
    plan = [(c, _lookup(d), _lookup(a)) for c, d, a in images[0].scan]
    per = sum(c == 0 for c, _, _ in plan)
    out = np.zeros((len(parts), int(counts_[0]) * per), np.int32)
    pred = {c: np.zeros(len(parts), np.int64) for c, _, _ in plan}
    u = np.uint64
    ends = np.searchsorted(-counts_, -np.arange(int(counts_[0])), side="left")  # segments with more than m units

    def peek(p: np.ndarray) -> np.ndarray:
        return window[np.minimum(p >> 3, len(window) - 1)] << (p & 7).astype(u)

    for m in range(int(counts_[0])):
        n, k = int(ends[m]), 0
        p = pos[:n]
        for component, dc, ac in plan:
            x = peek(p)
            e = dc[x >> u(48)]
            length, size = e >> u(8), e & u(255)
            extra = (x << length) >> u(1) >> (u(63) - size)
            half = (u(1) << size) >> u(1)
            value = extra.astype(np.int64) - np.where((extra < half) & (size > 0), (u(1) << size).astype(np.int64) - 1, 0)
            bad = length == 0
            pred[component][:n] += value
            if component == 0:
                out[:n, m * per + k] = pred[component][:n]
                k += 1
            p += (length + size).astype(np.int64)
            live, index = slice(None), np.ones(n, np.int64)  # place of the next AC coefficient
            while True:
                x = peek(p[live])
                e = ac[x >> u(48)]
                symbol = (e & u(255)).astype(np.int64)
                bad_ac = e == 0
                p[live] += ((e >> u(8)).astype(np.int64)) + (symbol & 15)
                index[live] += np.where(symbol == 0, 64, (symbol >> 4) + 1)
                if bad_ac.any() or bad.any():
                    raise ValueError("a code is in no Huffman table")
                more = np.flatnonzero(index < 64)
                if not len(more):
                    break
                live = more
        if (p > limit[:n]).any():
            raise ValueError("the scan is cut short")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    found, s = [], 0
    for x in images:
        rows = back[s : s + len(x.counts)]
        s += len(x.counts)
        full = out[rows, : x.counts[0] * per].reshape(-1)
        found.append(full[: sum(x.counts) * per])
    return found


def _thumbnail(x: Image, dc: np.ndarray) -> np.ndarray:
    wide, high = x.mcus
    grid = dc[: wide * high * x.h * x.v].reshape(high, wide, x.v, x.h).transpose(0, 2, 1, 3).reshape(high * x.v, wide * x.h)
    grid = grid[: x.high, : x.wide].astype(np.int64) * x.q
    return np.clip((grid + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def _decode_group(images: list[Image]) -> list[np.ndarray]:
    groups = defaultdict(list)
    for k, x in enumerate(images):
        groups[x.scan].append(k)
    out: list = [None] * len(images)
    for ks in groups.values():
        for k, dc in zip(ks, _decode_scans([images[k] for k in ks])):
            out[k] = _thumbnail(images[k], dc)
    return out


def decode_jpegs(blobs: list[bytes | None]) -> list[tuple[list[np.ndarray], tuple[int, int] | None, str | None]]:
    """(thumbnails of the images in each blob, pixel dimensions of the first, error)."""
    out: list = [([], None, "null") for _ in blobs]
    queue: list[tuple[int, Image]] = []
    size = 0

    def flush() -> None:
        try:
            thumbs = _decode_group([x for _, x in queue])
        except ValueError:  # find the ones at fault
            thumbs = []
            for _, x in queue:
                try:
                    thumbs += _decode_group([x])
                except ValueError as e:
                    thumbs.append(str(e))
        for (k, x), t in zip(queue, thumbs):
            if isinstance(t, str):
                out[k] = ([], None, t)
            elif out[k][2] is None:
                out[k][0].append(t)
        queue.clear()

    for k, blob in enumerate(blobs):
        if blob is None:
            continue
        blob, images, at = bytes(blob), [], 0
        try:
            while at < len(blob) or not images:
                images.append(Image(blob, at))
                at = images[-1].end
        except (ValueError, struct.error, IndexError, KeyError, StopIteration) as e:
            out[k] = ([], None, str(e) or "broken")
            continue
        out[k] = ([], (images[0].width, images[0].height), None)
        for x in images:
            queue.append((k, x))
            size += sum(map(len, x.parts))
            if size >= GROUP_BYTES:
                flush()
                size = 0
    flush()
    return out


def stacked(thumbs: list[np.ndarray]) -> np.ndarray:
    """All thumbnails of a blob as one, top to bottom; narrower ones are filled up with 0."""
    width = max(t.shape[1] for t in thumbs)
    return np.vstack([np.pad(t, ((0, 0), (0, width - t.shape[1]))) for t in thumbs])


def thumbnail_hashes(thumb: np.ndarray) -> tuple[str, str]:
    """Average hash and difference hash of the thumbnail's 8 x 9 cell means, 64 bits in hex each."""
    h, w = thumb.shape
    ys, xs = np.arange(8) * h // 8, np.arange(9) * w // 9
    cells = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), ys, axis=0), xs, axis=1)
    rows = np.maximum(np.diff([*ys, h]), 1)[:, None] * np.maximum(np.diff([*xs, w]), 1)
    cells = cells / rows
    average = cells[:, :8] > cells[:, :8].mean()
    difference = cells[:, 1:] > cells[:, :-1]
    return np.packbits(average).tobytes().hex(), np.packbits(difference).tobytes().hex()


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the stored form) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column("text").to_pylist()]
            start = 0
            while start < len(texts):  # batches as large as a group, so that no text waits for many
                stop, size = start, 0
                while stop < len(texts) and size < GROUP_BYTES:
                    size += len(texts[stop])
                    stop += 1
                part = texts[start:stop]
                arrays = [b.column("doc_id").slice(start, stop - start), pa.array([len(x) for x in part], pa.int64()), pa.array(encode_payloads([pad(x) for x in part]), pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "media"])
                start = stop

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, feature string, error string"


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes of doc_id, n_bytes, media hold, read back from them alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column("media").to_pylist()
            rows = []
            for i, n, blob, (thumbs, size, error) in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), blobs, decode_jpegs(blobs)):
                stored = (len(blob), hashlib.sha256(blob).hexdigest()) if blob is not None else (None, None)
                if error:
                    rows.append((i, n, None, None, None, *stored, None, None, None, error))
                    continue
                payload = b"".join(t.tobytes() for t in thumbs)
                average, difference = thumbnail_hashes(stacked(thumbs))
                sha = hashlib.sha256(payload).hexdigest()
                rows.append((i, n, len(payload), sha, zlib.crc32(payload[-32:]), *stored, *size, f"jpeg:{size[0]}x{size[1]}x{len(thumbs)}:a{average}:d{difference}", None))
            names = [x.split()[0] for x in FEATURES.split(", ")]
            kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in FEATURES.split(", ")]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return media_features(encode_media(docs)).drop("error")


QUERIES = {"op8_media_columns": op8_media_columns}
SQL: dict[str, str] = {}
