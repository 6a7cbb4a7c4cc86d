"""Shapefile bytes (.shp, .shx, .dbf) to and from records."""

from __future__ import annotations

import struct

# Shape codes of the format; Z and M variants read as their plain kind.
KINDS = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}
Part = list[tuple[float, float]]


def read_shapes(shp: bytes) -> list[tuple[str, list[Part]] | None]:
    """(type, parts of (x, y)) of each record; None for null shapes."""
    if struct.unpack_from(">i", shp)[0] != 9994:
        raise ValueError("no shapefile")
    out: list[tuple[str, list[Part]] | None] = []
    at = 100
    while at + 12 <= len(shp):
        (words,) = struct.unpack_from(">i", shp, at + 4)
        body = shp[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        (code,) = struct.unpack_from("<i", body)
        kind = KINDS.get(code % 10) if code else None
        if kind is None:
            out.append(None)
        elif kind == "Point":
            out.append((kind, [[struct.unpack_from("<2d", body, 4)]]))
        elif kind == "MultiPoint":
            (n,) = struct.unpack_from("<i", body, 36)
            out.append((kind, [[struct.unpack_from("<2d", body, 40 + 16 * k) for k in range(n)]]))
        else:
            parts, n = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
            points = [struct.unpack_from("<2d", body, 44 + 4 * parts + 16 * k) for k in range(n)]
            out.append((kind, [points[a:b] for a, b in zip(starts, starts[1:])]))
    return out


def read_fields(dbf: bytes) -> list[tuple[str, str, int, int]]:
    """(name, type, width, decimals) of the table's fields, from its header."""
    (size,) = struct.unpack_from("<H", dbf, 8)
    out = []
    for at in range(32, size - 1, 32):
        if dbf[at : at + 1] in (b"\r", b""):
            break
        out.append((dbf[at : at + 11].split(b"\0")[0].decode("utf-8", "replace"), chr(dbf[at + 11]), dbf[at + 16], dbf[at + 17]))
    return out


def read_records(dbf: bytes) -> list[dict | None]:
    """Values of each record, None for deleted ones (so that records and shapes keep their places); blanks are None."""
    n, size, width = struct.unpack_from("<IHH", dbf, 4)
    fields, out = read_fields(dbf), []
    for k in range(n):
        row = dbf[size + k * width : size + (k + 1) * width]
        if row[:1] == b"*":
            out.append(None)
            continue
        at, values = 1, {}
        for name, kind, w, decimals in fields:
            raw = row[at : at + w].decode("utf-8", "replace").strip()
            at += w
            values[name] = None if raw == "" or set(raw) == {"*"} else (int(raw) if decimals == 0 and "." not in raw and "e" not in raw.lower() else float(raw)) if kind in "NF" else raw
        out.append(values)
    return out


def write_layer(kind: str, shapes: list[list[Part] | None], fields: list[tuple[str, str, int, int]], records: list[dict]) -> tuple[bytes, bytes, bytes]:
    """(.shp, .shx, .dbf) of a layer."""
    code = {v: k for k, v in KINDS.items()}[kind]
    bodies, every = [], [p for s in shapes if s for part in s for p in part]

    def box(points) -> bytes:
        xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
        return struct.pack("<4d", min(xs), min(ys), max(xs), max(ys))

    for s in shapes:
        if not s:
            bodies.append(struct.pack("<i", 0))
        elif kind == "Point":
            bodies.append(struct.pack("<i2d", code, *s[0][0]))
        else:
            points = [p for part in s for p in part]
            starts = [sum(map(len, s[:k])) for k in range(len(s))]
            head = struct.pack("<i", code) + box(points) + struct.pack("<2i", len(s), len(points)) + struct.pack(f"<{len(s)}i", *starts)
            bodies.append(head + b"".join(struct.pack("<2d", *p[:2]) for p in points))
    shp = shx = b""
    at = 50
    for k, body in enumerate(bodies, 1):
        shx += struct.pack(">2i", at, len(body) // 2)
        shp += struct.pack(">2i", k, len(body) // 2) + body
        at += 4 + len(body) // 2

    def head(n: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + n) // 2) + struct.pack("<2i", 1000, code) + box(every) + b"\0" * 32

    rows = b""
    for r in records:
        rows += b" "
        for name, t, w, decimals in fields:
            v = r.get(name)
            text = "" if v is None else f"{v:.{decimals}f}" if t in "NF" and decimals else str(int(v)) if t in "NF" else str(v)
            raw = text.encode()[:w]
            rows += raw.rjust(w) if t in "NF" else raw.ljust(w)
    table = b"".join(f[0].encode()[:10].ljust(11, b"\0") + f[1].encode() + b"\0" * 4 + bytes([f[2], f[3]]) + b"\0" * 14 for f in fields)
    dbf = struct.pack("<4BIHH", 3, 124, 1, 1, len(records), 33 + 32 * len(fields), 1 + sum(f[2] for f in fields)) + b"\0" * 20 + table + b"\r" + rows + b"\x1a"
    return head(len(shp)) + shp, head(len(shx)) + shx, dbf
