"""Well-known binary to and from the geometry struct, as Arrow functions."""

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "struct<kind:string,srid:int,rings:array<array<array<struct<x:double,y:double>>>>,bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>"
# The type codes of the format.
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON"}
CODES = {v: k for k, v in KINDS.items()}


def decode(data: bytes, srid: int = 0) -> dict | None:
    """A geometry as nested dicts: points and lines are polygons of one ring each; None for other types and empty ones."""

    def numbers(at: int, order: str, n: int, dims: int) -> tuple[list[tuple[float, float]], int]:
        flat = struct.unpack_from(f"{order}{n * dims}d", data, at)
        return [(flat[i], flat[i + 1]) for i in range(0, n * dims, dims)], at + 8 * n * dims

    def one(at: int) -> tuple[int, int, list, int]:
        order = "<" if data[at] else ">"
        code = struct.unpack_from(f"{order}I", data, at + 1)[0]
        at += 5
        own = 0
        if code & 0x20000000:
            own = struct.unpack_from(f"{order}i", data, at)[0]
            at += 4
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        code &= 0x0FFFFFFF
        dims += (code // 1000 in (1, 3)) + (code // 1000 in (2, 3))
        code %= 1000
        if code == 1:
            points, at = numbers(at, order, 1, dims)
            return code, own, [[points]], at
        n = struct.unpack_from(f"{order}I", data, at)[0]
        at += 4
        if code == 2:
            points, at = numbers(at, order, n, dims)
            return code, own, [[points]], at
        if code == 3:
            rings = []
            for _ in range(n):
                k = struct.unpack_from(f"{order}I", data, at)[0]
                ring, at = numbers(at + 4, order, k, dims)
                rings.append(ring)
            return code, own, [rings], at
        parts: list = []
        for _ in range(n):
            _, _, inner, at = one(at)
            parts += inner
        return code, own, parts, at

    code, own, parts, _ = one(0)
    flat = [p for polygon in parts for ring in polygon for p in ring]
    if code not in KINDS or not flat or flat[0][0] != flat[0][0]:
        return None
    xs, ys = [p[0] for p in flat], [p[1] for p in flat]
    return {
        "kind": KINDS[code], "srid": own or srid, "rings": [[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in parts],
        "bbox": {"xmin": min(xs), "ymin": min(ys), "xmax": max(xs), "ymax": max(ys)},
    }


def encode(kind: str, rings) -> bytes:
    """Little-endian two-dimensional WKB; rings of polygons are closed."""

    def points(ring, closed: bool = False) -> bytes:
        at = [(p["x"], p["y"]) for p in ring]
        if closed and at[0] != at[-1]:
            at.append(at[0])
        return struct.pack("<I", len(at)) + b"".join(struct.pack("<2d", *p) for p in at)

    def single(code: int, polygon) -> bytes:
        head = struct.pack("<BI", 1, code)
        if code == 1:
            return head + struct.pack("<2d", polygon[0][0]["x"], polygon[0][0]["y"])
        if code == 2:
            return head + points(polygon[0])
        return head + struct.pack("<I", len(polygon)) + b"".join(points(r, True) for r in polygon)

    code = CODES[kind]
    if code <= 3:
        return single(code, rings[0])
    return struct.pack("<BII", 1, code, len(rings)) + b"".join(single(code - 3, p) for p in rings)


def from_wkb(c: Column, srid: int = 0) -> Column:
    @F.pandas_udf(GEOMETRY)
    def run(data: pd.Series) -> pd.DataFrame:
        out = [decode(bytes(b), srid) if b is not None else None for b in data]
        return pd.DataFrame({k: [g and g[k] for g in out] for k in ("kind", "srid", "rings", "bbox")})

    found = run(c)
    return F.when(found["kind"].isNotNull(), found)


def to_wkb(geom: Column) -> Column:
    @F.pandas_udf("binary")
    def run(kind: pd.Series, rings: pd.Series) -> pd.Series:
        return pd.Series([None if k is None or r is None or not len(r) else encode(k, r) for k, r in zip(kind, rings)])

    return run(geom["kind"], geom["rings"])
