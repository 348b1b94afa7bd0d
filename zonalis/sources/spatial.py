"""Python data sources of spatial files: GeoPackage layers, shapefiles and TIFF rasters (as tile rows).

    spark.dataSource.register(GeoPackage); spark.read.format("geopackage").option("layer", "zones").load(path)

The files must lie where the executors can open them.
"""

from __future__ import annotations

import sqlite3
import struct
import zlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from zonalis.functions.wkb import GEOMETRY, decode

TILE = "tile_id string, x0 double, y0 double, dx double, dy double, ncols int, nrows int, nodata double, band array<float>"


def _row(geometry: dict | None):
    if geometry is None:
        return None
    b = geometry["bbox"]
    rings = [[[(p["x"], p["y"]) for p in r] for r in polygon] for polygon in geometry["rings"]]
    return (geometry["kind"], geometry["srid"], rings, (b["xmin"], b["ymin"], b["xmax"], b["ymax"]))


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class GeoPackage(DataSource):
    """A layer of a GeoPackage, cut into ranges of row ids; options: path, layer (the first one by default), rows."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _layer(self, db) -> tuple[str, str, int]:
        return db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = coalesce(?, table_name) ORDER BY 1", (self.options.get("layer"),)).fetchone()

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            table, geom, _ = self._layer(db)
            kinds = {"INT": "bigint", "REAL": "double", "DOUB": "double", "FLOA": "double"}
            types = {name: GEOMETRY if name == geom else next((v for k, v in kinds.items() if k in (kind or "").upper()), "string") for _, name, kind, *_ in db.execute(f'PRAGMA table_info("{table}")')}
            return ", ".join(f"`{name}` {kind}" for name, kind in types.items())

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PackageReader(self.options, self._layer)


class _PackageReader(DataSourceReader):
    def __init__(self, options, layer):
        self.path, self.rows = options["path"], int(options.get("rows", "50000"))
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            self.table, self.geom, self.srid = layer(db)
            self.low, self.high = db.execute(f'SELECT coalesce(min(rowid), 1), coalesce(max(rowid), 0) FROM "{self.table}"').fetchone()

    def partitions(self):
        # without any partition read() would be called with none
        return [_Range(a, min(a + self.rows, self.high + 1)) for a in range(self.low, self.high + 1, self.rows)] or [_Range(self.low, self.low)]

    def read(self, partition):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            cursor = db.execute(f'SELECT * FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))
            at = [c[0] for c in cursor.description].index(self.geom)
            for row in cursor:
                yield (*row[:at], _row(self._geometry(row[at])), *row[at + 1 :])

    def _geometry(self, blob):
        if blob is None:
            return None
        flags = blob[3]
        srid = struct.unpack_from("<i" if flags & 1 else ">i", blob, 4)[0]
        # Bytes of the envelope by its code
        return decode(blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(flags >> 1) & 7] :], srid)


class Shapefile(DataSource):
    """The shapes of a .shp as (shape_no, geom); options: path, srid.  Points, lines and polygons."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return f"shape_no bigint, geom {GEOMETRY}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ShapeReader(self.options)


class _ShapeReader(DataSourceReader):
    # The shape types, each also with z (+10) and m (+20)
    KINDS = {1: "POINT", 3: "MULTILINESTRING", 5: "MULTIPOLYGON", 8: "MULTIPOINT"}

    def __init__(self, options):
        self.path, self.srid = options["path"], int(options.get("srid", "0"))

    def partitions(self):
        return [_Range(0, 0)]

    def read(self, partition):
        with open(self.path, "rb") as f:
            f.seek(100)
            while head := f.read(8):
                number, words = struct.unpack(">2i", head)
                yield number, self._shape(f.read(2 * words))

    def _shape(self, data: bytes):
        code = struct.unpack_from("<i", data)[0] % 10
        if code not in self.KINDS:
            return None
        if code == 1:
            at = [struct.unpack_from("<2d", data, 4)]
            rings = [[at]]
        else:
            if code == 8:
                n = struct.unpack_from("<i", data, 36)[0]
                first, starts = 40, range(n)
            else:
                parts, n = struct.unpack_from("<2i", data, 36)
                starts, first = struct.unpack_from(f"<{parts}i", data, 44), 44 + 4 * parts
            flat = struct.unpack_from(f"<{2 * n}d", data, first)
            at = list(zip(flat[::2], flat[1::2]))
            lines = [at[a:b] for a, b in zip(starts, [*starts[1:], n])]
            rings = [[line] for line in lines] if code != 5 else self._polygons(lines)
        xs, ys = zip(*at)
        return (self.KINDS[code], self.srid, rings, (min(xs), min(ys), max(xs), max(ys)))

    @staticmethod
    def _polygons(lines):
        """Clockwise rings begin a polygon; the others are holes of the one before."""
        out = []
        for ring in lines:
            turn = sum((b[0] - a[0]) * (b[1] + a[1]) for a, b in zip(ring, [*ring[1:], ring[0]]))
            if turn >= 0 or not out:
                out.append([ring])
            else:
                out[-1].append(ring)
        return out


class TiffTiles(DataSource):
    """A one-band TIFF, classic or big, in strips or tiles, plain or packed by deflate or LZW, with or without a predictor,
    as square tile rows; options: path (reachable from every node), tile (100).  Other packings raise.

    x0, y0 is the upper left corner, dy is negative as rows run south."""

    @classmethod
    def name(cls) -> str:
        return "tifftiles"

    def schema(self) -> str:
        return TILE

    def reader(self, schema) -> DataSourceReader:
        return _TiffReader(self.options)


def unpacked_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first; 256 empties the table, 257 ends."""
    out, table, width, bits, n, last = [], [], 9, 0, 0, b""
    for byte in data:
        bits, n = (bits << 8) | byte, n + 8
        if n < width:
            continue
        code = bits >> (n - width)
        n -= width
        bits &= (1 << n) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last:
            table.append(last + word[:1])
        last = word
        # one code earlier than the table is full
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


class _TiffReader(DataSourceReader):
    # Bytes and codes of the field types
    TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}

    def __init__(self, options):
        self.path, self.tile = options["path"], int(options.get("tile", "100"))
        with open(self.path, "rb") as f:
            head = f.read(16)
            self.order = o = "<" if head[:2] == b"II" else ">"
            big = struct.unpack(o + "H", head[2:4])[0] == 43
            word, entry = ("Q", 20) if big else ("I", 12)
            inline = struct.calcsize(word)
            f.seek(struct.unpack(o + word, head[8:16] if big else head[4:8])[0])
            n = struct.unpack(o + ("Q" if big else "H"), f.read(8 if big else 2))[0]
            self.tags = {}
            for raw in [f.read(entry) for _ in range(n)]:
                tag, kind, count = struct.unpack(o + "HH" + word, raw[: 4 + inline])
                size, code = self.TYPES.get(kind, (1, "B"))
                if size * count > inline:
                    back = f.tell()
                    f.seek(struct.unpack(o + word, raw[4 + inline :])[0])
                    data = f.read(size * count)
                    f.seek(back)
                else:
                    data = raw[4 + inline : 4 + inline + size * count]
                self.tags[tag] = data.rstrip(b"\0").decode() if kind == 2 else list(struct.unpack(f"{o}{count}{code}", data)) if len(code) == 1 else []
        self.ncols, self.nrows = self.tags[256][0], self.tags[257][0]
        if self.tags.get(259, [1])[0] not in (1, 5, 8, 32946) or self.tags.get(317, [1])[0] not in (1, 2, 3) or self.tags.get(277, [1])[0] != 1:
            raise ValueError(f"{self.path}: compression, predictor or number of bands not supported")

    def partitions(self):
        return [_Range(a, min(a + self.tile, self.nrows)) for a in range(0, self.nrows, self.tile)]

    def _block(self, data: bytes, kind: str, w: int):
        import numpy as np

        packing, predictor = self.tags.get(259, [1])[0], self.tags.get(317, [1])[0]
        data = zlib.decompress(data) if packing in (8, 32946) else unpacked_lzw(data) if packing == 5 else data
        size = int(kind[1])
        if predictor == 3:
            # the bytes of a row's numbers lie highest first, one after another, as differences
            rows = np.cumsum(np.frombuffer(data, np.uint8).reshape(-1, w * size), axis=1, dtype=np.uint8).reshape(-1, size, w)
            return np.ascontiguousarray(rows.transpose(0, 2, 1)).view(f">{kind}")[:, :, 0]
        block = np.frombuffer(data, np.dtype(kind).newbyteorder(self.order)).reshape(-1, w)
        return np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("=")) if predictor == 2 else block

    def _rows(self, f, low, high):
        import numpy as np

        t = self.tags
        kind = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}[(t.get(339, [1])[0], t.get(258, [8])[0])]
        out = np.empty((high - low, self.ncols), np.float32)
        tiled = 322 in t
        w, h = (t[322][0], t[323][0]) if tiled else (self.ncols, t.get(278, [self.nrows])[0])
        offsets, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
        across = -(-self.ncols // w)
        for k in range(low // h * across, min(len(offsets), ((high - 1) // h + 1) * across)):
            f.seek(offsets[k])
            block = self._block(f.read(sizes[k]), kind, w)
            r0, c0 = k // across * h, k % across * w
            a, b = max(low, r0), min(high, r0 + len(block))
            out[a - low : b - low, c0 : c0 + w] = block[a - r0 : b - r0, : self.ncols - c0]
        return out

    def read(self, partition):
        scale, tie = self.tags.get(33550, [1.0, 1.0, 0.0]), self.tags.get(33922, [0.0] * 6)
        nodata = float(self.tags[42113]) if 42113 in self.tags else None
        with open(self.path, "rb") as f:
            band = self._rows(f, partition.low, partition.high)
        for c in range(0, self.ncols, self.tile):
            part = band[:, c : c + self.tile]
            x0, y0 = tie[3] + (c - tie[0]) * scale[0], tie[4] - (partition.low - tie[1]) * scale[1]
            yield (f"{partition.low}_{c}", x0, y0, scale[0], -scale[1], part.shape[1], part.shape[0], nodata, part.ravel().tolist())
