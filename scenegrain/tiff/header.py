"""TIFF and BigTIFF headers: tags, tile layout, transform, nodata and coordinate system."""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrain.functions.crs import parse_epsg
from scenegrain.sources.bytes import default_source

# TIFF tag numbers and field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 277, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, EXTRA_SAMPLES, SAMPLE_FORMAT = 322, 323, 324, 325, 338, 339
PIXEL_SCALE, TIEPOINT, MODEL_TRANSFORM, GEO_KEYS, GEO_ASCII, GDAL_METADATA, GDAL_NODATA = 33550, 33922, 34264, 34735, 34737, 42112, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
KINDS = {1: "uint", 2: "int", 3: "float"}

STRUCT = (
    "image_width int, image_height int, tile_width int, tile_height int, dtype string, transform array<double>, predictor int, compression int, "
    "tile_offsets array<bigint>, tile_byte_counts array<bigint>, pixel_scale array<double>, tiepoint array<double>, nodata double, "
    "samples_per_pixel int, planar_configuration int, photometric int, extra_samples array<int>, byte_order string, epsg int"
)


@dataclass
class Header:
    width: int
    height: int
    tile_width: int
    tile_height: int
    dtype: str
    transform: tuple[float, float, float, float]
    compression: int
    predictor: int
    offsets: list[int]
    sizes: list[int]
    nodata: float | None
    samples: int
    planar: int
    photometric: int | None
    extra_samples: list[int] | None
    big_endian: bool
    epsg: int | None
    pixel_scale: list[float] | None = None
    tiepoint: list[float] | None = None
    tags: dict = field(default_factory=dict, repr=False)

    def row(self) -> dict:
        return {
            "image_width": self.width, "image_height": self.height, "tile_width": self.tile_width, "tile_height": self.tile_height, "dtype": self.dtype,
            "transform": list(self.transform), "predictor": self.predictor, "compression": self.compression, "tile_offsets": self.offsets, "tile_byte_counts": self.sizes,
            "pixel_scale": self.pixel_scale, "tiepoint": self.tiepoint, "nodata": self.nodata, "samples_per_pixel": self.samples, "planar_configuration": self.planar,
            "photometric": self.photometric, "extra_samples": self.extra_samples, "byte_order": ">" if self.big_endian else "<", "epsg": self.epsg,
        }

    @classmethod
    def of(cls, m: dict) -> Header:
        """From a stored struct; absent optional fields take TIFF's defaults."""
        return cls(m["image_width"], m["image_height"], m["tile_width"], m["tile_height"], m["dtype"], tuple(m["transform"]), m.get("compression") or 1, m.get("predictor") or 1, list(m["tile_offsets"]), list(m["tile_byte_counts"]), m.get("nodata"), m.get("samples_per_pixel") or 1, m.get("planar_configuration") or 1, m.get("photometric"), m.get("extra_samples"), m.get("byte_order") == ">", m.get("epsg"))


def read_tags(read) -> tuple[dict[int, tuple], str]:
    """Tags of the first directory, by number, and the byte order. ``read(offset, size)`` gives bytes; values of unknown types stay bytes."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError("not a TIFF")
    (magic,) = struct.unpack_from(order + "H", head, 2)
    if magic == 42:
        big, (at,) = False, struct.unpack_from(order + "I", head, 4)
    elif magic == 43:
        big, (at,) = True, struct.unpack_from(order + "Q", head, 8)
    else:
        raise ValueError("not a TIFF")
    count_code, entry = ("Q", 20) if big else ("H", 12)
    n_bytes = struct.calcsize(order + count_code)
    (n,) = struct.unpack(order + count_code, read(at, n_bytes))
    table = read(at + n_bytes, n * entry)
    tags = {}
    for i in range(n):
        tag, kind = struct.unpack_from(order + "HH", table, i * entry)
        (count,) = struct.unpack_from(order + ("Q" if big else "I"), table, i * entry + 4)
        code = TYPES.get(kind, "s")
        size = struct.calcsize("=" + code) * count
        inline = 8 if big else 4
        spot = i * entry + (12 if big else 8)
        if size <= inline:
            raw = table[spot : spot + size]
        else:
            (where,) = struct.unpack_from(order + ("Q" if big else "I"), table, spot)
            raw = read(where, size)
        if len(raw) < size:
            raise ValueError("cut off")
        tags[tag] = (raw,) if code == "s" else struct.unpack(order + code * count if len(code) > 1 else f"{order}{count}{code}", raw)
    return tags, order


def parse_nodata(text) -> float | None:
    text = (text.decode("ascii", "ignore") if isinstance(text, bytes) else str(text)).strip().strip("\x00").strip()
    try:
        return float(text) if text else None
    except ValueError:
        return None


def nodata_of(tags: dict[int, tuple]) -> float | None:
    """Of its own tag, else the first value in GDAL's metadata."""
    if GDAL_NODATA in tags:
        return parse_nodata(tags[GDAL_NODATA][0])
    if GDAL_METADATA in tags:
        try:
            root = ET.fromstring(tags[GDAL_METADATA][0].decode("utf-8", "ignore").strip("\x00"))
        except ET.ParseError:
            return None
        for item in root.iter("Item"):
            if item.get("name") in ("NODATA_VALUES", "NODATA_VALUE") and (item.text or "").split():
                return parse_nodata(item.text.split()[0])
    return None


def geo_keys(tags: dict[int, tuple]) -> dict[int, int]:
    """Short-valued GeoKeys."""
    k = tags.get(GEO_KEYS, ())
    return {k[i]: k[i + 3] for i in range(4, min(len(k) - 3, 4 + 4 * (k[3] if len(k) > 3 else 0)), 4) if k[i + 1] == 0}


def epsg_of(tags: dict[int, tuple]) -> int | None:
    """Of WKT in the text keys, else the projected, else the geographic code."""
    if GEO_ASCII in tags and (found := parse_epsg(tags[GEO_ASCII][0].decode("latin-1"))) and re.search("ID", tags[GEO_ASCII][0].decode("latin-1")):
        return found
    keys = geo_keys(tags)
    return next((keys[k] for k in (3072, 2048) if 0 < keys.get(k, 0) < 32767), None)


def transform_of(tags: dict[int, tuple]) -> tuple[float, float, float, float]:
    """(sx, tx, sy, ty) of the upper left corner of pixel (0, 0)."""
    if MODEL_TRANSFORM in tags:
        m = tags[MODEL_TRANSFORM]
        if len(m) != 16:
            raise NotImplementedError("a model transformation has 16 values")
        if any(abs(m[i]) > 1e-12 for i in (1, 2, 4, 6, 8, 9, 11, 12, 13, 14)) or abs(m[15] - 1) > 1e-12:
            raise NotImplementedError("rotated or sheared transforms are not supported")
        sx, tx, sy, ty = m[0], m[3], m[5], m[7]
    elif PIXEL_SCALE in tags and TIEPOINT in tags:
        sx, sy = tags[PIXEL_SCALE][0], -tags[PIXEL_SCALE][1]
        t = tags[TIEPOINT]
        if len(t) < 6 or len(t) % 6:
            raise ValueError("tiepoints have six values each")
        origins = [(t[i + 3] - t[i] * sx, t[i + 4] - t[i + 1] * sy) for i in range(0, len(t), 6)]
        tx, ty = origins[0]
        if any(abs(a - tx) > 1e-6 or abs(b - ty) > 1e-6 for a, b in origins):
            raise NotImplementedError("tiepoints disagree on the origin")
    else:
        raise NotImplementedError("no georeferencing tags")
    if geo_keys(tags).get(1025) == 2:  # coordinates name pixel centres
        tx, ty = tx - sx / 2, ty - sy / 2
    return float(sx), float(tx), float(sy), float(ty)


def tiepoint_columns(scale_x: Column, scale_y: Column, i: Column, j: Column, x: Column, y: Column, raster_type: Column) -> tuple[Column, Column, Column, Column]:
    """The same arithmetic for columns of pixel scale and one tiepoint."""
    sx, sy = scale_x, -scale_y
    half = F.when(raster_type == 2, 0.5).otherwise(0.0)
    return sx, x - i * sx - sx * half, sy, y - j * sy - sy * half


def parse(read) -> Header:
    """A header from a byte source; raises for what isn't a tiled, georeferenced file of a known layout."""
    tags, order = read_tags(read)
    one = lambda t, default=None: tags[t][0] if t in tags else default
    kind, bits = KINDS.get(one(SAMPLE_FORMAT, 1)), one(BITS, 8)
    if kind is None or bits not in ((16, 32, 64) if kind == "float" else (8, 16, 32, 64)):
        raise NotImplementedError(f"pixel type {one(SAMPLE_FORMAT, 1)}, {bits} bits")
    if TILE_OFFSETS not in tags or TILE_SIZES not in tags:
        raise NotImplementedError("only tiled files can be read")
    if one(COMPRESSION, 1) == 7:
        raise NotImplementedError("JPEG tiles are not supported")
    return Header(
        one(WIDTH), one(HEIGHT), one(TILE_WIDTH), one(TILE_HEIGHT), f"{kind}{bits}", transform_of(tags), one(COMPRESSION, 1), one(PREDICTOR, 1),
        list(tags[TILE_OFFSETS]), list(tags[TILE_SIZES]), nodata_of(tags), one(SAMPLES, 1), one(PLANAR, 1), one(PHOTOMETRIC),
        list(tags[EXTRA_SAMPLES]) if EXTRA_SAMPLES in tags else None, order == ">", epsg_of(tags),
        list(tags[PIXEL_SCALE]) if PIXEL_SCALE in tags else None, list(tags[TIEPOINT]) if TIEPOINT in tags else None, tags,
    )


def parse_headers(urls: DataFrame, column: str = "href", source=None) -> DataFrame:
    """Rows (href, header struct, error): files that can't be read have a null header and say why; one bad file spoils nothing."""
    source = source or default_source()

    def run(batches):
        for b in batches:
            heads, errors = [], []
            for url in b.column(0).to_pylist():
                try:
                    heads.append(parse(lambda at, n, u=url: source.get_range(u, at, n)).row())
                    errors.append(None)
                except Exception as e:
                    heads.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            kinds = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
            t = pa.struct([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in STRUCT.split(", ")])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(heads, t), pa.array(errors, pa.string())], names=["href", "header", "error"])

    inner = ", ".join(f"{f.split(' ')[0]}: {f.split(' ')[1]}" for f in STRUCT.split(", "))
    return urls.select(F.col(column).alias("href")).mapInArrow(run, f"href string, header struct<{inner}>, error string")
