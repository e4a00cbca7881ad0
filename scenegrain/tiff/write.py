"""A small writer of tiled GeoTIFFs, for fixtures and exports."""

from __future__ import annotations

import lzma
import struct
import zlib

import numpy as np

from scenegrain.tiff import decode, header


def _lzw(data: bytes) -> bytes:
    acc, bits, out = 0, 0, bytearray()
    table = {bytes([i]): i for i in range(256)}
    width, word = 9, b""

    def put(code):
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1

    put(256)
    n = 258
    for b in data:
        c = word + bytes([b])
        if c in table:
            word = c
            continue
        put(table[word])
        table[c] = n
        n += 1
        if n == (1 << width) and width < 12:
            width += 1
        if n >= 4094:
            put(256)
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([b])
    if word:
        put(table[word])
        n += 1
        if n == (1 << width) and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def compress(data: bytes, code: int) -> bytes:
    if code == decode.NONE:
        return data
    if code in (decode.DEFLATE, decode.OLD_DEFLATE):
        return zlib.compress(data)
    if code == decode.LZW:
        return _lzw(data)
    if code == decode.LZMA:
        return lzma.compress(data)
    if code == decode.PACKBITS:
        return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128))
    if code == decode.ZSTD:
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    raise NotImplementedError(f"compression {code}")


def predict(a: np.ndarray, predictor: int) -> bytes:
    """(rows, cols, samples) as the bytes a tile holds before compression; ``a`` carries its byte order."""
    if predictor == 1:
        return a.tobytes()
    if predictor == 2:
        order = a.dtype.byteorder
        w = a.astype(a.dtype.newbyteorder("=")).view(f"u{a.dtype.itemsize}")
        d = w.copy()
        d[:, 1:] = w[:, 1:] - w[:, :-1]
        return d.astype(d.dtype.newbyteorder(order)).tobytes()
    rows, cols, samples = a.shape
    size = a.dtype.itemsize
    b = np.ascontiguousarray(a.astype(f">f{size}")).view("u1").reshape(rows, cols * samples, size)
    b = b.transpose(0, 2, 1).reshape(rows, cols * size, samples)
    d = b.copy()
    d[:, 1:] = b[:, 1:] - b[:, :-1]
    return d.tobytes()


def write(path: str, pixels: np.ndarray, *, transform=(1.0, 0.0, -1.0, 0.0), tile=16, compression=1, predictor=1, planar=1, big=False, order="<", nodata=None, epsg=4326, point=False, model_transform=False, tiled=True, metadata=None) -> None:
    """``pixels``: (rows, cols) or (rows, cols, samples)."""
    a = pixels if pixels.ndim == 3 else pixels[:, :, None]
    rows, cols, samples = a.shape
    a = a.astype(a.dtype.newbyteorder(order))
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    ty, tx = -(-rows // tile), -(-cols // tile)
    padded = np.zeros((ty * tile, tx * tile, samples), a.dtype)
    padded[:rows, :cols] = a
    planes = [padded] if planar == 1 else [padded[:, :, k : k + 1] for k in range(samples)]
    chunks = [compress(predict(np.ascontiguousarray(p[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile]), predictor), compression) for p in planes for r in range(ty) for c in range(tx)]
    sx, ox, sy, oy = transform
    if point:
        ox, oy = ox + sx / 2, oy + sy / 2
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if epsg == 4326 else 1, 1025, 0, 1, 2 if point else 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg]
    H = header
    tags: list[tuple[int, int, list | bytes]] = [
        (H.WIDTH, 4, [cols]), (H.HEIGHT, 4, [rows]), (H.BITS, 3, [a.dtype.itemsize * 8] * samples), (H.COMPRESSION, 3, [compression]), (H.PHOTOMETRIC, 3, [2 if samples == 3 else 1]),
        (H.SAMPLES, 3, [samples]), (H.PLANAR, 3, [planar]), (H.PREDICTOR, 3, [predictor]), (H.SAMPLE_FORMAT, 3, [kind] * samples), (H.GEO_KEYS, 3, keys),
    ]
    if tiled:
        tags += [(H.TILE_WIDTH, 4, [tile]), (H.TILE_HEIGHT, 4, [tile]), (H.TILE_OFFSETS, 16 if big else 4, [0] * len(chunks)), (H.TILE_SIZES, 16 if big else 4, [len(c) for c in chunks])]
    if model_transform or sy > 0:
        tags.append((H.MODEL_TRANSFORM, 12, [sx, 0, 0, ox, 0, sy, 0, oy, 0, 0, 0, 0, 0, 0, 0, 1]))
    else:
        tags += [(H.PIXEL_SCALE, 12, [sx, -sy, 0]), (H.TIEPOINT, 12, [0, 0, 0, ox, oy, 0])]
    if nodata is not None:
        tags.append((H.GDAL_NODATA, 2, f"{nodata}\0".encode()))
    if metadata:
        tags.append((H.GDAL_METADATA, 2, metadata.encode() + b"\0"))
    tags.sort()
    inline, entry = (8, 20) if big else (4, 12)
    start = 16 if big else 8
    table = start + (8 if big else 2) + len(tags) * entry + inline
    spill, at = b"", table
    placed = []
    for tag, t, values in tags:
        raw = values if isinstance(values, bytes) else struct.pack(f"{order}{len(values)}{H.TYPES[t]}", *values)
        if len(raw) > inline:
            placed.append((tag, t, values, at + len(spill)))
            spill += raw
        else:
            placed.append((tag, t, values, None))
    data_at = table + len(spill)
    offsets = list(np.cumsum([0] + [len(c) for c in chunks])[:-1] + data_at)
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, start) if big else struct.pack(order + "HI", 42, start))
    body = struct.pack(order + ("Q" if big else "H"), len(tags))
    spill = b""
    for tag, t, values, where in placed:
        if tag == H.TILE_OFFSETS:
            values = [int(v) for v in offsets]
        raw = values if isinstance(values, bytes) else struct.pack(f"{order}{len(values)}{H.TYPES[t]}", *values)
        body += struct.pack(order + ("HHQ" if big else "HHI"), tag, t, len(values))
        if where is None:
            body += raw.ljust(inline, b"\0")
        else:
            body += struct.pack(order + ("Q" if big else "I"), where)
            spill += raw
    body += b"\0" * inline
    with open(path, "wb") as f:
        f.write(head + body + spill + b"".join(chunks))
