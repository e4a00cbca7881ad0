"""Tile bytes to pixels: decompression, predictors, planes and bands."""

from __future__ import annotations

import lzma
import zlib

import numpy as np

from scenegrain.tiff.header import Header

# TIFF compression codes.
NONE, LZW, JPEG, DEFLATE, PACKBITS, OLD_DEFLATE, LERC, LZMA, ZSTD = 1, 5, 7, 8, 32773, 32946, 34887, 34925, 50000


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, widened one code early."""
    out = bytearray()
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    width, prev, acc, bits = 9, b"", 0, 0
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, acc = acc >> bits, acc & ((1 << bits) - 1)
        if code == 256:
            del table[258:]
            width, prev = 9, b""
            continue
        if code == 257:
            break
        if not prev:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("bad LZW code")
            entry = table[code] if code < len(table) else prev + prev[:1]
            table.append(prev + entry[:1])
        out += entry
        prev = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def decompress(data: bytes, code: int) -> bytes:
    if code == NONE:
        return data
    if code in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if code == LZW:
        return lzw(data)
    if code == PACKBITS:
        return packbits(data)
    if code == LZMA:
        return lzma.decompress(data)
    if code == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise NotImplementedError(f"compression {code}")


def unpredict(raw: bytes, predictor: int, dtype: np.dtype, rows: int, cols: int, samples: int) -> np.ndarray:
    """(rows, cols, samples) in native byte order."""
    if predictor == 3:  # floats as byte planes of each row, most significant first, differenced
        size = dtype.itemsize
        b = np.frombuffer(raw, "u1", rows * cols * samples * size).reshape(rows, cols * size, samples)
        b = np.cumsum(b, axis=1, dtype="u1").reshape(rows, -1)
        planes = b.reshape(rows, size, cols * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").astype(f"f{size}").reshape(rows, cols, samples)
    a = np.frombuffer(raw, dtype, rows * cols * samples).reshape(rows, cols, samples)
    native = dtype.newbyteorder("=")
    if predictor == 2:
        whole = a.view(a.dtype.str.replace("f", "u")) if dtype.kind == "f" else a
        kind = np.dtype(whole.dtype).newbyteorder("=")
        return np.cumsum(whole.astype(kind), axis=1, dtype=kind).view(native)
    if predictor != 1:
        raise NotImplementedError(f"predictor {predictor}")
    return a.astype(native)


def tile(data: bytes, h: Header) -> np.ndarray:
    """All samples of a chunky tile, or the one sample of a planar one."""
    samples = h.samples if h.planar == 1 else 1
    raw = decompress(data, h.compression)
    dtype = np.dtype(h.dtype).newbyteorder(">" if h.big_endian else "<")
    need = h.tile_height * h.tile_width * samples * dtype.itemsize
    if len(raw) < need:
        raise ValueError("tile is cut off")
    return unpredict(raw[:need], h.predictor, dtype, h.tile_height, h.tile_width, samples)


def band(pixels: np.ndarray, index: int | None) -> np.ndarray:
    """One band of a tile; needed where there are several."""
    n = pixels.shape[2]
    if index is None:
        if n > 1:
            raise ValueError("a file of several bands needs a band index")
        index = 0
    if not 0 <= index < n:
        raise ValueError(f"band index {index} of {n}")
    return pixels[:, :, index]


def plane_tables(h: Header, index: int) -> tuple[list[int], list[int]]:
    """Tile tables of a band: a planar file holds one table per band, one after the other."""
    n = -(-h.width // h.tile_width) * -(-h.height // h.tile_height)
    if h.planar == 1 or len(h.offsets) == n:
        return h.offsets, h.sizes
    if (index + 1) * n > len(h.offsets):
        raise ValueError(f"band index {index} is beyond the tile table")
    return h.offsets[index * n : (index + 1) * n], h.sizes[index * n : (index + 1) * n]
