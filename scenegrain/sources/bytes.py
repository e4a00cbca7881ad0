"""Byte ranges of files, inside executors."""

from __future__ import annotations

import re
import time
import urllib.request
from collections.abc import Sequence
from typing import Protocol

from scenegrain.functions.text import rewrite_prefix, route_url


class ByteSource(Protocol):
    """What a reader needs; it must be picklable."""

    def get_range(self, url: str, offset: int, size: int) -> bytes: ...

    def get_ranges(self, url: str, ranges: Sequence[tuple[int, int]]) -> list[bytes]: ...


class LocalBytes:
    """Files on a path that all executors see; ``prefixes`` rewrites addresses first."""

    def __init__(self, prefixes: dict[str, str] | None = None):
        self.prefixes = prefixes or {}

    def _path(self, url: str) -> str:
        return rewrite_prefix(url, self.prefixes).removeprefix("file://")

    def get_range(self, url: str, offset: int, size: int) -> bytes:
        with open(self._path(url), "rb") as f:
            f.seek(offset)
            return f.read(size)

    def get_ranges(self, url: str, ranges: Sequence[tuple[int, int]]) -> list[bytes]:
        with open(self._path(url), "rb") as f:
            out = []
            for offset, size in ranges:
                f.seek(offset)
                out.append(f.read(size))
        return out


class ArrowBytes:
    """Files on any file system that Arrow opens by address (s3, gs, hdfs, file)."""

    def __init__(self, prefixes: dict[str, str] | None = None):
        self.prefixes = prefixes or {}

    def get_range(self, url: str, offset: int, size: int) -> bytes:
        return self.get_ranges(url, [(offset, size)])[0]

    def get_ranges(self, url: str, ranges: Sequence[tuple[int, int]]) -> list[bytes]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(rewrite_prefix(url, self.prefixes))
        with system.open_input_file(path) as f:
            return [bytes(f.read_at(size, offset)) for offset, size in ranges]


class Retrying:
    """Another source, asked up to ``attempts`` times while ranges come back short or fail."""

    def __init__(self, inner: ByteSource, attempts: int = 3, wait: float = 0.2):
        self.inner, self.attempts, self.wait = inner, attempts, wait

    def get_range(self, url: str, offset: int, size: int) -> bytes:
        return self.get_ranges(url, [(offset, size)])[0]

    def get_ranges(self, url: str, ranges: Sequence[tuple[int, int]]) -> list[bytes]:
        error: Exception | None = None
        for k in range(self.attempts):
            try:
                got = self.inner.get_ranges(url, ranges)
                if all(len(g) == n for g, (_, n) in zip(got, ranges)):
                    return got
                error = OSError(f"short read of {url}")
            except FileNotFoundError:
                raise
            except OSError as e:
                error = e
            if k + 1 < self.attempts:
                time.sleep(self.wait * 2**k)
        raise error


class Prefixed:
    """Another source that is asked by path: a prefix of the address is taken off first."""

    def __init__(self, inner: ByteSource, prefix: str):
        self.inner, self.prefix = inner, prefix

    def get_range(self, url: str, offset: int, size: int) -> bytes:
        return self.inner.get_range(url.removeprefix(self.prefix), offset, size)

    def get_ranges(self, url: str, ranges: Sequence[tuple[int, int]]) -> list[bytes]:
        return self.inner.get_ranges(url.removeprefix(self.prefix), ranges)


class Routed:
    """Each address by the store that serves it: paths from disk, buckets and web stores by Arrow's file systems, other sites by HTTP ranges.

    Public S3 addresses (``https://bucket.s3...``) are read as objects, in the region the address names, else the one Arrow finds for
    the bucket. ``anonymous``: without signing requests.
    """

    def __init__(self, prefixes: dict[str, str] | None = None, anonymous: bool = True, timeout: float = 60.0):
        self.prefixes, self.anonymous, self.timeout = prefixes or {}, anonymous, timeout
        self.systems: dict[tuple[str, str], object] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"systems": {}}

    def _system(self, store: str, bucket: str, url: str):
        from pyarrow import fs

        if (store, bucket) not in self.systems:
            if store == "s3":
                m = re.search(r"[.-]s3[.-]([a-z]{2}-[a-z]+-\d)|s3[.-]([a-z]{2}-[a-z]+-\d)", url)
                region = (m and (m[1] or m[2])) or fs.resolve_s3_region(bucket)
                self.systems[store, bucket] = fs.S3FileSystem(anonymous=self.anonymous, region=region)
            else:
                self.systems[store, bucket] = fs.GcsFileSystem(anonymous=self.anonymous)
        return self.systems[store, bucket]

    def get_range(self, url: str, offset: int, size: int) -> bytes:
        return self.get_ranges(url, [(offset, size)])[0]

    def get_ranges(self, url: str, ranges: Sequence[tuple[int, int]]) -> list[bytes]:
        url = rewrite_prefix(url, self.prefixes)
        store, bucket = route_url(url)
        if store == "local":
            return (ArrowBytes() if "://" in url and not url.startswith("file://") else LocalBytes()).get_ranges(url, ranges)
        if store in ("s3", "gcs"):
            path = url.split("://", 1)[1]
            key = path.split("/", 1)[1] if not path.startswith(bucket + "/") else path[len(bucket) + 1 :]
            key = key.removeprefix(bucket + "/").split("?")[0]
            with self._system(store, bucket, url).open_input_file(f"{bucket}/{key}") as f:
                return [bytes(f.read_at(size, offset)) for offset, size in ranges]
        out = []
        for offset, size in ranges:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"Range": f"bytes={offset}-{offset + size - 1}"}), timeout=self.timeout) as r:
                body = r.read() if r.status == 206 else r.read(offset + size)[offset:]
            out.append(body[:size])
        return out


def default_source() -> ByteSource:
    """What readers use unless told otherwise: routed by address, failed reads tried again. Missing local files aren't worth another try."""
    return Retrying(Routed())
