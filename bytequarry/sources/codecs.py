"""Registry of general codecs. Codecs whose library is missing are absent, not an error."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable
from importlib import import_module

Codec = tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]
_REGISTRY: dict[str, Codec] = {}


def register(name: str, pack: Callable[[bytes], bytes], unpack: Callable[[bytes], bytes]) -> None:
    """Adds a codec, or replaces the one of that name."""
    _REGISTRY[name] = (pack, unpack)


def get(name: str) -> Codec:
    if name not in _REGISTRY:
        raise KeyError(f"no codec {name!r}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)


def _zlib(level: int) -> Codec:
    return (lambda data: zlib.compress(data, level)), zlib.decompress


def _lzma(level: int) -> Codec:
    return (lambda data: lzma.compress(data, preset=level)), lzma.decompress


def _optional(module: str, add: Callable) -> None:
    try:
        found = import_module(module)
    except ImportError:
        return
    add(found)


def _zstd(z) -> None:
    for level in (1, 3, 9):
        register(f"zstd-{level}", lambda d, n=level: z.ZstdCompressor(level=n).compress(d), lambda d: z.ZstdDecompressor().decompress(d))


for _level in (1, 6, 9):
    register(f"zlib-{_level}", *_zlib(_level))
for _level in (1, 6):
    register(f"xz-{_level}", *_lzma(_level))
register("bzip2-9", lambda d: bz2.compress(d, 9), bz2.decompress)
register("store", bytes, bytes)
_optional("zstandard", _zstd)
_optional("brotli", lambda b: register("brotli-5", lambda d: b.compress(d, quality=5), b.decompress))
_optional("lz4.frame", lambda f: register("lz4", f.compress, f.decompress))
