"""Reversible byte transforms over whole buffers, with NumPy, and their registry.

Names: D{k} delta at lag k, X{k} xor at lag k, DD{k} delta twice, T{w} byte-plane transpose at width w, WD{w} and WX{w}
delta and xor of little-endian words, BIT bit planes, NIB nibbles, RES neighbourhood residuals. A name such as D4T4 is
applied from left to right. Bytes after the last whole row or word stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np


def _bytes(data) -> np.ndarray:
    return np.frombuffer(bytes(data), np.uint8)


def delta(data: bytes, lag: int) -> bytes:
    a = _bytes(data).copy()
    a[lag:] -= _bytes(data)[: max(0, len(a) - lag)]
    return a.tobytes()


def undo_delta(data: bytes, lag: int) -> bytes:
    a = _bytes(data)
    rows = -(-len(a) // lag)
    grid = np.zeros(rows * lag, np.uint8)
    grid[: len(a)] = a
    return np.cumsum(grid.reshape(rows, lag), axis=0, dtype=np.uint8).reshape(-1)[: len(a)].tobytes()


def xor(data: bytes, lag: int) -> bytes:
    a = _bytes(data).copy()
    a[lag:] ^= _bytes(data)[: max(0, len(a) - lag)]
    return a.tobytes()


def undo_xor(data: bytes, lag: int) -> bytes:
    a = _bytes(data)
    rows = -(-len(a) // lag)
    grid = np.zeros(rows * lag, np.uint8)
    grid[: len(a)] = a
    return np.bitwise_xor.accumulate(grid.reshape(rows, lag), axis=0).reshape(-1)[: len(a)].tobytes()


def double_delta(data: bytes, lag: int) -> bytes:
    return delta(delta(data, lag), lag)


def undo_double_delta(data: bytes, lag: int) -> bytes:
    return undo_delta(undo_delta(data, lag), lag)


def transpose(data: bytes, width: int) -> bytes:
    a = _bytes(data)
    main = len(a) // width * width
    return a[:main].reshape(-1, width).T.tobytes() + a[main:].tobytes()


def undo_transpose(data: bytes, width: int) -> bytes:
    a = _bytes(data)
    main = len(a) // width * width
    return a[:main].reshape(width, -1).T.tobytes() + a[main:].tobytes()


_WORDS = {2: "<u2", 4: "<u4", 8: "<u8"}


def _words(data: bytes, width: int) -> tuple[np.ndarray, bytes]:
    if width not in _WORDS:
        raise ValueError("words have 2, 4 or 8 bytes")
    main = len(data) // width * width
    return np.frombuffer(bytes(data[:main]), _WORDS[width]), bytes(data[main:])


def word_delta(data: bytes, width: int) -> bytes:
    a, tail = _words(data, width)
    out = a.copy()
    out[1:] -= a[:-1]
    return out.tobytes() + tail


def undo_word_delta(data: bytes, width: int) -> bytes:
    a, tail = _words(data, width)
    return np.cumsum(a, dtype=a.dtype).tobytes() + tail


def word_xor(data: bytes, width: int) -> bytes:
    a, tail = _words(data, width)
    out = a.copy()
    out[1:] ^= a[:-1]
    return out.tobytes() + tail


def undo_word_xor(data: bytes, width: int) -> bytes:
    a, tail = _words(data, width)
    return np.bitwise_xor.accumulate(a).tobytes() + tail


def bitplanes(data: bytes) -> bytes:
    """Eight planes, lowest bit first; byte i of the input is bit i % 8 of its plane's byte i // 8."""
    planes = np.unpackbits(_bytes(data)[:, None], axis=1, bitorder="little").T
    return np.packbits(planes, axis=1, bitorder="little").tobytes()


def undo_bitplanes(data: bytes, raw_len: int) -> bytes:
    planes = np.unpackbits(_bytes(data).reshape(8, -1), axis=1, bitorder="little")[:, :raw_len]
    return np.packbits(planes.T, axis=1, bitorder="little").tobytes()


def _pairs(half: np.ndarray) -> np.ndarray:
    """Half bytes packed in twos, the first one low."""
    padded = np.zeros(len(half) + len(half) % 2, np.uint8)
    padded[: len(half)] = half
    return padded[::2] | padded[1::2] << 4


def nibbles(data: bytes) -> bytes:
    """All high halves, then all low halves."""
    a = _bytes(data)
    return _pairs(a >> 4).tobytes() + _pairs(a & 15).tobytes()


def undo_nibbles(data: bytes, raw_len: int) -> bytes:
    a = _bytes(data)
    halves = np.stack([a & 15, a >> 4], axis=1).reshape(2, -1)[:, :raw_len] if len(a) else np.zeros((2, 0), np.uint8)
    return (halves[0] << 4 | halves[1]).astype(np.uint8).tobytes()


#: Fixed values: (distance, weight) of the neighbourhood predictor.
NEIGHBOURS = [(1, 3), (16, 2), (256, 2), (17, 1), (15, 1)]


def residuals(data: bytes, neighbours: list[tuple[int, int]] = NEIGHBOURS) -> bytes:
    """Each byte less the rounded weighted mean of the neighbours it has."""
    a = _bytes(data).astype(np.int64)
    total, weight = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for distance, w in neighbours:
        total[distance:] += w * a[: max(0, len(a) - distance)]
        weight[distance:] += w
    predicted = (total + weight // 2) // np.maximum(weight, 1)
    return ((a - predicted) & 255).astype(np.uint8).tobytes()


def undo_residuals(data: bytes) -> bytes:
    out = bytearray(len(data))
    for i, r in enumerate(data):
        total = weight = 0
        for distance, w in NEIGHBOURS:
            if i >= distance:
                total += w * out[i - distance]
                weight += w
        out[i] = (r + ((total + weight // 2) // weight if weight else 0)) & 255
    return bytes(out)


_STEPS: dict[str, tuple[Callable, Callable]] = {
    "D": (delta, undo_delta), "X": (xor, undo_xor), "DD": (double_delta, undo_double_delta), "T": (transpose, undo_transpose),
    "WD": (word_delta, undo_word_delta), "WX": (word_xor, undo_word_xor),
}
_WHOLE: dict[str, tuple[Callable, Callable]] = {
    "BIT": (bitplanes, undo_bitplanes), "NIB": (nibbles, undo_nibbles), "RES": (residuals, lambda d, n: undo_residuals(d)),
}
_STEP = re.compile(r"(BIT|NIB|RES)|(DD|WD|WX|D|X|T)(\d+)")

#: The candidate sets that experiments choose from, and the lags that are scored.
CATALOGUES: dict[str, list[str]] = {
    "lags3": ["BASE", "D16", "D256"],
    "lags7": ["BASE", "D1", "D4", "D16", "D64", "D256", "D1024"],
    "planes": ["BASE", "T4", "D4T4", "T16", "T256", "T1024", "D1024T1024"],
    "route3": ["BASE", "D4T4", "D1024T1024"],
    "words": ["BASE", "D4T4", "WD2T2", "WD4T4", "WD8T8", "WX2T2", "WX4T4", "WX8T8"],
    "route4": ["BASE", "D4T4", "D1024T1024", "WX2T2"],
    "route6": ["BASE", "D4T4", "D1024T1024", "WX2T2", "D2T2", "D16T16"],
    "bits": ["BASE", "BIT", "NIB", "X1BIT", "X2BIT", "X4BIT", "X8BIT"],
    "records28": ["BASE", "D28T28", "X28T28", "DD28T28"],
}
LAGS = [1, 2, 3, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]


def register(name: str, apply_whole: Callable[[bytes], bytes], undo_whole: Callable[[bytes, int], bytes]) -> None:
    """Adds a transform of whole buffers under a name of capital letters; undo_whole also gets the raw length."""
    global _STEP
    if not re.fullmatch("[A-Z]{3,}", name) or name in ("BASE", "BIT", "NIB", "RES"):
        raise ValueError("a new name has three or more capital letters and is not one of the engine's own")
    _WHOLE[name] = (apply_whole, undo_whole)
    _STEP = re.compile(rf"({'|'.join(sorted(_WHOLE, key=len, reverse=True))})|(DD|WD|WX|D|X|T)(\d+)")


def steps(name: str) -> list[tuple[str, int]]:
    if name in ("BASE", ""):
        return []
    found, at = [], 0
    for m in _STEP.finditer(name):
        if m.start() != at:
            break
        at = m.end()
        found.append((m[1], 0) if m[1] else (m[2], int(m[3])))
    if at != len(name) or any(k in _STEPS and n < 1 for k, n in found):
        raise ValueError(f"no transform is named {name!r}")
    return found


def apply(data: bytes, name: str) -> bytes:
    for kind, n in steps(name):
        data = _STEPS[kind][0](data, n) if kind in _STEPS else _WHOLE[kind][0](data)
    return bytes(data)


def undo(data: bytes, name: str, raw_len: int) -> bytes:
    """The input of apply(); only the last steps may change the length, and they need raw_len."""
    for kind, n in reversed(steps(name)):
        data = _STEPS[kind][1](data, n) if kind in _STEPS else _WHOLE[kind][1](data, raw_len)
    return bytes(data)
