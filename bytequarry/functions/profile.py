"""Measures of one chunk, with NumPy."""

from __future__ import annotations

import numpy as np

from bytequarry.functions.transforms import residuals

SAMPLES = 8192
SLOT_BITS, SLOT_FACTOR = 12, 2654435761


def entropy(data: bytes) -> float:
    """Bits per byte."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / max(1, len(data))
    return float(-(share * np.log2(share)).sum()) + 0.0


def residual_entropy(data: bytes) -> float:
    return entropy(residuals(data))


_PRINTABLE = np.array([32 <= b <= 126 or b in (9, 10, 13) for b in range(256)])


def printable_share(data: bytes) -> float:
    return float(_PRINTABLE[np.frombuffer(data, np.uint8)].mean()) if data else 0.0


def match_rate(data: bytes, lag: int) -> float:
    """Share of bytes that equal the byte `lag` before; 0 if there is none."""
    a = np.frombuffer(data, np.uint8)
    return float((a[lag:] == a[:-lag]).mean()) if len(a) > lag else 0.0


def sampled_match_rate(data: bytes, lag: int, samples: int = SAMPLES) -> float:
    """match_rate at places lag, lag + step, ...: about `samples` of them."""
    a = np.frombuffer(data, np.uint8)
    if len(a) <= lag:
        return 0.0
    at = np.arange(lag, len(a), max(1, (len(a) - lag) // samples))
    return float((a[at] == a[at - lag]).mean())


def top_lags(data: bytes, lags: list[int], k: int = 3) -> list[tuple[float, int]]:
    """Best sampled rates; of equal ones the larger lag."""
    return sorted(((sampled_match_rate(data, lag), lag) for lag in lags), reverse=True)[:k]


def repeat_rate(data: bytes, step: int = 64) -> tuple[int, int]:
    """(repeats, samples) of 4-grams at every `step` bytes. A table slot remembers only its last 4-gram, so a sample
    repeats if the sample before it in the same slot is equal."""
    if len(data) < 4:
        return 0, 0
    starts = np.arange(0, len(data) - 3, step)
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    keys = a[starts] | a[starts + 1] << 8 | a[starts + 2] << 16 | a[starts + 3] << 24
    slots = (keys * np.uint32(SLOT_FACTOR)) >> np.uint32(32 - SLOT_BITS)
    order = np.argsort(slots, kind="stable")
    same = (slots[order][1:] == slots[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    return int(same.sum()), len(starts)
