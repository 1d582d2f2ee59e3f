"""Entropy coding of whole arrays of symbols, with NumPy.

The symbols of an array are dealt to lanes, each a run of neighbours, and coded in rounds: the next symbol of every lane at
once, by asymmetric numeral systems, one state for each lane. All lanes of a round share one adaptive model, which learns
the round's symbols when it is over, so nothing about the model has to be sent. States pass from one array to the next.
The writer notes what the models say and codes it from the last round to the first; the reader goes the other way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BITS = 14
TOTAL, FLOOR = 1 << BITS, 1 << 16
STEP, LIMIT = 24, 1 << 13
#: Number coding: values below DIRECT are symbols, larger ones their bit length and the bits below the first.
DIRECT, NUMBERS = 16, 48
SLICE = 11


class CorruptStream(ValueError):
    """Coded symbols that no writer left."""


def lanes_for(symbols: int) -> int:
    return max(1, min(1024, symbols // 96))


class Writer:
    decoding = False

    def __init__(self, lanes: int):
        self.lanes, self.noted = lanes, []

    def move(self, share: np.ndarray, start: np.ndarray) -> None:
        self.noted.append((share.astype(np.uint64), start.astype(np.uint64)))

    def finish(self) -> bytes:
        x, words = np.full(self.lanes, FLOOR, np.uint64), []
        bits, low = np.uint64(BITS), np.uint64(16)
        for share, start in reversed(self.noted):
            own = x[: len(share)]
            full = own >= share << np.uint64(32 - BITS)
            words.append((own[full] & np.uint64(0xFFFF)).astype("<u2"))
            own[full] >>= low
            whole = own // share
            own[:] = (whole << bits) + own - whole * share + start
        return x.astype("<u4").tobytes() + np.concatenate(words[::-1] or [np.zeros(0, "<u2")]).tobytes()


class Reader:
    decoding = True

    def __init__(self, data: bytes, lanes: int):
        if len(data) < 4 * lanes or len(data) % 2:
            raise CorruptStream("the data end early")
        self.lanes, self.x = lanes, np.frombuffer(data, "<u4", lanes).astype(np.uint64)
        self.words, self.at = np.frombuffer(data, "<u2", offset=4 * lanes).astype(np.uint64), 0

    def slots(self, k: int) -> np.ndarray:
        return (self.x[:k] & np.uint64(TOTAL - 1)).astype(np.int64)

    def move(self, share: np.ndarray, start: np.ndarray) -> None:
        own = self.x[: len(share)]
        own[:] = share.astype(np.uint64) * (own >> np.uint64(BITS)) + (own & np.uint64(TOTAL - 1)) - start.astype(np.uint64)
        empty = own < FLOOR
        n = int(empty.sum())
        if self.at + n > len(self.words):
            raise CorruptStream("the data end early")
        own[empty] = own[empty] << np.uint64(16) | self.words[self.at : self.at + n]
        self.at += n

    def finish(self) -> None:
        if self.at != len(self.words) or (self.x != FLOOR).any():
            raise CorruptStream("the data do not end where the symbols do")


class Adaptive:
    """Shares of TOTAL for the symbols of each context; they follow the counts in growing steps of rounds."""

    def __init__(self, contexts: int, symbols: int):
        self.symbols, self.counts = symbols, np.ones(contexts * symbols, np.int64)
        self.base = np.arange(contexts)[:, None] * TOTAL
        self.round = self.due = 0
        self.refresh()

    def refresh(self) -> None:
        counts = self.counts.reshape(-1, self.symbols)
        total = counts.sum(axis=1, keepdims=True)
        heavy = total[:, 0] > LIMIT * 8
        if heavy.any():
            counts[heavy] = (counts[heavy] + 1) >> 1
            total = counts.sum(axis=1, keepdims=True)
        share = counts * (TOTAL - self.symbols) // total + 1
        share[np.arange(len(share)), counts.argmax(axis=1)] += TOTAL - share.sum(axis=1)
        start = np.cumsum(share, axis=1) - share
        self.share, self.start, self.edges = share.ravel(), start.ravel(), (start + self.base).ravel()
        self.due = self.round + 1 + self.round // 4

    def find(self, context: np.ndarray, slot: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, context * TOTAL + slot, side="right") - 1

    def learn(self, cells: np.ndarray) -> None:
        np.add.at(self.counts, cells, STEP)
        self.round += 1
        if self.round >= self.due:
            self.refresh()


def _rounds(lanes: int, n: int):
    """Places of the symbols that are coded together, round by round."""
    size = -(-n // lanes)
    starts = np.arange(-(-n // size)) * size if n else np.zeros(0, np.int64)
    for t in range(size):
        at = starts + t
        yield at if at[-1] < n else at[:-1]


def code(
    port: Writer | Reader, given: np.ndarray | None, n: int, symbols: int, contexts: int = 1,
    context: np.ndarray | Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> np.ndarray:
    """Writes the n symbols given, or reads them. A symbol's context is known beforehand (an array) or made from the
    two symbols before it in its lane (a function; 0 stands for none)."""
    model, out = Adaptive(contexts, symbols), np.zeros(n, np.int64) if given is None else given
    one, two = np.zeros(port.lanes, np.int64), np.zeros(port.lanes, np.int64)
    for at in _rounds(port.lanes, n):
        k = len(at)
        if context is None:
            of = np.zeros(k, np.int64)
        else:
            of = context(one[:k], two[:k]) if callable(context) else context[at]
        if port.decoding:
            cells = model.find(of, port.slots(k))
            out[at] = cells - of * symbols
        else:
            cells = of * symbols + out[at]
        port.move(model.share[cells], model.start[cells])
        model.learn(cells)
        one, two = out[at], one[:k]
    return out


def code_bits(port: Writer | Reader, given: np.ndarray | None, widths: np.ndarray) -> np.ndarray:
    """Numbers of so many bits each, all values alike likely."""
    n, done = len(widths), np.zeros(len(widths), np.int64)
    out = np.zeros(n, np.int64) if given is None else given
    while (left := widths - done).any():
        now = np.minimum(left, SLICE)
        for at in _rounds(port.lanes, n):
            unit = np.int64(TOTAL) >> now[at]
            if port.decoding:
                value = port.slots(len(at)) // unit
                out[at] |= value << done[at]
            else:
                value = (out[at] >> done[at]) & ((np.int64(1) << now[at]) - 1)
            port.move(unit, value * unit)
        done = done + now
    return out


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def code_numbers(port: Writer | Reader, given: np.ndarray | None, n: int, contexts: int = 1, context=None) -> np.ndarray:
    """Numbers from 0 to 2**36 or so, small ones in fewer bits."""
    symbols = None
    if given is not None:
        symbols = np.where(given < DIRECT, given, DIRECT + bit_lengths(given) - DIRECT.bit_length())
    symbols = code(port, symbols, n, NUMBERS, contexts, context)
    widths = np.where(symbols < DIRECT, 0, symbols - DIRECT + DIRECT.bit_length() - 1)
    first = np.int64(1) << widths
    rest = code_bits(port, None if given is None else np.where(symbols < DIRECT, 0, given - first), widths)
    return np.where(symbols < DIRECT, symbols, first + rest)


def ideal_bits(symbols: np.ndarray, contexts: np.ndarray, n_symbols: int, n_contexts: int, per_cell: float = 6.0) -> float:
    """What the symbols cost when each context's shares are known, plus the learning of every pair that occurs."""
    counts = np.bincount(contexts * n_symbols + symbols, minlength=n_contexts * n_symbols).reshape(n_contexts, -1)
    seen, totals = counts[counts > 0].astype(float), counts.sum(axis=1)
    totals = totals[totals > 0].astype(float)
    return float((totals * np.log2(totals)).sum() - (seen * np.log2(seen)).sum() + per_cell * len(seen))
