"""Chunk kernel: a chunk as matches and literals, each kind of number coded as a whole array.

A packed chunk holds, in this order: how many bytes are literals before each match, the matches' lengths, where their
distances stand among the recent ones, the distances that are new, and the literals. What an array's models know of
arrays before it is a choice of PackOptions, written into the head. Literals are bytes, or residuals of a mean of
earlier bytes; mean and contexts are those that cost the chunk least. All state is per chunk.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from bytequarry.functions import lanes
from bytequarry.functions.matches import EXTENDED, LONGEST, SHORTEST, Parse, ParseOptions, literal_bits, parsed  # noqa: F401
from bytequarry.functions.profile import top_lags
from bytequarry.functions.transforms import LAGS, NEIGHBOURS, residuals


class CorruptChunk(ValueError):
    """A packed chunk that cannot be decoded to the promised length."""


def parse(data: bytes, options: ParseOptions = ParseOptions()) -> list[tuple[int, int]]:
    """Tokens (length, distance) that cover data from left to right; distance 0 stands for one literal."""
    return parsed(data, options).tokens()


@dataclass(frozen=True)
class PackOptions:
    """How a parse is coded."""

    #: What else is known of a length (1: the distance before) and of a distance (2: its match's length); 3 for both.
    couple: int = 0
    #: Means that literals may be coded against: "none", "neighbours", "lags" (the chunk's three best), or (distance, weight) pairs.
    means: tuple = ("none", "neighbours", "lags")
    #: Contexts that literals may be coded in, by name; see LITERAL_CONTEXTS.
    contexts: tuple[str, ...] = ("one", "before", "signs", "column", "row", "cell")


# --- recent distances --------------------------------------------------------------------------------

RECENT = 8


def to_places(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each distance's place among the RECENT ones before it, latest first (RECENT: not there), and the new ones."""
    recent, places, new = [0] * RECENT, [], []
    for d in distances.tolist():
        if d in recent:
            places.append(recent.index(d))
            recent.remove(d)
        else:
            places.append(RECENT)
            new.append(d)
            recent.pop()
        recent.insert(0, d)
    return np.array(places, np.int64), np.array(new, np.int64)


def from_places(places: np.ndarray, new: np.ndarray) -> np.ndarray:
    recent, out, fresh = [0] * RECENT, [], iter(new.tolist())
    for place in places.tolist():
        d = next(fresh) if place == RECENT else recent[place]
        recent.pop(min(place, RECENT - 1))
        recent.insert(0, d)
        out.append(d)
    return np.array(out, np.int64)


# --- literals ----------------------------------------------------------------------------------------


def _sign(x: np.ndarray) -> np.ndarray:
    """0, 1, 2 for a residual of zero, above and below it."""
    return np.where(x == 0, 0, np.where(x < 128, 1, 2))


#: Name: number of contexts, and the context by the two symbols before or (True) by the literal's place.
LITERAL_CONTEXTS = {
    "one": (1, False, lambda one, two: one * 0),
    "before": (32, False, lambda one, two: one & 31),
    "signs": (9, False, lambda one, two: 3 * _sign(one) + _sign(two)),
    "column": (16, True, lambda at: at & 15),
    "row": (16, True, lambda at: at >> 4 & 15),
    "cell": (16, True, lambda at: (at ^ at >> 4) & 15),
}
_NAMES = list(LITERAL_CONTEXTS)
_MOST_BYTES = 4


def _means(data: bytes, options: PackOptions) -> list[list[tuple[int, int]]]:
    out = []
    for mean in options.means:
        if mean == "none":
            out.append([])
        elif mean == "neighbours":
            out.append(NEIGHBOURS)
        elif mean == "lags":
            found = [lag for rate, lag in top_lags(data, [k for k in LAGS if k < len(data)], 3) if rate > 0]
            out.append([(lag, 3 - i) for i, lag in enumerate(found)])
        else:
            out.append([tuple(pair) for pair in mean])
    return out


def _least(data: bytes, places: np.ndarray, options: PackOptions) -> tuple[list[tuple[int, int]], str, np.ndarray]:
    """The mean and the contexts that cost least, and the literals against that mean."""
    best = None
    for mean in _means(data, options):
        whole = np.frombuffer(residuals(data, mean) if mean else data, np.uint8)
        symbols = whole[places].astype(np.int64)
        one, two = np.concatenate([[0], symbols[:-1]])[: len(symbols)], np.concatenate([[0, 0], symbols[:-2]])[: len(symbols)]
        for name in options.contexts:
            n, by_place, of = LITERAL_CONTEXTS[name]
            cost = lanes.ideal_bits(symbols, of(places) if by_place else of(one, two), 256, n)
            if best is None or cost < best[0]:
                best = cost, mean, name, symbols
    return best[1:]


def _predicted(out: bytearray, at: int, mean: list[tuple[int, int]]) -> int:
    total = weight = 0
    for distance, w in mean:
        if at >= distance:
            total += w * out[at - distance]
            weight += w
    return (total + weight // 2) // weight if weight else 0


# --- streams -----------------------------------------------------------------------------------------

_HEAD = struct.Struct("<BBBII")  # coupling, contexts of literals, pairs of the mean, matches, literals
_PAIR = struct.Struct("<HB")


def _distance_class(places: np.ndarray, distances: np.ndarray) -> np.ndarray:
    return np.where(places < RECENT, 0, 1 + (distances >= 256) + (distances >= 65536))


def _length_class(lengths: np.ndarray) -> np.ndarray:
    return 0 + (lengths > 7) + (lengths > 31) + (lengths > 255)


def _matches(port, couple: int, n: int, given) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of literals before the matches, lengths and distances. Lengths that know distances come after them."""
    runs, lengths, distances = given or (None, None, None)
    places, new = to_places(distances) if given else (None, None)

    def code_lengths(known: np.ndarray | None) -> np.ndarray:
        less = None if lengths is None else lengths - SHORTEST
        return lanes.code_numbers(port, less, n, 4, known) + SHORTEST

    def code_distances(known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        found = lanes.code(port, places, n, RECENT + 1, 16, lambda one, two: np.minimum(one, 3) * 4 + np.minimum(two, 3))
        fresh = int((found == RECENT).sum())
        far = lanes.code_numbers(port, new, fresh, 4, None if known is None else known[found == RECENT])
        return found, from_places(found, far)

    runs = lanes.code_numbers(port, runs, n)
    if couple == 1:
        found, distances = code_distances(None)
        before = np.concatenate([[0], _distance_class(found, distances)[:-1]])[:n]
        return runs, code_lengths(before), distances
    if couple == 3:  # a length knows the place of its own distance, which knows the length
        found = lanes.code(port, places, n, RECENT + 1, 16, lambda one, two: np.minimum(one, 3) * 4 + np.minimum(two, 3))
        lengths = code_lengths(np.where(found < RECENT, 0, 1))
        far = lanes.code_numbers(port, new, int((found == RECENT).sum()), 4, _length_class(lengths)[found == RECENT])
        return runs, lengths, from_places(found, far)
    lengths = code_lengths(None)
    _, distances = code_distances(_length_class(lengths) if couple == 2 else None)
    return runs, lengths, distances


def _literals(port, name: str, places: np.ndarray, given: np.ndarray | None) -> np.ndarray:
    n, by_place, of = LITERAL_CONTEXTS[name]
    return lanes.code(port, given, len(places), 256, n, of(places) if by_place else of)


def _lanes(matches: int, literals: int) -> int:
    return lanes.lanes_for(literals + 4 * matches)


def _between(runs: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Places of the literals."""
    covered = np.zeros(size + 1, np.int64)
    starts = np.cumsum(runs + lengths) - lengths
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + lengths, -1)
    return np.flatnonzero(np.cumsum(covered[:-1]) == 0)


def encode(data: bytes, found: Parse, options: PackOptions = PackOptions()) -> bytes:
    ends = found.start + found.length
    runs = found.start - np.concatenate([[0], ends[:-1]])[: len(ends)]
    places = _between(runs, found.length, len(data))
    mean, name, symbols = _least(data, places, options)
    port = lanes.Writer(_lanes(len(runs), len(places)))
    _matches(port, options.couple, len(runs), (runs, found.length, found.distance))
    _literals(port, name, places, symbols)
    head = _HEAD.pack(options.couple, _NAMES.index(name), len(mean), len(runs), len(places))
    return head + b"".join(_PAIR.pack(*pair) for pair in mean) + port.finish()


def decode(packed: bytes, size: int) -> bytes:
    """Raises CorruptChunk for what cannot be the encoding of `size` bytes."""
    try:
        return _decode(packed, size)
    except (struct.error, IndexError, lanes.CorruptStream, StopIteration, OverflowError) as e:
        raise CorruptChunk(f"the data cannot be decoded: {e}") from e


def _decode(packed: bytes, size: int) -> bytes:
    couple, contexts, pairs, matches, literals = _HEAD.unpack_from(packed)
    if couple > 3 or contexts >= len(_NAMES) or pairs > 8 or literals > size or matches * SHORTEST > size:
        raise CorruptChunk("the head does not fit the chunk")
    mean = [_PAIR.unpack_from(packed, _HEAD.size + i * _PAIR.size) for i in range(pairs)]
    port = lanes.Reader(packed[_HEAD.size + pairs * _PAIR.size :], _lanes(matches, literals))
    runs, lengths, distances = _matches(port, couple, matches, None)
    starts = np.cumsum(runs + lengths) - lengths
    if int(lengths.sum()) + literals != size or int(runs.sum()) > literals or (distances < 1).any() or (distances > starts).any():
        raise CorruptChunk("the matches do not fit the chunk")
    symbols = _literals(port, _NAMES[contexts], _between(runs, lengths, size), None).astype(np.uint8).tobytes()
    port.finish()
    out, at = bytearray(), 0
    for run, length, distance in zip([*runs.tolist(), literals], [*lengths.tolist(), 0], [*distances.tolist(), 0]):
        if mean:
            for residual in symbols[at : at + run]:
                out.append((residual + _predicted(out, len(out), mean)) & 255)
        else:
            out += symbols[at : at + run]
        at += run
        if length:
            copy_match(out, distance, length)
    return bytes(out)


def copy_match(out: bytearray, distance: int, length: int) -> None:
    """Appends bytes from `distance` back; a match may reach into itself."""
    source = out[-distance:][:length]
    whole, rest = divmod(length, len(source))
    out += source * whole + source[:rest]


# --- chunks ------------------------------------------------------------------------------------------

RAW, PACKED = 0, 1


def pack(
    data: bytes, options: ParseOptions = ParseOptions(), verify: bool = True, compete_from: float | None = None,
    coding: PackOptions = PackOptions(),
) -> tuple[int, bytes]:
    """(mode, payload): packed, or as it is if hardly anything matches or packing does not pay.

    With compete_from, chunks of which at least that share are literals are also coded as literals alone, and the
    smaller result is kept; such chunks are not given up beforehand.
    """
    found = parsed(data, options)
    competes = compete_from is not None and found.literals >= compete_from * len(data)
    if found.literals > len(data) * 9 // 10 and not competes:
        return RAW, data
    payload = encode(data, found, coding)
    if competes:
        none = np.zeros(0, np.int64)
        payload = min(payload, encode(data, Parse(len(data), none, none, none), coding), key=len)
    if verify and decode(payload, len(data)) != data:
        raise CorruptChunk("a packed chunk does not decode to its bytes")
    return (PACKED, payload) if len(payload) < len(data) else (RAW, data)


def unpack(mode: int, payload: bytes, size: int) -> bytes:
    if mode not in (RAW, PACKED):
        raise CorruptChunk(f"unknown chunk mode {mode}")
    out = payload if mode == RAW else decode(payload, size)
    if len(out) != size:
        raise CorruptChunk(f"{len(out)} bytes instead of {size}")
    return out


def prefix_costs(data: bytes, literal: float = 6.48, predicted: float | str = 0.5, stride: int = 1) -> np.ndarray:
    """Cost in bits of coding the first i bytes as literals; see matches.literal_bits."""
    return np.concatenate([[0.0], np.cumsum(literal_bits(data, literal, predicted, stride))])
