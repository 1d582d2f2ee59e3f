"""Matches and parses of one chunk, with NumPy.

Search: places are sorted by the hash slot of their four bytes, so that the k-th earlier place of a slot lies k rows up;
one pass for each k looks at all places of the chunk together. Parse: what coding the rest of the chunk costs is worked
out from its end to its start, at each place as the least of a literal and the matches found there; the tokens follow
the choices from the start. Costs are whole numbers of 1/UNIT bit, so that sums are exact.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from bytequarry.functions.scalar import FACTOR, RECENT_MODES, lattice_bits
from bytequarry.functions.transforms import residuals

SHORTEST, LONGEST, EXTENDED = 4, 255, 65535
UNIT = 256


@dataclass(frozen=True)
class ParseOptions:
    """Costs in bits, and limits of the match search."""

    literal: float = 6.48
    match: float = 9.42
    distance: float = 1.88
    #: How many earlier places of a slot are looked at.
    depth: int = 42
    hash_bits: int = 20
    window: int = 1 << 22
    #: What distances save: a mode of scalar.lattice_bits; 0 for nothing.
    lattice: int = 0
    #: What literals cost: a share of the predicted cost, or a name in BLENDS; 0 for `literal` bits each.
    predicted: float | str = 0.0
    #: Every so many bytes a literal's cost is predicted; between them it drifts back to `literal`.
    stride: int = 1
    #: A second match at every place: "nearest", or "cheapest" for the one that saves most.
    second: str = ""


def _words(data: bytes, width: int) -> np.ndarray:
    """The little-endian word of `width` bytes that starts at every place."""
    n = max(0, len(data) - width + 1)
    return np.array(np.ndarray((n,), f"<u{width}", data, strides=(1,))) if n else np.zeros(0, f"<u{width}")


def common_lengths(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, known: int = 0) -> np.ndarray:
    """How many bytes from a and from b agree, up to `most`; `known` of them are known to. words are those of eight bytes,
    of padded data."""
    out, left = np.full(len(a), known, np.int64), np.arange(len(a))
    while len(left):
        at = out[left]
        differ = words[a[left] + at] ^ words[b[left] + at]
        first = (np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)  # 8 if none differs
        out[left] = np.minimum(at + first, most[left])
        left = left[(first == 8) & (out[left] < most[left])]
    return out


@dataclass
class Found:
    """Lengths and distances by place; length 0 where there is no match."""

    length: np.ndarray
    distance: np.ndarray


class Search:
    """The places of a chunk, or of several that lie one behind the other, in the order of their slots."""

    def __init__(self, data: bytes, hash_bits: int = 20, window: int = ParseOptions.window, sizes: np.ndarray | None = None):
        """sizes: how long the chunks in data are; nothing is matched across two of them."""
        self.n, self.window = len(data), window
        sizes = np.array([self.n]) if sizes is None else sizes
        #: Bytes from every place to the end of its chunk.
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(self.n)
        self.grams, self.words = _words(data, 4), _words(data + bytes(8), 8)
        at = np.flatnonzero(self.left >= 4).astype(np.uint64)
        chunk = np.repeat(np.arange(len(sizes), dtype=np.uint64), np.maximum(sizes - 3, 0))
        slot = (self.grams[at].astype(np.uint64) * np.uint64(FACTOR)) & np.uint64((1 << hash_bits) - 1)
        if len(sizes) >> (32 - hash_bits) or self.n >> 32:
            raise ValueError("too many chunks at once")
        # chunk, slot and place in one number: no two are equal, so any sort will do
        keys = np.sort((chunk << np.uint64(hash_bits) | slot) << np.uint64(32) | at)
        self.order, slot = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), keys >> np.uint64(32)
        rows = np.arange(len(slot))
        fresh = np.ones(len(slot), bool)
        fresh[1:] = slot[1:] != slot[:-1]
        self.nth = rows - np.maximum.accumulate(np.where(fresh, rows, 0)) if len(rows) else rows

    def earlier(self, depth: int):
        """For k = 1 to depth: (places, the k-th earlier places of their slots), as far as their four bytes agree."""
        return (pair for _, pair in self.numbered(depth))

    def numbered(self, depth: int):
        """(k, what earlier() gives for it)."""
        rows = np.flatnonzero(self.nth)
        for k in range(1, depth + 1):
            rows = rows[self.nth[rows] >= k]
            if not len(rows):
                return
            here, there = self.order[rows], self.order[rows - k]
            same = (self.grams[here] == self.grams[there]) & (here - there <= self.window)
            yield k, (here[same], there[same])

    def candidates(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, distances and numbers in the slot of all that earlier() gives."""
        found = [(here, here - there, np.full(len(here), k)) for k, (here, there) in self.numbered(depth)]
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def best(self, depth: int, k: int, score) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k candidates of the highest score(distances) at every place, of equal scores the nearer: places, distances
        and ranks from 1."""
        scores, distances = np.full((k, self.n), -np.inf), np.zeros((k, self.n), np.int64)
        for here, there in self.earlier(depth):
            new, far, moved = score(here - there), here - there, np.zeros(len(here), bool)
            for own, known in zip(scores, distances):
                moved |= new > own[here]  # what gives way to a better one goes before all that follow
                at = here[moved]
                own[at], new[moved] = new[moved], own[at]
                known[at], far[moved] = far[moved], known[at]
        rank, at = np.nonzero(distances)
        return at, distances[rank, at], rank + 1

    def longest(self, depth: int) -> Found:
        """At every place the longest match of up to LONGEST bytes; of equal ones the nearest."""
        length, distance = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        most, data = np.minimum(LONGEST, self.left), np.append(self.words.view(np.uint8)[::8], np.uint8(0))
        rows = np.argsort(-np.minimum(self.nth, depth).astype(np.int16), kind="stable") if depth < 1 << 15 else np.argsort(-self.nth, kind="stable")
        counts = np.searchsorted(-self.nth[rows].clip(max=depth), -np.arange(1, depth + 1), side="right")
        places = self.order[rows]
        for k, n in enumerate(counts.tolist(), 1):
            if not n:
                break
            here, there = places[:n], self.order[rows[:n] - k]
            known = length[here]
            # only a place whose next byte agrees too can be longer
            can = np.flatnonzero(data[here + known] == data[there + known])
            here, there, known = here[can], there[can], known[can]
            can = (self.grams[here] == self.grams[there]) & (known < most[here]) & (here - there <= self.window)
            here, there = here[can], there[can]
            found = common_lengths(self.words, here, there, most[here], SHORTEST)
            better = found > length[here]
            length[here[better]], distance[here[better]] = found[better], (here - there)[better]
        return Found(length, distance)

    def nearest(self, depth: int) -> Found:
        length, distance = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for here, there in self.earlier(depth):
            new = length[here] == 0
            here, there = here[new], there[new]
            length[here] = common_lengths(self.words, here, there, np.minimum(LONGEST, self.left[here]))
            distance[here] = here - there
        return Found(length, distance)

    def cheapest(self, depth: int, prefix: np.ndarray, bits) -> Found:
        """At every place the match that saves most; of equal ones the nearest. bits(places, lengths, distances)."""
        length, distance, saved = (np.zeros(self.n, np.int64) for _ in range(3))
        for here, there in self.earlier(depth):
            found = common_lengths(self.words, here, there, np.minimum(LONGEST, self.left[here]))
            gain = prefix[here + found] - prefix[here] - bits(here, found, here - there)
            better = gain > saved[here]
            at = here[better]
            length[at], distance[at], saved[at] = found[better], (here - there)[better], gain[better]
        return Found(length, distance)

    def extend(self, found: Found) -> Found:
        """Matches of LONGEST bytes made as long as they go, up to EXTENDED. Where neighbours match at one distance, each
        is a byte longer than the next, so only the last of them is compared."""
        full = np.flatnonzero(found.length == LONGEST)
        if not len(full):
            return found
        last = np.ones(len(full), bool)
        last[:-1] = (full[1:] != full[:-1] + 1) | (found.distance[full][1:] != found.distance[full][:-1])
        ends = full[last]
        reach = ends + common_lengths(self.words, ends, ends - found.distance[ends], np.minimum(EXTENDED, self.left[ends]))
        of = np.searchsorted(ends, full)
        length = found.length.copy()
        length[full] = np.minimum(EXTENDED, reach[of] - full)
        return Found(length, found.distance)


# --- costs -------------------------------------------------------------------------------------------

#: Places whose counts a predicted cost does not know yet.
BLOCK = 64

#: What share of a literal's predicted cost counts, by its surprise (cost above the level before it) and
#: by the cost itself.
BLENDS = {
    "asymmetric": lambda surprise, cost: np.select([surprise > 1.25, surprise < -1.25], [0.72, 0.35], 0.50),
    "smooth": lambda surprise, cost: 0.50 + np.where(surprise >= 0, 0.25, -0.20) * np.minimum(1.0, np.abs(surprise) / 3.0),
    "zones": lambda surprise, cost: np.select([cost >= 7.0, cost <= 4.5], [0.68, 0.38], 0.50),
}
LEAST, MOST, DRIFT = 1.5, 10.0, 0.92


def predicted_bits(data: bytes) -> np.ndarray:
    """Bits of every byte's residual, by how often it occurred in the blocks of BLOCK bytes before its own."""
    r = np.frombuffer(residuals(data), np.uint8).astype(np.int64)
    block = np.arange(len(r)) // BLOCK
    counts = np.bincount(block * 256 + r, minlength=(len(r) // BLOCK + 1) * 256).reshape(-1, 256)
    before = np.cumsum(counts, axis=0) - counts
    return np.log2((256.0 + BLOCK * block) / (1.0 + before[block, r]))


def literal_bits(data: bytes, literal: float = ParseOptions.literal, predicted: float | str = 0.0, stride: int = 1) -> np.ndarray:
    """Bits that every byte costs as a literal: `literal`, or a blend of it with the predicted cost."""
    if not predicted or not data:
        return np.full(len(data), float(literal))
    own = predicted_bits(data)
    if predicted in BLENDS:
        starts = np.arange(0, len(own), BLOCK)
        means = np.add.reduceat(own, starts) / np.diff(np.append(starts, len(own)))
        level = np.concatenate([[literal], means[:-1]])[np.arange(len(own)) // BLOCK]
        share = BLENDS[predicted](own - level, own)
    else:
        share = float(predicted)
    made = np.clip((1.0 - share) * literal + share * own, LEAST, MOST)
    if stride > 1:
        since = np.arange(len(own)) % stride
        made = literal + (made[np.arange(len(own)) - since] - literal) * DRIFT**since
    return made


def match_bits(length: np.ndarray, distance: np.ndarray, options: ParseOptions, last=0, older=0) -> np.ndarray:
    """Cost of matches in units."""
    bits = options.match + np.where(length <= 7, 1.0, np.log2(length + 1.0)) + options.distance * np.log2(distance + 1.0)
    if options.lattice:
        bits = bits - lattice_bits(options.lattice, distance, last, older)
    return np.rint(UNIT * bits).astype(np.int64)


# --- parse -------------------------------------------------------------------------------------------


def _choices(literals: list[int], found: list[tuple[list[int], list[int]]]) -> list[int]:
    """At every place 0 for a literal or the number of a match (from 1), whichever makes the rest cheapest."""
    n = len(literals)
    cost, choice = [0] * (n + 1), [0] * n
    (length, bits), more = found[0], found[1:]
    for at in range(n - 1, -1, -1):
        least = cost[at + 1] + literals[at]
        size = length[at]
        if size:
            own = cost[at + size] + bits[at]
            if own < least:
                least, choice[at] = own, 1
            for i, (sizes, prices) in enumerate(more, 2):
                if sizes[at]:
                    own = cost[at + sizes[at]] + prices[at]
                    if own < least:
                        least, choice[at] = own, i
        cost[at] = least
    return choice


@dataclass
class Parse:
    """Matches by place, in order; all other bytes are literals."""

    size: int
    start: np.ndarray
    length: np.ndarray
    distance: np.ndarray

    @property
    def literals(self) -> int:
        return self.size - int(self.length.sum())

    def tokens(self) -> list[tuple[int, int]]:
        out, at = [], 0
        for start, length, distance in zip(self.start.tolist(), self.length.tolist(), self.distance.tolist()):
            out += [(1, 0)] * (start - at)
            out.append((length, distance))
            at = start + length
        return out + [(1, 0)] * (self.size - at)


def parsed(data: bytes, options: ParseOptions = ParseOptions()) -> Parse:
    """The cheapest parse of literals and the matches found. Where distances save by those before them, a first parse
    without that tells which these are."""
    if options.lattice in RECENT_MODES:
        first = parsed(data, replace(options, lattice=0))
        after = np.searchsorted(first.start + first.length, np.arange(len(data)), side="right")
        known = np.concatenate([[0, 0], first.distance])
        return _parsed(data, options, known[after + 1], known[after])
    none = np.zeros(len(data), np.int64)
    return _parsed(data, options, none, none)


def _parsed(data: bytes, options: ParseOptions, last: np.ndarray, older: np.ndarray) -> Parse:
    search = Search(data, options.hash_bits, options.window)
    costs = np.rint(UNIT * literal_bits(data, options.literal, options.predicted, options.stride)).astype(np.int64)
    bits = lambda at, length, distance: match_bits(length, distance, options, last[at], older[at])
    found = [search.longest(options.depth)]
    if options.second == "nearest":
        found.append(search.nearest(options.depth))
    elif options.second == "cheapest":
        found.append(search.cheapest(options.depth, np.concatenate([[0], np.cumsum(costs)]), bits))
    found = [search.extend(f) for f in found]
    every = np.arange(len(data))
    choice = _choices(costs.tolist(), [(f.length.tolist(), bits(every, f.length, f.distance).tolist()) for f in found])
    lengths, distances = [f.length.tolist() for f in found], [f.distance.tolist() for f in found]
    starts, taken, far, at = [], [], [], 0
    for place in np.flatnonzero(choice).tolist():
        if place >= at:
            i = choice[place] - 1
            at = place + lengths[i][place]
            starts.append(place), taken.append(lengths[i][place]), far.append(distances[i][place])
    return Parse(len(data), *(np.array(x, np.int64) for x in (starts, taken, far)))
