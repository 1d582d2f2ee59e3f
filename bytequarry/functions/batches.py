"""The chunk kernel over many short chunks at once: what lz.pack and lz.unpack do to each, with the same containers.

A step of NumPy takes as long for one short chunk as for hundreds, so steps go over all chunks of a batch: the parse and
the copying of matches place by place, the coder round by round with a model for each chunk. Chunks over SHORT bytes, and
options that only lz knows how to follow, go through lz one by one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from bytequarry.functions import lanes, lz, matches
from bytequarry.functions.lz import RECENT
from bytequarry.functions.transforms import LAGS, NEIGHBOURS

SHORT = 1 << 14
#: Bytes that are searched at once: their words stay in the cache.
SEARCHED = 1 << 17


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count."""
    return np.arange(counts.sum()) - np.repeat(_starts(counts), counts)


class _Grid:
    """Cells (row, column) of chunks: a column is a chunk, the longest first, so that those of a row come first."""

    def __init__(self, sizes: np.ndarray):
        order = np.argsort(-sizes, kind="stable")
        self.column = np.empty(len(sizes), np.int64)
        self.column[order] = np.arange(len(sizes))
        self.width, self.height, self.order = len(sizes), int(sizes.max(initial=0)), order
        #: Columns with more than so many bytes, by row.
        self.filled = np.searchsorted(-sizes[order], -np.arange(self.height + 1), side="left").tolist()


# --- parse -------------------------------------------------------------------------------------------


@dataclass
class _Parses:
    """Matches of all chunks, chunk by chunk."""

    count: np.ndarray
    chunk: np.ndarray
    start: np.ndarray
    length: np.ndarray
    distance: np.ndarray


def _found(raws: list[bytes], sizes: np.ndarray, options: matches.ParseOptions) -> tuple[np.ndarray, ...]:
    """Chunks, bytes left, lengths and distances of the places with a match."""
    out, at = [], 0
    while at < len(raws):
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), SEARCHED, side="right")) + at)
        search = matches.Search(b"".join(raws[at:end]), options.hash_bits, options.window, sizes[at:end])
        found = search.extend(search.longest(options.depth))
        places = np.flatnonzero(found.length)
        chunk = np.repeat(np.arange(at, end), sizes[at:end])
        out.append((chunk[places], search.left[places], found.length[places], found.distance[places]))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out))


def parsed(raws: list[bytes], options: matches.ParseOptions = matches.ParseOptions(), penalties: np.ndarray | None = None) -> _Parses:
    """matches.parsed() of every chunk; penalties: `distance` of the options for each."""
    sizes = np.array([len(raw) for raw in raws], np.int64)
    chunk, left, length, distance = _found(raws, sizes, options)
    own = options if penalties is None else replace(options, distance=penalties[chunk])
    bits = matches.match_bits(length, distance, own)
    grid, literal = _Grid(sizes), int(np.rint(matches.UNIT * options.literal))
    column, width = grid.column[chunk], grid.width
    cell = left * width + column  # a row is the number of bytes left
    target = np.zeros((grid.height + 1, width), np.int64)
    price = np.full((grid.height + 1, width), 1 << 50, np.int64)
    target.reshape(-1)[cell], price.reshape(-1)[cell] = cell - length * width, bits
    cost = np.zeros((grid.height + 1, width), np.int64)
    flat = cost.reshape(-1)
    for row in range(1, grid.height + 1):
        m = grid.filled[row - 1]
        matched = flat.take(target[row, :m])
        matched += price[row, :m]
        np.minimum(matched, cost[row - 1, :m] + literal, out=cost[row, :m])
    taken = np.flatnonzero(flat[cell] < flat[cell - width] + literal)
    del target, price
    cell, chosen = cell[taken], np.zeros((grid.height + 1) * width, np.int32)
    chosen[cell] = left[taken]
    following = np.maximum.accumulate(chosen.reshape(-1, width), axis=0).reshape(-1)  # row of the next match, 0 if none
    which = np.zeros(len(chosen), np.int32)
    which[cell] = taken
    columns, rows, steps = np.arange(width), sizes[grid.order], []
    while True:
        rows = following[rows * width + columns].astype(np.int64)
        on = rows > 0
        columns, rows = columns[on], rows[on]
        if not len(rows):
            break
        steps.append(which[rows * width + columns])
        rows = rows - length[steps[-1]]
    all_ = np.concatenate([np.zeros(0, np.int64), *steps])
    all_ = all_[np.argsort(chunk[all_].astype(np.uint16), kind="stable")]
    chunk = chunk[all_]
    return _Parses(np.bincount(chunk, minlength=len(raws)), chunk, sizes[chunk] - left[all_], length[all_], distance[all_])


# --- recent distances --------------------------------------------------------------------------------

#: Where each of the recent distances comes from, by the place of the one that moves to the front.
_MOVED = np.array([[0, *(i - 1 if i <= p else i for i in range(1, RECENT))] for p in range(RECENT + 1)])


def _by_step(count: np.ndarray):
    """For the first match of every chunk, the second and so on: how many chunks have it, and where it is among all
    matches. Chunks come in the order of their counts, the largest first."""
    starts, order = _starts(count), np.argsort(-count, kind="stable")
    ends = np.searchsorted(-count[order], -np.arange(int(count.max(initial=0))), side="left")
    for step, m in enumerate(ends.tolist()):
        yield m, starts[order[:m]] + step


def _to_places(count: np.ndarray, distance: np.ndarray) -> np.ndarray:
    recent, out = np.zeros((len(count), RECENT), np.int64), np.zeros(len(distance), np.int64)
    for m, at in _by_step(count):
        d, known = distance[at], recent[:m]
        same = known == d[:, None]
        out[at] = place = np.where(same.any(axis=1), same.argmax(axis=1), RECENT)
        recent[:m] = np.take_along_axis(known, _MOVED[place], 1)
        recent[:m, 0] = d
    return out


def _from_places(count: np.ndarray, places: np.ndarray, new: np.ndarray) -> np.ndarray:
    """new: the new distances, chunk by chunk."""
    fresh = places == RECENT
    out = np.zeros(len(places), np.int64)
    out[fresh] = new
    recent = np.zeros((len(count), RECENT), np.int64)
    for m, at in _by_step(count):
        place, known = places[at], recent[:m]
        d = np.where(fresh[at], out[at], known[np.arange(m), np.minimum(place, RECENT - 1)])
        out[at] = d
        recent[:m] = np.take_along_axis(known, _MOVED[place], 1)
        recent[:m, 0] = d
    return out


# --- coder -------------------------------------------------------------------------------------------


class _Port:
    def __init__(self, lanes_of: np.ndarray):
        self.lanes, self.base = lanes_of, _starts(lanes_of)


class _Writer(_Port):
    """lanes.Writer of every chunk."""

    decoding = False

    def __init__(self, lanes_of: np.ndarray):
        super().__init__(lanes_of)
        self.noted: list[tuple[np.ndarray, ...]] = []

    def move(self, lane: np.ndarray, owner: np.ndarray, share: np.ndarray, start: np.ndarray) -> None:
        self.noted.append((lane, owner.astype(np.uint16), share.astype(np.int32), start.astype(np.int32)))

    def finish(self) -> list[bytes]:
        x, words, owners = np.full(self.lanes.sum(), lanes.FLOOR, np.int64), [], []
        while self.noted:
            lane, owner, share, start = self.noted.pop()
            own, share = x[lane], share.astype(np.int64)
            full = np.flatnonzero(own >= share << 32 - lanes.BITS)
            words.append((own[full] & 0xFFFF).astype("<u2")), owners.append(owner[full])
            own[full] >>= 16
            whole = (own / share).astype(np.int64)  # exact: both are under 2**32
            x[lane] = (whole << lanes.BITS) + own - whole * share + start
        all_words, owner = np.concatenate([np.zeros(0, "<u2"), *words[::-1]]), np.concatenate([np.zeros(0, np.uint16), *owners[::-1]])
        all_words = all_words[np.argsort(owner, kind="stable")].astype("<u2").tobytes()
        ends, states = np.cumsum(np.bincount(owner, minlength=len(self.lanes))).tolist(), x.astype("<u4").tobytes()
        heads = zip(self.base.tolist(), self.lanes.tolist(), [0, *ends], ends)
        return [states[4 * b : 4 * (b + n)] + all_words[2 * s : 2 * e] for b, n, s, e in heads]


class _Reader(_Port):
    """lanes.Reader of every chunk."""

    decoding = True

    def __init__(self, data: list[bytes], lanes_of: np.ndarray):
        super().__init__(lanes_of)
        if any(len(d) < 4 * n or len(d) % 2 for d, n in zip(data, lanes_of.tolist())):
            raise lanes.CorruptStream("the data end early")
        self.x = np.frombuffer(b"".join(d[: 4 * n] for d, n in zip(data, lanes_of.tolist())), "<u4").astype(np.int64)
        rest = [d[4 * n :] for d, n in zip(data, lanes_of.tolist())]
        self.words = np.frombuffer(b"".join(rest), "<u2").astype(np.int64)
        self.ends = np.cumsum([len(r) // 2 for r in rest])
        self.at = np.concatenate([[0], self.ends[:-1]])

    def move(self, lane: np.ndarray, owner: np.ndarray, share: np.ndarray, start: np.ndarray) -> None:
        own = self.x[lane]
        own = share * (own >> lanes.BITS) + (own & lanes.TOTAL - 1) - start
        empty = np.flatnonzero(own < lanes.FLOOR)
        if len(empty):
            of = owner[empty]
            n = np.bincount(of, minlength=len(self.at))
            at = (self.at - _starts(n))[of] + np.arange(len(empty))
            self.at = self.at + n
            if (self.at > self.ends).any():
                raise lanes.CorruptStream("the data end early")
            own[empty] = own[empty] << 16 | self.words[at]
        self.x[lane] = own

    def finish(self) -> None:
        if (self.at != self.ends).any() or (self.x != lanes.FLOOR).any():
            raise lanes.CorruptStream("the data do not end where the symbols do")


class _Models:
    """lanes.Adaptive of every chunk, each with its own number of contexts."""

    def __init__(self, contexts: np.ndarray, symbols: int, decoding: bool):
        rows = int(contexts.sum())
        self.symbols, self.base = symbols, _starts(contexts)
        self.table = np.ones((rows, symbols), np.int32)
        self.counts, self.parts = self.table.reshape(-1), np.empty((rows, symbols))
        shares, starts = np.empty((rows, symbols), np.int32), np.empty((rows, symbols), np.int32)
        self.shares, self.starts, self.share, self.start = shares, starts, shares.reshape(-1), starts.reshape(-1)
        self.first, self.rows = np.arange(rows)[:, None] * lanes.TOTAL, np.arange(rows)
        self.edges = np.empty((rows, symbols), np.int64) if decoding else None
        self.round = self.due = 0
        self.refresh()

    def refresh(self) -> None:
        total = self.table.sum(axis=1, keepdims=True)
        heavy = total[:, 0] > lanes.LIMIT * 8
        if heavy.any():
            self.table[heavy] = (self.table[heavy] + 1) >> 1
            total = self.table.sum(axis=1, keepdims=True)
        np.multiply(self.table, float(lanes.TOTAL - self.symbols), out=self.parts)
        self.parts /= total  # exact once cut off: all numbers are far under 2**52
        np.copyto(self.shares, self.parts, casting="unsafe")
        self.shares += 1
        self.shares[self.rows, self.table.argmax(axis=1)] += (lanes.TOTAL - self.shares.sum(axis=1)).astype(np.int32)
        np.cumsum(self.shares, axis=1, out=self.starts)
        self.starts -= self.shares
        if self.edges is not None:
            np.add(self.starts, self.first, out=self.edges)
        self.due = self.round + 1 + self.round // 4

    def learn(self, cells: np.ndarray) -> None:
        np.add.at(self.counts, cells, np.int32(lanes.STEP))
        self.round += 1
        if self.round >= self.due:
            self.refresh()


def _rounds(port: _Port, n: np.ndarray):
    """Round by round: lanes, their chunks, places of their symbols, and (if it has changed) which lanes are left."""
    size = -(-n // port.lanes)
    used = -(-n // np.maximum(size, 1))
    owner, i = np.repeat(np.arange(len(n)), used), _within(used)
    lane, first = port.base[owner] + i, _starts(n)[owner] + i * size[owner]
    length = np.minimum(size[owner], n[owner] - i * size[owner])
    stops, t, left = set(length.tolist()), 0, None
    while len(lane):
        yield lane, owner, first + t, left
        t, left = t + 1, None
        if t in stops:
            left = np.flatnonzero(length > t)
            lane, owner, first, length = lane[left], owner[left], first[left], length[left]


def _code(port, given: np.ndarray | None, n: np.ndarray, symbols: int, contexts: np.ndarray | None = None, context=None) -> np.ndarray:
    """lanes.code() of every chunk. context(symbol before, the one before that, places, chunks)."""
    models = _Models(np.ones(len(n), np.int64) if contexts is None else contexts, symbols, port.decoding)
    out = np.zeros(int(n.sum()), np.int64) if given is None else given
    one = two = None
    for lane, owner, at, left in _rounds(port, n):
        if one is None:
            one = two = np.zeros(len(lane), np.int64)
        elif left is not None:
            one, two = one[left], two[left]
        row = models.base[owner]
        if context is not None:
            row = row + context(one, two, at, owner)
        if port.decoding:
            cells = np.searchsorted(models.edges.reshape(-1), row * lanes.TOTAL + (port.x[lane] & lanes.TOTAL - 1), side="right") - 1
            out[at] = cells - row * symbols
        else:
            cells = row * symbols + out[at]
        port.move(lane, owner, models.share[cells].astype(np.int64), models.start[cells])
        models.learn(cells)
        one, two = out[at], one
    return out


def _code_numbers(port, given: np.ndarray | None, n: np.ndarray) -> np.ndarray:
    """lanes.code_numbers() of every chunk."""
    symbols = None
    if given is not None:
        symbols = np.where(given < lanes.DIRECT, given, lanes.DIRECT + lanes.bit_lengths(given) - lanes.DIRECT.bit_length())
    symbols = _code(port, symbols, n, lanes.NUMBERS)
    widths = np.where(symbols < lanes.DIRECT, 0, symbols - lanes.DIRECT + lanes.DIRECT.bit_length() - 1)
    first = np.int64(1) << widths
    rest = np.zeros(len(widths), np.int64) if given is None else np.where(symbols < lanes.DIRECT, 0, given - first)
    done = np.zeros(len(widths), np.int64)
    while (widths > done).any():
        now = np.minimum(widths - done, lanes.SLICE)
        for lane, owner, at, _ in _rounds(port, n):
            some = np.flatnonzero(now[at])  # numbers without bits move nothing
            lane, owner, at = lane[some], owner[some], at[some]
            unit = np.int64(lanes.TOTAL) >> now[at]
            if port.decoding:
                value = (port.x[lane] & lanes.TOTAL - 1) // unit
                rest[at] |= value << done[at]
            else:
                value = (rest[at] >> done[at]) & ((np.int64(1) << now[at]) - 1)
            port.move(lane, owner, unit, value * unit)
        done = done + now
    return np.where(symbols < lanes.DIRECT, symbols, first + rest)


# --- literals ----------------------------------------------------------------------------------------

_KINDS = list(lz.LITERAL_CONTEXTS.values())
_SIZES = np.array([n for n, _, _ in _KINDS])


def _literal_context(kinds: np.ndarray, places: np.ndarray):
    """The contexts of literals by the kind of their chunk; None if all have one context."""
    present = np.unique(kinds)
    if not (_SIZES[present] > 1).any():
        return None

    def context(one, two, at, owner):
        out, own = np.zeros(len(at), np.int64), kinds[owner]
        for kind in present.tolist():
            _, by_place, of = _KINDS[kind]
            if _SIZES[kind] > 1:
                here = np.flatnonzero(own == kind)
                out[here] = of(places[at[here]]) if by_place else of(one[here], two[here])
        return out

    return context


def _lags(whole: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int]]]:
    """The pairs of the mean "lags" of every chunk."""
    starts, place = _starts(sizes), _within(sizes)
    rates = np.full((len(LAGS), len(sizes)), -1.0)
    for i, lag in enumerate(LAGS):
        same = np.zeros(len(whole), np.int32)
        same[lag:] = (whole[lag:] == whole[: max(0, len(whole) - lag)]) & (place[lag:] >= lag)
        n = sizes - lag
        rates[i] = np.where(n > 0, np.add.reduceat(same, starts) / np.maximum(n, 1), -1.0)
    out = []
    for own in rates.T.tolist():
        best = sorted(zip(own, LAGS), reverse=True)[:3]
        out.append([(lag, 3 - i) for i, (rate, lag) in enumerate(x for x in best if x[0] > 0)])
    return out


def _less_mean(whole: np.ndarray, at: np.ndarray, place: np.ndarray, pairs: list[tuple]) -> np.ndarray:
    """The literals at `at`, `place` bytes into their chunks, less the mean of (distances, weights)."""
    total, weight = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for distance, w in pairs:
        known = (place >= distance) * w
        total += known * whole[np.where(known > 0, at - distance, 0)]
        weight += known
    mean = ((total + weight // 2) / np.maximum(weight, 1)).astype(np.int64)
    return (whole[at] - mean) & 255


_TABLE: list[np.ndarray] = []


def _logs(most: int) -> tuple[np.ndarray, np.ndarray]:
    """n log2 n, and what a pair that occurs n times takes from a cost."""
    if not _TABLE or len(_TABLE[0]) <= most:
        n = np.arange(max(most, SHORT) + 1)
        x = n * np.log2(np.maximum(n, 1))
        _TABLE[:] = x, np.where(n > 0, 6.0 - x, 0.0)
    return _TABLE[0], _TABLE[1]


def _least(whole: np.ndarray, sizes: np.ndarray, chunk: np.ndarray, place: np.ndarray) -> tuple[list[list], np.ndarray, np.ndarray]:
    """lz._least() of every chunk: pairs of its mean, kind of its contexts, and its literals against that mean."""
    at, n = _starts(sizes)[chunk] + place, np.bincount(chunk, minlength=len(sizes))
    lags = _lags(whole, sizes)
    given = np.array([[*own, *[(1 << 30, 0)] * (3 - len(own))] for own in lags]).reshape(-1, 3, 2)
    wide = whole.astype(np.int64)
    against = [wide[at], _less_mean(wide, at, place, NEIGHBOURS), _less_mean(wide, at, place, [(given[chunk, i, 0], given[chunk, i, 1]) for i in range(3)])]
    logs, pairs = _logs(int(n.max(initial=0)))
    costs, within, bounds = np.zeros((len(against), len(_KINDS), len(sizes))), _within(n), np.append(_starts(n), len(chunk))
    for low in range(0, len(sizes), 32):  # few enough for the counts to stay in the cache
        high = min(len(sizes), low + 32)
        part = slice(bounds[low], bounds[high])
        own, inside, where = chunk[part] - low, within[part], place[part]
        for i, symbols in enumerate(against):
            symbols = symbols[part]
            one, two = np.zeros_like(symbols), np.zeros_like(symbols)
            one[1:], two[2:] = symbols[:-1], symbols[:-2]
            one[inside < 1], two[inside < 2] = 0, 0
            for j, (k, by_place, of) in enumerate(_KINDS):
                keys = (own * k + (of(where) if by_place else of(one, two))) * 256 + symbols
                counts = np.bincount(keys, minlength=(high - low) * k * 256).reshape(high - low, k, 256)
                costs[i, j, low:high] = logs.take(counts.sum(axis=2)).sum(axis=1) + pairs.take(counts).sum(axis=(1, 2))
    best = costs.reshape(-1, len(sizes)).argmin(axis=0)
    mean, kind = best // len(_KINDS), best % len(_KINDS)
    symbols = np.choose(mean[chunk], against)
    return [[[], NEIGHBOURS, own][m] for m, own in zip(mean.tolist(), lags)], kind, symbols


# --- chunks ------------------------------------------------------------------------------------------


def _lanes_for(matched: np.ndarray, literals: np.ndarray) -> np.ndarray:
    return np.clip((literals + 4 * matched) // 96, 1, 1024)


def _literal_places(sizes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks and places of the bytes that no match covers."""
    change, at = np.zeros(int(sizes.sum()) + 1, np.int64), _starts(sizes)[chunk] + starts
    np.add.at(change, at, 1)
    np.add.at(change, at + lengths, -1)
    free = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return np.repeat(np.arange(len(sizes)), sizes)[free], _within(sizes)[free]


def _encoded(raws: list[bytes], found: _Parses) -> list[bytes]:
    sizes = np.array([len(raw) for raw in raws], np.int64)
    ends = found.start + found.length
    before = np.concatenate([[0], ends[:-1]])[: len(ends)]
    before[_starts(found.count)[found.count > 0]] = 0
    chunk, place = _literal_places(sizes, found.start, found.length, found.chunk)
    literals = np.bincount(chunk, minlength=len(raws))
    means, kinds, symbols = _least(np.frombuffer(b"".join(raws), np.uint8), sizes, chunk, place)
    port = _Writer(_lanes_for(found.count, literals))
    _code_numbers(port, found.start - before, found.count)
    _code_numbers(port, found.length - lz.SHORTEST, found.count)
    places = _to_places(found.count, found.distance)
    _code_places(port, places, found.count)
    new = places == RECENT
    _code_numbers(port, found.distance[new], np.bincount(found.chunk[new], minlength=len(raws)))
    _code(port, symbols, literals, 256, _SIZES[kinds], _literal_context(kinds, place))
    heads = zip(kinds.tolist(), means, found.count.tolist(), literals.tolist(), port.finish())
    return [lz._HEAD.pack(0, kind, len(mean), m, n) + b"".join(lz._PAIR.pack(*p) for p in mean) + data for kind, mean, m, n, data in heads]


def _code_places(port, given: np.ndarray | None, n: np.ndarray) -> np.ndarray:
    context = lambda one, two, at, owner: np.minimum(one, 3) * 4 + np.minimum(two, 3)
    return _code(port, given, n, RECENT + 1, np.full(len(n), 16), context)


def _decoded(payloads: list[bytes], sizes: np.ndarray) -> list[bytes]:
    heads = np.array([lz._HEAD.unpack_from(p) for p in payloads], np.int64)
    couple, kinds, pairs, count, literals = heads.T
    if couple.any() or (kinds >= len(_KINDS)).any() or (pairs > 8).any() or (literals > sizes).any() or (count * lz.SHORTEST > sizes).any():
        raise lz.CorruptChunk("the head does not fit the chunk")
    means = [[lz._PAIR.unpack_from(p, lz._HEAD.size + i * lz._PAIR.size) for i in range(n)] for p, n in zip(payloads, pairs.tolist())]
    if any(not d for mean in means for d, _ in mean):
        raise lz.CorruptChunk("a mean of the byte itself")
    bodies = [p[lz._HEAD.size + n * lz._PAIR.size :] for p, n in zip(payloads, pairs.tolist())]
    port = _Reader(bodies, _lanes_for(count, literals))
    chunk = np.repeat(np.arange(len(sizes)), count)
    runs = _code_numbers(port, None, count)
    lengths = _code_numbers(port, None, count) + lz.SHORTEST
    places = _code_places(port, None, count)
    new = places == RECENT
    far = _code_numbers(port, None, np.bincount(chunk[new], minlength=len(sizes)))
    distances = _from_places(count, places, far)
    total = lambda x: np.bincount(chunk, x, minlength=len(sizes))
    if (total(lengths) + literals != sizes).any() or (total(runs) > literals).any():
        raise lz.CorruptChunk("the matches do not fit the chunk")
    ends = np.cumsum(runs + lengths)
    starts = ends - lengths - np.concatenate([[0], ends])[_starts(count)][chunk]
    if (distances < 1).any() or (distances > starts).any():
        raise lz.CorruptChunk("the matches do not fit the chunk")
    of, place = _literal_places(sizes, starts, lengths, chunk)
    symbols = _code(port, None, literals, 256, _SIZES[kinds], _literal_context(kinds, place)).astype(np.uint8)
    port.finish()
    out: list[bytes] = [b""] * len(sizes)
    for some in (np.flatnonzero(pairs == 0), np.flatnonzero(pairs)):
        if len(some):
            renumber = np.full(len(sizes), -1)
            renumber[some] = np.arange(len(some))
            lit, mat = renumber[of] >= 0, renumber[chunk] >= 0
            made = _written(
                sizes[some], [means[i] for i in some.tolist()], (renumber[of[lit]], place[lit], symbols[lit]),
                (renumber[chunk[mat]], starts[mat], lengths[mat], distances[mat]),
            )
            for i, data in zip(some.tolist(), made):
                out[i] = data
    return out


def _written(sizes: np.ndarray, means: list[list], literals: tuple[np.ndarray, ...], matched: tuple[np.ndarray, ...]) -> list[bytes]:
    """The bytes of chunks, all chunks' next byte at once: a match's from its distance back, a literal's from its mean."""
    grid, most = _Grid(sizes), max(map(len, means))
    above = max((d for mean in means for d, _ in mean), default=0)  # rows of zeros before the first byte
    width = grid.width
    shape = (grid.height, width)
    of, place, symbols = literals
    at = place * width + grid.column[of]
    added = np.zeros(shape, np.uint8)
    added.reshape(-1)[at] = symbols
    # a cell that is no part of a match reads itself, which is still 0
    source = (np.arange(grid.height * width) + above * width).reshape(shape)
    chunk, start, length, distance = matched
    cells = (np.repeat(start, length) + _within(length)) * width + np.repeat(grid.column[chunk], length)
    source.reshape(-1)[cells] -= np.repeat(distance, length) * width
    out = np.zeros((above + grid.height, width), np.uint8)
    flat = out.reshape(-1)
    if most:
        back, weights = np.zeros((most, width), np.int64), np.zeros((most, width), np.float32)
        weight = np.zeros(shape, np.int32)
        for i in range(len(sizes)):
            column = grid.column[i]
            for j, (d, w) in enumerate(means[i]):
                back[j, column], weights[j, column] = d, w
                if d < grid.height:
                    weight[d, column] += w
        back = np.arange(width) + (above - back) * width
        weight = np.cumsum(weight, axis=0, dtype=np.int32)
        half, weight = (weight // 2).astype(np.float32), np.maximum(weight, 1).astype(np.float32)
        literal = np.zeros(shape, np.uint8)
        literal.reshape(-1)[at] = 1
    for row in range(grid.height):
        m = grid.filled[row]
        value = flat.take(source[row, :m])
        value += added[row, :m]
        if most:
            known = flat.take(back[:, :m] + row * width) * weights[:, :m]
            mean = known.sum(axis=0)
            mean += half[row, :m]
            mean /= weight[row, :m]
            value += mean.astype(np.uint8) * literal[row, :m]
        out[above + row, :m] = value
    columns = np.ascontiguousarray(out[above:].T)
    return [columns[c, :n].tobytes() for c, n in zip(grid.column.tolist(), sizes.tolist())]


def pack(
    raws: list[bytes], options: matches.ParseOptions = matches.ParseOptions(), verify: bool = True, compete_from: float | None = None,
    coding: lz.PackOptions = lz.PackOptions(), penalties: list[float] | None = None,
) -> list[tuple[int, bytes]]:
    """lz.pack() of every chunk; penalties: `distance` of the options for each."""
    own = lambda i: options if penalties is None else replace(options, distance=penalties[i])
    plain = coding == lz.PackOptions() and compete_from is None and not options.predicted and not options.second and options.lattice == 0 and options.hash_bits <= 22
    short = [i for i, raw in enumerate(raws) if plain and 0 < len(raw) <= SHORT]
    out: list = [None] * len(raws)
    for low in range(0, len(short), 1000):
        part = short[low : low + 1000]
        data = [bytes(raws[i]) for i in part]
        found = parsed(data, options, None if penalties is None else np.array([penalties[i] for i in part]))
        sizes = np.array([len(d) for d in data], np.int64)
        literals = sizes - np.bincount(found.chunk, found.length, minlength=len(data)).astype(np.int64)
        pays = literals <= sizes * 9 // 10
        for i, d, p in zip(part, data, pays.tolist()):
            out[i] = None if p else (lz.RAW, d)
        kept = np.flatnonzero(pays)
        if not len(kept):
            continue
        number, mine = np.cumsum(pays) - 1, pays[found.chunk]
        some = _Parses(found.count[kept], number[found.chunk[mine]], found.start[mine], found.length[mine], found.distance[mine])
        data = [data[k] for k in kept.tolist()]
        payloads = _encoded(data, some)
        if verify and unpack([lz.PACKED] * len(data), payloads, sizes[kept].tolist()) != data:
            raise lz.CorruptChunk("a packed chunk does not decode to its bytes")
        for k, d, payload in zip(kept.tolist(), data, payloads):
            out[part[k]] = (lz.PACKED, payload) if len(payload) < len(d) else (lz.RAW, d)
    return [lz.pack(bytes(raws[i]), own(i), verify, compete_from, coding) if x is None else x for i, x in enumerate(out)]


def unpack(modes: list[int], payloads: list[bytes], sizes: list[int]) -> list[bytes]:
    """lz.unpack() of every chunk."""
    out: list = [None] * len(modes)
    short = [i for i, (mode, p, n) in enumerate(zip(modes, payloads, sizes)) if mode == lz.PACKED and 0 < n <= SHORT and p[:1] == b"\0"]
    for low in range(0, len(short), 1000):
        part = short[low : low + 1000]
        try:
            made = _decoded([bytes(payloads[i]) for i in part], np.array([sizes[i] for i in part], np.int64))
        except Exception:  # a chunk is corrupt: lz says which and why
            continue
        for i, data in zip(part, made):
            out[i] = data
    return [lz.unpack(modes[i], bytes(payloads[i]), sizes[i]) if x is None else x for i, x in enumerate(out)]
