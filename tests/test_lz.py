import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytequarry.functions import lanes, lz, matches
from bytequarry.functions.scalar import FACTOR

random.seed(4)
EDGES = [b"", b"a", b"abc", b"a" * 300, b"a" * 70000, b"ab" * 400, bytes(range(256)) * 3, random.randbytes(1500), "naïve日本 ".encode() * 80,
         b"".join(random.choice([b"the ", b"cat ", b"sat\n"]) for _ in range(900)), bytes(i * i // 40 % 256 for i in range(1200))]
WORDS = b"".join(random.choice([b"the ", b"cat ", b"sat\n", b"zq"]) for _ in range(150))


# --- matches -----------------------------------------------------------------------------------------


def plain_matches(data, depth, bits):
    """The longest match at every place, by looking at each earlier place of the slot in turn."""
    slots, out = {}, []
    for at in range(len(data)):
        best = (0, 0)
        if at + 4 <= len(data):
            slot = int.from_bytes(data[at : at + 4], "little") * FACTOR % (1 << bits)
            for place in slots.get(slot, [])[::-1][:depth]:
                n = 0
                while n < 255 and at + n < len(data) and data[place + n] == data[at + n]:
                    n += 1
                if n >= 4 and n > best[0]:
                    best = n, at - place
            slots.setdefault(slot, []).append(at)
        out.append(best)
    return out


@pytest.mark.parametrize("depth,bits", [(42, 20), (1, 20), (3, 4), (42, 2)])
@pytest.mark.parametrize("data", [EDGES[3], EDGES[5], EDGES[6], EDGES[8][:400], WORDS], ids=len)
def test_longest_against_plain_search(data, depth, bits):
    found = matches.Search(data, bits).longest(depth)
    assert list(zip(found.length.tolist(), found.distance.tolist())) == plain_matches(data, depth, bits)


def test_first_and_cheapest_candidates():
    data = WORDS
    search, options = matches.Search(data), lz.ParseOptions()
    near = search.nearest(42)
    for at in np.flatnonzero(near.length).tolist():
        assert data.rfind(data[at : at + 4], 0, at + 3) == at - near.distance[at]
    prefix = np.arange(len(data) + 1) * round(256 * options.literal)
    bits = lambda at, n, d: matches.match_bits(n, d, options)
    best, long = search.cheapest(42, prefix, bits), search.longest(42)
    saved = lambda f: np.where(f.length > 0, prefix[f.length] - bits(None, f.length, f.distance), 0)
    assert (saved(best) >= saved(long)).all()


def test_window():
    data = b"wxyz" + bytes(range(130, 230)) + b"wxyz"
    assert matches.Search(data, window=104).longest(9).distance[-4] == 104 and matches.Search(data, window=103).longest(9).length[-4] == 0


def cheapest_by_hand(data, options):
    """Least total cost over all parses that use each place's longest match or a literal."""
    found = plain_matches(data, options.depth, options.hash_bits)
    cost = [0] * (len(data) + 1)
    for at in range(len(data) - 1, -1, -1):
        cost[at] = cost[at + 1] + round(256 * options.literal)
        n, d = found[at]
        if n:
            cost[at] = min(cost[at], cost[at + n] + int(matches.match_bits(np.array([n]), np.array([d]), options)[0]))
    return cost[0]


@pytest.mark.parametrize("options", [lz.ParseOptions(), lz.ParseOptions(literal=8.0, match=4.0, distance=0.5), lz.ParseOptions(depth=2)], ids=str)
def test_parse_is_the_cheapest(options):
    for data in (WORDS, EDGES[8][:250], b"abcd" * 9 + b"bcda" * 9):
        at = total = 0
        for n, d in lz.parse(data, options):
            assert d <= at and data[at : at + n] == bytes(data[at - d + i % d] for i in range(n)) if d else n == 1
            total += int(matches.match_bits(np.array([n]), np.array([d]), options)[0]) if d else round(256 * options.literal)
            at += n
        assert at == len(data) and total == cheapest_by_hand(data, options)


def test_long_run_is_one_extended_match():
    assert lz.parse(b"a" * 70000)[1][0] == matches.EXTENDED


# --- costs -------------------------------------------------------------------------------------------


def test_prefix_costs():
    assert lz.prefix_costs(b"abcd", 6.5, 0.0).tolist() == [0.0, 6.5, 13.0, 19.5, 26.0]
    for how in (1.0, 0.75, "asymmetric", "smooth", "zones"):
        steps = np.diff(lz.prefix_costs(EDGES[-2], 6.5, how))
        assert steps.min() >= 1.5 - 1e-9 and steps.max() <= 10 + 1e-9 and steps[-500:].mean() < 6.5


def test_predicted_bits_count_earlier_blocks():
    from bytequarry.functions.transforms import residuals

    data = EDGES[-2][:500]
    r, got = residuals(data), matches.predicted_bits(data)
    for at in range(500):
        start = at // 64 * 64
        assert got[at] == pytest.approx(np.log2((256 + start) / (1 + r[:start].count(r[at]))))


def test_strides_drift_back():
    full, thin = (matches.literal_bits(EDGES[-2], 6.5, 0.5, k) for k in (1, 4))
    assert (thin[::4] == full[::4]).all() and np.allclose(thin[3::4], 6.5 + (full[::4][: len(thin[3::4])] - 6.5) * 0.92**3)


# --- coding ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 161, 5000])
def test_lanes(n):
    rng = np.random.default_rng(n)
    symbols, known, numbers = rng.zipf(1.5, n) % 200, rng.integers(0, 3, n), rng.zipf(1.2, n) % (1 << 30)
    own = lambda one, two: (one & 1) + 2 * (two & 1)
    port = lanes.Writer(lanes.lanes_for(3 * n))
    for given, size, contexts, context in ((symbols, 200, 1, None), (symbols, 200, 3, known), (symbols, 200, 4, own)):
        lanes.code(port, given, n, size, contexts, context)
    lanes.code_numbers(port, numbers, n)
    data = port.finish()
    port = lanes.Reader(data, lanes.lanes_for(3 * n))
    for size, contexts, context in ((200, 1, None), (200, 3, known), (200, 4, own)):
        assert (lanes.code(port, None, n, size, contexts, context) == symbols).all()
    assert (lanes.code_numbers(port, None, n) == numbers).all()
    port.finish()


def test_recent_distances():
    given = np.array([5, 5, 9, 5, 9, 1, 2, 3, 4, 6, 7, 8, 5, 9, 9])
    places, new = lz.to_places(given)
    assert places.tolist()[:5] == [8, 0, 8, 1, 1] and lz.from_places(places, new).tolist() == given.tolist()


@pytest.mark.parametrize("couple", range(4))
@pytest.mark.parametrize("mean", ["none", "neighbours", "lags", ((1, 1),), ((1, 1), (16, 1))], ids=str)
@pytest.mark.parametrize("data", EDGES, ids=len)
def test_round_trip(data, mean, couple):
    payload = lz.encode(data, matches.parsed(data), lz.PackOptions(couple, (mean,)))
    assert lz.decode(payload, len(data)) == data


@pytest.mark.parametrize("context", list(lz.LITERAL_CONTEXTS))
def test_contexts_of_literals(context):
    data = EDGES[-1]
    assert lz.decode(lz.encode(data, matches.parsed(data), lz.PackOptions(contexts=(context,))), len(data)) == data


@pytest.mark.parametrize("data", EDGES, ids=len)
def test_packed_chunks(data):
    mode, payload = lz.pack(data)
    assert lz.unpack(mode, payload, len(data)) == data and len(payload) <= len(data)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"bc", b"abcd", b"\x00\xff", b"zzzz"]), max_size=200).map(b"".join))
def test_any_text(data):
    found = matches.parsed(data, lz.ParseOptions(literal=8.0, match=4.0, distance=0.5))
    assert lz.decode(lz.encode(data, found), len(data)) == data


def test_repetitive_text_gets_small():
    assert len(lz.pack(EDGES[-2])[1]) < len(EDGES[-2]) / 6


def test_overlapping_copy():
    out = bytearray(b"xab")
    lz.copy_match(out, 2, 5)
    assert out == b"xabababa"


@pytest.mark.parametrize("cut", [0, 1, 5, 14, 15, 40, -1, -2])
def test_truncated_payload(cut):
    data = EDGES[-2]
    with pytest.raises(lz.CorruptChunk):
        lz.decode(lz.encode(data, matches.parsed(data))[:cut], len(data))


def test_changed_payload():
    data, rng = EDGES[-2], random.Random(1)
    packed = lz.encode(data, matches.parsed(data))
    for _ in range(60):
        at = rng.randrange(len(packed))
        broken = packed[:at] + bytes([packed[at] ^ 1 << rng.randrange(8)]) + packed[at + 1 :]
        try:
            assert len(lz.decode(broken, len(data))) == len(data)
        except lz.CorruptChunk:
            pass


def test_wrong_size_and_mode():
    with pytest.raises(lz.CorruptChunk):
        lz.unpack(lz.RAW, b"abc", 4)
    with pytest.raises(lz.CorruptChunk):
        lz.unpack(9, b"abc", 3)


OPTIONS = [lz.ParseOptions(lattice=m) for m in (1, 3, 8)] + [lz.ParseOptions(predicted=p) for p in (0.5, "zones")]
OPTIONS += [lz.ParseOptions(depth=1), lz.ParseOptions(predicted=0.5, stride=4), lz.ParseOptions(second="nearest"), lz.ParseOptions(second="cheapest", lattice=8)]


@pytest.mark.parametrize("options", OPTIONS, ids=str)
def test_options_change_the_parse_only(options):
    data = EDGES[-2][:1500]
    assert lz.decode(lz.encode(data, matches.parsed(data, options)), len(data)) == data


def test_competing_codings():
    data = EDGES[-1]
    plain, both = lz.pack(data), lz.pack(data, compete_from=0.35)
    assert len(both[1]) <= len(plain[1]) and lz.unpack(*both, len(data)) == data


def test_lattice_of_arrays_and_columns(spark):
    from pyspark.sql import functions as F

    from bytequarry.functions import scalar

    rows = [(d, a, b) for d in (1, 15, 16, 30, 32, 33, 64, 100, 255, 256, 512, 600) for a in (0, 16, 33, 300, 512) for b in (0, 64, 512)]
    frame = spark.createDataFrame(rows, "d int, a int, b int")
    given = [np.array(x) for x in zip(*rows)]
    for mode in range(1, 10):
        found = [r.s for r in frame.withColumn("s", scalar.lattice_bonus(mode, F.col("d"), F.col("a"), F.col("b"))).collect()]
        assert np.allclose(found, scalar.lattice_bits(mode, *given)), mode


# --- many chunks -------------------------------------------------------------------------------------


def _many():
    rng = random.Random(9)
    words = [bytes(rng.choices(b"abcdefgh ", k=rng.randrange(2, 9))) for _ in range(300)]
    made = [b"".join(rng.choices(words[: rng.randrange(2, 300)], k=rng.randrange(1, 700)))[:4096] for _ in range(40)]
    rows = [bytes((i * 7 + j // 9) % 256 for j in range(28)) for i in range(120)]
    return [e[:16384] for e in EDGES] + made + [b"".join(rows), b"", rng.randbytes(4096), b"x" * 4096, EDGES[4]]


def test_chunks_together_are_packed_as_one_by_one():
    from bytequarry.functions import batches

    data = _many()
    want = [lz.pack(d) for d in data]
    assert batches.pack(data) == want and {m for m, _ in want} == {lz.RAW, lz.PACKED}
    sizes = [len(d) for d in data]
    assert batches.unpack([m for m, _ in want], [p for _, p in want], sizes) == data
    packed = [(p, d) for (m, p), d in zip(want, data) if m == lz.PACKED and len(d) <= batches.SHORT]
    # not by way of lz
    assert batches._decoded([p for p, _ in packed], np.array([len(d) for _, d in packed])) == [d for _, d in packed]
    penalties = [0.95 + 0.1 * (i % 3) for i in range(len(data))]
    from dataclasses import replace

    assert batches.pack(data, penalties=penalties) == [lz.pack(d, replace(lz.ParseOptions(), distance=p)) for d, p in zip(data, penalties)]
    assert batches.pack(data[:20], lz.ParseOptions(lattice=3)) == [lz.pack(d, lz.ParseOptions(lattice=3)) for d in data[:20]]


@pytest.mark.parametrize("context", list(lz.LITERAL_CONTEXTS))
def test_every_context_and_mean_is_read_together(context):
    from bytequarry.functions import batches

    data = [d for d in _many() if 0 < len(d) <= batches.SHORT]
    for mean in ("none", "neighbours", "lags", ((1, 1), (16, 1))):
        made = [lz.encode(d, matches.parsed(d), lz.PackOptions(means=(mean,), contexts=(context,))) for d in data]
        assert batches._decoded(made, np.array([len(d) for d in data])) == data


def test_a_corrupt_chunk_among_others_is_told():
    from bytequarry.functions import batches

    data = [d for d in _many() if 200 < len(d) <= 4096][:12]
    made = [lz.pack(d) for d in data]
    payloads = [p for _, p in made]
    i = next(i for i, (m, _) in enumerate(made) if m == lz.PACKED)
    payloads[i] = payloads[i][:-2]
    with pytest.raises(lz.CorruptChunk):
        batches.unpack([m for m, _ in made], payloads, [len(d) for d in data])


def test_hundreds_of_chunks_take_few_steps(monkeypatch):
    """Short chunks are not gone through one by one: calls of the coder do not follow their number."""
    from bytequarry.functions import batches

    calls = []
    refresh = batches._Models.refresh
    monkeypatch.setattr(batches._Models, "refresh", lambda self: (calls.append(1), refresh(self))[1])
    monkeypatch.setattr(lz, "pack", None)
    data = [d for d in _many() if 1000 < len(d) <= 4096]
    batches.pack(data)
    once = len(calls)
    batches.pack(data * 8)
    assert 0 < len(calls) - once <= 1.2 * once
