import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytequarry.functions import profile, transforms as t

NAMES = sorted({n for c in t.CATALOGUES.values() for n in c} | {"D3", "X5", "DD2", "T7", "WD2", "WX8", "RES", "D1T16", "X4BIT", "T4NIB", "D4T4BIT"})
EDGES = [b"", b"a", b"abc", b"abcd", b"abcde", bytes(256), bytes(range(256)), b"ab" * 99, np.random.default_rng(1).bytes(1031), "héß日本".encode() * 30]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("data", EDGES, ids=len)
def test_undo_gives_the_input(name, data):
    assert t.undo(t.apply(data, name), name, len(data)) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 40), st.sampled_from(["D", "X", "DD", "T"]))
def test_any_lag(data, n, kind):
    assert t.undo(t.apply(data, f"{kind}{n}"), f"{kind}{n}", len(data)) == data


def test_small_cases():
    assert t.delta(bytes([1, 2, 5, 4]), 2) == bytes([1, 2, 4, 2])
    assert t.transpose(b"abcdefg", 3) == b"adbecfg"
    assert t.word_delta(bytes([255, 0, 0, 1, 9]), 2) == bytes([255, 0, 1, 0, 9])
    assert t.bitplanes(bytes([1, 3])) == bytes([3, 2, 0, 0, 0, 0, 0, 0])
    assert t.nibbles(bytes([0x12, 0x34, 0x56])) == bytes([0x31, 0x05, 0x42, 0x06])
    assert t.residuals(bytes([10, 10, 13])) == bytes([10, 0, 3])


@pytest.mark.parametrize("name", ["Q4", "D0", "T", "D4x", "4D"])
def test_unknown_names(name):
    with pytest.raises(ValueError):
        t.apply(b"abc", name)


def test_word_width():
    with pytest.raises(ValueError):
        t.word_xor(b"abc", 3)


def test_measures_of_edges():
    assert profile.entropy(b"") == 0.0 and profile.entropy(b"aaaa") == 0.0
    assert profile.entropy(bytes(range(256))) == pytest.approx(8.0)
    assert profile.match_rate(b"abab", 4) == 0.0 and profile.match_rate(b"abab", 2) == 1.0
    assert profile.printable_share(b"") == 0.0 and profile.printable_share(b"a\n\x00\xff") == 0.5
    assert profile.repeat_rate(b"abc") == (0, 0)
    assert profile.repeat_rate(b"abcd" * 64) == (3, 4)
    assert profile.top_lags(b"", [1, 2, 8]) == [(0.0, 8), (0.0, 2), (0.0, 1)]


def test_slot_remembers_only_its_last_gram():
    data = np.random.default_rng(3).integers(0, 3, 20000, np.uint8).tobytes()
    keys, repeats, samples = {}, 0, 0
    for p in range(0, len(data) - 3, 64):
        v = int.from_bytes(data[p : p + 4], "little")
        h = (v * 2654435761 & 0xFFFFFFFF) >> 20
        repeats += keys.get(h) == v
        keys[h] = v
        samples += 1
    assert profile.repeat_rate(data) == (repeats, samples)


def test_registered_transforms():
    t.register("FLIP", lambda d: d[::-1], lambda d, n: d[::-1])
    assert t.apply(b"abcd", "D1FLIP") == t.delta(b"abcd", 1)[::-1]
    assert t.undo(t.apply(b"abcd", "FLIPD1"), "FLIPD1", 4) == b"abcd"
    for name in ("BIT", "no", "X"):
        with pytest.raises(ValueError):
            t.register(name, bytes, lambda d, n: d)
