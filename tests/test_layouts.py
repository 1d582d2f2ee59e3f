import random
import struct

import pytest

from bytequarry.functions import lz
from bytequarry.sources import layouts
from bytequarry.sources.archive import CorruptArchive

random.seed(2)
FILES = [("a", [b"hello " * 20, b"x"]), ("sub/empty", []), ("b.bin", [random.randbytes(50)])]
DATA = layouts.write_plain(FILES)


def kernel(data):
    mode, payload = lz.pack(data)
    return payload if mode == lz.PACKED else None


def test_plain_archive_comes_back():
    want = [("a", 0, FILES[0][1][0]), ("a", 1, b"x"), ("b.bin", 0, FILES[2][1][0])]
    assert list(layouts.read_plain(DATA)) == want
    assert list(layouts.read_plain(layouts.write_plain(FILES, kernel), lz.decode)) == want
    assert DATA[:24] == b"AUR2" + struct.pack("<IIQI", 4, 3, 171, 3)


def test_routed_archive_comes_back():
    chunks = [(m, random.randbytes(3000 + m)) for m in range(6)] + [(2, b"")]
    assert list(layouts.read_routed(layouts.write_routed(chunks))) == [(i, m, d) for i, (m, d) in enumerate(chunks)]


@pytest.mark.parametrize(
    "data",
    [b"", DATA[:10], DATA[:-1], DATA + b"x", b"AUR3" + DATA[4:], DATA[:4] + struct.pack("<I", 5) + DATA[8:], DATA[:4] + struct.pack("<I", 1) + DATA[8:], DATA.replace(b"sub/empty", b"../../etc"),
     DATA[:12] + struct.pack("<Q", 7) + DATA[20:], layouts.write_plain(FILES, kernel), layouts.write_routed([(0, b"abc")])],
    ids=range(11),
)
def test_broken_archives_are_refused(data):
    with pytest.raises(CorruptArchive):
        list(layouts.read_plain(data))


def test_broken_routed_archives_are_refused():
    data = layouts.write_routed([(1, b"abcdefgh")])
    for broken in (data[:-1], data + b"y", DATA, data[:16] + b"\x09" + data[17:]):
        with pytest.raises(CorruptArchive):
            list(layouts.read_routed(broken))


def test_files_of_either_layout(spark, tmp_path):
    (tmp_path / "one.aur").write_bytes(DATA)
    (tmp_path / "two.k44").write_bytes(layouts.write_routed([(1, b"abcdefgh"), (0, b"z")]))
    rows = {(r.archive, r.rel, r.chunk): (r.mode, bytes(r.raw)) for r in layouts.read(spark, str(tmp_path)).collect()}
    assert rows["two.k44", "two.k44", 0] == (1, b"abcdefgh") and rows["one.aur", "a", 1] == (0, b"x") and len(rows) == 5
