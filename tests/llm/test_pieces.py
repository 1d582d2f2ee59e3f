"""Unigram pieces: counts, encoding in one piece and in chunks, decoding."""

import random

import numpy as np
import pytest

from bytequarry.llm import piece_codec, unigram

TEXTS = [
    None, "", "a", " ", " x", "x ", "  Hello  world\n\tx\r\n", "日本語 テキスト　ﬁ é́", "aaaa" * 30, "a  b   c", "\n\n", "<s> </s> <0x0A> <unk>", "😀😀 z\x00", "the quick brown fox. " * 9,
    "word" * 40 + " " + "é" * 30, "0123456789abcdef" * 5, "ſtrange Ꙁ mix",
]


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.Vocabulary.load()


def best_path(vocabulary, text):
    """Plain dynamic programming over all pieces, ties to the first start."""
    n, scores = len(text), vocabulary.scores
    best, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - vocabulary.longest), end):
            piece = text[start:end]
            if piece in scores:
                score, ids = scores[piece][0], [scores[piece][1]]
            elif end == start + 1:
                score, ids = vocabulary.unknown_score, [vocabulary.byte_ids[b] for b in piece.encode()]
            else:
                continue
            if best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, (start, ids)
    out = []
    while n:
        n, ids = back[n]
        out = ids + out
    return out


def test_encoding_and_counts_are_the_best_path(vocabulary):
    own, trie = piece_codec.Segmenter(vocabulary), unigram.TokenTrie(vocabulary, max_nodes=60)
    prepared = [vocabulary.prepare(t or "") for t in TEXTS]
    want = [best_path(vocabulary, t) for t in prepared]
    assert [x.tolist() for x in own.encode_many(prepared)] == want
    assert [own.encode(t).tolist() for t in reversed(prepared)] == want[::-1]
    assert [n for n, _ in trie.total(prepared)] == list(map(len, want))
    assert [n for t in prepared for n, _ in trie.total([t])] == list(map(len, want))


def test_score_is_that_of_the_library(vocabulary):
    """The library's best of several segmentations, in lines whose sums its 32-bit floats hold exactly."""
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import duckdb
    import sentencepiece

    proto = pb2.ModelProto()
    with open(unigram.DEFAULT_VOCABULARY, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    own = piece_codec.Segmenter(vocabulary)
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()
    lines = [" ".join(x.split())[:50].strip() for (t,) in rows for x in (t or "").split("\n")]
    seen = 0
    for line in filter(None, lines):
        ours = own.encode(vocabulary.prepare(line)).tolist()
        if min(library.get_score(i) for i in ours) > -1e6:
            theirs = library.nbest_encode_as_ids(line, 4)[0]
            assert sum(map(library.get_score, ours)) >= sum(map(library.get_score, theirs))
            seen += sum(map(library.get_score, ours)) == sum(map(library.get_score, theirs))
    assert seen > 100


def chunked(own, text, size):
    parts = piece_codec.chunks_of(text, size, own.states)
    assert "".join(t[:n] for n, t in parts) == text
    stack = np.array([own.matrix(t, n) for n, t in parts])
    first = np.full((1, own.states), -np.inf)
    first[0, 0] = 0.0
    entries = np.concatenate([first, piece_codec.scan(stack)[:-1, 0, :]])
    state, leaves = 0, []
    for (n, t), e in reversed(list(zip(parts, entries))):
        leaves.append(state)
        state = int(own.entry_states(t, n, e)[state])
    assert state == 0
    return [i for (n, t), e, x in zip(parts, entries, reversed(leaves)) for i in own.encode_chunk(t, n, e, x).tolist()]


@pytest.mark.parametrize("size", [16, 17, 40, 500])
def test_chunks_give_the_whole_texts_path(vocabulary, size):
    rng, own = random.Random(size), piece_codec.Segmenter(vocabulary)
    made = ["".join(rng.choice(a) for _ in range(rng.randint(1, 700))) for a in ("abetion ", "abetion", "aé日 ▁ \n", "  a", "日") for _ in range(4)]
    for text in [vocabulary.prepare(t) for t in [*TEXTS, *made] if t]:
        assert chunked(own, text, size) == best_path(vocabulary, text)


def test_scan_is_the_running_product():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 8, 13):
        stack = rng.integers(-50, 0, (n, 3, 3)).astype(float)
        want = [stack[0]]
        for m in stack[1:]:
            want.append((want[-1][:, :, None] + m[None]).max(axis=1))
        assert np.array_equal(piece_codec.scan(stack), np.array(want))


@pytest.fixture(scope="module")
def docs(spark):
    long = ["lorem ipsum dolor " * 40, "x" * 900, "日本" * 300, "a b\n" * 200]
    rows = [(i, t, "n", 1) for i, t in enumerate([*TEXTS, *long])] + [(2, TEXTS[2], "n", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


@pytest.mark.parametrize("giant", [1 << 16, 100, 0])
def test_tables(spark, docs, vocabulary, giant):
    out, ids = piece_codec.encode(docs, vocabulary, giant_chars=giant, chunk_chars=32, check="back")
    assert ids == "ids_" and "text" not in out.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert list(r.ids_) == best_path(vocabulary, vocabulary.prepare(texts[r.doc_id] or "")) and r.back
    decoded, text = piece_codec.decode(out, vocabulary, ids)
    assert {r.doc_id: r[text] for r in decoded.collect()} == {i: t or "" for i, t in texts.items()}
    assert piece_codec.encode(docs.limit(0), vocabulary, giant_chars=giant)[0].count() == 0


def test_token_counts_of_tables(spark, docs, vocabulary):
    out, names = unigram.count_tokens(docs, vocabulary, max_nodes=500)
    assert names["n_tokens"] == "n_tokens_"
    for r in out.collect():
        assert r.n_tokens_ == len(best_path(vocabulary, vocabulary.prepare(r.text or "")))
    assert unigram.count_tokens(docs.limit(0), vocabulary)[0].count() == 0


def test_mark_in_a_text_reads_as_a_space(spark, vocabulary):
    docs = spark.createDataFrame([(1, "a▁b")], "doc_id long, text string")
    out, ids = piece_codec.encode(docs, vocabulary, check="back")
    assert not out.first().back
    assert piece_codec.decode(out, vocabulary, ids)[0].first().decoded == "a b"


def test_vocabulary_without_bytes():
    own = unigram.Vocabulary(["<unk>", "▁a", "b"], {"▁a": (-1.0, 1), "b": (-2.0, 2)}, [], 0)
    assert piece_codec.Segmenter(own).encode(own.prepare("abz")).tolist() == [1, 2, 0]
    assert unigram.TokenTrie(own).total([own.prepare("abz")]) == [(3, 1)]
    crossing = unigram.Vocabulary(["<unk>", "a▁b", "a", "b", "▁"], {"a▁b": (-1.0, 1), "a": (-2.0, 2), "b": (-2.0, 3), "▁": (-3.0, 4)}, [], 0)
    assert piece_codec.Segmenter(crossing).encode(crossing.prepare("a b")).tolist() == [4, 1]
