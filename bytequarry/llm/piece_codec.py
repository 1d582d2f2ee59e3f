"""Encoding into unigram pieces and decoding, with a max-plus parallel scan over giant documents.

A text of up to GIANT_CHARS characters is one chunk. A longer one is cut into chunks of CHUNK_CHARS characters, which
are dealt out over all tasks. A piece may reach over a chunk's end, so a boundary has one state for each number of
characters by which the piece that crosses it reaches into the next chunk (0: a piece ends at the boundary).

1. Every chunk yields its transfer matrix: the best score from each state at its start to each state at its end.
2. A document's matrices are combined by an associative scan in the max-plus semiring, which gives the scores of all
   states at every boundary.
3. With the scores at its start, every chunk tells which entry state its best path into each exit state has; these
   maps are composed from the document's end, which gives the state of every boundary.
4. Every chunk is traced back on its own between its two states, and the ids are joined in order.

The result is that of a forward pass over the whole text, ties included. Within a chunk, stretches between places
that no piece crosses are segmented once and kept in a bounded cache.

Step 2 and 3 gather one document's matrices (2 KB for each 16 KB of text) and step 4 its ids; a document is one row of
the input and of the result, so both are bounded by what a row may hold. No text is gathered.

Defined cases: a null or empty text has no ids and decodes to the empty string; rows that repeat are encoded alike; a
text that contains the mark U+2581 decodes with spaces in its place; of equal sums the one whose last piece starts first is
taken; texts of any length are encoded whole; an empty table gives an empty table; new columns get other names where the
table has them already. Texts are read twice, once for the lengths of the giants: sorting them out in one pass would mean
writing all ids to a table of about the input's size.
"""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytequarry.llm.common import append_columns, column_bytes, fresh_name, materialize
from bytequarry.llm.unigram import MARK, Vocabulary

GIANT_CHARS, CHUNK_CHARS = 1 << 16, 1 << 14
CACHE_TOKENS = 150_000
#: Words of up to so many characters, of the so many commonest characters, are segmented together.
DENSE_CHARS, DENSE_ALPHABET = 24, 110
GROUP = 2048  # words at a time: their tables stay in the processor's cache
_LOW = -np.inf


class DenseTrie:
    """The pieces made of the commonest characters, as a transition table: segments many short words at once.

    All words move together: from every place, the table is walked as long as some word's characters lead on, and each
    piece on the way improves its end. Words with other characters are left to the caller.
    """

    def __init__(self, vocabulary: Vocabulary, characters: int = DENSE_ALPHABET):
        alone = Counter(c for p in vocabulary.scores for c in p if c in vocabulary.scores)
        kept = {c: i + 1 for i, (c, _) in enumerate(alone.most_common(characters))}
        self.classes = np.zeros(max(map(ord, kept), default=0) + 2, np.uint8)
        for c, i in kept.items():
            self.classes[ord(c)] = i
        child: dict[tuple[int, int], int] = {}
        score, ids = [_LOW, _LOW], [0, 0]  # node 0 leads nowhere, node 1 is the root
        for piece, (value, number) in vocabulary.scores.items():
            if all(c in kept for c in piece):
                node = 1
                for c in piece:
                    node = child.setdefault((node, kept[c]), len(score))
                    if node == len(score):
                        score.append(_LOW), ids.append(0)
                score[node], ids[node] = value, number
        self.step = np.zeros((len(score), len(kept) + 1), np.int32)
        self.step[tuple(np.array(list(child), np.int64).reshape(-1, 2).T)] = list(child.values())
        self.score, self.ids = np.array(score), np.array(ids, np.int32)

    def segment(self, words: list[str]) -> dict[str, bytes | None]:
        """Ids of each word as int32 bytes; None for a word with other characters."""
        words = sorted(words, key=len)
        made = [x for i in range(0, len(words), GROUP) for x in self._segment_group(words[i : i + GROUP])]
        return dict(zip(words, made))

    def _segment_group(self, words: list[str]) -> list[bytes | None]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        sizes, most = lengths[order], int(lengths.max())
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = self.classes[np.minimum(codes, len(self.classes) - 1)]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        at = np.arange(most)
        table = np.where(at < sizes[:, None], kinds[np.minimum(starts[:, None] + at, len(kinds) - 1)], 0)
        best, back, ids = np.full((len(words), most + 1), _LOW), np.zeros((len(words), most + 1), np.int8), np.zeros((len(words), most + 1), np.int32)
        best[:, 0] = 0.0
        for start in range(most):
            rows = np.arange(np.searchsorted(-sizes, -start))  # longer words come first
            state = np.ones(len(rows), np.int32)
            for end in range(start + 1, most + 1):
                state = self.step[state, table[rows, end - 1]]
                rows, state = rows[state > 0], state[state > 0]
                if not len(rows):
                    break
                total = best[rows, start] + self.score[state]
                better = total > best[rows, end]
                won = rows[better]
                best[won, end], back[won, end], ids[won, end] = total[better], start, self.ids[state[better]]
        out: list[bytes | None] = [None] * len(words)
        found, count, place, row = np.zeros((len(words), most), np.int32), np.zeros(len(words), np.int64), sizes.copy(), np.arange(len(words))
        row = row[best[row, place] > _LOW]
        whole = row
        while len(row):  # from the last piece to the first, written from the right
            count[row] += 1
            found[row, most - count[row]] = ids[row, place[row]]
            place[row] = back[row, place[row]]
            row = row[place[row] > 0]
        for r in whole.tolist():
            out[order[r]] = found[r, most - count[r] :].tobytes()
        return out


class Segmenter:
    """Best paths over stretches of prepared text."""

    def __init__(self, vocabulary: Vocabulary, cache_tokens: int = CACHE_TOKENS):
        self.vocabulary, self.cache_tokens = vocabulary, cache_tokens
        self.states, self.prefixes = vocabulary.longest, vocabulary.prefixes
        self.dense = DenseTrie(vocabulary)
        self.cache: dict[str, bytes] = {}
        self.stretch_scores: dict[str, float] = {}

    def edges(self, text: str, at: int) -> list[tuple[int, float, object]]:
        """(end, score, id or the unknown character) of what can start at `at`, shortest first."""
        prefixes, out, end = self.prefixes, [], at + 1
        found = prefixes.get(text[at:end], False)
        if not found:
            out.append((end, self.vocabulary.unknown_score, text[at]))
        while found is not False and end <= len(text):
            if found:
                out.append((end, *found))
            end += 1
            found = prefixes.get(text[at:end], False)
        return out

    def forward(self, text: str, starts: int, entry: np.ndarray) -> tuple[list[float], list]:
        """Scores and back pointers (start, id) of all places; pieces start before `starts`."""
        best, back = [_LOW] * (len(text) + 1), [None] * (len(text) + 1)
        best[: min(len(entry), len(best))] = entry[: len(best)].tolist()
        prefixes, n, unknown = self.prefixes.get, len(text), self.vocabulary.unknown_score
        for at in range(starts):
            here = best[at]
            if here == _LOW:
                continue
            end = at + 1
            found = prefixes(text[at:end], False)
            if not found and here + unknown > best[end]:  # the character is no piece
                best[end], back[end] = here + unknown, (at, text[at])
            while found is not False:
                if found and here + found[0] > best[end]:
                    best[end], back[end] = here + found[0], (at, found[1])
                end += 1
                if end > n:
                    break
                found = prefixes(text[at:end], False)
        return best, back

    def trace(self, back: list, at: int) -> tuple[list[int], int]:
        """Ids on the path that ends at `at`, and where the path begins."""
        parts = []
        while back[at] is not None:
            at, what = back[at]
            parts.append([what] if isinstance(what, int) else self.vocabulary.unknown_tokens(what))
        return [i for p in reversed(parts) for i in p], at

    def score(self, token: str) -> float:
        """Score of a stretch between two forced cuts."""
        if token not in self.stretch_scores:
            if len(self.stretch_scores) >= self.cache_tokens:
                self.stretch_scores.clear()
            self.stretch_scores[token] = self.forward(token, len(token), np.zeros(1))[0][-1]
        return self.stretch_scores[token]

    def cached(self, token: str) -> bytes:
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) >= self.cache_tokens:
                self.cache.clear()
            found = self.cache[token] = self._segment(token)
        return found

    def _segment(self, token: str) -> bytes:
        """forward() and trace() for the common case: one entry, all of the text. The ids as int32 bytes."""
        n, prefixes, unknown = len(token), self.prefixes.get, self.vocabulary.unknown_score
        best, start = [_LOW] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            here, end = best[at], at + 1
            found = prefixes(token[at:end], False)
            if not found and here + unknown > best[end]:
                best[end], start[end] = here + unknown, at
            while found is not False:
                if found and here + found[0] > best[end]:
                    best[end], start[end] = here + found[0], at
                end += 1
                if end > n:
                    break
                found = prefixes(token[at:end], False)
        ids, end, known = [], n, self.vocabulary.scores.get
        while end:
            at = start[end]
            found = known(token[at:end])
            if found:
                ids.append(found[1])
            else:
                ids += reversed(self.vocabulary.unknown_tokens(token[at]))
            end = at
        ids.reverse()
        return array("i", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        cut, cache = self.vocabulary.pre_tokens.findall, self.cache
        if len(cache) >= self.cache_tokens:
            cache.clear()
        tokens = [cut(t) for t in texts]
        found = [list(map(cache.get, ts)) for ts in tokens]
        missing = [[j for j, ids in enumerate(row) if ids is None] for row in found]
        new = {ts[j] for ts, at in zip(tokens, missing) for j in at}
        cache.update(self.dense.segment([x for x in new if len(x) <= DENSE_CHARS]))
        for token in new:
            if cache.get(token) is None:
                cache[token] = self._segment(token)
        for ts, row, at in zip(tokens, found, missing):
            for j in at:
                row[j] = cache[ts[j]]
        return [np.frombuffer(b"".join(row), np.int32) for row in found]

    def forget(self) -> None:
        """Frees the caches; the vocabulary's tables stay."""
        self.cache, self.stretch_scores = {}, {}

    # --- chunks: `text` is the chunk and up to states - 1 characters after it, `size` the chunk's length

    def cuts(self, text: str, size: int) -> list[int]:
        """Places after the chunk's start, up to its end, that no piece crosses."""
        return [m.end() for m in self.vocabulary.pre_tokens.finditer(text) if m.end() <= size]

    def tail(self, text: str, size: int, cut: int) -> tuple[np.ndarray, list]:
        """Scores of the exit states from the last cut on, and the back pointers."""
        best, back = self.forward(text[cut:], size - cut, np.zeros(1))
        exits = np.full(self.states, _LOW)
        reach = best[size - cut :][: self.states]
        exits[: len(reach)] = reach
        return exits, back

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Best score from each entry state to each exit state."""
        n, cuts = self.states, self.cuts(text, size)
        end = cuts[0] if cuts else size
        scores = np.full((size + 2 * n, n), _LOW)
        scores[np.arange(min(n, end + 1)), np.arange(min(n, end + 1))] = 0.0
        head = text[:end] if cuts else text
        for at in range(end):
            row = scores[at]
            if row.max() > _LOW:
                for to, score, _ in self.edges(head, at):
                    np.maximum(scores[to], row + score, out=scores[to])
        if not cuts:
            return scores[size : size + n].T.copy()
        between = sum(self.score(text[a:b]) for a, b in zip(cuts, cuts[1:]))
        return scores[end][:, None] + between + self.tail(text, size, cuts[-1])[0][None, :]

    def entry_states(self, text: str, size: int, entry: np.ndarray) -> np.ndarray:
        """The entry state of the best path into each exit state; -1 where there is none."""
        cuts, out = self.cuts(text, size), np.full(self.states, -1, np.int64)
        if cuts:
            _, back = self.forward(text[: cuts[0]], cuts[0], entry)
            out[self.tail(text, size, cuts[-1])[0] > _LOW] = self.trace(back, cuts[0])[1]
            return out
        best, back = self.forward(text, size, entry)
        for x in range(min(self.states, len(text) - size + 1)):
            if best[size + x] > _LOW:
                out[x] = self.trace(back, size + x)[1]
        return out

    def encode_chunk(self, text: str, size: int, entry: np.ndarray, exit_state: int) -> np.ndarray:
        cuts = self.cuts(text, size)
        if not cuts:
            return np.array(self.trace(self.forward(text, size, entry)[1], size + exit_state)[0], np.int32)
        ids = self.trace(self.forward(text[: cuts[0]], cuts[0], entry)[1], cuts[0])[0]
        for a, b in zip(cuts, cuts[1:]):
            ids += np.frombuffer(self.cached(text[a:b]), np.int32).tolist()
        ids += self.trace(self.tail(text, size, cuts[-1])[1], size - cuts[-1] + exit_state)[0]
        return np.array(ids, np.int32)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices."""
    return (a[:, :, :, None] + b[:, None, :, :]).max(axis=2)


def scan(matrices: np.ndarray) -> np.ndarray:
    """Inclusive scan of a stack of matrices: products of pairs, scanned, then spread to the odd places."""
    if len(matrices) < 2:
        return matrices
    pairs = scan(combine(matrices[:-1:2], matrices[1::2]))
    out = np.empty_like(matrices)
    out[0], out[1::2] = matrices[0], pairs[: len(matrices) // 2]
    rest = matrices[2::2]
    out[2::2] = combine(pairs[: len(rest)], rest)
    return out


def chunks_of(prepared: str, chunk_chars: int, states: int) -> list[tuple[int, str]]:
    """(size, text with what follows) of each chunk; every chunk has at least `states` characters."""
    n = len(prepared)
    starts = list(range(0, max(1, n - states + 1), chunk_chars))
    return [(b - a, prepared[a : b + states - 1]) for a, b in zip(starts, [*starts[1:], n])]


_segmenters: dict[str, Segmenter] = {}


def held_segmenter(sent) -> Segmenter:
    vocabulary = sent.value
    if vocabulary.key not in _segmenters:
        _segmenters.clear()
        _segmenters[vocabulary.key] = Segmenter(vocabulary)
    return _segmenters[vocabulary.key]


def _batch(schema: T.StructType, columns: list[list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, schema.fields)], names=schema.names
    )


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    text_col: str = "text",
    giant_chars: int = GIANT_CHARS,
    chunk_chars: int = CHUNK_CHARS,
    check: str | None = None,
) -> tuple[DataFrame, str]:
    """docs with the ids of every text, in place of the text; also the name of the ids' column (array<int>).

    With `check`, a column of that name tells whether decoding a row's ids gives its text back. Texts that are one
    chunk are decoded where they were encoded: a second pass would hold the vocabulary in twice as many workers.
    """
    chunk_chars = max(chunk_chars, vocabulary.longest)
    sent, name = docs.sparkSession.sparkContext.broadcast(vocabulary), fresh_name(docs, "ids")
    checked = check is not None
    giant = F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)) > giant_chars

    def make():
        own, back = held_segmenter(sent), held_decoder(sent) if checked else None

        def work(texts):
            found = own.encode_many([Vocabulary.prepare(t.decode("utf-8", "replace")) if t else "" for t in texts])
            made = [pa.array(found, pa.list_(pa.int32()))]
            if checked:
                made.append(pa.array([back.decode(ids.tolist()) == (t or b"") for ids, t in zip(found, texts)], pa.bool_()))
            return made

        return work

    fields = [(name, T.ArrayType(T.IntegerType()))] + ([(check, T.BooleanType())] if checked else [])
    small = append_columns(docs.where(~giant), text_col, fields, make, lambda: held_segmenter(sent).forget())
    large = docs.where(giant)
    if checked:
        digest = fresh_name(docs, "piece_digest")
        large = encode_giants(large.withColumn(digest, F.sha2(F.col(f"`{text_col}`"), 256)), sent, text_col, name, chunk_chars)
        large, text = decode(large, vocabulary, name)
        large = large.withColumn(check, F.sha2(text, 256) == F.col(digest))
    else:
        large = encode_giants(large, sent, text_col, name, chunk_chars)
    columns = [F.col(f"`{c}`") for c in [*(c for c in docs.columns if c != text_col), *(n for n, _ in fields)]]
    return small.select(columns).unionByName(large.select(columns)), name


def encode_giants(docs: DataFrame, sent, text_col: str, name: str, chunk_chars: int) -> DataFrame:
    """The scan over chunks, for all rows of docs."""
    row = fresh_name(docs, "piece_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    schema = _schema("number long, k int, size int, chunk string")
    at = docs.columns.index(text_col)
    carried = T.StructType([f for f in numbered.schema.fields if f.name != text_col] + schema.fields[1:])
    names = {f.name: fresh_name(numbered, f.name) for f in schema.fields[1:]}
    carried = T.StructType(carried.fields[:-3] + [T.StructField(names[f.name], f.dataType) for f in schema.fields[1:]])

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                text = column_bytes(one.column(at))[0]
                parts = chunks_of(Vocabulary.prepare(text.decode("utf-8", "replace") if text else ""), chunk_chars, sent.value.longest)
                for start in range(0, len(parts), 64):
                    some = parts[start : start + 64]
                    same = one.take(pa.array([0] * len(some)))
                    yield pa.RecordBatch.from_arrays(
                        [c for j, c in enumerate(same.columns) if j != at]
                        + [
                            pa.array(range(start, start + len(some)), pa.int32()),
                            pa.array([s for s, _ in some], pa.int32()),
                            pa.array([t for _, t in some], pa.string()),
                        ],
                        names=carried.names,
                    )

    cols = [row, *names.values()]
    chunks = materialize(numbered.mapInArrow(cut, carried).repartition(row, names["k"]), "piece-chunks")
    plain = chunks.select(*[F.col(c).alias(a) for c, a in zip(cols, schema.names)])

    matrix_schema = _schema("number long, k int, matrix binary")

    def matrices(batches):
        own = held_segmenter(sent)
        for batch in batches:
            number, k, size, text = (c.to_pylist() for c in batch.columns)
            yield _batch(matrix_schema, [number, k, [own.matrix(t, s).tobytes() for s, t in zip(size, text)]])

    def boundary_scores(rows):
        import pandas as pd  # only here and below: the other workers stay smaller without it

        rows = rows.sort_values("k")
        n = int(round((len(rows["matrix"].iloc[0]) // 8) ** 0.5))
        stack = np.array([np.frombuffer(m).reshape(n, n) for m in rows["matrix"]])
        first = np.full((1, n), _LOW)
        first[0, 0] = 0.0  # the text starts with a piece
        entries = np.concatenate([first, scan(stack)[:-1, 0, :]])
        return pd.DataFrame({"number": rows["number"], "k": rows["k"], "entry": [e.tobytes() for e in entries]})

    scores = plain.mapInArrow(matrices, matrix_schema).groupBy("number").applyInPandas(boundary_scores, "number long, k int, entry binary")
    scores = materialize(scores, "piece-scores")
    scored = plain.join(scores, ["number", "k"])

    map_schema = _schema("number long, k int, states binary")

    def maps(batches):
        own = held_segmenter(sent)
        for batch in batches:
            number, k, size, text, entry = (c.to_pylist() for c in batch.columns)
            yield _batch(map_schema, [number, k, [own.entry_states(t, s, np.frombuffer(e)).tobytes() for s, t, e in zip(size, text, entry)]])

    def exit_states(rows):
        import pandas as pd

        rows = rows.sort_values("k", ascending=False)
        state, out = 0, []
        for m in rows["states"]:
            out.append(state)
            state = int(np.frombuffer(m, np.int64)[state])
        return pd.DataFrame({"number": rows["number"], "k": rows["k"], "leaves": np.array(out, np.int32)})

    wanted = ["number", "k", "size", "chunk", "entry"]
    leaving = scored.select(*wanted).mapInArrow(maps, map_schema).groupBy("number").applyInPandas(exit_states, "number long, k int, leaves int")
    id_schema = _schema("number long, k int, part array<int>")

    def traced(batches):
        own = held_segmenter(sent)
        for batch in batches:
            number, k, size, text, entry, leaves = (c.to_pylist() for c in batch.columns)
            yield _batch(id_schema, [number, k, [own.encode_chunk(t, s, np.frombuffer(e), x) for s, t, e, x in zip(size, text, entry, leaves)]])

    parts = scored.join(materialize(leaving, "piece-states"), ["number", "k"]).select(*wanted, "leaves").mapInArrow(traced, id_schema)
    joined = parts.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("parts"))
    ids = joined.select(F.col("number").alias(row), F.flatten(F.col("parts.part")).alias(name))
    heads = chunks.where(F.col(names["k"]) == 0).drop(*names.values())
    return heads.join(ids, row).drop(row)


# --- decoding ----------------------------------------------------------------------------------------


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.raw = [p.encode("utf-8").replace(MARK.encode(), b" ") for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids):
            self.raw[i] = bytes([b])
        self.raw[vocabulary.unknown_id] = " \u2047 ".encode()

    def decode(self, ids: list[int]) -> bytes:
        out = b"".join(map(self.raw.__getitem__, ids))
        return out[1:] if out[:1] == b" " else out


_decoders: dict[str, Decoder] = {}


def held_decoder(sent) -> Decoder:
    vocabulary = sent.value
    if vocabulary.key not in _decoders:
        _decoders.clear()
        _decoders[vocabulary.key] = Decoder(vocabulary)
    return _decoders[vocabulary.key]


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> tuple[DataFrame, str]:
    """encoded with the text of its ids, and the name of the text's column. Bytes that are no UTF-8 become U+FFFD."""
    name, sent = fresh_name(encoded, "decoded"), encoded.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())])
    at = encoded.columns.index(ids_col)

    def run(batches):
        own = held_decoder(sent)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = []
                for ids in part.column(at):
                    found = own.decode(ids.values.to_numpy().tolist()) if ids.is_valid else b""
                    texts.append(found.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema), name
