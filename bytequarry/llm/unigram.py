"""Unigram pieces: vocabulary, cuts that no piece crosses, and trie-shared token counts.

A text is prepared as its vocabulary expects: a mark for every space and one in front. Its segmentation is the
sequence of pieces with the largest sum of scores; a character that is no piece costs less than any piece and
becomes its UTF-8 bytes. Of equal sums the one whose last piece starts first is taken, and so on backwards.

Token counts: a text's pre-tokens are its words with the spaces in front of them; no piece crosses their borders.
Distinct pre-tokens enter a trie whose nodes hold the forward score of their prefix and the number of tokens on the
way to it, so each prefix is computed once however many pre-tokens share it; a pre-token's count stands at its last
node. The trie lives as long as the worker process and starts anew beyond MAX_NODES, so its memory has a bound.

Defined cases: a null or empty text has no tokens; the mark itself in a text is read as a space; texts of any length
are counted whole; rows that repeat are counted alike; an empty table gives an empty table; new columns get other names
where the table has them already.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bytequarry.llm.common import append_columns, fresh_name

DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
MAX_NODES = 800_000
_NO_SCORE = float("-inf")


@dataclass
class Vocabulary:
    """Pieces with ids and scores. It is sent to the executors, which need no file."""

    pieces: list[str]
    scores: dict[str, tuple[float, int]]  # of pieces that can be matched: score, id
    byte_ids: list[int]  # by byte; empty without byte fallback
    unknown_id: int
    key: str = ""
    longest: int = field(init=False)
    unknown_score: float = field(init=False)

    def __post_init__(self):
        self.longest = max(map(len, self.scores), default=1)
        self.unknown_score = min((s for s, _ in self.scores.values()), default=0.0) - UNKNOWN_PENALTY

    @classmethod
    def load(cls, path: str = DEFAULT_VOCABULARY) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        by_byte = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        return cls(
            pieces,
            {pieces[i]: (sp.get_score(i), i) for i in plain},
            [by_byte[b] for b in range(256)] if len(by_byte) == 256 else [],
            sp.unk_id(),
            key=path,
        )

    @cached_property
    def suffixes(self) -> dict[str, float | None]:
        """Every suffix of a piece, with its score if it is a piece: a search backwards ends where none is left."""
        out: dict[str, float | None] = {p[i:]: None for p in self.scores for i in range(1, len(p))}
        out.update((p, s) for p, (s, _) in self.scores.items())
        return out

    @cached_property
    def prefixes(self) -> dict[str, tuple[float, int] | None]:
        """Every prefix of a piece, with its score and id if it is a piece."""
        out: dict[str, tuple[float, int] | None] = {p[:i]: None for p in self.scores for i in range(1, len(p))}
        out.update(self.scores)
        return out

    @cached_property
    def pre_tokens(self) -> re.Pattern:
        """Matches the stretches between forced cuts: places that no piece crosses."""
        crossing = any(a != MARK and b == MARK for p in self.scores for a, b in zip(p, p[1:]))
        used = set("".join(self.scores))
        alone = "".join(c for c in "\t\n\r" if c not in used)  # always tokens of their own
        if crossing:
            return re.compile(f"[{alone}]|[^{alone}]+" if alone else "(?s:.+)")
        return re.compile(f"[{alone}]|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    @staticmethod
    def prepare(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def unknown_tokens(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown_id]


class TokenTrie:
    """Forward scores and token counts of prefixes."""

    def __init__(self, vocabulary: Vocabulary, max_nodes: int = MAX_NODES):
        self.vocabulary, self.max_nodes = vocabulary, max_nodes
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}  # pre-token: token count at its last node

    def insert(self, token: str) -> int:
        child, best, count = self.child, self.best, self.count
        scores, suffixes = self.vocabulary.scores, self.vocabulary.suffixes
        path = [0]
        for at, char in enumerate(token, 1):
            node = child.get((path[-1], char))
            if node is None:
                top, tokens = _NO_SCORE, 0
                start = at - 1
                while start >= 0:
                    score = suffixes.get(token[start:at], _NO_SCORE)
                    if score == _NO_SCORE:  # no piece ends like this
                        break
                    if score is not None and (total := best[path[start]] + score) >= top:  # the first start wins
                        top, tokens = total, count[path[start]] + 1
                    start -= 1
                if char not in scores:
                    before = path[-1]
                    if (total := best[before] + self.vocabulary.unknown_score) > top:
                        top, tokens = total, count[before] + len(self.vocabulary.unknown_tokens(char))
                node = child[(path[-1], char)] = len(best)
                best.append(top), count.append(tokens)
            path.append(node)
        self.terminal[token] = count[path[-1]]
        return count[path[-1]]

    def total(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        if len(self.best) > self.max_nodes:
            self.clear()
        split = self.vocabulary.pre_tokens.findall
        out = []
        for text in texts:
            tokens, parts = 0, split(text)
            known = self.terminal
            try:
                tokens = sum(map(known.__getitem__, parts))
            except KeyError:
                for token in set(parts).difference(known):
                    self.insert(token)
                tokens = sum(map(known.__getitem__, parts))
                if len(self.best) > self.max_nodes:
                    self.clear()
            out.append((tokens, len(parts)))
        return out


_tries: dict[str, TokenTrie] = {}


def held_trie(sent, max_nodes: int) -> TokenTrie:
    """This worker process's trie for the vocabulary that was sent."""
    vocabulary = sent.value
    if vocabulary.key not in _tries:
        _tries.clear()
        _tries[vocabulary.key] = TokenTrie(vocabulary, max_nodes)
    return _tries[vocabulary.key]


def count_tokens(
    docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", max_nodes: int = MAX_NODES
) -> tuple[DataFrame, dict[str, str]]:
    """docs with n_tokens and n_pre_tokens; also the names these got."""
    names = {n: fresh_name(docs, n) for n in ("n_tokens", "n_pre_tokens")}
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        trie = held_trie(sent, max_nodes)

        def work(texts):
            found = trie.total([Vocabulary.prepare(t.decode("utf-8", "replace")) if t else "" for t in texts])
            return [pa.array([n for n, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())]

        return work

    return append_columns(docs, text_col, [(n, T.LongType()) for n in names.values()], make), names
