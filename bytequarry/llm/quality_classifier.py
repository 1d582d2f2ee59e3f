"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Features of a text are n-grams of its words (runs other than spaces and \\x09-\\x0D, case kept), hashed (XXH3) into
2**HASH_BITS weights: words and pairs of adjacent words, and the same over the words' shapes (the classes of the first and
the last three bytes; a pair of shapes also tells whether its words are the same). The shapes carry what words never seen in
training cannot: without them half of the bad texts pass (see SHAPES). A feature's value is its share of the text's features
of its kind times SCALE, so that a text's length does not move its score. A score is the sigmoid of the sparse dot product
with the weights plus a bias.

Training reads at most TRAIN_ROWS labelled texts: those whose ids have the smallest hashes. The bound is a
parameter; labels beyond it are not used. The ids of the sample are broadcast (at most TRAIN_ROWS longs) and their
texts are hashed where they lie. The sparse vectors are sorted, once for each of EPOCHS passes, by the ids' hashes, and
stream through one task that makes follow-the-regularised-leader updates: it holds the weights and one batch, and the model
does not depend on how rows are dealt out. The weights (2**HASH_BITS floats, 1 MiB) are broadcast for scoring, which reads
every whole text without a shuffle.

Defined cases: a null or empty text has only the bias; null labels and labels of unknown documents are left out;
an id with several labels counts as 1 if at least half of them are; of several texts of one id the least vector
is learnt; without labels all scores are 0.5; rows that repeat are scored alike; texts are read whole, whatever their length;
an empty table gives an empty table; the score gets another name where the table has a column of that name already.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytequarry.llm.common import append_columns, column_bytes, fresh_name, materialize

HASH_BITS, TRAIN_ROWS, EPOCHS = 18, 8_000, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.01, 0.1
SCALE = 8.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

#: Whether the n-grams of shapes are used. Held-out labels of the tables of scale 0.1: see the README.
SHAPES = True

_PAIR, _SHAPE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A for capitals, 0 for digits, a for other letters and all of UTF-8's longer characters; the rest stands for itself.
_CLASS = bytes(48 if 48 <= b <= 57 else 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def feature_indexes(text: bytes | None, bits: int = HASH_BITS, with_shapes: bool = SHAPES) -> list[np.ndarray]:
    """Indexes of the n-grams of each kind that the text has."""
    words = text.split() if text else []
    if not words:
        return []
    digest, shift = xxhash.xxh3_64_intdigest, np.uint64(64 - bits)
    word = np.fromiter(map(digest, words), np.uint64, len(words))
    kinds = [word, (word[:-1] * _PAIR + word[1:]) * _PAIR]
    if with_shapes:
        shapes = [w[:1] + w[-3:] for w in text.translate(_CLASS).split()]
        shape = np.fromiter(map(digest, shapes), np.uint64, len(words)) * _SHAPE
        same = (word[:-1] == word[1:]).astype(np.uint64)
        kinds += [shape, ((shape[:-1] + same) * _PAIR + shape[1:]) * _PAIR]
    return [(h >> shift).astype(np.int64) for h in kinds if len(h)]


def sparse_vector(text: bytes | None, bits: int = HASH_BITS, with_shapes: bool = SHAPES) -> tuple[np.ndarray, np.ndarray]:
    kinds = feature_indexes(text, bits, with_shapes)
    if not kinds:
        return np.zeros(0, np.int64), np.zeros(0)
    index, where = np.unique(np.concatenate(kinds), return_inverse=True)
    return index, np.bincount(where, np.concatenate([np.full(len(x), SCALE / len(x)) for x in kinds]), len(index))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """FTRL-proximal logistic regression; the last weight is the bias, which has no penalty."""

    def __init__(self, bits: int = HASH_BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        """The weights at these indexes, the last of which is the bias."""
        z, n = self.z[at], self.n[at]
        l1, l2 = np.full(len(at), self.l1), np.full(len(at), self.l2)
        l1[-1] = l2[-1] = 0.0
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + l2))

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        at, x = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w, n = self.weights(at), self.n[at]
        g = (float(sigmoid(w @ x)) - label) * x
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown


def training_sample(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """(id, label, turn) of at most `rows` labelled ids outside the held-out fold."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    own = own.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    return own.withColumn("turn", F.xxhash64("id")).orderBy("turn", "id").limit(rows)


def train(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
    bits: int = HASH_BITS,
    epochs: int = EPOCHS,
    with_shapes: bool = SHAPES,
) -> np.ndarray:
    """The weights, bias last."""
    sample = materialize(training_sample(labels, id_col, label_col, train_rows), "classifier-sample")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    chosen = texts.join(F.broadcast(sample), "id").select("id", "label", "turn", "text")
    schema = "id {}, label int, turn long, index array<int>, value array<double>".format(dict(chosen.dtypes)["id"])

    def vectors(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [sparse_vector(t, bits, with_shapes) for t in column_bytes(part.column(3))]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3],
                        pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())),
                        pa.array([v for _, v in found], pa.list_(pa.float64())),
                    ],
                    names=["id", "label", "turn", "index", "value"],
                )

    def learn(batches):
        model = Ftrl(bits)
        for batch in batches:
            label, index, value = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                model.update(np.asarray(index[i].values), np.asarray(value[i].values), label[i].as_py())
        weights = model.weights(np.arange((1 << bits) + 1)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    features = chosen.mapInArrow(vectors, schema).groupBy("id", "label", "turn").agg(F.min(F.struct("index", "value")).alias("x"))
    features = materialize(features, "classifier-features").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    ordered = features.repartition(1).sortWithinPartitions("epoch", "turn", "id").select("label", "x.index", "x.value")
    learnt = ordered.mapInArrow(learn, "weights binary").first()
    return np.frombuffer(learnt[0], np.float32) if learnt else np.zeros((1 << bits) + 1, np.float32)


_held: dict[str, np.ndarray] = {}


def held_weights(key: str, sent) -> np.ndarray:
    if key not in _held:
        _held.clear()
        _held[key] = np.asarray(sent.value, np.float64)
    return _held[key]


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", bits: int = HASH_BITS, with_shapes: bool = SHAPES) -> tuple[DataFrame, str]:
    """docs with the score (0 to 1) of every whole text; also the name of its column: score, unless docs has that."""
    name = fresh_name(docs, "score")
    sent, key = docs.sparkSession.sparkContext.broadcast(weights), uuid.uuid4().hex

    def make():
        w = held_weights(key, sent)
        bias = float(w[-1])

        def one(text: bytes | None) -> float:
            return bias + SCALE * sum(float(w[index].mean()) for index in feature_indexes(text, bits, with_shapes))

        return lambda texts: [pa.array(sigmoid(np.array([one(t) for t in texts], np.float64)))]

    return append_columns(docs, text_col, [(name, T.DoubleType())], make), name


def predicted(score_col: Column, threshold: float = THRESHOLD) -> Column:
    return (score_col >= threshold).cast("int")
