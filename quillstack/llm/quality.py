"""Document quality by random-indexing vectors and a small network.

Every word, and every shape (case, length, what stands behind it, repetition), owns a fixed sparse
vector of -1, 0 and 1; its word vector is the sum of those of its neighbours over the whole corpus.
A document is the mean of the vectors of its words and of its shapes. A network with one hidden
layer, written in numpy, is fitted on a bounded sample; a temperature fitted on rows that neither
the network nor the choice of its state has seen calibrates it. Words are hashed into WORDS rows, so
that the tables have a fixed size; words that share a row share its vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import SAMPLE_DOCS, labelled_ids, labelled_texts, remainder
from .rolling import Chunk, chunks, slices, words_of
from .sketches import SCHEMA, add_up, emit, gather
from .store import workers_find_package

WORDS, SHAPES, WIDTH, SPARSE = 1 << 14, 512, 64, 4
HIDDEN, ACCEPT = 32, 0.7
FEATURES = 2 * WIDTH + 1
_rng = np.random.default_rng(4242)


def _index(rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's non-zero components."""
    place = np.argsort(_rng.random((rows, WIDTH)), 1)[:, :SPARSE]
    return place, _rng.choice(np.array([-1, 1]), (rows, SPARSE))


_WORD_AT, _WORD_SIGN = _index(WORDS)
_SHAPE_AT, _SHAPE_SIGN = _index(SHAPES)


def _marks(data: np.ndarray, codes: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(codes.encode())] = True
    return np.concatenate(([0], np.cumsum(mask[data])))


def stream(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, shape number and text of each word of a chunk."""
    w = words_of(chunk)
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w.doc
    upper, digit = _marks(chunk.data, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _marks(chunk.data, "0123456789")
    size, ups = w.end - w.start, upper[w.end] - upper[w.start]
    head = upper[w.start + 1] - upper[w.start]
    case = np.select([digit[w.end] > digit[w.start], ups == 0, (ups == size) & (size > 1), (ups == 1) & (head == 1)], [4, 0, 2, 1], 3)
    long_ = np.digitize(size, (4, 8, 14))
    after = np.minimum(np.append(w.start[1:], len(chunk.data)), chunk.end[w.doc])
    has = lambda codes: (m := _marks(chunk.data, codes))[after] - m[w.end]
    behind = np.select([has("!") > 1, has("#$%&*@^~=+<>\\") > 1, has("|") > 0, has("#$%&*@^~=+<>\\/[]{}") > 0, has("\n") > 0, has(".!?") > 0, has(",;:") > 0], [1, 2, 3, 4, 5, 6, 7], 0)
    again = np.zeros(n, int)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    return (w.hash % np.uint64(WORDS)).astype(np.int64), ((case * 4 + long_) * 8 + behind) * 2 + again, w.doc


def corpus_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of all hashed words and of all shapes, from neighbours in every document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = np.zeros(WORDS * WIDTH), np.zeros((SHAPES, SHAPES))
        for batch in batches:
            for c in chunks(batch.column(0)):
                word, shape, doc = stream(c)
                if len(word) < 2:
                    continue
                near = doc[1:] == doc[:-1]
                a, b = np.flatnonzero(near), np.flatnonzero(near) + 1
                own, other = word[np.concatenate((a, b))], word[np.concatenate((b, a))]
                words += np.bincount((own[:, None] * WIDTH + _WORD_AT[other]).ravel(), _WORD_SIGN[other].ravel(), WORDS * WIDTH)
                pairs += np.bincount(shape[a] * SHAPES + shape[b], minlength=SHAPES * SHAPES).reshape(SHAPES, SHAPES)
        yield from emit({"words": words.astype(np.int64), "pairs": pairs.astype(np.int64)})

    texts = docs.select("text")

    def joined(payloads: list[bytes], name: str) -> bytes:
        return add_up("int64")(payloads, name)

    got = gather(texts.mapInArrow(task, SCHEMA), texts.rdd.getNumPartitions(), {"words": (np.dtype(np.int64), (WORDS, WIDTH)), "pairs": (np.dtype(np.int64), (SHAPES, SHAPES))}, joined)
    index = np.zeros((SHAPES, WIDTH))
    np.put_along_axis(index, _SHAPE_AT, _SHAPE_SIGN, 1)
    pairs = got["pairs"].astype(float)
    near = (pairs + pairs.T) @ index
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    # a shape's own vector goes in with what stands beside it, so that few shapes stay apart
    return unit(got["words"].astype(float)).astype(np.float32), unit(unit(index) + 0.5 * unit(near)).astype(np.float32)


def pooled(chunk: Chunk, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """A row a text: mean word vector, mean shape vector, logarithm of the number of words."""
    word, shape, doc = stream(chunk)
    n = np.bincount(doc, minlength=len(chunk))
    out = np.zeros((len(chunk), FEATURES))
    some = np.flatnonzero(n)
    if len(some):
        at = (np.cumsum(n) - n)[some]
        for k in range(0, len(some), 200):
            part = slice(k, k + 200)
            a, b = at[part][0], at[part][-1] + n[some[part]][-1]
            out[some[part], :WIDTH] = np.add.reduceat(words[word[a:b]], at[part] - a, 0, dtype=np.float64) / n[some[part], None]
            out[some[part], WIDTH:-1] = np.add.reduceat(shapes[shape[a:b]], at[part] - a, 0, dtype=np.float64) / n[some[part], None]
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Network:
    """Two layers over standardised features, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.inner + self.inner_bias) @ self.outer + self.outer_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, ridge: float = 1e-3) -> Network:
    """Fit on four fifths of the rows, keep the best state on a tenth, and calibrate on the tenth that neither has seen."""
    rng = np.random.default_rng(11)
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(p / (1 - p))), 1.0)
    order = rng.permutation(len(y))
    fresh, held, own = np.split(order, (len(y) // 10, len(y) // 5))
    net = Network(x[own].mean(0), x[own].std(0) + 1e-6, rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0, 1.0)
    z = (x - net.mean) / net.scale
    state = [net.inner, net.inner_bias, net.outer, np.zeros(1)]
    m, v = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]

    def loss(s: list[np.ndarray], rows: np.ndarray, t: float = 1.0) -> float:
        a = np.clip((np.tanh(z[rows] @ s[0] + s[1]) @ s[2] + s[3][0]) / t, -30, 30)
        return float(np.mean(np.log1p(np.exp(-a)) + (1 - y[rows]) * a))

    best, kept, step = np.inf, [s.copy() for s in state], 0
    for _ in range(epochs):
        shuffled = rng.permutation(own)
        for lo in range(0, len(shuffled), 128):
            rows = shuffled[lo : lo + 128]
            h = np.tanh(z[rows] @ state[0] + state[1])
            p = 1 / (1 + np.exp(-np.clip(h @ state[2] + state[3][0], -30, 30)))
            d = (p - y[rows]) / len(rows)
            back = d[:, None] * state[2] * (1 - h * h)
            grad = [z[rows].T @ back + ridge * state[0], back.sum(0), h.T @ d + ridge * state[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grad):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                state[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        now = loss(state, held) if len(held) else loss(state, own)
        if now < best:
            best, kept = now, [s.copy() for s in state]
    net.inner, net.inner_bias, net.outer, net.outer_bias = kept[0], kept[1], kept[2], float(kept[3][0])
    if len(fresh):
        net.temperature = float(min(np.exp(np.linspace(-1.5, 1.5, 61)), key=lambda t: loss(kept, fresh, t)))
    return net


@dataclass
class Quality:
    words: np.ndarray
    shapes: np.ndarray
    net: Network


def fit(docs: DataFrame, labels: DataFrame, by: int = 4, held_out: int = 2, most: int = SAMPLE_DOCS) -> Quality:
    """Vectors from all documents; the network from at most `most` labelled ones outside the held-out remainder."""
    workers_find_package(docs.sparkSession)
    words, shapes = corpus_vectors(docs)
    held = docs.sparkSession.sparkContext.broadcast((words, shapes))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                x = pooled(c, *held.value).astype(np.float32)
                yield pa.record_batch([batch.column(0).slice(c.lo, len(c)), batch.column(1).slice(c.lo, len(c)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    rows = labelled_texts(docs, labelled_ids(labels, "quality", by, held_out, most)).mapInArrow(task, "id long, y int, x binary").collect()
    rows.sort(key=lambda r: (r.id, bytes(r.x)))
    x = np.array([np.frombuffer(bytes(r.x), np.float32) for r in rows], float).reshape(len(rows), FEATURES)
    return Quality(words, shapes, train(x, np.array([r.y for r in rows], float)))


def score(docs: DataFrame, model: Quality, accept: float = ACCEPT) -> DataFrame:
    """docs with score and predicted (1 if score >= accept).

    Whole texts are read. Null or empty text: the score of a document without words. Rows of equal or
    null doc_id: each on its own. Empty table: no rows. Columns named score or predicted give way.
    """
    workers_find_package(docs.sparkSession)
    base = docs.drop("score", "predicted")
    names, held = base.columns, docs.sparkSession.sparkContext.broadcast(model)
    place = [n.lower() for n in names].index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", score double, predicted int"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in slices(batches):
            s = np.zeros(batch.num_rows)
            for c in chunks(batch.column(place)):
                s[c.lo : c.hi] = own.net.scores(pooled(c, own.words, own.shapes))
            yield pa.record_batch([*batch.columns, pa.array(s), pa.array((s >= accept).astype(np.int32))], names=[*names, "score", "predicted"])

    return base.mapInArrow(task, fields)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, from labels outside the held-out quarter."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
