"""Toxic spans by a linear-chain conditional random field.

Tokens of labelled documents get labels of their own: a token is toxic if its document is and its
word, or a stem of it, occurs in toxic documents so much oftener that chance is ruled out over the
whole vocabulary. The field has two states, a weight for each hashed word and stem (the first 4, 5
and 6 bytes of a word), and transitions; it is fitted by gradient
on sentences. Forward-backward marginals give offending spans, and their sum and maximum over a
document give its score through a logistic curve fitted on the same sample.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import SAMPLE_DOCS, labelled_ids, labelled_texts, remainder
from .rolling import LOWER, Chunk, Prefix, chunks, mix, slices, words_of
from .store import Scratch, workers_find_package

BUCKETS = 1 << 22
STEMS = (4, 5, 6)
TRAITS = 1 + len(STEMS)
LONGEST = 64
SAMPLE_TOKENS, SAMPLE_FILES = 4_000_000, 4
#: Sentences without a listed word that the field is fitted on, about; all of those with one are. Each stands
#: for as many as were passed over for it, so that the share of toxic tokens is that of the sample at any size.
PLAIN_SENTENCES = 20_000
REJECT = 0.7
#: Share of a word's documents that are toxic, at least, where its tokens are labelled so.
PURE = 0.8
BREAK = np.zeros(256, bool)
BREAK[[10, 33, 46, 63]] = True


@dataclass
class Tokens:
    """Hashed words and stems (a column each) of a chunk, their texts and bytes, and where sentences begin (and one past the last)."""

    word: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sentence: np.ndarray


def tokens_of(chunk: Chunk) -> Tokens:
    """Words; sentences end at . ! ? and line ends, at texts' ends, and after LONGEST words."""
    w = words_of(chunk)
    n = len(w.hash)
    stops = np.concatenate(([0], np.cumsum(BREAK[chunk.data])))
    new = np.ones(n, bool)
    if n:
        new[1:] = (w.doc[1:] != w.doc[:-1]) | (stops[w.start[1:]] != stops[w.end[:-1]])
        first = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        new |= place % LONGEST == 0
    hashes = Prefix(LOWER[chunk.data])
    traits = [w.hash] + [mix(hashes.of(w.start, np.minimum(w.end, w.start + k)) + np.uint64(k)) for k in STEMS]
    return Tokens((np.stack(traits, 1) & np.uint64(BUCKETS - 1)).astype(np.int32), w.doc, w.start, w.end, np.append(np.flatnonzero(new), n))


@dataclass
class Field:
    """Log-odds of the toxic state by word, transition scores, and the curve from marginals to scores."""

    weight: np.ndarray
    bias: float
    transition: np.ndarray
    curve: np.ndarray

    def marginals(self, word: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        """Probability of the toxic state of each token, given its sentence."""
        return self.expectations(word, sentence)[0]

    def expectations(self, word: np.ndarray, sentence: np.ndarray, gain: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Marginals, and if sentences' weights are given the expected number of moves from each state to each."""
        expected = np.zeros((2, 2))
        size = np.diff(sentence)
        order = np.argsort(-size, kind="stable")
        begin, size = sentence[:-1][order], size[order]
        odds = np.exp(np.clip(self.weight[word].sum(1) + self.bias, -30, 30))
        move = np.exp(self.transition)
        out = np.empty(len(word))
        longest = int(size[0]) if len(size) else 0
        # the first `alive[t]` sentences have a token t
        alive = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
        ahead = np.empty((2, len(word)))
        a0, a1 = np.ones(len(size)), np.ones(len(size))
        for t in range(longest):
            k = alive[t]
            at = begin[:k] + t
            if t:
                a0, a1 = a0[:k] * move[0, 0] + a1[:k] * move[1, 0], a0[:k] * move[0, 1] + a1[:k] * move[1, 1]
            a1 = a1[:k] * odds[at]
            total = a0[:k] + a1
            a0, a1 = a0[:k] / total, a1 / total
            ahead[0, at], ahead[1, at] = a0, a1
        b0, b1 = np.ones(len(size)), np.ones(len(size))
        for t in range(longest - 1, -1, -1):
            k = alive[t]
            at = begin[:k] + t
            p0, p1 = ahead[0, at] * b0[:k], ahead[1, at] * b1[:k]
            out[at] = p1 / (p0 + p1)
            o = odds[at] * b1[:k]
            if gain is not None and t:
                f0, f1 = ahead[0, at - 1], ahead[1, at - 1]
                x = np.stack((f0 * move[0, 0] * b0[:k], f0 * move[0, 1] * o, f1 * move[1, 0] * b0[:k], f1 * move[1, 1] * o))
                expected += ((x / x.sum(0)) @ gain[order[:k]]).reshape(2, 2)
            n0, n1 = move[0, 0] * b0[:k] + move[0, 1] * o, move[1, 0] * b0[:k] + move[1, 1] * o
            total = n0 + n1
            b0[:k], b1[:k] = n0 / total, n1 / total
        return out, expected

    def scores(self, marginal: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
        x = document_features(marginal, doc, texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def document_features(marginal: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    total = np.bincount(doc, marginal, texts)
    top = np.zeros(texts)
    np.maximum.at(top, doc, marginal)
    return np.stack((np.ones(texts), np.log1p(total), top), 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Sample:
    """Labelled documents: traits of their words, where their sentences begin, and whether each is toxic."""

    words: list[np.ndarray]
    heads: list[np.ndarray]
    y: np.ndarray

    def ends(self, k: int) -> np.ndarray:
        return np.append(self.heads[k], len(self.words[k]))


def toxic_traits(sample: Sample) -> np.ndarray:
    """Words and stems bound to toxic documents beyond chance over all of the sample's.

    A trait counts once for each pair of words that it stands between, so that copies of a text,
    whole or with changes elsewhere, are one witness.
    """
    bad, all_ = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    share = [0, 0]
    for y in (0, 1):
        own = [w for w, toxic in zip(sample.words, sample.y, strict=True) if toxic == y and len(w)]
        if not own:
            continue
        place = np.concatenate([mix(np.concatenate(([0], w[:-1, 0])).astype(np.uint64) * np.uint64(BUCKETS) + np.concatenate((w[1:, 0], [0])).astype(np.uint64)) for w in own])
        for k in range(TRAITS):
            trait = np.concatenate([w[:, k] for w in own])
            _, at = np.unique(mix(place + trait.astype(np.uint64)), return_index=True)
            n = np.bincount(trait[at], minlength=BUCKETS).astype(np.int32)
            all_ += n
            if y:
                bad += n
            share[y] += len(at)
    prior = share[1] / max(1, sum(share))
    at = np.flatnonzero(bad)
    b, n, share = bad[at].astype(float), all_[at].astype(float), max(prior, 1e-9)
    good = n - b
    # likelihood ratio of the word's share of toxic documents against the share of all
    g = 2 * (b * np.log(b / (n * share)) + good * np.log(np.maximum(good, 1e-9) / np.maximum(n * (1 - share), 1e-9)))
    out = np.zeros(BUCKETS, bool)
    out[at] = (b >= n * PURE) & (g > 2 * np.log(max(2, int((all_ > 0).sum()))))
    return out


def train(sample: Sample, steps: int = 120, rate: float = 0.1, ridge: float = 1e-2, plain: int = PLAIN_SENTENCES) -> Field:
    """Fit the field on labelled sentences (of those without a listed word about `plain`, weighted), and the curve on documents."""
    field = Field(np.zeros(BUCKETS, np.float32), -2.0, np.zeros((2, 2)), np.array([-20.0, 0, 0]))
    if not len(sample.y) or not sample.y.any():
        return field
    toxic = toxic_traits(sample)
    listed = np.zeros(BUCKETS, bool)
    for w, y in zip(sample.words, sample.y, strict=True):
        if y:
            listed[w[toxic[w].any(1), 0]] = True
    if not listed.any():
        return field
    # all sentences with a word that is toxic somewhere, and as many of others as make a sample
    total, rng = sum(map(len, sample.heads)), np.random.default_rng(5)
    drawn = min(1.0, plain / total)
    parts, labels, sizes, gains = [], [], [], []
    for k, (w, y) in enumerate(zip(sample.words, sample.y, strict=True)):
        if not len(w):
            continue
        ends = sample.ends(k)
        hot = np.logical_or.reduceat(listed[w[:, 0]], ends[:-1])
        for i in np.flatnonzero(hot | (rng.random(len(hot)) < drawn)):
            part = w[ends[i] : ends[i + 1]]
            parts.append(part)
            labels.append(toxic[part].any(1) & bool(y))
            sizes.append(len(part))
            gains.append(1.0 if hot[i] else 1 / drawn)
    gain, of_token = np.array(gains), np.repeat(gains, sizes)
    w, z, s = np.concatenate(parts), np.concatenate(labels).astype(float), np.append(0, np.cumsum(sizes))
    first = np.zeros(len(w), bool)
    first[s[:-1]] = True
    used, place = np.unique(w, return_inverse=True)
    place = place.reshape(w.shape)
    seen = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(seen, (z[inner - 1].astype(int), z[inner].astype(int)), of_token[inner])
    theta, m, v = np.zeros(len(used) + 5), np.zeros(len(used) + 5), np.zeros(len(used) + 5)
    theta[-5] = -2.0
    for t in range(1, steps + 1):
        field.weight[used], field.bias, field.transition = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
        p, expected = field.expectations(w, s, gain)
        diff = (z - p) * of_token
        grad = np.concatenate((np.bincount(place.ravel(), np.repeat(diff, TRAITS), len(used)), [diff.sum()], (seen - expected).ravel())) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -3, 3)
    field.weight[used], field.bias, field.transition = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
    x = np.concatenate([document_features(field.marginals(own, sample.ends(k)), np.zeros(len(own), int), 1) for k, own in enumerate(sample.words)])
    field.curve = _logistic(x, sample.y.astype(float))
    return field


def within(counts: Iterable[tuple[int, int]], tokens: int) -> set[int]:
    """Ids whose documents are taken in the order given while their tokens fit in `tokens`; one that doesn't fit is passed over."""
    out, total = set(), 0
    for i, n in counts:
        if total + n <= tokens:
            out.add(i)
            total += n
    return out


def fit(docs: DataFrame, labels: DataFrame, by: int = 3, held_out: int = 1, most: int = SAMPLE_DOCS // 2, tokens: int = SAMPLE_TOKENS) -> Field:
    """Fit on at most `most` labelled documents and at most `tokens` tokens of them, outside the held-out remainder.

    Tokens are counted first, and documents taken in order of the ids' hash, so that the order of the table doesn't matter.
    """
    spark = docs.sparkSession
    workers_find_package(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                n = np.bincount(tokens_of(c).doc, minlength=len(c))
                yield pa.record_batch([batch.column(0).slice(c.lo, len(c)), batch.column(1).slice(c.lo, len(c)), pa.array(n, pa.int64())], names=["id", "y", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                x = tokens_of(c)
                edge = np.searchsorted(x.doc, np.arange(len(c) + 1))
                cut = np.searchsorted(x.sentence, edge)
                words = [x.word[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                heads = [(x.sentence[a:b] - e).astype(np.int32).tobytes() for a, b, e in zip(cut[:-1], cut[1:], edge[:-1], strict=True)]
                yield pa.record_batch([batch.column(0).slice(c.lo, len(c)), batch.column(1).slice(c.lo, len(c)), pa.array(words, pa.binary()), pa.array(heads, pa.binary())], names=["id", "y", "words", "heads"])

    counted = labelled_texts(docs, labelled_ids(labels, "toxic", by, held_out, most)).mapInArrow(count, "id long, y int, n long").groupBy("id", "y").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.md5(F.col("id").cast("string")), "id").collect()
    fitting = within(((r.id, r.n) for r in rows), tokens)
    taken = spark.createDataFrame([(r.id, r.y) for r in rows if r.id in fitting], "id long, y int")
    words, heads, y = [], [], []
    # the bounded sample goes to a few files first: read one by one from the scan, it would be a job for each of its tasks
    scratch = Scratch(spark, "toxicity")
    sample = scratch.keep(labelled_texts(docs, taken).mapInArrow(task, "id long, y int, words binary, heads binary").repartition(SAMPLE_FILES, "id"), "sample")
    got = {}
    for row in sample.toLocalIterator():
        got.setdefault(row.id, []).append(row)
    for row in sorted((r for own in got.values() for r in own), key=lambda r: (r.id, bytes(r.words))):
        words.append(np.frombuffer(row.words, np.int32).reshape(-1, TRAITS))
        heads.append(np.frombuffer(row.heads, np.int32))
        y.append(row.y)
    return train(Sample(words, heads, np.array(y, int)))


def score(docs: DataFrame, field: Field, reject: float = REJECT) -> DataFrame:
    """docs with score, predicted (1 if score >= reject) and spans (bytes of runs of tokens more toxic than not).

    Whole texts are read. Null or empty text: the curve's foot, no spans. Rows of equal or null
    doc_id: each on its own. Empty table: no rows. Columns named score, predicted or spans give way.
    """
    workers_find_package(docs.sparkSession)
    base = docs.drop("score", "predicted", "spans")
    names, held = base.columns, docs.sparkSession.sparkContext.broadcast(field)
    place = [n.lower() for n in names].index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", score double, predicted int, spans array<struct<start:int,end:int>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in slices(batches):
            s = np.zeros(batch.num_rows)
            spans: list[list[dict[str, int]]] = [[] for _ in range(batch.num_rows)]
            for c in chunks(batch.column(place)):
                x = tokens_of(c)
                p = own.marginals(x.word, x.sentence)
                s[c.lo : c.hi] = own.scores(p, x.doc, len(c))
                hit = np.flatnonzero(p >= 0.5)
                if len(hit):
                    first = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (x.doc[hit[1:]] != x.doc[hit[:-1]]))))
                    last = np.append(first[1:], len(hit)) - 1
                    for a, b in zip(hit[first].tolist(), hit[last].tolist(), strict=True):
                        d = int(x.doc[a])
                        spans[c.lo + d].append({"start": int(x.start[a] - c.start[d]), "end": int(x.end[b] - c.start[d])})
            yield pa.record_batch([*batch.columns, pa.array(s), pa.array((s >= reject).astype(np.int32)), pa.array(spans, kind)], names=[*names, "score", "predicted", "spans"])

    return base.mapInArrow(task, fields)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every document, from labels outside the held-out third."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "spans")
