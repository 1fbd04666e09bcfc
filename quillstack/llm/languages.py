"""Languages of texts by hyperdimensional profiles.

Every letter owns a random vector of -1 and 1. Three letters in a row are bound into one vector: the
first's, rotated by two places, times the second's, rotated by one, times the third's; the edge of a
word is a letter of its own. The vectors of a text's triples add up to the text's, those of a language's
texts to its prototype, and a text is of the language whose prototype has the largest cosine with it.
Sums are of whole numbers, so they do not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .labelled import remainder
from .rolling import slices
from .store import workers_find_package

WIDTH, SEED = 1024, 20260
UNKNOWN = "und"
#: Characters and texts that are worked on at once; a longer text is cut and its parts added up.
CHUNK_CHARS, CHUNK_TEXTS, PART_CHARS, CHUNK_TRIPLES = 1 << 19, 256, 1 << 20, 1 << 13
#: Languages that a task sums up before it hands them on, and that all prototypes may hold together.
HELD, MOST_LANGUAGES = 1024, 4096


@cache
def letters() -> np.ndarray:
    """The lower-case letter of each code point, 0 for what is no letter."""
    out = np.zeros(0x110000, np.int32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


@cache
def letter_vector(letter: int) -> np.ndarray:
    return (np.random.default_rng([SEED, letter]).integers(0, 2, WIDTH, np.int8) * 2 - 1).astype(np.int8)


def triple_vectors(triples: np.ndarray) -> np.ndarray:
    """The bound vector of each triple, as floats."""
    out = np.ones((len(triples), WIDTH), np.int8)
    for shift, turn in ((42, 2), (21, 1), (0, 0)):
        own, at = np.unique((triples >> shift) & 0x1FFFFF, return_inverse=True)
        out *= np.roll(np.array([letter_vector(int(x)) for x in own]).reshape(-1, WIDTH), turn, 1)[at]
    return out.astype(np.float32)


def triples_of(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triples of letters and the text of each; symbols are letters, or 0 for the edge of a word."""
    keep = symbols > 0
    keep[1:] |= symbols[:-1] > 0
    keep[:1] = True
    s, d = symbols[keep].astype(np.int64), doc[keep]
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    middle = s[1:-1] > 0
    return ((s[:-2] << 42) | (s[1:-1] << 21) | s[2:])[middle], d[1:-1][middle]


def _symbols(text: str) -> np.ndarray:
    return letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _parts(text: str) -> Iterator[np.ndarray]:
    """Symbols of a long text in parts; two letters of a part go on into the next, so that no triple is lost or made."""
    tail = np.zeros(1, np.int32)
    for lo in range(0, len(text), PART_CHARS):
        own = np.concatenate((tail, _symbols(text[lo : lo + PART_CHARS])))
        if lo + PART_CHARS >= len(text):
            own = np.concatenate((own, np.zeros(1, np.int32)))
        yield own
        last = np.flatnonzero(own == 0)
        at = last[-1] if len(last) else 0
        tail = own[max(at, len(own) - 2) :]


def _table(rows: np.ndarray, triples: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, distinct triples, and how often each row holds each, for a bounded number of triples at a time."""
    if not len(triples):
        return
    found, place = np.unique(triples, return_inverse=True)
    own, row = np.unique(rows, return_inverse=True)
    for lo in range(0, len(found), CHUNK_TRIPLES):
        some = found[lo : lo + CHUNK_TRIPLES]
        here = slice(None) if len(some) == len(found) else (place >= lo) & (place < lo + CHUNK_TRIPLES)
        count = np.bincount(row[here] * len(some) + place[here] - lo, minlength=len(own) * len(some))
        yield own, some, count.reshape(len(own), len(some)).astype(np.float32)


def counted(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of texts, triples, and how often each of these texts holds each of these triples; what a text holds may come in parts."""
    lo = 0
    while lo < len(texts):
        if len(texts[lo] or "") > PART_CHARS:
            for own in _parts(texts[lo]):
                triples, _ = triples_of(own, np.zeros(len(own), np.int64))
                yield from _table(np.full(len(triples), lo), triples)
            lo += 1
            continue
        hi, size = lo, 0
        while hi < len(texts) and hi - lo < CHUNK_TEXTS and (n := len(texts[hi] or "")) <= PART_CHARS and (hi == lo or size + n <= CHUNK_CHARS):
            size, hi = size + n, hi + 1
        own = [t or "" for t in texts[lo:hi]]
        doc = np.repeat(np.arange(lo, hi), [len(t) + 1 for t in own])
        triples, rows = triples_of(_symbols("\n" + "\n".join(own) + "\n"), np.concatenate(([lo], doc)))
        yield from _table(rows, triples)
        lo = hi


@dataclass
class Profiles:
    """Names of languages, ascending, and a prototype of each."""

    names: list[str]
    sums: np.ndarray

    def closest(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language of each text and the cosine, not below 0; UNKNOWN and 0 without a letter or without a language."""
        own, some = np.zeros((len(texts), WIDTH)), np.zeros(len(texts), bool)
        for rows, triples, count in counted(texts):
            own[rows] += count @ triple_vectors(triples)
            some[rows] = True
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        norm = lambda x: np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
        cosine = (own / norm(own)) @ (self.sums / norm(self.sums)).T
        best = cosine.argmax(1)
        score = np.where(some, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
        return [self.names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], score


def fit(docs: DataFrame, by: int = 5, held_out: int = 0) -> Profiles:
    """Prototypes of all non-null languages from every text outside the held-out remainder.

    A task adds up its own texts, HELD languages at a time; what meets is a sum a task, language and place.
    """
    workers_find_package(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "sums"])
            sums.clear()
            return out

        for batch in slices(batches):
            lang = np.array(batch.column(1).to_pylist(), object)
            for rows, triples, count in counted(batch.column(0).to_pylist()):
                names, at = np.unique(lang[rows].astype(str), return_inverse=True)
                together = (at == np.arange(len(names))[:, None]).astype(np.float32) @ count
                for name, own in zip(names.tolist(), together @ triple_vectors(triples), strict=True):
                    sums[name] = sums.get(name, 0) + own.astype(np.int64)
            if len(sums) >= HELD:
                yield told()
        yield told()

    known = docs.where(F.col("lang").isNotNull() & (remainder("doc_id", by) != held_out)).select("text", F.col("lang").cast("string").alias("lang"))
    parts = known.mapInArrow(task, "lang string, sums array<long>").select("lang", F.posexplode("sums").alias("k", "x"))
    whole = parts.groupBy("lang", "k").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("sums"))
    rows = whole.limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: prototypes are held by every task")
    rows.sort(key=lambda r: r.lang)
    return Profiles([r.lang for r in rows], np.array([[x.x for x in r.sums] for r in rows], float).reshape(len(rows), WIDTH))


def tag(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs with lang_pred and score (the cosine with its prototype, 0 to 1).

    Whole texts are read. Null text, or one without a letter: UNKNOWN and 0. Equal cosines: the first name.
    Without any prototype all are UNKNOWN. Rows of equal or null doc_id: each on its own. Empty table: no
    rows. Columns named lang_pred or score give way, others come through.
    """
    workers_find_package(docs.sparkSession)
    base = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(profiles)
    place = [n.lower() for n in base.columns].index("text")
    told = base.toDF(*(f"c{k}" for k in range(len(base.columns))))  # names may hold dots and backticks
    schema = StructType([*told.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, score = held.value.closest(batch.column(place).to_pylist())
            yield pa.record_batch([*batch.columns, pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    return told.mapInArrow(task, schema).toDF(*base.columns, "lang_pred", "score")


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, from the languages of those outside the held-out fifth."""
    out = tag(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
