"""Packing of token sequences by harmonic classes.

A document is cut into full sequences and a rest; the rest is cut at the powers of two it is made
of, down to LEAST, so that its pieces are reciprocals of the capacity, and what remains is shorter
than LEAST. A piece of length l belongs to class k = floor(capacity / l), and every bin of class k
takes exactly k pieces. Each task fills bins on its own. Bins that are still open at its end are
emptied and their pieces run on one after another, cut where a sequence is full; the last of them
is cut into sequences whose lengths are powers of two. Only bins of short rests are padded.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import LONGEST, PairTable
from .store import workers_find_package

CAPACITY, LEAST, CLOSING = 2048, 64, 1
CACHED_WORDS, PORTION = 400_000, 2 << 20
SPACE, LETTER, DIGIT, SIGN, QUOTE, OTHER = range(6)
#: The rules by which WordEncoder may cut.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = [{"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def _cuts(a: int, b: int) -> bool:
    """Whether texts may be cut between bytes of these kinds. A quote may begin a word ('s, 're) with what follows."""
    if SPACE in (a, b) or OTHER in (a, b):
        return SPACE in (a, b)
    return DIGIT in (a, b) or (a == LETTER) != (b == LETTER) and (a, b) != (QUOTE, LETTER)


_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_KIND = np.array([OTHER if b > 127 else SPACE if chr(b) in "\t\n\v\f\r " else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else QUOTE if chr(b) == "'" else SIGN for b in range(256)], np.uint8)
_CUT = np.array([_cuts(a, b) for a in range(8) for b in range(8)])
#: First bytes of U+00C0 to U+024F and U+0400 to U+047F: letters that compose with no letter before them, but for these.
_LEAD = np.isin(np.arange(256), [*range(0xC3, 0xCA), 0xD0, 0xD1])
_NO_LETTER = [0xC397, 0xC3B7, 0xC4B0]


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8; OTHER what only the tokenizer's own tables tell."""
    kind = _KIND[data]
    high = np.flatnonzero(kind == OTHER)
    if len(high):
        lead = high[_LEAD[data[high]]]
        lead = lead[~np.isin(data[lead].astype(np.int32) << 8 | data[lead + 1], _NO_LETTER)]
        kind[lead] = kind[lead + 1] = LETTER
    return kind


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of large_binary values, and where each value begins and the last ends."""
    _, edge, data = texts.buffers()
    edge = np.frombuffer(edge, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[edge[0] : edge[-1]], edge - edge[0]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each range, one after another."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


class WordEncoder:
    """Token ids of texts under a tokenizer whose words are runs of letters, single digits and runs of signs.

    Texts are cut where such a tokenizer cuts in any case and nothing composes across: at white space
    and between letters, digits and signs, as far as bytes tell them. Each different part is encoded
    once; parts are cached up to a bound, then the cache starts anew. Texts that hold a special token,
    and all under a tokenizer of other rules, go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._read(path)
        self._clear()

    def _read(self, path: str) -> None:
        """Whether texts may be cut, and the merge table where the file is of the kind whose words can be merged here."""
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model, added = rules["model"], rules["added_tokens"]
        self.known = (rules["normalizer"] or {}).get("normalizers") == _NORMALIZERS and (rules["pre_tokenizer"] or {}).get("pretokenizers") == _SPLIT and not rules["truncation"] and not rules["padding"] and not any(x["normalized"] for x in added)
        self.special = re.compile(b"|".join(re.escape(x["content"].encode()) for x in added)) if added else None
        self.table, close = None, model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            return
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        rows = [(vocab[a], vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(pairs)]
        self.table = PairTable(*(np.array(x) for x in zip(*rows, strict=True)))
        # byte-level alphabets name a byte by its own character if that prints, else by those from 256 on
        prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(prints)]
        name = {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.inner = np.array([vocab.get(name[b], -1) for b in range(256)], np.int32)
        self.last = np.array([vocab.get(name[b] + close, -1) for b in range(256)], np.int32)

    def _whole(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts by the tokenizer, one after another, and how many each has."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum())), n

    def _encode_new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts of texts one after another, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        plain = np.logical_and.reduceat(_kinds(data) == LETTER, begin) if self.table is not None else np.zeros(len(words), bool)
        at = np.flatnonzero(plain)
        raw = [words[i] for i in at]
        for k in np.flatnonzero((np.maximum.reduceat(data, begin) > 127)[at]):
            raw[k] = raw[k].decode().lower().encode()
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        fit = size <= LONGEST
        plain[at[~fit]] = False
        at, size = at[fit], size[fit]
        other = np.flatnonzero(~plain)
        count = np.zeros(len(words), np.int64)
        parts = []
        if len(at):
            data = np.frombuffer(b"".join([x for x, ok in zip(raw, fit, strict=True) if ok]), np.uint8)
            flat = self.inner[data]
            tail = np.cumsum(size) - 1
            flat[tail] = self.last[data[tail]]
            parts.append((at, *self.table.merge_all(flat, size)))
        if len(other):
            parts.append((other, *self._whole([words[i] for i in other])))
        for own, _, n in parts:
            count[own] = n
        out = np.empty(int(count.sum()), np.uint32)
        begin = np.cumsum(count) - count
        for own, ids, n in parts:
            out[_ranges(begin[own], n)] = ids
        return out, count

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.end = np.zeros(0, np.int64)

    def _parts(self, data: np.ndarray, edge: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Parts of texts without white space, by number and dictionary, and the edges of texts among them."""
        if not len(data):
            return pa.array([], pa.large_binary()).dictionary_encode(), np.zeros(len(edge), np.int64)
        kind = _kinds(data)
        cut = np.ones(len(data), bool)
        cut[1:] = _CUT[kind[:-1] << 3 | kind[1:]]
        cut[edge[:-1][edge[:-1] < len(data)]] = True
        low = _LOWER[data]
        # a letter that may compose with what follows keeps its case, as composing comes first
        follow = np.flatnonzero((kind[1:] == OTHER) & ~cut[1:])
        low[follow] = data[follow]
        stay = kind != SPACE
        edge = np.searchsorted(np.flatnonzero(cut & stay), edge)
        low, cut = low[stay], cut[stay]
        offset = np.append(np.flatnonzero(cut), len(low))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offset) - 1, [None, pa.py_buffer(offset), pa.py_buffer(low)]).dictionary_encode(), edge

    def encode_column(self, texts: pa.Array, closing: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of large_binary texts one after another, each text's followed by `closing`, and where each text's end."""
        data, edge = _bytes_of(texts)
        if self.known:
            # a match across two texts sends the first of them to the tokenizer whole, which gives the same ids
            found = [m.start() for m in self.special.finditer(data)] if self.special and len(data) else []
            alone = np.unique(np.searchsorted(edge, found, "right") - 1)
        else:
            alone = np.arange(len(texts))
        whole, sizes = self._whole([data[edge[i] : edge[i + 1]].tobytes() for i in alone])
        if len(alone):
            stay = np.ones(len(texts), bool)
            stay[alone] = False
            size = np.where(stay, np.diff(edge), 0)
            data, edge = data[_ranges(edge[:-1], size)], np.append(0, np.cumsum(size))
        parts, edge = self._parts(data, edge)
        if len(self.place) > CACHED_WORDS:
            self._clear()
        place, words = self.place, parts.dictionary.to_pylist()
        new = [x for x in words if x not in place]
        if new:
            ids, count = self._encode_new(new)
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            self.end = np.append(self.end, len(self.ids) + np.cumsum(count))
            self.ids = np.append(self.ids, ids)
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))[parts.indices.to_numpy()]
        # texts that were encoded whole, and closing ids, are parts of their own behind the others
        own = np.zeros(len(texts), np.int64)
        own[alone] = 1
        more = np.append(sizes, [1] * (closing is not None)).astype(np.int64)
        ids = np.concatenate([self.ids, whole, np.array([closing] * (closing is not None), np.uint32)])
        end = np.append(self.end, len(self.ids) + np.cumsum(more))
        names = np.full((len(texts), 2), -1)
        names[alone, 0] = len(self.end) + np.arange(len(alone))
        if closing is not None:
            names[:, 1] = len(end) - 1
        put = names >= 0
        at = np.insert(at, np.repeat(edge[1:], put.sum(1)), names[put])
        edge = edge[1:] + np.cumsum(put.sum(1))
        stop = end[at]
        size = stop - np.where(at > 0, end[at - 1], 0)
        return ids[_ranges(stop - size, size)], np.append(0, np.cumsum(size))[edge]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, end = self.encode_column(pa.array([t.encode() for t in texts], pa.large_binary()))
        return np.split(ids, end[:-1]) if texts else []


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut_points(total: int, capacity: int = CAPACITY, least: int = LEAST) -> list[int]:
    """Lengths of the pieces of a document."""
    out = [capacity] * (total // capacity)
    rest, size = total % capacity, capacity // 2
    while size >= least:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class HarmonicBins:
    """Bins of one task. Rows are (document, start, ids, tokens of the document, sequence, offset)."""

    def __init__(self, task: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.next = capacity, task << 33
        self.open: dict[int, list[tuple]] = {}

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at, name = 0, self._sequence()
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, name, at
            at += len(ids)

    def add(self, doc: int | None, ids: np.ndarray, least: int = LEAST) -> Iterator[tuple]:
        start, total = 0, len(ids)
        for n in cut_points(total, self.capacity, least):
            k = self.capacity // n
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, ids[start : start + n].copy(), total))  # no view: open bins would hold whole portions
            if len(bin_) == k:
                yield from self._close(bin_)
                self.open[k] = []
            start += n

    def finish(self) -> Iterator[tuple]:
        """What open bins hold, in full sequences and then in ones of powers of two."""
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        left = sum(len(p[2]) for p in rest)
        self.open = {}
        room, at, name = 0, 0, 0
        for doc, start, ids, total in rest:
            while len(ids):
                if not room:
                    room, at, name = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1), 0, self._sequence()
                n = min(room, len(ids))
                yield doc, start, ids[:n], total, name, at
                start, ids, at, room, left = start + n, ids[n:], at + n, room - n, left - n


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.Array]]:
    """Ids of documents and their texts, null as empty, by about PORTION bytes."""
    texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
    edge, lo = _bytes_of(texts)[1] if len(texts) else [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + PORTION, "right")) - 1)
        yield batch.column(0).slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo)
        lo = hi


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset [, ids].

    A document is its text's ids and a closing id. Every id lies in one piece; pieces of a sequence
    lie without gaps from offset 0 and hold at most `capacity` ids.

    Null or empty text: the closing id alone. Null doc_id: kept as null. Rows of equal doc_id: packed
    each on its own. Empty table: no rows. Other columns are not read.
    """
    workers_find_package(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        doc, start, ids, total, name, at = zip(*rows, strict=True)
        columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4", copy=False)) for x in ids], pa.int64()), pa.array(total, pa.int64()), pa.array(name, pa.int64()), pa.array(at, pa.int64())]
        if with_ids:
            columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
        return pa.record_batch(columns, names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        bins, rows = HarmonicBins(TaskContext.get().partitionId(), capacity), []
        least = min(LEAST, capacity)
        for batch in batches:
            for names, texts in _portions(batch):
                ids, end = words.encode_column(texts, CLOSING)
                begin = 0
                for doc, stop in zip(names, end.tolist(), strict=True):
                    rows.extend(bins.add(doc, ids[begin:stop], least))
                    begin = stop
                    if len(rows) >= 5000:
                        yield batch_of(rows)
                        rows = []
        rows.extend(bins.finish())
        if rows:
            yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, schema)

