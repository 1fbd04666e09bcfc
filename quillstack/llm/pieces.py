"""SentencePiece encoding with byte offsets, and decoding.

The model file is read here, not by a library. Text is normalised by the longest prefix that the
compiled character map holds, and every normalised character remembers the source bytes it came
from; pieces are merged on the normalised text and projected back to spans of source bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import LONGEST, PairTable
from .rolling import slices
from .store import workers_find_package

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHED = 200_000
_SIGNS = {chr(i) for i in range(128) if not chr(i).isalpha()}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 1:
            yield tag >> 3, data[at : at + 8]
            at += 8
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            yield tag >> 3, data[at : at + 4]
            at += 4


class CharacterMap:
    """A compiled character map: a double-array trie of source strings and a pool of replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.pool = blob[4 + size :] if size else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes matched at `at`, and what replaces them."""
        units = self.units
        if not units:
            return None
        node, found = 0, None
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = k + 1 - at, value
        if found is None:
            return None
        n, value = found
        return n, self.pool[value : self.pool.index(0, value)]


@dataclass
class Piece:
    id: int
    text: str
    start: int
    end: int


@dataclass
class Encoded:
    """Ids of a text, source bytes of each, the ids as text, and what they decode to."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    line: str
    decoded: str


class PieceModel:
    """Encoder and decoder of a BPE model file, ids as the public library gives them."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.map = CharacterMap(b"")
        self.prefix = self.squeeze = self.escape = True
        self.byte_fallback, self.unknown_surface, kind, self.suffix = False, " ⁇ ", 1, False
        for k, v in _fields(data):
            if k == 1:
                text, score, t = "", 0.0, NORMAL
                for a, b in _fields(v):
                    if a == 1:
                        text = b.decode()
                    elif a == 2:
                        score = struct.unpack("<f", b)[0]
                    elif a == 3:
                        t = b
                self.pieces.append(text)
                self.kinds.append(t)
                scores.append(score)
            elif k == 2:
                for a, b in _fields(v):
                    if a == 3:
                        kind = b
                    elif a == 24:
                        self.suffix = bool(b)
                    elif a == 35:
                        self.byte_fallback = bool(b)
                    elif a == 44:
                        self.unknown_surface = b.decode()
            elif k == 3:
                for a, b in _fields(v):
                    if a == 2:
                        self.map = CharacterMap(b)
                    elif a == 3:
                        self.prefix = bool(b)
                    elif a == 4:
                        self.squeeze = bool(b)
                    elif a == 5:
                        self.escape = bool(b)
        if kind != 2 or self.suffix:
            raise ValueError("only BPE models with white space before words are read")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.kinds, strict=True)) if t in (NORMAL, USER, UNUSED)}
        self.rank = {p: (-scores[i], i) for p, i in self.ids.items()}
        self.user = sorted((p for p, i in self.ids.items() if self.kinds[i] == USER), key=len, reverse=True)
        self.unused = {p for p, i in self.ids.items() if self.kinds[i] == UNUSED}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.kinds, strict=True)) if t == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        #: words never join if no piece has the mark of a space behind something else
        self.apart = not self.user and not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: of each part: its ids and the characters that each covers, as bytes of numbers, the ids as text, and what they decode to
        self.parts: dict[str, tuple[bytes, bytes, str, str]] = {}
        self._cut = re.compile(self._parts_pattern())
        self._pairs: PairTable | None = None

    def _parts_pattern(self) -> str:
        """Parts that pieces never reach across: none has a space's mark behind other characters; a cut
        between other characters and an ASCII sign, and around line ends, is made where no piece has that."""
        if any("\n" in p or any(x not in _SIGNS and x != SPACE and y in _SIGNS for x, y in zip(p, p[1:], strict=False)) for p in self.ids):
            return f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        sign = re.escape("".join(sorted(_SIGNS - {"\n"})))
        rest = f"[^{sign}\n{SPACE}]"
        return f"{SPACE}+[{sign}]*{rest}*|[{sign}]+{rest}*|{rest}+|\n"

    def _table(self) -> PairTable:
        if self._pairs is None:
            steps = {s: k for k, s in enumerate(sorted({r[0] for r in self.rank.values()}))}
            rows = [(a, b, steps[self.rank[p][0]], i) for p, i in self.ids.items() for k in range(1, len(p)) if (a := self.ids.get(p[:k])) is not None and (b := self.ids.get(p[k:])) is not None]
            self._pairs = PairTable(*(np.array(x) for x in zip(*rows, strict=True)))
            self._symbol = np.full(0x110000, -1, np.int32)
            for p, i in self.ids.items():
                if len(p) == 1:
                    self._symbol[ord(p)] = i
            self._shown = [str(i) for i in range(len(self.pieces))]
            self._surface = [p.replace(SPACE, " ") for p in self.pieces]
            self._length = np.array([len(p) for p in self.pieces], np.int16)
        return self._pairs

    def learn(self, parts: set[str]) -> None:
        """Encode parts that are not known yet, all at once."""
        if len(self.parts) >= CACHED:
            self.parts.clear()
        new = list(parts.difference(self.parts))
        if not new:
            return
        table = self._table()
        size = np.fromiter(map(len, new), np.int64, len(new))
        points = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat = self._symbol[points]
        # a character without a piece joins nothing: below -1, and its bytes at the end
        flat = np.where(flat < 0, -2 - points.astype(np.int32), flat)
        plain = (size <= LONGEST) & (not self.user and not self.unused and self.byte_fallback)
        ids, n = table.merge_all(flat[np.repeat(plain, size)], size[plain])
        shown, surface, length, at = self._shown, self._surface, self._length, 0
        raw, own, cover = ids.astype(np.int32).tobytes(), ids.tolist(), length[np.maximum(ids, 0)].tobytes()
        strange = np.zeros(len(n), bool)
        strange[np.repeat(np.arange(len(n)), n)[ids < 0]] = True
        for k, m, odd in zip(np.flatnonzero(plain).tolist(), n.tolist(), strange.tolist(), strict=True):
            got = own[at : at + m]
            if odd:
                listed, covered = [], []
                for i in got:
                    code = [i] if i >= 0 else [self.bytes[b] for b in chr(-2 - i).encode()]
                    listed += code
                    covered += [int(length[i]) if i >= 0 else 1, *[0] * (len(code) - 1)]
                self._keep(new[k], listed, covered)
            else:
                self.parts[new[k]] = raw[4 * at : 4 * (at + m)], cover[2 * at : 2 * (at + m)], ",".join([shown[i] for i in got]), "".join([surface[i] for i in got])
            at += m
        for k in np.flatnonzero(~plain).tolist():
            self._keep(new[k], *self.merge(new[k]))

    def _keep(self, part: str, ids: list[int], cover: list[int]) -> None:
        self.parts[part] = np.array(ids, np.int32).tobytes(), np.array(cover, np.int16).tobytes(), ",".join(map(str, ids)), self.decode(ids, False)

    def normalise(self, text: str) -> tuple[str, list[int], list[int]]:
        """Normalised text, and the source bytes (start, end) of each of its characters."""
        data = text.encode()
        out: list[tuple[str, int, int]] = []
        at = 0
        if not self.map.units:
            for ch in text:
                n = len(ch.encode())
                out.append((ch, at, at + n))
                at += n
        while at < len(data) and self.map.units:
            hit = self.map.longest(data, at)
            if hit is None:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                hit = n, data[at : at + n]
            n, new = hit
            out.extend((ch, at, at + n) for ch in new.decode())
            at += n
        if self.squeeze:
            kept: list[tuple[str, int, int]] = []
            for x in out:
                if x[0] != " " or kept and kept[-1][0] != " ":
                    kept.append(x)
            while kept and kept[-1][0] == " ":
                kept.pop()
            out = kept
        # also before what the map leaves nothing of, unless spaces at the end go
        if self.prefix and (out or data and not self.squeeze):
            at = out[0][1] if out else 0
            out.insert(0, (" ", at, at))
        mark = SPACE if self.escape else " "
        return "".join(mark if ch == " " else ch for ch, _, _ in out), [s for _, s, _ in out], [e for _, _, e in out]

    def _symbols(self, text: str) -> list[str]:
        if not self.user:
            return list(text)
        out, at = [], 0
        while at < len(text):
            own = next((u for u in self.user if text.startswith(u, at)), text[at])
            out.append(own)
            at += len(own)
        return out

    def merge(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a piece of normalised text, and the characters that each covers.

        The best pair of neighbours joins first, the leftmost of equals. Characters without a piece
        become their bytes: the first id covers the character, the others nothing.
        """
        part: list[str | None] = list(self._symbols(text))
        rank = self.rank
        n = len(part)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (r := rank.get(part[i] + part[j])) is not None:
                heap.append((r[0], i, j, part[i] + part[j]))

        frozen = {i for i, p in enumerate(part) if self.user and p in self.user}
        for i in range(n - 1):
            if i not in frozen and i + 1 not in frozen:
                offer(i, i + 1)
        heapq.heapify(heap)
        made: dict[str, tuple[str, str]] = {}
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if part[i] is None or part[j] is None or after[i] != j or part[i] + part[j] != whole:
                continue
            if whole in self.unused:
                made[whole] = part[i], part[j]
            part[i], part[j] = whole, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and a not in frozen and b not in frozen and (r := rank.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r[0], a, b, part[a] + part[b]))
        ids: list[int] = []
        cover: list[int] = []

        def put(p: str) -> None:
            if p in self.unused and p in made:
                for x in made[p]:
                    put(x)
                return
            if (i := self.ids.get(p)) is not None:
                ids.append(i)
                cover.append(len(p))
            elif self.byte_fallback:
                raw = p.encode()
                ids.extend(self.bytes[b] for b in raw)
                cover.extend([len(p), *[0] * (len(raw) - 1)])
            else:
                ids.append(self.unknown)
                cover.append(len(p))

        for p in part:
            if p is not None:
                put(p)
        return ids, cover

    def aligned(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """normalise(); where the map is empty and nothing is squeezed, without a loop over characters."""
        if self.map.units or self.squeeze:
            norm, start, end = self.normalise(text)
            return norm, np.array(start, np.int64), np.array(end, np.int64)
        data = np.frombuffer(text.encode(), np.uint8)
        start = np.flatnonzero((data & 0xC0) != 0x80)
        end = np.append(start[1:], len(data)) if len(start) else start
        if self.prefix and len(start):
            start, end = np.concatenate((start[:1], start)), np.concatenate((start[:1], end))
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text, start, end

    def encode_all(self, texts: list[str]) -> Iterator[Encoded]:
        """Ids of each text with the source bytes that each stands for; bytes of one character share its span.

        Parts that pieces never reach across are merged once each, and projected wherever they stand.
        """
        norms = [self.aligned(t) for t in texts]
        cut = [self._cut.findall(x) if self.apart else [x] * bool(x) for x, _, _ in norms]
        self.learn(set().union(*cut))
        known = self.parts
        for (_, start, end), own in zip(norms, cut, strict=True):
            ids, cover, lines, surfaces = zip(*[known[p] for p in own], strict=True) if own else ((), (), (), ())
            size = np.frombuffer(b"".join(cover), np.int16).astype(np.int64)
            last = np.cumsum(size)
            first = last - np.maximum(size, 1)
            numbers = np.frombuffer(b"".join(ids), np.int32)
            back = self.decode(numbers.tolist()) if self.squeeze else "".join(surfaces)
            if self.prefix and not self.squeeze and back.startswith(" "):
                back = back[1:]
            yield Encoded(numbers, start[first], end[last - 1], ",".join(lines), back)

    def encode(self, text: str) -> list[Piece]:
        """Pieces of text with the source bytes that each stands for."""
        got = next(self.encode_all([text]))
        return [Piece(i, self.pieces[i], s, e) for i, s, e in zip(got.ids.tolist(), got.start.tolist(), got.end.tolist(), strict=True)]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids. first: at the start of a text, where one mark of a space is dropped."""
        out: list[str] = []
        raw = bytearray()

        def flush() -> None:
            at = 0
            while at < len(raw):
                lead = raw[at]
                n = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                except UnicodeDecodeError:
                    out.append("�")
                    at += 1
            raw.clear()

        fresh = first and (self.prefix or self.squeeze)
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                fresh = False
                continue
            flush()
            kind, p = self.kinds[i], self.pieces[i]
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(self.unknown_surface)
            else:
                if fresh and p.startswith(SPACE):
                    p = p[1:]
                    if self.squeeze:
                        p = p.lstrip(SPACE)
                out.append(p.replace(SPACE, " "))
            fresh = False
        flush()
        return "".join(out)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, starts, ends: ids of each whole text and the source bytes that each stands for.

    Null or empty text: empty lists. Rows of equal or null doc_id: each on its own. Other columns are not read.
    """
    workers_find_package(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_path)
        for batch in batches:
            for part in slices([batch]):
                got = list(own.encode_all([t or "" for t in part.column(1).to_pylist()]))
                lists = [pa.array([getattr(x, k).astype(np.int32) for x in got], pa.list_(pa.int32())) for k in ("ids", "start", "end")]
                yield pa.record_batch([part.column(0), *lists], names=["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of each row of ids; null ids give an empty text."""
    workers_find_package(encoded.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 of each whole text's encoding, without moving the ids.

    spans_sha256 is of the starts and then the ends of all pieces' source bytes, as little-endian
    32-bit numbers. Null text: as an empty one. Rows of equal or null doc_id: each on its own. Very
    long texts are one row. Empty table: no rows. Other columns, of whatever names, are not read.
    """
    workers_find_package(docs.sparkSession)

    def row(x: Encoded) -> tuple[int, str, str, str]:
        sha = lambda data: hashlib.sha256(data).hexdigest()
        return len(x.ids), sha(x.line.encode()), sha(x.decoded.encode()), sha(x.start.astype("<i4").tobytes() + x.end.astype("<i4").tobytes())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_path)
        for part in slices(batches):
            n, *shas = zip(*map(row, own.encode_all([t or "" for t in part.column(1).to_pylist()])), strict=True)
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), *map(pa.array, shas)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
