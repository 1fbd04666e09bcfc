"""Removal of passages that occur more than once in a corpus, exact to the byte.

Prefix-free parsing. A rolling hash runs over every text; the grams at which it is least among all
grams of a window of `width` bytes are triggers, and they cut the text into overlapping phrases: a
phrase is all windows that share a trigger, so each window lies whole in one phrase and the order of
the corpus down to depth `width` is that of phrases and of places inside them.

The parse, one row a phrase, is ordered by phrase: entries that stand side by side in its suffix
array with the same phrase share all its windows. The dictionary holds each distinct phrase once,
range-partitioned by trigger; its suffix array is induced. Suffixes that begin at the trigger are
sorted first, and those that begin one byte further left follow from the order of the ones before
and that one byte. A window repeats if its common prefix with a neighbour in that order is `width`
bytes long; bytes are compared, not hashes.

What moves: triggers that two Bloom filters suspect of a second occurrence, one row each; phrases
whose trigger has several, once each; and texts once, to be rewritten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .rolling import Chunk, Prefix, chunks, mix, slices
from .sketches import SeenTwice, filter_bits_for, seen_twice
from .store import Scratch, free_names

U = np.uint64
WIDTH, GRAM = 200, 32
#: Phrases of one trigger whose suffixes one task sorts; windows of triggers with more are counted by their bytes' digests.
GROUP = 1 << 16
#: Phrases sorted together, several triggers at a time.
SORTED = 20_000
NO_ID = -(2**63)
_PLACE = U((1 << 28) - 1)


@dataclass
class Phrases:
    """Phrases of a chunk: text that holds each, first window, windows, trigger's hash, trigger's place."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    trigger: np.ndarray
    owner: np.ndarray


def phrases_of(chunk: Chunk, width: int = WIDTH, gram: int = GRAM) -> Phrases:
    """Every window of `width` bytes lies in one phrase; windows never cross texts."""
    room = np.maximum(0, chunk.end - chunk.start - width + 1)
    total = int(room.sum())
    if not total:
        z = np.zeros(0, np.int64)
        return Phrases(z, z, z, z.astype(np.uint64), z)
    grams = Prefix(chunk.data).windows(gram)
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span, size = width - gram + 1, 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    doc = np.repeat(np.arange(len(chunk)), room)
    at = np.arange(total) - np.repeat(np.cumsum(room) - room, room) + chunk.start[doc]
    owner = (least[at] & _PLACE).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    return Phrases(doc[head], at[head], np.diff(np.append(head, total)), grams[owner[head]], owner[head])


def _row_key(ids: np.ndarray, twins: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(mix(ids.view(np.uint64) ^ (twins.view(np.uint64) * U(3))) + start.astype(np.uint64))


def _digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> pa.Array:
    return pa.array([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())


def common_prefixes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows of bytes."""
    other = left != right
    return np.where(other.any(1), other.argmax(1), left.shape[1])


def suffix_order(data: np.ndarray, part: np.ndarray, trigger: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases by group and by their suffixes at the trigger, and each one's common prefix with the one before (-1: none)."""
    size = np.minimum(end - trigger, width)
    wide = -(-width // 8) * 8
    step = np.arange(wide)
    text = np.where(step < size[:, None], data[np.minimum(trigger[:, None] + step, len(data) - 1)], 0).astype(np.uint8)
    words = text.view(">u8")
    order = np.lexsort((size, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), part))
    text, size, part = text[order], size[order], part[order]
    common = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        same = np.flatnonzero(part[1:] == part[:-1])
        common[same + 1] = np.minimum(common_prefixes(text[same], text[same + 1]), np.minimum(size[same], size[same + 1]))
    return order, common


def repeated_in_dictionary(data: np.ndarray, part: np.ndarray, start: np.ndarray, trigger: np.ndarray, end: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place of the window in it) of every window that another phrase of its group holds too.

    part: groups; start, trigger, end: where each phrase, and its trigger, lie in data. Suffixes are
    ordered at the trigger, and that order is carried left byte by byte: what begins one byte further
    left is sorted by that byte and then as before, and its common prefix with its neighbour is one
    more than the least of those between them.
    """
    left = trigger - start
    order, common = suffix_order(data, part, trigger, end, width)
    group = np.cumsum(common < 0)
    phrases, places = [], []
    back = 0
    while len(order):
        # common prefixes are counted from the trigger on; `back` bytes before it are equal within a group
        hit = common >= width - back
        hit[:-1] |= hit[1:]
        own = order[hit]
        phrases.append(own)
        places.append(left[own] - back)
        # alone in its group: nothing to share
        first = common < 0
        last = np.append(first[1:], True)
        keep = (left[order] > back) & ~(first & last)
        at = np.flatnonzero(keep)
        if not len(at):
            break
        begin = np.append(0, at[:-1] + 1)
        common = np.minimum.reduceat(common[: at[-1] + 1], begin)
        order, group = order[at], group[at]
        back += 1
        key = group.astype(np.int64) << 8 | data[trigger[order] - back]
        by = np.argsort(key, kind="stable")
        key = key[by]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        nearest = np.full(len(key), -1, np.int64)
        old = np.flatnonzero(~new)
        if len(old):
            i, j = by[old - 1] + 1, by[old] + 1
            both = np.stack((i, j), 1).ravel()
            nearest[old] = np.minimum.reduceat(np.append(common, 0), both)[::2]
        common, order, group = nearest, order[by], np.cumsum(new)
    if not phrases:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(phrases), np.concatenate(places)


def runs_of(phrase: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, first place, length) of maximal runs of places."""
    code = np.unique(phrase << 32 | place)
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1] + 1)) if len(code) else np.zeros(0, np.int64)
    return code[first] >> 32, code[first] & 0xFFFFFFFF, np.diff(np.append(first, len(code)))


RUNS = "id long, twin long, start long, count long"
_NAMES = ["id", "twin", "start", "count"]


def repeated_windows(docs: DataFrame, scratch: Scratch, width: int = WIDTH, gram: int = GRAM, filter_bits: int | None = None, group: int = GROUP) -> DataFrame:
    """(id, twin, start, count): runs of windows that also start elsewhere; twin tells texts of one id apart."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("twin"), "text")
    bits = filter_bits or filter_bits_for(docs, 85)
    share = scratch.spark.sparkContext.broadcast

    def triggers(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        for c in chunks(batch.column(2)):
            yield {"trigger": phrases_of(c, width, gram).trigger}

    held = share(seen_twice(texts, triggers, {"trigger": bits})["trigger"].twice)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = SeenTwice.reader(held.value)
        for batch in batches:
            ids, twins = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for c in chunks(batch.column(2)):
                x = phrases_of(c, width, gram)
                k = np.flatnonzero(seen.suspected(x.trigger))
                if len(k):
                    row = c.lo + x.doc[k]
                    key = _digests(c.data.tobytes(), x.start[k], x.start[k] + x.count[k] - 1 + width)
                    columns = [x.trigger[k].view(np.int64), key, ids[row], twins[row], x.start[k] - c.start[x.doc[k]], x.count[k]]
                    yield pa.record_batch([pa.array(v) for v in columns], names=["part", "phrase", *_NAMES])

    parsed = scratch.keep(texts.mapInArrow(parse, f"part long, phrase binary, {RUNS}"), "parse")
    entries = scratch.keep(parsed.groupBy("part", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("id", "twin", "start")).alias("at")), "entries")
    whole = scratch.keep(parsed.join(entries.where("n > 1").select("part", "phrase"), ["part", "phrase"]).select(*_NAMES), "whole")
    scratch.drop(parsed)
    sizes = scratch.keep(entries.groupBy("part").agg(F.count("*").alias("k")).where("k > 1"), "sizes")
    pool = scratch.keep(entries.join(sizes, "part").select("at.id", "at.twin", "at.start"), "pool")
    scratch.drop(entries)

    def members(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        h = _row_key(*(np.asarray(batch.column(k)) for k in range(3)))
        yield {"pool": np.concatenate((h, h))}

    wanted = share(seen_twice(pool, members, {"pool": bits})["pool"].twice)

    def dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = SeenTwice.reader(wanted.value)
        for batch in batches:
            ids, twins = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for c in chunks(batch.column(2)):
                x = phrases_of(c, width, gram)
                row, local = c.lo + x.doc, x.start - c.start[x.doc]
                k = np.flatnonzero(seen.suspected(_row_key(ids[row], twins[row], local)))
                if len(k):
                    raw, a, b = c.data.tobytes(), x.start[k], x.start[k] + x.count[k] - 1 + width
                    own = pa.array([raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
                    columns = [x.trigger[k].view(np.int64), ids[row[k]], twins[row[k]], local[k], (x.owner[k] - a).astype(np.int32)]
                    yield pa.record_batch([*(pa.array(v) for v in columns), own], names=["part", "id", "twin", "start", "place", "own"])

    phrases = scratch.keep(texts.mapInArrow(dictionary, "part long, id long, twin long, start long, place int, own binary"), "dictionary")
    large = scratch.keep(sizes.where(F.col("k") > group).select("part"), "large")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come one behind the other; whole ones are sorted, many at a time."""

        def found(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            own = table.column("own").combine_chunks()
            if isinstance(own, pa.ChunkedArray):
                own = pa.concat_arrays(own.chunks)
            off = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1, 4 * own.offset).astype(np.int64)
            data = np.frombuffer(own.buffers()[2], np.uint8)
            k, place, n = runs_of(*repeated_in_dictionary(data, table.column("part").to_numpy(), off[:-1], off[:-1] + table.column("place").to_numpy(), off[1:], width))
            start = table.column("start").to_numpy()[k] + place
            return pa.record_batch([pa.array(table.column("id").to_numpy()[k]), pa.array(table.column("twin").to_numpy()[k]), pa.array(start), pa.array(n)], names=_NAMES)

        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= SORTED:
                table = pa.Table.from_batches(waiting)
                part = table.column("part").to_numpy()
                # the last group may go on in the next batch
                cut = int(np.searchsorted(part, part[-1]))
                if cut:
                    yield found(table.slice(0, cut))
                    waiting, rows = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
        if rows:
            yield found(pa.Table.from_batches(waiting))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for k, (i, t, s, own) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), batch.column(5), strict=True)):
                raw = own.as_py()
                at = np.arange(len(raw) - width + 1)
                yield pa.record_batch([_digests(raw, at, at + width), pa.array(np.full(len(at), i)), pa.array(np.full(len(at), t)), pa.array(at + s)], names=["window", "id", "twin", "start"])

    ordered = phrases.join(large, "part", "left_anti").repartitionByRange("part").sortWithinPartitions("part").select("part", "id", "twin", "start", "place", "own")
    runs = whole.unionByName(scratch.keep(ordered.mapInArrow(sort, RUNS), "sorted"))
    if large.limit(1).count():
        single = scratch.keep(phrases.join(large, "part", "left_semi").select("part", "id", "twin", "start", "place", "own").mapInArrow(windows, "window binary, id long, twin long, start long"), "windows")
        again = single.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
        runs = runs.unionByName(single.join(again, "window").select("id", "twin", "start", F.lit(1).cast("long").alias("count")))
    scratch.drop(phrases)
    return runs


def drop_repeated_passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, filter_bits: int | None = None, group: int = GROUP) -> DataFrame:
    """docs without each byte that a repeated string of `width` bytes covers.

    Adds n_bytes (before), n_removed, n_spans (maximal removed runs) and kept (the bytes that stay);
    text becomes kept as text, without the halves of characters that were cut.

    Strings are judged on the input, overlaps count, and both occurrences go; matches never cross
    texts. Null text: empty. Texts shorter than `width`: untouched. Null doc_id and rows of equal
    doc_id: each row is a text of its own, equal rows are repeats of each other. Empty table: no
    rows. Columns named like the new ones give way; others of any name pass through; n_chars, if
    there, is counted anew. filter_bits: of each Bloom filter, by default by the size of docs.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    base = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    one, other, starts, counts = free_names(base.columns, "id", "twin", "start", "count")
    runs = repeated_windows(base, scratch, width, gram, filter_bits, group).groupBy(F.col("id").alias(one), F.col("twin").alias(other)).agg(F.collect_list("start").alias(starts), F.collect_list("count").alias(counts))
    keyed = base.withColumns({one: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), other: F.xxhash64("text")})
    joined = keyed.join(runs, [one, other], "left").drop(one, other)
    names = base.columns
    place = [n.lower() for n in names].index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", n_bytes long, n_removed long, n_spans long, kept binary"

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            starts, counts = batch.column(len(names)), batch.column(len(names) + 1)
            has = np.asarray(starts.is_valid())
            kept, removed, spans = np.empty(batch.num_rows, object), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            size = np.zeros(batch.num_rows, np.int64)
            for c in chunks(batch.column(place)):
                size[c.lo : c.hi] = c.end - c.start
                for j in range(len(c)):
                    i, own = c.lo + j, c.data[c.start[j] : c.end[j]]
                    if has[i]:
                        s, n = np.asarray(starts[i].values), np.asarray(counts[i].values)
                        edge = np.zeros(len(own) + 1, np.int64)
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + n - 1 + width, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        removed[i] = gone.sum()
                        spans[i] = gone[0] + (gone[1:] & ~gone[:-1]).sum()
                        own = own[~gone]
                    kept[i] = own.tobytes()
            out = [batch.column(k) for k in range(len(names))]
            out[place] = pa.array([x.decode("utf-8", "ignore") if n else x.decode() for x, n in zip(kept, removed, strict=True)], pa.string())
            yield pa.record_batch([*out, pa.array(size), pa.array(removed), pa.array(spans), pa.array(list(kept), pa.binary())], names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])

    out = joined.mapInArrow(rewrite, fields)
    if "n_chars" in [n.lower() for n in names]:
        out = out.withColumn("n_chars", F.length("text").cast(base.schema[[n.lower() for n in names].index("n_chars")].dataType))
    return out
