"""Merkle manifest of a dataset: a tree a group of rows, a tree over the groups, a path for every row.

Positions come from a radix trie over the keys: histograms of leading digits, level by level, until no
prefix holds more than PREFIX_ROWS keys. What stands before a prefix is what stands before its parent plus
the parent's smaller digits, so ranks are exact and nothing is sorted as a whole. Ranks, written in the
base of the fanout, key the nodes of the hash tree; nodes meet by their longest common prefix, a block of
several levels at a time, and paths come back down the same blocks.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import Scratch

FANOUT = 3
#: Keys that one window may hold, and leaves that one block may hold.
PREFIX_ROWS, BLOCK_ROWS = 512, 128
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"
#: Blocks that equal rows in a row of their own are dealt out to at once.
SPAN = 4096


def field_text(value: Column) -> Column:
    """'-' for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(field_text(v) for v in values)).cast("binary"), 256)


def ordered_text(value: Column) -> Column:
    """A long as text of equal length in the same order; null first."""
    shown = F.lpad(F.hex(value.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.when(value.isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), shown))


def ranked(scratch: Scratch, items: DataFrame, bound: int = PREFIX_ROWS) -> tuple[DataFrame, int]:
    """items (g, key, n, ...) with `at`, the rows of its group before it, and `size`, all of them; and the largest size.

    Keys are ASCII text, distinct within a group; n is how many rows a key stands for.
    """
    prefix = lambda length: F.substring("key", 1, length)
    low, high, longest = items.agg(F.min("key"), F.max("key"), F.max(F.length("key"))).first()
    common = len(os.path.commonprefix([low, high]))
    lengths = [common]
    while True:
        most = items.groupBy("g", prefix(lengths[-1]).alias("p")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).agg(F.max("k"), F.max("n")).first()
        if len(lengths) == 1:
            largest = most[1]
        if most[0] <= bound or lengths[-1] >= longest:
            break
        lengths.append(lengths[-1] + 2)
    finest = scratch.keep(items.groupBy("g", prefix(lengths[-1]).alias("p")).agg(F.sum("n").alias("n")), "histogram")
    starts = finest.groupBy("g").agg(F.sum("n").alias("size")).withColumn("p", F.lit(low[:common])).withColumn("at", F.lit(0).cast("long"))
    before = lambda order: F.coalesce(F.sum("n").over(Window.partitionBy("g", "up").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for length in lengths[1:]:
        level = finest.groupBy("g", F.substring("p", 1, length).alias("p")).agg(F.sum("n").alias("n"))
        level = level.withColumn("up", F.substring("p", 1, length - 2)).withColumn("less", before("p"))
        starts = level.join(starts.select("g", F.col("p").alias("up"), "at", "size"), ["g", "up"]).select("g", "p", (F.col("at") + F.col("less")).alias("at"), "size")
    out = items.withColumn("up", prefix(lengths[-1])).withColumn("less", before("key"))
    out = out.join(starts.select("g", F.col("p").alias("up"), "at", "size"), ["g", "up"])
    return out.withColumn("at", F.col("at") + F.col("less")).drop("up", "less"), largest


def _levels_a_block(fanout: int) -> int:
    return max(1, max(k for k in range(1, 64) if k == 1 or fanout**k <= BLOCK_ROWS))


def _depth(size: Column, fanout: int) -> Column:
    """Rounds until one node is left."""
    powers = [fanout**k for k in range(63) if fanout**k < 2**62]
    return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in powers)), lambda p: p < size))


def _block(nodes: DataFrame, done: int, fanout: int) -> DataFrame:
    """nodes (g, depth, at, n, hash, row) as blocks: rows, the hashes of each level, and the node on top."""
    per = _levels_a_block(fanout)
    width = fanout**per
    wide = width * SPAN
    floor = lambda x, by: F.expr(f"({x}) div {by}")
    spans = nodes.withColumn("span", F.explode(F.sequence(floor("at", wide), floor("at + n - 1", wide))))
    pieces = spans.withColumn("block", F.explode(F.sequence(floor(f"greatest(at, span * {wide})", width), floor(f"least(at + n, (span + 1) * {wide}) - 1", width))))
    lo = F.greatest("at", F.col("block") * width)
    count = (F.least(F.col("at") + F.col("n"), (F.col("block") + 1) * width) - lo).cast("int")
    grouped = pieces.groupBy("g", "depth", "block").agg(F.sort_array(F.collect_list(F.struct(lo.alias("lo"), count.alias("count"), "hash", "row"))).alias("runs"))
    spread = lambda name: F.flatten(F.transform("runs", lambda x: F.array_repeat(x[name], x["count"])))
    out = grouped.select("g", "depth", "block", F.least(F.lit(per), F.col("depth") - done).alias("levels"), spread("row").alias("rows"), spread("hash").alias("h0"))
    def joined(below: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.expr(f"cast((size({below}) - 1) div {fanout} as int)")), lambda i: F.sha2(F.array_join(F.slice(below, i * fanout + 1, fanout), "").cast("binary"), 256))

    for k in range(per):
        out = out.withColumn(f"h{k + 1}", F.when(F.lit(k) < F.col("levels"), joined(f"h{k}")).otherwise(F.col(f"h{k}")))
    return out.select("g", "depth", "block", "levels", "rows", F.array(*(f"h{k}" for k in range(per))).alias("hashes"), F.col(f"h{per}")[0].alias("top"))


def climb(scratch: Scratch, runs: DataFrame, largest: int, fanout: int) -> list[DataFrame]:
    """Blocks of runs (g, at, size, n, hash, row), the lowest first; each is written before the next reads it."""
    per, out = _levels_a_block(fanout), []
    nodes = runs.withColumn("depth", _depth(F.col("size"), fanout)).select("g", "depth", "at", "n", "hash", "row")
    while True:
        out.append(scratch.keep(_block(nodes, per * len(out), fanout), "blocks"))
        if fanout ** (per * len(out)) >= largest:
            return out
        nodes = out[-1].where(F.col("depth") > per * len(out)).select("g", "depth", F.col("block").alias("at"), F.lit(1).cast("long").alias("n"), F.col("top").alias("hash"), F.lit(0).alias("row"))


def tops(blocks: list[DataFrame], fanout: int) -> DataFrame:
    """(g, top) of each group's tree."""
    per = _levels_a_block(fanout)
    out = [b.where(F.col("depth") <= per * (k + 1)).select("g", "top") for k, b in enumerate(blocks)]
    for x in out[1:]:
        out[0] = out[0].unionAll(x)
    return out[0]


def descend(blocks: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """row, hash, at and path of every leaf, with the columns of above (g, path, ...), the paths from the groups' tops on."""
    per = _levels_a_block(fanout)
    width = fanout**per
    others = [c for c in above.columns if c not in ("g", "path")]
    paths = None
    for k in reversed(range(len(blocks))):
        ended = F.col("depth") <= per * (k + 1)
        b = blocks[k].where(ended).join(above, "g")
        if paths is not None:
            b = b.unionByName(blocks[k].where(~ended).join(paths.withColumnRenamed("at", "block"), ["g", "block"]))

        def own(j: Column) -> Column:
            steps = []
            for level in range(per):
                place = F.floor(j / F.lit(fanout**level)).cast("int")
                inside = place % fanout
                row = F.col("hashes")[level]
                steps.append(F.struct(F.array_join(F.slice(row, place - inside + 1, inside), "").alias("before"), F.array_join(F.slice(row, place + 2, fanout - 1 - inside), "").alias("after")))
            return F.concat(F.slice(F.array(*steps), F.lit(1), F.col("levels")), F.col("path"))

        member = lambda j: F.struct((F.col("block") * width + j).alias("at"), F.col("rows")[j].alias("row"), F.col("hashes")[0][j].alias("hash"), own(j).alias("path"))
        paths = b.select("g", *others, F.inline(F.transform(F.sequence(F.lit(0), F.size(F.col("rows")) - 1), member)))
        if k:
            paths = paths.drop("row", "hash")
    return paths


def proof_digest(path: str) -> Column:
    """Digest of all siblings on a path, from the leaf's level to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def fold(leaf: Column, path: str) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, source, position, leaf, turned, subroot, root and path (siblings before and after, from the leaf up) of every row.

    A leaf is the digest of FIELDS. Leaves of a source ascend by doc_id, null first, those of equal doc_id
    by leaf; `fanout` consecutive nodes become one until one is left; subroots ascend by source, null
    first, and become the root likewise. turned is the leaf with `tampered` in the place of text. Equal
    rows are leaves of their own side by side; a source that holds most rows, a doc_id of many rows
    and many copies of one row are split by longer prefixes and by runs. Null or empty columns: marked
    differently in the leaf. Empty table: no rows. Other columns are not read.
    """
    if fanout < 2:
        raise ValueError("a node must join two others at least")
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    values = {c: F.col(f"`{c}`") for c in FIELDS}
    turned = digest(*(values | {"text": F.col("text") if tampered is None else tampered}).values())
    leaves = docs.select(
        F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source").cast("string"))).alias("g"),
        F.col("doc_id").cast("long").alias("doc_id"), digest(*values.values()).alias("leaf"), turned.alias("turned"),
    )
    items = leaves.groupBy("g", "doc_id", "leaf").agg(F.max("turned").alias("turned"), F.count("*").alias("n"))
    items = scratch.keep(items.select("g", F.concat(ordered_text(F.col("doc_id")), "leaf").alias("key"), "n", F.col("leaf").alias("hash"), F.struct("doc_id", F.when(F.col("turned") != F.col("leaf"), F.col("turned")).alias("turned")).alias("row")), "leaves")
    schema = f"doc_id long, source string, position long, leaf string, turned string, subroot string, root string, path {PATH}"
    if items.isEmpty():
        return spark.createDataFrame([], schema)
    trees = climb(scratch, *ranked(scratch, items), fanout)
    groups = scratch.keep(tops(trees, fanout).select(F.lit("").alias("g"), F.hex(F.col("g").cast("binary")).alias("key"), F.lit(1).cast("long").alias("n"), F.col("top").alias("hash"), F.struct("g").alias("row")), "groups")
    crown = climb(scratch, *ranked(scratch, groups), fanout)
    root = tops(crown, fanout).withColumnRenamed("top", "root").withColumn("path", F.array().cast(PATH))
    above = scratch.keep(descend(crown, root, fanout).select(F.col("row.g").alias("g"), "path", F.col("hash").alias("subroot"), "root"), "paths")
    out = descend(trees, above, fanout)
    source = F.when(F.col("g") != "0", F.substring("g", 2, 2**31 - 1))
    return out.select("row.doc_id", source.alias("source"), F.col("at").alias("position"), F.col("hash").alias("leaf"), F.coalesce("row.turned", "hash").alias("turned"), "subroot", "root", "path")


def without_line_ends(doc_id: str = "doc_id", text: str = "text") -> Column:
    """text without \\n where 2 divides crc32 of the id as text (null: of empty text), else as it is."""
    even = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))
