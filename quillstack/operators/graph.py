"""Hierarchies, components and orders."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import shared_folder


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, ancestor, depth): every ancestor of every node at its least depth.

    Each round joins only the pairs that the last one found with the edges, once each, and leaves out
    those that are known, so that rounds are as many as the longest shortest way up and neither
    parallel ways nor circles multiply work. A node in a circle is an ancestor of itself. New pairs
    are written between rounds.
    """
    shared_folder(edges.sparkSession)
    own = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node is not null and ancestor is not null").distinct().checkpoint()
    up = own.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"))
    known = new = own.withColumn("depth", F.lit(1))
    depth = 1
    while True:
        depth += 1
        found = new.select("node", "ancestor").join(up, "ancestor").select("node", F.col("above").alias("ancestor")).distinct()
        new = found.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if not new.limit(1).count():
            return known
        known = known.unionByName(new)


def ways_up(edges: DataFrame, starts: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, way): every way up from each of starts (node), link by link, as the values on it; each beginning of a way is one too.

    A round lengthens the last one's ways by a link and is written; a way ends where it would come to a value
    that it holds already, so that circles end. Ways can be many where parents are: starts are few.
    """
    shared_folder(edges.sparkSession)
    up = edges.select(F.col(child).alias("at"), F.col(parent).alias("above")).where("at is not null and above is not null").distinct().checkpoint()
    new = starts.select("node").distinct().join(up, F.col("node") == F.col("at")).where("above <> node").select("node", "above", F.array("node", "above").alias("way")).checkpoint()
    out = new
    while new.limit(1).count():
        longer = new.select("node", F.col("above").alias("at"), "way").join(up, "at").where(~F.array_contains("way", F.col("above")))
        new = longer.select("node", "above", F.concat("way", F.array("above")).alias("way")).checkpoint()
        out = out.unionByName(new)
    return out.select("node", "way")


#: Items that share one copy of what follows from their answers, and values of a list of it.
ITEMS_A_COPY, VALUES_A_LIST = 2000, 1000


def expand_answers(said: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(item, value, added) over a hierarchy: yes reaches all ancestors, no all descendants.

    No stands above yes, and a direct word above what follows from others, except that a no above
    takes the whole subtree. What follows is worked out once for all items that said the same, and handed
    to each as lists, so that no row of the result is shuffled.
    """
    shared_folder(said.sparkSession)
    own = said.where("added is not null").groupBy("item").agg(F.sort_array(F.collect_set(F.struct("value", "added"))).alias("said"))
    own = own.withColumn("mark", F.sha2(F.to_json("said"), 256)).checkpoint()
    kinds = own.groupBy("mark").agg(F.first("said").alias("said"), F.ceil(F.count("*") / ITEMS_A_COPY).cast("int").alias("copies"))
    each = kinds.select(F.col("mark").alias("item"), F.inline("said"))
    yes, no = each.where("added"), each.where("not added")
    up = yes.join(ancestors, yes["value"] == ancestors["node"]).select("item", F.col("ancestor").alias("value"))
    down = no.join(ancestors, no["value"] == ancestors["ancestor"]).select("item", F.col("node").alias("value"))
    rows = [
        (no.select("item", "value"), 4, False),
        (down, 3, False),
        (yes.select("item", "value"), 2, True),
        (up, 1, True),
    ]
    every = None
    for df, rank, added in rows:
        one = df.select("item", "value", F.lit(rank).alias("rank"), F.lit(added).alias("added"))
        every = one if every is None else every.unionByName(one)
    every = every.groupBy(F.col("item").alias("mark"), "value").agg(F.max_by("added", "rank").alias("added"))
    parts = every.groupBy("mark").agg(F.ceil(F.count("*") / VALUES_A_LIST).alias("parts"))
    lists = every.join(parts, "mark").groupBy("mark", F.pmod(F.xxhash64("value"), "parts").alias("part")).agg(F.collect_list(F.struct("value", "added")).alias("list"))
    copied = lists.join(kinds.select("mark", "copies"), "mark").select("mark", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "list")
    dealt = own.join(kinds.select("mark", "copies"), "mark").select("item", "mark", F.pmod(F.xxhash64("item"), "copies").cast("int").alias("copy"))
    tasks = int(said.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # so many tasks in any case, as few rows go in and many come out
    return dealt.repartition(tasks, "mark", "copy").join(copied.hint("shuffle_hash"), ["mark", "copy"]).select("item", F.inline("list"))


def close_values(values: DataFrame, ancestors: DataFrame, rejected: DataFrame) -> DataFrame:
    """Values of items with all their ancestors, without those rejected."""
    up = values.join(ancestors, values["value"] == ancestors["node"]).select("item", F.col("ancestor").alias("value"))
    return values.select("item", "value").unionByName(up).distinct().join(rejected.select("item", "value"), ["item", "value"], "left_anti")


def redundant_edges(edges: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Edges child → parent whose parent is also an ancestor of another parent of the child."""
    other = edges.select("child", F.col("parent").alias("via"))
    return edges.join(other, "child").where("parent <> via").join(ancestors, (F.col("via") == F.col("node")) & (F.col("parent") == F.col("ancestor"))).select("child", "parent").distinct()


def meeting_points(edges: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(node, a, b, meeting, reach): where each two parents of a node meet, at the least of the greater of both ways up.

    A parent may itself be the meeting point. Pairs are those of one node's parents.
    """
    several = edges.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").select(F.col("child").alias("node"))
    direct = edges.select(F.col("child").alias("node"), F.col("parent").alias("via")).join(several, "node")
    up = direct.join(ancestors.select(F.col("node").alias("via"), F.col("ancestor").alias("m"), "depth"), "via").select("node", "via", "m", "depth")
    own = direct.select("node", "via", F.col("via").alias("m"), F.lit(0).alias("depth")).unionByName(up)
    a, b = own.select("node", "m", F.col("via").alias("a"), F.col("depth").alias("da")), own.select("node", "m", F.col("via").alias("b"), F.col("depth").alias("db"))
    best = F.min(F.struct(F.greatest("da", "db").alias("reach"), (F.col("da") + F.col("db")).alias("sum"), F.col("m")))
    return a.join(b, ["node", "m"]).where("a < b").groupBy("node", "a", "b").agg(best.alias("best")).select("node", "a", "b", F.col("best.m").alias("meeting"), F.col("best.reach").alias("reach"))


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest node of each component, by alternating large and small stars.

    Rounds go on until every node hangs on one root. Links are checkpointed each round and shrink as
    they turn into stars; a hub's links meet only in partial minima and in joins that can be split.
    A pair of a node with itself makes it a component of its own; null ends are left out.
    """
    shared_folder(pairs.sparkSession)
    every = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    links = every.where("u <> v").distinct().checkpoint()

    def step(e: DataFrame, large: bool) -> DataFrame:
        near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = near.join(low, "u").where("v > u" if large else "true").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    while True:
        roots = links.select(F.col("v").alias("u")).distinct()
        loose = links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").unionByName(links.select("u").join(roots, "u", "left_semi"))
        if not loose.limit(1).count():
            break
        links = step(step(links, True), False).checkpoint()
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    alone = every.where("u = v").select(F.col("u").alias("node")).distinct().join(stars.select("node"), "node", "left_anti")
    return stars.unionByName(alone.withColumn("component", F.col("node")))


def rebound(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Links (child, parent) after merges (node, into): both ends moved, once each, none to itself."""
    a = merges.select(F.col("node").alias("child"), F.col("into").alias("a"))
    b = merges.select(F.col("node").alias("parent"), F.col("into").alias("b"))
    out = edges.join(a, "child", "left").join(b, "parent", "left").select(F.coalesce("a", "child").alias("child"), F.coalesce("b", "parent").alias("parent"))
    return out.where("child <> parent").distinct()


def closing_circles(asked: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Links of asked(child, parent, ...) whose parent lies below the child already, or is the child."""
    below = ancestors.select(F.col("node").alias("parent"), F.col("ancestor").alias("child"))
    return asked.join(below, ["child", "parent"], "left_semi").unionByName(asked.where("child = parent"))


def around(edges: DataFrame, seeds: list[str], steps: int) -> DataFrame:
    """(node, step): nodes within so many links of the seeds, in either direction, at their least distance."""
    shared_folder(edges.sparkSession)
    both = edges.select(F.col("child").alias("at"), F.col("parent").alias("to")).unionByName(edges.select(F.col("parent").alias("at"), F.col("child").alias("to")))
    known = new = edges.sparkSession.createDataFrame([(s, 0) for s in seeds], "node string, step int")
    for step in range(1, steps + 1):
        found = new.select(F.col("node").alias("at")).join(both, "at").select(F.col("to").alias("node")).distinct()
        new = found.join(known.select("node"), "node", "left_anti").withColumn("step", F.lit(step)).checkpoint()
        known = known.unionByName(new)
    return known


def merged_into(merges: DataFrame) -> DataFrame:
    """(gone, into): where a chain of merges ends."""
    ends = closure(merges, "gone", "into")
    return ends.groupBy("node").agg(F.max_by("ancestor", "depth").alias("into")).withColumnRenamed("node", "gone")


def topological(works: Iterable[int], pairs: Iterable[tuple[int, int]]) -> list[int]:
    """works so that of every pair the first comes first, smallest work first where pairs leave a choice.

    Pairs are taken in order; one that would close a circle is passed over.
    """
    after: dict[int, set[int]] = {w: set() for w in works}

    def reaches(a: int, b: int) -> bool:
        stack, seen = [a], set()
        while stack:
            x = stack.pop()
            if x == b:
                return True
            if x not in seen:
                seen.add(x)
                stack.extend(after[x])
        return False

    for a, b in pairs:
        if a in after and b in after and a != b and not reaches(b, a):
            after[a].add(b)
    waiting = {w: 0 for w in after}
    for targets in after.values():
        for t in targets:
            waiting[t] += 1
    out: list[int] = []
    while len(out) < len(after):
        w = min(x for x, n in waiting.items() if n == 0)
        out.append(w)
        del waiting[w]
        for t in after[w]:
            waiting[t] -= 1
    return out


def series_order(places: DataFrame) -> DataFrame:
    """(series, work, place) from (series, site, work, number): sites that number more works speak first.

    A series comes as one row of lists, so that many small ones go through Python in batches.
    """

    def order(lines: Iterable) -> list[int]:
        by: dict[int, list[tuple[int, int]]] = {}
        for x in lines:
            if x["site"] is not None:
                by.setdefault(x["site"], []).append((x["number"], x["work"]))
        pairs: list[tuple[int, int]] = []
        for _, _, site in sorted((-len({w for _, w in own}), -sum(n for n, _ in own), site) for site, own in by.items()):
            line = [w for _, w in sorted(by[site])]
            pairs += list(zip(line, line[1:], strict=False))
        return topological(sorted({x["work"] for x in lines}), pairs)

    def task(batches):  # noqa: ANN001, ANN202
        for b in batches:
            works = [order(x) for x in b["lines"]]
            yield pd.DataFrame({"series": b["series"].repeat([len(w) for w in works]), "work": [x for w in works for x in w], "place": [k for w in works for k in range(1, len(w) + 1)]})

    lines = places.groupBy("series").agg(F.collect_list(F.struct("site", "work", "number")).alias("lines"))
    return lines.mapInPandas(task, "series long, work long, place long")
