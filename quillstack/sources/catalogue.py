"""Logical tables of a catalogue of works, read from Parquet of a star schema.

An item is a part, its source the brand, its work a group of parts; words of the name and the type
are its facets, size and price its numbers; order lines grade it. Columns are pruned and filters
reach the scans, as every table is a plain projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

TYPES = ["ECONOMY", "SMALL", "MEDIUM", "STANDARD", "LARGE", "PROMO"]
WORKS = 700


@dataclass
class Catalogue:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def items(self) -> DataFrame:
        """item_id, title, source, words, type, size, price, work."""
        return self.table("part").select(
            F.col("p_partkey").alias("item_id"),
            F.col("p_name").alias("title"),
            F.col("p_brand").alias("source"),
            F.split("p_name", " ").alias("words"),
            F.col("p_type").alias("type"),
            F.col("p_size").cast("double").alias("size"),
            F.col("p_retailprice").alias("price"),
            (F.col("p_partkey") % WORKS).alias("work"),
        )

    def ratings(self) -> DataFrame:
        """A grade of 1 to 5 of one version of an item at a time; rating_id breaks ties."""
        return self.table("lineitem").select(
            F.col("l_partkey").alias("item_id"),
            (F.col("l_partkey") % WORKS).alias("work"),
            F.col("l_linenumber").alias("version"),
            (F.col("l_quantity").cast("long") % 5 + 1).cast("int").alias("grade"),
            F.col("l_shipdate").alias("rated_at"),
            F.col("l_orderkey").alias("rating_id"),
        )

    def predictions(self) -> DataFrame:
        """item_id, score (0 to 10), chance of interest; sums are of whole cents, so that every engine agrees."""
        lines = self.table("lineitem")
        cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
        kept = F.sum((F.col("l_returnflag") != "R").cast("long"))
        return lines.groupBy(F.col("l_partkey").alias("item_id")).agg((cents / F.count("*") / 1_000_000).alias("score"), (kept / F.count("*")).alias("chance"))

    def latest_grades(self) -> DataFrame:
        """The newest grade of an item's seventh version; items without one are not graded."""
        own = self.ratings().where("version = 7")
        return own.groupBy("item_id").agg(F.max_by("grade", F.struct("rated_at", "rating_id", "version")).alias("grade"), F.max("rated_at").alias("rated_at"))

    def rows(self) -> DataFrame:
        """The read model of lists: items with predictions and grades."""
        return self.items().join(self.predictions(), "item_id", "left").join(self.latest_grades(), "item_id", "left")

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "embedding", "label")

    def documents(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text", "lang", "source", "n_chars")

    def words_edges(self) -> DataFrame:
        """A hierarchy: suppliers below a nation and a region each, nations below regions, regions below the world."""
        named = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        out = s.select(named("S", F.col("s_suppkey")).alias("child"), named("N", F.col("s_nationkey")).alias("parent"))
        out = out.unionByName(s.select(named("S", F.col("s_suppkey")).alias("child"), named("R", F.col("s_suppkey") % 5).alias("parent")))
        out = out.unionByName(n.select(named("N", F.col("n_nationkey")).alias("child"), named("R", F.col("n_regionkey")).alias("parent")))
        return out.unionByName(r.select(named("R", F.col("r_regionkey")).alias("child"), F.lit("W").alias("parent")))
