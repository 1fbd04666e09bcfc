"""An inverted index that is written once and read by its terms.

Postings lie in folders by field and by a digest of their token, sorted by token within files, so that
a search reads the folders of its own tokens and, in them, the row groups that can hold these. Values of
facets lie beside them in folders by facet; an item without a value has a marker, so that a choice which
lets such items through is a read of terms too. Searches and choices meet on keys; no document is read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder
from . import search

#: Folders of each field, and the value of an item that has none of a facet.
BUCKETS, NONE = 32, "\x00none"
SOURCE = "source"


@dataclass(frozen=True)
class Choice:
    """Values of a facet to show, or to hide, or the steps of a range; items without a value pass unless without_hidden.

    sources: those that have the facet at all; items of others pass. None: all have it.
    """

    facet: str
    shown: Sequence[str] | None = None
    hidden: Sequence[str] = ()
    within: Sequence[str] | None = None
    without_hidden: bool = False
    sources: Sequence[str] | None = None


def bucket_of(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


class StoredIndex:
    """The index below one folder of the shared space."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    @classmethod
    def build(cls, documents: DataFrame, key: str, fields: Sequence[str], facets: Mapping[str, Column], root: str | None = None) -> StoredIndex:
        """Postings of the fields and values of the facets (arrays of text, or text) of documents, written below root.

        key is distinct. Null and empty fields have no tokens; a null facet or one without a value that is
        not null has the marker. The postings of a token of every document are spread over files by key.
        """
        spark = documents.sparkSession
        out = cls(spark, root or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
        own = search.postings(documents, key, fields).withColumn("bucket", F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(BUCKETS)).cast("int"))
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        salts = max(1, tasks // (BUCKETS * len(fields)))
        own.repartition("field", "bucket", F.pmod(F.xxhash64("key"), F.lit(salts))).sortWithinPartitions("field", "bucket", "token", "key").write.partitionBy("field", "bucket").parquet(f"{out.root}/postings")
        many = lambda c: c if dict(documents.select(c.alias("x")).dtypes)["x"].startswith("array") else F.array(c)
        known = {name: F.array_distinct(F.filter(F.coalesce(many(c), F.array().cast("array<string>")), lambda x: x.isNotNull())) for name, c in facets.items()}
        told = F.array(*(F.struct(F.lit(name).alias("facet"), F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(NONE))).alias("vals")) for name, values in known.items()))
        values = documents.select(F.col(key).alias("key"), F.inline(told)).select("key", "facet", F.explode("vals").alias("value"))
        values.repartition("facet", F.pmod(F.xxhash64("key"), F.lit(max(1, tasks // max(1, len(facets)))))).sortWithinPartitions("facet", "value", "key").write.partitionBy("facet").parquet(f"{out.root}/values")
        return out

    def exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/values/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def postings(self, tokens: Sequence[str] | None = None, fields: Sequence[str] | None = None) -> DataFrame:
        """(token, field, key, n, places) of these tokens and fields; only their folders are read."""
        out = self.spark.read.parquet(f"{self.root}/postings")
        if fields is not None:
            out = out.where(F.col("field").isin(*fields))
        if tokens is not None:
            out = out.where(F.col("bucket").isin(*sorted({bucket_of(t) for t in tokens})) & F.col("token").isin(*tokens))
        return out.drop("bucket")

    def values(self, facet: str) -> DataFrame:
        """(key, value) of a facet, with the marker."""
        return self.spark.read.parquet(f"{self.root}/values").where(F.col("facet") == facet).select("key", "value")

    def chosen(self, choice: Choice) -> DataFrame:
        """Keys that a choice lets through, each once."""
        own = self.values(choice.facet)
        given = choice.within if choice.within is not None else choice.shown
        let = F.col("value").isin(*given) if given is not None else (F.col("value") != NONE) & ~F.col("value").isin(*choice.hidden)
        out = own.where(let if choice.without_hidden else let | (F.col("value") == NONE)).select("key")
        if choice.sources is not None:
            out = out.unionByName(self.values(SOURCE).where(~F.col("value").isin(*choice.sources)).select("key"))
        return out.distinct()

    def within(self, choices: Sequence[Choice]) -> DataFrame:
        """Keys that all choices let through; one shuffle for all of them."""
        each = [self.chosen(c).withColumn("c", F.lit(k)) for k, c in enumerate(choices)]
        both = each[0]
        for more in each[1:]:
            both = both.unionByName(more)
        return both.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(choices)).select("key")

    def search(self, line: Sequence[str], weights: Mapping[str, float], naming: Sequence[str], choices: Sequence[Choice] = ()) -> DataFrame:
        """Word scores of the documents that the line finds and all choices let through."""
        found = search.word_scores(self.postings(line, list(weights)), line, weights, naming)
        return found.join(self.within(choices), "key", "left_semi") if choices else found
