"""What plug-ins offer: sources, encoders, scorers, suggesters, pair models and search, by name in a registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ITEM = "source string, item_id long, title string, updated_at timestamp_ntz"


@dataclass
class Source:
    """A place that items come from: its name, kind of content, and how its items, facets and pages are read.

    items(spark, path) gives source, item_id, title, updated_at; facets gives source, item_id, facet,
    value; pages are the URL patterns whose captured pages it can read.
    """

    name: str
    content: str
    items: Callable[[SparkSession, str], DataFrame]
    facets: Callable[[SparkSession, str], DataFrame] | None = None
    pages: Sequence[str] = ()
    modes: Sequence[str] = ("all",)


class Scorer(Protocol):
    """Fitted on labelled rows of features; gives a column of scores over `features`."""

    def fit(self, rows: DataFrame) -> Scorer: ...

    def score(self, features: Column) -> Column: ...


class Suggester(Protocol):
    """Learns values from (item, value) rows; gives (item, value, chance)."""

    def fit(self, inputs: DataFrame, said: DataFrame) -> Suggester: ...

    def chances(self, inputs: DataFrame) -> DataFrame: ...


class PairModel(Protocol):
    """A prior from layers of a pair, and a fit on answered pairs; gives a column of chances."""

    def prior(self, layers: Sequence[Column]) -> Column: ...

    def fit(self, answered: DataFrame) -> PairModel: ...

    def chance(self, layers: Sequence[Column]) -> Column: ...


class SearchProvider(Protocol):
    """An index that is built from documents, brought up to date, and asked for a line."""

    def rebuild(self, documents: DataFrame) -> None: ...

    def update(self, documents: DataFrame) -> None: ...

    def search(self, line: Sequence[str]) -> DataFrame: ...


@dataclass
class Registry:
    """Plug-ins by kind and name, and which of a kind is the one in use."""

    known: dict[tuple[str, str], object] = field(default_factory=dict)
    chosen: dict[str, str] = field(default_factory=dict)

    def add(self, kind: str, name: str, plugin: object) -> None:
        if (kind, name) in self.known:
            raise ValueError(f"{kind} {name} is known already")
        self.known[kind, name] = plugin
        self.chosen.setdefault(kind, name)

    def use(self, kind: str, name: str) -> None:
        if (kind, name) not in self.known:
            raise ValueError(f"no {kind} named {name}")
        self.chosen[kind] = name

    def of(self, kind: str) -> list:
        return [p for (k, _), p in sorted(self.known.items(), key=lambda x: x[0]) if k == kind]

    def active(self, kind: str) -> object:
        return self.known[kind, self.chosen[kind]]

    def items(self, spark: SparkSession, path: str) -> DataFrame:
        """Items of all sources, in the columns that a source promises; a source that breaks its promise is an error."""
        out = None
        for source in self.of("source"):
            own = source.items(spark, path).select("source", "item_id", "title", "updated_at")
            out = own if out is None else out.unionByName(own)
        return spark.createDataFrame([], ITEM) if out is None else out

    def captured(self, pages: DataFrame) -> DataFrame:
        """Pages that a source can read, with its name: the first one whose pattern the URL fits."""
        by = [F.when(F.col("url").rlike(p), F.lit(s.name)) for s in self.of("source") for p in s.pages]
        return pages.withColumn("source", F.coalesce(*by) if by else F.lit(None).cast("string")).where("source is not null")


def memory_source(name: str, rows: Sequence[tuple]) -> Source:
    """A source of rows given in a test: (item_id, title, updated_at)."""
    return Source(name, "test", lambda spark, _: spark.createDataFrame([(name, *r) for r in rows], ITEM))
