"""Read-only SQL over registered tables, with a limit that tells whether it cut."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DEFAULT, MOST = 1000, 100_000
_READS = re.compile(r"\s*(select|with|values|show|describe|explain)\b", re.IGNORECASE)


def read_only(spark: SparkSession, text: str, limit: int = DEFAULT) -> tuple[DataFrame, bool]:
    """Rows of a query, and whether there are more than limit (at most MOST) of them."""
    if not _READS.match(text) or ";" in text.rstrip().rstrip(";"):
        raise ValueError("one statement that only reads is accepted")
    n = max(1, min(limit, MOST))
    out = spark.sql(text.rstrip().rstrip(";"))
    return out.limit(n), out.limit(n + 1).count() > n
