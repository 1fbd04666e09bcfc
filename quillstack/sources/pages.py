"""Captured pages: parsing by patterns, and what an older parser read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url and what is read of each page: title, language, links, host, and text without markup."""
    html = F.col("html")
    body = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]*>", " ")
    return pages.select(
        "page_id",
        "url",
        F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(html, '<html lang="([^"]*)"', 1).alias("lang"),
        F.size(F.regexp_extract_all(html, F.lit('<a href="[^"]*"'), F.lit(0))).cast("long").alias("links"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
        F.trim(F.regexp_replace(body, r"\s+", " ")).alias("body"),
    )


def misread(pages: DataFrame, version: int) -> DataFrame:
    """Pages that a parser older than `version` read."""
    return pages.where(F.col("parser_version") < version)


# fixed values: tags that break lines
BLOCKS = "p|div|br|li|ul|h1|h2|h3|article|nav|section|tr|table|footer|header"


def text_of(page: Column) -> Column:
    """Text of a page: block tags break lines, scripts, styles and comments go, spaces are evened, one blank line at most."""
    bare = F.regexp_replace(F.regexp_replace(page, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), r"<!--.*?-->", "")
    lines = F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), rf"(?i)</?({BLOCKS})\b[^>]*>", "\n")
    plain = F.regexp_replace(F.regexp_replace(lines, r"<[^>]*>", ""), r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(plain, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")
