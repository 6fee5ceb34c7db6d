"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import save

# A line goes if it is on more than this share of the pages of its host, and on two of them at least: every line of a
# host of one page is on all of its pages.
RATIO = 0.3
LEAST_REPEATS = 2

_BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul"
# What ends a line: comments, scripts, styles, doctypes, block tags and line feeds.
BREAKS = rf"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!doctype[^>]*>|</?(?:{_BLOCKS})\b[^>]*>|\n"
TAGS = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def html_lines(html: Column) -> Column:
    """The text lines of a page: split at block tags, other tags removed, blanks made one, empty lines left out."""
    pieces = F.transform(F.split(html, BREAKS), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, TAGS, ""), r"[ \t\n\f\r]+", " ")))
    return F.filter(F.coalesce(pieces, F.array().cast("array<string>")), lambda x: x != "")


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def boilerplate(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(host, frequent): hashes of the boilerplate lines of each host that has any, for `pages(host, lines)`.

    Each page counts a line once. Lines and hosts are counted in the tasks before they are shuffled, as hashes. A
    host has at most 1 / ratio times as many boilerplate lines as an average page has lines, so the list stays short
    however many pages the host has.
    """
    rows = pages.where("host is not null")
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    each = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    counted = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_REPEATS)
    frequent = counted.join(totals, "host").where(F.col("n") / F.col("pages") > ratio)
    return frequent.groupBy("host").agg(F.collect_list("line").alias("frequent"))


def drop_boilerplate(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", ratio: float = RATIO) -> DataFrame:
    """(key, host, n_lines, n_dropped, text) for every row of `pages`: its lines without its host's boilerplate.

    A line of a page is text between block tags; one that is on more than `ratio` of the pages of its host goes from all of
    them, every time it occurs, if it is on two pages at least. Pages without a host, and the only page of a host, lose nothing. Null
    and empty pages have no lines and empty text, but count for their host; repeated rows count as pages and
    keep rows of their own. Further columns are not read; an empty table gives an empty result.
    """
    lined = pages.select(F.col(key).alias("key"), host_of(F.col(url).cast("string")).alias("host"), html_lines(F.col(html).cast("string")).alias("lines"))
    known = save(boilerplate(lined.select("host", "lines"), ratio), "boilerplate")
    known = known.withColumnRenamed("host", "__host")
    joined = lined.join(known, F.col("host") == F.col("__host"), "left")
    kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains(F.col("frequent"), F.xxhash64(x)), F.lit(False)))
    joined = joined.withColumn("kept", kept)
    return joined.select(
        F.col("key").alias(key),
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )
