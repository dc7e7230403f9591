"""Line dedup by site-relative frequency, in DataFrame operations only.

A line is boilerplate of a host if the share of the host's pages that contain it exceeds a ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longweave.llm.common import fresh
from longweave.operators.joins import salted_join
from longweave.session import saved

#: A line is dropped if it is on more than this share of its host's pages, and on so many pages at least.
RATIO, LEAST_PAGES = 0.01, 3
#: Boilerplate lines of all hosts up to which they are broadcast, at some 60 bytes each.
BROADCAST_LINES = 500_000



def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a line without spaces, tabs and carriage returns around it; null for a blank one."""
    bare = F.trim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def host_of(url: Column) -> Column:
    """The host that a URL names, in lower case, without user and port; null for what is no URL with a host."""
    found = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s]*@)?([^/:?#\s]+)", 1)
    return F.when(found != "", F.lower(found))


def _of(host: str | Column) -> Column:
    return F.col(host) if isinstance(host, str) else host


def boilerplate(pages: DataFrame, host: str | Column = "source", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """(host, lines): keys of the boilerplate lines of each host that has any.

    A page counts once for a line, however often the line is on it. Counts are summed on the map side,
    so a line or host with a third of all pages is no hot spot. A host has at most its mean number of
    lines a page, divided by ``ratio``, of such lines, whatever its number of pages.
    """
    own = pages.select(_of(host).cast("string").alias("host"), F.col("text").cast("string").alias("text")).where("host IS NOT NULL")
    total = own.groupBy("host").agg(F.count("*").alias("total"))
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _key), lambda x: x.isNotNull()))
    n = own.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    found = n.where(F.col("n") >= least).join(total, "host").where(F.col("n") > ratio * F.col("total"))
    return found.groupBy("host").agg(F.collect_list("line").alias("lines"))


def without_boilerplate(pages: DataFrame, host: str | Column = "source", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """``pages`` with boilerplate lines cut from ``text``, and ``lines_dropped`` long.

    Every row stays, as do the order and spelling of lines that stay, and blank lines. Rows whose host
    or text is null stay as they are and count for no host. Repeated rows are pages of their own. Other
    columns stay, but a ``lines_dropped`` there was is replaced. Very long texts are met as a whole, a line
    right at the ratio stays. An empty table gives no rows. ``host`` is a column, such as
    ``host_of(F.col("url"))``. Beyond BROADCAST_LINES boilerplate lines the texts of a host with very many
    pages are dealt over several tasks.
    """
    at, line, bad = fresh(pages, "__lw_host", "__lw_line", "__lw_bad")
    known = saved(boilerplate(pages, host, ratio, least), "boilerplate").select(F.col("host").alias(at), F.col("lines").alias(bad))
    count = known.agg(F.sum(F.size(bad))).first()[0] or 0
    names = [c for c in pages.columns if c != "lines_dropped"]
    text = F.col("text").cast("string")
    keyed = pages.select(*names, _of(host).cast("string").alias(at))
    if count <= BROADCAST_LINES:
        joined = keyed.join(F.broadcast(known), at, "left")
    else:
        joined = salted_join(keyed.withColumn(line, F.md5("text")), known, at, line, "left")
    kept = F.filter(_lines(text), lambda x: ~F.coalesce(F.array_contains(F.col(bad), _key(x)), F.lit(False)))
    joined = joined.withColumn(line, F.when(F.col(bad).isNotNull(), kept))
    dropped = F.coalesce(F.size(_lines(text)) - F.size(line), F.lit(0)).cast("long")
    cols = [F.coalesce(F.array_join(line, "\n"), text).alias("text") if c == "text" else F.col(c) for c in names]
    return joined.select(*cols, F.when(F.col(line).isNull(), F.lit(0).cast("long")).otherwise(dropped).alias("lines_dropped"))


def digest(pages: DataFrame, **kw) -> DataFrame:
    """doc_id, n_lines and text_md5 of what is kept, lines_dropped; one row per input row."""
    out = without_boilerplate(pages.select("doc_id", "source", "text"), **kw)
    return out.select("doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), F.md5("text").alias("text_md5"), "lines_dropped")


SQL = f"""
WITH page AS (SELECT doc_id, source, text, row_number() OVER () AS page FROM documents),
line AS (SELECT page, source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''))) AS line FROM page),
host AS (SELECT source, count(*) AS total FROM page WHERE source IS NOT NULL GROUP BY source),
bad AS (SELECT source, list(line) AS lines FROM (SELECT source, line, count(*) AS n FROM line GROUP BY ALL) JOIN host USING (source) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * total GROUP BY source),
kept AS (SELECT doc_id, string_split(text, chr(10)) AS old, CASE WHEN lines IS NULL THEN string_split(text, chr(10)) ELSE list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(lines, trim(x, ' ' || chr(9) || chr(13)))) END AS new FROM page LEFT JOIN bad USING (source))
SELECT doc_id, CAST(greatest(len(new), 1) AS BIGINT) AS n_lines, md5(array_to_string(new, chr(10))) AS text_md5, CAST(len(old) - len(new) AS BIGINT) AS lines_dropped FROM kept
"""
