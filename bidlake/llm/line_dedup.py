"""Site-relative line deduplication (operator 8; DataFrame functions only).

Per host: the pages that contain a line, divided by all pages of the host. A line whose share
exceeds ``max_ratio``, and that stands on ``min_pages`` pages at least, is boilerplate and
goes from every page of that host. Elsewhere the same line stays.

Lines are counted by a 128-bit digest after trimming, once per page. A host has at most
(lines per page / max_ratio) boilerplate lines, so one host's list is a short array however
many pages it has; pages meet it in a join on the host and one of ``SALTS`` hashes of the text,
so a hot host's pages go to many tasks.

Defined results: blank lines are never boilerplate and stay; a null text stays null; an empty
text stays empty; rows without a host belong to no site and stay as they are; repeated rows
count as pages of their own, unless ``copies_once`` is set: then pages of a host with the same
lines count as one page, in the share's numerator and denominator and in ``min_pages``; other columns pass through, and a column that has the name of
``stats`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

MAX_RATIO = 0.1
MIN_PAGES = 5
#: Tasks that the pages of one host are dealt to, at most.
SALTS = 32


def url_host(url: Column) -> Column:
    """The lower-cased host of a URL, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(
        url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def html_lines(html: Column) -> Column:
    """The visible text of a page, one line per block element."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    text = F.regexp_replace(
        text, r"(?i)</?(?:p|br|li|ul|ol|div|nav|h[1-6]|article|section|header|footer|title|"
              r"table|tr|td|th|head|body|html)\b[^>]*>", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"[ \t]*\n\s*", "\n")


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def drop_boilerplate_lines(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO,
                           min_pages: int = MIN_PAGES, stats: str = "line_stats",
                           copies_once: bool = False) -> DataFrame:
    """``pages`` with boilerplate lines removed from ``text``, and a struct column ``stats``
    (host_pages, n_lines, n_dropped; lines that are not blank). With ``copies_once`` a host's
    pages are its distinct ones, so that a text isn't boilerplate for being copied. ``pages`` is read three times;
    if its plan is costly, pass a written table."""
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != stats]).alias("row"),
        F.col(f"`{host}`").alias("host"), F.split(F.col(f"`{text}`"), "\n").alias("lines"),
        F.pmod(F.xxhash64(f"`{text}`"), F.lit(SALTS)).alias("salt"))
    keys = F.array_distinct(F.transform(
        F.filter("lines", lambda x: F.trim(x) != ""), line_key))
    sited = rows.where(F.col("host").isNotNull()).select("host", keys.alias("keys"))
    if copies_once:
        sited = sited.distinct()
    totals = sited.groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = (sited.select("host", F.explode("keys").alias("key"))
              .groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))
    sites = (counts.join(totals, "host")
             .where(F.col("n") > F.lit(max_ratio) * F.col("host_pages"))
             .groupBy("host").agg(F.collect_list("key").alias("boilerplate")))
    known = totals.join(sites, "host", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = rows.join(known, ["host", "salt"], "left")
    spoken = F.filter("lines", lambda x: F.trim(x) != "")
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains(
            F.col("boilerplate"), line_key(x))))
    cut = joined.select("row", "host_pages", F.size(spoken).alias("n"), kept.alias("kept"))
    columns = [F.array_join("kept", "\n").alias(c) if c == text else F.col(f"row.`{c}`").alias(c)
               for c in pages.columns if c != stats]
    left = F.size(F.filter("kept", lambda x: F.trim(x) != ""))
    return cut.select(*columns, F.struct(
        F.col("host_pages"), F.coalesce(F.col("n"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.col("n") - left, F.lit(0)).alias("n_dropped")).alias(stats))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All pages without the boilerplate lines of their site."""
    # the lines are read three times, so they are taken from the HTML once and written
    pages = stage(spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", url_host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text")),
        "page-lines")
    out = drop_boilerplate_lines(pages, "host", "text")
    return out.select(
        "page_id", "host", "text",
        F.coalesce("line_stats.host_pages", F.lit(0)).cast("long").alias("host_pages"),
        F.col("line_stats.n_lines").cast("long").alias("n_lines"),
        F.col("line_stats.n_dropped").cast("long").alias("n_dropped"))


OP8_SQL = r"""
WITH p AS (
  SELECT page_id,
    nullif(lower(regexp_extract(url,
      '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g'),
      '(?i)</?(?:p|br|li|ul|ol|div|nav|h[1-6]|article|section|header|footer|title|table|tr|td|th|head|body|html)\b[^>]*>',
      chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \t]*\n\s*', chr(10), 'g') AS text
  FROM pages
), l AS (
  SELECT page_id, host, s.line, s.i FROM p,
    LATERAL (SELECT unnest(string_split(text, chr(10))) AS line,
                    generate_subscripts(string_split(text, chr(10)), 1) AS i) s
), t AS (
  SELECT host, count(*) AS host_pages FROM p WHERE host IS NOT NULL GROUP BY host
), b AS (
  SELECT host, trim(line, ' ') AS k FROM l JOIN t USING (host) WHERE trim(line, ' ') <> ''
  GROUP BY host, k, host_pages
  HAVING count(DISTINCT page_id) >= 5 AND count(DISTINCT page_id) > 0.1 * host_pages
), k AS (
  SELECT l.page_id,
         string_agg(line, chr(10) ORDER BY i) FILTER (b.k IS NULL) AS text,
         count(*) FILTER (trim(line, ' ') <> '') AS n_lines,
         count(*) FILTER (b.k IS NOT NULL) AS n_dropped
  FROM l LEFT JOIN b ON l.host = b.host AND trim(line, ' ') = b.k GROUP BY l.page_id
)
SELECT p.page_id, p.host,
       CASE WHEN p.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       coalesce(host_pages, 0) AS host_pages, coalesce(n_lines, 0) AS n_lines,
       coalesce(n_dropped, 0) AS n_dropped
FROM p LEFT JOIN k USING (page_id) LEFT JOIN t ON p.host = t.host
"""
