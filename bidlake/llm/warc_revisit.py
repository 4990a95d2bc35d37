"""Resolution of not-modified WARC revisits (operator 10).

A crawler that gets "304 Not Modified" stores a revisit record: headers, no body. Each one is
joined, by canonical URL, to the latest earlier full response (as-of join). If the revisit's
validator agrees with that response's (ETag by weak comparison, else Last-Modified), the
record gets its body and the response's headers, updated by those headers that a 304 may
update.

The as-of join never sorts one URL's captures in one task: capture times are cut at global
quantiles, a window finds the latest response inside each (URL, slice), and the last response
of each earlier slice (one row per URL and slice) is carried forward. Only narrow columns
take part; bodies join at the end, by record id.

Defined results: "earlier" orders by (captured, record_id), so ties are settled by the smaller
record id; a revisit without an earlier full response, without a validator, or whose validator
differs stays unresolved, with that reason; records without URL or time are kept as
unresolved ``no_earlier_response``; null headers are empty. Repeated revisits are kept, one row
each; repeated responses count once (of bodies under one record id the smallest text), and
responses without a record id can't be referred to, so they aren't used. Response records are no
revisits and give no row. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 may update (fixed values, RFC 9110 section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified",
             "vary")
SLICES = 64


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no user, no fragment, no tracking
    parameters, the other parameters in order, no trailing slash; http and https are one."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^[a-zA-Z]+://(?:[^/?@]*@)?([^/?:]+)", 1))
    port = F.regexp_extract(plain, r"^[a-zA-Z]+://[^/?]*:(\d+)(?:[/?]|$)", 1)
    path = F.regexp_replace(
        F.regexp_extract(plain, r"^[a-zA-Z]+://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(
        F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"),
        lambda p: (p != "") & ~p.rlike(r"^(?:utm_[a-z]+|gclid|fbclid)(?:=|$)"))), "&")
    return F.when(host != "", F.concat(
        host, F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)),
        path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the last counts."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    names = F.array_distinct(F.transform(F.map_keys(headers), F.lower))
    value = F.transform(names, lambda k: F.element_at(F.filter(
        F.map_entries(headers), lambda e: F.lower(e["key"]) == k), -1)["value"])
    return F.coalesce(F.map_from_arrays(names, value), empty)


def weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, captured timestamp, kind
    'response' or 'revisit', status, headers map, payload string):
    record_id, url (canonical), captured, refers_to, outcome, status, headers, payload."""
    narrow = records.select(
        "record_id", canonical_url(F.col("url")).alias("url"),
        F.col("captured").cast("timestamp").alias("captured"), "kind", "status",
        lower_keys(F.col("headers")).alias("headers"))
    bounds = narrow.agg(F.percentile_approx(
        F.unix_micros("captured"), [i / slices for i in range(1, slices)], 1000)).first()[0] or []
    cuts = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast(
        "array<bigint>")
    cut = F.size(F.filter(cuts, lambda b: b <= F.unix_micros("captured")))
    usable = ((F.col("kind") == "response") & (F.col("status") == 200)
              & F.col("record_id").isNotNull())
    order = F.struct("captured", "record_id", "headers")
    sliced = (narrow.where(F.col("url").isNotNull() & F.col("captured").isNotNull()
                           & (usable | (F.col("kind") == "revisit")))
              .withColumn("slice", cut).withColumn("full", F.when(usable, order)))
    lasts = (sliced.where(usable).groupBy("url", "slice").agg(F.max_by(
        "full", F.struct("captured", "record_id")).alias("last")))
    by_slice = Window.partitionBy("url").orderBy("slice")
    wanted = sliced.where(F.col("kind") == "revisit").select("url", "slice").distinct()
    carried = (wanted.join(lasts, ["url", "slice"], "full")
               .withColumn("carried", F.last("last", True).over(
                   by_slice.rowsBetween(Window.unboundedPreceding, -1)))
               .select("url", "slice", "carried"))
    inside = (Window.partitionBy("url", "slice").orderBy("captured", "record_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    seen = (sliced.withColumn("inside", F.last("full", True).over(inside))
            .where(F.col("kind") == "revisit"))
    found = (seen.join(carried, ["url", "slice"], "left")
             .withColumn("source", F.coalesce("inside", "carried")))
    stray = (narrow.where((F.col("kind") == "revisit")
                          & (F.col("url").isNull() | F.col("captured").isNull()))
             .withColumn("source", F.lit(None).cast(dict(found.dtypes)["source"])))
    both = found.select("record_id", "url", "captured", "headers", "source").unionByName(
        stray.select("record_id", "url", "captured", "headers", "source"))

    mine, theirs = F.col("headers"), F.col("source.headers")
    etag, modified = weak(mine["etag"]), mine["last-modified"]
    outcome = (
        F.when(F.col("source").isNull(), "no_earlier_response")
        .when(etag.isNotNull(), F.when(etag == weak(theirs["etag"]), "resolved")
              .otherwise("validator_mismatch"))
        .when(modified.isNotNull(), F.when(modified == theirs["last-modified"], "resolved")
              .otherwise("validator_mismatch"))
        .otherwise("no_validator"))
    permitted = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(
        F.map_filter(theirs, lambda k, v: ~F.map_contains_key(permitted, k)), permitted)
    judged = both.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    resolved = judged.select(
        "record_id", "url", "captured", "outcome",
        F.when(ok, F.col("source.record_id")).alias("refers_to"),
        F.when(ok, 200).otherwise(304).alias("status"),
        F.when(ok, merged).otherwise(mine).alias("headers"))
    # Revisits without a body have keys of their own, so they don't meet in one task. The key is
    # no column of the aggregate: so the join has its own exchange, which AQE can split where
    # many revisits refer to one body.
    bodies = (records.where((F.col("kind") == "response") & (F.col("status") == 200)
                            & F.col("record_id").isNotNull())
              .groupBy("record_id").agg(F.min("payload").alias("payload"))
              .select(F.concat(F.lit("body "), F.col("record_id").cast("string")).alias("_key"),
                      "payload"))
    keyed = resolved.withColumn("_key", F.coalesce(
        F.concat(F.lit("body "), F.col("refers_to").cast("string")),
        F.concat(F.lit("none "), F.col("record_id").cast("string"))))
    return keyed.join(bodies, "_key", "left").drop("_key")


def captures(pages: DataFrame) -> DataFrame:
    """A crawl over ``pages``: each page is captured once in full; a later visit, by another
    spelling of its URL, finds it not modified. One visit in ten carries an outdated
    validator, one in eleven none but Last-Modified, and one in thirteen came before the
    first full capture."""
    one = F.col("page_id")
    first = F.timestamp_seconds(F.lit(1_700_000_000) + one * 60)
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16),
                   F.lit('"'))
    modified = F.date_format(first, "yyyy-MM-dd")
    full = pages.select(
        (one * 2).alias("record_id"), "url", first.alias("captured"),
        F.lit("response").alias("kind"), F.lit(200).alias("status"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"),
            F.lit("Content-Length"), F.length("html").cast("string"),
            F.lit("ETag"), tag, F.lit("Last-Modified"), modified,
            F.lit("Date"), first.cast("string")).alias("headers"),
        F.col("html").alias("payload"))
    later = F.when(one % 13 == 5, first - F.expr("interval 400 days")).otherwise(
        first + F.expr("interval 1 day"))
    dated = F.create_map(F.lit("Date"), later.cast("string"), F.lit("Content-Length"), F.lit("0"),
                         F.lit("Cache-Control"), F.lit("max-age=60"))
    again = pages.select(
        (one * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"),
        later.alias("captured"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.when(one % 11 == 3, F.map_concat(dated, F.create_map(F.lit("last-modified"), modified)))
        .when(one % 10 == 7, F.map_concat(dated, F.create_map(F.lit("etag"), F.lit('"old"'))))
        .otherwise(F.map_concat(dated, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag))))
        .alias("headers"), F.lit(None).cast("string").alias("payload"))
    return full.unionByName(again)


def op10_warc_revisit(spark, sf_dir: str) -> DataFrame:
    """Every revisit of the crawl over all pages, resolved or with the reason why not
    (refers_to and payload_chars are -1 where there is no body)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = resolve_revisits(captures(pages))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(
        e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))))
    return found.select(
        "record_id", F.coalesce("refers_to", F.lit(-1)).alias("refers_to"), "url", "outcome",
        F.col("status").cast("long").alias("status"),
        F.array_join(entries, "\n").alias("headers"),
        F.coalesce(F.length("payload"), F.lit(-1)).cast("long").alias("payload_chars"),
        F.md5("payload").alias("payload_md5"))


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, url, html,
    make_timestamp((1700000000 + page_id * 60) * 1000000) AS first_seen,
    '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag,
    regexp_replace(trim(url, ' '), '#.*$', '') AS plain
  FROM pages
), c AS (
  SELECT *, lower(regexp_extract(plain, '^[a-zA-Z]+://(?:[^/?@]*@)?([^/?:]+)', 1)) AS host,
    regexp_extract(plain, '^[a-zA-Z]+://[^/?]*:(\d+)(?:[/?]|$)', 1) AS port,
    regexp_replace(regexp_extract(plain, '^[a-zA-Z]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(
      string_split(regexp_extract(plain, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|gclid|fbclid)(?:=|$)'))), '&') AS query,
    CASE WHEN page_id % 13 = 5 THEN first_seen - INTERVAL 400 DAY
         ELSE first_seen + INTERVAL 1 DAY END AS later
  FROM p
), u AS (
  SELECT *, CASE WHEN host <> '' THEN host
      || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || path
      || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical
  FROM c
), f AS (
  SELECT r.page_id, r.canonical, r.later, r.tag AS my_tag, r.first_seen AS my_first,
    (SELECT max({'t': s.first_seen, 'i': s.page_id}) FROM u s
     WHERE s.canonical = r.canonical AND s.first_seen <= r.later
       AND (s.first_seen < r.later OR s.page_id * 2 < r.page_id * 2 + 1)) AS best
  FROM u r
), j AS (
  SELECT f.*, s.page_id AS src, s.tag, s.html, s.first_seen,
    CASE WHEN s.page_id IS NULL THEN 'no_earlier_response'
         WHEN f.page_id % 11 = 3 THEN CASE WHEN strftime(f.my_first, '%Y-%m-%d')
           = strftime(s.first_seen, '%Y-%m-%d') THEN 'resolved' ELSE 'validator_mismatch' END
         WHEN f.page_id % 10 = 7 THEN 'validator_mismatch'
         WHEN f.my_tag = s.tag THEN 'resolved' ELSE 'validator_mismatch' END AS outcome
  FROM f LEFT JOIN u s ON best.i = s.page_id
)
SELECT page_id * 2 + 1 AS record_id,
  CASE WHEN outcome = 'resolved' THEN src * 2 ELSE -1 END AS refers_to, canonical AS url, outcome,
  CASE WHEN outcome = 'resolved' THEN 200 ELSE 304 END::BIGINT AS status,
  CASE WHEN outcome = 'resolved' THEN
    'cache-control: max-age=60' || chr(10) || 'content-length: ' || length(html) || chr(10)
    || 'content-type: text/html' || chr(10)
    || 'date: ' || strftime(later, '%Y-%m-%d %H:%M:%S') || chr(10)
    || 'etag: ' || CASE WHEN page_id % 11 = 3 THEN tag ELSE 'W/' || my_tag END || chr(10)
    || 'last-modified: ' || strftime(CASE WHEN page_id % 11 = 3 THEN my_first
                                     ELSE first_seen END, '%Y-%m-%d')
  ELSE 'cache-control: max-age=60' || chr(10) || 'content-length: 0' || chr(10)
    || 'date: ' || strftime(later, '%Y-%m-%d %H:%M:%S')
    || CASE WHEN page_id % 11 = 3
         THEN chr(10) || 'last-modified: ' || strftime(my_first, '%Y-%m-%d')
       WHEN page_id % 10 = 7 THEN chr(10) || 'etag: "old"'
       ELSE chr(10) || 'etag: W/' || my_tag END END AS headers,
  coalesce(CASE WHEN outcome = 'resolved' THEN length(html) END, -1) AS payload_chars,
  CASE WHEN outcome = 'resolved' THEN md5(html) END AS payload_md5
FROM j
"""
