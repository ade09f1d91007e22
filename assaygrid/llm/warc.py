"""Not-modified revisits resolved to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaygrid.llm.common import column
from assaygrid.session import cut

# Headers that a 304 response must not pass on (they describe its own message), and tracking parameters.
OWN_HEADERS = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
               "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = r"^(?:utm_[a-z_]*|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(?:=|$)"


def canonical_url(url: Column) -> Column:
    """Host without www and default port, path without a last slash, sorted query without tracking; null if there is no host."""
    rest = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)?$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^(?:[^/?]*)//[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), tail))


def headers(block: Column) -> Column:
    """array<struct<name,value>> of a header block: names lower-cased, equal names joined by ', ' in order, folded lines unfolded."""
    lines = F.split(F.regexp_replace(F.coalesce(block, F.lit("")), r"\r?\n[ \t]+", " "), r"\r?\n")
    pairs = F.transform(F.filter(lines, lambda x: F.instr(x, ":") > 1), lambda x: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"),
        F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    return F.transform(names, lambda n: F.struct(
        n.alias("name"), F.array_join(F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: p["value"]), ", ").alias("value")))


def header(found: Column, name: str) -> Column:
    """A header's value, or null."""
    return F.get(F.transform(F.filter(found, lambda h: h["name"] == name), lambda h: h["value"]), 0)


def merged(stored: Column, fresh: Column) -> Column:
    """The stored headers, those named in a 304 replaced or added but for OWN_HEADERS, in order of name."""
    news = F.filter(fresh, lambda h: ~h["name"].isin(*OWN_HEADERS))
    old = F.filter(stored, lambda h: ~F.exists(news, lambda n: n["name"] == h["name"]))
    return F.array_sort(F.concat(old, news))


def latest_before(events: DataFrame, bucket_seconds: int) -> DataFrame:
    """(record_id of a revisit, response_id): the last full response of its URL strictly before it.

    A URL's records are ordered inside buckets of time only; what earlier buckets hold comes from one
    row per URL and bucket. So a URL with a third of all records is spread over its buckets, and the
    window over a whole URL sees one row per bucket.
    """
    full = F.struct("ts", "record_id")
    dealt = events.withColumn("bucket", F.floor(F.unix_micros("ts") / (bucket_seconds * 1_000_000)))
    last = dealt.where("is_full").groupBy("url_key", "bucket").agg(F.max(full).alias("last"))
    spots = last.unionByName(dealt.where("not is_full").select("url_key", "bucket").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType)))
    spots = spots.groupBy("url_key", "bucket").agg(F.max("last").alias("last"))
    before = W.partitionBy("url_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = spots.select("url_key", "bucket", F.last("last", ignorenulls=True).over(before)["record_id"].alias("carried"))
    # At one instant revisits stand before responses, so a response then is not earlier.
    inside = W.partitionBy("url_key", "bucket").orderBy("ts", "is_full", "record_id").rowsBetween(W.unboundedPreceding, 0)
    own = dealt.withColumn("own", F.last(F.when(F.col("is_full"), F.col("record_id")), ignorenulls=True).over(inside))
    return own.where("not is_full").join(carried, ["url_key", "bucket"], "left").select(
        "record_id", F.coalesce("own", "carried").alias("response_id"))


def resolve_revisits(records: DataFrame, bucket_seconds: int = 86_400, with_body: bool = True) -> DataFrame:
    """One row per not-modified revisit, from records (record_id, kind, url, ts, status, headers, body).

    `kind` is 'response' or 'revisit'; a full response has status 200, a revisit 304; other records
    and null record ids are left out. Returned: record_id, url_key, response_id, state, status,
    headers (name, value; those of the response with the revisit's permitted ones merged in),
    body_sha256, body_length and, `with_body`, body.

    state: 'no_key' if URL or time is null, 'no_response' without an earlier full response,
    'mismatch' if the validators differ, 'unchecked' if they share none, else 'resolved'. ETags are
    compared weakly (without W/) if both have one, else Last-Modified if both have it. Only resolved
    and unchecked rows carry status, headers and body. Of responses at one time the largest record
    id is the latest. A repeated record id is one record: its largest row counts. Null headers are none, a null body is empty.
    """
    r = records.select(
        column(records, "record_id").cast("long").alias("record_id"), column(records, "kind").alias("kind"), canonical_url(column(records, "url")).alias("url_key"),
        column(records, "ts").cast("timestamp").alias("ts"), column(records, "status").cast("int").alias("status"),
        column(records, "headers").alias("raw"), F.coalesce(column(records, "body"), F.lit("")).alias("body")).where("record_id is not null")
    full = r.where("kind = 'response' and status = 200")
    revisit = r.where("kind = 'revisit' and status = 304").groupBy("record_id").agg(
        F.max(F.struct("ts", "url_key", "raw")).alias("m")).select("record_id", "m.*")
    # One narrow row per record goes through the as-of step; bodies join by record id afterwards.
    stored = full.groupBy("record_id").agg(F.max(F.struct("ts", "url_key", "raw", F.sha2("body", 256).alias("body_sha256"),
                                           F.length("body").cast("long").alias("body_length"))).alias("m")).select("record_id", "m.*")
    stored, revisit = cut(stored, "warc-responses"), cut(revisit, "warc-revisits")
    events = stored.select("record_id", "url_key", "ts", F.lit(True).alias("is_full")).unionByName(
        revisit.select("record_id", "url_key", "ts", F.lit(False).alias("is_full"))).where("url_key is not null and ts is not null")
    found = cut(latest_before(events, bucket_seconds), "warc-asof")
    old = stored.select(F.col("record_id").alias("response_id"), headers(F.col("raw")).alias("old"), "body_sha256", "body_length")
    joined = revisit.withColumn("new", headers(F.col("raw"))).join(found, "record_id", "left").join(old, "response_id", "left")
    etag = [F.regexp_replace(header(F.col(c), "etag"), r"^W/", "") for c in ("old", "new")]
    date = [header(F.col(c), "last-modified") for c in ("old", "new")]
    same = F.coalesce(etag[0] == etag[1], date[0] == date[1])
    state = (F.when(F.col("url_key").isNull() | F.col("ts").isNull(), "no_key").when(F.col("response_id").isNull(), "no_response")
             .when(same, "resolved").when(~same, "mismatch").otherwise("unchecked"))
    out = joined.withColumn("state", state)
    good = F.col("state").isin("resolved", "unchecked")
    out = out.select(
        "record_id", "url_key", "response_id", "state", F.when(good, 200).alias("status"), F.when(good, merged(F.col("old"), F.col("new"))).alias("headers"),
        F.when(good, F.col("body_sha256")).alias("body_sha256"), F.when(good, F.col("body_length")).alias("body_length"))
    if not with_body:
        return out
    bodies = full.groupBy("record_id").agg(F.max(F.struct("ts", "url_key", "raw", "body"))["body"].alias("body"))
    bodies = cut(bodies, "warc-bodies").select(F.col("record_id").alias("response_id"), "body")
    joined = cut(out, "warc-resolved").join(bodies, "response_id", "left")
    return joined.select(*out.columns, F.when(F.col("state").isin("resolved", "unchecked"), F.col("body")).alias("body"))


def captures(pages: DataFrame) -> DataFrame:
    """Every page as a full response, and a later not-modified visit to it, as WARC records.

    The visit's validators follow the page: mostly the response's ETag, sometimes weak, changed, or
    left to Last-Modified; some visits are dated before anything was captured. Record ids are twice the page id, plus one for visits.
    """
    n = F.conv(F.substring(F.md5(F.coalesce(F.col("url"), F.lit(""))), 1, 2), 16, 10).cast("int") % 10
    tag = F.md5(F.coalesce("html", F.lit("")))
    modified = F.concat(F.lit("day "), F.col("page_id") % 1000)
    when = lambda shift: F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("page_id") + shift) * 600)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", when(0).alias("ts"), F.lit(200).alias("status"),
        F.concat(line("Content-Type", F.lit("text/html; charset=utf-8")), line("ETag", F.concat(F.lit('"'), tag, F.lit('"'))),
                 line("Last-Modified", modified), line("Cache-Control", F.lit("max-age=60")), line("Content-Length", F.length("html").cast("string")),
                 ).alias("headers"), F.col("html").alias("body"))
    shown = (F.when(n == 0, F.lit("")).when(n == 1, line("ETag", F.lit('"changed"')))
             .when(n == 2, line("ETag", F.concat(F.lit('W/"'), tag, F.lit('"')))).otherwise(line("ETag", F.concat(F.lit('"'), tag, F.lit('"')))))
    visit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.upper(F.substring("url", 1, 4)).alias("_s"), "url",
        F.when(n == 3, when(-100_000_000)).otherwise(when(F.length("url"))).alias("ts"), F.lit(304).alias("status"),
        F.concat(shown, line("Last-Modified", modified), line("cache-control", F.lit("max-age=90")), line("Content-Length", F.lit("0")),
                 line("Set-Cookie", F.lit("a=1")), line("Set-Cookie", F.lit("b=2"))).alias("headers"), F.lit(None).cast("string").alias("body"))
    # Visits write the scheme in capitals: another spelling of the same URL.
    visit = visit.withColumn("url", F.concat("_s", F.substring("url", 5, 1_000_000))).drop("_s")
    return full.unionByName(visit)
