"""Resolution of not-modified revisits: each revisit record gets the latest earlier full response of its URL.

An as-of join by canonical URL and time, as a window that carries the last full response forward. A URL captured very often
is cut into spans of time: the last response of every (URL, span) is combined before the shuffle, carried from span to span
over those few rows, and then the rows of each span are filled in on their own; so no task holds all captures of a hot URL.
Payloads are never moved: the result names the response whose payload holds.

A revisit is resolved if its validators agree with that response: the ETag by weak comparison if the revisit has one, else
Last-Modified if it has one, else without a check. The resolved record's headers are the response's, with those a 304 may
update taken from the revisit.

Defined results: a record of null URL or time resolves nothing and is base for nothing. Of full responses at the same time
the largest record id counts, and a revisit sees only responses of a strictly earlier time. Repeated rows resolve alike, a row each. A very long URL is a key like any; headers of any length are carried as text.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confera.llm.common import checkpointed

#: Header fields that a not-modified response updates (RFC 9110, section 15.4.5, and the freshness fields).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age")
SPAN_SECONDS = 86_400


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, no tracking parameters, no slash at the path's end."""
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(head), r"^(http://[^/?]*):80$", "$1"), r"^(https://[^/?]*):443$", "$1")
    tail = F.substr(bare, F.length(head) + 1)
    path = F.regexp_replace(F.regexp_extract(tail, r"^([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(tail, r"^[^?]*\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"))), "&")
    return F.when(url.isNull(), None).otherwise(F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^[Ww]/", "")


def resolve_revisits(records: DataFrame, *, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """records: record_id, url, ts (seconds, bigint), kind ('response' or 'revisit'), headers (map, names in lower case).

    One row per revisit: record_id, canonical_url, ts, base_id, base_ts, status (resolved, mismatch or no_base), headers.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("bigint").alias("ts"), "kind", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    rows = checkpointed(rows.withColumn("span", F.floor(F.col("ts") / span_seconds)))
    known = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    base = F.struct(F.col("ts").alias("ts"), F.col("record_id").alias("id"), F.to_json("headers").alias("headers"))

    # The latest response of each span, carried to the next spans of the URL.
    per_span = rows.filter(known).groupBy("canonical_url", "span").agg(F.max(F.when(F.col("kind") == "response", base)).alias("own"))
    earlier = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = checkpointed(per_span.select("canonical_url", "span", F.last("own", ignorenulls=True).over(earlier).alias("carried")))
    # Within a span: the latest response of an earlier second.
    before = Window.partitionBy("canonical_url", "span").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    inside = rows.filter(known).withColumn("inside", F.max(F.when(F.col("kind") == "response", base)).over(before)).filter("kind = 'revisit'")
    joined = inside.join(carried, ["canonical_url", "span"]).withColumn("base", F.coalesce("inside", "carried")).select("record_id", "canonical_url", "ts", "headers", "base")
    unknown = rows.filter(~known & (F.col("kind") == "revisit")).select("record_id", "canonical_url", "ts", "headers", F.lit(None).cast(joined.schema["base"].dataType).alias("base"))

    both = joined.unionByName(unknown).withColumn("held", F.from_json("base.headers", "map<string,string>"))
    etag, since = F.try_element_at("headers", F.lit("etag")), F.try_element_at("headers", F.lit("last-modified"))
    agrees = F.when(etag.isNotNull(), F.coalesce(_weak(etag) == _weak(F.try_element_at("held", F.lit("etag"))), F.lit(False))).when(since.isNotNull(), F.coalesce(since == F.try_element_at("held", F.lit("last-modified")), F.lit(False))).otherwise(True)
    status = F.when(F.col("base").isNull(), "no_base").when(agrees, "resolved").otherwise("mismatch")
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.map_filter("held", lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh))))
    resolved = F.col("status") == "resolved"
    return both.withColumn("status", status).select("record_id", "canonical_url", "ts", F.when(resolved, F.col("base.id")).alias("base_id"), F.when(resolved, F.col("base.ts")).alias("base_ts"), "status", F.when(resolved, merged).alias("headers"))
