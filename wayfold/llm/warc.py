"""Resolution of not-modified revisits in web captures, with native columns only.

A revisit says that a page had not changed. It stands for the latest earlier full response of the same canonical
URL, if their validators agree; the headers a 304 may carry replace those of the response. The as-of join is a
window over captures in order of URL and time, dealt by range, so that captures of one URL can be
spread over many tasks; what the tasks before know is carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.tables import partitions, stored

# The headers a not-modified response may change, and query parameters that do not name a page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)$"

RESOLVED, NO_RESPONSE, NO_VALIDATOR, CHANGED = "resolved", "no_response", "no_validator", "changed"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, default port, fragment and tracking parameters.

    The scheme does not count, empty paths are ``/``, a trailing slash goes, parameters are sorted. Null stays null.
    """
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(path, r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    params = F.filter(
        F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).rlike(TRACKING)
    )
    sorted_query = F.array_join(F.array_sort(params), "&")
    mark = F.when(sorted_query == "", "").otherwise(F.lit("?"))
    return F.concat(host, F.when(path == "", "/").otherwise(path), mark, sorted_query)


def weak(etag: Column) -> Column:
    """An entity tag for weak comparison: without the weakness mark."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def _header(headers: str, name: str) -> Column:
    return F.element_at(F.col(headers), name)


def lower_names(headers: Column) -> Column:
    """A header map with names in lower case; of names that then are equal the last by order stays."""
    pairs = F.transform(
        F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
    )
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    return F.map_from_arrays(
        names,
        F.transform(
            names, lambda n: F.element_at(F.filter(pairs, lambda e: e["key"] == n), -1)["value"]
        ),
    )


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, with those the revisit has and may change."""
    allowed = F.map_filter(revisit, lambda k, _: k.isin(*PERMITTED))
    untouched = F.map_filter(response, lambda k, _: ~F.map_contains_key(allowed, k))
    return F.map_concat(untouched, allowed)


def verdict(base_id: Column, base_etag: Column, base_modified: Column, etag: Column, modified: Column) -> Column:
    """What becomes of a revisit.

    Entity tags decide when the revisit has one (a response without one is not known to be the same);
    otherwise equal Last-Modified values do. A revisit with neither cannot be checked.
    """
    return (
        F.when(base_id.isNull(), NO_RESPONSE)
        .when(etag.isNotNull(), F.when(weak(base_etag) == weak(etag), RESOLVED).otherwise(CHANGED))
        .when(modified.isNotNull(), F.when(base_modified == modified, RESOLVED).otherwise(CHANGED))
        .otherwise(NO_VALIDATOR)
    )


def resolve_revisits(
    captures: DataFrame,
    id_col: str = "record_id",
    url_col: str = "url",
    time_col: str = "captured_at",
    status_col: str = "status",
    headers_col: str = "headers",
) -> DataFrame:
    """The response each not-modified revisit stands for.

    ``captures``: an id, a URL, a time, a status (200 full response, 304 revisit; others take no part) and
    a map of headers. One row for each revisit: id, ``url_key``, ``base_id`` (the latest full response of the
    URL that is strictly earlier; of several at one time the one with the largest id), ``verdict`` and
    ``headers``, merged when the verdict is ``resolved``, else null. A revisit with null URL or time has
    verdict ``no_response``; responses with null id, URL or time answer nothing; null headers are none.
    Rows are told apart by themselves, not by id: revisits with null or repeated ids keep their own headers, and of
    responses with one id and time the one stored last answers. Other columns are left out,
    whatever their names.
    """
    spark = captures.sparkSession
    rows = captures.where(F.col(f"`{status_col}`").isin(200, 304)).select(
        F.col(f"`{id_col}`").alias("id"),
        canonical_url(F.col(f"`{url_col}`")).alias("url_key"),
        F.col(f"`{time_col}`").alias("at"),
        (F.col(f"`{status_col}`") == 200).alias("full"),
        lower_names(F.col(f"`{headers_col}`")).alias("headers"),
    )
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "captures")
    keyed = rows.where(F.col("url_key").isNotNull() & F.col("at").isNotNull()).select(
        "row",
        "id",
        "url_key",
        "at",
        "full",
        _header("headers", "etag").alias("etag"),
        _header("headers", "last-modified").alias("modified"),
    )
    # Captures of one URL at one time share a range; a URL with very many fills several.
    dealt = keyed.repartitionByRange(partitions(spark), "url_key", "at").withColumn(
        "part", F.spark_partition_id()
    )
    dealt = stored(dealt, "dealt")
    usable = F.col("full") & F.col("id").isNotNull()
    base = F.when(usable, F.struct("at", "id", "row", "etag", "modified"))
    before = Window.partitionBy("part", "url_key").orderBy("at", "full", "id", "row").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Revisits sort before responses of their time, so what precedes them is strictly earlier.
    here = dealt.withColumn("base", F.last(base, ignorenulls=True).over(before)).where(~F.col("full"))
    spans = dealt.groupBy("url_key").agg(
        F.min("part").alias("low"), F.max("part").alias("high")
    ).where("low < high")
    # Each border between ranges has at most one such URL: at most twice the number of ranges in rows.
    ends = (
        dealt.join(F.broadcast(spans.select("url_key")), "url_key", "left_semi")
        .groupBy("url_key", "part")
        .agg(F.max(base).alias("last"))
    )
    earlier = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).drop("last")
    known = here.join(F.broadcast(carried), ["url_key", "part"], "left").withColumn(
        "base", F.coalesce("base", "carried")
    )
    checked = known.select(
        "row",
        "id",
        "url_key",
        F.col("base.id").alias("base_id"),
        F.col("base.row").alias("base_row"),
        verdict(
            F.col("base.id"), F.col("base.etag"), F.col("base.modified"), F.col("etag"), F.col("modified")
        ).alias("verdict"),
    )
    lost = rows.where(~F.col("full") & (F.col("url_key").isNull() | F.col("at").isNull())).select(
        "row",
        "id",
        "url_key",
        F.lit(None).cast(rows.schema["id"].dataType).alias("base_id"),
        F.lit(None).cast("long").alias("base_row"),
        F.lit(NO_RESPONSE).alias("verdict"),
    )
    own = rows.where(~F.col("full")).select("row", F.col("headers").alias("own"))
    answers = rows.where("full").select(F.col("row").alias("base_row"), F.col("headers").alias("theirs"))
    merged = merged_headers(
        F.coalesce("theirs", F.create_map().cast("map<string,string>")),
        F.coalesce("own", F.create_map().cast("map<string,string>")),
    )
    return (
        checked.union(lost)
        .join(own, "row", "left")
        .join(answers, "base_row", "left")
        .select(
            F.col("id").alias(id_col),
            "url_key",
            "base_id",
            "verdict",
            F.when(F.col("verdict") == RESOLVED, merged).alias("headers"),
        )
    )
