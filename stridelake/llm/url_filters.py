"""URL filters with dated lists: an as-of join of captures with the entries active when they were fetched.

List entries say that on a day a list adds or removes a host, a domain with all below it, or the beginning of a
path. Per list and value they become validity intervals: an addition holds from its day until the next entry
of that value. A capture offers its host, each of its parent domains and each leading part of its path, and meets
the intervals of these values that hold its fetch day.

Values that no list has are thinned out before the shuffle by a filter of bounded size, and each url and day is
looked up once, however often it was captured. On one day a removal outweighs an addition,
and repeated entries count once. Entries with a null part say nothing. A capture with a null or malformed
url, or without fetch day, is not blocked; one without page_id is judged like any other. Repeated captures get a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, maybe_in

# as a browser reads them: blanks and control characters around a url do not count, a scheme may be left to the page, and the
# host stands behind the last @ of the authority
_EDGES = r"^[\x00-\x20]+|[\x00-\x20]+$"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
_HOST = _AUTHORITY + r"(?:[^/?#]*@)?([^/?#:@]*)"
_PATH = _AUTHORITY + r"[^/?#]*(/[^?#]*)"


def _bare(url: Column) -> Column:
    return F.regexp_replace(url, _EDGES, "")


def host(url: Column) -> Column:
    """Lower-cased host without user, port and last dot; empty where there is none."""
    return F.rtrim(F.lower(F.regexp_extract(_bare(url), _HOST, 1)), F.lit("."))


def path_parts(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(_bare(url), _PATH, 1), "/"), lambda p: p != "")


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, value, since, until) of (list, kind, value, action, day); ``until`` is exclusive, null if open.

    ``kind`` is host, domain or path; ``action`` is add or remove.
    """
    whole = entries.select("list", "kind", F.lower("value").alias("value"), "action", "day").where(
        "list is not null and kind is not null and value is not null and day is not null and action in ('add', 'remove')")
    days = whole.groupBy("list", "kind", "value", "day").agg(F.max("action").alias("action"))  # remove > add
    later = Window.partitionBy("list", "kind", "value").orderBy("day")
    return (days.withColumn("until", F.lead("day").over(later)).where("action = 'add'")
            .select("list", "kind", "value", F.col("day").alias("since"), "until"))


def offered(captures: DataFrame) -> DataFrame:
    """(url, fetched, kind, value): all values under which a list may have the capture."""
    parts = captures.select("url", "fetched", host(F.col("url")).alias("host"), path_parts(F.col("url")).alias("parts")).where("host <> ''")
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    paths = F.when(F.size("parts") > 0, F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.struct(
        F.lit("path").alias("kind"), F.lower(F.concat("host", F.lit("/"), F.array_join(F.slice("parts", F.lit(1), i), "/"))).alias("value")))
    ).otherwise(F.array().cast("array<struct<kind: string, value: string>>"))
    own = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("value")))
    return (parts.select("url", "fetched", F.explode(F.concat(own, domains, paths)).alias("key"))
            .select("url", "fetched", "key.kind", "key.value"))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched, blocked, matches) of captures (page_id, url, fetched).

    ``matches`` holds list, kind, value and since of every entry that blocks the capture. What blocks it depends on url and
    day alone, so a capture is judged whatever its page_id, null included.
    """
    own = captures.select("page_id", "url", "fetched")
    active = intervals(entries)
    keys = maybe_in(offered(own.select("url", "fetched").distinct()), F.concat_ws(" ", "kind", "value"), active, F.concat_ws(" ", "kind", "value"))
    within = (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    # kept as a table, so that both sides of the last join are dealt anew and a much captured url can be split
    hit = cut(keys.join(active, ["kind", "value"]).where(within).groupBy("url", "fetched")
              .agg(F.array_sort(F.collect_set(F.struct("list", "kind", "value", "since"))).alias("matches")))
    none = F.array().cast(hit.schema["matches"].dataType)
    return (own.join(hit, ["url", "fetched"], "left")
            .select("page_id", "url", "fetched", F.col("matches").isNotNull().alias("blocked"), F.coalesce("matches", none).alias("matches")))
