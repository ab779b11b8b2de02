"""URL filters as a temporal list join.

Dated list entries become validity intervals; a capture is judged by the entries that were active when it was
fetched. A key is a domain, which covers its subdomains, or a whole URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenary.session import cut_lineage

ADD, REMOVE = "add", "remove"
FOREVER = "9999-12-31"
#: Types of a time of the day; every other one is read as a date.
INSTANTS = ("timestamp", "timestamp_ntz")


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port or trailing dot; null for a URL without one."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def keys_of(url: Column, host: Column) -> Column:
    """All list keys that can hold a URL: the URL itself, its host, and every parent domain."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    return F.concat(F.array(F.concat(F.lit("url:"), url)), F.coalesce(parents, F.array().cast("array<string>")))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to) from (list, key, day, action), end exclusive.

    `day` is a date or a timestamp. An entry holds from the time it is added to the time it is removed; of both
    at one time the removal counts. Repeated entries change nothing; a null in list, key, day or action voids
    the entry. Entries of one list and key are first reduced to one a time, so with dates a key's history is no
    longer than the calendar however often it is listed.
    """
    whole_rows = entries.select("list", "key", "day", "action").dropna().filter(F.col("action").isin(ADD, REMOVE))
    daily = whole_rows.groupBy("list", "key", "day").agg(F.max(F.col("action") == REMOVE).alias("removed"))
    history = Window.partitionBy("list", "key").orderBy("day")
    changes = daily.withColumn("before", F.lag("removed").over(history)).filter(~F.col("removed").eqNullSafe(F.col("before")))
    spans = changes.withColumn("valid_to", F.coalesce(F.lead("day").over(history), F.lit(FOREVER).cast(entries.schema["day"].dataType)))
    return spans.filter(~F.col("removed")).select("list", "key", F.col("day").alias("valid_from"), "valid_to")


def time_type(*columns: tuple[DataFrame, str]) -> str:
    """The type at which times are compared: an instant where one of the columns is one, else a date."""
    kinds = [df.schema[name].dataType.simpleString() for df, name in columns]
    return next((k for k in INSTANTS if k in kinds), "date")


def judge_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """(id, url, day, host, n_entries, lists, blocked): one row per row of `captures`.

    `n_entries` counts the entries active at the time of the fetch and `lists` names their lists in order. Times
    are timestamps if those of the captures or of the entries are, where a date is its midnight, else dates. A
    capture without URL, host or day meets no domain entry; without URL or day it meets none at all. Each
    (URL, time) is judged once and each key of a time once, so with dates a busy host costs a row per day, not
    per capture; the answer is then joined back to all captures. Only the named columns are read.
    """
    kind = time_type((captures, day_col), (entries, "day"))
    entries = entries.withColumn("day", F.col("day").cast(kind))
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(day_col).cast(kind).alias("day"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    asked = rows.filter("url is not null AND day is not null").groupBy("url", "host", "day").count().drop("count")
    asked = cut_lineage(asked.select("url", "day", F.explode(keys_of(F.col("url"), F.col("host"))).alias("key")))
    per_key = asked.select("key", "day").distinct()
    spans = validity_intervals(entries)
    active = per_key.join(spans, (per_key.key == spans.key) & (F.col("day") >= F.col("valid_from")) & (F.col("day") < F.col("valid_to")))
    active = active.groupBy(per_key.key, "day").agg(F.count(F.lit(1)).alias("n"), F.collect_set("list").alias("lists"))
    per_url = (
        asked.join(cut_lineage(active), ["key", "day"])
        .groupBy("url", "day")
        .agg(F.sum("n").alias("n_entries"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lists")))).alias("lists"))
    )
    judged = rows.join(cut_lineage(per_url), ["url", "day"], "left")
    return judged.select(
        "id", "url", "day", "host",
        F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"),
        F.coalesce("lists", F.array().cast("array<string>")).alias("lists"),
        (F.coalesce("n_entries", F.lit(0)) > 0).alias("blocked"),
    )
