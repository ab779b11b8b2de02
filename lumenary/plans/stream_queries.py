"""Watching queries: batch forms, and streams run to their present end."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.functions.text import file_name
from lumenary.plans.catalog import THR, Catalog, stamp
from lumenary.plans.ingest_queries import FILES, page_folder
from lumenary.plans.registry import query
from lumenary.session import work_path
from lumenary.sources.files import SOURCE_KINDS, list_files, with_sha256
from lumenary.streaming import watch as WA
from lumenary.streaming.online_clusters import stream_clusters

GAP = 1800


def table_stream(c: Catalog, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file of that name or a folder of parts."""
    table, at = c.table(name), f"{name}.parquet"
    reader = c.spark.readStream.schema(table.schema)
    if any(f"/{at}/" in path for path in table.inputFiles()):
        return reader.parquet(f"{c.dir}/{at}")
    return reader.option("pathGlobFilter", at).parquet(c.dir)


@contextmanager
def stored(c: Catalog) -> Iterator[None]:
    """State in the store that keeps entries one by one, for as long as a stream runs."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = c.spark.conf.get(store)
    c.spark.conf.set(store, WA.STORE)
    try:
        yield
    finally:
        c.spark.conf.set(store, before)


def run_to_end(c: Catalog, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a parquet folder and read it back."""
    out, checkpoint = work_path(c.spark, "sink"), work_path(c.spark, "checkpoint")
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return c.spark.read.schema(stream.schema).parquet(out)


@query("w1_watch_files", "pf", "SELECT name, octet_length(encode(body)) AS length FROM pf WHERE media_kind<>'unsupported'", FILES)
def watch(c: Catalog) -> DataFrame:
    rows = WA.watch_files(c.spark, page_folder(c)).select(file_name(F.col("path")).alias("name"), "length")
    return run_to_end(c, rows)


@query(
    "w2_eligible_files", "photos sources",
    """SELECT p.id, CASE WHEN NOT coalesce(s.enabled,false) THEN 'off' WHEN s.root_path LIKE '/archive/%' THEN 'loop' END AS reason FROM photos p LEFT JOIN sources s ON s.id=p.source_id""",
)
def eligible(c: Catalog) -> DataFrame:
    files = c.photos.select("id", "source_id", F.col("original_path").alias("path"))
    rows = WA.eligible_files(files, c.sources, "/archive")
    return rows.select("id", F.when(F.col("reason").contains("禁用"), "off").when(F.col("reason").isNotNull(), "loop").alias("reason"))


@query("w3_normalise_events", "normal_events", "SELECT source_id, path, strftime(ts,'%Y-%m-%d %H:%M:%S') AS ts FROM normal_events")
def normalise(c: Catalog) -> DataFrame:
    return WA.normalise_events(c.watch_events).select("source_id", "path", stamp(F.col("ts")).alias("ts"))


_BURSTS = {
    "bursts": (
        "normal_events",
        f"""SELECT source_id, min(ts) AS opened, max(ts)+INTERVAL {GAP} SECOND AS flushed, list_sort(list(DISTINCT path)) AS paths FROM (SELECT *, sum(o) OVER (PARTITION BY source_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM (
 SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY source_id ORDER BY ts) < INTERVAL {GAP} SECOND THEN 0 ELSE 1 END AS o FROM normal_events)) GROUP BY source_id, b""",
    ),
}
_BURST_SQL = "SELECT source_id, strftime(opened,'%Y-%m-%d %H:%M:%S') AS opened, strftime(flushed,'%Y-%m-%d %H:%M:%S') AS flushed, {0} FROM bursts"


@query("w4_debounce", "bursts", _BURST_SQL.format("unnest(paths) AS path"), _BURSTS)
def debounce(c: Catalog) -> DataFrame:
    rows = WA.debounce_batch(WA.normalise_events(c.watch_events), GAP, 6 * 3600)
    return rows.select("source_id", stamp(F.col("opened_at")).alias("opened"), stamp(F.col("flushed_at")).alias("flushed"), "path")


@query(
    "w4_debounce_stream", "bursts",
    _BURST_SQL.format("unnest(paths) AS path") + " WHERE flushed <= (SELECT max(ts) FROM normal_events) - INTERVAL 10 SECOND", _BURSTS,
)
def debounce_stream(c: Catalog) -> DataFrame:
    """Bursts the watermark has closed; later ones stay open."""
    events = WA.normalise_events(c.watch_events_of(table_stream(c, "events")))
    with stored(c):
        rows = run_to_end(c, WA.debounce(events, GAP))
    return rows.select("source_id", stamp(F.col("opened_at")).alias("opened"), stamp(F.col("flushed_at")).alias("flushed"), "path")


@query(
    "w5_stream_ingest", "pf",
    """SELECT p.name, CASE WHEN p.page_id=f.first AND sha256(p.body) NOT IN (SELECT sha256(html) FROM pages WHERE page_id%20=1) THEN 'imported' ELSE 'duplicate' END AS outcome FROM pf p
 JOIN (SELECT body, max(page_id) AS first FROM pf WHERE media_kind<>'unsupported' GROUP BY body) f ON f.body=p.body WHERE p.media_kind<>'unsupported'""",
    FILES,
)
def ingest_stream(c: Catalog) -> DataFrame:
    root = page_folder(c)
    kind = F.regexp_extract("path", r"/([a-z]+_folder)/", 1)
    files = with_sha256(WA.watch_files(c.spark, root)).withColumn("source_kind", kind).withColumn(
        "source_id", (F.array_position(F.array(*map(F.lit, SOURCE_KINDS)), kind) - 1).cast("long")
    )
    known = c.videos.filter("id % 20 = 1").select("sha256")
    out = work_path(c.spark, "ingest")
    WA.stream_ingest(
        files, known.limit(0), known, out, work_path(c.spark, "checkpoint"), lambda: list_files(c.spark, root)
    ).awaitTermination()
    return c.spark.read.parquet(f"{out}/files").select(file_name(F.col("path")).alias("name"), "outcome")


@query(
    "w6_dedupe", "photos",
    "SELECT sha256, arg_min(id, created_at) AS id FROM photos GROUP BY sha256",
)
def dedupe(c: Catalog) -> DataFrame:
    return WA.dedupe_batch(c.photos.select("sha256", "created_at", "id"), ["created_at", "id"]).select("sha256", "id")


@query("w6_dedupe_stream", "", "SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def dedupe_stream(c: Catalog) -> DataFrame:
    files = table_stream(c, "documents").select(
        F.sha2("text", 256).alias("sha256"),
        F.timestamp_add("SECOND", F.col("doc_id").cast("int"), F.expr("timestamp'2024-01-01'")).alias("modificationTime"),
    )
    return run_to_end(c, WA.stream_dedupe(files)).select("sha256")


_STATUS = {
    "batches": (
        "ev",
        """SELECT user_id%5+1 AS source_id, ts AS started_at, CASE WHEN event_id%40<>0 THEN ts + INTERVAL 1 MINUTE END AS completed_at, CASE WHEN event_type='error' THEN 'error '||event_id END AS error_message
 FROM ev WHERE event_id%20=0 AND user_id%5<>3""",
    ),
}


@query(
    "w7_watch_status", "batches normal_events",
    """SELECT e.source_id, coalesce(b.processing,false) AS processing, count(*) FILTER (b.last IS NULL OR e.ts>b.last) AS queued_file_count, strftime(max(e.ts),'%Y-%m-%d %H:%M:%S') AS last_event_at, max(b.err) AS last_error
 FROM (SELECT source_id, path, max(ts) AS ts FROM normal_events GROUP BY ALL) e LEFT JOIN (SELECT source_id, max(started_at) AS last, bool_or(completed_at IS NULL) AS processing, arg_max_null(error_message, started_at) AS err FROM batches GROUP BY 1) b
 ON b.source_id=e.source_id GROUP BY e.source_id, b.processing""", _STATUS,
)
def status(c: Catalog) -> DataFrame:
    events = WA.normalise_events(c.watch_events)
    batches = c.events.filter("event_id % 20 = 0 and user_id % 5 <> 3").select(
        (F.col("user_id") % 5 + 1).alias("source_id"), F.col("ts").alias("started_at"),
        F.when(F.col("event_id") % 40 != 0, F.col("ts") + F.expr("interval 1 minute")).alias("completed_at"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("error "), "event_id")).alias("error_message"),
    )
    sources = events.select(F.col("source_id").alias("id")).distinct().withColumn("enabled", F.lit(True))
    rows = WA.watch_status(sources, events, batches)
    return rows.select("source_id", "processing", "queued_file_count", stamp(F.col("last_event_at")).alias("last_event_at"), "last_error")


@query("w8_drop_vanished", "normal_events", "SELECT DISTINCT source_id, path FROM normal_events WHERE path NOT LIKE '/src/m%'")
def vanished(c: Catalog) -> DataFrame:
    events = WA.normalise_events(c.watch_events).select("source_id", "path").distinct()
    return WA.drop_vanished(events, events.filter("path not like '/src/m%'"))


@query("w9_stream_clusters")
def online(c: Catalog) -> DataFrame:
    faces = table_stream(c, "embeddings").select(
        (F.col("vec_id") % 4).alias("shard"), F.col("vec_id").alias("face_id"), F.col("vec_id").alias("seq"), "embedding"
    )
    with stored(c):
        return run_to_end(c, stream_clusters(faces, THR))


@query(
    "p13_source_view", "sources",
    "SELECT id, name, enabled, enabled AND id<>0 AS watching, CASE WHEN id<>0 THEN id*3 ELSE 0 END AS queued_file_count FROM sources",
)
def source_view(c: Catalog) -> DataFrame:
    from lumenary.operators.views import source_view as view

    nothing = F.lit(None).cast("timestamp")
    status_rows = c.sources.filter("id <> 0").select(
        F.col("id").alias("source_id"), F.col("enabled").alias("watching"), F.lit(False).alias("processing"),
        (F.col("id") * 3).alias("queued_file_count"), F.lit(None).cast("string").alias("last_error"),
        nothing.alias("last_event_at"), nothing.alias("last_completed_at"),
    )
    return view(c.sources, status_rows).select("id", "name", "enabled", "watching", "queued_file_count")
