"""Watching folders: events, debounce, streaming ingest and status."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lumenary.operators.ingest import import_job_summary, ingest_batch
from lumenary.session import materialize
from lumenary.sources.files import media_kind, supported, with_media_kind
from lumenary.sources.files import select_paths as _select

LATENESS = "10 seconds"
_FILE = "path string, modificationTime timestamp, length long, content binary"


def watch_files(spark: SparkSession, root: str, per_trigger: int | None = None) -> DataFrame:
    """Stream of the files that appear anywhere below root."""
    reader = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    files = reader.load(root)
    return supported(files.withColumn("path", F.regexp_replace("path", "^file:(//)?", "")))


def _inside(path: Column, root: str) -> Column:
    bare = root.rstrip("/")
    return (path == bare) | path.startswith(bare + "/")


def eligible_files(files: DataFrame, sources: DataFrame, archive_root: str) -> DataFrame:
    """Adds `reason` (null when the file may be imported): source unknown or off, or archive inside."""
    known = sources.select(F.col("id").alias("source_id"), "enabled", "root_path")
    rows = files.join(known, "source_id", "left")
    off = ~F.coalesce("enabled", F.lit(False))
    looped = _inside(F.col("root_path"), archive_root) | _inside(F.col("path"), archive_root)
    reason = F.when(off, "来源不存在或已被禁用。").when(looped, "来源目录位于归档目录内部，已跳过以避免循环导入。")
    return rows.withColumn("reason", reason).drop("enabled", "root_path")


def normalise_events(events: DataFrame) -> DataFrame:
    """(source_id, path, ts): a move counts for its destination; folders and other files are dropped."""
    path = F.coalesce(F.nullif("dest_path", F.lit("")), "src_path")
    rows = events.filter("not is_directory").select("source_id", path.alias("path"), "ts")
    return rows.filter(media_kind(F.col("path")) != "unsupported")


BURST = "source_id long, opened_at timestamp, flushed_at timestamp, path string"
#: The state store that keeps map entries one by one, outside memory.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Bursts(StatefulProcessor):
    """Open bursts of a source: their spans as a list, their paths in map entries of bounded length.

    Times are microseconds. Spans that may still meet lie within the lateness, so the list is short. A burst's paths
    are dealt by hash to entries, twice as many whenever one grows beyond FULL, so an entry is all that is in memory.
    One timer stands at the earliest end.
    """

    FULL = 4_096

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "lo long, hi long, entries int")
        self.paths = handle.getMapState("paths", "lo long, entry int", "paths array<string>")

    def _due(self, hi: int) -> int:
        """The first whole millisecond at which nothing can join a burst any more."""
        return -(-(hi + self.gap) // 1000)

    def _open(self) -> list[tuple[int, int, int]]:
        return [tuple(map(int, s)) for s in self.spans.get()] if self.spans.exists() else []

    def _put(self, spans: list[tuple[int, int, int]], before: int | None) -> None:
        first = min((self._due(hi) for _, hi, _ in spans), default=None)
        if spans:
            self.spans.put(spans)
        else:
            self.spans.clear()
        if first != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if first is not None:
                self.handle.registerTimer(first)

    def _read(self, lo: int, entry: int) -> list[str]:
        return list(self.paths.getValue((lo, entry))[0]) if self.paths.containsKey((lo, entry)) else []

    def _add(self, lo: int, entries: int, fresh: bool, paths: Iterable[str]) -> int:
        """Add paths to a burst; the number of its entries after it."""
        dealt: dict[int, set[str]] = {}
        for path in paths:
            dealt.setdefault(zlib.crc32(path.encode()) % entries, set()).add(path)
        for entry, new in dealt.items():
            held = new if fresh else new.union(self._read(lo, entry))
            self.paths.updateValue((lo, entry), (sorted(held),))
            if len(held) > self.FULL:
                moved = [self._read(lo, e) for e in range(entries)]
                rest = [p for e, new in dealt.items() for p in new]
                for e, some in enumerate(moved):
                    for half in (e, e + entries):
                        self.paths.updateValue((lo, half), (sorted(p for p in some if zlib.crc32(p.encode()) % (2 * entries) == half),))
                return self._add(lo, 2 * entries, False, rest)
        return entries

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self._open()
        before = min((self._due(hi) for _, hi, _ in old), default=None)
        known = {lo: entries for lo, _, entries in old}
        for batch in rows:
            # bursts of the batch by itself, then together with the open ones
            batch = batch.sort_values("us")
            us = batch["us"].to_numpy()
            burst = np.cumsum(np.diff(us, prepend=us[0]) >= self.gap)
            parts = [(int(p["us"].iloc[0]), int(p["us"].iloc[-1]), p["path"].unique()) for _, p in batch.groupby(burst)]
            for lo, hi, paths in parts:
                near = [s for s in old if s[0] - self.gap < hi and lo < s[1] + self.gap]
                start, end = min([lo, *(s[0] for s in near)]), max([hi, *(s[1] for s in near)])
                entries = self._add(start, known.get(start, 1), start not in known, paths)
                for gone, _, held in near:
                    if gone != start:
                        for entry in range(held):
                            entries = self._add(start, entries, False, self._read(gone, entry))
                            self.paths.removeKey((gone, entry))
                        del known[gone]
                known[start] = entries
                old = [s for s in old if s not in near] + [(start, end, entries)]
        self._put(sorted(old), before)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        spans = self._open()
        for lo, hi, entries in spans:
            if self._due(hi) <= now:
                for entry in range(entries):
                    if some := self._read(lo, entry):
                        ends = {"source_id": key[0], "opened_at": pd.Timestamp(lo, unit="us"), "flushed_at": pd.Timestamp(hi + self.gap, unit="us")}
                        yield pd.DataFrame({"path": some}).assign(**ends)[["source_id", "opened_at", "flushed_at", "path"]]
                        self.paths.removeKey((lo, entry))
        self._put([s for s in spans if self._due(s[1]) > now], None)

    def close(self) -> None:
        pass


def debounce(events: DataFrame, gap_seconds: float = 3.0, lateness: str = LATENESS) -> DataFrame:
    """Streaming: (source_id, opened_at, flushed_at, path), a row per path once a source was quiet for the gap.

    The paths of an open burst are entries of the state store (RocksDB: set STORE as the provider), so a burst
    that never ends fills no row and no list.
    """
    timed = events.withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("source_id").transformWithStateInPandas(
        statefulProcessor=_Bursts(int(gap_seconds * 1_000_000)), outputStructType=BURST, outputMode="Append", timeMode="EventTime"
    )


def debounce_batch(events: DataFrame, gap_seconds: float = 3.0, slice_seconds: int = 86_400) -> DataFrame:
    """The same over a finished table, one row per burst and path: (source_id, opened_at, flushed_at, path).

    A busy source is cut into time slices: gaps are found inside each slice, slices are stitched over
    their first and last event only, so no source is sorted in one task.
    """
    gap = int(gap_seconds * 1_000_000)
    rows = events.withColumn("us", F.unix_micros("ts")).withColumn("slice", F.floor(F.col("us") / (slice_seconds * 1_000_000)))
    inside = W.partitionBy("source_id", "slice").orderBy("us")
    rows = rows.withColumn("opens", (F.col("us") - F.lag("us").over(inside) >= gap).cast("int"))
    slices = rows.groupBy("source_id", "slice").agg(
        F.min("us").alias("lo"), F.max("us").alias("hi"), F.coalesce(F.sum("opens"), F.lit(0)).alias("opens")
    )
    order = W.partitionBy("source_id").orderBy("slice")
    fresh = F.coalesce((F.col("lo") - F.lag("hi").over(order) >= gap).cast("int"), F.lit(1))
    slices = slices.withColumn("fresh", fresh).withColumn(
        "base", F.sum(F.col("opens") + F.col("fresh")).over(order) - F.col("opens")
    )
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = rows.join(slices.select("source_id", "slice", "base"), ["source_id", "slice"]).withColumn(
        "burst", F.coalesce(F.sum("opens").over(running), F.lit(0)) + F.col("base")
    )
    spans = numbered.groupBy("source_id", "burst").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    paths = numbered.select("source_id", "burst", "path").distinct()
    return paths.join(spans, ["source_id", "burst"]).select(
        "source_id", F.timestamp_micros("lo").alias("opened_at"), F.timestamp_micros(F.col("hi") + gap).alias("flushed_at"), "path"
    )


def drop_vanished(batch: DataFrame, listing: DataFrame) -> DataFrame:
    """Only paths the folder still lists."""
    return _select(batch, listing)


def stream_dedupe(files: DataFrame, lateness: str = "1 hour", ts: str = "modificationTime") -> DataFrame:
    """First file of each digest within the lateness (bounded state); older copies meet the catalog in ingest."""
    return files.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["sha256"])


def dedupe_batch(files: DataFrame, order: list[str]) -> DataFrame:
    """First file of each digest of a finished table."""
    rest = [c for c in files.columns if c not in order]
    first = files.groupBy("sha256").agg(F.min(F.struct(*order, *[c for c in rest if c != "sha256"])).alias("f"))
    return first.select("sha256", "f.*").select(*files.columns)


#: Hex digits by which the digest table is divided.
PREFIX = 2


def ingest_micro_batch(
    files: DataFrame, batch_id: int, photos: DataFrame, videos: DataFrame, out: str, listing: DataFrame | None = None
) -> None:
    """One import run. Outcomes go to a folder per batch, so a repeated batch overwrites itself.

    Digests that earlier batches took lie in a table of their own, divided by their first letters, and a batch
    reads only the parts its own digests fall in. Rows of the batch itself, from a run that broke off, don't count.
    """
    spark = files.sparkSession
    one = files.dropDuplicates(["source_id", "path"])
    if listing is not None:
        one = drop_vanished(one, listing)
    if "media_kind" not in one.columns:
        one = with_media_kind(one)
    one = materialize(one.drop("content"), "batch")
    known = photos.select("sha256").unionByName(videos.select("sha256"))
    earlier = taken_digests(spark, out, batch_id, one)
    if earlier is not None:
        known = known.unionByName(earlier)
    rows = ingest_batch(one, known, videos.select("sha256").limit(0))
    target = f"{out}/files/batch={batch_id}"
    rows.withColumn("started_at", F.current_timestamp()).write.mode("overwrite").parquet(target)
    done = spark.read.parquet(target)
    taken = done.filter("outcome = 'imported'").select("sha256", F.lit(batch_id).cast("long").alias("batch"), F.substring("sha256", 1, PREFIX).alias("prefix"))
    taken.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(f"{out}/digests")
    import_job_summary(done).withColumn("completed_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{out}/jobs/batch={batch_id}")


def taken_digests(spark: SparkSession, out: str, before: int, batch: DataFrame) -> DataFrame | None:
    """Digests that batches before the given one took, of those parts only in which the batch has a digest."""
    if before == 0:
        return None
    # at most 16 ** PREFIX short texts
    parts = [r[0] for r in batch.filter("sha256 is not null").select(F.substring("sha256", 1, PREFIX)).distinct().collect()]
    found = None
    for part in sorted(parts):
        try:
            rows = spark.read.schema("sha256 string, batch long").parquet(f"{out}/digests/prefix={part}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found = rows if found is None else found.unionByName(rows)
    return None if found is None else found.filter(F.col("batch") < before).select("sha256")


def stream_ingest(
    files: DataFrame, photos: DataFrame, videos: DataFrame, out: str, checkpoint: str, listing=None
) -> StreamingQuery:
    """Run the stream to its present end. One micro-batch is in flight at a time; arrivals wait for the next.

    listing: a function giving the current listing, asked in every batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        ingest_micro_batch(batch, batch_id, photos, videos, out, listing() if listing else None)

    return (
        files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def watch_status(sources: DataFrame, events: DataFrame, batches: DataFrame) -> DataFrame:
    """(source_id, watching, processing, queued_file_count, last_event_at, last_completed_at, last_error).

    events: source_id, path, ts. batches: source_id, started_at, completed_at (null while running),
    error_message. Paths seen after the last start are queued.
    """
    runs = batches.groupBy("source_id").agg(
        F.max("started_at").alias("last_start"), F.max("completed_at").alias("last_completed_at"),
        F.max_by("error_message", "started_at").alias("last_error"),
        F.coalesce(F.bool_or(F.col("completed_at").isNull()), F.lit(False)).alias("processing"),
    )
    seen = events.groupBy("source_id", "path").agg(F.max("ts").alias("ts"))
    waits = F.col("last_start").isNull() | (F.col("ts") > F.col("last_start"))
    queues = seen.join(runs.select("source_id", "last_start"), "source_id", "left").groupBy("source_id").agg(
        F.max("ts").alias("last_event_at"), F.count_if(waits).alias("queued")
    )
    rows = sources.select(F.col("id").alias("source_id"), F.col("enabled").alias("watching"))
    rows = rows.join(runs, "source_id", "left").join(queues, "source_id", "left")
    return rows.select(
        "source_id", "watching", F.coalesce("processing", F.lit(False)).alias("processing"),
        F.when(F.col("watching"), F.coalesce("queued", F.lit(0))).otherwise(0).cast("long").alias("queued_file_count"),
        "last_event_at", "last_completed_at", "last_error",
    )


def watch_totals(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count_if("watching").alias("active_watches"), F.count_if(F.col("queued_file_count") > 0).alias("queued_sources"),
        F.coalesce(F.bool_or("processing"), F.lit(False)).alias("busy"),
    )
