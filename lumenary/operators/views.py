"""Catalog rows enriched with names, statistics and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.functions.text import distinct_concat, empty_strings
from lumenary.operators.identity import face_names


def _link(kind: str, key: Column, present: Column) -> Column:
    return F.when(present, F.concat(F.lit(f"/api/v1/{kind}/"), key.cast("string"), F.lit("/asset")))


def _with_names(media: DataFrame, clusters: DataFrame, persons: DataFrame) -> DataFrame:
    named = media.join(face_names(media, clusters, persons), "id", "left")
    names = F.coalesce("face_names", empty_strings())
    return named.withColumn("people", distinct_concat(F.col("people"), names)).withColumn("face_names", names)


def enrich_photos(photos: DataFrame, clusters: DataFrame, persons: DataFrame) -> DataFrame:
    """Adds face_names, merges them into people, and says whether a vector is there."""
    rows = _with_names(photos, clusters, persons)
    ready = F.coalesce(F.size("vector") > 0, F.lit(False)) if "vector" in photos.columns else F.lit(False)
    return rows.withColumn("vector_ready", ready)


def clean_moments(moments: Column) -> Column:
    """Moments of a named person; box entries that are no numbers are dropped."""
    named = F.filter(moments, lambda m: F.coalesce(m["person_name"] != "", F.lit(False)))
    return F.transform(
        named,
        lambda m: m.withField("bbox", F.filter(m["bbox"], lambda x: x.isNotNull())).withField(
            "cluster_label", F.nullif(m["cluster_label"], F.lit(""))
        ),
    )


def enrich_videos(videos: DataFrame, clusters: DataFrame, persons: DataFrame) -> DataFrame:
    rows = enrich_photos(videos, clusters, persons)
    if "person_moments" in videos.columns:
        rows = rows.withColumn("person_moments", clean_moments(F.col("person_moments")))
    has_thumbnail = F.coalesce(F.col("thumbnail_path") != "", F.lit(False))
    url = F.concat(F.lit("/api/v1/videos/"), F.col("id").cast("string"), F.lit("/thumbnail"))
    return rows.withColumn("thumbnail_asset_url", F.when(has_thumbnail, url))


def cluster_view(clusters: DataFrame, stats: DataFrame, photos: DataFrame) -> DataFrame:
    shown = photos.select(F.col("id").alias("example_photo_id"), F.lit(True).alias("exists"))
    return (
        clusters.join(stats, "label", "left")
        .join(shown, "example_photo_id", "left")
        .select(
            "id", "label", "display_name", "example_photo_id",
            _link("photos", F.col("example_photo_id"), F.col("exists")).alias("example_photo_asset_url"),
            F.coalesce("photo_count", F.lit(0)).alias("photo_count"),
            F.coalesce(F.col("display_name") != "", F.lit(False)).alias("named"),
            "latest_photo_at", "created_at", "updated_at",
        )
    )


def person_view(persons: DataFrame, samples: DataFrame, stats: DataFrame) -> DataFrame:
    shown = samples.select(F.col("id").alias("example_sample_id"), F.lit(True).alias("exists"))
    return (
        persons.join(stats.withColumnRenamed("person_id", "id"), "id", "left")
        .join(shown, "example_sample_id", "left")
        .select(
            "id", "name", "example_sample_id",
            _link("person-samples", F.col("example_sample_id"), F.col("exists")).alias("example_sample_asset_url"),
            F.col("sample_count").cast("long").alias("sample_count"),
            F.coalesce("linked_cluster_count", F.lit(0)).alias("linked_cluster_count"),
            F.coalesce("linked_photo_count", F.lit(0)).alias("linked_photo_count"),
            "created_at", "updated_at",
        )
    )


def source_view(sources: DataFrame, status: DataFrame) -> DataFrame:
    """Sources with their watch status; an unwatched source has nothing queued."""
    rows = sources.join(status.withColumnRenamed("source_id", "id"), "id", "left")
    return rows.select(
        *sources.columns,
        F.coalesce("watching", F.lit(False)).alias("watching"),
        F.coalesce("processing", F.lit(False)).alias("watch_processing"),
        F.coalesce("queued_file_count", F.lit(0)).alias("queued_file_count"),
        F.col("last_error").alias("watch_error"),
        F.col("last_event_at").alias("last_watch_event_at"),
        F.col("last_completed_at").alias("last_watch_completed_at"),
    )


def sample_view(samples: DataFrame) -> DataFrame:
    return samples.select(
        "id", "person_id", "original_filename",
        _link("person-samples", F.col("id"), F.lit(True)).alias("asset_url"), "created_at",
    ).orderBy(F.desc("created_at"), F.desc("id"))
