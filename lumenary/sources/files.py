"""Media files as tables: listings, kinds, content."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.functions.text import file_suffix

# Suffixes of each kind, and the kinds of source.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".heic")
VIDEO_SUFFIXES = (".mp4", ".mov", ".m4v", ".avi", ".mkv", ".webm")
SOURCE_KINDS = ("local_folder", "wechat_folder", "qq_folder")


def media_kind(path: Column) -> Column:
    suffix = F.lower(file_suffix(path))
    return (
        F.when(suffix.isin(*IMAGE_SUFFIXES), "image").when(suffix.isin(*VIDEO_SUFFIXES), "video").otherwise("unsupported")
    )


def with_media_kind(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumn("media_kind", media_kind(F.col(path)))


def supported(df: DataFrame, path: str = "path") -> DataFrame:
    return with_media_kind(df, path).filter("media_kind <> 'unsupported'")


def newest_media(listing: DataFrame, limit: int | None = None) -> DataFrame:
    """Supported files of a listing (path, modificationTime, …), newest first."""
    rows = supported(listing).orderBy(F.desc("modificationTime"), "path")
    return rows if limit is None else rows.limit(limit)


def _reader(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Folder does not exist: {root}") from error
        raise


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime, length of every file below root; contents are not read."""
    return _plain(_reader(spark, root).select("path", "modificationTime", "length"))


def discover(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    return newest_media(list_files(spark, root), limit)


def read_contents(spark: SparkSession, root: str) -> DataFrame:
    """As list_files, with content."""
    return _plain(_reader(spark, root))


def with_sha256(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("sha256", F.sha2(content, 256))


def check_kind(kind: str) -> str:
    if kind not in SOURCE_KINDS:
        raise ValueError(f"Unsupported source kind: {kind}")
    return kind


def scan_sources(spark: SparkSession, sources: Sequence[tuple[int, str, str]], contents: bool = False) -> DataFrame:
    """Files of several (source_id, kind, root_path), tagged with their source."""
    read = read_contents if contents else list_files
    parts = [
        read(spark, root).withColumns({"source_id": F.lit(source_id).cast("long"), "source_kind": F.lit(check_kind(kind))})
        for source_id, kind, root in sources
    ]
    return supported(reduce(DataFrame.unionByName, parts))


def select_paths(files: DataFrame, paths: DataFrame, limit: int | None = None) -> DataFrame:
    """Listed paths that exist."""
    rows = files.join(paths.select("path").distinct(), "path", "left_semi")
    return rows if limit is None else rows.limit(limit)


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images below root (struct `image`); undecodable files stay, with size -1."""
    return spark.read.format("image").option("recursiveFileLookup", "true").load(root)
