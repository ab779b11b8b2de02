"""From files to catalog rows: dedupe, archive names, new rows, upserts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenary.functions.text import distinct_concat, empty_strings, file_name
from lumenary.schemas import LATE_COLUMN_DEFAULTS, MOMENT
from lumenary.session import cut_lineage


def _age() -> list[Column]:
    """Newest first, then by path."""
    return [-F.unix_micros("modificationTime"), F.col("path")]


def _place(files: DataFrame) -> Column:
    """Where a listing row stands in its batch: newest first, then by path, then by source."""
    source = [F.col("source_id")] if "source_id" in files.columns else []
    return F.struct(*[c.alias(n) for c, n in zip([*_age(), *source], ("age", "path", "source_id"))])


def ingest_batch(files: DataFrame, photos: DataFrame, videos: DataFrame) -> DataFrame:
    """Adds `outcome` to files (path, modificationTime, media_kind, sha256[, source_id]): imported, duplicate, unsupported.

    A file that two sources list is imported for the smaller source and a duplicate for the other. The first copy of a digest in a batch is a combinable minimum, so copies are reduced before the
    shuffle. Files of no supported kind neither count nor claim a digest. Of the catalog only digests of the
    batch go further than the scan, by a semi-join that broadcasts the batch while it is small.
    """
    usable = files.filter("media_kind <> 'unsupported'")
    place = _place(files)
    first = usable.groupBy("sha256").agg(F.min(place).alias("first"))
    catalog = photos.select("sha256").unionByName(videos.select("sha256"))
    known = catalog.join(first.select("sha256"), "sha256", "left_semi").distinct().withColumn("known", F.lit(True))
    rows = files.join(first.join(known, "sha256", "left"), "sha256", "left")
    new = F.col("known").isNull() & (place == F.col("first"))
    outcome = F.when(F.col("media_kind") == "unsupported", "unsupported").when(new, "imported").otherwise("duplicate")
    return rows.withColumn("outcome", outcome).drop("first", "known")


def import_job_summary(classified: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(source_id, scanned_count, imported_count, duplicate_count, status, error_message)."""
    counts = classified.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("scanned_count"),
        F.count_if(F.col("outcome") == "imported").alias("imported_count"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicate_count"),
    )
    if errors is None:
        rows = counts.withColumn("error_message", F.lit(None).cast("string"))
    else:
        rows = counts.join(errors.select("source_id", "error_message"), "source_id", "left")
    return rows.withColumn("status", F.when(F.col("error_message").isNotNull(), "failed").otherwise("completed"))


# --- archive names ----------------------------------------------------------------------------------


def spread_sum(df: DataFrame, key: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Running sum of `value` in each key, in order, without gathering a key in one task.

    Rows are range-partitioned by key and order, summed inside their partition, and shifted by the
    sums of the partitions before. The range partitioning is checkpointed so that both see the same
    split even after a lost executor.
    """
    ranged = cut_lineage(df.withColumn("_value", value).repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*key, "_part").agg(F.sum("_value").alias("_n"))
    before = W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(*key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = W.partitionBy(*key, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = ranged.withColumn("_run", F.sum("_value").over(inside)).join(shifts, [*key, "_part"])
    return rows.withColumn(out, F.col("_shift") + F.col("_run")).drop("_value", "_part", "_run", "_shift")


def spread_rank(df: DataFrame, key: list[str], order: list[str], out: str) -> DataFrame:
    """0-based rank of each row in its key; rows of a key differ in the order."""
    return spread_sum(df, key, order, F.lit(1).cast("long"), out).withColumn(out, F.col(out) - 1)


def _slot(name: Column, counter: Column) -> Column:
    numbered = F.concat(
        F.regexp_replace(name, r"^(.+?)(\.[^.]+)?$", "$1"), F.lit("_"), counter.cast("string"),
        F.regexp_extract(name, r"^.+?(\.[^.]+)?$", 1),
    )
    return F.when(counter == 0, name).otherwise(numbered)


def _claims(names: DataFrame) -> DataFrame:
    """(name, counter) pairs that write the given file name: itself, and as a numbered copy."""
    number = F.regexp_extract("file", r"^.+_([1-9][0-9]{0,17})(\.[^.]+)?$", 1)
    parent = F.concat(
        F.regexp_extract("file", r"^(.+)_[1-9][0-9]{0,17}(?:\.[^.]+)?$", 1), F.regexp_extract("file", r"^.+?_[1-9][0-9]{0,17}(\.[^.]+)?$", 1)
    )
    pairs = F.array(
        F.struct(F.col("file").alias("name"), F.lit(0).cast("long").alias("counter")),
        F.struct(F.when(number != "", parent).alias("name"), F.try_to_number(number, F.lit("999999999999999999")).cast("long").alias("counter")),
    )
    return names.select(F.explode(pairs).alias("p")).select("p.*").filter("name is not null")


def assign_archive_paths(files: DataFrame, existing: DataFrame, folder: str) -> DataFrame:
    """Adds `archive_path`: the first free of name, stem_1, stem_2, … when files come newest first.

    Files of one name take its free numbers in order. Where two names write the same text (`a_1.jpg`
    and the first copy of `a.jpg`) the earlier file keeps it and the other name skips that number,
    until nothing clashes; the outcome is that of handling the files one by one.
    """
    rows = files.withColumns({"name": file_name(F.col("path")), "_age": _age()[0]})
    ranked = cut_lineage(spread_rank(rows, ["name"], ["_age", "path"], "rank"))
    prefix = folder.rstrip("/") + "/"
    taken = existing.filter(F.col("archive_path").startswith(prefix)).select(
        F.substring("archive_path", F.lit(len(prefix) + 1), F.length("archive_path")).alias("file")
    )
    blocked = cut_lineage(_claims(taken.distinct()).join(ranked.select("name").distinct(), "name", "left_semi"))
    while True:
        # the i-th blocked number b pushes every rank from b - i on by one; runs of numbers share a step
        steps = spread_rank(blocked, ["name"], ["counter"], "i").groupBy("name", (F.col("counter") - F.col("i")).alias("at")).agg(
            F.count(F.lit(1)).alias("n")
        )
        # steps and ranks in one order: what stands before a rank is summed as it goes
        line = ranked.select("name", F.col("rank").alias("at"), F.lit(1).alias("turn"), F.lit(0).cast("long").alias("n"), F.struct(*ranked.columns).alias("row"))
        line = line.unionByName(steps.select("name", "at", F.lit(0).alias("turn"), "n"), allowMissingColumns=True)
        pushed = spread_sum(line, ["name"], ["at", "turn"], F.col("n"), "pushed").filter("turn = 1")
        placed = pushed.select("row.*", (F.col("at") + F.col("pushed")).alias("counter"))
        placed = cut_lineage(placed.withColumn("file", _slot(F.col("name"), F.col("counter"))))
        first = placed.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_age", "path")).alias("w")).filter("n > 1")
        lost = placed.join(first, "file").filter(F.struct("_age", "path") != F.col("w")).select("name", "counter")
        lost = cut_lineage(lost)
        if lost.isEmpty():
            break
        blocked = cut_lineage(blocked.unionByName(lost).distinct())
    return placed.withColumn("archive_path", F.concat(F.lit(prefix), "file")).drop("name", "_age", "rank", "counter", "file")


# --- rows -------------------------------------------------------------------------------------------


def _source_columns() -> dict[str, Column]:
    return {
        "external_id": F.col("path"), "original_path": F.col("path"), "storage_path": F.col("archive_path"),
        "taken_at": F.col("modificationTime"), "created_at": F.current_timestamp(),
    }


_KEPT = ("source_id", "source_kind", "source_name", "sha256")


def _or_empty(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column), empty_strings()) if column in df.columns else empty_strings()


def _or_null(df: DataFrame, column: str, ddl: str) -> Column:
    return (F.col(column) if column in df.columns else F.lit(None)).cast(ddl)


def _build(files: DataFrame, extra: Mapping[str, Column]) -> DataFrame:
    lists = {c: _or_empty(files, c) for c in ("scene_tags", "object_tags", "face_clusters")}
    people = distinct_concat(_or_empty(files, "people"), _or_empty(files, "face_names"))
    texts = {c: _or_null(files, c, "string") for c in ("caption", "ocr_text")}
    count = F.coalesce(_or_null(files, "face_count", "int"), F.lit(0))
    columns = {
        # the digest is unique in the catalog, so it gives a stable id
        "id": F.shiftrightunsigned(F.xxhash64("sha256"), 1), **{c: F.col(c) for c in _KEPT}, **_source_columns(), **texts,
        "people": people, **lists, "face_count": count, "vector": _or_null(files, "vector", "array<double>"), **extra,
    }
    return files.select(*[c.alias(n) for n, c in columns.items()])


def build_photo_rows(files: DataFrame) -> DataFrame:
    """Photos of imported image files. Analysis columns are taken where present, else empty."""
    extra = {"phash": _or_null(files, "phash", "string")}
    extra |= {c: _or_null(files, c, "int") for c in ("width", "height")}
    return _build(files, extra)


def build_video_rows(files: DataFrame) -> DataFrame:
    extra = {
        "thumbnail_path": _or_null(files, "thumbnail_path", "string"),
        "person_moments": F.coalesce(_or_null(files, "person_moments", f"array<{MOMENT}>"), F.array().cast(f"array<{MOMENT}>")),
        "duration_seconds": _or_null(files, "duration_seconds", "double"),
        **{c: _or_null(files, c, "int") for c in ("frame_width", "frame_height")},
        "fps": _or_null(files, "fps", "double"),
        "sampled_frame_count": F.coalesce(_or_null(files, "sampled_frame_count", "int"), F.lit(0)),
    }
    return _build(files, extra)


def upsert(base: DataFrame, updates: DataFrame, key: str, stamp: str | None = None, order: str | None = None) -> DataFrame:
    """Rows of updates replace or join those of base; `stamp` gets the current time.

    Of several updates of a key the one with the highest `order` counts; without `order` that is an error.
    """
    row = F.struct(*[c for c in updates.columns if c != order])
    if order is not None:
        one = F.max_by(row, order)
    else:
        one = F.when(F.count(F.lit(1)) == 1, F.any_value(row)).otherwise(F.raise_error(F.lit(f"several updates of one {key}")))
    new = updates.groupBy(F.col(key).alias("_key")).agg(one.alias("_row")).select("_row.*")
    new = new if stamp is None else new.withColumn(stamp, F.current_timestamp())
    return base.join(new.select(key), key, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def evolve(df: DataFrame, target: StructType, defaults: Mapping[str, object] = LATE_COLUMN_DEFAULTS) -> DataFrame:
    """Adds only the missing columns of the target, with their default; further columns stay."""
    missing = [f for f in target.fields if f.name not in df.columns]
    added = {f.name: F.lit(defaults.get(f.name)).cast(f.dataType) for f in missing}
    return df.withColumns(added) if added else df
