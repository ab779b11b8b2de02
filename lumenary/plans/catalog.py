"""The given tables read as a media catalog (fixed formulas, the same in Spark and in the check SQL)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.functions import text as X
from lumenary.functions.vector import l2_normalize, mean_vector, zeros
from lumenary.operators import hygiene, identity

DIM = 64
THR = 0.30
EPOCH = "timestamp'2024-01-01 00:00:00'"


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def piped(items: Column) -> Column:
    return F.array_join(items, "|")


def flat_vector(v: Column, digits: int = 4) -> Column:
    """A vector as text, for comparing results; vectors stored with 6 decimals are compared with 6.

    Rounded as SQL does it: multiplied, rounded to a whole number and divided, where Spark rounds the decimals it would show.
    """
    unit = 10.0**digits
    spell = lambda x: F.format_string(f"%.{digits}f", F.round(x * unit) / unit + 0.0)
    return F.array_join(F.transform(v.cast("array<double>"), spell), ",")


def after_epoch(n: Column, unit: str) -> Column:
    return F.timestamp_add(unit, n.cast("int"), F.expr(EPOCH))


class Catalog:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        """A text table, spread over the cores when it has fewer splits than that.

        Text work is heavy per row, and a small file is one split. A large table has many splits and
        is read as it is, without the exchange.
        """
        df = self.table(name)
        cores = self.spark.sparkContext.defaultParallelism
        splits = df._jdf.queryExecution().toRdd().getNumPartitions()
        return df if splits >= cores else df.repartition(cores)

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings")

    def vector_count(self) -> Column:
        return self.vectors.agg(F.count(F.lit(1)).alias("n")).scalar()

    def _vector_labels(self) -> DataFrame:
        slot = F.concat(F.lit("face-"), F.col("label"), F.lit("-"), F.col("vec_id") % 5)
        return self.vectors.select("vec_id", F.col("label").alias("vlabel"), slot.alias("flabel"))

    def _with_faces(self, media: DataFrame) -> DataFrame:
        """face_clusters and the label of the media's own vector."""
        n = self.vector_count()
        first = self._vector_labels().toDF("v1", "vlabel", "f1")
        second = self._vector_labels().toDF("v2", "_l2", "f2")
        both = (
            media.withColumn("v1", F.col("id") % n)
            .withColumn("v2", F.when(F.col("id") % 3 == 0, F.col("id") * 7 % n))
            .join(first, "v1", "left")
            .join(second, "v2", "left")
        )
        return both.withColumn("face_clusters", F.array_compact(F.array("f1", "f2"))).drop("v1", "v2", "f1", "f2", "_l2")

    @cached_property
    def photos(self) -> DataFrame:
        return self._marked(self._photo_files())

    def _photo_files(self) -> DataFrame:
        """What the documents alone say of the photos."""
        d = self.texts("documents")
        doc = F.col("doc_id")
        kind = F.element_at(F.array(*map(F.lit, ("local_folder", "wechat_folder", "qq_folder"))), (doc % 3 + 1).cast("int"))
        name = F.concat(
            F.when(doc % 11 == 0, "thumb_").otherwise("img_"),
            F.lpad(F.floor(doc / 2).cast("string"), 6, "0"),
            F.when(doc % 2 == 1, " copy").otherwise(""),
            F.lit(".jpg"),
        )
        made = after_epoch(doc, "MINUTE")
        return d.select(
            doc.alias("id"),
            (doc % 3).alias("source_id"),
            kind.alias("source_kind"),
            F.col("source").alias("source_name"),
            F.concat(F.lit("/src/"), "source", F.lit("/"), name).alias("original_path"),
            F.concat(F.lit("/archive/"), name).alias("storage_path"),
            F.sha2("text", 256).alias("sha256"),
            F.substring(F.sha1(F.substring(F.lower("text"), 1, 40).cast("binary")), 1, 16).alias("phash"),
            F.col("text").alias("caption"),
            F.when(doc % 5 != 0, F.col("text")).alias("ocr_text"),
            F.array("lang").alias("scene_tags"),
            (doc % 4).cast("int").alias("face_count"),
            (200 + doc * 37 % 1800).cast("int").alias("width"),
            (150 + doc * 53 % 1200).cast("int").alias("height"),
            made.alias("created_at"),
            F.when(doc % 5 != 0, F.timestamp_add("HOUR", (-(doc % 48)).cast("int"), made)).alias("taken_at"),
        )

    def _marked(self, files: DataFrame) -> DataFrame:
        """Photos with people, tags and faces."""
        marks = self.table("labels").select(
            F.col("doc_id").alias("id"),
            F.array_compact(
                F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))
            ).alias("object_tags"),
        )
        texts = [c for c in ("caption", "ocr_text", "caption_key", "has_text") if c in files.columns]
        faced = self._with_faces(files).join(marks, "id", "left")
        return faced.select(
            "id", "source_id", "source_kind", "source_name", F.col("original_path").alias("external_id"),
            "original_path", "storage_path", "sha256", "phash", *texts,
            F.when(F.col("id") % 4 == 0, F.array(F.concat(F.lit("person "), "vlabel"))).otherwise(X.empty_strings()).alias("people"),
            "scene_tags", F.coalesce("object_tags", X.empty_strings()).alias("object_tags"), "face_clusters",
            "face_count", "width", "height", "taken_at", "created_at",
        )

    @cached_property
    def videos(self) -> DataFrame:
        p = self.texts("pages")
        page = F.col("page_id")
        made = after_epoch(page, "MINUTE")
        base = p.select(
            page.alias("id"),
            (page % 3).alias("source_id"),
            F.element_at(F.array(*map(F.lit, ("local_folder", "wechat_folder", "qq_folder"))), (page % 3 + 1).cast("int")).alias("source_kind"),
            F.regexp_extract("url", "^https?://([^/]*)", 1).alias("source_name"),
            F.concat(F.lit("/vid/"), F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", ""), F.lit(".mp4")).alias("original_path"),
            F.concat(F.lit("/archive/v"), page, F.lit(".mp4")).alias("storage_path"),
            F.when(page % 4 != 0, F.concat(F.lit("/frames/video-"), page, F.lit("/thumbnail.jpg"))).alias("thumbnail_path"),
            F.sha2(F.when(page % 10 == 0, F.regexp_extract("html", 'lang="([a-z]*)"', 1)).otherwise(F.col("html")), 256).alias("sha256"),
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("caption"),
            F.when(page % 5 != 0, F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("ocr_text"),
            F.array(F.regexp_extract("html", 'lang="([a-z]*)"', 1)).alias("scene_tags"),
            F.when(page % 3 == 0, F.array(F.lit("page"))).otherwise(X.empty_strings()).alias("object_tags"),
            (page % 4).cast("int").alias("face_count"),
            (1 + F.length("html") % 600 / 10).alias("duration_seconds"),
            (320 + page * 41 % 1600).cast("int").alias("frame_width"),
            (240 + page * 29 % 840).cast("int").alias("frame_height"),
            F.lit(25.0).alias("fps"),
            (page % 24).cast("int").alias("sampled_frame_count"),
            made.alias("created_at"),
            F.when(page % 5 != 0, F.timestamp_add("HOUR", (-(page % 48)).cast("int"), made)).alias("taken_at"),
        )
        faced = self._with_faces(base)
        return faced.withColumn("external_id", F.col("original_path")).withColumn(
            "people",
            F.when(F.col("id") % 4 == 0, F.array(F.concat(F.lit("person "), "vlabel"))).otherwise(X.empty_strings()),
        ).drop("vlabel")

    def photo_text(self) -> list[Column]:
        return [
            F.coalesce("caption", F.lit("")), F.coalesce("ocr_text", F.lit("")), F.concat_ws(" ", "people"),
            F.concat_ws(" ", "scene_tags"), F.concat_ws(" ", "object_tags"),
        ]

    @cached_property
    def photos_with_text_vector(self) -> DataFrame:
        """240 entries: hashed text, and an all-zero image half."""
        v = F.concat(X.text_hash_vector(*self.photo_text(), X.file_stem(F.col("storage_path"))), zeros(112))
        return self.photos.withColumn("vector", v)

    @cached_property
    def photos_with_vector(self) -> DataFrame:
        """The vector of the embeddings table at id % n."""
        return self._with_vector(self.photos)

    @cached_property
    def photos_to_clean(self) -> DataFrame:
        """`photos_with_vector` with the keys of the texts, which are joined with no whole text."""
        return self._with_vector(self._marked(hygiene.with_text_keys(self._photo_files())))

    @cached_property
    def videos_with_vector(self) -> DataFrame:
        return self._with_vector(self.videos)

    def _with_vector(self, media: DataFrame) -> DataFrame:
        v = self.vectors.select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector"))
        return media.withColumn("v", F.col("id") % self.vector_count()).join(v, "v", "left").drop("v")

    @cached_property
    def clusters(self) -> DataFrame:
        b = F.col("vec_id") % 5
        grouped = self.vectors.groupBy("label", b.alias("b")).agg(
            mean_vector(F.col("embedding")).alias("m"), F.min("vec_id").alias("first")
        )
        ident = F.col("label") * 5 + F.col("b") + 1
        return grouped.select(
            ident.cast("long").alias("id"),
            F.concat(F.lit("face-"), "label", F.lit("-"), "b").alias("label"),
            F.when(F.col("b") % 2 == 1, None)
            .when(F.col("b") == 0, F.concat(F.lit("Person "), "label"))
            .otherwise(F.concat(F.lit("Group "), "label", F.lit("-"), "b"))
            .alias("display_name"),
            l2_normalize(F.col("m")).alias("centroid"),
            F.when(F.col("b") < 2, (F.col("label") + 1).cast("long")).alias("person_profile_id"),
            F.when(F.col("b") == 3, F.col("first") + 1_000_000_000).when(F.col("b") != 4, F.col("first")).alias("example_photo_id"),
            after_epoch(ident, "HOUR").alias("created_at"),
            after_epoch(ident * 7 % 50, "HOUR").alias("updated_at"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        v = F.col("vec_id")
        return self.vectors.filter(v % 10 < 3).select(
            v.alias("id"),
            (F.col("label") + 1).cast("long").alias("person_id"),
            F.concat(F.lit("sample_"), v, F.lit(".jpg")).alias("original_filename"),
            F.concat(F.lit("/people/"), v, F.lit(".jpg")).alias("storage_path"),
            "embedding",
            after_epoch(v, "MINUTE").alias("created_at"),
        )

    @cached_property
    def persons(self) -> DataFrame:
        """One person per label, with the profile its samples give."""
        labels = self.vectors.select("label").distinct()
        bare = labels.select(
            (F.col("label") + 1).cast("long").alias("id"),
            F.concat(F.lit("Person "), "label").alias("name"),
            F.concat(F.lit("person "), "label").alias("normalized_name"),
            F.lit(None).cast("array<double>").alias("centroid"),
            F.lit(None).cast("long").alias("example_sample_id"),
            F.lit(0).alias("sample_count"),
            after_epoch(F.col("label"), "HOUR").alias("created_at"),
            after_epoch(F.col("label") * 3 % 7, "HOUR").alias("updated_at"),
        )
        return identity.refresh_profiles(bare, self.samples, DIM)

    @cached_property
    def faces(self) -> DataFrame:
        """One detection per vector, four to a photo and ten to a video."""
        v = F.col("vec_id")
        x1, y1 = (v * 37 % 560).cast("double"), (v * 53 % 400).cast("double")
        return self.vectors.select(
            v.alias("face_id"), F.floor(v / 4).alias("media_id"), F.floor(v / 10).alias("video_id"), v.alias("seq"),
            ((v % 10) * 0.5).alias("frame_t"), x1.alias("x1"), y1.alias("y1"),
            (x1 + 20 + v * 11 % 100).alias("x2"), (y1 + 20 + v * 13 % 90).alias("y2"),
            (0.30 + (v % 70) / 100).alias("det_score"), F.lit(640).alias("image_width"), F.lit(480).alias("image_height"),
            "embedding",
        )

    @cached_property
    def sources(self) -> DataFrame:
        s = self.table("documents").select((F.col("doc_id") % 3).alias("id")).distinct()
        kind = F.element_at(F.array(*map(F.lit, ("local_folder", "wechat_folder", "qq_folder"))), (F.col("id") + 1).cast("int"))
        return s.select(
            "id", F.concat(F.lit("source "), "id").alias("name"), kind.alias("kind"),
            F.element_at(F.array(F.lit("/src"), F.lit("/src/source_1"), F.lit("/archive/in")), (F.col("id") + 1).cast("int")).alias("root_path"),
            (F.col("id") != 1).alias("enabled"), after_epoch(F.col("id"), "DAY").alias("created_at"),
        )

    @cached_property
    def events(self) -> DataFrame:
        e = self.table("events")
        return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
            "k", F.get_json_object("props", "$.k").cast("long")
        )

    def watch_events_of(self, e: DataFrame) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        suffix = F.when(k % 10 == 9, ".txt").otherwise(".jpg")
        return e.select(
            (F.col("user_id") % 5 + 1).alias("source_id"),
            F.concat(F.lit("/src/"), k, suffix).alias("src_path"),
            F.when(F.col("event_type") == "signup", F.concat(F.lit("/src/m"), k, F.lit(".jpg"))).alias("dest_path"),
            F.col("event_type").alias("event_kind"),
            (k % 17 == 0).alias("is_directory"),
            F.col("ts").cast("timestamp").alias("ts"),
        )

    @cached_property
    def watch_events(self) -> DataFrame:
        return self.watch_events_of(self.table("events"))

    @cached_property
    def import_jobs(self) -> DataFrame:
        day = F.date_trunc("DAY", "ts")
        g = self.events.groupBy((F.col("user_id") % 5 + 1).alias("source_id"), day.alias("created_at")).agg(
            F.count(F.lit(1)).alias("scanned_count"),
            F.countDistinct("k").alias("imported_count"),
            F.count_if(F.col("event_type") == "error").alias("errors"),
        )
        failed = F.col("errors") * 4 > F.col("scanned_count")
        return g.select(
            (F.col("source_id") * 1000 + F.dayofyear("created_at")).alias("id"), "source_id",
            F.concat(F.lit("source "), "source_id").alias("source_name"),
            F.when(failed, "failed").otherwise("completed").alias("status"),
            "scanned_count", "imported_count", (F.col("scanned_count") - F.col("imported_count")).alias("duplicate_count"),
            F.when(failed, "read error").alias("error_message"), "created_at", F.col("created_at").alias("updated_at"),
        )

    @cached_property
    def tasks(self) -> DataFrame:
        """One task per event type and day."""
        g = self.events.groupBy("event_type", F.date_trunc("DAY", "ts").alias("created_at")).agg(
            F.count_if(F.col("value") >= 50).alias("completed_items"),
            F.count_if(F.col("value") < 50).alias("failed_items"),
        )
        state = F.element_at(F.array(*map(F.lit, ("queued", "running", "completed", "failed"))), (F.dayofyear("created_at") % 4 + 1).cast("int"))
        return g.select(
            F.xxhash64("event_type", "created_at").alias("id"), F.col("event_type").alias("task_type"),
            state.alias("status"), (F.col("completed_items") + F.col("failed_items") + F.dayofyear("created_at") % 2).alias("total_items"),
            "completed_items", "failed_items", "created_at",
        )

    @cached_property
    def moments(self) -> DataFrame:
        """Event of a user = sighting of a person in a video, hours as seconds."""
        e = self.events
        firsts = e.groupBy("user_id").agg(F.min("ts").alias("t0"))
        seconds = F.round((F.unix_micros("ts") - F.unix_micros("t0")) / 3_600_000_000.0, 3)
        return e.join(firsts, "user_id").select(
            F.col("user_id").alias("video_id"), F.col("event_type").alias("person_name"),
            seconds.alias("timestamp_seconds"), F.least(F.round(F.col("value") / 100, 4), F.lit(1.0)).alias("score"),
            F.col("event_id").alias("seq"),
        )
