"""File, ingest and codec queries."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lumenary.functions import codecs as CO
from lumenary.functions.text import file_name
from lumenary.operators import ingest as IN
from lumenary.plans.catalog import Catalog, flat_vector, piped, stamp
from lumenary.plans.check_sql import flat
from lumenary.plans.registry import query
from lumenary.session import work_path
from lumenary.sources import files as FS
from lumenary.sources.files import SOURCE_KINDS

EPOCH_SECONDS = 1_704_067_200  # 2024-01-01 UTC


def page_folder(c: Catalog) -> str:
    """The pages as files, one folder per source kind, changed at 2024-01-01 + page_id minutes.

    Every fifth page has the content of page 0 and every seventh is no media file.
    """
    root = work_path(c.spark, "pages")
    start, kinds = EPOCH_SECONDS, SOURCE_KINDS

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, html in zip(batch["page_id"], batch["html"]):
                suffix = ".txt" if page % 7 == 6 else ".MP4" if page % 4 == 1 else ".jpg"
                folder = os.path.join(root, kinds[page % 3], f"d{page % 10}")
                os.makedirs(folder, exist_ok=True)
                target = os.path.join(folder, f"page_{page}{suffix}")
                with open(target, "w", encoding="utf-8", newline="") as handle:
                    handle.write("same" if page % 5 == 0 else html)
                os.utime(target, (start + page * 60,) * 2)
            yield batch[["page_id"]]

    c.table("pages").mapInPandas(write, "page_id long").agg(F.count(F.lit(1))).collect()
    return root


FILES = {
    "pf": (
        "",
        """SELECT page_id, CASE WHEN page_id%5=0 THEN 'same' ELSE html END AS body, 'page_'||page_id||CASE WHEN page_id%7=6 THEN '.txt' WHEN page_id%4=1 THEN '.MP4' ELSE '.jpg' END AS name,
 CASE WHEN page_id%7=6 THEN 'unsupported' WHEN page_id%4=1 THEN 'video' ELSE 'image' END AS media_kind,
 CASE page_id%3 WHEN 0 THEN 'local_folder' WHEN 1 THEN 'wechat_folder' ELSE 'qq_folder' END AS source_kind FROM pages""",
    ),
}


@query(
    "s1_discover", "pf",
    """SELECT name, media_kind, octet_length(encode(body)) AS length, strftime(TIMESTAMP '2024-01-01'+to_minutes(page_id),'%Y-%m-%d %H:%M:%S') AS changed FROM pf
 WHERE media_kind<>'unsupported' ORDER BY page_id DESC LIMIT 50""", FILES,
)
def discover(c: Catalog) -> DataFrame:
    rows = FS.discover(c.spark, page_folder(c), 50)
    return rows.select(
        file_name(F.col("path")).alias("name"), "media_kind", "length", stamp(F.col("modificationTime")).alias("changed")
    )


@query(
    "s2_media_kind", "",
    """SELECT event_id, CASE (k)%4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'unsupported' ELSE 'image' END AS media_kind FROM (
 SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)""",
)
def kinds(c: Catalog) -> DataFrame:
    suffix = F.array(*map(F.lit, (".JPG", ".tar.mkv", ".txt", ".heic")))
    paths = c.events.select("event_id", F.concat(F.lit("/a.b/"), "k", F.element_at(suffix, (F.col("k") % 4 + 1).cast("int"))).alias("path"))
    return FS.with_media_kind(paths).select("event_id", "media_kind")


def scan(c: Catalog, contents: bool = False) -> DataFrame:
    root = page_folder(c)
    return FS.scan_sources(c.spark, [(i, k, f"{root}/{k}") for i, k in enumerate(SOURCE_KINDS)], contents)


@query("s3_scan_sources", "pf", "SELECT name, source_kind, page_id%3 AS source_id, media_kind FROM pf WHERE media_kind<>'unsupported'", FILES)
def sources(c: Catalog) -> DataFrame:
    return scan(c).select(file_name(F.col("path")).alias("name"), "source_kind", "source_id", "media_kind")


@query("s4_select_paths", "photos", "SELECT original_path FROM photos WHERE id%3=0")
def select_paths(c: Catalog) -> DataFrame:
    listing = c.photos.select(F.col("original_path").alias("path"))
    wanted = c.photos.filter("id % 3 = 0").select(F.col("original_path").alias("path"))
    wanted = wanted.unionByName(wanted.select(F.concat("path", F.lit(".gone")).alias("path")))
    return FS.select_paths(listing, wanted).select(F.col("path").alias("original_path"))


@query("s5_content_sha256", "pf", "SELECT name, sha256(body) AS sha256 FROM pf WHERE media_kind<>'unsupported'", FILES)
def digests(c: Catalog) -> DataFrame:
    return FS.with_sha256(scan(c, contents=True)).select(file_name(F.col("path")).alias("name"), "sha256")


def batch_files(c: Catalog) -> DataFrame:
    """Documents as files of a batch, newest last by id; of eight documents two are already known.

    Every seventh file is listed by a second source too, ten times its number and one.
    """
    rows = c.photos.select(
        F.col("original_path").alias("path"), "source_id", F.col("created_at").alias("modificationTime"), "sha256",
        F.when(F.col("id") % 13 == 12, "unsupported").otherwise("image").alias("media_kind"), (F.col("id") % 7 == 0).alias("twice"),
    )
    again = rows.filter("twice").withColumn("source_id", F.col("source_id") * 10 + 1)
    return rows.unionByName(again).drop("twice")


def known(c: Catalog) -> tuple[DataFrame, DataFrame]:
    return c.photos.filter("id % 8 = 0"), c.photos.filter("id % 8 = 2")


INGEST = {
    "outcomes": (
        "photos",
        """SELECT p.original_path, p.source_id, CASE WHEN p.id%13=12 THEN 'unsupported' WHEN k.sha256 IS NULL AND p.id=f.first AND p.source_id=f.least THEN 'imported' ELSE 'duplicate' END AS outcome
 FROM (SELECT id, original_path, sha256, source_id FROM photos UNION ALL SELECT id, original_path, sha256, source_id*10+1 FROM photos WHERE id%7=0) p
 LEFT JOIN (SELECT DISTINCT sha256 FROM photos WHERE id%8 IN (0,2)) k ON k.sha256=p.sha256
 LEFT JOIN (SELECT sha256, arg_max(id, created_at) AS first, arg_max(least(source_id, CASE WHEN id%7=0 THEN source_id*10+1 ELSE source_id END), created_at) AS least
 FROM photos WHERE id%13<>12 GROUP BY 1) f ON f.sha256=p.sha256""",
    ),
}


@query("s6_ingest_batch", "outcomes", "SELECT original_path, source_id, outcome FROM outcomes", INGEST)
def ingest(c: Catalog) -> DataFrame:
    return IN.ingest_batch(batch_files(c), *known(c)).select(F.col("path").alias("original_path"), "source_id", "outcome")


@query(
    "s7_import_job_summary", "outcomes",
    """SELECT source_id, count(*) AS scanned_count, count(*) FILTER (outcome='imported') AS imported_count, count(*) FILTER (outcome='duplicate') AS duplicate_count,
 CASE WHEN source_id=1 THEN 'failed' ELSE 'completed' END AS status FROM outcomes GROUP BY source_id""", INGEST,
)
def job_summary(c: Catalog) -> DataFrame:
    errors = c.sources.filter("id = 1").select(F.col("id").alias("source_id"), F.lit("disk full").alias("error_message"))
    return IN.import_job_summary(IN.ingest_batch(batch_files(c), *known(c)), errors).drop("error_message")


_ARCHIVE = {
    "given": (
        "photos",
        """SELECT '/in/'||id||'/'||name AS path, name, row_number() OVER (ORDER BY created_at DESC, '/in/'||id||'/'||name) AS i FROM (
 SELECT id, created_at, CASE WHEN id%3=0 THEN 'a.jpg' WHEN id%50=1 THEN 'a_1.jpg' ELSE regexp_replace(original_path,'^.*/','') END AS name FROM photos)""",
    ),
    "there": ("photos", "SELECT DISTINCT CASE WHEN id%40=0 THEN 'a_'||(id//40+1)||'.jpg' ELSE regexp_replace(original_path,'^.*/','') END AS file FROM photos WHERE id%20=0"),
    "tries": ("given there", "SELECT g.*, n.most FROM given g JOIN (SELECT name, count(*)+(SELECT count(*) FROM there)+(SELECT count(*) FROM given WHERE name='a_1.jpg') AS most FROM given GROUP BY name) n ON n.name=g.name"),
    # one by one: each file takes the first of its names that isn't taken yet
    "placed": (
        "tries there",
        r"""SELECT * FROM (WITH RECURSIVE w AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS file, (SELECT list(file) FROM there) AS taken
 UNION ALL SELECT t.i, t.path, f.file, list_append(w.taken, f.file) FROM w JOIN tries t ON t.i=w.i+1, LATERAL (SELECT list_filter(list_transform(range(0, t.most+1),
 lambda k: CASE WHEN k=0 THEN t.name ELSE regexp_replace(t.name, '(\.[^.]+)$', '_'||k||'\1') END), lambda x: NOT list_contains(w.taken, x))[1] AS file) f) SELECT path, file FROM w WHERE i>0)""",
    ),
}


@query("s8_assign_archive_paths", "placed", "SELECT path, '/archive/20240101/'||file AS archive_path FROM placed", _ARCHIVE)
def archive(c: Catalog) -> DataFrame:
    files = c.photos.select(
        F.concat(F.lit("/in/"), "id", F.lit("/"), F.when(F.col("id") % 3 == 0, "a.jpg").when(F.col("id") % 50 == 1, "a_1.jpg").otherwise(file_name(F.col("original_path")))).alias("path"),
        F.col("created_at").alias("modificationTime"),
    )
    existing = c.photos.filter("id % 20 = 0").select(
        F.concat(F.lit("/archive/20240101/"), F.when(F.col("id") % 40 == 0, F.concat(F.lit("a_"), F.floor(F.col("id") / 40) + 1, F.lit(".jpg"))).otherwise(file_name(F.col("original_path")))).alias("archive_path")
    )
    return IN.assign_archive_paths(files, existing, "/archive/20240101").select("path", "archive_path")


@query(
    "s9_build_photo_rows", "photos",
    """SELECT id%1000000 AS n, original_path, original_path AS external_id, '/archive/x.jpg' AS storage_path, 'person 1' AS people, strftime(created_at,'%Y-%m-%d %H:%M:%S') AS taken_at, 0 AS face_count FROM photos""",
)
def photo_rows(c: Catalog) -> DataFrame:
    files = c.photos.select(
        F.col("original_path").alias("path"), "source_id", "source_kind", "source_name", "sha256",
        F.lit("/archive/x.jpg").alias("archive_path"), F.col("created_at").alias("modificationTime"),
        F.array(F.lit("person 1")).alias("people"), F.array(F.lit("person 1")).alias("face_names"), "caption",
    )
    number = (F.unix_seconds("taken_at") - EPOCH_SECONDS) / 60
    return IN.build_photo_rows(files).select(
        number.cast("long").alias("n"), "original_path", "external_id", "storage_path", piped(F.col("people")).alias("people"),
        stamp(F.col("taken_at")).alias("taken_at"), "face_count",
    )


@query(
    "s9_build_video_rows", "videos",
    "SELECT original_path, duration_seconds, 0 AS sampled_frame_count, 0 AS moments, frame_width FROM videos",
)
def video_rows(c: Catalog) -> DataFrame:
    files = c.videos.select(
        F.col("original_path").alias("path"), "source_id", "source_kind", "source_name", "sha256", "duration_seconds", "frame_width",
        F.col("storage_path").alias("archive_path"), F.col("created_at").alias("modificationTime"),
    )
    return IN.build_video_rows(files).select(
        "original_path", "duration_seconds", "sampled_frame_count", F.size("person_moments").alias("moments"), "frame_width"
    )


@query(
    "s10_upsert", "photos",
    "SELECT id, CASE WHEN id%5=0 THEN 'new '||id ELSE caption END AS caption FROM photos UNION ALL SELECT id+1000000, 'new '||id FROM photos WHERE id%50=0",
)
def upsert(c: Catalog) -> DataFrame:
    base = c.photos.select("id", "caption")
    fresh = F.concat(F.lit("new "), "id")
    updates = base.filter("id % 5 = 0").select("id", fresh.alias("caption")).unionByName(
        base.filter("id % 50 = 0").select((F.col("id") + 1_000_000).alias("id"), fresh.alias("caption"))
    )
    # every key comes twice: an older caption, then the one that counts
    twice = updates.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("caption", F.when(F.col("seq") == 2, F.col("caption")).otherwise("old"))
    return IN.upsert(base, twice, "id", order="seq")


@query(
    "s11_decode_list", "",
    """SELECT event_id, CASE k%6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN event_type||'|'||k||'|True|None|true' WHEN 4 THEN '' ELSE 'a' END AS items FROM (
 SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)""",
)
def decode_list(c: Catalog) -> DataFrame:
    k = F.col("k") % 6
    full = F.concat(F.lit('["'), "event_type", F.lit('",'), "k", F.lit(',true,null,"true"]'))
    text = (
        F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "").when(k == 2, F.col("props")).when(k == 3, full)
        .when(k == 4, F.concat(F.lit("["), "k", F.lit(","))).otherwise('["a"]')
    )
    return c.events.select("event_id", piped(CO.decode_list(text)).alias("items"))


@query(
    "s12_decode_records", "",
    "SELECT event_id, CASE WHEN k%3=0 THEN '' ELSE event_type||':'||printf('%.2f',value) END AS records FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)",
)
def decode_records(c: Catalog) -> DataFrame:
    record = F.to_json(F.struct(F.col("event_type").alias("person_name"), F.col("value").alias("score")))
    text = F.when(F.col("k") % 3 == 0, record).otherwise(F.concat(F.lit("[1,"), record, F.lit(',"x",null]')))
    rows = CO.decode_records(text, "struct<person_name:string,score:double>")
    said = F.transform(rows, lambda r: F.concat(r["person_name"], F.lit(":"), F.format_string("%.2f", r["score"])))
    return c.events.select("event_id", piped(said).alias("records"))


@query("s13_vector_codec", "vec", f"SELECT vec_id, {flat('e', 6)} AS vector, 0 AS bad FROM vec")
def codec(c: Catalog) -> DataFrame:
    text = CO.encode_vector(F.col("embedding"))
    return c.vectors.select(
        "vec_id", flat_vector(CO.decode_vector(text), 6).alias("vector"),
        F.size(CO.decode_vector(F.substring(text, 1, 20))).alias("bad"),
    )


@query(
    "s14_evolve", "photos",
    "SELECT id, 0 AS face_count, CAST(NULL AS VARCHAR) AS note, caption FROM photos",
)
def evolve(c: Catalog) -> DataFrame:
    target = StructType([StructField("id", LongType()), StructField("face_count", IntegerType()), StructField("note", StringType())])
    return IN.evolve(c.photos.select("id", "caption"), target).select("id", "face_count", "note", "caption")
