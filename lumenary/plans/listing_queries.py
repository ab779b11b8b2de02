"""Listings, look-ups, enriched views, totals and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.operators import identity as I
from lumenary.operators import jobs as J
from lumenary.operators import listing as L
from lumenary.operators import views as VW
from lumenary.plans.catalog import Catalog, piped, stamp
from lumenary.plans.check_sql import piped as sql_piped
from lumenary.plans.check_sql import stamp as sql_stamp
from lumenary.plans.registry import query


def _recent(name: str, table: str, n: int, ts: str, get) -> None:
    sql = f"SELECT id, {sql_stamp(ts)} AS at FROM {table} t ORDER BY t.{ts} DESC, id DESC LIMIT {n}"

    @query(f"p1_recent_{name}", table, sql)
    def run(c: Catalog) -> DataFrame:
        return L.recent(get(c), n, ts).select("id", stamp(F.col(ts)).alias("at"))


_recent("photos", "photos", 50, "created_at", lambda c: c.photos)
_recent("videos", "videos", 50, "created_at", lambda c: c.videos)
_recent("jobs", "import_jobs", 50, "created_at", lambda c: c.import_jobs)
_recent("sources", "sources", 50, "created_at", lambda c: c.sources)
_recent("clusters", "clusters", 20, "updated_at", lambda c: c.clusters)
_recent("persons", "persons", 5, "updated_at", lambda c: c.persons)


@query(
    "p1_recent_tasks", "tasks",
    "SELECT task_type, strftime(created_at,'%Y-%m-%d') AS day FROM tasks t ORDER BY t.created_at DESC, task_type DESC LIMIT 80",
)
def recent_tasks(c: Catalog) -> DataFrame:
    return L.recent(c.tasks, 80, key="task_type").select("task_type", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("p2_enabled_sources", "sources", "SELECT id, name, kind, root_path FROM sources WHERE enabled")
def enabled(c: Catalog) -> DataFrame:
    return L.enabled_sources(c.sources).select("id", "name", "kind", "root_path")


@query(
    "p3_lookup", "clusters photos",
    "SELECT label, display_name FROM clusters WHERE label IN (SELECT unnest(face_clusters) FROM photos WHERE id%10=0)",
)
def lookup(c: Catalog) -> DataFrame:
    keys = c.photos.filter(F.col("id") % 10 == 0).select(F.explode("face_clusters").alias("label"))
    return L.lookup(c.clusters, keys, "label").select("label", "display_name")


@query(
    "p4_active_tasks", "tasks",
    "SELECT task_type, status, strftime(created_at,'%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY created_at DESC) AS r FROM tasks WHERE status IN ('queued','running')) WHERE r=1",
)
def active(c: Catalog) -> DataFrame:
    return L.active_tasks(c.tasks).select("task_type", "status", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query(
    "p5_enrich_photos", "rich_photos",
    f"SELECT id, {sql_piped('face_names')} AS face_names, {sql_piped('people')} AS people, id%2=0 AS vector_ready FROM rich_photos",
)
def enrich_photos(c: Catalog) -> DataFrame:
    vector = F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0)))
    rows = VW.enrich_photos(c.photos.withColumn("vector", vector), c.clusters, c.persons)
    return rows.select("id", piped(F.col("face_names")).alias("face_names"), piped(F.col("people")).alias("people"), "vector_ready")


@query(
    "p6_enrich_videos", "rich_videos",
    f"""SELECT id, {sql_piped('face_names')} AS face_names, {sql_piped('people')} AS people, CASE WHEN thumbnail_path IS NOT NULL THEN '/api/v1/videos/'||id||'/thumbnail' END AS thumbnail,
 CASE WHEN id%3=0 THEN '' WHEN id%3=1 THEN 'ann:1:f' ELSE 'ann:2:-' END AS moments FROM rich_videos""",
)
def enrich_videos(c: Catalog) -> DataFrame:
    def moment(name, label, *box):
        return F.struct(
            name.alias("person_name"), F.lit(1.0).alias("timestamp_seconds"), F.lit(0.5).alias("score"),
            F.array(*box).cast("array<double>").alias("bbox"), label.alias("cluster_label"),
        )

    kind = F.col("id") % 3
    moments = F.array(
        moment(F.lit(""), F.lit("x"), F.lit(1.0)),
        moment(
            F.when(kind > 0, "ann"), F.when(kind == 1, "f").otherwise(""),
            F.when(kind == 2, 0.5), F.lit(0.25),
        ),
    )
    rows = VW.enrich_videos(c.videos.withColumn("person_moments", moments), c.clusters, c.persons)
    said = F.transform(
        "person_moments",
        lambda m: F.concat_ws(":", m["person_name"], F.size(m["bbox"]), F.coalesce(m["cluster_label"], F.lit("-"))),
    )
    return rows.select(
        "id", piped(F.col("face_names")).alias("face_names"), piped(F.col("people")).alias("people"),
        F.col("thumbnail_asset_url").alias("thumbnail"), piped(said).alias("moments"),
    )


VIEW_SQL = {
    "stats": (
        "photos",
        "SELECT label, count(*) AS photo_count, max(seen) AS latest FROM (SELECT unnest(face_clusters) AS label, coalesce(taken_at,created_at) AS seen FROM photos) GROUP BY label",
    ),
    "cview": (
        "clusters stats photos",
        """SELECT c.id, c.label, c.display_name, c.updated_at, coalesce(s.photo_count,0) AS photo_count, coalesce(c.display_name,'')<>'' AS named, s.latest,
 CASE WHEN c.example_photo_id IN (SELECT id FROM photos) THEN '/api/v1/photos/'||c.example_photo_id||'/asset' END AS asset FROM clusters c LEFT JOIN stats s ON s.label=c.label""",
    ),
    "pstats": (
        "clusters photos",
        """SELECT c.person_profile_id AS person_id, count(DISTINCT c.label) AS linked_cluster_count, count(DISTINCT p.id) AS linked_photo_count
 FROM clusters c LEFT JOIN photos p ON list_contains(p.face_clusters, c.label) WHERE c.person_profile_id IS NOT NULL GROUP BY 1""",
    ),
    "pview": (
        "persons samples pstats",
        """SELECT p.id, p.name, p.sample_count, coalesce(s.linked_cluster_count,0) AS linked_cluster_count, coalesce(s.linked_photo_count,0) AS linked_photo_count, p.updated_at,
 CASE WHEN p.example_sample_id IS NOT NULL THEN '/api/v1/person-samples/'||p.example_sample_id||'/asset' END AS asset FROM persons p LEFT JOIN pstats s ON s.person_id=p.id""",
    ),
}


def cluster_view(c: Catalog) -> DataFrame:
    return VW.cluster_view(c.clusters, I.cluster_stats(c.photos), c.photos)


def person_view(c: Catalog) -> DataFrame:
    return VW.person_view(c.persons, c.samples, I.person_stats(c.photos, c.clusters))


@query("p7_cluster_view", "cview", f"SELECT label, photo_count, named, {sql_stamp('latest')} AS latest, asset FROM cview", VIEW_SQL)
def clusters(c: Catalog) -> DataFrame:
    return cluster_view(c).select(
        "label", "photo_count", "named", stamp(F.col("latest_photo_at")).alias("latest"), F.col("example_photo_asset_url").alias("asset")
    )


@query("p8_person_view", "pview", "SELECT id, name, sample_count, linked_cluster_count, linked_photo_count, asset FROM pview", VIEW_SQL)
def persons(c: Catalog) -> DataFrame:
    return person_view(c).select(
        "id", "name", "sample_count", "linked_cluster_count", "linked_photo_count", F.col("example_sample_asset_url").alias("asset")
    )


@query(
    "p9_filter_clusters", "cview",
    "SELECT label, photo_count FROM cview WHERE named AND (contains(lower(label),'group') OR contains(lower(coalesce(display_name,'')),'group'))", VIEW_SQL,
)
def filter_clusters(c: Catalog) -> DataFrame:
    return L.filter_clusters(cluster_view(c), "named", " Group ").select("label", "photo_count")


@query(
    "p11_rank_people", "pview",
    "SELECT id, linked_photo_count, row_number() OVER (ORDER BY linked_photo_count DESC, updated_at DESC, id DESC) AS place FROM pview", VIEW_SQL,
)
def rank_people(c: Catalog) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy(F.lit(0)).orderBy(F.desc("linked_photo_count"), F.desc("updated_at"), F.desc("id"))
    return L.rank_people(person_view(c)).withColumn("place", F.row_number().over(order)).select("id", "linked_photo_count", "place")


_LABEL_SQL = "list_concat(list_transform(people, lambda x: '{0}'||x), list_transform(scene_tags, lambda x: '{1}'||x), list_transform(object_tags, lambda x: '{2}'||x))"


@query(
    "p12_tag_labels_card", "rich_photos",
    f"SELECT id, {sql_piped('(' + _LABEL_SQL.format(*L.CARD_FAMILIES) + ')[1:3]')} AS labels FROM rich_photos",
)
def card_labels(c: Catalog) -> DataFrame:
    rows = VW.enrich_photos(c.photos, c.clusters, c.persons)
    return rows.select("id", piped(L.tag_labels(limit=3)).alias("labels"))


@query("p12_tag_labels_detail", "rich_videos", f"SELECT id, {sql_piped(_LABEL_SQL.format(*L.DETAIL_FAMILIES))} AS labels FROM rich_videos")
def detail_labels(c: Catalog) -> DataFrame:
    rows = VW.enrich_videos(c.videos, c.clusters, c.persons)
    return rows.select("id", piped(L.tag_labels(L.DETAIL_FAMILIES, None)).alias("labels"))


@query(
    "p13_sample_view", "samples",
    f"SELECT id, person_id, '/api/v1/person-samples/'||id||'/asset' AS asset_url, {sql_stamp('created_at')} AS at FROM samples WHERE person_id=3",
)
def samples(c: Catalog) -> DataFrame:
    rows = VW.sample_view(c.samples.filter("person_id = 3"))
    return rows.select("id", "person_id", "asset_url", stamp(F.col("created_at")).alias("at"))


@query("c16_cluster_stats", "stats", f"SELECT label, photo_count, {sql_stamp('latest')} AS latest FROM stats", VIEW_SQL)
def cluster_stats(c: Catalog) -> DataFrame:
    return I.cluster_stats(c.photos).select("label", "photo_count", stamp(F.col("latest_photo_at")).alias("latest"))


@query("c17_person_stats", "pstats", "SELECT * FROM pstats", VIEW_SQL)
def person_stats(c: Catalog) -> DataFrame:
    return I.person_stats(c.photos, c.clusters)


@query(
    "a5_job_totals", "import_jobs",
    """SELECT count(*) FILTER (status='completed') AS completed, count(*) FILTER (status='failed') AS failed, CAST(sum(imported_count) AS BIGINT) AS imported_total,
 CAST(sum(duplicate_count) AS BIGINT) AS duplicate_total FROM import_jobs""",
)
def job_totals(c: Catalog) -> DataFrame:
    return J.job_totals(c.import_jobs)


@query(
    "a6_task_totals", "tasks",
    """SELECT count(*) FILTER (status IN ('queued','running')) AS running, count(*) FILTER (status='completed') AS completed, count(*) FILTER (status='failed') AS failed,
 CAST(sum(completed_items+failed_items) AS BIGINT) AS processed_total FROM tasks""",
)
def task_totals(c: Catalog) -> DataFrame:
    return J.task_totals(c.tasks)


@query(
    "a7_task_outcome", "",
    """SELECT user_id AS task_id, count(*) FILTER (event_type<>'error') AS completed_items, count(*) FILTER (event_type='error') AS failed_items,
 arg_max('event '||event_id, event_id) FILTER (event_type='error') AS error_message,
 CASE WHEN count(*) FILTER (event_type='error')>0 AND count(*) FILTER (event_type<>'error')=0 THEN 'failed' ELSE 'completed' END AS status FROM events GROUP BY user_id""",
)
def task_outcome(c: Catalog) -> DataFrame:
    failed = F.col("event_type") == "error"
    results = c.table("events").select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"),
        F.when(failed, F.concat(F.lit("event "), "event_id")).alias("error"),
    )
    return J.task_outcome(results)
