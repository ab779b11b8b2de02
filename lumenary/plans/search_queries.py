"""Search and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.operators import search as S
from lumenary.operators.search import SearchRequest
from lumenary.plans.catalog import DIM, THR, Catalog, piped, stamp
from lumenary.plans.check_sql import TOKENS, VIEWS, text_vectors
from lumenary.plans.check_sql import stamp as sql_stamp
from lumenary.plans.registry import query
from lumenary.session import cut_lineage

REQUESTS = [
    SearchRequest(text="erblest thou and"),
    SearchRequest(text="heonsh the the aux", mode="keyword"),
    SearchRequest(text="esheon erstlyat", mode="vector"),
    SearchRequest(scene_tags=["fr"]),
    SearchRequest(),
    SearchRequest(text="!!!"),
    SearchRequest(text="Person 3 the"),
    SearchRequest(text="que des", source_kinds=["qq_folder"]),
    SearchRequest(face_cluster_labels=["face-1-1"]),
    SearchRequest(text="the", object_tags=["quality"], scene_tags=["EN"], mode="keyword"),
    SearchRequest(people=["Person 2"], mode="vector"),
    SearchRequest(text="thumb", people=["person 4"], mode="keyword", limit=5),
]


def _list(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def _request_rows(requests) -> str:
    rows = [
        f"({i}, '{r.text}', {_list(r.people)}, {_list(r.scene_tags)}, {_list(r.object_tags)}, {_list(r.source_kinds)}, {_list(r.face_cluster_labels)}, '{r.mode}', {r.limit})"
        for i, r in enumerate(requests)
    ]
    return "SELECT * FROM (VALUES " + ",".join(rows) + ") t(q, txt, people, scenes, objects, kinds, faces, mode, lim)"


def _search_sql(media: str, vec: str, faces: bool, requests) -> tuple[str, str, dict]:
    face_text = "||' '||array_to_string(m.face_clusters,' ')" if faces else ""
    face_keep = "AND list_has_all(m.face_clusters, r.faces)" if faces else ""
    extra = {
        "req0": ("", _request_rows(requests)),
        "req": (
            "req0 persons",
            "SELECT r.* EXCLUDE (people), list_concat(r.people, list_filter(coalesce((SELECT list(p.name ORDER BY updated_at DESC, id DESC) FROM persons p WHERE contains(lower(trim(r.txt)), p.normalized_name)),[]), lambda x: NOT list_contains(r.people,x))) AS people FROM req0 r",
        ),
        "reqtext": ("req", "SELECT q, txt||chr(10)||array_to_string(people,' ')||chr(10)||array_to_string(scenes,' ')||chr(10)||array_to_string(objects,' ') AS t FROM req"),
        "reqvec": ("reqtext", text_vectors("reqtext", "q", "t")),
    }
    low = "list_transform({}, lambda x: lower(x))"
    body = f"""SELECT q AS query_no, id, round(score,6) AS score, rank, total FROM (
 SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score,6) DESC, created_at DESC, id DESC) AS rank, count(*) OVER (PARTITION BY q) AS total FROM (
 SELECT q, id, created_at, lim, CASE WHEN nt=0 AND NOT wants THEN 1.0::DOUBLE WHEN mode='keyword' THEN kw WHEN mode='vector' THEN CASE WHEN vs>0.01 THEN vs ELSE 0 END
 WHEN kw<=0 AND vs<=0.01 THEN 0 ELSE kw*0.55::DOUBLE+vs*0.45::DOUBLE END AS score FROM (
 SELECT r.q, r.mode, r.lim, m.id, m.created_at, len(r.terms) AS nt, r.wants,
 CASE WHEN len(r.terms)=0 THEN 1.0::DOUBLE ELSE len(list_filter(r.terms, lambda t: contains(m.txt, t)))::DOUBLE/len(r.terms) END AS kw,
 CASE WHEN r.wants THEN coalesce(list_cosine_similarity(v.v, rv.v),0) ELSE 0 END AS vs
 FROM (SELECT m.*, lower(coalesce(m.caption,'')||' '||coalesce(m.ocr_text,'')||' '||array_to_string(m.people,' ')||' '||array_to_string(m.scene_tags,' ')||' '||array_to_string(m.object_tags,' '){face_text}||' '||m.original_path) AS txt FROM {media} m) m
 JOIN (SELECT *, {TOKENS.format("trim(txt)")} AS terms, (trim(txt)<>'' OR len(people)>0 OR len(scenes)>0 OR len(objects)>0) AS wants FROM req) r
 ON list_has_all({low.format('m.people')}, {low.format('r.people')}) AND list_has_all({low.format('m.scene_tags')}, {low.format('r.scenes')})
 AND list_has_all({low.format('m.object_tags')}, {low.format('r.objects')}) AND (len(r.kinds)=0 OR list_contains(r.kinds, m.source_kind)) {face_keep}
 LEFT JOIN {vec} v ON v.id=m.id LEFT JOIN reqvec rv ON rv.q=r.q)) WHERE round(score,6)>0) WHERE rank<=lim"""
    return f"{media} {vec} reqvec req", body, extra


_views, _sql, _extra = _search_sql("rich_photos", "photo_vec", True, REQUESTS)


@query("q4_search_photos", _views, _sql, _extra)
def search_photos(c: Catalog) -> DataFrame:
    hits = S.search_photos(c.photos_with_text_vector, c.clusters, c.persons, REQUESTS)
    return hits.select("query_no", "id", "score", "rank", "total")


@query(
    "q4_photo_results", f"{_views} rich_photos",
    f"""SELECT h.query_no, h.rank, h.total, h.score, h.id, m.storage_path, m.source_name, array_to_string(m.people,'|') AS people
 FROM ({_sql}) h JOIN rich_photos m ON m.id=h.id""", _extra,
)
def photo_results(c: Catalog) -> DataFrame:
    hits = S.search_photos(c.photos_with_text_vector, c.clusters, c.persons, REQUESTS)
    rows = S.photo_results(hits, c.photos, c.clusters, c.persons)
    return rows.select("query_no", "rank", "total", "score", "id", "storage_path", "source_name", piped(F.col("people")).alias("people"))


_VIDEO_VEC = {"video_hash": ("videos", text_vectors("videos", "id", "coalesce(caption,'')||chr(10)||coalesce(ocr_text,'')"))}
_v_views, _v_sql, _v_extra = _search_sql("rich_videos", "video_hash", False, REQUESTS)


@query("q5_search_videos", _v_views, _v_sql, {**_v_extra, **_VIDEO_VEC})
def search_videos(c: Catalog) -> DataFrame:
    return video_hits(c).select("query_no", "id", "score", "rank", "total")


def video_hits(c: Catalog) -> DataFrame:
    from lumenary.functions.text import text_hash_vector
    from lumenary.functions.vector import zeros

    v = F.concat(text_hash_vector(F.col("caption"), F.col("ocr_text")), zeros(DIM))
    return S.search_videos(c.videos.withColumn("vector", v), c.clusters, c.persons, REQUESTS, DIM)


@query(
    "q5_video_results", f"{_v_views} rich_videos",
    f"""SELECT h.query_no, h.rank, h.total, h.score, h.id, m.storage_path, m.duration_seconds, array_to_string(m.people,'|') AS people
 FROM ({_v_sql}) h JOIN rich_videos m ON m.id=h.id""", {**_v_extra, **_VIDEO_VEC},
)
def video_results(c: Catalog) -> DataFrame:
    rows = S.video_results(video_hits(c), c.videos, c.clusters, c.persons)
    return rows.select("query_no", "rank", "total", "score", "id", "storage_path", "duration_seconds", piped(F.col("people")).alias("people"))


@query(
    "q1_facet_filter", "rich_photos",
    """SELECT id FROM rich_photos WHERE list_contains(list_transform(people, lambda x: lower(x)),'person 2') AND list_contains(scene_tags,'en')
 AND source_kind IN ('local_folder','qq_folder')""",
)
def facets(c: Catalog) -> DataFrame:
    from lumenary.operators.views import enrich_photos

    wanted = SearchRequest(people=["Person 2"], scene_tags=["EN"], source_kinds=["local_folder", "qq_folder"])
    return enrich_photos(c.photos, c.clusters, c.persons).filter(S.facet_filter(wanted)).select("id")


@query(
    "q2_keyword_score", "photos",
    """SELECT id, round(len(list_filter(['the','que','ouou','the'], lambda t: contains(x,t)))/4.0::DOUBLE,6) AS score FROM (
 SELECT id, lower(caption||' '||coalesce(ocr_text,'')||' '||array_to_string(people,' ')||' '||array_to_string(scene_tags,' ')||' '||array_to_string(object_tags,' ')||' '||array_to_string(face_clusters,' ')||' '||original_path) AS x FROM photos)""",
)
def keyword(c: Catalog) -> DataFrame:
    known = ["the", "que", "ouou"]
    score = S.keyword_score(S.term_flags(known), known, ["the", "que", "ouou", "the"])
    return c.photos.select("id", F.round(score, 6).alias("score"))


@query(
    "q3_merge_scores", "",
    """SELECT event_id, round(kw,6) AS keyword, CASE WHEN vs>0.01 THEN vs ELSE 0 END AS vector, round(CASE WHEN kw<=0 AND vs<=0.01 THEN 0 ELSE kw*0.55::DOUBLE+vs*0.45::DOUBLE END,6) AS hybrid
 FROM (SELECT event_id, (user_id%5)/4 AS kw, round(value/100-0.2::DOUBLE,6) AS vs FROM events)""",
)
def merged(c: Catalog) -> DataFrame:
    rows = c.table("events").select(
        "event_id", (F.col("user_id") % 5 / 4).alias("kw"), F.round(F.col("value") / 100 - 0.2, 6).alias("vs")
    )
    return rows.select(
        "event_id",
        *[F.round(S.merge_scores(m, F.col("kw"), F.col("vs"), True), 6).alias(m) for m in ("keyword", "vector", "hybrid")],
    )


_MEDIA_VEC = {
    f"{m}_e": (f"{m} vec n", f"SELECT m.id, m.created_at, v.e AS v FROM {m} m CROSS JOIN n JOIN vec v ON v.vec_id=m.id%n.n")
    for m in ("photos", "videos")
}


def _vector_sql(media: str) -> str:
    return f"""SELECT id, s AS score, row_number() OVER (ORDER BY s DESC, created_at DESC, id DESC) AS rank FROM (
 SELECT id, created_at, round(list_cosine_similarity(v, list_transform(range(1,65), lambda i: CASE WHEN i%3=0 THEN 1.0::DOUBLE ELSE -0.25::DOUBLE END)),6) AS s FROM {media}_e) WHERE s>0
 ORDER BY s DESC, created_at DESC, id DESC LIMIT 20"""


def _vector(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    probe = [1.0 if i % 3 == 0 else -0.25 for i in range(1, DIM + 1)]
    page = S.vector_search(df, probe, 20)
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.desc("created_at"), F.desc("id"))
    return page.withColumn("rank", F.row_number().over(order)).select("id", "score", "rank")


@query("q6_vector_search_photos", "photos_e", _vector_sql("photos"), _MEDIA_VEC)
def vector_photos(c: Catalog) -> DataFrame:
    return _vector(c.photos_with_vector)


@query("q6_vector_search_videos", "videos_e", _vector_sql("videos"), _MEDIA_VEC)
def vector_videos(c: Catalog) -> DataFrame:
    return _vector(c.videos_with_vector)


def _similar_sql(media: str) -> str:
    return f"""SELECT id, match_id, s AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, created_at DESC, match_id DESC) AS rank FROM (
 SELECT a.id, b.id AS match_id, b.created_at, round(list_cosine_similarity(a.v,b.v),6) AS s FROM {media}_e a JOIN {media}_e b ON a.id<>b.id)
 WHERE s>=0.000001) WHERE rank<=5"""


@query("q7_similar_photos", "photos_e", _similar_sql("photos"), _MEDIA_VEC)
def similar_photos(c: Catalog) -> DataFrame:
    return S.similar(c.photos_with_vector, c.photos, 5, DIM)


@query("q7_similar_videos", "videos_e", _similar_sql("videos"), _MEDIA_VEC)
def similar_videos(c: Catalog) -> DataFrame:
    return S.similar(c.videos_with_vector, c.videos, 5, DIM)


_FACE_LABEL = {
    "face_label": (
        "face_rank faces clusters",
        """SELECT face_id, label, max(score) AS score FROM (
 SELECT r.face_id, c.label, r.score FROM face_rank r JOIN clusters c ON c.person_profile_id=r.person_id WHERE r.r<=3 AND r.score>=0.30
 UNION ALL SELECT face_id, label, s FROM (SELECT f.face_id, c.label, round(list_cosine_similarity(f.embedding,c.centroid),6) AS s FROM faces f, clusters c) WHERE s>=0.30) GROUP BY ALL""",
    )
}


@query("q8_cluster_scores", "face_label", "SELECT face_id AS query_id, label, score FROM face_label", _FACE_LABEL)
def cluster_scores(c: Catalog) -> DataFrame:
    return S.cluster_scores(_face_queries(c), c.persons, c.samples, c.clusters, THR, DIM)


def _face_queries(c: Catalog) -> DataFrame:
    return c.faces.select(F.col("face_id").alias("query_id"), "embedding")


def _person_search_sql(media: str, k: int) -> str:
    return f"""SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, id DESC) AS rank FROM (
 SELECT f.face_id AS query_id, m.id, m.created_at, max(f.score) AS score FROM face_label f JOIN (SELECT id, created_at, unnest(face_clusters) AS label FROM {media}) m ON m.label=f.label GROUP BY ALL)) WHERE rank<={k}"""


@query("q9_search_by_person_photos", "face_label photos", _person_search_sql("photos", 10), _FACE_LABEL)
def person_photos(c: Catalog) -> DataFrame:
    return S.search_by_person(_face_queries(c), c.photos, c.persons, c.samples, c.clusters, 10, THR, DIM)


@query("q9_search_by_person_videos", "face_label videos", _person_search_sql("videos", 10), _FACE_LABEL)
def person_videos(c: Catalog) -> DataFrame:
    return S.search_by_person(_face_queries(c), c.videos, c.persons, c.samples, c.clusters, 10, THR, DIM)


@query(
    "q10_photos_of_cluster", "photos",
    f"SELECT id, {sql_stamp('created_at')} AS created_at FROM photos WHERE list_contains(face_clusters,'face-1-1') ORDER BY photos.created_at DESC, id DESC LIMIT 48",
)
def of_cluster(c: Catalog) -> DataFrame:
    return S.photos_of_cluster(c.photos, "face-1-1").select("id", stamp(F.col("created_at")).alias("created_at"))


_p_views, _p_sql, _p_extra = _search_sql(
    "owner_photos", "photo_vec", True, [SearchRequest(people=["Person 1"], limit=48)]
)
_p_extra["owner_photos"] = (
    "rich_photos clusters",
    "SELECT * FROM rich_photos WHERE list_has_all(face_clusters, (SELECT list(label) FROM clusters WHERE person_profile_id=2))",
)
# the person owns the two clusters of the first photo that carries two
_p_extra["clusters"] = (
    VIEWS["clusters"][0] + " photos",
    f"SELECT * REPLACE (CASE WHEN list_contains((SELECT face_clusters FROM photos WHERE len(list_distinct(face_clusters))=2 ORDER BY id LIMIT 1), label) THEN 2 WHEN person_profile_id<>2 THEN person_profile_id END AS person_profile_id) FROM ({VIEWS['clusters'][1]})",
)
_a_extra = {
    **{k: v for k, v in _p_extra.items() if k != "clusters"},
    "owner_photos": (
        "rich_photos clusters",
        "SELECT * FROM rich_photos WHERE list_has_any(face_clusters, (SELECT list(label) FROM clusters WHERE person_profile_id=2))",
    ),
}


@query("q11_photos_of_person", _p_views, _p_sql, _p_extra)
def of_person(c: Catalog) -> DataFrame:
    both = c.photos.filter("size(array_distinct(face_clusters)) = 2").orderBy("id").select("face_clusters").first()
    owner = F.when(F.col("label").isin(both[0] if both else []), 2).when(F.col("person_profile_id") != 2, F.col("person_profile_id"))
    clusters = c.clusters.withColumn("person_profile_id", owner.cast("long"))
    hits = S.photos_of_person(c.photos_with_text_vector, clusters, c.persons, 2)
    return hits.select("query_no", "id", "score", "rank", "total")


@query("q11_photos_of_person_any_label", _p_views, _p_sql, _a_extra)
def of_person_any(c: Catalog) -> DataFrame:
    hits = S.photos_of_person(c.photos_with_text_vector, c.clusters, c.persons, 2, any_label=True)
    return hits.select("query_no", "id", "score", "rank", "total")


@query(
    "q12_videos_of_clusters", "videos",
    "SELECT id FROM videos WHERE list_has_any(face_clusters, ['face-1-1','face-2-0','face-3-4']) ORDER BY created_at DESC, id DESC LIMIT 48",
)
def of_clusters(c: Catalog) -> DataFrame:
    labels = c.clusters.filter(F.col("label").isin("face-1-1", "face-2-0", "face-3-4"))
    return S.videos_of_clusters(c.videos, labels).select("id")


@query(
    "q12_videos_of_person", "videos clusters",
    "SELECT id FROM videos WHERE list_has_any(face_clusters, (SELECT list(label) FROM clusters WHERE person_profile_id=3)) ORDER BY created_at DESC, id DESC LIMIT 48",
)
def videos_of_person(c: Catalog) -> DataFrame:
    return S.videos_of_person(c.videos, c.clusters, 3).select("id")


def _example_sql(media: str) -> str:
    return f"""SELECT example_id, match_id, s AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY s DESC, created_at DESC, match_id DESC) AS rank FROM (
 SELECT a.vec_id AS example_id, b.id AS match_id, b.created_at, round(list_cosine_similarity(a.e,b.v),6) AS s FROM vec a, {media}_e b)
 WHERE s>=0.000001) WHERE rank<=3"""


def _examples(c: Catalog) -> DataFrame:
    return c.vectors.select(F.col("vec_id").alias("example_id"), F.col("embedding").alias("vector"))


@query("q13_search_by_example_photos", "photos_e vec", _example_sql("photos"), _MEDIA_VEC)
def example_photos(c: Catalog) -> DataFrame:
    return S.search_by_examples(_examples(c), c.photos_with_vector, 3, DIM)


@query("q13_search_by_example_videos", "videos_e vec", _example_sql("videos"), _MEDIA_VEC)
def example_videos(c: Catalog) -> DataFrame:
    return S.search_by_examples(_examples(c), c.videos_with_vector, 3, DIM)


# --- evaluation -----------------------------------------------------------------------------------


def _truth(media: str) -> tuple[str, str]:
    return (
        f"{media} clusters",
        f"SELECT DISTINCT c.person_profile_id AS person_id, m.id FROM {media} m, clusters c WHERE c.person_profile_id IS NOT NULL AND list_contains(m.face_clusters, c.label)",
    )


def _eval_views(media: str) -> dict:
    return {
        **_FACE_LABEL,
        "truth": _truth(media),
        "asked": ("samples truth", "SELECT id AS sample_id, person_id FROM samples WHERE person_id IN (SELECT person_id FROM truth)"),
        "hits": (
            f"face_label {media} asked",
            f"""SELECT sample_id, person_id, id, score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, created_at DESC, id DESC) AS rank, count(*) OVER (PARTITION BY sample_id) AS total FROM (
 SELECT a.sample_id, a.person_id, m.id, m.created_at, max(f.score) AS score FROM asked a JOIN face_label f ON f.face_id=a.sample_id
 JOIN (SELECT id, created_at, unnest(face_clusters) AS label FROM {media}) m ON m.label=f.label GROUP BY ALL)""",
        ),
        "best": (
            "hits truth asked",
            "SELECT a.sample_id, a.person_id, b.best_rank FROM asked a LEFT JOIN (SELECT sample_id, min(rank) AS best_rank FROM hits h JOIN truth t USING (person_id, id) WHERE rank<=200 GROUP BY 1) b ON b.sample_id=a.sample_id",
        ),
    }


_METRICS = """count(*) AS query_count, round(avg(coalesce(1.0::DOUBLE/best_rank,0)),6) AS mrr, round(avg(CASE WHEN best_rank<=1 THEN 1.0::DOUBLE ELSE 0 END),6) AS hit_1,
 round(avg(CASE WHEN best_rank<=5 THEN 1.0::DOUBLE ELSE 0 END),6) AS hit_5, round(avg(CASE WHEN best_rank<=10 THEN 1.0::DOUBLE ELSE 0 END),6) AS hit_10"""


def _register_evaluation(kind: str) -> None:
    media = f"{kind}s"
    views = _eval_views(media)

    def rows(c: Catalog) -> DataFrame:
        return c.photos if kind == "photo" else c.videos

    def inputs(c: Catalog, keys: DataFrame | None = None):
        return S.evaluation_inputs(rows(c), c.persons, c.samples, c.clusters, 200, THR, DIM, keys)

    @query(f"e1_ground_truth_{media}", "truth", "SELECT person_id, id FROM truth", views)
    def truth(c: Catalog) -> DataFrame:
        return S.ground_truth(rows(c), c.clusters)

    @query(f"e2_rank_samples_{media}", "hits", "SELECT sample_id, person_id, id, score, rank FROM hits WHERE rank<=200", views)
    def ranked(c: Catalog) -> DataFrame:
        return S.rank_samples(rows(c), c.persons, c.samples, c.clusters, 200, THR, DIM)

    @query(f"e3_retrieval_metrics_{media}", "best", f"SELECT {_METRICS} FROM best", views)
    def metrics(c: Catalog) -> DataFrame:
        return S.retrieval_metrics(inputs(c)[0])

    @query(
        f"e4_person_report_{media}", "best persons",
        f"SELECT person_id, 'Person '||(person_id-1) AS person_name, {_METRICS} FROM best GROUP BY person_id", views,
    )
    def report(c: Catalog) -> DataFrame:
        return S.retrieval_report(inputs(c)[0], c.persons)

    @query(
        f"e4_query_report_{media}", "best truth hits",
        """SELECT b.sample_id, b.person_id, b.best_rank, t.n AS relevant_count, coalesce(h.n,0) AS retrieved_count FROM best b
 JOIN (SELECT person_id, count(*) AS n FROM truth GROUP BY 1) t ON t.person_id=b.person_id
 LEFT JOIN (SELECT sample_id, max(total) AS n FROM hits GROUP BY 1) h ON h.sample_id=b.sample_id""", views,
    )
    def per_query(c: Catalog) -> DataFrame:
        asked = S.evaluable(c.samples, rows(c), c.clusters).withColumnRenamed("sample_id", "query_id")
        # the ranks and the counts read the same matches
        keys = cut_lineage(S.query_keys(asked, c.persons, c.samples, c.clusters, THR, DIM))
        best, truth_rows, _ = inputs(c, keys)
        retrieved = S.retrieved_counts(asked, rows(c), c.persons, c.samples, c.clusters, THR, DIM, keys)
        return S.query_report(best, truth_rows, retrieved)


for _kind in ("photo", "video"):
    _register_evaluation(_kind)
