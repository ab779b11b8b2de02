"""Threshold tuning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.operators import identity as I
from lumenary.operators import tuning as TU
from lumenary.plans.catalog import DIM, THR, Catalog
from lumenary.plans.listing_queries import VIEW_SQL
from lumenary.plans.registry import query

MARGIN = 0.02
_VIEWS = {
    **VIEW_SQL,
    "merges": (
        "clusters",
        """SELECT label, neighbor_label, s AS score FROM (SELECT a.label, b.label AS neighbor_label, round(list_dot_product(a.centroid,b.centroid),6) AS s,
 row_number() OVER (PARTITION BY a.label ORDER BY round(list_dot_product(a.centroid,b.centroid),6) DESC, b.updated_at DESC, b.label DESC) AS r FROM clusters a JOIN clusters b ON a.label<>b.label) WHERE r=1""",
    ),
    "pbest": (
        "clusters clus_rank",
        """SELECT c.label, a.person_id AS best_person_id, coalesce(a.score,0) AS score, coalesce(b.score,0) AS second_score, round(coalesce(a.score,0)-coalesce(b.score,0),6) AS margin
 FROM clusters c LEFT JOIN clus_rank a ON a.label=c.label AND a.r=1 LEFT JOIN clus_rank b ON b.label=c.label AND b.r=2""",
    ),
}
_M = "count(*) FILTER (score>={0}) AS {1}candidate_count, count(*) FILTER (score>=round({0}-0.03::DOUBLE,6) AND score<{0}) AS {1}ambiguous_count"
_P = "count(*) FILTER (score>={0}) AS {1}candidate_count, count(*) FILTER (score>={0} AND margin<0.02) AS {1}ambiguous_count"


def merges(c: Catalog) -> DataFrame:
    return TU.merge_scores(TU.preview_clusters(c.clusters, DIM), DIM)


def people(c: Catalog) -> DataFrame:
    return TU.person_scores(TU.preview_clusters(c.clusters, DIM), c.persons, c.samples, DIM)


@query("a1_merge_scores", "merges", "SELECT label, neighbor_label, score FROM merges", _VIEWS)
def merge_scores(c: Catalog) -> DataFrame:
    return merges(c)


@query("a1_merge_scores_in_blocks", "merges", "SELECT label, neighbor_label, score FROM merges", _VIEWS)
def merge_scores_in_blocks(c: Catalog) -> DataFrame:
    return TU.merge_scores(TU.preview_clusters(c.clusters, DIM), DIM, broadcast_rows=0, block_rows=8)


@query("a1_merge_preview", "merges", f"SELECT {_M.format(0.2, '')}, round(avg(score),6) AS mean_score FROM merges", _VIEWS)
def merge_preview(c: Catalog) -> DataFrame:
    return TU.merge_preview(merges(c), 0.2)


@query(
    "a1_borderline_merges", "merges stats clusters",
    """SELECT m.label, m.neighbor_label, m.score, m.d AS distance, coalesce(s.photo_count,0) AS photo_count, coalesce(t.photo_count,0) AS neighbor_photo_count FROM (
 SELECT *, round(abs(score-0.2::DOUBLE),6) AS d FROM merges ORDER BY d, label LIMIT 12) m LEFT JOIN stats s ON s.label=m.label LEFT JOIN stats t ON t.label=m.neighbor_label WHERE score>0""",
    _VIEWS,
)
def near_merges(c: Catalog) -> DataFrame:
    rows = TU.borderline_merges(merges(c), c.clusters, I.cluster_stats(c.photos), 0.2)
    return rows.select(
        "label", "neighbor_label", "score", F.col("distance_to_threshold").alias("distance"), "photo_count", "neighbor_photo_count"
    )


@query("a2_person_scores", "pbest", "SELECT * FROM pbest", _VIEWS)
def person_scores(c: Catalog) -> DataFrame:
    return people(c)


@query("a2_person_preview", "pbest", f"SELECT {_P.format(0.3, '')}, round(avg(score),6) AS mean_score FROM pbest", _VIEWS)
def person_preview(c: Catalog) -> DataFrame:
    return TU.person_preview(people(c), THR, MARGIN)


@query(
    "a2_borderline_persons", "pbest clusters persons",
    """SELECT b.label, b.score, b.second_score, b.margin, b.d AS distance, p.id AS current_person_id, q.name AS best_person_name FROM (
 SELECT *, round(abs(score-0.5::DOUBLE),6) AS d FROM pbest ORDER BY d, score DESC, label LIMIT 12) b JOIN clusters c ON c.label=b.label LEFT JOIN persons p ON p.id=c.person_profile_id
 LEFT JOIN persons q ON q.id=b.best_person_id WHERE score>0""", _VIEWS,
)
def near_persons(c: Catalog) -> DataFrame:
    rows = TU.borderline_persons(people(c), c.clusters, I.cluster_stats(c.photos), c.persons, 0.5)
    return rows.select(
        "label", "score", "second_score", "margin", F.col("distance_to_threshold").alias("distance"), "current_person_id", "best_person_name"
    )


def _bands(source: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{lo:.2f}-{hi:.2f}' AS label, {lo}::DOUBLE AS min_score, {hi}::DOUBLE AS max_score, (SELECT count(*) FROM {source} WHERE score>={lo} AND score{'<=' if hi == 1.0 else '<'}{hi}) AS count"
        for lo, hi in zip(TU.EDGES, TU.EDGES[1:])
    )
    return rows


@query("a3_cluster_bands", "merges", _bands("merges"), _VIEWS)
def cluster_bands(c: Catalog) -> DataFrame:
    return TU.score_bands(merges(c))


@query("a3_person_bands", "pbest", _bands("pbest"), _VIEWS)
def person_bands(c: Catalog) -> DataFrame:
    return TU.score_bands(people(c))


@query(
    "a3_event_bands", "", _bands("(SELECT value/100 AS score FROM events)")
)
def event_bands(c: Catalog) -> DataFrame:
    return TU.score_bands(c.table("events").select((F.col("value") / 100).alias("score")))


@query(
    "a4_tuning_summary", "merges pbest clusters persons",
    f"""SELECT (SELECT count(*) FROM clusters) AS total_clusters, (SELECT count(person_profile_id) FROM clusters) AS linked_clusters, (SELECT count(*) FROM persons) AS total_people,
 (SELECT count(*) FROM documents) AS total_photos, m.candidate_count AS merge_candidate_count, m.ambiguous_count AS ambiguous_merge_count, m.mean_score AS nearest_neighbor_mean_score,
 p.candidate_count AS person_candidate_count, p.ambiguous_count AS ambiguous_person_match_count, p.mean_score AS best_person_mean_score
 FROM (SELECT {_M.format(0.2, '')}, round(avg(score),6) AS mean_score FROM merges) m, (SELECT {_P.format(0.3, '')}, round(avg(score),6) AS mean_score FROM pbest) p""", _VIEWS,
)
def summary(c: Catalog) -> DataFrame:
    return TU.tuning_summary(c.clusters, c.photos, c.persons, merges(c), people(c), 0.2, THR, MARGIN, DIM)


_SETTINGS = [
    {"face_cluster_similarity_threshold": 0.1, "person_recognition_similarity_threshold": 0.3},
    {"face_cluster_similarity_threshold": 0.2}, {"person_recognition_similarity_threshold": 0.45}, {},
]


def _sweep_sql() -> str:
    rows = []
    for i, s in enumerate(_SETTINGS):
        a = s.get("face_cluster_similarity_threshold", 0.5)
        b = s.get("person_recognition_similarity_threshold", 0.52)
        rows.append(
            f"SELECT {i} AS setting, {a}::DOUBLE AS face_cluster_similarity_threshold, {b}::DOUBLE AS person_recognition_similarity_threshold, m.*, p.* FROM (SELECT {_M.format(a, 'merge_')} FROM merges) m, (SELECT {_P.format(b, 'person_')} FROM pbest) p"
        )
    return " UNION ALL ".join(rows)


@query("a8_threshold_sweep", "merges pbest", _sweep_sql(), _VIEWS)
def sweep(c: Catalog) -> DataFrame:
    return TU.threshold_sweep(merges(c), people(c), _SETTINGS, margin=MARGIN)
