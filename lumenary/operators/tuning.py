"""What a threshold would change: nearest-cluster and best-person previews, bands, sweeps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.functions import blockmatch as bm
from lumenary.functions.blockmatch import Side
from lumenary.operators import identity as I

# Band edges, the width of the doubtful zone, list length and default thresholds.
EDGES = (0.0, 0.35, 0.45, 0.5, 0.55, 0.6, 0.7, 1.0)
DOUBT = 0.03
BORDERLINE = 12
DEFAULTS = {
    "face_cluster_similarity_threshold": I.CLUSTER_THRESHOLD,
    "person_recognition_similarity_threshold": I.PERSON_THRESHOLD,
    "face_detection_confidence_threshold": 0.5,
    "face_detection_nms_threshold": 0.4,
}


def check_thresholds(values: Mapping[str, float]) -> dict[str, float]:
    """The known settings of `values`, each between 0 and 1."""
    known = {k: float(v) for k, v in values.items() if k in DEFAULTS}
    for name, value in known.items():
        if not 0 <= value <= 1:
            raise ValueError(f"{name} must be between 0 and 1")
    return known


def preview_clusters(clusters: DataFrame, dim: int = I.FACE_DIM, limit: int | None = None) -> DataFrame:
    """Clusters with a current vector; optionally only the latest."""
    rows = clusters.filter(I.has_dim("centroid", dim))
    return rows if limit is None else rows.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


def merge_scores(clusters: DataFrame, dim: int = I.FACE_DIM, **sizes) -> DataFrame:
    """(label, neighbor_label, score): the best other cluster by plain dot product."""
    side = Side(clusters, "label", "centroid", "updated_at")
    hits = bm.nearest(side, side, dim=dim, k=1, floor=float("-inf"), metric="dot", skip_self=True, **sizes)
    return hits.select("label", F.col("match_label").alias("neighbor_label"), "score")


def person_scores(
    clusters: DataFrame, persons: DataFrame, samples: DataFrame, dim: int = I.FACE_DIM
) -> DataFrame:
    """(label, best_person_id, score, second_score, margin); a cluster without match scores 0."""
    ranked = I.rank_persons(Side(clusters, "label", "centroid"), persons, samples, 2, dim)
    top = I.top_two(ranked, "label")
    score, second = F.coalesce("score", F.lit(0.0)), F.coalesce("second", F.lit(0.0))
    rows = clusters.select("label").join(top, "label", "left")
    return rows.filter(persons.agg(F.count(F.lit(1)).alias("n")).scalar() > 0).select(
        "label", F.col("person_id").alias("best_person_id"), score.alias("score"), second.alias("second_score"),
        F.round(score - second, 6).alias("margin"),
    )


def _merge_counts(thr: Column) -> list[Column]:
    s = F.col("score")
    return [
        F.count_if(s >= thr).alias("candidate_count"),
        F.count_if((s >= F.round(thr - DOUBT, 6)) & (s < thr)).alias("ambiguous_count"),
    ]


def _person_counts(thr: Column, margin: float) -> list[Column]:
    s = F.col("score")
    return [
        F.count_if(s >= thr).alias("candidate_count"),
        F.count_if((s >= thr) & (F.col("margin") < margin)).alias("ambiguous_count"),
    ]


def _mean() -> Column:
    return F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("mean_score")


def merge_preview(scores: DataFrame, thr: float) -> DataFrame:
    """(candidate_count, ambiguous_count, mean_score), all 0 for fewer than two clusters."""
    return scores.agg(*_merge_counts(F.lit(thr)), _mean())


def person_preview(scores: DataFrame, thr: float, margin: float = I.PERSON_MARGIN) -> DataFrame:
    return scores.agg(*_person_counts(F.lit(thr), margin), _mean())


def borderline(scores: DataFrame, thr: float, by_score: bool, n: int = BORDERLINE) -> DataFrame:
    """The n rows closest to the threshold, then only those with a positive score."""
    gap = F.round(F.abs(F.col("score") - thr), 6)
    tie = [F.desc("score")] if by_score else []
    rows = scores.withColumn("distance_to_threshold", gap).orderBy("distance_to_threshold", *tie, "label").limit(n)
    return rows.filter("score > 0")


def borderline_merges(scores: DataFrame, clusters: DataFrame, stats: DataFrame, thr: float) -> DataFrame:
    named = clusters.select("label", "display_name").join(stats.select("label", "photo_count"), "label", "left").select(
        "label", "display_name", F.coalesce("photo_count", F.lit(0)).alias("photo_count")
    )
    near = borderline(scores, thr, False).join(named, "label")
    return near.join(named.toDF("neighbor_label", "neighbor_display_name", "neighbor_photo_count"), "neighbor_label")


def borderline_persons(
    scores: DataFrame, clusters: DataFrame, stats: DataFrame, persons: DataFrame, thr: float
) -> DataFrame:
    named = clusters.select("label", "display_name", "person_profile_id").join(stats.select("label", "photo_count"), "label", "left")
    names = persons.select("id", "name")
    rows = borderline(scores, thr, True).join(named, "label")
    rows = rows.join(names.toDF("person_profile_id", "current_person_name"), "person_profile_id", "left")
    rows = rows.join(names.toDF("best_person_id", "best_person_name"), "best_person_id", "left")
    return rows.withColumn("photo_count", F.coalesce("photo_count", F.lit(0))).withColumn(
        "current_person_id", F.when(F.col("current_person_name").isNotNull(), F.col("person_profile_id"))
    ).drop("person_profile_id")


def score_bands(scores: DataFrame) -> DataFrame:
    """(label, min_score, max_score, count) of every band, empty ones included; the last is closed."""
    s = F.col("score")
    counts = []
    for low, high in zip(EDGES, EDGES[1:]):
        inside = (s >= low) & ((s <= high) if high == EDGES[-1] else (s < high))
        counts.append(
            F.struct(
                F.lit(f"{low:.2f}-{high:.2f}").alias("label"), F.lit(low).alias("min_score"),
                F.lit(high).alias("max_score"), F.count_if(inside).alias("count"),
            )
        )
    return scores.agg(F.array(*counts).alias("b")).select(F.inline("b"))


def tuning_summary(
    clusters: DataFrame, photos: DataFrame, persons: DataFrame, merges: DataFrame, people: DataFrame,
    cluster_thr: float = I.CLUSTER_THRESHOLD, person_thr: float = I.PERSON_THRESHOLD,
    margin: float = I.PERSON_MARGIN, dim: int = I.FACE_DIM,
) -> DataFrame:
    """One row of totals and both previews. Every input is a one-row aggregate."""
    valid = clusters.filter(I.has_dim("centroid", dim)).agg(
        F.count(F.lit(1)).alias("total_clusters"), F.count("person_profile_id").alias("linked_clusters")
    )
    parts = [
        persons.agg(F.count(F.lit(1)).alias("total_people")),
        photos.agg(F.count(F.lit(1)).alias("total_photos")),
        merge_preview(merges, cluster_thr).toDF(
            "merge_candidate_count", "ambiguous_merge_count", "nearest_neighbor_mean_score"
        ),
        person_preview(people, person_thr, margin).toDF(
            "person_candidate_count", "ambiguous_person_match_count", "best_person_mean_score"
        ),
    ]
    out = valid
    for part in parts:
        out = out.join(F.broadcast(part))
    return out


def threshold_sweep(
    merges: DataFrame, people: DataFrame, settings: list[Mapping[str, float]], current: Mapping[str, float] | None = None,
    margin: float = I.PERSON_MARGIN,
) -> DataFrame:
    """Counts for many settings from one pass over each score table.

    Unspecified thresholds fall back to the current ones.
    """
    base = {**DEFAULTS, **check_thresholds(current or {})}
    full = [{**base, **check_thresholds(s)} for s in settings]

    def counted(scores: DataFrame, field: str, counts, prefix: str) -> DataFrame:
        rows = [
            F.struct(
                F.lit(i).alias("setting"), F.lit(s[field]).alias(field),
                *[c.alias(prefix + n) for c, n in zip(counts(F.lit(s[field])), ("candidate_count", "ambiguous_count"))],
            )
            for i, s in enumerate(full)
        ]
        return scores.agg(F.array(*rows).alias("r")).select(F.inline("r"))

    left = counted(merges, "face_cluster_similarity_threshold", _merge_counts, "merge_")
    right = counted(people, "person_recognition_similarity_threshold", lambda t: _person_counts(t, margin), "person_")
    return left.join(right, "setting")
