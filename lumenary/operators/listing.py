"""Listings, look-ups and list filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("queued", "running")
# Label families of the card and of the detail view.
CARD_FAMILIES = ("人物 · ", "场景 · ", "物体 · ")
DETAIL_FAMILIES = ("人物 / ", "场景 / ", "物体 / ")
CARD_LABELS = 6


def recent(df: DataFrame, n: int, ts: str = "created_at", key: str = "id") -> DataFrame:
    """Newest n rows; the larger key wins a tie."""
    return df.orderBy(F.desc(ts), F.desc(key)).limit(n)


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled")


def lookup(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is listed; unknown keys drop silently."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def active_tasks(tasks: DataFrame) -> DataFrame:
    """Newest queued or running task of each type."""
    rows = tasks.filter(F.col("status").isin(*ACTIVE))
    newest = rows.groupBy("task_type").agg(
        F.max_by(F.struct(*tasks.columns), F.struct("created_at", "id")).alias("t")
    )
    return newest.select("t.*")


def _mentions(keyword: str, *columns: str) -> Column:
    word = keyword.strip().lower()
    hit = F.lit(not word)
    for c in columns:
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(word)
    return hit


def filter_clusters(view: DataFrame, mode: str = "all", keyword: str = "") -> DataFrame:
    if mode not in ("all", "named", "unnamed"):
        raise ValueError(f"unknown cluster filter: {mode}")
    rows = view if mode == "all" else view.filter(F.col("named") == (mode == "named"))
    return rows.filter(_mentions(keyword, "label", "display_name")).orderBy(
        F.desc("photo_count"), F.desc_nulls_last("latest_photo_at"), "label"
    )


def filter_candidates(
    candidates: DataFrame, selected_person: int, mode: str = "all", min_score: float = 0.0, keyword: str = ""
) -> DataFrame:
    linked = F.col("linked_to_selected_person")
    other = F.coalesce(F.col("current_person_id") != selected_person, F.lit(False))
    modes = {
        "all": F.lit(True), "recommended": F.col("recommended"), "linked": linked, "unlinked": ~linked,
        "reassign": other,
    }
    if mode not in modes:
        raise ValueError(f"unknown candidate filter: {mode}")
    return candidates.filter(
        (F.col("score") >= min_score) & modes[mode] & _mentions(keyword, "label", "display_name", "current_person_name")
    )


def rank_people(view: DataFrame) -> DataFrame:
    return view.orderBy(F.desc("linked_photo_count"), F.desc("updated_at"), F.desc("id"))


def tag_labels(families: tuple[str, str, str] = CARD_FAMILIES, limit: int | None = CARD_LABELS) -> Column:
    """People, scene and object tags with the name of their family in front."""

    def marked(family: str, tags: str) -> Column:
        return F.transform(tags, lambda x: F.concat(F.lit(family), x))

    labels = F.concat(*map(marked, families, ("people", "scene_tags", "object_tags")))
    return labels if limit is None else F.slice(labels, 1, limit)
