"""Vectors of photos, videos and queries, from text, image and frame features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenary.functions import blockmatch as bm
from lumenary.functions import text as X
from lumenary.functions.blockmatch import Side
from lumenary.functions.vector import IMAGE_DIM, as_doubles, l2_normalize, mean_vector, unit_beside, units_beside, zeros

# Weights of the two deep vectors, and the prompts with their tags.
FRAME_WEIGHT, CAPTION_WEIGHT = 0.65, 0.35
DEEP_DIM = 768
TAGS_PER_VIDEO = 5
SCENE_PROMPTS = {
    "beach": "海边", "travel": "旅行", "office": "办公室", "home": "家里", "classroom": "教室", "night view": "夜景",
    "sunset": "日落", "indoor": "室内", "street": "街道", "food": "食物", "sport": "运动", "concert": "演出",
    "family gathering": "家庭聚会", "group photo": "合影",
}
OBJECT_PROMPTS = {
    "cat": "猫", "dog": "狗", "car": "汽车", "phone": "手机", "book": "书", "laptop": "电脑", "document": "文档",
    "lego bricks": "乐高", "child": "孩子", "whiteboard": "白板", "food": "食物",
}


def media_text(*, people: str = "people") -> list[Column]:
    """The text pieces of a medium that enter its vector."""
    return [F.concat_ws(" ", c) for c in ("caption", "ocr_text", people, "scene_tags", "object_tags")]


def media_text_counts(path: str = "storage_path", people: str = "people") -> Column:
    return X.text_hash_counts(*media_text(people=people), X.file_stem(F.col(path)))


def media_text_vector(path: str = "storage_path", people: str = "people") -> Column:
    return X.text_added_vector(*media_text(people=people), X.file_stem(F.col(path)))


def photo_vectors(photos: DataFrame, image_features: DataFrame | None = None, people: str = "people") -> DataFrame:
    """(id, vector): hashed text and image features as one unit vector. image_features: id, features.

    Text is reduced to its vector where it is read, so the join moves these only.
    """
    rows = photos.select("id", media_text_vector(people=people).alias("_text"))
    if image_features is None:
        image = zeros(IMAGE_DIM)
    else:
        rows = rows.join(image_features.select("id", "features"), "id", "left")
        image = F.coalesce(as_doubles(F.col("features")), zeros(IMAGE_DIM))
    return rows.select("id", units_beside(F.col("_text"), image).alias("vector"))


def refreshed_vector(people: str, path: str = "storage_path", stored: str = "vector", text_dim: int = X.TEXT_DIM) -> Column:
    """A photo vector with new text; its image half is read back from the stored vector."""
    image = F.when(F.size(stored) > text_dim, F.slice(stored, text_dim + 1, IMAGE_DIM)).otherwise(zeros(IMAGE_DIM))
    return unit_beside(media_text_counts(path, people), l2_normalize(image), rest_is_unit=True)


def query_vectors(queries: DataFrame) -> DataFrame:
    """Adds the photo query vector of (text, people, scene_tags, object_tags); no image half."""
    hashed = X.text_hash_vector(*[F.concat_ws(" ", c) for c in ("text", "people", "scene_tags", "object_tags")])
    return queries.withColumn("vector", F.concat(hashed, zeros(IMAGE_DIM)))


def pool_frames(frames: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, pooled): unit mean of a video's frame vectors."""
    return frames.groupBy(key).agg(mean_vector(F.col("embedding")).alias("m")).select(
        key, l2_normalize(F.col("m")).alias("pooled")
    )


def _joined(rows: DataFrame, other: DataFrame, column: str, dim: int) -> DataFrame:
    """Left join on id; a missing vector is zero."""
    joined = rows.join(other.select("id", as_doubles(F.col(column)).alias("_v")), "id", "left")
    return joined.withColumn(column, F.coalesce("_v", zeros(dim))).drop("_v")


def video_vectors(videos: DataFrame, pooled: DataFrame, text_vectors: DataFrame, dim: int = DEEP_DIM) -> DataFrame:
    """(id, vector): hashed text next to the mix of pooled frames and encoded text.

    pooled: id, pooled; text_vectors: id, encoded.
    """
    rows = videos.select("id", media_text_vector().alias("_text"))
    rows = _joined(_joined(rows, pooled, "pooled", dim), text_vectors, "encoded", dim)
    mixed = F.zip_with("pooled", "encoded", lambda f, t: FRAME_WEIGHT * f + CAPTION_WEIGHT * t)
    return rows.select("id", units_beside(F.col("_text"), l2_normalize(mixed), rest_is_unit=True).alias("vector"))


def video_query_vectors(queries: DataFrame, encoded: DataFrame, dim: int = DEEP_DIM) -> DataFrame:
    """Text queries: hashed text next to the encoded text. encoded: id, encoded."""
    rows = _joined(queries, encoded, "encoded", dim)
    hashed = X.text_hash_counts(*[F.concat_ws(" ", c) for c in ("text", "people", "scene_tags", "object_tags")])
    return rows.withColumn("vector", unit_beside(hashed, F.col("encoded"))).drop("encoded")


def video_example_vectors(pooled: DataFrame) -> DataFrame:
    """Example clips: no text, only pooled frames."""
    return pooled.withColumn("vector", l2_normalize(F.concat(zeros(X.TEXT_DIM), "pooled"))).drop("pooled")


def zero_shot_tags(
    frames: DataFrame, prompts: DataFrame, k: int = TAGS_PER_VIDEO, key: str = "video_id", dim: int = DEEP_DIM
) -> DataFrame:
    """(key, tags): labels of the k prompts closest to a video on average, positive scores only.

    The mean of dot products is the dot product with the mean frame, so frames are averaged first
    and only one row per video meets the prompts. prompts: no, tag, embedding.
    """
    means = frames.groupBy(key).agg(mean_vector(F.col("embedding")).alias("m"))
    hits = bm.nearest(
        Side(means, key, "m"), Side(prompts, "no", "embedding", "no"), dim=dim, k=k, floor=1e-6, metric="dot"
    )
    named = hits.join(prompts.select(F.col("no").alias("match_no"), "tag"), "match_no")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda e: e["tag"])
    return named.groupBy(key).agg(F.array_distinct(ordered).alias("tags"))


def top_faces(detections: DataFrame, n: int = 12, key: str = "media_id") -> DataFrame:
    """The n largest and most central faces of each image."""
    dx = (F.col("x1") + F.col("x2")) / 2 - F.col("image_width") / 2
    dy = (F.col("y1") + F.col("y2")) / 2 - F.col("image_height") / 2
    metric = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) - 2 * (dx * dx + dy * dy)
    order = W.partitionBy(key).orderBy(F.desc("metric"), F.desc("face_id"))
    rows = detections.withColumn("metric", metric).withColumn("place", F.row_number().over(order))
    return rows.filter(F.col("place") <= n).drop("metric")


def filter_detections(detections: DataFrame, thr: float) -> DataFrame:
    return detections.filter(F.col("det_score") >= thr)
