"""Items to clean up: thumbnails, small and junk media, exact and near copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenary.functions import gates as G
from lumenary.functions import text as X
from lumenary.functions.similarity import text_similarity
from lumenary.functions.vector import cosine, duration_similarity, no_vector, phash_similarity
from lumenary.session import cut_lineage, materialize, spread_groups

# Path hints in reporting order, chat sources, category names, pair caps.
THUMB_HINTS = ("thumb", "thumbnail", "thumbnails", "thumbs", "preview", "cover", "small")
JUNK_HINTS = (
    "thumb", "thumbnail", "cache", "temp", "tmp", "avatar", "emoji", "emotion", "sticker", "appbrand", "miniapp",
)
CHAT_KINDS = ("wechat_folder", "qq_folder")
CATEGORIES = (
    "thumbnail_images", "low_resolution_images", "junk_transfer_images", "duplicate_images",
    "low_resolution_videos", "duplicate_videos",
)
EXACT_SCORE, TOP_SCORE, NEAR_SCORE = 0.99, 0.99, 0.985
SEPARATOR = "；"

# Text gates of a near copy.
NAME_ALIKE, CAPTION_ALIKE = 0.94, 0.88


def _hint(hints: Sequence[str]) -> Column:
    """First listed hint found in the paths."""
    paths = F.lower(F.concat_ws(" ", F.coalesce("original_path", F.lit("")), F.coalesce("storage_path", F.lit(""))))
    return F.coalesce(*[F.when(F.contains(paths, F.lit(h)), F.lit(h)) for h in hints])


def _size() -> Column:
    return F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))


def _rated(df: DataFrame, rules: Sequence[tuple[Column, float, Column]], base: float = 0.0) -> DataFrame:
    """Sum of the weights of the rules that hold, and their reasons in order."""
    score = F.lit(base)
    for holds, weight, _ in rules:
        score = score + F.when(holds, weight).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(holds, reason) for holds, _, reason in rules]))
    return df.withColumns({"score": score, "reason": F.array_join(reasons, SEPARATOR)})


def _newest(df: DataFrame, limit: int | None) -> DataFrame:
    """The newest hits, not the highest scores."""
    return df if limit is None else df.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def _measured(photos: DataFrame) -> DataFrame:
    return photos.filter((F.col("width") > 0) & (F.col("height") > 0)).withColumn(
        "pixels", F.col("width").cast("long") * F.col("height")
    )


def thumbnail_candidates(photos: DataFrame, limit: int | None = None) -> DataFrame:
    hint = _hint(THUMB_HINTS)
    rules = [
        (hint.isNotNull(), 0.62, F.concat(F.lit("路径或文件名包含 "), hint, F.lit(" 缩略图特征"))),
        ((F.col("width") <= 480) | (F.col("height") <= 480), 0.2, F.concat(F.lit("分辨率仅 "), _size())),
        (F.col("pixels") <= 200_000, 0.16, F.lit("总像素明显偏小")),
        (F.col("source_kind").isin(*CHAT_KINDS), 0.04, F.lit("来自聊天同步目录")),
    ]
    rows = _rated(_measured(photos), rules).filter(F.col("score") >= 0.66)
    return _newest(rows.withColumn("score", F.least("score", F.lit(TOP_SCORE))), limit)


def _small(df: DataFrame, tiny: Column, small: Column, small_score: float, words: tuple[str, str]) -> DataFrame:
    rows = df.withColumns(
        {
            "score": F.when(tiny, 0.96).when(small, small_score),
            "reason": F.when(tiny, F.concat(F.lit(words[0]), _size())).when(small, F.concat(F.lit(words[1]), _size())),
        }
    )
    return rows.filter("score is not null")


def low_res_images(photos: DataFrame, limit: int | None = None) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    tiny = (w <= 640) | (h <= 640) | (F.col("pixels") <= 300_000)
    words = ("分辨率过低，仅 ", "分辨率偏低，为 ")
    return _newest(_small(_measured(photos), tiny, (w < 1280) | (h < 720), 0.76, words), limit)


def low_res_videos(videos: DataFrame, limit: int | None = None) -> DataFrame:
    rows = _sized_videos(videos)
    w, h = F.col("width"), F.col("height")
    words = ("视频分辨率过低，仅 ", "视频分辨率偏低，为 ")
    return _newest(_small(rows, (w <= 640) | (h <= 360), (w < 960) | (h < 540), 0.8, words), limit)


def _sized_videos(videos: DataFrame) -> DataFrame:
    return _measured(videos.withColumnsRenamed({"frame_width": "width", "frame_height": "height"}))


def junk_images(photos: DataFrame, limit: int | None = None) -> DataFrame:
    hint = _hint(JUNK_HINTS)
    untagged = (F.size("people") + F.size("scene_tags") + F.size("object_tags")) == 0
    rules = [
        (F.lit(True), 0.0, F.lit("来自微信 / QQ 同步目录")),
        (hint.isNotNull(), 0.34, F.concat(F.lit("路径或文件名包含 "), hint, F.lit(" 缓存 / 缩略图特征"))),
        ((F.col("width") <= 720) | (F.col("height") <= 720), 0.16, F.concat(F.lit("分辨率较小，仅 "), _size())),
        (F.col("pixels") <= 250_000, 0.12, F.lit("总像素较小")),
        (F.col("face_count") == 0, 0.08, F.lit("未检测到人物")),
        (~_has_text(photos), 0.05, F.lit("没有可保留的 OCR 文本")),
        (untagged, 0.1, F.lit("AI 内容信号较弱")),
    ]
    rows = _rated(_measured(photos.filter(F.col("source_kind").isin(*CHAT_KINDS))), rules, 0.2)
    rows = rows.filter(F.col("score") >= 0.7)
    return _newest(rows.withColumn("score", F.least("score", F.lit(TOP_SCORE))), limit)


def _has_text(media: DataFrame) -> Column:
    if "has_text" in media.columns:
        return F.col("has_text")
    return F.coalesce(F.length(X.strip(F.col("ocr_text"))) > 0, F.lit(False))


def _caption_key(media: DataFrame) -> Column:
    return F.col("caption_key") if "caption_key" in media.columns else X.caption_key(F.col("caption"))


def with_text_keys(media: DataFrame) -> DataFrame:
    """caption_key and has_text in place of the texts: all that cleaning up reads of them.

    For a table whose rows are joined with others before they are cleaned up, so that no whole text is shuffled.
    """
    return media.withColumns({"caption_key": _caption_key(media), "has_text": _has_text(media)}).drop("caption", "ocr_text")


# --- copies -----------------------------------------------------------------------------------------


def tenths(seconds: Column) -> Column:
    """Seconds rounded to tenths, half to even on the exact binary value, as a whole number."""
    unit = 1 << 58
    whole = F.floor(seconds)
    scaled = ((seconds - whole) * float(unit)).cast("long") * 10
    low = F.shiftright(scaled, 58)
    rest = scaled - F.shiftleft(low, 58)
    up = (rest > unit // 2) | ((rest == unit // 2) & (low % 2 == 1))
    return whole * 10 + low + F.when(up, 1).otherwise(0)


def prepare(media: DataFrame, kind: str) -> DataFrame:
    """Keys, features and the quality columns q1..q4 (then id), larger is better."""
    if kind not in ("photo", "video"):
        raise ValueError(f"unknown media kind: {kind}")
    rows = _measured(media) if kind == "photo" else _sized_videos(media)
    path = F.when(F.coalesce("original_path", F.lit("")) != "", F.col("original_path")).otherwise(F.col("storage_path"))
    at = F.coalesce("taken_at", "created_at").cast("double")
    if kind == "photo":
        quality = [F.col("face_count"), F.when(_has_text(media), 1).otherwise(0)]
    else:
        quality = [F.col("duration_seconds"), F.col("sampled_frame_count")]
    vector = F.col("vector").cast("array<double>") if "vector" in media.columns else no_vector()
    return rows.select(
        "id", "sha256", "width", "height", "created_at",
        X.media_name_key(path).alias("name_key"),
        _caption_key(media).alias("caption_key"),
        F.coalesce(vector, no_vector()).alias("vector"),
        (F.col("phash") if kind == "photo" else F.lit(None).cast("string")).alias("phash"),
        (F.coalesce("duration_seconds", F.lit(0.0)) if kind == "video" else F.lit(0.0)).cast("double").alias("duration"),
        F.col("pixels").cast("double").alias("q1"),
        quality[0].cast("double").alias("q2"),
        quality[1].cast("double").alias("q3"),
        F.coalesce(at, F.lit(0.0)).alias("q4"),
    )


def quality_order() -> Column:
    """One comparable value per prepared row."""
    return F.struct("q1", "q2", "q3", "q4", "id")


def exact_duplicates(prepared: DataFrame) -> DataFrame:
    """(id, keeper, score, reason): every copy of a digest but the best one.

    The best copy is a combinable maximum, so a digest with very many copies is reduced before the
    shuffle; only digests with copies are joined back.
    """
    best = prepared.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct(quality_order().alias("q"), "width", "height")).alias("best")
    ).filter("n > 1")
    size = F.concat(F.col("best.width").cast("string"), F.lit("x"), F.col("best.height").cast("string"))
    reason = F.concat(F.lit("与保留项二进制完全一致（SHA256 相同）；建议保留更优版本 "), size)
    return prepared.join(best, "sha256").filter(F.col("id") != F.col("best.q.id")).select(
        "id", F.col("best.q.id").alias("keeper"), F.lit(EXACT_SCORE).alias("score"), reason.alias("reason")
    )


_FEATURES = ["vector", "phash", "duration", "name_key", "caption_key"]


def duplicate_blocks(prepared: DataFrame, kind: str, caption_block: int | None = None) -> DataFrame:
    """(kind, block, profile, id, …): items sharing a name key or a caption key, in blocks of two or more.

    Items of a block with equal features have one profile. Blocks are whole; with `caption_block` a caption block is its best items, a per-group top-k that
    Spark cuts down before the shuffle.
    """
    caption = F.col("caption_key")
    if kind == "video":
        caption = F.concat(caption, F.lit(":"), F.when(F.col("duration") > 0, tenths(F.col("duration"))).otherwise(0).cast("string"))
    keys = F.array(
        F.struct(F.lit("name").alias("kind"), F.when(F.col("name_key") != "", F.col("name_key")).alias("block")),
        F.struct(F.lit("caption").alias("kind"), F.when(F.col("caption_key") != "", caption).alias("block")),
    )
    rows = prepared.withColumn("k", F.explode(keys)).select("k.*", *prepared.columns).filter("block is not null")
    # told before the join, which then moves the features for those only who read them
    rows = rows.withColumn("profile", F.concat_ws(
        ":", F.xxhash64(*_FEATURES).cast("string"), F.hash(*_FEATURES).cast("string"), F.xxhash64("kind", "block").cast("string")
    ))
    sizes = rows.groupBy("kind", "block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(sizes, ["kind", "block"])
    if caption_block is None:
        return rows
    best = W.partitionBy("block").orderBy(*[F.desc(c) for c in ("q1", "q2", "q3", "q4", "id")])
    capped = (
        rows.filter("kind = 'caption'").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= caption_block).drop("r")
    )
    return rows.filter("kind = 'name'").unionByName(capped.withColumn("n", F.least("n", F.lit(caption_block).cast("long"))))


def _gates(led: DataFrame, media: str, piece_rows: int, text_rows: int) -> list[tuple[list[str], DataFrame]]:
    """(a value's columns, best lead of each value) of the gates that open in name blocks and in caption blocks.

    In a block of one name the names are equal, in a block of one caption the captions; what is left of the
    conditions of `score_photo_pairs` and `score_video_pairs` are these.
    """
    led = led.withColumn("other_key", F.when(F.col("kind") == "name", F.col("caption_key")).otherwise(F.col("name_key")))
    alike = {"name": CAPTION_ALIKE, "caption": NAME_ALIKE}
    if media == "photo":
        return [
            (["vector"], G.vector_gate(led, {"name": 0.86, "caption": 0.9}, piece_rows=piece_rows)),
            (["phash"], G.hash_gate(led.filter("kind = 'name'"), 0.9)), (["other_key"], G.text_gate(led, "other_key", alike, text_rows)),
        ]
    return [
        (["vector", "duration"], G.vector_gate(led, {"name": 0.88, "caption": 0.9}, 0.94, piece_rows)),
        (["duration"], G.duration_gate(led.filter("kind = 'name'"), 0.98)),
        (["other_key"], G.text_gate(led.filter("kind = 'caption'"), "other_key", alike, text_rows)),
    ]


def first_better(blocks: DataFrame, media: str, piece_rows: int = G.PIECE_ROWS, text_rows: int = G.TEXT_ROWS) -> DataFrame:
    """(kind, id, better): for each item the best item of its block that it is a near copy of, if better.

    Items with equal features behave alike, so each block is first reduced to one profile per feature set, led by its
    best item. Each gate gives a profile the best lead it opens for; the best of them is scored. Where an open
    gate isn't enough (unlike vectors can push a score to zero, a like name needs a like length too), the
    profile is scored with all others of its block.
    """
    led = blocks.groupBy("kind", "block", "profile").agg(
        F.max(quality_order()).alias("q"), *[F.any_value(c).alias(c) for c in _FEATURES]
    )
    led = materialize(led, "profiles")
    open_to = None
    for columns, best in _gates(led, media, piece_rows, text_rows):
        key = F.when(F.col("kind") == "name", F.col("caption_key")).otherwise(F.col("name_key"))
        one = led.withColumn("other_key", key).select("kind", "block", "profile", *columns).join(best, ["kind", "block", *columns]).select("kind", "block", "profile", "lead")
        open_to = one if open_to is None else open_to.unionByName(one)
    pairs = open_to.groupBy("kind", "block", "profile").agg(F.max("lead").alias("lead")).select("kind", "block", "profile", F.col("lead.profile").alias("other"))
    judged = cut_lineage(_judged(spread_groups(pairs, "profile"), led, media))
    shut = judged.filter("not copies").select("kind", "block", "profile")
    found = judged.filter("copies")
    if not shut.isEmpty():
        every = shut.join(led.select("kind", "block", F.col("profile").alias("other")), ["kind", "block"])
        found = found.unionByName(_judged(every, led, media).filter("copies"))
    best = found.groupBy("kind", "block", "profile").agg(F.max("bq").alias("bq"))
    members = blocks.select("kind", "block", "profile", "id", quality_order().alias("q"))
    return members.join(best, ["kind", "block", "profile"]).filter("bq > q").select("kind", "id", F.col("bq.id").alias("better"))


def _judged(pairs: DataFrame, led: DataFrame, media: str) -> DataFrame:
    """Adds the quality of the other profile's lead, and whether the pair's score says they are copies."""
    sides = pairs
    for name, prefix in (("profile", "a_"), ("other", "b_")):
        sides = sides.join(led.select(F.col("profile").alias(name), F.col("q").alias(prefix + "q"), *[F.col(c).alias(prefix + c) for c in _FEATURES]), name)
    sides = sides.withColumns({"b_width": F.lit(0), "b_height": F.lit(0)})
    scored = (score_photo_pairs if media == "photo" else score_video_pairs)(sides)
    return scored.select("kind", "block", "profile", "other", F.col("b_q").alias("bq"), (F.col("score") > 0).alias("copies"))


def _pair_columns(prepared: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    return prepared.select(F.col("id").alias(prefix + "id"), *[F.col(c).alias(prefix + c) for c in keep])


def with_features(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """Pairs (id, better) with the features of both sides as a_* and b_*."""
    keep = [*_FEATURES, "width", "height"]
    named = pairs.withColumnRenamed("id", "a_id").withColumnRenamed("better", "b_id")
    return named.join(_pair_columns(prepared, "a_", keep), "a_id").join(_pair_columns(prepared, "b_", keep), "b_id")


def _scored(rows: DataFrame, gates: Column, score: Column, reasons: Sequence[Column]) -> DataFrame:
    reason = F.array_join(F.array_compact(F.array(*reasons)), SEPARATOR)
    return rows.withColumns(
        {
            "score": F.when(gates, F.round(F.least(score, F.lit(NEAR_SCORE)), 6)).otherwise(0.0),
            "reason": F.when(gates, reason).otherwise(""),
        }
    )


def _with_similarities(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(
        {
            "same_name": (F.col("a_name_key") != "") & (F.col("a_name_key") == F.col("b_name_key")),
            "name_sim": text_similarity(F.col("a_name_key"), F.col("b_name_key")),
            "caption_sim": text_similarity(F.col("a_caption_key"), F.col("b_caption_key")),
            "vec_sim": cosine(F.col("a_vector"), F.col("b_vector")),
            "phash_sim": phash_similarity(F.col("a_phash"), F.col("b_phash")),
            "length_sim": duration_similarity(F.col("a_duration"), F.col("b_duration")),
        }
    )


def _said(test: Column, text: str, value: Column | None = None) -> Column:
    shown = F.lit(text) if value is None else F.concat(F.lit(text + " "), F.format_string("%.2f", value))
    return F.when(test, shown)


def _name_reasons() -> list[Column]:
    same, sim = F.col("same_name"), F.col("name_sim")
    return [_said(same, "规范化文件名一致"), _said(~same & (sim >= 0.9), "文件名高度相似", sim)]


def _keep_reason(text: str) -> Column:
    return F.concat(F.lit(text), F.col("b_width").cast("string"), F.lit("x"), F.col("b_height").cast("string"))


def score_photo_pairs(pairs: DataFrame) -> DataFrame:
    """Adds score (0 when no gate opens) and reason to pairs with a_* (current) and b_* (better)."""
    rows = _with_similarities(pairs)
    same, name, caption, vec, hashed = map(F.col, ("same_name", "name_sim", "caption_sim", "vec_sim", "phash_sim"))
    near_name = same | (name >= 0.94)
    gates = (
        (vec >= 0.96) | ((vec >= 0.92) & (hashed >= 0.84))
        | (near_name & ((vec >= 0.86) | (hashed >= 0.9) | (caption >= 0.88)))
        | ((caption >= 0.9) & (vec >= 0.9))
    )
    bonus = F.greatest(
        F.when(same, 0.16).when(name >= 0.94, 0.12).otherwise(0.0), F.when(caption >= 0.9, 0.08).otherwise(0.0)
    )
    score = bonus + F.least(vec, F.lit(1.0)) * 0.48 + hashed * 0.28
    reasons = [
        _keep_reason("与更高清版本高度重复，建议保留 "), *_name_reasons(),
        _said(vec >= 0.8, "语义向量相似度", vec), _said(hashed >= 0.8, "感知哈希相似度", hashed),
        _said(caption >= 0.88, "AI 描述接近"),
    ]
    return _scored(rows, gates, score, reasons)


def score_video_pairs(pairs: DataFrame) -> DataFrame:
    rows = _with_similarities(pairs)
    same, name, caption, vec, length = map(F.col, ("same_name", "name_sim", "caption_sim", "vec_sim", "length_sim"))
    near_name = same | (name >= 0.94)
    gates = (
        ((vec >= 0.95) & (length >= 0.97))
        | (near_name & ((length >= 0.98) | ((vec >= 0.88) & (length >= 0.94))))
        | ((caption >= 0.9) & (vec >= 0.9) & (length >= 0.94))
    )
    bonus = F.greatest(
        F.when(same, 0.18).when(name >= 0.94, 0.12).otherwise(0.0), F.when(caption >= 0.9, 0.08).otherwise(0.0)
    )
    score = bonus + F.least(vec, F.lit(1.0)) * 0.42 + length * 0.28
    reasons = [
        _keep_reason("与更清晰版本高度重复，建议保留 "), *_name_reasons(),
        _said(length >= 0.9, "时长相近", length), _said(vec >= 0.8, "视频向量相似度", vec),
        _said(caption >= 0.88, "AI 描述接近"),
    ]
    return _scored(rows, gates, score, reasons)


def duplicate_candidates(
    media: DataFrame, kind: str, limit: int | None = None, caption_block: int | None = None,
    piece_rows: int = G.PIECE_ROWS, text_rows: int = G.TEXT_ROWS,
) -> DataFrame:
    """(id, score, reason, width, height, created_at): copies with the best score any block gives them."""
    prepared = materialize(prepare(media, kind), "prepared")
    pairs = first_better(duplicate_blocks(prepared, kind, caption_block), kind, piece_rows, text_rows)
    scorer = score_photo_pairs if kind == "photo" else score_video_pairs
    near = scorer(with_features(pairs, prepared)).filter("score > 0")
    order = F.when(F.col("kind") == "name", -1).otherwise(-2)
    found = exact_duplicates(prepared).select("id", "score", F.lit(0).alias("turn"), "reason").unionByName(
        near.select(F.col("a_id").alias("id"), "score", order.alias("turn"), "reason")
    )
    # of equal scores the digest match counts first, then the name block
    best = found.groupBy("id").agg(F.max_by(F.struct("score", "reason"), F.struct("score", "turn")).alias("b"))
    rows = best.join(prepared.select("id", "width", "height", "created_at"), "id").select(
        "id", "b.score", "b.reason", "width", "height", "created_at"
    )
    if limit is None:
        return rows
    return rows.orderBy(*[F.desc(c) for c in ("score", "width", "height", "created_at", "id")]).limit(limit)


def cleanup_report(
    photos: DataFrame, videos: DataFrame, categories: Sequence[str] = CATEGORIES, limit: int | None = None
) -> DataFrame:
    """(category, rank, id, score, reason, total) for the wanted categories.

    `total` counts all hits of a category. With `limit` its best rows are given with their rank; without
    it all rows are, and rank is null, because numbering them all would pass them through one task.
    """
    makers = {
        "thumbnail_images": lambda: thumbnail_candidates(photos),
        "low_resolution_images": lambda: low_res_images(photos),
        "junk_transfer_images": lambda: junk_images(photos),
        "duplicate_images": lambda: duplicate_candidates(photos, "photo"),
        "low_resolution_videos": lambda: low_res_videos(videos),
        "duplicate_videos": lambda: duplicate_candidates(videos, "video"),
    }
    wanted = [c.strip().lower() for c in categories]
    unknown = [c for c in wanted if c not in makers]
    if unknown or not wanted:
        raise ValueError(f"Unsupported cleanup category: {unknown}")
    out = None
    for category in wanted:
        copies = category.startswith("duplicate")
        first = ["score", "width", "height"] if copies else []
        order = W.partitionBy("category").orderBy(*[F.desc(c) for c in (*first, "created_at", "id")])
        rows = makers[category]().withColumn("category", F.lit(category))
        if copies:
            rows = materialize(rows, "copies")
        total = rows.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
        place = F.lit(None).cast("int") if limit is None else F.row_number().over(order)
        rows = rows.withColumn("rank", place)
        rows = (rows if limit is None else rows.filter(F.col("rank") <= limit)).join(total, "category")
        rows = rows.select("category", "rank", "id", F.round("score", 6).alias("score"), "reason", "total")
        out = rows if out is None else out.unionByName(rows)
    return out
