"""Videos over time: sampling, frame votes, people and representative moments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenary.functions.blockmatch import Side
from lumenary.functions.text import distinct_concat, empty_strings
from lumenary.functions.vector import normalize_bbox
from lumenary.operators import identity as I
from lumenary.operators.listing import lookup
from lumenary.session import cut_lineage

# Defaults of sampling, voting and moment selection.
FRAMES, INTERVAL = 24, 1.0
VOTE_FLOOR, VOTE_SLACK, VOTE_MARGIN = 0.36, 0.08, 0.02
VIDEO_FLOOR, VIDEO_SLACK, TOP_VOTES, MIN_HITS = 0.4, 0.06, 4, 2
MOMENT_GAP, MOMENTS_PER_PERSON = 2.0, 5
#: Moments of a person in a video that are gathered in a row at most.
GATHERED = 4_096


def sample_plan(videos: DataFrame, interval: float = INTERVAL, n: int = FRAMES) -> DataFrame:
    """(id, idx, t): the first n distinct sample times of each video, computed inside the row.

    Grid points lie at least a quarter second apart, so the first n of them cover the first n times
    whatever the length of the video.
    """
    step, n = max(0.25, float(interval)), max(1, int(n))
    d = F.col("duration_seconds")
    points = F.least(F.ceil(d / step), F.lit(n)).cast("int")
    grid = F.transform(F.sequence(F.lit(0), points - 1), lambda i: (i * step).cast("float").cast("double"))
    marks = F.array(F.lit(0.0), d * 0.25, d * 0.5, d * 0.75, F.greatest(d - 0.5, F.lit(0.0)))
    top = F.greatest(d - 0.05, F.lit(0.0))
    clamped = F.transform(F.concat(grid, marks), lambda t: F.greatest(F.lit(0.0), F.least(t, top)))
    keyed = F.array_sort(F.transform(clamped, lambda t: F.struct(F.bround(t * 20).cast("long").alias("k"), t.alias("t"))))
    videos = videos.select("id", F.when(d > 0, keyed).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("t")))).alias("c"))
    firsts = F.filter("c", lambda e, i: (i == 0) | (F.element_at("c", F.when(i > 0, i).otherwise(1))["k"] != e["k"]))
    return videos.select("id", F.posexplode(F.slice(firsts, 1, n)).alias("idx", "e")).select(
        "id", "idx", F.round("e.t", 3).alias("t")
    )


def with_duration(df: DataFrame) -> DataFrame:
    known = (F.col("fps") > 0) & (F.col("frame_count") > 0)
    return df.withColumn("duration_seconds", F.coalesce(F.when(known, F.try_divide("frame_count", "fps")), F.lit(0.0)))


def needs_dense_scan() -> Column:
    """Long videos in which the first pass saw too little."""
    d, faces = F.col("duration_seconds"), F.col("face_count")
    unnamed = F.size("names") == 0
    return (d > 2) & ((faces == 0) | (unnamed & (d >= 6)) | ((faces <= 2) & (d >= 12)))


def frame_votes(
    faces: DataFrame, assigned: DataFrame, persons: DataFrame, samples: DataFrame,
    thr: float = I.PERSON_THRESHOLD, dim: int = I.FACE_DIM, top: DataFrame | None = None,
) -> DataFrame:
    """One moment per face that clearly votes for a person.

    faces: face_id, video_id, seq, frame_t, box and image size, embedding; `top`: their `identity.best_two`, where
    they are ranked already (further faces in it don't matter).
    """
    top = I.best_two(Side(faces, "face_id", "embedding"), persons, samples, dim) if top is None else top
    floor = max(VOTE_FLOOR, thr - VOTE_SLACK)
    clear = (F.col("second") <= 0) | (F.round(F.col("score") - F.col("second"), 6) >= VOTE_MARGIN)
    votes = top.filter((F.col("score") >= floor) & clear)
    names = persons.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    box = normalize_bbox(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "image_width", "image_height")])
    return (
        faces.join(votes, "face_id").join(names, "person_id")
        .join(assigned.select("face_id", F.col("label").alias("cluster_label")), "face_id", "left")
        .select(
            "video_id", "seq", "person_id", "person_name", F.col("frame_t").alias("timestamp_seconds"), "score",
            box.alias("bbox"), "cluster_label",
        )
    )


def face_summary(
    faces: DataFrame, assigned: DataFrame, matches: DataFrame, votes: DataFrame, clusters: DataFrame, persons: DataFrame
) -> DataFrame:
    """(video_id, labels, names, face_count) of one pass."""
    media = faces.select("face_id", F.col("video_id").alias("media_id"), "seq")
    voted = votes.select(F.col("video_id").alias("media_id"), "seq", F.col("person_name").alias("name"))
    return I.summarise_faces(media, assigned, matches, clusters, persons, voted)[0].withColumnRenamed("media_id", "video_id")


def merge_passes(base: DataFrame, dense: DataFrame) -> DataFrame:
    """Summaries of two passes: ordered unions and the sum of faces."""
    second = dense.select("video_id", *[F.col(c).alias("d_" + c) for c in ("labels", "names", "face_count")])
    rows = base.join(second, "video_id", "full")
    count = F.coalesce("face_count", F.lit(0)) + F.coalesce("d_face_count", F.lit(0))
    return rows.select(
        "video_id", distinct_concat(F.col("labels"), F.col("d_labels")).alias("labels"),
        distinct_concat(F.col("names"), F.col("d_names")).alias("names"), count.alias("face_count"),
    )


def merge_votes(base: DataFrame, dense: DataFrame) -> DataFrame:
    """Votes of two passes, the second after the first."""
    last = base.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long")) + 1).scalar()
    return base.unionByName(dense.withColumn("seq", F.col("seq") + last))


def video_people(votes: DataFrame, thr: float = I.PERSON_THRESHOLD, min_hits: int = MIN_HITS) -> DataFrame:
    """(video_id, person_id, person_name, first_seq) of persons seen surely, or often enough."""
    key = ["video_id", "person_id"]
    best = W.partitionBy(*key).orderBy(F.desc("score"), "seq")
    top = votes.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= TOP_VOTES)
    means = top.groupBy(*key).agg(F.max("score").alias("best"), F.avg("score").alias("mean"))
    hits = votes.groupBy(*key, "person_name").agg(F.count(F.lit(1)).alias("hits"), F.min("seq").alias("first_seq"))
    sure = F.col("best") >= thr
    often = (F.col("hits") >= min_hits) & (F.col("mean") >= max(VIDEO_FLOOR, thr - VIDEO_SLACK))
    return hits.join(means, key).filter(sure | often).select(*key, "person_name", "first_seq")


def _in_rounds(rows: DataFrame, key: list[str], far: Callable[[Column, Column], Column], n: int, salts: int) -> DataFrame:
    """(key, chosen), in n rounds. A round is one combinable maximum over the moments far from those
    already chosen, first within salted parts and then over them; only the few chosen ones travel."""
    # of the moments at one instant only the best can ever be chosen
    base = rows.groupBy(*key, F.col("m.timestamp_seconds").alias("t")).agg(F.max("m").alias("m")).select(
        *key, "m", F.pmod(F.xxhash64("t"), F.lit(salts)).alias("salt")
    )
    base = cut_lineage(base)  # every round reads it
    chosen = base.groupBy(*key, "salt").agg(F.max("m").alias("m")).groupBy(*key).agg(F.array(F.max("m")).alias("chosen"))
    salted = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    for _ in range(n - 1):
        rows = base.join(chosen.withColumn("salt", salted), [*key, "salt"])
        part = rows.groupBy(*key, "salt").agg(
            F.any_value("chosen").alias("chosen"), F.max(F.when(far(F.col("chosen"), F.col("m")), F.col("m"))).alias("m")
        )
        step = part.groupBy(*key).agg(F.any_value("chosen").alias("chosen"), F.max("m").alias("m"))
        chosen = step.select(*key, F.array_compact(F.concat("chosen", F.array("m"))).alias("chosen"))
    return chosen


def select_moments(
    moments: DataFrame, gap: float = MOMENT_GAP, n: int = MOMENTS_PER_PERSON, salts: int = 16
) -> DataFrame:
    """(video_id, person_name, moments in time order): the best moments at least `gap` apart, up to n.

    Greedy by score. A key's moments are gathered and gone through in order; keys with more than GATHERED of
    them take n rounds instead, so that they are never gathered in one place.
    """
    gap, n = max(0.5, float(gap)), max(1, int(n))
    key = ["video_id", "person_name"]
    rest = [c for c in moments.columns if c not in key]
    # of equal scores the earlier detection goes first
    value = F.struct("score", (-F.col("seq")).alias("_early"), *[c for c in rest if c != "score"])
    rows = cut_lineage(moments.select(*key, value.alias("m")))
    # at most one in GATHERED rows
    long = cut_lineage(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GATHERED).select(*key))
    alike = lambda k: F.col("a." + k).eqNullSafe(F.col("b." + k))
    side = lambda how: rows.alias("a").join(F.broadcast(long.alias("b")), alike(key[0]) & alike(key[1]), how)
    far = lambda chosen, m: F.forall(
        chosen, lambda c: F.abs(c["timestamp_seconds"] - m["timestamp_seconds"]) >= gap
    )
    keep = lambda acc, m: F.when((F.size(acc) < n) & F.coalesce(far(acc, m), F.lit(False)), F.concat(acc, F.array(m))).otherwise(acc)
    held = side("left_anti").groupBy(*key).agg(F.sort_array(F.collect_list("m"), asc=False).alias("ms"))
    chosen = held.select(*key, F.aggregate("ms", F.slice("ms", 1, 1), keep).alias("chosen"))
    if not long.isEmpty():
        chosen = chosen.unionByName(_in_rounds(side("left_semi"), key, far, n, salts))
    ordered = F.array_sort(
        F.transform("chosen", lambda c: F.struct(c["timestamp_seconds"].alias("timestamp_seconds"), c.alias("m")))
    )
    plain = F.transform(
        ordered, lambda e: F.struct(*[e["m"][c].alias(c) for c in ("timestamp_seconds", "score", "seq", *[x for x in rest if x not in ("timestamp_seconds", "score", "seq")])])
    )
    return chosen.select(*key, plain.alias("moments"))


def _listed(rows: DataFrame, key: str, value: str, place: str, out: str) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct(place, value)))
    return rows.groupBy(key).agg(F.array_distinct(F.transform(entries, lambda e: e[value])).alias(out))


def assemble_videos(
    analysed: DataFrame, summary: DataFrame, people: DataFrame, scene_tags: DataFrame, moments: DataFrame,
    object_tags: DataFrame | None = None,
) -> DataFrame:
    """One record per analysed video.

    analysed: id, people, scene_tags, object_tags (of the model), sampled, dense; summary: video_id,
    labels, names, face_count; people: as video_people; *_tags: video_id, tags; moments: as
    select_moments.
    """
    known = _listed(people, "video_id", "person_name", "first_seq", "voted")
    groups = moments.select("video_id", "person_name", F.explode("moments").alias("m")).select(
        "video_id", F.struct("person_name", "m.*").alias("m")
    )
    firsts = groups.groupBy("video_id", "m.person_name").agg(F.min("m.seq").alias("turn"), F.collect_list("m").alias("ms"))
    flat = firsts.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("turn", "person_name", "ms"))).alias("g")).select(
        "video_id",
        F.flatten(F.transform("g", lambda g: F.array_sort(g["ms"], lambda a, b: F.when(a["timestamp_seconds"] < b["timestamp_seconds"], -1).when(a["timestamp_seconds"] > b["timestamp_seconds"], 1).otherwise(0)))).alias("person_moments"),
    )
    rows = analysed.withColumnRenamed("id", "video_id")
    for extra in (summary, known, scene_tags.withColumnRenamed("tags", "scene_found"), flat):
        rows = rows.join(extra, "video_id", "left")
    if object_tags is None:
        rows = rows.withColumn("object_found", empty_strings())
    else:
        rows = rows.join(object_tags.withColumnRenamed("tags", "object_found"), "video_id", "left")
    return rows.select(
        F.col("video_id").alias("id"),
        distinct_concat(F.col("people"), F.col("names"), F.col("voted")).alias("people"),
        distinct_concat(F.col("scene_found"), F.col("scene_tags")).alias("scene_tags"),
        distinct_concat(F.col("object_found"), F.col("object_tags")).alias("object_tags"),
        F.coalesce("labels", empty_strings()).alias("face_clusters"),
        F.coalesce("face_count", F.lit(0)).alias("face_count"),
        (F.col("sampled") + F.coalesce("dense", F.lit(0))).alias("sampled_frame_count"),
        "person_moments",
    )


def reanalyze_videos(videos: DataFrame, ids: DataFrame, analysis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(videos with the analysed columns replaced, one outcome row per listed id).

    A listed video without analysis, or an id without video, is an error of that item only.
    """
    replaced = [c for c in analysis.columns if c != "id" and c in videos.columns]
    asked = ids.select("id").distinct()
    found = lookup(analysis, asked, "id").select("id", *[F.col(c).alias("new_" + c) for c in replaced], F.lit(True).alias("done"))
    rows = videos.join(found, "id", "left")
    new = rows.select(
        *[F.when(F.col("done"), F.col("new_" + c)).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c) for c in videos.columns]
    )
    known = videos.select("id", F.lit(True).alias("known"))
    status = asked.join(known, "id", "left").join(found.select("id", "done"), "id", "left")
    error = (
        F.when(F.col("known").isNull(), F.concat(F.lit("Video not found: "), "id"))
        .when(F.col("done").isNull(), F.concat(F.lit("Video asset not found: "), "id"))
    )
    return new, status.select("id", error.alias("error"))


def reanalyze_photos(
    photos: DataFrame, annotations: DataFrame, new_faces: DataFrame, clusters: DataFrame, persons: DataFrame
) -> DataFrame:
    """Listed photos analysed again. annotations: id, caption, ocr_text, people, scene_tags, object_tags;
    new_faces: media_id, labels, names, face_count, used where a photo has no cluster yet."""
    stored = photos.select("id", "face_clusters", F.col("face_count").alias("old_count"))
    resolved = I.resolve_labels(photos, clusters, persons).select("id", F.col("names").alias("known_names"))
    fresh = new_faces.select(
        F.col("media_id").alias("id"), F.col("labels").alias("new_labels"), F.col("names").alias("new_names"),
        F.col("face_count").alias("new_count"),
    )
    rows = annotations.join(stored, "id").join(resolved, "id", "left").join(fresh, "id", "left")
    has = F.size("face_clusters") > 0
    found = F.when(has, F.size("face_clusters")).otherwise(F.coalesce("new_count", F.lit(0)))
    names = F.when(has, F.col("known_names")).otherwise(F.col("new_names"))
    return rows.select(
        "id", "caption", "ocr_text", distinct_concat(F.col("people"), names).alias("people"), "scene_tags", "object_tags",
        F.when(has, F.col("face_clusters")).otherwise(F.coalesce("new_labels", empty_strings())).alias("face_clusters"),
        F.greatest("old_count", found).alias("face_count"),
    )


def moments_by_person(videos: DataFrame) -> DataFrame:
    """(video_id, place, person_name, moments): groups by first appearance, moments in time order."""
    rows = videos.select(F.col("id").alias("video_id"), F.posexplode("person_moments").alias("pos", "m"))
    groups = rows.groupBy("video_id", F.col("m.person_name").alias("person_name")).agg(
        F.min(F.struct("m.timestamp_seconds", "pos")).alias("first"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("m.timestamp_seconds", "pos", "m"))), lambda e: e["m"]
        ).alias("moments"),
    )
    # at most one row per person of a video
    order = W.partitionBy("video_id").orderBy("first")
    return groups.withColumn("place", F.row_number().over(order)).select("video_id", "place", "person_name", "moments")
