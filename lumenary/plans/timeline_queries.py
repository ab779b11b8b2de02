"""Video timeline queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.operators import features as FE
from lumenary.operators import identity as I
from lumenary.operators import timelines as TL
from lumenary.functions.blockmatch import Side
from lumenary.functions.text import empty_strings
from lumenary.plans.catalog import DIM, THR, Catalog, piped
from lumenary.plans.check_sql import piped as sql_piped
from lumenary.plans.identity_queries import _SUMMARY, assigned, matches
from lumenary.plans.registry import query
from lumenary.session import cut_lineage
from lumenary.plans.vector_queries import TAG_VIEWS, prompts


@query(
    "m1_sample_plan", "videos",
    """SELECT id, row_number() OVER (PARTITION BY id ORDER BY t)-1 AS idx, round(t,3) AS t FROM (SELECT id, min(t) AS t, row_number() OVER (PARTITION BY id ORDER BY min(t)) AS r FROM (
 SELECT id, greatest(0, least(t, greatest(duration_seconds-0.05::DOUBLE,0))) AS t FROM (
 SELECT id, duration_seconds, unnest(list_concat(list_transform(range(0, CAST(ceil(duration_seconds) AS BIGINT)), lambda i: i*1.0::DOUBLE),
 [0.0::DOUBLE, duration_seconds*0.25::DOUBLE, duration_seconds*0.5::DOUBLE, duration_seconds*0.75::DOUBLE, greatest(duration_seconds-0.5::DOUBLE,0)])) AS t FROM videos))
 GROUP BY id, CAST(round_even(t*20,0) AS BIGINT)) WHERE r<=24""",
)
def sample_plan(c: Catalog) -> DataFrame:
    return TL.sample_plan(c.videos)


@query("m2_with_duration", "videos", "SELECT id, round(CASE WHEN id%5=0 THEN 0 ELSE sampled_frame_count/25 END,6) AS duration FROM videos")
def durations(c: Catalog) -> DataFrame:
    fps = F.when(F.col("id") % 5 == 0, 0.0).otherwise(F.col("fps"))
    rows = c.videos.select("id", fps.alias("fps"), F.col("sampled_frame_count").alias("frame_count"))
    return TL.with_duration(rows).select("id", F.round("duration_seconds", 6).alias("duration"))


@query(
    "m3_needs_dense_scan", "videos",
    """SELECT id, duration_seconds>2 AND (face_count=0 OR (len(people)=0 AND duration_seconds>=6) OR (face_count<=2 AND duration_seconds>=12)) AS dense
 FROM videos""",
)
def dense(c: Catalog) -> DataFrame:
    return c.videos.withColumn("names", F.col("people")).select("id", TL.needs_dense_scan().alias("dense"))


VOTES = {
    **_SUMMARY,
    "votes": (
        "faces face_match face_cluster",
        """SELECT f.video_id, f.seq, m.person_id, m.name AS person_name, f.frame_t AS timestamp_seconds, m.score, a.label AS cluster_label
 FROM faces f JOIN face_match m ON m.face_id=f.face_id LEFT JOIN face_cluster a ON a.face_id=f.face_id
 WHERE m.score>=0.36 AND (m.second<=0 OR round(m.score-m.second,6)>=0.02)""",
    ),
}


class Seen:
    """The faces of all videos, matched with clusters and ranked by person once."""

    def __init__(self, c: Catalog) -> None:
        self.c = c
        self.top = cut_lineage(I.best_two(Side(c.faces, "face_id", "embedding"), c.persons, c.samples, DIM))
        self.labels = cut_lineage(assigned(c))

    def part(self, which: int | None) -> DataFrame:
        return self.c.faces if which is None else self.c.faces.filter(F.col("seq") % 2 == which)

    def votes(self, which: int | None = None) -> DataFrame:
        return TL.frame_votes(self.part(which), self.labels, self.c.persons, self.c.samples, THR, DIM, self.top)

    def summary(self, which: int | None = None) -> DataFrame:
        return TL.face_summary(self.part(which), self.labels, matches(self.c, self.top), self.votes(which), self.c.clusters, self.c.persons)

    def merged_votes(self) -> DataFrame:
        """Even faces as the first pass over a video, odd ones as the second."""
        return TL.merge_votes(self.votes(0), self.votes(1))

    def merged_summary(self) -> DataFrame:
        return TL.merge_passes(self.summary(0), self.summary(1))


@query("m4_frame_votes", "votes", "SELECT * FROM votes", VOTES)
def frame_votes(c: Catalog) -> DataFrame:
    return Seen(c).votes().drop("bbox")


_VIDEO_SUMMARY = {
    **VOTES,
    "vrow": ("frow faces", "SELECT r.*, f.video_id, f.seq AS s FROM frow r JOIN faces f ON f.face_id=r.face_id"),
    "vnames": (
        "vrow votes",
        """SELECT video_id, part, list(name ORDER BY p) AS names FROM (SELECT video_id, part, name, min(p) AS p FROM (
 SELECT video_id, s%2 AS part, shown AS name, s*3 AS p FROM vrow UNION ALL SELECT video_id, s%2, match_name, s*3+1 FROM vrow UNION ALL SELECT video_id, seq%2, person_name, seq*3+2 FROM votes)
 WHERE name IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
    ),
    "vlabels": (
        "vrow",
        "SELECT video_id, part, list(label ORDER BY p) AS labels FROM (SELECT video_id, s%2 AS part, label, min(s) AS p FROM vrow WHERE label IS NOT NULL GROUP BY ALL) GROUP BY ALL",
    ),
    "wnames": (
        "vrow votes",
        """SELECT video_id, list(name ORDER BY p) AS names FROM (SELECT video_id, name, min(p) AS p FROM (
 SELECT video_id, shown AS name, s*3 AS p FROM vrow UNION ALL SELECT video_id, match_name, s*3+1 FROM vrow UNION ALL SELECT video_id, person_name, seq*3+2 FROM votes)
 WHERE name IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
    ),
    "vsum": (
        "vrow wnames",
        """SELECT c.video_id, c.n AS face_count, l.labels, w.names FROM (SELECT video_id, count(*) AS n FROM vrow GROUP BY 1) c LEFT JOIN wnames w ON w.video_id=c.video_id
 LEFT JOIN (SELECT video_id, list(label ORDER BY p) AS labels FROM (SELECT video_id, label, min(s) AS p FROM vrow WHERE label IS NOT NULL GROUP BY ALL) GROUP BY 1) l ON l.video_id=c.video_id""",
    ),
}


@query(
    "m4_face_summary", "vsum",
    "SELECT video_id, array_to_string(coalesce(labels,[]),'|') AS labels, array_to_string(coalesce(names,[]),'|') AS names, face_count FROM vsum", _VIDEO_SUMMARY,
)
def face_summary(c: Catalog) -> DataFrame:
    rows = Seen(c).summary()
    return rows.select("video_id", piped(F.col("labels")).alias("labels"), piped(F.col("names")).alias("names"), "face_count")


def _joined(kind: str) -> str:
    both = f"list_concat(coalesce(a.{kind},[]), list_filter(coalesce(b.{kind},[]), lambda x: NOT list_contains(coalesce(a.{kind},[]), x)))"
    return f"(SELECT v.video_id, {both} AS {kind} FROM (SELECT DISTINCT video_id FROM vrow) v LEFT JOIN v{kind} a ON a.video_id=v.video_id AND a.part=0 LEFT JOIN v{kind} b ON b.video_id=v.video_id AND b.part=1)"


@query(
    "m5_merge_passes", "vnames vlabels",
    f"""SELECT n.video_id, array_to_string(l.labels,'|') AS labels, array_to_string(n.names,'|') AS names, c.n AS face_count FROM {_joined('names')} n JOIN {_joined('labels')} l ON l.video_id=n.video_id
 JOIN (SELECT video_id, count(*) AS n FROM vrow GROUP BY 1) c ON c.video_id=n.video_id""", _VIDEO_SUMMARY,
)
def merge_passes(c: Catalog) -> DataFrame:
    rows = Seen(c).merged_summary()
    return rows.select("video_id", piped(F.col("labels")).alias("labels"), piped(F.col("names")).alias("names"), "face_count")


_MERGED = {
    **VOTES,
    "merged": (
        "votes",
        """SELECT * REPLACE (CASE WHEN seq%2=0 THEN seq ELSE seq+1+(SELECT coalesce(max(seq),0) FROM votes WHERE seq%2=0) END AS seq) FROM votes""",
    ),
}


@query("m5_merge_votes", "merged", "SELECT * FROM merged", _MERGED)
def merge_votes(c: Catalog) -> DataFrame:
    return Seen(c).merged_votes().drop("bbox")


@query(
    "m6_video_people_of_two_passes", "merged",
    """SELECT video_id, person_id, person_name, min(seq) AS first_seq FROM merged GROUP BY ALL
 HAVING max(score)>=0.30 OR (count(*)>=2 AND list_avg(list(score ORDER BY score DESC)[1:4])>=0.4)""", _MERGED,
)
def people_of_two_passes(c: Catalog) -> DataFrame:
    return TL.video_people(Seen(c).merged_votes(), THR)


_PEOPLE = {
    **_VIDEO_SUMMARY,
    "vpeople": (
        "votes",
        """SELECT video_id, person_id, person_name, min(seq) AS first_seq FROM votes GROUP BY ALL
 HAVING max(score)>=0.30 OR (count(*)>=2 AND list_avg(list(score ORDER BY score DESC)[1:4])>=0.4)""",
    ),
}


@query("m6_video_people", "vpeople", "SELECT * FROM vpeople", _PEOPLE)
def video_people(c: Catalog) -> DataFrame:
    return TL.video_people(Seen(c).votes(), THR)


@query(
    "m6_video_people_votes", "moments",
    """SELECT video_id, person_name, min(seq) AS first_seq FROM moments GROUP BY ALL HAVING max(score)>=0.97 OR (count(*)>=2 AND list_avg(list(score ORDER BY score DESC)[1:4])>=0.91::DOUBLE)""",
)
def video_people_votes(c: Catalog) -> DataFrame:
    rows = c.moments.withColumn("person_id", F.xxhash64("person_name"))
    return TL.video_people(rows, 0.97).select("video_id", "person_name", "first_seq")


@query(
    "m7_select_moments", "moments",
    """SELECT video_id, person_name, m.t AS timestamp_seconds, m.s AS score, m.seq AS seq FROM (SELECT video_id, person_name, unnest(chosen) AS m FROM (SELECT video_id, person_name, list_reduce(
 list([struct_pack(t:=timestamp_seconds, s:=score, seq:=seq)] ORDER BY score DESC, seq),
 lambda acc, e: CASE WHEN len(acc)<5 AND len(list_filter(acc, lambda a: abs(a.t-e[1].t)<24))=0 THEN list_concat(acc,e) ELSE acc END) AS chosen FROM moments GROUP BY video_id, person_name))""",
)
def moments(c: Catalog) -> DataFrame:
    rows = TL.select_moments(c.moments, 24.0)
    return rows.select("video_id", "person_name", F.explode("moments").alias("m")).select(
        "video_id", "person_name", "m.timestamp_seconds", "m.score", "m.seq"
    )


_MERGED_MOMENTS = {
    **_MERGED,
    "two_moments": (
        "merged",
        """SELECT video_id, person_name, m.t AS timestamp_seconds, m.s AS score, m.seq AS seq FROM (SELECT video_id, person_name, unnest(chosen) AS m FROM (SELECT video_id, person_name, list_reduce(
 list([struct_pack(t:=timestamp_seconds, s:=score, seq:=seq)] ORDER BY score DESC, seq),
 lambda acc, e: CASE WHEN len(acc)<5 AND len(list_filter(acc, lambda a: abs(a.t-e[1].t)<2))=0 THEN list_concat(acc,e) ELSE acc END) AS chosen FROM merged GROUP BY video_id, person_name))""",
    ),
}


@query("m7_select_moments_of_two_passes", "two_moments", "SELECT * FROM two_moments", _MERGED_MOMENTS)
def moments_of_two_passes(c: Catalog) -> DataFrame:
    rows = TL.select_moments(Seen(c).merged_votes().drop("person_id"))
    return rows.select("video_id", "person_name", F.explode("moments").alias("m")).select(
        "video_id", "person_name", "m.timestamp_seconds", "m.score", "m.seq"
    )


def _records_sql(summary: str) -> str:
    return f"""SELECT v.id, array_to_string(list_concat(v.people, list_filter(coalesce(s.names,[]), lambda x: NOT list_contains(v.people,x))),'|') AS people,
 array_to_string(list_concat(coalesce(t.tags,[]), v.scene_tags),'|') AS scene_tags,
 array_to_string(list_concat(coalesce(o.tags,[]), list_filter(v.object_tags, lambda x: NOT list_contains(coalesce(o.tags,[]),x))),'|') AS object_tags, array_to_string(coalesce(s.labels,[]),'|') AS face_clusters,
 coalesce(s.face_count,0) AS face_count, v.sampled_frame_count+v.id%3 AS sampled_frame_count
 FROM videos v LEFT JOIN {summary} s ON s.video_id=v.id LEFT JOIN tagged t ON t.video_id=v.id LEFT JOIN things o ON o.video_id=v.id"""


def _records(c: Catalog, summary: DataFrame, found: DataFrame) -> DataFrame:
    analysed = c.videos.select(
        "id", "people", "scene_tags", "object_tags", F.col("sampled_frame_count").alias("sampled"), (F.col("id") % 3).alias("dense")
    )
    rows = TL.assemble_videos(
        analysed, summary, TL.video_people(found, THR), FE.zero_shot_tags(c.faces, prompts(c), dim=DIM),
        TL.select_moments(found.drop("person_id")), FE.zero_shot_tags(c.faces, prompts(c, FE.OBJECT_PROMPTS), dim=DIM),
    )
    spelt = F.transform("person_moments", lambda m: F.concat_ws(":", m["person_name"], F.format_string("%.1f", m["timestamp_seconds"])))
    lists = [piped(F.col(x)).alias(x) for x in ("people", "scene_tags", "object_tags", "face_clusters")]
    return rows.select("id", *lists, "face_count", "sampled_frame_count", piped(F.coalesce(spelt, empty_strings())).alias("moments"))


@query("m8_assemble_videos", "vsum vpeople tagged things videos", _records_sql("vsum"), {**_PEOPLE, **TAG_VIEWS})
def assemble(c: Catalog) -> DataFrame:
    seen = Seen(c)
    return _records(c, seen.summary(), seen.votes()).drop("moments")


_TWO_PASSES = {
    **_MERGED_MOMENTS, **_PEOPLE, **TAG_VIEWS,
    "vsum2": (
        "vnames vlabels vrow",
        f"""SELECT n.video_id, l.labels, n.names, c.n AS face_count FROM {_joined('names')} n JOIN {_joined('labels')} l ON l.video_id=n.video_id
 JOIN (SELECT video_id, count(*) AS n FROM vrow GROUP BY 1) c ON c.video_id=n.video_id""",
    ),
    # persons by their first vote, each one's moments in time order
    "spelt": (
        "two_moments",
        """SELECT video_id, string_agg(person_name||':'||printf('%.1f',timestamp_seconds), '|' ORDER BY turn, person_name, timestamp_seconds) AS moments
 FROM (SELECT *, min(seq) OVER (PARTITION BY video_id, person_name) AS turn FROM two_moments) GROUP BY video_id""",
    ),
}


@query(
    "m8_assemble_videos_of_two_passes", "vsum2 spelt tagged things videos",
    f"SELECT r.*, coalesce(p.moments,'') AS moments FROM ({_records_sql('vsum2')}) r LEFT JOIN spelt p ON p.video_id=r.id", _TWO_PASSES,
)
def assemble_two_passes(c: Catalog) -> DataFrame:
    seen = Seen(c)
    return _records(c, seen.merged_summary(), cut_lineage(seen.merged_votes()))


@query(
    "m9_reanalyze_videos", "videos",
    "SELECT id, CASE WHEN id%2=0 AND id%3=0 THEN 'again '||id ELSE caption END AS caption FROM videos",
)
def reanalyze(c: Catalog) -> DataFrame:
    ids = c.videos.filter("id % 2 = 0").select("id")
    analysis = c.videos.filter("id % 3 = 0").select("id", F.concat(F.lit("again "), "id").alias("caption"))
    return TL.reanalyze_videos(c.videos, ids, analysis)[0].select("id", "caption")


@query(
    "m9_reanalysis_outcome", "videos",
    """SELECT count(*) FILTER (ok) AS completed_items, count(*) FILTER (NOT ok) AS failed_items, 'completed' AS status FROM (SELECT id%3=0 AS ok FROM videos WHERE id%2=0 UNION ALL SELECT false)""",
)
def reanalysis_outcome(c: Catalog) -> DataFrame:
    from lumenary.operators.jobs import task_outcome

    missing = c.videos.agg((F.max("id") + 1).alias("id"))
    ids = c.videos.filter("id % 2 = 0").select("id").unionByName(missing)
    analysis = c.videos.filter("id % 3 = 0").select("id", F.lit("x").alias("caption"))
    status = TL.reanalyze_videos(c.videos, ids, analysis)[1]
    rows = status.select(F.lit(1).alias("task_id"), F.col("id").alias("seq"), "error")
    return task_outcome(rows).select("completed_items", "failed_items", "status")


@query(
    "m9_reanalyze_photos", "rich_photos",
    """SELECT id, array_to_string(list_concat(['model'], CASE WHEN id%7=0 THEN ['New'] ELSE face_names END),'|') AS people, CASE WHEN id%7=0 THEN 'face-new' ELSE array_to_string(face_clusters,'|') END AS face_clusters,
 greatest(face_count, CASE WHEN id%7=0 THEN 2 ELSE len(face_clusters) END) AS face_count FROM rich_photos""",
)
def reanalyze_photos(c: Catalog) -> DataFrame:
    bare = F.when(F.col("id") % 7 == 0, empty_strings()).otherwise(F.col("face_clusters"))
    photos = c.photos.withColumn("face_clusters", bare)
    notes = photos.select(
        "id", "caption", "ocr_text", F.array(F.lit("model")).alias("people"), "scene_tags", "object_tags"
    )
    fresh = photos.select(
        F.col("id").alias("media_id"), F.array(F.lit("face-new")).alias("labels"), F.array(F.lit("New")).alias("names"),
        F.lit(2).alias("face_count"),
    )
    rows = TL.reanalyze_photos(photos, notes, fresh, c.clusters, c.persons)
    return rows.select("id", piped(F.col("people")).alias("people"), piped(F.col("face_clusters")).alias("face_clusters"), "face_count")


@query(
    "m10_moments_by_person", "moments",
    """SELECT video_id, person_name, row_number() OVER (PARTITION BY video_id ORDER BY f) AS place, times FROM (SELECT video_id, person_name, min(struct_pack(a:=timestamp_seconds, b:=seq)) AS f,
 string_agg(printf('%.3f', timestamp_seconds), '|' ORDER BY timestamp_seconds, seq) AS times FROM moments GROUP BY ALL)""",
)
def grouped(c: Catalog) -> DataFrame:
    record = F.struct("person_name", "timestamp_seconds", "score")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", record.alias("m")))), lambda e: e["m"])
    videos = c.moments.groupBy(F.col("video_id").alias("id")).agg(ordered.alias("person_moments"))
    times = F.transform("moments", lambda m: F.format_string("%.3f", m["timestamp_seconds"]))
    return TL.moments_by_person(videos).select("video_id", "person_name", "place", piped(times).alias("times"))
