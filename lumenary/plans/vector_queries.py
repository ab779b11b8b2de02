"""Vector, hash, box and image queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.functions import image as IM
from lumenary.functions import text as X
from lumenary.functions import vector as V
from lumenary.functions.similarity import text_similarity
from lumenary.operators import features as FE
from lumenary.operators import identity as I
from lumenary.operators.detections import nms
from lumenary.plans.catalog import DIM, Catalog, flat_vector, piped
from lumenary.plans.check_sql import flat, ratio_sql, text_vectors
from lumenary.plans.registry import query
from lumenary.plans.text_queries import CAPTION_KEY_SQL


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: CASE WHEN sqrt(list_dot_product({v},{v}))=0 THEN x ELSE x/sqrt(list_dot_product({v},{v})) END)"


@query(
    "v1_cosine", "vec n",
    """SELECT a.vec_id, round(CASE WHEN a.vec_id%7=0 THEN 0 ELSE list_cosine_similarity(a.e,b.e) END,6) AS score
 FROM vec a CROSS JOIN n JOIN vec b ON b.vec_id=(a.vec_id*7+1)%n.n""",
)
def cosine(c: Catalog) -> DataFrame:
    other = c.vectors.select(F.col("vec_id").alias("o"), F.col("embedding").alias("b"))
    rows = c.vectors.withColumn("o", (F.col("vec_id") * 7 + 1) % c.vector_count()).join(other, "o")
    cut = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return rows.select("vec_id", F.round(V.cosine(cut, F.col("b")), 6).alias("score"))


@query(
    "v2_l2_normalize", "vec",
    f"SELECT vec_id, {flat(_unit('s'))} AS unit FROM (SELECT vec_id, list_transform(e, lambda x: x*(vec_id%3)) AS s FROM vec)",
)
def normalize(c: Catalog) -> DataFrame:
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (F.col("vec_id") % 3))
    return c.vectors.select("vec_id", flat_vector(V.l2_normalize(scaled)).alias("unit"))


_BITS = "array_to_string(list_transform(range(1,17), lambda i: lpad(bin(CAST(('0x'||phash[i]) AS BIGINT)),4,'0')),'')"


@query("v3_phash_bits", "photos", f"SELECT id, {_BITS} AS bits FROM photos")
def bits(c: Catalog) -> DataFrame:
    signs = F.transform(V.phash_bits(F.col("phash")), lambda x: F.when(x > 0, "1").otherwise("0"))
    return c.photos.select("id", F.array_join(signs, "").alias("bits"))


def page_images(c: Catalog) -> DataFrame:
    """A picture per page: its bytes as rows of 16 blue-green-red pixels; every tenth is cut short."""
    size = F.octet_length("html")
    rows = F.floor(size / 48).cast("int")
    data = F.when(F.col("page_id") % 10 == 9, F.substring(F.encode("html", "utf-8"), 1, 10)).otherwise(F.encode("html", "utf-8"))
    readable = F.col("page_id") % 10 != 9
    image = F.struct(
        F.col("url").alias("origin"), F.when(readable, rows).otherwise(-1).alias("height"),
        F.when(readable, 16).otherwise(-1).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"),
        data.alias("data"),
    )
    return c.texts("pages").select(F.col("page_id").alias("id"), image.alias("image"))


@query("v4_phash_images")
def phash_images(c: Catalog) -> DataFrame:
    return IM.phash_images(page_images(c)).select("id", "phash")


@query("v5_image_features")
def image_features(c: Catalog) -> DataFrame:
    rows = IM.image_features(IM.phash_images(page_images(c)))
    return rows.select("id", flat_vector(F.col("features")).alias("features"))


@query(
    "v6_image_meta", "",
    "SELECT page_id AS id, 16 AS width, octet_length(encode(html))//48 AS height, 16*(octet_length(encode(html))//48) AS pixels FROM pages WHERE page_id%10<>9 AND octet_length(encode(html))>=48",
)
def image_meta(c: Catalog) -> DataFrame:
    return IM.image_meta(page_images(c)).select("id", "width", "height", "pixels")


_HALF = "list_concat(list_transform(range(0,48), lambda i: 0.0::DOUBLE), list_transform(range(1,65), lambda i: CASE WHEN b[i]='1' THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END))"


@query(
    "v7_photo_vectors", "photo_vec photos",
    f"""SELECT id, {flat('w')} AS vector FROM (SELECT id, CASE WHEN id%2=0 THEN list_transform(list_concat(v, {_HALF}), lambda x: x/sqrt(2))
 ELSE list_concat(v, list_transform(range(0,112), lambda i: 0.0::DOUBLE)) END AS w FROM (SELECT p.id, v.v, {_BITS} AS b FROM photos p JOIN photo_vec v ON v.id=p.id))""",
)
def photo_vectors(c: Catalog) -> DataFrame:
    half = V.l2_normalize(F.concat(V.zeros(48), V.phash_bits(F.col("phash"))))
    features = c.photos.filter(F.col("id") % 2 == 0).select("id", half.alias("features"))
    return FE.photo_vectors(c.photos, features).select("id", flat_vector(F.col("vector")).alias("vector"))


_PAD = "list_transform(range(0,112), lambda i: 0.0::DOUBLE)"


@query(
    "v8_query_vectors", "qv", f"SELECT item_id, {flat(f'list_concat(v, {_PAD})')} AS vector FROM qv",
    {"qv": ("", text_vectors("benchmark", "item_id", "text||' person '||item_id"))},
)
def query_vectors(c: Catalog) -> DataFrame:
    asked = c.table("benchmark").select(
        "item_id", "text", F.array(F.lit("person"), F.col("item_id").cast("string")).alias("people"),
        X.empty_strings().alias("scene_tags"), X.empty_strings().alias("object_tags"),
    )
    return FE.query_vectors(asked).select("item_id", flat_vector(F.col("vector")).alias("vector"))


_POOL = {
    "frame_mean": (
        "faces",
        "SELECT video_id, list(m ORDER BY pos) AS m FROM (SELECT video_id, pos, avg(embedding[pos]) AS m FROM faces, range(1,65) r(pos) GROUP BY ALL) GROUP BY video_id",
    ),
    "pooled": ("frame_mean", f"SELECT video_id, {_unit('m')} AS v FROM frame_mean"),
}


@query("v9_pool_frames", "pooled", f"SELECT video_id, {flat('v')} AS pooled FROM pooled", _POOL)
def pool(c: Catalog) -> DataFrame:
    return FE.pool_frames(c.faces).select("video_id", flat_vector(F.col("pooled")).alias("pooled"))


_VIDEO_TEXT = (
    "caption||chr(10)||coalesce(ocr_text,'')||chr(10)||array_to_string(people,' ')||chr(10)||array_to_string(scene_tags,' ')"
    "||chr(10)||array_to_string(object_tags,' ')||chr(10)||regexp_replace(regexp_replace(storage_path,'^.*/',''),'\\.[^.]+$','')"
)
_MIX = {
    **_POOL,
    "video_text": ("videos", text_vectors("videos", "id", _VIDEO_TEXT)),
    "mixed": (
        "videos pooled vec n",
        """SELECT v.id, list_transform(range(1,65), lambda i: coalesce(0.65::DOUBLE*p.v[i],0)+0.35::DOUBLE*e.e[i]) AS m FROM videos v CROSS JOIN n
 LEFT JOIN pooled p ON p.video_id=v.id JOIN vec e ON e.vec_id=v.id%n.n""",
    ),
}


@query(
    "v10_video_vectors", "video_text mixed",
    f"SELECT id, {flat('list_transform(list_concat(v,u), lambda x: x/sqrt(2))')} AS vector FROM (SELECT t.id, t.v, {_unit('m.m')} AS u FROM video_text t JOIN mixed m ON m.id=t.id)",
    _MIX,
)
def video_vectors(c: Catalog) -> DataFrame:
    pooled = FE.pool_frames(c.faces).select(F.col("video_id").alias("id"), "pooled")
    encoded = c.videos_with_vector.select("id", F.col("vector").alias("encoded"))
    rows = FE.video_vectors(c.videos, pooled, encoded, DIM)
    return rows.select("id", flat_vector(F.col("vector")).alias("vector"))


@query(
    "v11_video_query_vectors", "qt vec",
    f"SELECT item_id, {flat('list_transform(list_concat(q.v, e.e), lambda x: x/sqrt(1+list_dot_product(e.e,e.e)))')} AS vector FROM qt q JOIN vec e ON e.vec_id=q.item_id",
    {"qt": ("", text_vectors("benchmark", "item_id", "text"))},
)
def video_queries(c: Catalog) -> DataFrame:
    none = X.empty_strings()
    asked = c.table("benchmark").select(
        F.col("item_id").alias("id"), "text", none.alias("people"), none.alias("scene_tags"), none.alias("object_tags")
    )
    encoded = c.vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("encoded"))
    rows = FE.video_query_vectors(asked, encoded, DIM)
    return rows.select(F.col("id").alias("item_id"), flat_vector(F.col("vector")).alias("vector"))


@query(
    "v11_video_example_vectors", "pooled",
    f"SELECT video_id, {flat('list_concat(list_transform(range(0,128), lambda i: 0.0::DOUBLE), v)')} AS vector FROM pooled", _POOL,
)
def video_examples(c: Catalog) -> DataFrame:
    rows = FE.video_example_vectors(FE.pool_frames(c.faces))
    return rows.select("video_id", flat_vector(F.col("vector")).alias("vector"))


def prompts(c: Catalog, vocabulary: dict[str, str] = FE.SCENE_PROMPTS) -> DataFrame:
    """A vocabulary with vectors of the embeddings table: the first for scenes, those after them for objects."""
    tags, first = list(vocabulary.values()), _FIRST[id(vocabulary)]
    words = F.array(*map(F.lit, tags))
    no = F.col("vec_id") - first
    return c.vectors.filter((no >= 0) & (no < len(tags))).select(
        F.col("vec_id").alias("no"), F.element_at(words, (no + 1).cast("int")).alias("tag"), "embedding"
    )


_FIRST = {id(FE.SCENE_PROMPTS): 0, id(FE.OBJECT_PROMPTS): len(FE.SCENE_PROMPTS)}


def _tagged_sql(vocabulary: dict[str, str]) -> tuple[str, str]:
    tags, first = "[" + ",".join(f"'{t}'" for t in vocabulary.values()) + "]", _FIRST[id(vocabulary)]
    return (
        "frame_mean vec",
        f"""SELECT video_id, list(tag ORDER BY rank) AS tags FROM (SELECT m.video_id, {tags}[p.vec_id-{first}+1] AS tag, round(list_dot_product(m.m,p.e),6) AS s,
 row_number() OVER (PARTITION BY m.video_id ORDER BY round(list_dot_product(m.m,p.e),6) DESC, p.vec_id DESC) AS rank FROM frame_mean m, vec p
 WHERE p.vec_id>={first} AND p.vec_id<{first + len(vocabulary)}) WHERE rank<=5 AND s>=0.000001 GROUP BY video_id""",
    )


TAG_VIEWS = {**_POOL, "tagged": _tagged_sql(FE.SCENE_PROMPTS), "things": _tagged_sql(FE.OBJECT_PROMPTS)}


@query("v12_zero_shot_tags", "tagged", "SELECT video_id, array_to_string(tags,'|') AS tags FROM tagged", TAG_VIEWS)
def tags(c: Catalog) -> DataFrame:
    return FE.zero_shot_tags(c.faces, prompts(c), dim=DIM).select("video_id", piped(F.col("tags")).alias("tags"))


@query("v12_object_tags", "things", "SELECT video_id, array_to_string(tags,'|') AS tags FROM things", TAG_VIEWS)
def object_tags(c: Catalog) -> DataFrame:
    return FE.zero_shot_tags(c.faces, prompts(c, FE.OBJECT_PROMPTS), dim=DIM).select("video_id", piped(F.col("tags")).alias("tags"))


@query("v13_centroids", "persons", f"SELECT id AS person_id, {flat('centroid', 6)} AS centroid FROM persons WHERE centroid IS NOT NULL")
def centroids(c: Catalog) -> DataFrame:
    return I.centroids(c.samples, dim=DIM).select("person_id", flat_vector(F.col("centroid"), 6).alias("centroid"))


def _pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row next to row (7 id + 1) mod n."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    other = df.select(F.col("id").alias("o"), *[F.col(x).alias("o_" + x) for x in columns])
    return df.withColumn("o", (F.col("id") * 7 + 1) % n).join(other, "o")


@query(
    "v14_phash_similarity", "photos",
    """SELECT a.id, round(greatest(0, 1-bit_count(xor(('0x'||a.phash)::UBIGINT, ('0x'||b.phash)::UBIGINT))/64),6) AS score
 FROM photos a JOIN photos b ON b.id=(a.id*7+1)%(SELECT count(*) FROM photos)""",
)
def phash_pairs(c: Catalog) -> DataFrame:
    rows = _pairs(c.photos.select("id", "phash"), ["phash"])
    return rows.select("id", F.round(V.phash_similarity(F.col("phash"), F.col("o_phash")), 6).alias("score"))


_RATIOS = {
    "ck": ("photos", CAPTION_KEY_SQL.format("photos")),
    "kp": ("ck photos", "SELECT a.id, a.caption_key AS x, b.caption_key AS y FROM ck a JOIN ck b ON b.id=(a.id*7+1)%(SELECT count(*) FROM photos)"),
    "two": ("kp", "SELECT DISTINCT x, y FROM kp WHERE x<>y AND x<>'' AND y<>''"),
    "rat": ("two", ratio_sql("two")),
}


@query(
    "v15_text_similarity", "kp rat",
    "SELECT k.id, round(CASE WHEN k.x='' OR k.y='' THEN 0 WHEN k.x=k.y THEN 1 ELSE r.ratio END,6) AS score FROM kp k LEFT JOIN rat r ON r.x=k.x AND r.y=k.y", _RATIOS,
)
def text_pairs(c: Catalog) -> DataFrame:
    keyed = c.photos.select("id", X.caption_key(F.col("caption")).alias("key"))
    rows = _pairs(keyed, ["key"])
    return rows.select("id", F.round(text_similarity(F.col("key"), F.col("o_key")), 6).alias("score"))


@query(
    "v16_duration_similarity", "videos",
    """SELECT a.id, round(greatest(0, 1-abs(a.duration_seconds-b.duration_seconds)/greatest(a.duration_seconds,b.duration_seconds)),6) AS score
 FROM videos a JOIN videos b ON b.id=(a.id*7+1)%(SELECT count(*) FROM videos)""",
)
def duration_pairs(c: Catalog) -> DataFrame:
    rows = _pairs(c.videos.select("id", "duration_seconds"), ["duration_seconds"])
    score = V.duration_similarity(F.col("duration_seconds"), F.col("o_duration_seconds"))
    return rows.select("id", F.round(score, 6).alias("score"))


@query(
    "v17_normalize_bbox", "faces",
    """SELECT face_id, round(x1/640,7) AS left_share, round(y1/480,7) AS top_share, round((x2-x1)/640,7) AS width_share, round((y2-y1)/480,7) AS height_share FROM faces""",
)
def boxes(c: Catalog) -> DataFrame:
    box = V.normalize_bbox(*[F.col(x) for x in ("x1", "y1", "x2", "y2", "image_width", "image_height")])
    names = ("left_share", "top_share", "width_share", "height_share")
    return c.faces.withColumn("b", box).select("face_id", *[F.round(F.col("b")[i], 7).alias(n) for i, n in enumerate(names)])


@query("v18_filter_detections", "faces", "SELECT face_id, round(det_score,6) AS det_score FROM faces WHERE det_score>=0.65::DOUBLE")
def detections(c: Catalog) -> DataFrame:
    return FE.filter_detections(c.faces, 0.65).select("face_id", F.round("det_score", 6).alias("det_score"))


@query(
    "v19_nms", "faces",
    """SELECT media_id, unnest(kept).id AS face_id FROM (SELECT image AS media_id, list_reduce(list([struct_pack(l:=x1, t:=y1, r:=x2, b:=y2, id:=face_id)] ORDER BY det_score DESC, face_id DESC),
 lambda acc, e: CASE WHEN len(list_filter(acc, lambda k: greatest(0, least(k.r,e[1].r)-greatest(k.l,e[1].l)+1)*greatest(0, least(k.b,e[1].b)-greatest(k.t,e[1].t)+1)
 > 0.1::DOUBLE*((k.r-k.l+1)*(k.b-k.t+1)+(e[1].r-e[1].l+1)*(e[1].b-e[1].t+1)-greatest(0, least(k.r,e[1].r)-greatest(k.l,e[1].l)+1)*greatest(0, least(k.b,e[1].b)-greatest(k.t,e[1].t)+1))))=0
 THEN list_concat(acc,e) ELSE acc END) AS kept FROM (SELECT *, face_id//40 AS image FROM faces) GROUP BY image)""",
)
def suppressed(c: Catalog) -> DataFrame:
    crowded = c.faces.withColumn("media_id", F.floor(F.col("face_id") / 40))
    return nms(crowded.drop("embedding"), 0.1).select("media_id", "face_id")


@query(
    "v20_top_faces", "faces",
    """SELECT media_id, face_id, place FROM (SELECT media_id, face_id, row_number() OVER (PARTITION BY media_id ORDER BY
 (x2-x1)*(y2-y1)-2*(pow((x1+x2)/2-320,2)+pow((y1+y2)/2-240,2)) DESC, face_id DESC) AS place FROM faces) WHERE place<=2""",
)
def top(c: Catalog) -> DataFrame:
    return FE.top_faces(c.faces, 2).select("media_id", "face_id", "place")
