"""Clean-up queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.operators import hygiene as H
from lumenary.plans.catalog import Catalog
from lumenary.plans.check_sql import ratio_sql
from lumenary.plans.registry import query
from lumenary.plans.text_queries import CAPTION_KEY_SQL, NAME_KEY_SQL
from lumenary.session import materialize

def _first_hint(hints) -> str:
    whens = " ".join(f"WHEN contains(paths,'{h}') THEN '{h}'" for h in hints)
    return f"CASE {whens} END"


def _paths(media: str) -> str:
    return f"(SELECT *, lower(original_path||' '||storage_path) AS paths, width*height AS px, width||'x'||height AS size FROM {media})"


def _tail(limit: int) -> str:
    return f" ORDER BY created_at DESC, id DESC LIMIT {limit}"


_THUMB = f"""SELECT id, round(least(score,0.99),6) AS score, reason FROM (SELECT id, created_at,
 CASE WHEN hint IS NOT NULL THEN 0.62::DOUBLE ELSE 0 END + CASE WHEN width<=480 OR height<=480 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN px<=200000 THEN 0.16::DOUBLE ELSE 0 END
 + CASE WHEN source_kind IN ('wechat_folder','qq_folder') THEN 0.04::DOUBLE ELSE 0 END AS score,
 concat_ws('；', CASE WHEN hint IS NOT NULL THEN '路径或文件名包含 '||hint||' 缩略图特征' END, CASE WHEN width<=480 OR height<=480 THEN '分辨率仅 '||size END,
 CASE WHEN px<=200000 THEN '总像素明显偏小' END, CASE WHEN source_kind IN ('wechat_folder','qq_folder') THEN '来自聊天同步目录' END) AS reason
 FROM (SELECT *, {_first_hint(H.THUMB_HINTS)} AS hint FROM {_paths('photos')})) WHERE score>=0.66::DOUBLE"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), "reason")


@query("k1_thumbnail_candidates", "photos", _THUMB)
def thumbnails(c: Catalog) -> DataFrame:
    return _shown(H.thumbnail_candidates(c.photos))


_LOW = """SELECT id, CASE WHEN width<=640 OR height<=640 OR px<=300000 THEN 0.96::DOUBLE ELSE 0.76::DOUBLE END AS score,
 CASE WHEN width<=640 OR height<=640 OR px<=300000 THEN '分辨率过低，仅 ' ELSE '分辨率偏低，为 ' END||size AS reason FROM {0}
 WHERE width<=640 OR height<=640 OR px<=300000 OR width<1280 OR height<720"""


@query("k2_low_res_images", "photos", _LOW.format(_paths("photos")))
def low_images(c: Catalog) -> DataFrame:
    return _shown(H.low_res_images(c.photos))


_JUNK = f"""SELECT id, round(least(score,0.99),6) AS score, reason FROM (SELECT id, created_at, 0.2::DOUBLE + 0.0::DOUBLE + CASE WHEN hint IS NOT NULL THEN 0.34::DOUBLE ELSE 0 END
 + CASE WHEN width<=720 OR height<=720 THEN 0.16::DOUBLE ELSE 0 END + CASE WHEN px<=250000 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN face_count=0 THEN 0.08::DOUBLE ELSE 0 END
 + CASE WHEN blank THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN len(people)+len(scene_tags)+len(object_tags)=0 THEN 0.1::DOUBLE ELSE 0 END AS score,
 concat_ws('；', '来自微信 / QQ 同步目录', CASE WHEN hint IS NOT NULL THEN '路径或文件名包含 '||hint||' 缓存 / 缩略图特征' END, CASE WHEN width<=720 OR height<=720 THEN '分辨率较小，仅 '||size END,
 CASE WHEN px<=250000 THEN '总像素较小' END, CASE WHEN face_count=0 THEN '未检测到人物' END, CASE WHEN blank THEN '没有可保留的 OCR 文本' END,
 CASE WHEN len(people)+len(scene_tags)+len(object_tags)=0 THEN 'AI 内容信号较弱' END) AS reason
 FROM (SELECT *, coalesce(trim(ocr_text),'')='' AS blank, {_first_hint(H.JUNK_HINTS)} AS hint FROM {_paths('photos')} WHERE source_kind IN ('wechat_folder','qq_folder'))) WHERE score>=0.7::DOUBLE"""


@query("k3_junk_images", "photos", _JUNK)
def junk(c: Catalog) -> DataFrame:
    return _shown(H.junk_images(c.photos))


_SIZED_VIDEOS = "(SELECT *, frame_width AS width, frame_height AS height, frame_width*frame_height AS px, frame_width||'x'||frame_height AS size FROM videos)"


_LOW_VIDEOS = f"""SELECT id, CASE WHEN width<=640 OR height<=360 THEN 0.96::DOUBLE ELSE 0.8::DOUBLE END AS score,
 CASE WHEN width<=640 OR height<=360 THEN '视频分辨率过低，仅 ' ELSE '视频分辨率偏低，为 ' END||size AS reason FROM {_SIZED_VIDEOS}
 WHERE width<=640 OR height<=360 OR width<960 OR height<540"""


@query("k4_low_res_videos", "videos", _LOW_VIDEOS)
def low_videos(c: Catalog) -> DataFrame:
    return _shown(H.low_res_videos(c.videos))


_Q = {
    "photo": "struct_pack(a:=px, b:=face_count, c:=CASE WHEN coalesce(trim(ocr_text),'')='' THEN 0 ELSE 1 END, d:=coalesce(taken_at,created_at), e:=id)",
    "video": "struct_pack(a:=px, b:=duration_seconds, c:=sampled_frame_count, d:=coalesce(taken_at,created_at), e:=id)",
}
_ROWS = {"photo": _paths("photos"), "video": _SIZED_VIDEOS}


def _exact_sql(kind: str) -> str:
    return f"""SELECT id, keeper, 0.99::DOUBLE AS score, '与保留项二进制完全一致（SHA256 相同）；建议保留更优版本 '||best AS reason FROM (
 SELECT id, first_value(id) OVER w AS keeper, first_value(size) OVER w AS best, row_number() OVER w AS r FROM {_ROWS[kind]} WINDOW w AS (PARTITION BY sha256 ORDER BY {_Q[kind]} DESC)) WHERE r>1"""


def _media(c: Catalog, kind: str) -> DataFrame:
    return c.photos_to_clean if kind == "photo" else c.videos_with_vector


def _blocks_sql(kind: str) -> str:
    caption = "caption_key" if kind == "photo" else "caption_key||':'||CAST(round_even(duration_seconds*10,0) AS BIGINT)"
    return f"""SELECT kind, block, id FROM (SELECT *, count(*) OVER (PARTITION BY kind, block) AS n FROM (
 SELECT 'name' AS kind, k.name_key AS block, id, {_Q[kind]} AS q FROM {_ROWS[kind]} m JOIN {kind}_nk k USING (id) WHERE k.name_key<>''
 UNION ALL SELECT 'caption', {caption}, id, {_Q[kind]} FROM {_ROWS[kind]} m JOIN {kind}_ck k USING (id) WHERE k.caption_key<>'')) WHERE n>1"""


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789_ "


def _letters(text: str) -> str:
    """How often each letter is in a text, all further ones together."""
    counts = ", ".join(f"len({text})-len(replace({text},'{x}',''))" for x in _LETTERS)
    return f"(SELECT list_append(l, len({text})-list_sum(l)) FROM (SELECT [{counts}] AS l))"


_OTHER = {
    "photo": ("CASE WHEN a.h IS NULL OR b.h IS NULL THEN 0::DOUBLE ELSE 1-bit_count(xor(a.h,b.h))/64.0::DOUBLE END", "('0x'||phash)::UBIGINT AS h"),
    "video": ("CASE WHEN a.h>0 AND b.h>0 THEN greatest(0::DOUBLE, 1-abs(a.h-b.h)/greatest(a.h,b.h)) ELSE 0::DOUBLE END", "duration_seconds AS h"),
}
# what opens without regard to the other key, and what the other key must go with, in name and in caption blocks
_OPEN = {
    "photo": ("vec>=0.86::DOUBLE OR oth>=0.9::DOUBLE", "vec>=0.9::DOUBLE", "true", "true"),
    "video": (
        "oth>=0.98::DOUBLE OR (vec>=0.88::DOUBLE AND oth>=0.94::DOUBLE)", "vec>=0.9::DOUBLE AND oth>=0.94::DOUBLE", "false",
        "oth>=0.98::DOUBLE OR (vec>=0.88::DOUBLE AND oth>=0.94::DOUBLE)",
    ),
}
_WEIGHT = {"photo": ("0.48::DOUBLE", "0.16::DOUBLE"), "video": ("0.42::DOUBLE", "0.18::DOUBLE")}
_SAID = {
    "photo": ("与更高清版本高度重复，建议保留 ", "CASE WHEN vec>=0.8::DOUBLE THEN '语义向量相似度 '||printf('%.2f',vec) END, CASE WHEN oth>=0.8::DOUBLE THEN '感知哈希相似度 '||printf('%.2f',oth) END"),
    "video": ("与更清晰版本高度重复，建议保留 ", "CASE WHEN oth>=0.9::DOUBLE THEN '时长相近 '||printf('%.2f',oth) END, CASE WHEN vec>=0.8::DOUBLE THEN '视频向量相似度 '||printf('%.2f',vec) END"),
}


def _near_views(kind: str, media: str) -> dict:
    """Every item with every better one of its blocks; the best better one that qualifies."""
    weight, same = _WEIGHT[kind]
    name_open, caption_open, name_with, caption_with = _OPEN[kind]
    total = f"least(vec,1)*{weight}+oth*0.28::DOUBLE"
    text = "CASE k.kind WHEN 'name' THEN {0}.caption_key ELSE {0}.name_key END"
    floor = "CASE kind WHEN 'name' THEN 0.88::DOUBLE ELSE 0.94::DOUBLE END"
    lead, said = _SAID[kind]
    return {
        f"{kind}_e": (f"{media} vec n", f"SELECT m.id, v.e AS v FROM {media} m CROSS JOIN n JOIN vec v ON v.vec_id=m.id%n.n"),
        f"{kind}_it": (
            f"{media} {kind}_nk {kind}_ck {kind}_e",
            f"""SELECT m.id, m.size, {_Q[kind]} AS q, name_key, caption_key, e.v, {_OTHER[kind][1]}, {_letters('name_key')} AS nl, {_letters('caption_key')} AS cl
 FROM {_ROWS[kind]} m JOIN {kind}_nk USING (id) JOIN {kind}_ck USING (id) JOIN {kind}_e e USING (id)""",
        ),
        f"{kind}_blk": (f"{media} {kind}_nk {kind}_ck", _blocks_sql(kind)),
        f"{kind}_pr": (
            f"{kind}_it {kind}_blk",
            f"""SELECT *, len(x) AS lx, len(y) AS ly FROM (SELECT k.kind, k.block, a.id AS a_id, b.id AS b_id, b.q AS bq, list_cosine_similarity(a.v,b.v) AS vec, {_OTHER[kind][0]} AS oth,
 a.name_key<>'' AND a.name_key=b.name_key AS same, {text.format('a')} AS x, {text.format('b')} AS y, CASE k.kind WHEN 'name' THEN a.cl ELSE a.nl END AS ax, CASE k.kind WHEN 'name' THEN b.cl ELSE b.nl END AS bx
 FROM {kind}_blk k JOIN {kind}_blk l ON l.kind=k.kind AND l.block=k.block JOIN {kind}_it a ON a.id=k.id JOIN {kind}_it b ON b.id=l.id WHERE b.q>a.q)""",
        ),
        f"{kind}_may": (
            f"{kind}_pr",
            f"""SELECT *, {floor} AS floor FROM {kind}_pr WHERE NOT CASE kind WHEN 'name' THEN {name_open} ELSE {caption_open} END AND CASE kind WHEN 'name' THEN {name_with} ELSE {caption_with} END
 AND lx>0 AND ly>0 AND 2*least(lx,ly)>={floor}*(lx+ly) AND 2*list_sum(list_transform(list_zip(ax,bx), lambda z: least(z[1],z[2])))>={floor}*(lx+ly)""",
        ),
        f"{kind}_two": (f"{kind}_may", f"SELECT DISTINCT x, y FROM {kind}_may WHERE x<>y"),
        f"{kind}_rat": (f"{kind}_two", ratio_sql(f"{kind}_two")),
        f"{kind}_acc": (
            f"{kind}_pr {kind}_may {kind}_rat",
            f"""SELECT kind, block, a_id, b_id, bq FROM {kind}_pr WHERE CASE kind WHEN 'name' THEN ({name_open}) AND {same}+{total}>0 ELSE {caption_open} END
 UNION ALL SELECT m.kind, block, a_id, b_id, bq FROM {kind}_may m LEFT JOIN {kind}_rat r ON r.x=m.x AND r.y=m.y
 WHERE (m.x=m.y OR r.ratio>=floor) AND CASE WHEN same THEN {same} ELSE 0.12::DOUBLE END+{total}>0""",
        ),
        f"{kind}_first": (f"{kind}_acc", f"SELECT kind, a_id, arg_max(b_id, bq) AS b_id FROM {kind}_acc GROUP BY kind, block, a_id"),
        f"{kind}_fin": (
            f"{kind}_first {kind}_it",
            f"""SELECT f.*, a.name_key AS an, b.name_key AS bn, a.caption_key AS ac, b.caption_key AS bc, b.size, list_cosine_similarity(a.v,b.v) AS vec, {_OTHER[kind][0]} AS oth
 FROM {kind}_first f JOIN {kind}_it a ON a.id=f.a_id JOIN {kind}_it b ON b.id=f.b_id""",
        ),
        f"{kind}_both": (f"{kind}_fin", f"SELECT DISTINCT x, y FROM (SELECT an AS x, bn AS y FROM {kind}_fin UNION ALL SELECT ac, bc FROM {kind}_fin) WHERE x<>y AND x<>'' AND y<>''"),
        f"{kind}_rat2": (f"{kind}_both", ratio_sql(f"{kind}_both")),
        f"{kind}_scored": (
            f"{kind}_fin {kind}_rat2",
            f"""SELECT kind, a_id, b_id, round(least(greatest(CASE WHEN same THEN {same} WHEN name>=0.94::DOUBLE THEN 0.12::DOUBLE ELSE 0::DOUBLE END, CASE WHEN cap>=0.9::DOUBLE THEN 0.08::DOUBLE ELSE 0::DOUBLE END)+{total}, 0.985::DOUBLE),6) AS score,
 concat_ws('；', '{lead}'||size, CASE WHEN same THEN '规范化文件名一致' END, CASE WHEN NOT same AND name>=0.9::DOUBLE THEN '文件名高度相似 '||printf('%.2f',name) END, {said}, CASE WHEN cap>=0.88::DOUBLE THEN 'AI 描述接近' END) AS reason
 FROM (SELECT f.*, an<>'' AND an=bn AS same, CASE WHEN an='' OR bn='' THEN 0 WHEN an=bn THEN 1 ELSE n.ratio END AS name, CASE WHEN ac='' OR bc='' THEN 0 WHEN ac=bc THEN 1 ELSE c.ratio END AS cap
 FROM {kind}_fin f LEFT JOIN {kind}_rat2 n ON n.x=f.an AND n.y=f.bn LEFT JOIN {kind}_rat2 c ON c.x=f.ac AND c.y=f.bc)""",
        ),
        f"{kind}_dup": (
            f"{kind}_scored {media}",
            f"""SELECT id, arg_max(struct_pack(score, reason), struct_pack(score, turn)) AS b FROM (SELECT id, score, 0 AS turn, reason FROM ({_exact_sql(kind)})
 UNION ALL SELECT a_id, score, CASE kind WHEN 'name' THEN -1 ELSE -2 END, reason FROM {kind}_scored) GROUP BY id""",
        ),
    }


def _keys(kind: str, media: str) -> dict:
    return {f"{kind}_nk": (media, NAME_KEY_SQL + f"{media})))"), f"{kind}_ck": (media, CAPTION_KEY_SQL.format(media))}


def _register(kind: str) -> None:
    media = f"{kind}s"
    keys = _keys(kind, media)
    near = {**keys, **_near_views(kind, media)}

    def prepared(c: Catalog) -> DataFrame:
        return H.prepare(_media(c, kind), kind)

    @query(f"k6_exact_duplicates_{media}", media, _exact_sql(kind))
    def exact(c: Catalog) -> DataFrame:
        return H.exact_duplicates(prepared(c))

    @query(f"k7_duplicate_blocks_{media}", f"{media} {kind}_nk {kind}_ck", _blocks_sql(kind), keys)
    def blocks(c: Catalog) -> DataFrame:
        return H.duplicate_blocks(prepared(c), kind).select("kind", "block", "id")

    number = 8 if kind == "photo" else 9

    @query(f"k{number}_score_{kind}_pairs", f"{kind}_scored", f"SELECT kind, a_id, b_id, score, reason FROM {kind}_scored", near)
    def pairs(c: Catalog) -> DataFrame:
        rows = materialize(prepared(c), "prepared")
        found = H.first_better(H.duplicate_blocks(rows, kind), kind)
        scorer = H.score_photo_pairs if kind == "photo" else H.score_video_pairs
        return scorer(H.with_features(found, rows)).select("kind", "a_id", "b_id", "score", "reason")

    @query(f"k10_duplicate_candidates_{media}", f"{kind}_dup", f"SELECT id, b.score AS score, b.reason AS reason FROM {kind}_dup", near)
    def candidates(c: Catalog) -> DataFrame:
        return H.duplicate_candidates(_media(c, kind), kind, None).select("id", "score", "reason")


for _kind in ("photo", "video"):
    _register(_kind)


_ALL = [
    ("thumbnail_images", _THUMB), ("low_resolution_images", _LOW.format(_paths("photos"))), ("junk_transfer_images", _JUNK),
    ("duplicate_images", "SELECT id, b.score AS score, b.reason AS reason FROM photo_dup"), ("low_resolution_videos", _LOW_VIDEOS),
    ("duplicate_videos", "SELECT id, b.score AS score, b.reason AS reason FROM video_dup"),
]


@query(
    "k11_cleanup_report", "photos videos photo_dup video_dup",
    " UNION ALL ".join(f"SELECT '{name}' AS category, CAST(NULL AS INTEGER) AS rank, id, round(score,6) AS score, reason, count(*) OVER () AS total FROM ({sql})" for name, sql in _ALL),
    {**_keys("photo", "photos"), **_keys("video", "videos"), **_near_views("photo", "photos"), **_near_views("video", "videos")},
)
def report(c: Catalog) -> DataFrame:
    return H.cleanup_report(c.photos_to_clean, c.videos_with_vector)


_SIMPLE = [
    ("thumbnail_images", "photos", _THUMB), ("low_resolution_images", "photos", _LOW.format(_paths("photos"))),
    ("junk_transfer_images", "photos", _JUNK),
]


@query(
    "k11_cleanup_report_simple", "photos",
    " UNION ALL ".join(
        f"SELECT '{name}' AS category, row_number() OVER (ORDER BY p.created_at DESC, id DESC) AS rank, id, k.score, k.reason, k.total FROM (SELECT id, score, reason, total FROM (SELECT h.*, count(*) OVER () AS total FROM ({sql}) h) JOIN photos USING (id){_tail(30)}) k JOIN photos p USING (id)"
        for name, _, sql in _SIMPLE
    ),
)
def simple_report(c: Catalog) -> DataFrame:
    return H.cleanup_report(c.photos, c.videos, [n for n, _, _ in _SIMPLE], 30)
