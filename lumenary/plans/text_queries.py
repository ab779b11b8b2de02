"""Token, tag and name queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.functions import text as X
from lumenary.operators import annotations as A
from lumenary.operators import search as S
from lumenary.plans.catalog import Catalog, flat_vector, piped
from lumenary.plans.check_sql import TOKENS, text_vectors
from lumenary.plans.check_sql import flat as sql_flat
from lumenary.plans.check_sql import piped as sql_piped
from lumenary.plans.registry import query

_GENERIC = "(" + ",".join(f"'{w}'" for w in X.GENERIC_WORDS) + ")"
_COPY = "^(copy|副本)[0-9]*$"


@query("t1_tokenize_text", sql=f"SELECT doc_id, {sql_piped(TOKENS.format('text'))} AS tokens FROM documents")
def tokenize(c: Catalog) -> DataFrame:
    return c.texts("documents").select("doc_id", piped(X.tokenize(F.col("text"))).alias("tokens"))


@query(
    "t2_text_hash_vector", "tv",
    f"SELECT doc_id, {sql_flat('v')} AS vector FROM tv", {"tv": ("", text_vectors("documents", "doc_id", "text"))},
)
def text_hash(c: Catalog) -> DataFrame:
    return c.texts("documents").select("doc_id", flat_vector(X.text_added_vector(F.col("text"))).alias("vector"))


@query(
    "t3_normalize_name",
    sql=r"SELECT conv_id, turn, lower(trim(regexp_replace(role||'  '||text, '\s+', ' ', 'g'))) AS name_key FROM conversations",
)
def normalize(c: Catalog) -> DataFrame:
    raw = F.concat("role", F.lit("  "), "text")
    return c.texts("conversations").select("conv_id", "turn", X.normalize_name(raw).alias("name_key"))


# the given texts hold no CJK, so some is added on both sides
_MIXED_SQL = "text||CASE doc_id%3 WHEN 0 THEN ' 海边日落photo图 2024年' WHEN 1 THEN '，去旅行 一' ELSE '' END"


def _mixed() -> Column:
    kind = F.col("doc_id") % 3
    return F.concat("text", F.when(kind == 0, " 海边日落photo图 2024年").when(kind == 1, "，去旅行 一").otherwise(""))


@query("t1_tokenize_cjk", sql=f"SELECT doc_id, {sql_piped(TOKENS.format(_MIXED_SQL))} AS tokens FROM documents")
def tokenize_cjk(c: Catalog) -> DataFrame:
    return c.texts("documents").select("doc_id", piped(X.tokenize(_mixed())).alias("tokens"))


@query(
    "t2_text_hash_vector_cjk", "tv",
    f"SELECT doc_id, {sql_flat('v')} AS vector FROM tv", {"tv": ("", text_vectors("documents", "doc_id", _MIXED_SQL))},
)
def text_hash_cjk(c: Catalog) -> DataFrame:
    return c.texts("documents").select("doc_id", flat_vector(X.text_added_vector(_mixed())).alias("vector"))


NAME_KEY_SQL = f"""SELECT id, array_to_string((CASE WHEN len(named)>0 THEN named ELSE uncopied END)[1:6],' ') AS name_key FROM (
 SELECT id, uncopied, list_filter(uncopied, lambda t: NOT list_contains({_GENERIC.replace('(', '[').replace(')', ']')}, t)) AS named FROM (
 SELECT id, list_filter(toks[1:greatest(1, list_max(list_concat([1], list_transform(range(1,len(toks)+1), lambda i: CASE WHEN regexp_matches(toks[i],'^[0-9]+$') OR regexp_matches(toks[i],'{_COPY}') THEN 1 ELSE i END))))],
 lambda t: NOT regexp_matches(t,'{_COPY}')) AS uncopied FROM (
 SELECT id, regexp_extract_all(regexp_replace(lower(regexp_replace(regexp_replace(original_path,'^.*/',''),'^(.+)\\.[^.]+$','\\1')),'[_\\-\\(\\)\\[\\]{{}}]+',' ','g'),'[a-zA-Z0-9_]+') AS toks FROM """


@query("t4_media_name_key_photos", "photos", NAME_KEY_SQL + "photos)))")
def photo_name_key(c: Catalog) -> DataFrame:
    return c.photos.select("id", X.media_name_key(F.col("original_path")).alias("name_key"))


@query("t4_media_name_key_videos", "videos", NAME_KEY_SQL + "videos)))")
def video_name_key(c: Catalog) -> DataFrame:
    return c.videos.select("id", X.media_name_key(F.col("original_path")).alias("name_key"))


CAPTION_KEY_SQL = (
    f"SELECT id, array_to_string(list_filter({TOKENS.format('caption')}, lambda t: NOT regexp_matches(t,'^[0-9]+$') AND t NOT IN {_GENERIC} AND length(t)>1)[1:6],' ') AS caption_key FROM {{0}}"
)


@query("t5_caption_key", "photos", CAPTION_KEY_SQL.format("photos"))
def caption_key(c: Catalog) -> DataFrame:
    return c.photos.select("id", X.caption_key(F.col("caption")).alias("caption_key"))


def _sorted_hits(words: tuple[str, ...]) -> str:
    listed = "[" + ",".join(f"'{w}'" for w in sorted(words)) + "]"
    return f"list_filter({listed}, lambda w: list_contains(toks, w))"


@query(
    "t6_rule_annotations", "",
    f"""SELECT doc_id AS id, 'Imported from '||kind||CASE WHEN len(toks)>0 THEN ': '||array_to_string(toks[1:6],' ') ELSE '' END AS caption,
 replace(stem,'_',' ') AS ocr_text, {sql_piped(_sorted_hits(X.SCENE_WORDS))} AS scene_tags, {sql_piped(_sorted_hits(X.OBJECT_WORDS))} AS object_tags
 FROM (SELECT doc_id, kind, stem, list_filter(regexp_split_to_array(lower(stem),'[_\\-\\s]+'), lambda t: length(t)>0) AS toks FROM (
 SELECT doc_id, CASE doc_id%3 WHEN 0 THEN 'local_folder' WHEN 1 THEN 'wechat_folder' ELSE 'qq_folder' END AS kind,
 ['beach','cat','office_dog','Car-Sunset','notes','book book'][doc_id%6+1]||'_'||lang||'-'||doc_id AS stem FROM documents))""",
)
def rule_annotations(c: Catalog) -> DataFrame:
    doc = F.col("doc_id")
    kinds = F.array(*map(F.lit, ("local_folder", "wechat_folder", "qq_folder")))
    words = F.array(*map(F.lit, ("beach", "cat", "office_dog", "Car-Sunset", "notes", "book book")))
    files = c.texts("documents").select(
        doc.alias("id"),
        F.element_at(kinds, (doc % 3 + 1).cast("int")).alias("source_kind"),
        F.concat(F.lit("/in/"), F.element_at(words, (doc % 6 + 1).cast("int")), F.lit("_"), "lang", F.lit("-"), doc, F.lit(".jpg")).alias("storage_path"),
    )
    return A.rule_annotations(files).select(
        "id", "caption", "ocr_text", piped(F.col("scene_tags")).alias("scene_tags"), piped(F.col("object_tags")).alias("object_tags")
    )


def _distinct_sql(items: str) -> str:
    stripped = f"list_transform({items}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"
    low = f"list_transform({stripped}, lambda x: lower(x))"
    return f"array_to_string(list_filter({stripped}, lambda w, i: w<>'' AND list_position({low}, lower(w))=i),'|')"


_ANSWERS = "role||', '||upper(role)||', '||text"


@query(
    "t7_parse_annotations", "",
    f"""SELECT media_id, nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') AS caption, {_distinct_sql(f"regexp_split_to_array({_ANSWERS}, '[,\\n，、/]+')")} AS people,
 {_distinct_sql("string_split(text, ' ')")} AS scene_tags, role AS object_tags FROM (SELECT conv_id*100+turn AS media_id, role, text FROM conversations) WHERE media_id%7<>0""",
)
def parse_annotations(c: Catalog) -> DataFrame:
    parsed = A.parse_annotations(annotation_responses(c))
    return parsed.select(
        "media_id", "caption", *[piped(F.col(x)).alias(x) for x in ("people", "scene_tags", "object_tags")]
    )


def annotation_responses(c: Catalog) -> DataFrame:
    """Chat-completion payloads made of conversation turns: plain, fenced or cut short."""
    t = c.texts("conversations").withColumn("media_id", F.col("conv_id") * 100 + F.col("turn"))
    body = F.to_json(
        F.struct(
            F.col("text").alias("caption"),
            F.concat_ws(", ", F.col("role"), F.upper("role"), F.col("text")).alias("people"),
            F.split("text", " ").alias("scene_tags"),
            F.col("role").alias("object_tags"),
        )
    )
    kind = F.col("media_id") % 7
    said = (
        F.when(kind == 0, F.substring(body, 1, 20))
        .when(kind % 3 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Result "), body, F.lit(" end")))
    )
    message = F.to_json(F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices")))
    return t.select("media_id", message.alias("payload_json"))


@query(
    "t8_dedupe_ci", "",
    """SELECT doc_id, string_agg(w, '|' ORDER BY pos) AS items FROM (SELECT doc_id, arg_min(w,pos) AS w, min(pos) AS pos FROM (
 SELECT doc_id, trim(ws[i]) AS w, i AS pos FROM (SELECT doc_id, string_split(text,' ') AS ws FROM documents), range(1, (SELECT max(len(string_split(text,' ')))+1 FROM documents)) r(i) WHERE i<=len(ws)) WHERE w<>'' GROUP BY doc_id, lower(w)) GROUP BY doc_id""",
)
def dedupe(c: Catalog) -> DataFrame:
    # a text has a word where more than blanks is left of it; a filter on the words would find them twice
    worded = c.texts("documents").filter(F.trim("text") != "")
    return worded.select("doc_id", piped(X.dedupe_ci(F.split("text", " "))).alias("items"))


_MERGE_SQL = """SELECT id, CASE WHEN coalesce(model_caption,'')<>'' THEN model_caption WHEN trim(coalesce(caption,''))<>'' THEN trim(caption) ELSE 'Imported from '||source_kind END AS caption,
 ocr, array_to_string(list_concat(tags, CASE WHEN q IS NOT NULL AND NOT list_contains(list_transform(tags, lambda x: lower(x)), lower(q)) THEN [q] ELSE [] END),'|') AS scene_tags FROM (
 SELECT p.id, p.source_kind, p.caption, CASE WHEN trim(coalesce(p.ocr_text,''), ' '||chr(10)||chr(9)||chr(13))='' THEN NULL ELSE 1 END AS ocr, p.scene_tags AS tags,
 CASE WHEN p.id%3=0 THEN 'model '||p.id END AS model_caption, CASE WHEN p.id%3=0 THEN 'EN' END AS q FROM photos p)"""


@query("t9_merge_annotations", "photos", _MERGE_SQL)
def merge_annotations(c: Catalog) -> DataFrame:
    model = c.photos.filter(F.col("id") % 3 == 0).select(
        "id", F.concat(F.lit("model "), "id").alias("caption"), X.empty_strings().alias("people"),
        F.array(F.lit("EN")).alias("scene_tags"), X.empty_strings().alias("object_tags"),
    )
    merged = A.merge_annotations(c.photos, model)
    return merged.select(
        "id", "caption", F.when(F.col("ocr_text").isNotNull(), 1).alias("ocr"), piped(F.col("scene_tags")).alias("scene_tags")
    )


@query(
    "t10_assemble_ocr", "",
    """SELECT media_id, sha256(string_agg(t, chr(10) ORDER BY f)) AS ocr_sha256 FROM (SELECT media_id, arg_min(t, f) AS t, min(f) AS f FROM (
 SELECT media_id, f, string_agg(line, chr(10) ORDER BY i) AS t FROM (SELECT doc_id AS media_id, (i-1)%8 AS f, i, regexp_replace(ls[i], '^\\s+|\\s+$', '', 'g') AS line
 FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(1, (SELECT max(len(string_split(text, chr(10))))+1 FROM documents)) r(i) WHERE i<=len(ls))
 WHERE line<>'' AND f<6 GROUP BY ALL) GROUP BY media_id, lower(t)) GROUP BY media_id""",
)
def assemble_ocr(c: Catalog) -> DataFrame:
    lines = c.texts("documents").select(
        F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text")
    ).withColumn("frame_idx", F.col("line_no") % 8)
    return A.assemble_frame_ocr(lines).select("media_id", F.sha2("ocr_text", 256).alias("ocr_sha256"))



@query(
    "t11_detect_people", "persons",
    """SELECT c.conv_id, c.turn, coalesce(string_agg(p.name,'|' ORDER BY p.updated_at DESC, p.id DESC),'') AS names
 FROM (SELECT conv_id, turn, lower(trim('look for person '||(conv_id%13)||' and Person '||(turn%10)||' '||text)) AS q FROM conversations) c
 JOIN persons p ON contains(c.q, p.normalized_name) GROUP BY ALL""",
)
def detect_people(c: Catalog) -> DataFrame:
    asked = c.texts("conversations").select(
        F.struct("conv_id", "turn").alias("query_id"),
        F.concat(
            F.lit("look for person "), F.col("conv_id") % 13, F.lit(" and Person "), F.col("turn") % 10, F.lit(" "),
            F.col("text"),
        ).alias("text"),
    )
    found = S.detect_people(asked, c.persons)
    return found.select("query_id.conv_id", "query_id.turn", piped(F.col("names")).alias("names"))


@query(
    "t12_parse_tags", "",
    """SELECT doc_id, string_agg(w,'|' ORDER BY pos) AS tags FROM (SELECT doc_id, w, min(i) AS pos FROM (
 SELECT doc_id, i, trim(ws[i], ' '||chr(9)||chr(13)) AS w FROM (SELECT doc_id, regexp_split_to_array(text,'[,\\n，]') AS ws FROM documents), range(1, (SELECT max(len(regexp_split_to_array(text,'[,\\n，]')))+1 FROM documents)) r(i) WHERE i<=len(ws)) WHERE w<>'' GROUP BY doc_id, w) GROUP BY doc_id""",
)
def parse_tags(c: Catalog) -> DataFrame:
    out = c.texts("documents").select("doc_id", X.parse_tags(F.col("text")).alias("t"))
    return out.filter(F.size("t") > 0).select("doc_id", piped(F.col("t")).alias("tags"))


@query(
    "t13_format_duration", "",
    """SELECT event_id, CASE WHEN value<=0 THEN '00:00' WHEN s>=3600 THEN printf('%02d:%02d:%02d', s//3600, s%3600//60, s%60)
 ELSE printf('%02d:%02d', s//60, s%60) END AS clock FROM (SELECT event_id, value, CAST(floor(value*60) AS BIGINT) AS s FROM events)""",
)
def duration(c: Catalog) -> DataFrame:
    return c.table("events").select("event_id", X.format_duration(F.col("value") * 60).alias("clock"))


@query(
    "t14_job_progress", "import_jobs",
    """SELECT id, CASE WHEN scanned_count<=0 THEN CASE WHEN status='completed' THEN 100 ELSE 0 END
 ELSE least(100, CAST(floor((imported_count+duplicate_count)*100.0::DOUBLE/scanned_count+0.5) AS BIGINT)) END AS progress FROM import_jobs""",
)
def job_progress(c: Catalog) -> DataFrame:
    return c.import_jobs.select("id", X.job_progress().alias("progress"))


@query(
    "t14_task_progress", "tasks",
    """SELECT task_type, strftime(created_at,'%Y-%m-%d') AS day, CASE WHEN total_items<=0 THEN CASE WHEN status='completed' THEN 100 ELSE 0 END
 ELSE least(100, CAST(floor((completed_items+failed_items)*100.0::DOUBLE/total_items+0.5) AS BIGINT)) END AS progress FROM tasks""",
)
def task_progress(c: Catalog) -> DataFrame:
    return c.tasks.select("task_type", F.date_format("created_at", "yyyy-MM-dd").alias("day"), X.task_progress().alias("progress"))
