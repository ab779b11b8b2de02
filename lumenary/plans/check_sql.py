"""The same catalog as DuckDB SQL, for the check queries."""

from __future__ import annotations

# name -> (views it needs, SELECT)
VIEWS: dict[str, tuple[str, str]] = {
    "n": ("", "SELECT count(*) AS n FROM embeddings"),
    "vl": ("", "SELECT vec_id, label AS vlabel, 'face-'||label||'-'||(vec_id%5) AS flabel FROM embeddings"),
    "photos": (
        "n vl",
        """SELECT d.doc_id AS id, d.doc_id%3 AS source_id,
 CASE d.doc_id%3 WHEN 0 THEN 'local_folder' WHEN 1 THEN 'wechat_folder' ELSE 'qq_folder' END AS source_kind,
 d.source AS source_name, '/src/'||d.source||'/'||f.fname AS original_path, '/archive/'||f.fname AS storage_path,
 sha256(d.text) AS sha256, substr(sha1(substr(lower(d.text),1,40)),1,16) AS phash,
 d.text AS caption,
 CASE WHEN d.doc_id%5<>0 THEN d.text END AS ocr_text,
 CASE WHEN d.doc_id%4=0 THEN ['person '||a.vlabel] ELSE []::VARCHAR[] END AS people,
 [d.lang] AS scene_tags,
 list_filter([CASE WHEN l.quality=1 THEN 'quality' END, CASE WHEN l.toxic=1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS object_tags,
 list_filter([a.flabel, b.flabel], lambda x: x IS NOT NULL) AS face_clusters,
 d.doc_id%4 AS face_count, 200+d.doc_id*37%1800 AS width, 150+d.doc_id*53%1200 AS height,
 TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS created_at,
 CASE WHEN d.doc_id%5<>0 THEN TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) - to_hours(d.doc_id%48) END AS taken_at
 FROM documents d CROSS JOIN n
 JOIN (SELECT doc_id, CASE WHEN doc_id%11=0 THEN 'thumb_' ELSE 'img_' END||lpad(CAST(doc_id//2 AS VARCHAR),6,'0')||CASE WHEN doc_id%2=1 THEN ' copy' ELSE '' END||'.jpg' AS fname FROM documents) f ON f.doc_id=d.doc_id
 LEFT JOIN vl a ON a.vec_id = d.doc_id%n.n
 LEFT JOIN vl b ON d.doc_id%3=0 AND b.vec_id = d.doc_id*7%n.n
 LEFT JOIN labels l ON l.doc_id=d.doc_id""",
    ),
    "videos": (
        "n vl",
        """SELECT p.page_id AS id, p.page_id%3 AS source_id,
 CASE p.page_id%3 WHEN 0 THEN 'local_folder' WHEN 1 THEN 'wechat_folder' ELSE 'qq_folder' END AS source_kind,
 regexp_extract(url,'^https?://([^/]*)',1) AS source_name,
 '/vid/'||regexp_replace(regexp_replace(url,'^https?://',''),'[?#].*$','')||'.mp4' AS original_path,
 '/archive/v'||page_id||'.mp4' AS storage_path,
 CASE WHEN page_id%4<>0 THEN '/frames/video-'||page_id||'/thumbnail.jpg' END AS thumbnail_path,
 sha256(CASE WHEN page_id%10=0 THEN regexp_extract(html,'lang="([a-z]*)"',1) ELSE html END) AS sha256, regexp_extract(html,'<title>([^<]*)</title>',1) AS caption,
 CASE WHEN page_id%5<>0 THEN regexp_extract(html,'<h1>([^<]*)</h1>',1) END AS ocr_text,
 CASE WHEN page_id%4=0 THEN ['person '||a.vlabel] ELSE []::VARCHAR[] END AS people,
 [regexp_extract(html,'lang="([a-z]*)"',1)] AS scene_tags,
 CASE WHEN page_id%3=0 THEN ['page'] ELSE []::VARCHAR[] END AS object_tags,
 list_filter([a.flabel, b.flabel], lambda x: x IS NOT NULL) AS face_clusters,
 page_id%4 AS face_count, 1+(length(html)%600)/10 AS duration_seconds,
 320+page_id*41%1600 AS frame_width, 240+page_id*29%840 AS frame_height, 25.0 AS fps, page_id%24 AS sampled_frame_count,
 TIMESTAMP '2024-01-01' + to_minutes(page_id) AS created_at,
 CASE WHEN page_id%5<>0 THEN TIMESTAMP '2024-01-01' + to_minutes(page_id) - to_hours(page_id%48) END AS taken_at
 FROM pages p CROSS JOIN n LEFT JOIN vl a ON a.vec_id = p.page_id%n.n
 LEFT JOIN vl b ON p.page_id%3=0 AND b.vec_id = p.page_id*7%n.n""",
    ),
    "vec": ("", "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"),
    "cmean": (
        "vec",
        """SELECT label, b, min(first) AS first, list(m ORDER BY pos) AS m FROM (
 SELECT label, vec_id%5 AS b, pos, avg(e[pos]) AS m, min(vec_id) AS first FROM vec, range(1,65) r(pos) GROUP BY ALL) GROUP BY label, b""",
    ),
    "clusters": (
        "cmean",
        """SELECT label*5+b+1 AS id, 'face-'||label||'-'||b AS label,
 CASE WHEN b%2=1 THEN NULL WHEN b=0 THEN 'Person '||label ELSE 'Group '||label||'-'||b END AS display_name,
 list_transform(m, lambda x: x/sqrt(list_dot_product(m,m))) AS centroid,
 CASE WHEN b<2 THEN label+1 END AS person_profile_id,
 CASE WHEN b=3 THEN first+1000000000 WHEN b<>4 THEN first END AS example_photo_id,
 TIMESTAMP '2024-01-01' + to_hours(label*5+b+1) AS created_at,
 TIMESTAMP '2024-01-01' + to_hours((label*5+b+1)*7%50) AS updated_at FROM cmean""",
    ),
    "samples": (
        "vec",
        """SELECT vec_id AS id, label+1 AS person_id, 'sample_'||vec_id||'.jpg' AS original_filename, e AS embedding,
 TIMESTAMP '2024-01-01' + to_minutes(vec_id) AS created_at FROM vec WHERE vec_id%10<3""",
    ),
    "pmean": (
        "samples",
        """SELECT person_id, list(m ORDER BY pos) AS m FROM (
 SELECT person_id, pos, avg(embedding[pos]) AS m FROM samples, range(1,65) r(pos) GROUP BY ALL) GROUP BY person_id""",
    ),
    "persons": (
        "pmean samples",
        """SELECT l.label+1 AS id, 'Person '||l.label AS name, 'person '||l.label AS normalized_name,
 list_transform(p.m, lambda x: round(x/sqrt(list_dot_product(p.m,p.m)),6)) AS centroid,
 s.last AS example_sample_id, coalesce(s.n,0) AS sample_count,
 TIMESTAMP '2024-01-01' + to_hours(l.label) AS created_at, TIMESTAMP '2024-01-01' + to_hours(l.label*3%7) AS updated_at
 FROM (SELECT DISTINCT label FROM embeddings) l LEFT JOIN pmean p ON p.person_id=l.label+1
 LEFT JOIN (SELECT person_id, count(*) AS n, max_by(id, struct_pack(a:=created_at, b:=id)) AS last FROM samples GROUP BY 1) s ON s.person_id=l.label+1""",
    ),
    "faces": (
        "vec",
        """SELECT vec_id AS face_id, vec_id//4 AS media_id, vec_id//10 AS video_id, vec_id AS seq, (vec_id%10)*0.5 AS frame_t,
 vec_id*37%560 AS x1, vec_id*53%400 AS y1, vec_id*37%560+20+vec_id*11%100 AS x2, vec_id*53%400+20+vec_id*13%90 AS y2,
 CAST(0.30 AS DOUBLE)+(vec_id%70)/100 AS det_score, 640 AS image_width, 480 AS image_height, e AS embedding FROM vec""",
    ),
    "face_cluster": (
        "faces clusters",
        "SELECT face_id, label, s AS score FROM (SELECT face_id, c.label, round(list_cosine_similarity(f.embedding, c.centroid),6) AS s, row_number() OVER (PARTITION BY face_id ORDER BY round(list_cosine_similarity(f.embedding, c.centroid),6) DESC, c.updated_at DESC, c.label DESC) AS r FROM faces f, clusters c) WHERE r=1 AND s>=0.30",
    ),
    # person scores of every face and of every cluster
    "face_sample": (
        "faces samples",
        """SELECT face_id, person_id, list(s ORDER BY s DESC)[1:3] AS t FROM (
 SELECT f.face_id, s.person_id, list_cosine_similarity(f.embedding, s.embedding) AS s FROM faces f, samples s) GROUP BY ALL""",
    ),
    "face_person": (
        "face_sample faces persons",
        """SELECT face_id, person_id, name, updated_at, score FROM (SELECT f.face_id, p.id AS person_id, p.name, p.updated_at,
 round(CASE WHEN t.t IS NULL THEN c ELSE greatest(c, 0.45*t.t[1]+0.35*list_avg(t.t)+0.2*c) END, 6) AS score
 FROM (SELECT f.face_id, p.id, p.name, p.updated_at, coalesce(list_cosine_similarity(f.embedding, p.centroid),0) AS c FROM faces f, persons p) f
 JOIN persons p ON p.id=f.id LEFT JOIN face_sample t ON t.face_id=f.face_id AND t.person_id=p.id)""",
    ),
    "face_rank": (
        "face_person",
        "SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY score DESC, updated_at DESC, person_id DESC) AS r FROM face_person WHERE score>0",
    ),
    "face_match": (
        "face_rank",
        """SELECT a.face_id, a.person_id, a.name, a.score, coalesce(b.score,0) AS second FROM face_rank a
 LEFT JOIN face_rank b ON b.face_id=a.face_id AND b.r=2 WHERE a.r=1""",
    ),
    "clus_sample": (
        "clusters samples",
        """SELECT label, person_id, list(s ORDER BY s DESC)[1:3] AS t FROM (
 SELECT c.label, s.person_id, list_cosine_similarity(c.centroid, s.embedding) AS s FROM clusters c, samples s) GROUP BY ALL""",
    ),
    "clus_person": (
        "clus_sample clusters persons",
        """SELECT f.label, p.id AS person_id, p.name, p.updated_at,
 round(CASE WHEN t.t IS NULL THEN c ELSE greatest(c, 0.45*t.t[1]+0.35*list_avg(t.t)+0.2*c) END, 6) AS score
 FROM (SELECT c.label, p.id, coalesce(list_cosine_similarity(c.centroid, p.centroid),0) AS c FROM clusters c, persons p) f
 JOIN persons p ON p.id=f.id LEFT JOIN clus_sample t ON t.label=f.label AND t.person_id=p.id""",
    ),
    "clus_rank": (
        "clus_person",
        "SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, updated_at DESC, person_id DESC) AS r FROM clus_person WHERE score>0",
    ),
    "sources": (
        "",
        """SELECT id, 'source '||id AS name, ['local_folder','wechat_folder','qq_folder'][id+1] AS kind,
 ['/src','/src/source_1','/archive/in'][id+1] AS root_path, id<>1 AS enabled, TIMESTAMP '2024-01-01' + to_days(CAST(id AS INTEGER)) AS created_at
 FROM (SELECT DISTINCT doc_id%3 AS id FROM documents)""",
    ),
    "ev": ("", "SELECT *, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events"),
    "watch_events": (
        "ev",
        """SELECT user_id%5+1 AS source_id, '/src/'||k||CASE WHEN k%10=9 THEN '.txt' ELSE '.jpg' END AS src_path,
 CASE WHEN event_type='signup' THEN '/src/m'||k||'.jpg' END AS dest_path, event_type AS event_kind, k%17=0 AS is_directory, ts FROM ev""",
    ),
    "normal_events": (
        "watch_events",
        "SELECT source_id, coalesce(dest_path,src_path) AS path, ts FROM watch_events WHERE NOT is_directory AND coalesce(dest_path,src_path) LIKE '%.jpg'",
    ),
    "import_jobs": (
        "ev",
        """SELECT source_id*1000+dayofyear(day) AS id, source_id, CASE WHEN errors*4>scanned_count THEN 'failed' ELSE 'completed' END AS status,
 scanned_count, imported_count, scanned_count-imported_count AS duplicate_count, day AS created_at FROM (
 SELECT user_id%5+1 AS source_id, date_trunc('day',ts) AS day, count(*) AS scanned_count, count(DISTINCT k) AS imported_count,
 count(*) FILTER (event_type='error') AS errors FROM ev GROUP BY ALL)""",
    ),
    "tasks": (
        "ev",
        """SELECT event_type AS task_type, ['queued','running','completed','failed'][dayofyear(day)%4+1] AS status,
 completed_items+failed_items+dayofyear(day)%2 AS total_items, completed_items, failed_items, day AS created_at FROM (
 SELECT event_type, date_trunc('day',ts) AS day, count(*) FILTER (value>=50) AS completed_items, count(*) FILTER (value<50) AS failed_items FROM ev GROUP BY ALL)""",
    ),
    "moments": (
        "ev",
        """SELECT user_id AS video_id, event_type AS person_name,
 round((epoch_us(ts)-epoch_us(min(ts) OVER (PARTITION BY user_id)))/3600000000.0::DOUBLE, 3) AS timestamp_seconds,
 least(round(value/100,4),1.0) AS score, event_id AS seq FROM ev""",
    ),
    # names per label and enriched media
    "label_names": (
        "clusters persons",
        "SELECT c.label, c.display_name, p.name AS person_name, p.id AS person_id FROM clusters c LEFT JOIN persons p ON p.id=c.person_profile_id",
    ),
}

for _kind in ("photo", "video"):
    VIEWS[f"{_kind}_names"] = (
        f"{_kind}s label_names",
        f"""SELECT id, list(name ORDER BY first) AS face_names FROM (SELECT id, name, min(place) AS first FROM (
 SELECT m.id, u.i AS place, l.display_name AS name FROM {_kind}s m, range(1,3) u(i), label_names l WHERE l.label=m.face_clusters[u.i]
 UNION ALL SELECT m.id, 100+u.i, l.person_name FROM {_kind}s m, range(1,3) u(i), label_names l WHERE l.label=m.face_clusters[u.i])
 WHERE name IS NOT NULL GROUP BY id, name) GROUP BY id""",
    )
    VIEWS[f"rich_{_kind}s"] = (
        f"{_kind}s {_kind}_names",
        f"""SELECT m.* EXCLUDE (people), coalesce(n.face_names, []) AS face_names, m.people AS stored_people,
 list_concat(m.people, list_filter(coalesce(n.face_names, []), lambda x: NOT list_contains(m.people, x))) AS people
 FROM {_kind}s m LEFT JOIN {_kind}_names n ON n.id=m.id""",
    )

TOKENS = (
    "flatten(list_transform(regexp_extract_all(lower({0}), '[a-zA-Z0-9_]+|[一-鿿]+'), lambda r: CASE WHEN regexp_matches(r, '[一-鿿]')"
    " THEN list_concat([r], list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) ELSE [r] END))"
)


def text_vectors(source: str, key: str, text: str) -> str:
    """SELECT key, v: unit signed-hash vector of 128 entries per row that has tokens."""
    return f"""SELECT {key}, list(coalesce(w,0) ORDER BY pos) AS v FROM (
 SELECT k.{key}, p.pos, h.w/k.norm AS w FROM
 (SELECT {key}, sqrt(sum(w*w)) AS norm FROM (SELECT {key}, idx, sum(w) AS w FROM (
   SELECT {key}, ('0x'||substr(sha1(t),1,8))::BIGINT%128 AS idx,
   (CASE WHEN ('0x'||substr(sha1(t),9,2))::BIGINT%2=0 THEN 1 ELSE -1 END)*(CAST(1 AS DOUBLE)+least(length(t),10)/10) AS w
   FROM (SELECT {key}, unnest({TOKENS.format(text)}) AS t FROM {source})) GROUP BY ALL) GROUP BY ALL) k
 CROSS JOIN range(0,128) p(pos)
 LEFT JOIN (SELECT {key}, idx, sum(w) AS w FROM (
   SELECT {key}, ('0x'||substr(sha1(t),1,8))::BIGINT%128 AS idx,
   (CASE WHEN ('0x'||substr(sha1(t),9,2))::BIGINT%2=0 THEN 1 ELSE -1 END)*(CAST(1 AS DOUBLE)+least(length(t),10)/10) AS w
   FROM (SELECT {key}, unnest({TOKENS.format(text)}) AS t FROM {source})) GROUP BY ALL) h ON h.{key}=k.{key} AND h.idx=p.pos
 WHERE k.norm>0) GROUP BY {key}"""


PHOTO_TEXT = (
    "coalesce(caption,'')||chr(10)||coalesce(ocr_text,'')||chr(10)||array_to_string(people,' ')||chr(10)||"
    "array_to_string(scene_tags,' ')||chr(10)||array_to_string(object_tags,' ')||chr(10)||"
    "regexp_replace(regexp_replace(storage_path,'^.*/',''),'\\.[^.]+$','')"
)
VIEWS["photo_vec"] = ("photos", text_vectors("photos", "id", PHOTO_TEXT))


def ratio_sql(pairs: str) -> str:
    """(x, y, ratio) of different texts: twice the letters of matching blocks over all letters.

    The longest common stretch that starts first in x, then in y, is matched; then the texts before and behind it are.
    """
    return f"""SELECT x, y, 2.0::DOUBLE*coalesce(sum(got),0)/(len(x)+len(y)) AS ratio FROM (WITH RECURSIVE m AS (SELECT x, y, x AS s, y AS t, 0 AS got, 0 AS step FROM {pairs}
 UNION ALL SELECT x, y, unnest([substr(s,1,i-1), substr(s,i+l)]), unnest([substr(t,1,j-1), substr(t,j+l)]), unnest([l, 0]), step+1 FROM (
 SELECT x, y, s, t, step, b.l, -b.i AS i, strpos(t, b.p) AS j FROM (SELECT x, y, s, t, step, list_max(list_filter(flatten(list_transform(range(1,len(s)+1), lambda i: list_transform(range(1,len(s)-i+2),
 lambda l: struct_pack(l:=l, i:=-i, p:=substr(s,i,l))))), lambda e: contains(t, e.p))) AS b FROM m WHERE len(s)>0 AND len(t)>0) WHERE b IS NOT NULL)) SELECT x, y, got FROM m) GROUP BY x, y"""


def with_views(names: str, body: str, extra: dict[str, tuple[str, str]] | None = None) -> str:
    """Body preceded by the views it needs, each after those it is built on."""
    known = {**VIEWS, **(extra or {})}
    done: list[str] = []

    def need(name: str) -> None:
        if name in done:
            return
        for other in known[name][0].split():
            need(other)
        done.append(name)

    for name in names.split():
        need(name)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n][1]})" for n in done) + "\n" + body


def flat(v: str, digits: int = 4) -> str:
    return f"array_to_string(list_transform({v}, lambda x: printf('%.{digits}f', round(x,{digits})+0.0)),',')"


def piped(v: str) -> str:
    return f"array_to_string({v},'|')"


def stamp(ts: str) -> str:
    return f"strftime({ts},'%Y-%m-%d %H:%M:%S')"
