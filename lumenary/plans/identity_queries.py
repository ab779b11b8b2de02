"""Cluster and person queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.functions.blockmatch import Side
from lumenary.operators import corrections as C
from lumenary.operators import identity as I
from lumenary.operators import listing as L
from lumenary.plans.catalog import DIM, THR, Catalog, flat_vector, piped
from lumenary.plans.check_sql import PHOTO_TEXT, flat, text_vectors
from lumenary.plans.check_sql import piped as sql_piped
from lumenary.plans.listing_queries import VIEW_SQL
from lumenary.plans.registry import query

MARGIN = 0.02


def assigned(c: Catalog) -> DataFrame:
    return I.assign_clusters(c.faces, c.clusters, THR, DIM)


def matches(c: Catalog, top: DataFrame | None = None) -> DataFrame:
    return I.match_persons(Side(c.faces, "face_id", "embedding"), c.persons, c.samples, THR, MARGIN, DIM, top)


@query("c1_assign_clusters", "face_cluster", "SELECT face_id, label, score FROM face_cluster")
def assign(c: Catalog) -> DataFrame:
    return assigned(c)


# what large tables take: no side is fetched, blocks meet in pairs
BLOCKS = {"broadcast_rows": 0, "block_rows": 256}


@query("c1_assign_clusters_in_blocks", "face_cluster", "SELECT face_id, label, score FROM face_cluster")
def assign_in_blocks(c: Catalog) -> DataFrame:
    return I.assign_clusters(c.faces, c.clusters, THR, DIM, **BLOCKS)


_LINKS = {
    "lonely": ("faces face_cluster", "SELECT face_id, embedding FROM faces WHERE face_id NOT IN (SELECT face_id FROM face_cluster)"),
    "linked": ("lonely", "SELECT a.face_id AS a, b.face_id AS b FROM lonely a, lonely b WHERE a.face_id<>b.face_id AND round(list_cosine_similarity(a.embedding,b.embedding),6)>=0.30"),
}


_FORMED = """SELECT l.face_id, least(l.face_id, coalesce(r.root, l.face_id)) AS root, 'face-'||substr(sha1(CAST(least(l.face_id, coalesce(r.root, l.face_id)) AS VARCHAR)),1,32) AS label
 FROM lonely l LEFT JOIN (WITH RECURSIVE reach AS (SELECT a, b FROM linked UNION SELECT r.a, k.b FROM reach r JOIN linked k ON k.a=r.b) SELECT a, min(b) AS root FROM reach GROUP BY a) r ON r.a=l.face_id"""


@query("c2_form_clusters", "lonely linked", _FORMED, _LINKS)
def form(c: Catalog) -> DataFrame:
    lonely = c.faces.join(assigned(c).select("face_id"), "face_id", "left_anti")
    return I.form_clusters(lonely, THR, DIM)


@query("c2_form_clusters_in_blocks", "lonely linked", _FORMED, _LINKS)
def form_in_blocks(c: Catalog) -> DataFrame:
    lonely = c.faces.join(assigned(c).select("face_id"), "face_id", "left_anti")
    return I.form_clusters(lonely, THR, DIM, block_rows=64)


_FOLD = """SELECT label, {0} AS centroid, folded FROM (SELECT c.label, len(f.es) AS folded, list_reduce(f.es, lambda acc, e:
 list_transform(range(1,65), lambda i: round((0.7::DOUBLE*acc[i]+0.3::DOUBLE*e[i])/sqrt(0.49::DOUBLE*list_dot_product(acc,acc)+0.42::DOUBLE*list_dot_product(acc,e)+0.09::DOUBLE*list_dot_product(e,e)),6)), c.centroid) AS centroid
 FROM clusters c JOIN (SELECT a.label, list(f.embedding ORDER BY f.seq) AS es FROM face_cluster a JOIN faces f ON f.face_id=a.face_id GROUP BY a.label) f ON f.label=c.label)"""


@query("c3_update_centroids", "face_cluster clusters faces", _FOLD.format(flat("centroid", 6)))
def fold(c: Catalog) -> DataFrame:
    rows = assigned(c).join(c.faces.select("face_id", "media_id", "seq", "embedding"), "face_id")
    out = I.update_centroids(c.clusters, rows).filter("folded > 0")
    return out.select("label", flat_vector(F.col("centroid"), 6).alias("centroid"), "folded")


@query("c4_rank_persons", "face_rank", "SELECT face_id, person_id, score, r AS rank FROM face_rank WHERE r<=5")
def rank(c: Catalog) -> DataFrame:
    return I.rank_persons(Side(c.faces, "face_id", "embedding"), c.persons, c.samples, 5, DIM)


@query("c4_rank_persons_in_blocks", "face_rank", "SELECT face_id, person_id, score, r AS rank FROM face_rank WHERE r<=5")
def rank_in_blocks(c: Catalog) -> DataFrame:
    return I.rank_persons(Side(c.faces, "face_id", "embedding"), c.persons, c.samples, 5, DIM, **BLOCKS)


@query(
    "c5_match_persons", "face_match",
    "SELECT face_id, person_id, score FROM face_match WHERE score>=0.30 AND (second<=0 OR round(score-second,6)>=0.02)",
)
def match(c: Catalog) -> DataFrame:
    return matches(c)


_SUMMARY = {
    "frow": (
        "faces face_cluster face_match clusters",
        """SELECT f.face_id, f.media_id, f.seq, a.label, m.person_id, m.name AS match_name,
 CASE WHEN m.name IS NOT NULL AND lower(coalesce(c.display_name,''))<>lower(m.name) THEN m.name ELSE c.display_name END AS shown
 FROM faces f LEFT JOIN face_cluster a ON a.face_id=f.face_id LEFT JOIN clusters c ON c.label=a.label
 LEFT JOIN (SELECT * FROM face_match WHERE score>=0.30 AND (second<=0 OR round(score-second,6)>=0.02)) m ON m.face_id=f.face_id""",
    ),
    "fnames": (
        "frow",
        """SELECT media_id, string_agg(name,'|' ORDER BY p) AS names FROM (SELECT media_id, name, min(p) AS p FROM (SELECT media_id, shown AS name, seq*2 AS p FROM frow
 UNION ALL SELECT media_id, match_name, seq*2+1 FROM frow) WHERE name IS NOT NULL GROUP BY ALL) GROUP BY media_id""",
    ),
    "flabels": (
        "frow",
        "SELECT media_id, string_agg(label,'|' ORDER BY p) AS labels FROM (SELECT media_id, label, min(seq) AS p FROM frow WHERE label IS NOT NULL GROUP BY ALL) GROUP BY media_id",
    ),
    "fcount": ("frow", "SELECT media_id, count(*) AS face_count FROM frow GROUP BY media_id"),
}


@query(
    "c6_summarise_faces", "fcount fnames flabels",
    """SELECT c.media_id, coalesce(l.labels,'') AS labels, coalesce(n.names,'') AS names, c.face_count FROM fcount c
 LEFT JOIN fnames n ON n.media_id=c.media_id LEFT JOIN flabels l ON l.media_id=c.media_id""", _SUMMARY,
)
def summarise(c: Catalog) -> DataFrame:
    media, _ = I.summarise_faces(c.faces, assigned(c), matches(c), c.clusters, c.persons)
    return media.select("media_id", piped(F.col("labels")).alias("labels"), piped(F.col("names")).alias("names"), "face_count")


@query(
    "c6_cluster_changes", "frow",
    "SELECT label, arg_max(person_id, seq) AS person_profile_id, arg_max(shown, seq) AS display_name FROM frow WHERE label IS NOT NULL AND person_id IS NOT NULL GROUP BY label",
    _SUMMARY,
)
def changes(c: Catalog) -> DataFrame:
    return I.summarise_faces(c.faces, assigned(c), matches(c), c.clusters, c.persons)[1]


@query(
    "c7_resolve_labels", "rich_photos",
    f"SELECT id, {sql_piped('face_clusters')} AS labels, {sql_piped('face_names')} AS names, len(face_clusters) AS face_count FROM rich_photos",
)
def resolve(c: Catalog) -> DataFrame:
    rows = I.resolve_labels(c.photos, c.clusters, c.persons)
    return rows.select("id", piped(F.col("labels")).alias("labels"), piped(F.col("names")).alias("names"), "face_count")


_ASSOCIATE_THR = 0.45
_ASSOCIATE = {
    "assoc": (
        "clusters clus_person clus_rank persons",
        """SELECT c.label, c.person_profile_id AS old, c.display_name AS old_name, own.score AS own, own.name AS own_name, best.person_id AS best_id, best.name AS best_name, best.score AS best
 FROM clusters c LEFT JOIN clus_person own ON own.label=c.label AND own.person_id=c.person_profile_id LEFT JOIN clus_rank best ON best.label=c.label AND best.r=1""",
    ),
}


@query(
    "c8_associate", "assoc",
    f"""SELECT label, CASE WHEN own>={_ASSOCIATE_THR} THEN old WHEN best>={_ASSOCIATE_THR} THEN best_id END AS person_profile_id,
 CASE WHEN own>={_ASSOCIATE_THR} THEN own_name WHEN best>={_ASSOCIATE_THR} THEN best_name WHEN lower(old_name)=lower(own_name) THEN NULL ELSE old_name END AS display_name FROM assoc""",
    _ASSOCIATE,
)
def associate(c: Catalog) -> DataFrame:
    rows = C.associate(c.persons, c.samples, c.clusters, _ASSOCIATE_THR, DIM)
    return rows.select("label", "person_profile_id", "display_name")


@query(
    "c9_remove_persons", "clusters",
    """SELECT label, CASE WHEN person_profile_id%3=0 THEN NULL ELSE person_profile_id END AS person_profile_id,
 CASE WHEN person_profile_id%3=0 AND display_name='Person '||(person_profile_id-1) THEN NULL ELSE display_name END AS display_name FROM clusters""",
)
def remove(c: Catalog) -> DataFrame:
    ids = c.persons.filter("id % 3 = 0").select(F.col("id").alias("person_id"))
    change = C.remove_persons(ids, c.persons, c.samples, c.clusters)[2]
    return change.clusters.select("label", "person_profile_id", "display_name")


@query(
    "c10_rename_clusters", "clusters",
    "SELECT label, CASE id%4 WHEN 0 THEN 'New '||id WHEN 1 THEN NULL ELSE display_name END AS display_name FROM clusters",
)
def rename(c: Catalog) -> DataFrame:
    kind = F.col("id") % 4
    named = F.when(kind == 0, F.concat(F.lit(" New "), "id", F.lit(" "))).otherwise(" ")
    commands = c.clusters.filter(kind < 2).select(
        "label", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("Old").alias("new_name")), F.struct(F.lit(2).alias("seq"), named.alias("new_name")))).alias("c")
    )
    return C.rename_clusters(c.clusters, commands.select("label", "c.*")).select("label", "display_name")


@query(
    "c11_upsert_persons", "persons",
    """SELECT arg_min(name, seq) AS name, k AS normalized_name FROM (SELECT doc_id AS seq, trim(name) AS name, lower(trim(name)) AS k FROM (
 SELECT doc_id, CASE WHEN doc_id%2=0 THEN 'Person '||(doc_id%40) ELSE ' PERSON '||(doc_id%30)||' ' END AS name FROM documents))
 WHERE k NOT IN (SELECT normalized_name FROM persons) GROUP BY k""",
)
def upsert(c: Catalog) -> DataFrame:
    doc = F.col("doc_id")
    name = F.when(doc % 2 == 0, F.concat(F.lit("Person "), doc % 40)).otherwise(F.concat(F.lit(" PERSON "), doc % 30, F.lit(" ")))
    names = c.table("documents").select(doc.alias("seq"), name.alias("name"))
    return C.upsert_persons(c.persons, names).select("name", "normalized_name")


# up to two commands a person: names in use, names given up by earlier commands, names asked for twice
_RENAME = {
    "command": (
        "persons",
        """SELECT id*10 AS seq, id AS p, CASE id%3 WHEN 0 THEN 'Renamed '||id WHEN 1 THEN 'Person '||(id%2) END AS new_name FROM persons WHERE id%3<2
 UNION ALL SELECT id*10+1, id, 'Person '||(id-2) FROM persons WHERE id%4=0 UNION ALL SELECT id*10+2, id, 'Renamed '||(id-2) FROM persons WHERE id%5=0
 UNION ALL SELECT id*10+3, id, ' SOLO  '||id FROM persons WHERE id%6=0""",
    ),
    "line": ("command", "SELECT *, row_number() OVER (ORDER BY seq) AS i FROM command"),
    # one by one: the names of all persons by id after each command, and who has been refused
    "walk": (
        "line persons",
        """SELECT * FROM (WITH RECURSIVE w AS (SELECT 0 AS i, (SELECT list(name ORDER BY id) FROM persons) AS names, (SELECT list([lower(name)] ORDER BY id) FROM persons) AS had, CAST(NULL AS VARCHAR) AS taken
 UNION ALL SELECT l.i, CASE WHEN t.no THEN w.names ELSE list_transform(w.names, lambda x, k: CASE WHEN k=l.p THEN trim(l.new_name) ELSE x END) END,
 CASE WHEN t.no THEN w.had ELSE list_transform(w.had, lambda x, k: CASE WHEN k=l.p THEN list_append(x, lower(trim(regexp_replace(l.new_name,' +',' ','g')))) ELSE x END) END, CASE WHEN t.no THEN 'no' END
 FROM w JOIN line l ON l.i=w.i+1, LATERAL (SELECT len(list_filter(w.names, lambda x, k: k<>l.p AND lower(regexp_replace(x,' +',' ','g'))=lower(trim(regexp_replace(l.new_name,' +',' ','g')))))>0 AS no) t) SELECT * FROM w)""",
    ),
    "final": ("walk", "SELECT names, had FROM walk WHERE i=(SELECT max(i) FROM walk)"),
    "renamed": ("final persons", "SELECT p.id, f.names[p.id] AS name, len(f.had[p.id])>1 AS moved, f.had[p.id][2] AS first_key, f.had[p.id][1:len(f.had[p.id])-1] AS was FROM persons p, final f"),
    "moved_rank": (
        "renamed clus_person",
        "SELECT c.*, row_number() OVER (PARTITION BY label ORDER BY score DESC, updated_at DESC, person_id DESC) AS r FROM clus_person c JOIN renamed n ON n.id=c.person_id WHERE n.moved AND score>0",
    ),
    "rebound": (
        "clusters clus_person moved_rank renamed",
        f"""SELECT c.label, CASE WHEN own.moved AND o.score>={_ASSOCIATE_THR} THEN c.person_profile_id WHEN own.moved OR c.person_profile_id IS NULL THEN CASE WHEN b.score>={_ASSOCIATE_THR} THEN b.person_id END ELSE c.person_profile_id END AS owner,
 CASE WHEN own.moved AND o.score>={_ASSOCIATE_THR} THEN own.name WHEN (own.moved OR c.person_profile_id IS NULL) AND b.score>={_ASSOCIATE_THR} THEN bn.name WHEN own.moved AND lower(c.display_name)=own.first_key THEN NULL ELSE c.display_name END AS shown
 FROM clusters c LEFT JOIN renamed own ON own.id=c.person_profile_id LEFT JOIN clus_person o ON o.label=c.label AND o.person_id=c.person_profile_id
 LEFT JOIN moved_rank b ON b.label=c.label AND b.r=1 LEFT JOIN renamed bn ON bn.id=b.person_id""",
    ),
}


def _rename(c: Catalog):
    pid = F.col("id")

    def said(k: int, when: str, name):
        return c.persons.filter(when).select((pid * 10 + k).alias("seq"), pid.alias("person_id"), name.alias("new_name"))

    commands = (
        said(0, "id % 3 < 2", F.when(pid % 3 == 0, F.concat(F.lit("Renamed "), pid)).otherwise(F.concat(F.lit("Person "), pid % 2)))
        .unionByName(said(1, "id % 4 = 0", F.concat(F.lit("Person "), pid - 2)))
        .unionByName(said(2, "id % 5 = 0", F.concat(F.lit("Renamed "), pid - 2)))
        .unionByName(said(3, "id % 6 = 0", F.concat(F.lit(" SOLO  "), pid)))
    )
    return C.rename_persons(c.persons, c.clusters, commands, c.samples, _ASSOCIATE_THR, DIM)


@query("c11_rename_persons", "renamed", "SELECT id, name FROM renamed", _RENAME)
def rename_persons(c: Catalog) -> DataFrame:
    return _rename(c)[0].select("id", "name")


@query("c11_refused_renames", "line walk", "SELECT l.seq, l.p AS person_id, trim(l.new_name) AS new_name FROM line l JOIN walk w ON w.i=l.i WHERE w.taken='no'", _RENAME)
def refused_renames(c: Catalog) -> DataFrame:
    return _rename(c)[1]


@query(
    "c11_sync_cluster_names", "rebound renamed",
    """SELECT r.label, r.owner AS person_profile_id, CASE WHEN n.moved AND (coalesce(r.shown,'')='' OR list_contains(n.was, lower(r.shown))) THEN n.name ELSE r.shown END AS display_name
 FROM rebound r LEFT JOIN renamed n ON n.id=r.owner""", _RENAME,
)
def sync_names(c: Catalog) -> DataFrame:
    return _rename(c)[2].clusters.select("label", "person_profile_id", "display_name")


_SELECTED = 3
_CANDIDATES = {
    **VIEW_SQL,
    "cands": (
        "clusters clus_person clus_rank stats persons",
        f"""SELECT c.label, c.display_name, coalesce(s.photo_count,0) AS photo_count, coalesce(own.score,0) AS score, coalesce(o.score,0) AS competitor_score,
 round(coalesce(own.score,0)-coalesce(o.score,0),6) AS margin, p.id AS current_person_id, p.name AS current_person_name, coalesce(c.person_profile_id={_SELECTED},false) AS linked,
 coalesce(own.score,0)>=0.30 AND round(coalesce(own.score,0)-coalesce(o.score,0),6)>=0.02 AS recommended, c.updated_at, c.id
 FROM clusters c LEFT JOIN clus_person own ON own.label=c.label AND own.person_id={_SELECTED} LEFT JOIN stats s ON s.label=c.label LEFT JOIN persons p ON p.id=c.person_profile_id
 LEFT JOIN (SELECT label, max(score) AS score FROM clus_rank WHERE person_id<>{_SELECTED} AND r<=2 GROUP BY 1) o ON o.label=c.label""",
    ),
}


def candidates(c: Catalog) -> DataFrame:
    return C.correction_candidates(
        _SELECTED, c.persons, c.samples, c.clusters, I.cluster_stats(c.photos), None, THR, MARGIN, DIM
    )


@query(
    "c12_correction_candidates", "cands",
    """SELECT label, display_name, photo_count, score, competitor_score, margin, current_person_id, current_person_name, linked, recommended FROM cands""", _CANDIDATES,
)
def correction_candidates(c: Catalog) -> DataFrame:
    return candidates(c).drop("example_photo_id").withColumnRenamed("linked_to_selected_person", "linked")


@query(
    "p10_filter_candidates", "cands",
    f"""SELECT label, score FROM cands
 WHERE score>=0.02 AND current_person_id IS NOT NULL AND current_person_id<>{_SELECTED} AND (contains(lower(label),'person') OR contains(lower(coalesce(display_name,'')),'person') OR contains(lower(coalesce(current_person_name,'')),'person'))""",
    _CANDIDATES,
)
def filter_candidates(c: Catalog) -> DataFrame:
    return L.filter_candidates(candidates(c), _SELECTED, "reassign", 0.02, "Person").select("label", "score")


_CORRECT = """SELECT label, CASE WHEN act='bind' THEN who WHEN act='unbind' AND person_profile_id=who THEN NULL ELSE person_profile_id END AS person_profile_id,
 CASE WHEN act='bind' THEN 'Person '||(who-1) WHEN act='unbind' AND person_profile_id=who AND lower(display_name)='person '||(who-1) THEN NULL ELSE display_name END AS display_name
 FROM (SELECT *, CASE WHEN id%3=0 THEN 'bind' WHEN id%3=1 THEN 'unbind' END AS act, CASE WHEN id%3=0 THEN 2 ELSE (id-1)//5+1 END AS who FROM clusters)"""


@query("c13_apply_corrections", "clusters", _CORRECT)
def correct(c: Catalog) -> DataFrame:
    ident = F.col("id")
    commands = c.clusters.filter("id % 3 < 2").select(
        ident.alias("seq"),
        F.when(ident % 3 == 0, F.lit(2)).otherwise(F.floor((ident - 1) / 5) + 1).cast("long").alias("person_id"),
        F.when(ident % 3 == 0, "bind").otherwise("unbind").alias("action"),
        F.array(F.concat(F.lit(" "), "label"), F.col("label")).alias("labels"),
    )
    change = C.apply_corrections(c.clusters, c.persons, commands)
    return change.clusters.select("label", "person_profile_id", "display_name")


_FRESH = {
    "fresh": (
        "photos photo_names clusters",
        """SELECT p.* EXCLUDE (people), b.base, list_concat(b.base, list_filter(coalesce(n.face_names,[]), lambda x: NOT list_contains(b.base, x))) AS people
 FROM photos p LEFT JOIN photo_names n ON n.id=p.id JOIN (SELECT id, list_filter(people, lambda x: lower(x) NOT IN ('person 2','person 4')) AS base, people AS said FROM photos) b ON b.id=p.id
 WHERE list_has_any(p.face_clusters, (SELECT list(label) FROM clusters WHERE person_profile_id=3)) OR len(list_filter(b.said, lambda x: lower(x) IN ('person 2','person 4')))>0""",
    ),
    "fresh_vec": ("fresh", text_vectors("fresh", "id", PHOTO_TEXT)),
}


@query(
    "c14_refresh_media", "fresh fresh_vec",
    f"""SELECT f.id, array_to_string(f.base,'|') AS people, array_to_string(f.people,'|') AS merged_people,
 {flat("list_concat(coalesce(v.v, list_transform(range(0,128), lambda x: 0.0::DOUBLE)), list_transform(range(0,112), lambda x: 0.0::DOUBLE))")} AS vector FROM fresh f LEFT JOIN fresh_vec v ON v.id=f.id""",
    _FRESH,
)
def refresh(c: Catalog) -> DataFrame:
    labels = c.clusters.filter("person_profile_id = 3").select("label")
    strip_names = c.persons.filter("id in (3, 5)").select("name")
    rows = C.refresh_media(c.photos_with_text_vector, c.clusters, c.persons, labels, strip_names)
    return rows.select(
        "id", piped(F.col("people")).alias("people"), piped(F.col("merged_people")).alias("merged_people"),
        flat_vector(F.col("vector")).alias("vector"),
    )


@query(
    "c14_refreshed_people", "photos photo_names clusters",
    """SELECT p.id, array_to_string(list_filter(p.people, lambda x: lower(x) NOT IN ('person 2','person 4')),'|') AS people,
 array_to_string(list_concat(list_filter(p.people, lambda x: lower(x) NOT IN ('person 2','person 4')), list_filter(coalesce(n.face_names,[]), lambda x: NOT list_contains(list_filter(p.people, lambda y: lower(y) NOT IN ('person 2','person 4')), x))),'|') AS merged_people
 FROM photos p LEFT JOIN photo_names n ON n.id=p.id WHERE list_has_any(p.face_clusters, (SELECT list(label) FROM clusters WHERE person_profile_id=3))
 OR len(list_filter(p.people, lambda x: lower(x) IN ('person 2','person 4')))>0""",
)
def refreshed_people(c: Catalog) -> DataFrame:
    labels = c.clusters.filter("person_profile_id = 3").select("label")
    strip_names = c.persons.filter("id in (3, 5)").select("name")
    rows = C.refresh_media(c.photos, c.clusters, c.persons, labels, strip_names, with_vector=False)
    return rows.select("id", piped(F.col("people")).alias("people"), piped(F.col("merged_people")).alias("merged_people"))


@query(
    "c15_refresh_profiles", "persons",
    f"SELECT id, sample_count, example_sample_id, {flat('centroid', 6)} AS centroid FROM persons",
)
def profiles(c: Catalog) -> DataFrame:
    return c.persons.select("id", "sample_count", "example_sample_id", flat_vector(F.col("centroid"), 6).alias("centroid"))


@query(
    "c18_legacy_vectors", "persons samples clusters",
    """SELECT * FROM (SELECT 'person' AS kind, CAST(id AS VARCHAR) AS key, 64 AS length FROM persons WHERE centroid IS NOT NULL UNION ALL SELECT 'sample', CAST(id AS VARCHAR), 64 FROM samples
 UNION ALL SELECT 'cluster', label, 64 FROM clusters) WHERE kind<>'sample' OR CAST(key AS BIGINT)%4<>0""",
)
def legacy(c: Catalog) -> DataFrame:
    current = F.when(F.col("id") % 4 == 0, F.concat("embedding", F.array_repeat(F.lit(0.0), 448))).otherwise(F.col("embedding"))
    return I.legacy_vectors(c.persons, c.samples.withColumn("embedding", current), c.clusters, 512)


_REBUILT = {
    "close": ("faces", "SELECT a.face_id AS a, b.face_id AS b FROM faces a, faces b WHERE a.face_id<>b.face_id AND round(list_cosine_similarity(a.embedding,b.embedding),6)>=0.30"),
    # the smallest face of a component, by passing on the smallest known one
    "rooted": (
        "close faces",
        """SELECT face_id, min(root) AS root FROM (WITH RECURSIVE r AS (SELECT face_id, face_id AS root FROM faces UNION SELECT k.b, r.root FROM r JOIN close k ON k.a=r.face_id AND k.b>r.root) SELECT * FROM r) GROUP BY face_id""",
    ),
    "rface": (
        "rooted faces face_match",
        """SELECT f.media_id, f.seq, 'face-'||substr(sha1(CAST(r.root AS VARCHAR)),1,32) AS label, m.name FROM faces f JOIN rooted r ON r.face_id=f.face_id
 LEFT JOIN (SELECT * FROM face_match WHERE score>=0.30 AND (second<=0 OR round(score-second,6)>=0.04)) m ON m.face_id=f.face_id""",
    ),
    "rlabels": ("rface", "SELECT media_id, string_agg(label,'|' ORDER BY p) AS labels FROM (SELECT media_id, label, min(seq) AS p FROM rface GROUP BY ALL) GROUP BY 1"),
    "rnames": ("rface", "SELECT media_id, list(name ORDER BY p) AS names FROM (SELECT media_id, name, min(seq) AS p FROM rface WHERE name IS NOT NULL GROUP BY ALL) GROUP BY 1"),
}


@query(
    "c19_rebuild_index", "photos persons rlabels rnames rface",
    """SELECT p.id, array_to_string(list_concat(p.base, list_filter(coalesce(n.names,[]), lambda x: NOT list_contains(p.base,x))),'|') AS people, coalesce(l.labels,'') AS labels, coalesce(c.n,0) AS face_count
 FROM (SELECT id, list_filter(people, lambda x: NOT list_contains(k.keys, lower(x))) AS base FROM photos, (SELECT list(normalized_name) AS keys FROM persons) k) p LEFT JOIN rlabels l ON l.media_id=p.id LEFT JOIN rnames n ON n.media_id=p.id
 LEFT JOIN (SELECT media_id, count(*) AS n FROM rface GROUP BY 1) c ON c.media_id=p.id""",
    _REBUILT,
)
def rebuild(c: Catalog) -> DataFrame:
    _, _, photos = C.rebuild_index(c.faces, c.photos, c.persons, c.samples, THR, THR, DIM)
    return photos.select("id", piped(F.col("merged_people")).alias("people"), piped(F.col("face_clusters")).alias("labels"), "face_count")


@query(
    "c20_cleanup_clusters", "clusters photos videos",
    """SELECT c.label, p.newest AS example_photo_id FROM clusters c LEFT JOIN (SELECT label, max_by(id, struct_pack(a:=created_at,b:=id)) AS newest FROM (
 SELECT unnest(face_clusters) AS label, created_at, id FROM photos) GROUP BY label) p ON p.label=c.label
 WHERE p.label IS NOT NULL OR c.label IN (SELECT unnest(face_clusters) FROM videos)""",
)
def cleanup(c: Catalog) -> DataFrame:
    rows = C.cleanup_clusters(c.clusters, c.photos, c.videos)
    return rows.select("label", "example_photo_id")


@query(
    "c21_delete_media", "photos sources",
    """SELECT p.id, p.storage_path, coalesce(p.id%2=0 AND (s.root_path='/src' OR starts_with(p.original_path, s.root_path||'/')) AND p.original_path<>p.storage_path, false) AS remove_original
 FROM photos p LEFT JOIN sources s ON s.id=p.source_id WHERE p.id%9=0""",
)
def delete(c: Catalog) -> DataFrame:
    ids = c.photos.filter("id % 9 = 0").select("id", (F.col("id") % 2 == 0).alias("delete_source_file"))
    return C.delete_media(c.photos, ids, c.sources)[1].select("id", "storage_path", "remove_original")


_CHANGED = {
    "later": (
        "samples vec",
        """SELECT id, person_id, embedding, created_at FROM samples WHERE id%20<>0
 UNION ALL SELECT vec_id, label+1, e, TIMESTAMP '2024-03-01' FROM vec WHERE vec_id%10=3""",
    ),
    "lmean": ("later", "SELECT person_id, list(m ORDER BY pos) AS m FROM (SELECT person_id, pos, avg(embedding[pos]) AS m FROM later, range(1,65) r(pos) GROUP BY ALL) GROUP BY person_id"),
}


@query(
    "c22_apply_sample_changes", "persons later lmean",
    f"""SELECT p.name, coalesce(s.n,0) AS sample_count, s.last AS example_sample_id, {flat("list_transform(l.m, lambda x: round(x/sqrt(list_dot_product(l.m,l.m)),6))", 6)} AS centroid FROM persons p
 LEFT JOIN lmean l ON l.person_id=p.id LEFT JOIN (SELECT person_id, count(*) AS n, max_by(id, struct_pack(a:=created_at, b:=id)) AS last FROM later GROUP BY 1) s ON s.person_id=p.id""",
    _CHANGED,
)
def sample_changes(c: Catalog) -> DataFrame:
    v = F.col("vec_id")
    record = F.struct(
        v.alias("id"), (F.col("label") + 1).cast("long").alias("person_id"), F.lit("new.jpg").alias("original_filename"),
        F.lit("/people/new.jpg").alias("storage_path"), F.col("embedding"), F.expr("timestamp'2024-03-01'").alias("created_at"),
    )
    commands = c.vectors.filter(v % 10 < 4).select(
        v.alias("seq"), F.when(v % 10 == 3, "add").otherwise("delete").alias("action"),
        (F.col("label") + 1).cast("long").alias("person_id"), record.alias("sample"),
    ).filter("action = 'add' or seq % 20 = 0")
    _, persons, _, change = C.apply_sample_changes(commands, c.persons, c.samples, c.clusters, THR, DIM)
    return persons.select(
        F.col("name"), F.col("sample_count").cast("long").alias("sample_count"), "example_sample_id",
        flat_vector(F.col("centroid"), 6).alias("centroid"),
    )
