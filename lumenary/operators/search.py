"""Facet, keyword and vector search, person search, and its evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenary.functions import blockmatch as bm
from lumenary.functions import text as X
from lumenary.functions.blockmatch import Side
from lumenary.functions.vector import IMAGE_DIM, cosines_to
from lumenary.operators import identity as I
from lumenary.operators.views import enrich_photos, enrich_videos
from lumenary.session import cut_lineage

# Score weights, the vector floor and the person count of a face search.
KEYWORD_WEIGHT, VECTOR_WEIGHT = 0.55, 0.45
VECTOR_FLOOR = 0.01
FACE_SEARCH_PERSONS = 3
#: Labels that are looked up for the terms of a search at most.
NAMED_LABELS = 5_000
#: Rows that the queries of a task are matched to, and rows of media or label sets that are sent to all tasks at most.
FAN_ROWS, SENT_ROWS = 250_000, 50_000
#: Names whose anchors are sent to all tasks at most.
SENT_NAMES = 200_000
MODES = ("hybrid", "keyword", "vector")


@dataclass(frozen=True)
class SearchRequest:
    text: str = ""
    people: Sequence[str] = ()
    scene_tags: Sequence[str] = ()
    object_tags: Sequence[str] = ()
    source_kinds: Sequence[str] = ()
    face_cluster_labels: Sequence[str] = ()
    mode: str = "hybrid"
    limit: int = 20
    deep: Sequence[float] = field(default=())  # encoder vector of the text, for videos

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown search mode: {self.mode}")

    @property
    def terms(self) -> list[str]:
        return X.token_list(self.text.strip())

    @property
    def wants_vector(self) -> bool:
        return bool(self.text.strip() or self.people or self.scene_tags or self.object_tags)

    def chunks(self) -> str:
        return "\n".join([self.text, " ".join(self.people), " ".join(self.scene_tags), " ".join(self.object_tags)])


GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """The different stretches of `size` letters of a text; none if it is shorter."""

    def cut(letters: Column) -> Column:
        starts = F.when(F.size(letters) >= size, F.sequence(F.lit(1), F.size(letters) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(letters, i, size), "")))

    return X.let(F.split(text, ""), cut)


def detect_people(queries: DataFrame, persons: DataFrame) -> DataFrame:
    """(query_id, names): persons whose normalised name occurs in the query text.

    Each name is indexed by one anchor, the three letters of it that fewest names share (a shorter name by
    all of it). A text that holds a name holds its anchor, so texts meet names by equal anchors, and only
    those pairs are tested for containment.
    """
    named = persons.filter(F.trim("normalized_name") != "").select(
        F.lower(F.trim("normalized_name")).alias("piece"), "name", "updated_at", "id"
    )
    pieces = named.select("piece").distinct().select("piece", F.explode(_grams(F.col("piece"), F.least(F.length("piece"), F.lit(GRAM)))).alias("anchor"))
    shared = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    anchors = pieces.join(shared, "anchor").groupBy("piece").agg(F.min_by("anchor", F.struct("n", "anchor")).alias("anchor"))
    texts = queries.select("query_id", F.lower(F.trim("text")).alias("t")).filter("t <> ''")
    # every stretch of n letters, found at each place in turn
    cut = [F.array_distinct(F.regexp_extract_all("t", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))) for n in range(1, GRAM + 1)]
    grams = texts.select("query_id", F.explode(F.concat(*cut)).alias("anchor"))
    # stretches that anchor no name drop out where the text is read, unless there are very many names
    anchors = cut_lineage(anchors)
    maybe = grams.join(F.broadcast(anchors) if anchors.count() <= SENT_NAMES else anchors, "anchor").select("query_id", "piece").distinct()
    said = maybe.join(texts, "query_id").filter(F.contains("t", "piece")).select("query_id", "piece").distinct()
    found = said.join(named, "piece").select(
        "query_id", F.struct((-F.unix_micros("updated_at")).alias("u"), (-F.col("id")).alias("i"), "name").alias("e")
    )
    return found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["name"]).alias("names"))


def _with_people(requests: Sequence[SearchRequest], persons: DataFrame) -> list[SearchRequest]:
    """Names found in a request's text join its people, newest person first.

    A page of requests is a few short texts, so one pass over the persons tests all of them; a table of
    texts goes through `detect_people`.
    """
    name = F.lower(F.trim("normalized_name"))
    said = F.array(*[F.contains(F.lit(r.text.strip().lower()), name) for r in requests])
    rows = persons.filter(name != "").select("name", "updated_at", "id", said.alias("said")).filter(F.exists("said", lambda x: x))
    found = rows.collect()
    found.sort(key=lambda p: (p["updated_at"], p["id"]), reverse=True)
    return [
        replace(r, people=tuple(dict.fromkeys([*r.people, *(p["name"] for p in found if p["said"][i])]))) for i, r in enumerate(requests)
    ]


def facet_filter(request: SearchRequest, clusters: bool = True, named: Callable[[str], Column] | None = None) -> Column:
    """Every wanted person, tag and cluster is on the row, and the source kind is listed.

    `named` says of a lower-case name whether a face of the row has it; without it `people` holds all names.
    """
    wanted = [
        ("people", [p.lower() for p in request.people], True),
        ("scene_tags", [p.lower() for p in request.scene_tags], True),
        ("object_tags", [p.lower() for p in request.object_tags], True),
    ]
    if clusters:
        wanted.append(("face_clusters", list(request.face_cluster_labels), False))
    keep = F.lit(True)
    for column, values, fold in wanted:
        have = F.transform(column, F.lower) if fold else F.col(column)
        for value in dict.fromkeys(values):
            there = F.coalesce(F.array_contains(have, value), F.lit(False))
            keep = keep & (there | named(value) if named is not None and column == "people" else there)
    if request.source_kinds:
        keep = keep & F.col("source_kind").isin(*request.source_kinds)
    return keep


_TEXTS = ("caption", "ocr_text", "scene_tags", "object_tags", "original_path")


def _mentions(columns: Sequence[str], terms: Sequence[str]) -> Column:
    """For each term whether a column holds it; a term has no blanks, so it never spans columns."""
    texts = [F.lower(F.concat_ws(" ", c)) for c in columns]
    found = [reduce(lambda a, b: a | b, [F.contains(t, F.lit(term)) for t in texts]) for term in terms]
    return F.array(*found).cast("array<boolean>")


def keyword_score(found: Column, known: Sequence[str], terms: Sequence[str]) -> Column:
    """Share of the terms, counted with repeats, that were found; 1 without terms.

    found: booleans in the order of `known`.
    """
    if not terms:
        return F.lit(1.0)
    hits = [F.when(found[known.index(t)], terms.count(t)).otherwise(0) for t in dict.fromkeys(terms)]
    return reduce(lambda a, b: a + b, hits) / F.lit(float(len(terms)))


def merge_scores(mode: str, keyword: Column, vector: Column, has_query: bool) -> Column:
    if not has_query:
        return F.lit(1.0)
    if mode == "keyword":
        return keyword
    if mode == "vector":
        return F.when(vector > VECTOR_FLOOR, vector).otherwise(0.0)
    silent = (keyword <= 0) & (vector <= VECTOR_FLOOR)
    return F.when(silent, 0.0).otherwise(keyword * KEYWORD_WEIGHT + vector * VECTOR_WEIGHT)


def _labels_saying(clusters: DataFrame, persons: DataFrame, terms: Sequence[str], people: Sequence[str]) -> list[list[str]] | None:
    """Per term the labels with a name that holds it, then per lower-case person those with that very name.

    None if more than NAMED_LABELS labels say any of them.
    """
    names = [F.lower("display_name"), F.lower("person_name")]
    tests = [lambda n, t=t: F.contains(n, F.lit(t)) for t in terms] + [lambda n, p=p: n == p for p in people]
    if not tests:
        return []
    flags = [reduce(lambda x, y: x | y, [F.coalesce(test(n), F.lit(False)) for n in names]) for test in tests]
    said = I.label_names(clusters, persons).select("label", F.array(*flags).alias("flags")).filter(F.exists("flags", lambda x: x))
    rows = said.take(NAMED_LABELS + 1)
    if len(rows) > NAMED_LABELS:
        return None
    return [[r["label"] for r in rows if r["flags"][i]] for i in range(len(tests))]


def _on_faces(labels: Sequence[str]) -> Column:
    """Whether a face of the row has one of the labels."""
    if not labels:
        return F.lit(False)
    quoted = ",".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in labels)
    return F.coalesce(F.expr(f"exists(face_clusters, x -> x in ({quoted}))"), F.lit(False))


def _score_all(
    media: DataFrame, clusters: DataFrame, persons: DataFrame, requests: Sequence[SearchRequest], targets: np.ndarray,
    by_cluster: bool,
) -> DataFrame:
    """(id, created_at, scores) of all media, a score per request (null or 0: no hit): one scan answers all requests.

    The names of faces are resolved the other way round: labels whose names hold a wanted term or person are
    looked up first, and the rows are tested for them, so media meet no table. Only if very many labels
    say a term, the media are joined with the names of their faces.
    """
    terms = list(dict.fromkeys(t for r in requests for t in r.terms))
    people = list(dict.fromkeys(p.lower() for r in requests for p in r.people))
    texts = [*_TEXTS, "face_clusters"] if by_cluster else list(_TEXTS)
    labels = _labels_saying(clusters, persons, terms, people)
    rows = media.select(
        "id", "created_at", "source_kind", "people", "scene_tags", "object_tags", "face_clusters",
        _mentions(texts, terms).alias("_said"), cosines_to(F.col("vector"), targets).alias("_cos"),
    )
    named = None
    found = F.zip_with("_said", _mentions(["people"], terms), lambda a, b: a | b)
    if labels is None:
        rows = enrich_photos(rows, clusters, persons)
    else:
        found = F.zip_with(found, F.array(*[_on_faces(labels[i]) for i in range(len(terms))]).cast("array<boolean>"), lambda a, b: a | b)
        rows = rows.withColumns({f"_person{i}": _on_faces(labels[len(terms) + i]) for i in range(len(people))})
        named = lambda name: F.col(f"_person{people.index(name)}")
    rows = rows.withColumn("_found", found)
    scores = []
    for i, r in enumerate(requests):
        vector = F.coalesce(F.col("_cos")[i], F.lit(0.0)) if r.wants_vector else F.lit(0.0)
        keyword = keyword_score(F.col("_found"), terms, r.terms)
        score = merge_scores(r.mode, keyword, vector, bool(r.terms or r.wants_vector))
        scores.append(F.round(F.when(facet_filter(r, by_cluster, named), score), 6).cast("double"))
    return rows.select("id", "created_at", F.array(*scores).alias("scores"))


def _page(scored: DataFrame, requests: Sequence[SearchRequest]) -> DataFrame:
    """(query_no, id, created_at, score, rank, total): one page per request, from one pass.

    A task keeps the best `limit` hits of each request and counts all; only those rows leave it.
    """
    limits = [r.limit for r in requests]
    best_first = [("score", "descending"), ("created_at", "descending"), ("id", "descending")]

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}
        counts = np.zeros(len(limits), dtype=np.int64)
        rest = None
        for batch in batches:
            rest = batch.slice(0, 0).select(["id", "created_at"])
            scores = pc.fill_null(batch.column("scores").flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, len(limits))
            for q, limit in enumerate(limits):
                hit = np.flatnonzero(scores[:, q] > 0)
                counts[q] += len(hit)
                rows = pa.table({"id": batch.column("id").take(pa.array(hit)), "created_at": batch.column("created_at").take(pa.array(hit)), "score": scores[hit, q]})
                rows = pa.concat_tables([held[q], rows]) if q in held else rows
                held[q] = rows.take(pc.select_k_unstable(rows, limit, best_first)) if rows.num_rows > limit else rows
        if rest is None:
            return
        for q, rows in held.items():
            total = pa.table({"id": pa.nulls(1, rest.schema.field("id").type), "created_at": pa.nulls(1, rest.schema.field("created_at").type), "score": pa.nulls(1, pa.float64())})
            out = pa.concat_tables([rows, total])
            n = pa.array([None] * rows.num_rows + [int(counts[q])], pa.int64())
            out = pa.table({"query_no": pa.array([q] * out.num_rows, pa.int32()), **{c: out.column(c) for c in ("id", "created_at", "score")}, "n": n})
            yield from out.combine_chunks().to_batches()

    kinds = dict(scored.dtypes)
    parts = scored.mapInArrow(tops, f"query_no int, id {kinds['id']}, created_at {kinds['created_at']}, score double, n long")
    whole = W.partitionBy("query_no")
    order = whole.orderBy(F.col("n").isNotNull(), F.desc("score"), F.desc("created_at"), F.desc("id"))
    ranked = parts.withColumns({"rank": F.row_number().over(order), "total": F.sum("n").over(whole)})
    page = F.array(*map(F.lit, limits))[F.col("query_no")]
    return ranked.filter(F.col("n").isNull() & (F.col("rank") <= page)).select("query_no", "id", "created_at", "score", "rank", "total")


def photo_results(hits: DataFrame, photos: DataFrame, clusters: DataFrame, persons: DataFrame) -> DataFrame:
    """The enriched photos of a search, with query_no, score, rank and total of their hits.

    `hits` is one page per request, so it is broadcast to the photos; only its photos meet their names.
    """
    page = hits.select("id", "query_no", "score", "rank", "total")
    wanted = photos.join(F.broadcast(page.select("id").distinct()), "id", "left_semi")
    return page.join(enrich_photos(wanted, clusters, persons), "id")


def video_results(hits: DataFrame, videos: DataFrame, clusters: DataFrame, persons: DataFrame) -> DataFrame:
    """As photo_results, for videos."""
    page = hits.select("id", "query_no", "score", "rank", "total")
    wanted = videos.join(F.broadcast(page.select("id").distinct()), "id", "left_semi")
    return page.join(enrich_videos(wanted, clusters, persons), "id")


def search_photos(photos: DataFrame, clusters: DataFrame, persons: DataFrame, requests: Sequence[SearchRequest]) -> DataFrame:
    """(query_no, id, created_at, score, rank, total) for each request."""
    requests = _with_people(requests, persons)
    hashed = X.hash_texts([r.chunks() for r in requests])
    targets = np.hstack([hashed, np.zeros((len(requests), IMAGE_DIM))])
    return _page(_score_all(photos, clusters, persons, requests, targets, True), requests)


def search_videos(
    videos: DataFrame, clusters: DataFrame, persons: DataFrame, requests: Sequence[SearchRequest], deep_dim: int = 768
) -> DataFrame:
    """As search_photos; cluster labels neither filter nor count as text."""
    requests = _with_people(requests, persons)
    hashed = X.hash_texts([r.chunks() for r in requests])
    deep = np.array([list(r.deep) or [0.0] * deep_dim for r in requests])
    targets = np.hstack([hashed, deep])
    return _page(_score_all(videos, clusters, persons, requests, targets, False), requests)


def term_flags(terms: Sequence[str], by_cluster: bool = True) -> Column:
    """Which of the terms a row mentions anywhere, people included."""
    extra = ["people", "face_clusters"] if by_cluster else ["people"]
    return _mentions([*_TEXTS, *extra], terms)


def vector_search(df: DataFrame, vector: Sequence[float], k: int = 20) -> DataFrame:
    """Newest-first among equal scores; only positive cosines."""
    scored = df.withColumn("score", F.round(cosines_to(F.col("vector"), np.array([vector]))[0], 6))
    return scored.filter("score > 0").orderBy(F.desc("score"), F.desc("created_at"), F.desc("id")).limit(k)


_POSITIVE = 1e-6


def similar(df: DataFrame, ids: DataFrame, k: int = 20, dim: int = 240) -> DataFrame:
    """(id, match_id, score, rank): the k nearest other items of each listed item."""
    asked = df.join(ids.select("id").distinct(), "id", "left_semi")
    return bm.nearest(
        Side(asked, "id", "vector"), Side(df, "id", "vector", "created_at"), dim=dim, k=k, floor=_POSITIVE, skip_self=True
    )


def search_by_examples(examples: DataFrame, df: DataFrame, k: int = 24, dim: int = 240) -> DataFrame:
    """(example_id, match_id, score, rank) for a table of example vectors."""
    return bm.nearest(
        Side(examples, "example_id", "vector"), Side(df, "id", "vector", "created_at"), dim=dim, k=k, floor=_POSITIVE
    )


# --- person search --------------------------------------------------------------------------------


def query_keys(queries: DataFrame, persons, samples, clusters, thr: float, dim: int, most: int | None = None) -> DataFrame:
    """(query_id, kind, ref, score): persons and (all, or the `most` best) clusters a query face matches."""
    side = Side(queries, "query_id", "embedding")
    people = I.rank_persons(side, persons, samples, FACE_SEARCH_PERSONS, dim).filter(F.col("score") >= thr)
    direct = bm.nearest(side, Side(clusters, "label", "centroid", "updated_at"), dim=dim, k=most, floor=thr)
    return people.select(
        "query_id", F.lit("person").alias("kind"), F.col("person_id").cast("string").alias("ref"), "score"
    ).unionByName(
        direct.select("query_id", F.lit("cluster").alias("kind"), F.col("match_label").alias("ref"), "score")
    )


def cluster_scores(
    queries: DataFrame, persons: DataFrame, samples: DataFrame, clusters: DataFrame,
    thr: float = I.PERSON_THRESHOLD, dim: int = I.FACE_DIM, keys: DataFrame | None = None,
) -> DataFrame:
    """(query_id, label, score): best of the owner's score and the centroid cosine."""
    if keys is None:
        keys = query_keys(queries, persons, samples, clusters, thr, dim)
    owned = clusters.select(F.col("person_profile_id").cast("string").alias("ref"), "label")
    by_owner = keys.filter("kind = 'person'").join(owned, "ref").select("query_id", "label", "score")
    direct = keys.filter("kind = 'cluster'").select("query_id", F.col("ref").alias("label"), "score")
    return by_owner.unionByName(direct).groupBy("query_id", "label").agg(F.max("score").alias("score"))


def _media_keys(media: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, created_at, kind, ref): the clusters on a medium and their owners, an owner once for each of its clusters."""
    labels = media.select("id", "created_at", F.explode(F.array_distinct("face_clusters")).alias("label"))
    owned = labels.join(clusters.select("label", "person_profile_id"), "label")
    refs = F.array(
        F.struct(F.lit("cluster").alias("kind"), F.col("label").alias("ref")),
        F.struct(F.lit("person").alias("kind"), F.col("person_profile_id").cast("string").alias("ref")),
    )
    rows = owned.select("id", "created_at", F.explode(refs).alias("r")).select("id", "created_at", "r.*")
    return rows.filter("ref is not null")


def _fan_out(asked: DataFrame, lists: DataFrame, on: str | list[str], rows: DataFrame) -> DataFrame:
    """asked joined with lists, the rows of a query in one partition; rows: what rows of `asked` will give, as `n`.

    What a row of `asked` gives is many times its size, so partitions are dealt by what comes out, not by their bytes.
    """
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // FAN_ROWS))
    if lists.count() <= SENT_ROWS:
        return asked.repartition(parts, "query_id").join(F.broadcast(lists), on)
    return asked.join(lists, on).repartition(parts, "query_id")


def search_by_person(
    queries: DataFrame, media: DataFrame, persons: DataFrame, samples: DataFrame, clusters: DataFrame,
    k: int = 20, thr: float = I.PERSON_THRESHOLD, dim: int = I.FACE_DIM, keys: DataFrame | None = None,
) -> DataFrame:
    """(query_id, id, score, rank) per query face; a medium scores as its best matching cluster.

    `keys`: the persons and clusters each query matches, where they are known already (`query_keys`).

    A result of rank <= k is among the k newest media of its best key: k newer ones there would all
    score at least as much. So k media per key suffice, however many carry a hot label. A query's keys are
    taken from the best one down, and only until those before hold k different media.
    """
    newest = W.partitionBy("kind", "ref").orderBy(F.desc("created_at"), F.desc("id"))
    # a medium that is named twice has one rank
    short = _media_keys(media, clusters).withColumn("r", F.dense_rank().over(newest)).filter(F.col("r") <= k)
    short = cut_lineage(short.distinct())
    sizes = short.groupBy("kind", "ref").agg(F.max("r").cast("long").alias("size"))
    # a medium is on as many lists as it has labels and owners, so lists of k * most rows hold k media
    most = short.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    if keys is None:
        seen = clusters.join(sizes.filter("kind = 'cluster'").select(F.col("ref").alias("label")), "label", "left_semi")
        keys = query_keys(queries, persons, samples, seen, thr, dim, k * most)
    keys = keys.join(sizes, ["kind", "ref"])
    better = W.partitionBy("query_id").orderBy(-F.round(F.col("score") * 1_000_000).cast("long")).rangeBetween(W.unboundedPreceding, -1)
    keys = keys.filter("score > 0").withColumn("above", F.coalesce(F.sum("size").over(better), F.lit(0))).filter(F.col("above") < k * most)
    # a key stands for up to k media, so tasks are dealt by the rows that their keys will give
    keys = cut_lineage(keys.select("query_id", "kind", "ref", "score", "size"))
    fanned = _fan_out(keys.drop("size"), short.drop("r"), ["kind", "ref"], keys.select(F.col("size").alias("n")))
    hits = fanned.groupBy("query_id", "id").agg(
        F.max("score").alias("score"), F.max("created_at").alias("created_at")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("created_at"), F.desc("id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "id", "score", "rank"
    )


def retrieved_counts(
    queries: DataFrame, media: DataFrame, persons: DataFrame, samples: DataFrame, clusters: DataFrame,
    thr: float = I.PERSON_THRESHOLD, dim: int = I.FACE_DIM, keys: DataFrame | None = None,
) -> DataFrame:
    """(query_id, retrieved): all media a query matches, counted by distinct label set. `keys`: as in search_by_person."""
    sets = media.select(F.array_sort(F.array_distinct("face_clusters")).alias("labels")).groupBy("labels").agg(
        F.count(F.lit(1)).alias("n")
    )
    labels = cut_lineage(cluster_scores(queries, persons, samples, clusters, thr, dim, keys).filter("score > 0").select("query_id", "label"))
    # sets go by numbers, and tasks are dealt by the sets that their labels will give
    sets = cut_lineage(sets.withColumn("set", F.monotonically_increasing_id()))
    members = sets.select("set", "n", F.explode("labels").alias("label"))
    fan = labels.join(members.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")
    matched = _fan_out(labels, members, "label", fan).select("query_id", "set", "n").distinct()
    return matched.groupBy("query_id").agg(F.sum("n").alias("retrieved"))


# --- media of clusters and persons ------------------------------------------------------------------


def _newest(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("score", F.lit(1.0)).orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def photos_of_cluster(photos: DataFrame, label: str, k: int = 48) -> DataFrame:
    return _newest(photos.filter(F.array_contains("face_clusters", label)), k)


def videos_of_clusters(videos: DataFrame, labels: DataFrame, k: int = 48) -> DataFrame:
    """Videos with any of the labels."""
    wanted = labels.filter("label <> ''").select("label").distinct()
    hit = videos.select("id", F.explode("face_clusters").alias("label")).join(wanted, "label", "left_semi")
    return _newest(videos.join(hit.select("id").distinct(), "id", "left_semi"), k)


def videos_of_person(videos: DataFrame, clusters: DataFrame, person_id: int, k: int = 48) -> DataFrame:
    return videos_of_clusters(videos, clusters.filter(F.col("person_profile_id") == person_id), k)


def photos_of_person(
    photos: DataFrame, clusters: DataFrame, persons: DataFrame, person_id: int, k: int = 48, any_label: bool = False
) -> DataFrame:
    """Facet search for the person among photos that carry all the person's clusters.

    `any_label=True` asks for one of the clusters instead.
    """
    person = persons.filter(F.col("id") == person_id).select("name").first()
    if person is None:
        raise ValueError("person not found")
    owned = clusters.filter(F.col("person_profile_id") == person_id).select("label").distinct()
    total = owned.agg(F.count(F.lit(1)).alias("n")).scalar()
    held = (
        photos.select("id", F.explode(F.array_distinct("face_clusters")).alias("label"))
        .join(owned, "label", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("held"))
    )
    need = F.least(total, F.lit(1)) if any_label else total
    kept = photos.join(held, "id", "left").filter(F.coalesce("held", F.lit(0)) >= need).drop("held")
    return search_photos(kept, clusters, persons, [SearchRequest(people=[person["name"]], limit=k)])


# --- evaluation -----------------------------------------------------------------------------------


def ground_truth(media: DataFrame, clusters: DataFrame) -> DataFrame:
    """(person_id, id): media that carry a cluster of the person."""
    owned = clusters.filter("person_profile_id is not null").select("label", F.col("person_profile_id").alias("person_id"))
    labels = media.select("id", F.explode(F.array_distinct("face_clusters")).alias("label"))
    return labels.join(owned, "label").select("person_id", "id").distinct()


def rank_samples(
    media: DataFrame, persons: DataFrame, samples: DataFrame, clusters: DataFrame,
    k: int = 200, thr: float = I.PERSON_THRESHOLD, dim: int = I.FACE_DIM, keys: DataFrame | None = None,
) -> DataFrame:
    """(sample_id, person_id, id, score, rank) for every sample of a person with relevant media."""
    asked = evaluable(samples, media, clusters)
    ranked = search_by_person(
        asked.withColumnRenamed("sample_id", "query_id"), media, persons, samples, clusters, k, thr, dim, keys
    )
    return ranked.withColumnRenamed("query_id", "sample_id").join(asked.select("sample_id", "person_id"), "sample_id")


def evaluable(samples: DataFrame, media: DataFrame, clusters: DataFrame) -> DataFrame:
    shown = media.select(F.explode("face_clusters").alias("label")).distinct()
    known = clusters.join(shown, "label", "left_semi").select(F.col("person_profile_id").alias("person_id")).distinct()
    return samples.filter(F.size("embedding") > 0).select(F.col("id").alias("sample_id"), "person_id", "embedding").join(
        known, "person_id", "left_semi"
    )


def best_ranks(ranked: DataFrame, truth: DataFrame, asked: DataFrame) -> DataFrame:
    """(sample_id, person_id, best_rank): rank of the first relevant hit, null on a miss."""
    relevant = ranked.join(truth, ["person_id", "id"], "left_semi")
    best = relevant.groupBy("sample_id").agg(F.min("rank").alias("best_rank"))
    return asked.select("sample_id", "person_id").join(best, "sample_id", "left")


def _quality(ks: Sequence[int]) -> list[Column]:
    hit = lambda k: F.round(F.avg(F.when(F.col("best_rank") <= k, 1.0).otherwise(0.0)), 6)
    return [
        F.count(F.lit(1)).alias("query_count"),
        F.round(F.avg(F.coalesce(1.0 / F.col("best_rank"), F.lit(0.0))), 6).alias("mrr"),
        *[hit(k).alias(f"hit_{k}") for k in sorted(set(ks)) if k > 0],
    ]


def retrieval_metrics(best: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    return best.agg(*_quality(ks))


def retrieval_report(best: DataFrame, persons: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    names = persons.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    return best.groupBy("person_id").agg(*_quality(ks)).join(names, "person_id")


def query_report(best: DataFrame, truth: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(sample_id, person_id, best_rank, relevant_count, retrieved_count)."""
    relevant = truth.groupBy("person_id").agg(F.count(F.lit(1)).alias("relevant_count"))
    counts = retrieved.select(F.col("query_id").alias("sample_id"), F.col("retrieved").alias("retrieved_count"))
    return best.join(relevant, "person_id").join(counts, "sample_id", "left").withColumn(
        "retrieved_count", F.coalesce("retrieved_count", F.lit(0))
    )


def evaluation_inputs(
    media: DataFrame, persons: DataFrame, samples: DataFrame, clusters: DataFrame,
    k: int = 200, thr: float = I.PERSON_THRESHOLD, dim: int = I.FACE_DIM, keys: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(best ranks, ground truth, asked samples) for the reports above."""
    truth = ground_truth(media, clusters)
    asked = evaluable(samples, media, clusters)
    ranked = rank_samples(media, persons, samples, clusters, k, thr, dim, keys)
    return best_ranks(ranked, truth, asked), truth, asked
