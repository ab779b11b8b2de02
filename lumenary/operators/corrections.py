"""Batches of changes to clusters, persons and samples, and what they change on media."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenary.functions.blockmatch import Side
from lumenary.functions.text import distinct_concat, empty_strings, normalize_name, strip
from lumenary.operators import identity as I
from lumenary.operators.features import refreshed_vector
from lumenary.operators.listing import lookup


@dataclass(frozen=True)
class Change:
    """New clusters, the labels whose media must be refreshed, and the names to strip there."""

    clusters: DataFrame
    labels: DataFrame
    strip: DataFrame


def _same_name(display: Column, normalized: Column) -> Column:
    return F.coalesce(normalize_name(display) == normalized, F.lit(False)) & (F.coalesce(display, F.lit("")) != "")


def associate(
    persons: DataFrame, samples: DataFrame, clusters: DataFrame, thr: float = I.PERSON_THRESHOLD, dim: int = I.FACE_DIM
) -> DataFrame:
    """Bind free clusters to their best person at or above thr; unbind owners that fell below.

    Clusters owned by somebody outside `persons` are left alone. Adds `changed`.
    """
    ranked = I.rank_persons(
        Side(clusters, "label", "centroid"), persons, samples, 1, dim, watch="person_profile_id"
    )
    best = ranked.filter("rank = 1").select("label", F.col("person_id").alias("best_id"), F.col("score").alias("best_score"))
    own = ranked.filter("rank is null").select("label", F.col("score").alias("own_score"))
    names = persons.select(F.col("id"), "name", "normalized_name")
    owner = names.toDF("person_profile_id", "owner_name", "owner_key")
    finder = names.toDF("best_id", "best_name", "best_key")
    rows = (
        clusters.join(own, "label", "left").join(best, "label", "left")
        .join(owner, "person_profile_id", "left").join(finder, "best_id", "left")
    )
    current = I.has_dim("centroid", dim)
    held = F.col("owner_name").isNotNull()
    foreign = F.col("person_profile_id").isNotNull() & ~held
    stays = held & (F.coalesce("own_score", F.lit(0.0)) >= thr)
    leaves = held & ~stays
    binds = ~foreign & ~stays & F.coalesce(F.col("best_score") >= thr, F.lit(False))
    owner_id = (
        F.when(~current | foreign | stays, F.col("person_profile_id")).when(binds, F.col("best_id"))
    )
    shown = (
        F.when(~current | foreign, F.col("display_name"))
        .when(stays, F.col("owner_name"))
        .when(binds, F.col("best_name"))
        .when(leaves & _same_name(F.col("display_name"), F.col("owner_key")), None)
        .otherwise(F.col("display_name"))
    )
    return _replace(rows, clusters.columns, owner_id, shown)


def _replace(rows: DataFrame, columns: list[str], owner: Column, shown: Column) -> DataFrame:
    """Set owner and display name at once and flag the rows where either differs."""
    out = rows.withColumns({"_owner": owner, "_shown": shown})
    changed = ~(F.col("_owner").eqNullSafe(F.col("person_profile_id")) & F.col("_shown").eqNullSafe(F.col("display_name")))
    renamed = {"person_profile_id": F.col("_owner"), "display_name": F.col("_shown")}
    return out.select(*[renamed.get(c, F.col(c)).alias(c) for c in columns], changed.alias("changed"))


def _strip_of(persons: DataFrame) -> DataFrame:
    return persons.select("name").filter(F.trim("name") != "").distinct()


def remove_persons(
    ids: DataFrame, persons: DataFrame, samples: DataFrame, clusters: DataFrame
) -> tuple[DataFrame, DataFrame, Change]:
    """Remaining persons and samples, and the cluster change. ids: person_id."""
    gone = persons.join(ids.select(F.col("person_id").alias("id")).distinct(), "id", "left_semi")
    key = gone.select(F.col("id").alias("person_profile_id"), F.col("normalized_name").alias("gone_key"))
    rows = clusters.join(key, "person_profile_id", "left")
    hit = F.col("gone_key").isNotNull()
    shown = F.when(hit & _same_name(F.col("display_name"), F.col("gone_key")), None).otherwise(F.col("display_name"))
    new = _replace(rows, clusters.columns, F.when(~hit, F.col("person_profile_id")), shown)
    left = persons.join(gone.select("id"), "id", "left_anti")
    kept = samples.join(gone.select(F.col("id").alias("person_id")), "person_id", "left_anti")
    return left, kept, Change(new, new.filter("changed").select("label"), _strip_of(gone))


def rename_clusters(clusters: DataFrame, commands: DataFrame) -> DataFrame:
    """commands: seq, label, new_name; the last one of a label counts, a blank name clears, an unknown label is ignored."""
    new = commands.groupBy("label").agg(F.max_by(strip(F.coalesce("new_name", F.lit(""))), "seq").alias("_new"))
    rows = clusters.join(new, "label", "left")
    shown = F.when(F.col("_new").isNull(), F.col("display_name")).otherwise(F.nullif("_new", F.lit("")))
    return _replace(rows, clusters.columns, F.col("person_profile_id"), shown)


def upsert_persons(persons: DataFrame, names: DataFrame) -> DataFrame:
    """New persons for the names nobody has yet. names: seq, name; the first spelling of a name wins.

    The id is derived from the normalised name, so a retried task gives the same person.
    """
    asked = names.select("seq", strip(F.col("name")).alias("name"), normalize_name(F.col("name")).alias("normalized_name"))
    fresh = asked.join(persons.select("normalized_name"), "normalized_name", "left_anti")
    return fresh.groupBy("normalized_name").agg(F.min_by("name", "seq").alias("name")).select(
        F.shiftrightunsigned(F.xxhash64("normalized_name"), 1).alias("id"), "name", "normalized_name"
    )


_START = -(1 << 62)


def settle_renames(persons: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands (seq, person_id, new_name) of known persons, with new_key and whether each is accepted, as if one by one.

    A name is held from the command that claims it until its holder's next accepted command, and at first by
    whoever has it in `persons`. A command is refused while somebody else holds its name. What a command
    meets depends on earlier ones only, so verdicts are taken from name timelines and revised until none
    changes: after each round one more link of every chain of dependent commands is settled.
    """
    asked = commands.select(
        F.col("seq").cast("long").alias("seq"), "person_id", strip(F.col("new_name")).alias("new_name"), normalize_name(F.col("new_name")).alias("new_key")
    ).join(persons.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    asked = I.cut_lineage(asked.withColumn("accepted", F.lit(True)))
    first = persons.select(
        F.lit(_START).alias("seq"), F.col("id").alias("person_id"), F.lit(None).cast("string").alias("new_name"),
        F.col("normalized_name").alias("new_key"), F.lit(True).alias("accepted"),
    )
    place = F.struct("seq", "person_id")
    # the next accepted command of the person ends a claim
    later = W.partitionBy("person_id").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("new_key").orderBy("seq", "person_id").rowsBetween(W.unboundedPreceding, -1)
    while True:
        rows = first.unionByName(asked).withColumn("until", F.last(F.when(F.col("accepted"), place), True).over(later))
        rows = rows.withColumn("held", F.last(F.when(F.col("accepted"), F.struct("person_id", "until")), True).over(earlier))
        free = F.col("held").isNull() | (F.col("held.person_id") == F.col("person_id")) | F.coalesce(F.col("held.until") < place, F.lit(False))
        judged = rows.filter(F.col("seq") > _START).select("seq", "person_id", "new_name", "new_key", free.alias("accepted"), F.col("accepted").alias("before"))
        judged = I.cut_lineage(judged)
        asked = judged.drop("before")
        if judged.filter("accepted <> before").isEmpty():
            return asked


def rename_persons(
    persons: DataFrame, clusters: DataFrame, commands: DataFrame, samples: DataFrame | None = None,
    thr: float = I.PERSON_THRESHOLD, dim: int = I.FACE_DIM,
) -> tuple[DataFrame, DataFrame, Change]:
    """(persons, rejected commands, cluster change). commands: seq, person_id, new_name.

    Commands count in the order of `seq` (then person): a name somebody else holds at that time is refused, a
    name given up by an earlier command is free, and the last accepted command of a person gives its name.
    With `samples` the renamed persons are associated with the clusters again. Clusters they then own take the
    new name where they have none or any name the person had before.
    """
    asked = settle_renames(persons, commands)
    good = asked.filter("accepted")
    new = good.groupBy(F.col("person_id").alias("id")).agg(
        F.max_by(F.struct("new_name", "new_key"), "seq").alias("last"), F.min_by("new_key", "seq").alias("first_key"), F.max("seq").alias("last_seq")
    )
    changed = {"name": F.col("last.new_name"), "normalized_name": F.col("last.new_key")}
    renamed = persons.join(new, "id", "left").select(*[F.coalesce(changed.get(c, F.col(c)), F.col(c)).alias(c) for c in persons.columns])
    # names given up: the first one, and all accepted ones but the last
    was = persons.join(new, "id").select("id", "name", F.col("normalized_name").alias("key"))
    between = good.join(new.select(F.col("id").alias("person_id"), "last_seq"), "person_id").filter(F.col("seq") < F.col("last_seq"))
    was = was.unionByName(between.select(F.col("person_id").alias("id"), F.col("new_name").alias("name"), F.col("new_key").alias("key")))
    bound = clusters
    if samples is not None:
        # a cluster that falls away is judged when the first new name is given
        movers = renamed.join(new.select("id", "first_key"), "id").withColumn("normalized_name", F.col("first_key")).select(*persons.columns)
        bound = associate(movers, samples, clusters, thr, dim).drop("changed")
    given = new.select(F.col("id").alias("person_profile_id"), F.col("last.new_name").alias("new_name"))
    had = was.select(F.col("id").alias("person_profile_id"), F.col("key").alias("shown_key"), F.lit(True).alias("had")).distinct()
    rows = bound.withColumn("shown_key", normalize_name(F.col("display_name"))).join(given, "person_profile_id", "left").join(had, ["person_profile_id", "shown_key"], "left")
    old = F.col("had") | (F.coalesce("display_name", F.lit("")) == "")
    shown = F.when(F.col("new_name").isNotNull() & F.coalesce(old, F.lit(False)), F.col("new_name")).otherwise(F.col("display_name"))
    before = clusters.select("label", F.col("person_profile_id").alias("_owner0"), F.col("display_name").alias("_shown0"))
    synced = rows.withColumn("display_name", shown).join(before, "label").withColumn(
        "changed", ~(F.col("person_profile_id").eqNullSafe(F.col("_owner0")) & F.col("display_name").eqNullSafe(F.col("_shown0")))
    ).select(*clusters.columns, "changed")
    touched = synced.join(given.select("person_profile_id"), "person_profile_id", "left_semi").select("label")
    rejected = asked.filter("not accepted").select("seq", "person_id", "new_name")
    return renamed, rejected, Change(synced, touched.unionByName(synced.filter("changed").select("label")).distinct(), _strip_of(was))


def correction_candidates(
    person_id: int, persons: DataFrame, samples: DataFrame, clusters: DataFrame, stats: DataFrame, limit: int | None = None,
    thr: float = I.PERSON_THRESHOLD, margin: float = I.PERSON_MARGIN, dim: int = I.FACE_DIM,
) -> DataFrame:
    """Clusters with the selected person's score, the best competitor and whether to bind them."""
    usable = clusters.filter(F.size("centroid") > 0).withColumn("_asked", F.lit(person_id))
    ranked = I.rank_persons(Side(usable, "label", "centroid"), persons, samples, 2, dim, watch="_asked")
    scores = ranked.groupBy("label").agg(
        F.max(F.when(F.col("rank").isNull(), F.col("score"))).alias("own"),
        F.max(F.when(F.col("person_id") != person_id, F.when(F.col("rank").isNotNull(), F.col("score")))).alias("other"),
    )
    owner = persons.select(F.col("id").alias("person_profile_id"), F.col("name").alias("current_person_name"))
    own, other = F.coalesce("own", F.lit(0.0)), F.coalesce("other", F.lit(0.0))
    gap = F.round(own - other, 6)
    rows = (
        usable.join(scores, "label", "left")
        .join(stats.select("label", "photo_count"), "label", "left")
        .join(owner, "person_profile_id", "left")
        .select(
            "label", "display_name", "example_photo_id",
            F.coalesce("photo_count", F.lit(0)).alias("photo_count"),
            own.alias("score"), other.alias("competitor_score"), gap.alias("margin"),
            F.when(F.col("current_person_name").isNotNull(), F.col("person_profile_id")).alias("current_person_id"),
            "current_person_name",
            F.coalesce(F.col("person_profile_id") == person_id, F.lit(False)).alias("linked_to_selected_person"),
            ((own >= thr) & (gap >= margin)).alias("recommended"),
            "updated_at", "id",
        )
    )
    best = ["linked_to_selected_person", "recommended", "score", "photo_count", "updated_at", "id"]
    if limit is not None:
        rows = rows.orderBy(*[F.desc(c) for c in best]).limit(limit)
    return rows.drop("updated_at", "id")


def apply_corrections(clusters: DataFrame, persons: DataFrame, commands: DataFrame) -> Change:
    """commands: seq, person_id, action (bind | unbind), labels.

    Commands of unknown persons do nothing. The last bind of a label sets its owner, and only an unbind by
    that person after it frees the label; without a bind, an unbind by the present owner does. Both are
    combinable maxima, so a label with very many commands is reduced before the shuffle.
    """
    odd = F.when(
        F.col("action").isin("bind", "unbind"), F.col("action")
    ).otherwise(F.raise_error(F.concat(F.lit("Unsupported correction action: "), "action")))
    single = commands.select("seq", "person_id", odd.alias("action"), F.explode("labels").alias("label")).withColumn(
        "label", strip(F.col("label"))
    )
    known = persons.select(F.col("id").alias("person_id"), F.col("name").alias("new_name"), F.col("normalized_name").alias("new_key"))
    single = single.join(known, "person_id")
    person = F.struct("person_id", "new_name", "new_key")
    bound = single.filter("action = 'bind'").groupBy("label").agg(F.max_by(person, "seq").alias("bound"), F.max("seq").alias("bound_at"))
    freed = single.filter("action = 'unbind'").groupBy("label", "person_id").agg(F.max("seq").alias("freed_at"), F.any_value("new_key").alias("freed_key"))
    rows = clusters.join(bound, "label", "left").withColumn("holder", F.coalesce("bound.person_id", "person_profile_id"))
    freed = freed.withColumnsRenamed({"label": "freed_label", "person_id": "freed_by"})
    rows = rows.join(freed, (F.col("label") == F.col("freed_label")) & (F.col("holder") == F.col("freed_by")), "left")
    bind = F.col("bound").isNotNull()
    free = F.coalesce(F.col("freed_at") > F.coalesce("bound_at", F.lit(-(1 << 62))), F.lit(False))
    name = F.when(bind, F.col("bound.new_name")).otherwise(F.col("display_name"))
    shown = F.when(~(free & F.coalesce(_same_name(name, F.col("freed_key")), F.lit(False))), name)
    new = _replace(rows, clusters.columns, F.when(~free, F.col("holder")), shown)
    touched = rows.filter(bind | free).select(F.explode(F.array("holder", "person_profile_id")).alias("id"))
    return Change(new, new.filter("changed").select("label"), _strip_of(persons.join(touched, "id", "left_semi")))


def refresh_media(
    photos: DataFrame, clusters: DataFrame, persons: DataFrame, labels: DataFrame, strip_names: DataFrame,
    with_vector: bool = True,
) -> DataFrame:
    """Photos touched by the labels or the stripped names: people without them, names and vector anew."""
    keys = strip_names.select(normalize_name(F.col("name")).alias("key")).distinct()
    said = photos.select("id", F.posexplode("people").alias("pos", "person"))
    said = said.withColumn("key", normalize_name(F.col("person")))
    by_label = lookup(photos.select("id", F.explode("face_clusters").alias("label")), labels, "label").select("id")
    by_name = said.join(keys, "key", "left_semi").select("id")
    touched = photos.join(by_label.unionByName(by_name).distinct(), "id", "left_semi")
    kept = said.join(keys, "key", "left_anti").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "person"))), lambda e: e["person"]).alias("base")
    )
    rows = (
        touched.join(kept, "id", "left")
        .join(I.face_names(touched, clusters, persons), "id", "left")
        .withColumn("people", F.coalesce("base", empty_strings()))
        .withColumn("merged_people", distinct_concat(F.col("people"), F.col("face_names")))
        .drop("base", "face_names")
    )
    if with_vector:
        rows = rows.withColumn("vector", refreshed_vector("merged_people"))
    return rows


def apply_sample_changes(
    commands: DataFrame, persons: DataFrame, samples: DataFrame, clusters: DataFrame,
    thr: float = I.PERSON_THRESHOLD, dim: int = I.FACE_DIM,
) -> tuple[DataFrame, DataFrame, DataFrame, Change]:
    """(samples, persons, rejected commands, cluster change).

    commands: seq, action (add | delete), person_id, sample (struct of the samples columns). An added
    sample needs a vector; a deleted one must belong to the person.
    """
    known = commands.join(persons.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    adds = known.filter((F.col("action") == "add") & (F.size("sample.embedding") > 0))
    drops = known.filter("action = 'delete'").join(
        samples.select(F.col("id").alias("_sid"), F.col("person_id").alias("_pid")),
        (F.col("sample.id") == F.col("_sid")) & (F.col("person_id") == F.col("_pid")),
    )
    done = adds.select("seq").unionByName(drops.select("seq"))
    rejected = commands.join(done, "seq", "left_anti")
    new_samples = samples.join(drops.select(F.col("_sid").alias("id")), "id", "left_anti").select(*samples.columns).unionByName(
        adds.select("sample.*").select(*samples.columns)
    )
    who = known.join(done, "seq", "left_semi").select(F.col("person_id").alias("id")).distinct()
    changed_persons = I.refresh_profiles(persons.join(who, "id", "left_semi"), new_samples, dim)
    new_persons = persons.join(who, "id", "left_anti").select(*persons.columns).unionByName(changed_persons)
    new_clusters = associate(changed_persons, new_samples, clusters, thr, dim)
    owners = who.withColumnRenamed("id", "person_profile_id")
    before = clusters.join(owners, "person_profile_id", "left_semi").select("label")
    after = new_clusters.join(owners, "person_profile_id", "left_semi").select("label")
    labels = before.unionByName(after).distinct()
    return new_samples, new_persons, rejected, Change(new_clusters, labels, _strip_of(persons.join(who, "id", "left_semi")))


def rebuild_index(
    faces: DataFrame, photos: DataFrame, persons: DataFrame, samples: DataFrame,
    cluster_thr: float = I.CLUSTER_THRESHOLD, person_thr: float = I.PERSON_THRESHOLD, dim: int = I.FACE_DIM,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(persons, clusters, photos) with every face clustered and named anew.

    faces: face_id, media_id (a photo id), seq, embedding.
    """
    fresh = I.refresh_profiles(persons, samples, dim)
    formed = I.cut_lineage(I.form_clusters(faces, cluster_thr, dim))
    founders = formed.filter("face_id = root").join(faces, "face_id")
    bare = founders.select(
        "label", F.lit(None).cast("string").alias("display_name"), F.col("embedding").cast("array<double>").alias("centroid"),
        F.lit(None).cast("long").alias("person_profile_id"), F.col("media_id").alias("example_photo_id"),
    )
    members = formed.filter("face_id <> root").join(faces, "face_id")
    folded = I.update_centroids(bare, members).drop("folded", "example_photo_id")
    matches = I.match_persons(Side(faces, "face_id", "embedding"), fresh, samples, person_thr, dim=dim)
    media, changes = I.summarise_faces(faces, formed, matches, bare, fresh)
    clusters = bare.drop("centroid", "display_name", "person_profile_id").join(folded, "label").join(changes, "label", "left")
    known = fresh.select(F.col("normalized_name").alias("key")).distinct()
    said = photos.select("id", F.posexplode("people").alias("pos", "person")).withColumn("key", normalize_name(F.col("person")))
    kept = said.join(known, "key", "left_anti").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "person"))), lambda e: e["person"]).alias("base")
    )
    rows = photos.drop("face_clusters", "face_count").join(media.withColumnRenamed("media_id", "id"), "id", "left").join(kept, "id", "left")
    rows = rows.withColumns(
        {
            "people": F.coalesce("base", empty_strings()),
            "merged_people": distinct_concat(F.col("base"), F.col("names")),
            "face_clusters": F.coalesce("labels", empty_strings()),
            "face_count": F.coalesce("face_count", F.lit(0)),
        }
    ).drop("base", "labels", "names")
    return fresh, clusters, rows


def cleanup_clusters(
    clusters: DataFrame, photos: DataFrame, videos: DataFrame, preferred: DataFrame | None = None
) -> DataFrame:
    """Clusters still on some medium, each with its newest photo as example (none if only on videos).

    With `preferred` only those unused labels are dropped, others stay as they are.
    """
    on_photo = photos.select(F.explode("face_clusters").alias("label"), F.struct("created_at", "id").alias("p"))
    on_video = videos.select(F.explode("face_clusters").alias("label"), F.lit(None).cast(dict(on_photo.dtypes)["p"]).alias("p"))
    used = on_photo.unionByName(on_video).groupBy("label").agg(F.max("p")["id"].alias("newest"))
    rows = clusters.join(used.withColumn("used", F.lit(True)), "label", "left")
    if preferred is None:
        rows = rows.filter("used")
    else:
        rows = rows.join(preferred.select("label", F.lit(True).alias("asked")).distinct(), "label", "left").filter(
            "used or asked is null"
        )
    example = F.when(F.col("used"), F.col("newest")).otherwise(F.col("example_photo_id"))
    return rows.withColumn("example_photo_id", example).select(*clusters.columns)


def _inside(path: Column, root: Column) -> Column:
    bare = F.regexp_replace(root, "/+$", "")
    return (path == bare) | path.startswith(F.concat(bare, F.lit("/")))


def delete_media(media: DataFrame, ids: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining media, file plan). The original goes only if it lies in its source and is no archive copy.

    ids: id, delete_source_file.
    """
    asked = ids.groupBy("id").agg(F.max("delete_source_file").alias("delete_source_file"))
    root = sources.select(F.col("id").alias("source_id"), "root_path")
    plan = (
        media.join(asked, "id").join(root, "source_id", "left")
        .select(
            "id", "storage_path", "original_path", "face_clusters",
            F.coalesce(
                F.col("delete_source_file") & _inside(F.col("original_path"), F.col("root_path"))
                & (F.col("original_path") != F.col("storage_path")),
                F.lit(False),
            ).alias("remove_original"),
        )
    )
    return media.join(asked.select("id"), "id", "left_anti"), plan
