"""Timelines, files, ingest, corrections and streams on small cases."""

import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenary.functions import image as IM
from lumenary.operators import corrections as C
from lumenary.operators import features as FE
from lumenary.operators import ingest as IN
from lumenary.operators import timelines as TL
from lumenary.operators import tuning as TU
from lumenary.plans import stream_queries as SQ
from lumenary.plans.catalog import DIM, Catalog
from lumenary.session import work_path
from lumenary.sources import files as FS
from lumenary.streaming import watch as WA

# --- timelines --------------------------------------------------------------------------------------


def plain_plan(d, interval, n):
    if d <= 0:
        return [0.0]
    step = max(0.25, interval)
    grid = [float(x) for x in np.arange(0.0, d, step, dtype=np.float32)]
    out, seen = [], set()
    for t in sorted([*grid, 0.0, d * 0.25, d * 0.5, d * 0.75, max(d - 0.5, 0.0)]):
        t = max(0.0, min(t, max(d - 0.05, 0.0)))
        if int(round(t * 20)) not in seen:
            seen.add(int(round(t * 20)))
            out.append(round(t, 3))
    return out[:n]


@pytest.mark.parametrize("interval, n", [(1.0, 24), (0.5, 48), (0.1, 5)])
def test_sample_plan(spark, interval, n):
    durations = [0.0, 0.3, 2.0, 100.0, 7.3, 12.9, 0.04, 3600.0]
    df = spark.createDataFrame(list(enumerate(durations)), "id long, duration_seconds double")
    got = {}
    for r in TL.sample_plan(df, interval, n).orderBy("id", "idx").collect():
        got.setdefault(r["id"], []).append(r["t"])
    assert got == {i: plain_plan(d, interval, n) for i, d in enumerate(durations)}


def test_moments_match_a_greedy_pass(spark):
    rng = random.Random(3)
    rows = [(v, p, round(rng.random() * 30, 1), round(rng.random(), 2), i) for i, (v, p) in enumerate((rng.randint(1, 3), rng.choice("ab")) for _ in range(300))]
    rows += [(9, "a", 0.0, 0.5, 900), (9, "a", 2.0, 0.5, 901), (9, "a", 1.9, 0.5, 902)]
    df = spark.createDataFrame(rows, "video_id long, person_name string, timestamp_seconds double, score double, seq long")
    want = {}
    for key in {(r[0], r[1]) for r in rows}:
        chosen = []
        for r in sorted([r for r in rows if r[:2] == key], key=lambda r: (-r[3], r[4])):
            if all(abs(r[2] - c[2]) >= 2.0 for c in chosen) and len(chosen) < 5:
                chosen.append(r)
        want[key] = [(r[2], r[3], r[4]) for r in sorted(chosen, key=lambda r: r[2])]
    got = {
        (r["video_id"], r["person_name"]): [(m["timestamp_seconds"], m["score"], m["seq"]) for m in r["moments"]]
        for r in TL.select_moments(df, salts=4).collect()
    }
    assert got == want


@pytest.mark.parametrize("gathered", [4_096, 60, 0])
def test_short_lists_of_moments_take_no_rounds(spark, monkeypatch, gathered):
    rng = random.Random(6)
    rows = [(v, p, round(rng.random() * 60, 1), rng.randint(0, 9) / 10, i) for i, (v, p) in enumerate((min(rng.randint(1, 6), 3), rng.choice("ab")) for _ in range(400))]
    rows += [(9, "a", None, 0.5, 900), (9, "a", 2.0, 0.4, 901)]
    df = spark.createDataFrame(rows, "video_id long, person_name string, timestamp_seconds double, score double, seq long")
    want = {}
    for key in {(r[0], r[1]) for r in rows}:
        chosen = []
        for r in sorted([r for r in rows if r[:2] == key], key=lambda r: (-r[3], r[4])):
            if len(chosen) < 5 and all(r[2] is not None and c[2] is not None and abs(r[2] - c[2]) >= 4.0 for c in chosen):
                chosen.append(r)
        want[key] = sorted((r[2], r[3], r[4]) for r in chosen)
    asked, rounds = [], TL._in_rounds
    monkeypatch.setattr(TL, "_in_rounds", lambda found, *more: asked.append(found.count()) or rounds(found, *more))
    monkeypatch.setattr(TL, "GATHERED", gathered)
    got = {(r["video_id"], r["person_name"]): [(m["timestamp_seconds"], m["score"], m["seq"]) for m in r["moments"]] for r in TL.select_moments(df, 4.0, salts=3).collect()}
    assert got == want
    sizes = [sum(r[:2] == key for r in rows) for key in want]
    # only the moments of long lists travel in rounds
    assert sum(asked) == sum(x for x in sizes if x > gathered)


def test_dense_scan_rule(spark):
    cases = [(2.0, 0, []), (2.1, 0, []), (5.9, 3, []), (6.0, 3, []), (11.9, 2, ["a"]), (12.0, 2, ["a"]), (50.0, 3, ["a"])]
    df = spark.createDataFrame(cases, "duration_seconds double, face_count int, names array<string>")
    assert [r["d"] for r in df.select(TL.needs_dense_scan().alias("d")).collect()] == [False, True, False, True, False, True, False]


def test_bands_edges_and_thresholds(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.35, 0.7, 1.0, -0.1)], "score double")
    assert [r["count"] for r in TU.score_bands(df).collect()] == [1, 1, 0, 0, 0, 0, 2]
    assert [r["count"] for r in TU.score_bands(df.limit(0)).collect()] == [0] * 7
    with pytest.raises(ValueError):
        TU.check_thresholds({"face_cluster_similarity_threshold": 1.2})


# --- files and ingest -------------------------------------------------------------------------------


def png(path, pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    part = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    )


def test_images(spark, tmp_path):
    x, y = np.meshgrid(np.arange(40), np.arange(40))
    small = np.stack([(x * 6) % 256, (y * 5) % 256, (x * y) % 256], axis=2).astype(np.uint8)
    big = small.repeat(2, axis=0).repeat(2, axis=1)
    png(tmp_path / "small.png", small)
    png(tmp_path / "big.png", big)
    png(tmp_path / "dot.png", small[:1, :1])
    (tmp_path / "bad.png").write_bytes(b"\x89PNG broken")
    images = FS.read_images(spark, str(tmp_path)).withColumn("name", F.regexp_extract("image.origin", "([a-z]+)[.]png", 1))
    hashed = IM.phash_images(images)
    keys = {r["name"]: r["phash"] for r in hashed.select("name", "phash").collect()}
    assert bin(int(keys["small"], 16) ^ int(keys["big"], 16)).count("1") <= 2 and len(keys["dot"]) == 16
    features = {r["name"]: np.array(r["features"]) for r in IM.image_features(hashed).select("name", "features").collect()}
    assert all(len(v) == 112 for v in features.values())
    assert abs(np.linalg.norm(features["small"]) - 1) < 1e-9 and features["small"] @ features["big"] > 0.98
    sizes = {(r["name"], r["width"], r["height"]) for r in IM.image_meta(images).collect()}
    assert sizes == {("small", 40, 40), ("big", 80, 80), ("dot", 1, 1)}


def test_discovery(spark, tmp_path):
    for i, name in enumerate(["a.JPG", "sub/b.mp4", "sub/c.txt", "d.heic"]):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(name)
        os.utime(path, (1000 + i, 1000 + i))
    got = [(os.path.basename(r["path"]), r["media_kind"]) for r in FS.discover(spark, str(tmp_path)).collect()]
    assert got == [("d.heic", "image"), ("b.mp4", "video"), ("a.JPG", "image")]
    assert FS.discover(spark, str(tmp_path), 1).count() == 1
    with pytest.raises(FileNotFoundError):
        FS.discover(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        FS.scan_sources(spark, [(1, "ftp", str(tmp_path))])


def plain_names(files, existing):
    taken, out = set(existing), {}
    for age, path in files:
        name = path.rsplit("/", 1)[-1]
        stem, dot, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
        target, n = name, 1
        while target in taken:
            target, n = f"{stem}_{n}{dot}{ext}", n + 1
        taken.add(target)
        out[path] = target
    return out


@pytest.mark.parametrize("seed", range(3))
def test_archive_names_equal_one_by_one_handling(spark, seed):
    rng = random.Random(seed)
    names = ["a.jpg", "a.jpg", "a_1.jpg", "a_2.jpg", "a_1_1.jpg", "b", "b_1", "a_01.jpg"]
    files = [(i, f"/in/{i}/{rng.choice(names)}") for i in range(60)]
    existing = [n for n in ["a_3.jpg", "a_1.jpg", "b", "a_1_2.jpg"] if rng.random() < 0.7]
    df = spark.createDataFrame([(p, 10_000 - i) for i, p in files], "path string, t long").select(
        "path", F.timestamp_seconds("t").alias("modificationTime")
    )
    old = spark.createDataFrame([("/arc/d/" + n,) for n in existing] + [("/arc/e/a.jpg",)], "archive_path string")
    got = {r["path"]: r["archive_path"] for r in IN.assign_archive_paths(df, old, "/arc/d").collect()}
    assert got == {p: "/arc/d/" + n for p, n in plain_names(files, existing).items()}


def test_second_ingest_imports_nothing(catalog):
    from lumenary.plans.ingest_queries import batch_files

    files = batch_files(catalog)
    empty = catalog.photos.limit(0)
    first = IN.ingest_batch(files, empty, empty)
    imported = first.filter("outcome = 'imported'")
    assert imported.count() == imported.select("sha256").distinct().count() > 0
    assert IN.ingest_batch(files, imported, empty).filter("outcome = 'imported'").count() == 0


# --- corrections ------------------------------------------------------------------------------------


def test_refresh_without_change_gives_the_same_vector(catalog):
    photos = catalog.photos.join(FE.photo_vectors(catalog.photos), "id")
    nobody = catalog.clusters.withColumns({"display_name": F.lit(None).cast("string"), "person_profile_id": F.lit(None).cast("long")})
    labels = catalog.clusters.select("label")
    rows = C.refresh_media(photos, nobody, catalog.persons, labels, catalog.persons.select("name").limit(0))
    both = rows.select("id", F.col("vector").alias("new")).join(photos.select("id", "vector"), "id").collect()
    assert both and all(np.allclose(r["new"], r["vector"]) for r in both)


def test_sample_changes_reject_the_impossible(spark, catalog):
    persons, samples = catalog.persons, catalog.samples
    one = samples.orderBy("id").first()
    record = F.struct(*[F.col(f"s.{c}").alias(c) for c in samples.columns])
    base = samples.filter(F.col("id") == one["id"]).select(F.struct(*samples.columns).alias("s"))
    gone = base.select(F.lit(1).cast("long").alias("seq"), F.lit("delete").alias("action"), F.lit(one["person_id"]).alias("person_id"), record.alias("sample"))
    wrong = gone.withColumns({"seq": F.lit(2).cast("long"), "person_id": F.lit(one["person_id"] % 10 + 1)})
    faceless = gone.withColumns(
        {"seq": F.lit(3).cast("long"), "action": F.lit("add"), "sample": F.col("sample").withField("embedding", F.array().cast("array<float>"))}
    )
    commands = gone.unionByName(wrong).unionByName(faceless)
    new_samples, new_persons, rejected, _ = C.apply_sample_changes(commands, persons, samples, catalog.clusters, 0.3, DIM)
    assert sorted(r["seq"] for r in rejected.collect()) == [2, 3]
    assert new_samples.count() == samples.count() - 1 and new_persons.count() == persons.count()


def test_rebuild_index_covers_every_face(catalog):
    persons, clusters, photos = C.rebuild_index(catalog.faces, catalog.photos, catalog.persons, catalog.samples, 0.3, 0.3, DIM)
    found = {label for r in photos.select("face_clusters").collect() for label in r["face_clusters"]}
    assert found <= {r["label"] for r in clusters.select("label").collect()}
    assert not [p for r in photos.select("people").collect() for p in r["people"] if p.startswith("person ")]


# --- streams ----------------------------------------------------------------------------------------


def test_online_clusters_follow_arrival_order(spark, catalog):
    from lumenary.plans.stream_queries import online

    got = {r["face_id"]: r["label"] for r in online(catalog).collect()}
    want, shards = {}, {}
    for r in catalog.vectors.orderBy("vec_id").collect():
        known = shards.setdefault(r["vec_id"] % 4, [])
        face = np.array(r["embedding"], dtype=float)
        scores = [float(c @ face / (np.linalg.norm(c) * np.linalg.norm(face))) for _, c in known]
        if scores and max(scores) >= 0.3:
            at = int(np.argmax(scores))
            merged = 0.7 * known[at][1] + 0.3 * face
            known[at] = (known[at][0], np.round(merged / np.linalg.norm(merged), 6))
        else:
            at = len(known)
            known.append((r["vec_id"], face))
        want[r["vec_id"]] = known[at][0]
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups(want)


def test_debounce_bursts(spark):
    base = 1_700_000_000
    rows = [(1, "/a.jpg", base), (1, "/b.jpg", base + 2), (1, "/a.jpg", base + 6), (2, "/c.jpg", base + 1)]
    df = spark.createDataFrame(rows, "source_id long, path string, t long").withColumn("ts", F.timestamp_seconds("t"))
    for size in (1, 4, 86_400):
        got = sorted((r["source_id"], r["path"], (r["flushed_at"] - r["opened_at"]).seconds) for r in WA.debounce_batch(df, 3.0, size).collect())
        assert got == [(1, "/a.jpg", 3), (1, "/a.jpg", 5), (1, "/b.jpg", 5), (2, "/c.jpg", 3)]


def test_moves_folders_and_other_files(spark):
    rows = [(1, "/a.tmp", "/a.jpg", False), (1, "/b", None, True), (1, "/c.txt", None, False), (1, "/d.png", "", False)]
    df = spark.createDataFrame(rows, "source_id long, src_path string, dest_path string, is_directory boolean").withColumn("ts", F.current_timestamp())
    assert sorted(r["path"] for r in WA.normalise_events(df).collect()) == ["/a.jpg", "/d.png"]


def test_stream_of_a_table_in_parts(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 30}") for i in range(50)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = SQ.dedupe_stream(Catalog(spark, str(tmp_path))).collect()
    assert len(got) == len(set(got)) == 30


def test_stream_ingest_resumes(spark, tmp_path):
    root, out, checkpoint = tmp_path / "in", work_path(spark, "ingest"), work_path(spark, "checkpoint")
    root.mkdir()
    none = spark.createDataFrame([], "sha256 string")

    def go():
        files = FS.with_sha256(WA.watch_files(spark, str(root))).withColumns({"source_id": F.lit(1).cast("long")})
        WA.stream_ingest(files, none, none, out, checkpoint).awaitTermination()
        rows = spark.read.parquet(out + "/files").collect()
        return sorted((os.path.basename(r["path"]), r["outcome"]) for r in rows)

    (root / "a.jpg").write_text("one")
    assert go() == [("a.jpg", "imported")]
    (root / "b.jpg").write_text("one")
    (root / "c.mp4").write_text("two")
    assert go() == [("a.jpg", "imported"), ("b.jpg", "duplicate"), ("c.mp4", "imported")]
    assert go() == [("a.jpg", "imported"), ("b.jpg", "duplicate"), ("c.mp4", "imported")]
    jobs = {r["batch"]: (r["scanned_count"], r["imported_count"], r["duplicate_count"]) for r in spark.read.parquet(out + "/jobs").collect()}
    assert jobs == {0: (1, 1, 0), 1: (2, 1, 1)}


# --- commands that meet on one key -------------------------------------------------------------------


def _people(spark):
    persons = spark.createDataFrame([(1, "Ann", "ann"), (2, "Ann Lee", "ann lee")], "id long, name string, normalized_name string")
    clusters = spark.createDataFrame(
        [(1, "a", None, None), (2, "b", "Ann Lee", 2), (3, "c", "Ann", 1)], "id long, label string, display_name string, person_profile_id long"
    )
    return persons, clusters


@pytest.mark.parametrize(
    "commands, owner, shown",
    [
        ([(1, 1, "bind", "b"), (2, 2, "unbind", "b")], 1, "Ann"),  # the former owner no longer holds it
        ([(1, 1, "bind", "b"), (2, 9, "bind", "b")], 1, "Ann"),  # nobody knows person 9
        ([(1, 1, "bind", "b"), (2, 1, "unbind", "b")], None, None),
        ([(1, 1, "unbind", "b"), (2, 1, "bind", "b")], 1, "Ann"),
        ([(1, 2, "unbind", "b")], None, None),
        ([(1, 1, "unbind", "b")], 2, "Ann Lee"),
        ([(1, 2, "unbind", "b"), (2, 1, "bind", "b"), (3, 2, "bind", "b")], 2, "Ann Lee"),
    ],
)
def test_corrections_in_order(spark, commands, owner, shown):
    persons, clusters = _people(spark)
    df = spark.createDataFrame([(s, p, a, [x]) for s, p, a, x in commands], "seq long, person_id long, action string, labels array<string>")
    rows = {r["label"]: r for r in C.apply_corrections(clusters, persons, df).clusters.collect()}
    assert len(rows) == 3
    assert (rows["b"]["person_profile_id"], rows["b"]["display_name"]) == (owner, shown)


def test_photos_of_a_person_whose_name_holds_another(spark, catalog):
    from lumenary.operators import search as S

    persons, clusters = _people(spark)
    at = F.timestamp_seconds(F.lit(0))
    persons = persons.withColumns({"updated_at": at, "created_at": at})
    clusters = clusters.withColumns({"updated_at": at, "created_at": at})
    photos = catalog.photos_with_text_vector.filter("id < 6").withColumn("face_clusters", F.array(F.lit("b")))
    assert S.photos_of_person(photos, clusters, persons, 2).count() == 6


def test_last_rename_of_a_label_counts(spark):
    _, clusters = _people(spark)
    commands = spark.createDataFrame([(2, "a", " New "), (1, "a", "Old"), (1, "b", "x"), (2, "b", " "), (1, "zz", "y")], "seq long, label string, new_name string")
    rows = [(r["label"], r["display_name"]) for r in C.rename_clusters(clusters, commands).collect()]
    assert sorted(rows) == [("a", "New"), ("b", None), ("c", "Ann")]


def test_upsert_takes_one_row_of_a_key(spark):
    base = spark.createDataFrame([(1, "x"), (2, "y")], "id long, caption string")
    twice = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "first", 1)], "id long, caption string, seq long")
    assert sorted(map(tuple, IN.upsert(base, twice, "id", order="seq").collect())) == [(1, "x"), (2, "new"), (3, "first")]
    with pytest.raises(Exception, match="several updates of one id"):
        IN.upsert(base, twice, "id").collect()


def test_a_shared_folder_is_needed_on_a_cluster():
    from lumenary.session import is_single_process

    assert is_single_process("local[8]") and is_single_process("local")
    assert not is_single_process("local-cluster[3,2,1024]") and not is_single_process("yarn")


@pytest.mark.parametrize(
    "commands, names, refused",
    [
        ([(1, 1, "Cara"), (2, 1, "Dora")], {1: "Dora", 2: "Ann Lee"}, []),  # two commands for one person
        ([(1, 1, "Cara"), (2, 2, "Ann")], {1: "Cara", 2: "Ann"}, []),  # a name given up is free
        ([(1, 2, "Ann"), (2, 1, "Cara")], {1: "Cara", 2: "Ann Lee"}, [1]),  # but not before
        ([(1, 1, "Cara"), (2, 2, " CARA "), (3, 1, "Eve"), (4, 2, "cara")], {1: "Eve", 2: "cara"}, [2]),
        ([(1, 1, "ann LEE"), (2, 2, "Ann  Lee"), (3, 9, "Zed")], {1: "Ann", 2: "Ann  Lee"}, [1]),
        ([(1, 1, "b"), (2, 2, "ann"), (3, 1, "ann"), (4, 2, "c"), (5, 1, "Ann")], {1: "Ann", 2: "c"}, [3]),
    ],
)
def test_renames_in_order(spark, commands, names, refused):
    persons, clusters = _people(spark)
    df = spark.createDataFrame(commands, "seq long, person_id long, new_name string")
    renamed, rejected, change = C.rename_persons(persons, clusters, df)
    assert {r["id"]: r["name"] for r in renamed.collect()} == names and renamed.count() == 2
    assert sorted(r["seq"] for r in rejected.collect()) == refused
    assert change.clusters.count() == 3


def test_names_of_clusters_follow_a_chain_of_renames(spark):
    persons, _ = _people(spark)
    clusters = spark.createDataFrame(
        [("a", None, 1), ("b", "Ann", 1), ("c", "Cara", 1), ("d", "Other", 1), ("e", "Ann", 2), ("f", "Dora", 1)], "label string, display_name string, person_profile_id long"
    )
    df = spark.createDataFrame([(1, 1, "Cara"), (2, 1, "Dora")], "seq long, person_id long, new_name string")
    change = C.rename_persons(persons, clusters, df)[2]
    assert {r["label"]: r["display_name"] for r in change.clusters.collect()} == {"a": "Dora", "b": "Dora", "c": "Dora", "d": "Other", "e": "Ann", "f": "Dora"}
    assert {r["label"] for r in change.labels.collect()} == set("abcdf") and {r["name"] for r in change.strip.collect()} == {"Ann", "Cara"}


def test_a_file_that_two_sources_list_is_imported_once(spark):
    rows = [("/a.jpg", 1, 5), ("/a.jpg", 2, 5), ("/b.jpg", 2, 9)]
    files = spark.createDataFrame(rows, "path string, source_id long, t long").select(
        "path", "source_id", F.timestamp_seconds("t").alias("modificationTime"), F.lit("image").alias("media_kind"), F.sha2("path", 256).alias("sha256")
    )
    none = spark.createDataFrame([], "sha256 string")
    got = sorted((r["path"], r["source_id"], r["outcome"]) for r in IN.ingest_batch(files, none, none).collect())
    assert got == [("/a.jpg", 1, "imported"), ("/a.jpg", 2, "duplicate"), ("/b.jpg", 2, "imported")]


def test_a_name_with_many_taken_numbers(spark):
    old = spark.range(100_000).filter("id % 2 = 1").select(F.concat(F.lit("/d/a_"), "id", F.lit(".jpg")).alias("archive_path"))
    old = old.unionByName(spark.createDataFrame([("/d/a.jpg",)], "archive_path string"))
    files = spark.range(60_000).select(F.concat(F.lit("/in/"), "id", F.lit("/a.jpg")).alias("path"), F.timestamp_seconds(-F.col("id")).alias("modificationTime"))
    rows = IN.assign_archive_paths(files, old, "/d").select(
        F.regexp_extract("path", "/in/([0-9]+)/", 1).cast("long").alias("i"), F.regexp_extract("archive_path", "a_([0-9]+)", 1).cast("long").alias("n")
    )
    # even numbers are free below 100,000, all of them after it
    want = F.when(F.col("i") < 49_999, 2 * F.col("i") + 2).otherwise(F.col("i") + 50_001)
    assert rows.count() == 60_000 and rows.filter(F.col("n") != want).count() == 0


def test_names_in_long_texts(spark):
    import time

    from lumenary.operators import search as S

    names = [f"Person Number{i} {'xyz'[i % 3]}" for i in range(50)] + ["Al", "é"]
    persons = spark.createDataFrame([(i, n, n.lower(), i) for i, n in enumerate(names)], "id long, name string, normalized_name string, u long").withColumn("updated_at", F.timestamp_seconds("u"))
    rng = random.Random(2)
    texts = [("".join(rng.choice("abcdefgh nump") for _ in range(20_000)) + " PERSON number7 y"), "", None, "al", "fé", "person number1", "nobody"]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    S.detect_people(df, persons).collect()
    began = time.time()
    got = {r["query_id"]: r["names"] for r in S.detect_people(df, persons).collect()}
    taken = time.time() - began
    order = [n for n in reversed(names)]
    assert got == {i: f for i, t in enumerate(texts) if (f := [n for n in order if n.lower() in (t or "").strip().lower()])}
    assert taken < 10


def test_stretches_without_a_name_are_not_shuffled(spark, monkeypatch):
    from lumenary.operators import search as S

    persons = spark.createDataFrame([(1, "Ann 😀 Lee", 1), (2, "Bo", 2), (3, "Cy\nD", 3)], "id long, name string, u long").withColumns(
        {"normalized_name": F.lower("name"), "updated_at": F.timestamp_seconds("u")}
    )
    letters = random.Random(5)
    rows = [(i, "".join(letters.choice("efghijkm 😀") for _ in range(400)) + ("x ann 😀 lee" if i % 50 == 0 else "cy\nd bo" if i % 50 == 1 else "")) for i in range(500)]
    texts = spark.createDataFrame(rows, "query_id long, text string")
    want = {i: ["Ann 😀 Lee"] for i in range(0, 500, 50)} | {i: ["Cy\nD", "Bo"] for i in range(1, 500, 50)}
    found = S.detect_people(texts, persons)
    assert {r["query_id"]: r["names"] for r in found.collect()} == want
    # the stretches meet the anchors before any exchange
    plan = found._jdf.queryExecution().sparkPlan().toString()
    at = plan.index("Generate explode")
    assert "BroadcastHashJoin" in plan[:at] and "HashAggregate" not in plan[at:].split("Generate explode")[1].split("LocalTableScan")[0]
    monkeypatch.setattr(S, "SENT_NAMES", 0)
    assert {r["query_id"]: r["names"] for r in S.detect_people(texts, persons).collect()} == want


def test_bursts_stay_open_across_batches(spark, tmp_path):
    import pandas as pd

    from lumenary.plans.stream_queries import stored

    base = 1_700_000_000
    parts = [
        [(1, "/a.jpg", 0), (1, "/b.jpg", 2), (2, "/z.jpg", 0)],
        [(1, "/a.jpg", 4), (1, "/late.jpg", 12), (1, "/c.jpg", 9)],  # 4 joins the open burst, 9 and 12 don't touch yet
        [(1, "/mid.jpg", 10), (1, "/a.jpg", 60)],  # 10 joins 9 and 12
        [(1, "/end.jpg", 200)], [(3, "/far.jpg", 400)],
    ]
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    kind = "source_id long, path string, ts timestamp"
    with stored(type("c", (), {"spark": spark})):
        for n, part in enumerate(parts):
            frame = pd.DataFrame(part, columns=["source_id", "path", "t"])
            frame["ts"] = pd.to_datetime(frame.pop("t") + base, unit="s").astype("datetime64[us]")
            frame.to_parquet(folder / f"{n}.parquet", coerce_timestamps="us")
            stream = WA.debounce(spark.readStream.schema(kind).parquet(str(folder)), 3.0)
            stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    got = sorted((r["source_id"], int(r["opened_at"].timestamp()) - base, (r["flushed_at"] - r["opened_at"]).seconds, r["path"]) for r in spark.read.parquet(out).collect())
    every = spark.createDataFrame([(s, p, base + t) for part in parts for s, p, t in part], "source_id long, path string, t long").withColumn("ts", F.timestamp_seconds("t"))
    want = sorted((r["source_id"], int(r["opened_at"].timestamp()) - base, (r["flushed_at"] - r["opened_at"]).seconds, r["path"]) for r in WA.debounce_batch(every).collect())
    assert got == [w for w in want if w[1] < 380]  # the last burst is open


def test_a_batch_reads_only_the_parts_of_its_digests(spark, tmp_path):
    out = str(tmp_path / "out")
    none = spark.createDataFrame([], "sha256 string")

    def files(names):
        return spark.createDataFrame([(n,) for n in names], "path string").select(
            "path", F.lit(1).cast("long").alias("source_id"), F.timestamp_seconds(F.lit(0)).alias("modificationTime"), F.lit(b"x").alias("content"),
            F.sha2(F.regexp_replace("path", "^/[a-z]+/", ""), 256).alias("sha256"),
        )

    WA.ingest_micro_batch(files([f"/one/{i}.jpg" for i in range(40)]), 0, none, none, out)
    second = files(["/two/3.jpg", "/two/new.jpg"])
    known = WA.taken_digests(spark, out, 1, second.select("sha256"))
    wanted = {r[0][:2] for r in second.select("sha256").collect()}
    assert {f.split("prefix=")[1][:2] for f in known.inputFiles()} <= wanted
    for _ in range(2):  # a repeated batch overwrites itself and isn't its own duplicate
        WA.ingest_micro_batch(second, 1, none, none, out)
        rows = {r["path"]: r["outcome"] for r in spark.read.parquet(f"{out}/files/batch=1").collect()}
        assert rows == {"/two/3.jpg": "duplicate", "/two/new.jpg": "imported"}
