from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenary.operators import hygiene as H
from lumenary.session import materialize


def ratio(a, b):
    if not a or not b:
        return 0.0
    return 1.0 if a == b else SequenceMatcher(a=a, b=b).ratio()


def cos(a, b):
    if not a or not b or len(a) != len(b):
        return 0.0
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / size) if size else 0.0


def hashes(a, b):
    if not a or not b:
        return 0.0
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / (4 * max(len(a), len(b)))


def lengths(a, b):
    return max(0.0, 1 - abs(a - b) / max(a, b)) if a > 0 and b > 0 else 0.0


def score(kind, a, b):
    same = bool(a["name_key"]) and a["name_key"] == b["name_key"]
    name, cap, vec = ratio(a["name_key"], b["name_key"]), ratio(a["caption_key"], b["caption_key"]), cos(a["vector"], b["vector"])
    near = same or name >= 0.94
    if kind == "photo":
        other = hashes(a["phash"], b["phash"])
        gate = vec >= 0.96 or (vec >= 0.92 and other >= 0.84) or (near and (vec >= 0.86 or other >= 0.9 or cap >= 0.88))
        gate = gate or (cap >= 0.9 and vec >= 0.9)
        bonus, weight = (0.16 if same else 0.12 if name >= 0.94 else 0), 0.48
    else:
        other = lengths(a["duration"], b["duration"])
        gate = (vec >= 0.95 and other >= 0.97) or (near and (other >= 0.98 or (vec >= 0.88 and other >= 0.94)))
        gate = gate or (cap >= 0.9 and vec >= 0.9 and other >= 0.94)
        bonus, weight = (0.18 if same else 0.12 if name >= 0.94 else 0), 0.42
    if not gate:
        return 0.0
    return min(max(bonus, 0.08 if cap >= 0.9 else 0) + min(vec, 1) * weight + other * 0.28, 0.985)


def quality(r):
    return tuple(r[c] for c in ("q1", "q2", "q3", "q4", "id"))


def brute(rows, kind):
    """Scores of all duplicate items, block by block, item by item."""
    best = {}
    digests, blocks = {}, {}
    for r in rows:
        digests.setdefault(r["sha256"], []).append(r)
        if r["name_key"]:
            blocks.setdefault(("name", r["name_key"]), []).append(r)
        if r["caption_key"]:
            extra = round(r["duration"], 1) if kind == "video" and r["duration"] > 0 else 0
            blocks.setdefault(("caption", r["caption_key"], extra), []).append(r)
    for group in digests.values():
        for r in sorted(group, key=quality, reverse=True)[1:]:
            best[r["id"]] = 0.99
    for key, group in blocks.items():
        ordered = sorted(group, key=quality, reverse=True)
        for i, r in enumerate(ordered):
            found = next((s for s in (score(kind, r, b) for b in ordered[:i]) if s > 0), 0)
            if found:
                best[r["id"]] = max(best.get(r["id"], 0), found)
    return {k: round(v, 6) for k, v in best.items()}


@pytest.mark.parametrize("kind, chunk", [("photo", 2048), ("photo", 20), ("video", 2048), ("video", 7)])
def test_duplicates_match_brute_force(catalog, kind, chunk):
    media = catalog.photos_with_vector if kind == "photo" else catalog.videos_with_vector
    if kind == "video":  # pages of one length class and one name, so that the gates open
        media = media.withColumns(
            {"duration_seconds": 10 + F.col("id") % 5 / 20, "original_path": F.lit("/v/trip.mp4"), "vector": F.col("vector")}
        )
    rows = [r.asDict() for r in H.prepare(media, kind).collect()]
    got = H.duplicate_candidates(media, kind, None, piece_rows=chunk)
    assert {r["id"]: round(r["score"], 6) for r in got.collect()} == brute(rows, kind)


def near_rows(n):
    """Photos of one name: many equal copies, near captions and near hashes."""
    rng = np.random.default_rng(2)
    out = []
    for i in range(n):
        copy = i % 3 == 0
        vector = [1.0, 0.0, 0.0] if copy else rng.normal(size=3).round(2).tolist()
        caption = "harbour sunset evening boats" if copy else f"harbour sunset evening boat{i % 9} {'x' * (i % 4)}"
        out.append((i, f"/s/trip_{i}.jpg", f"{i % 40:064x}", f"{(i * 2654435761) % 2**64:016x}" if not copy else "ff" * 8, caption, vector, 100 + i * 7 % 50, 100, i % 2))
    return out


def test_hot_block_of_copies(spark):
    rows = near_rows(120)
    df = spark.createDataFrame(
        rows, "id long, original_path string, sha256 string, phash string, caption string, vector array<double>, width int, height int, face_count int"
    ).withColumns({"storage_path": F.col("original_path"), "ocr_text": F.lit(None).cast("string"), "taken_at": F.lit(None).cast("timestamp"), "created_at": F.timestamp_seconds("id")})
    prepared = [r.asDict() for r in H.prepare(df, "photo").collect()]
    got = H.duplicate_candidates(df, "photo", None, piece_rows=16)
    assert {r["id"]: round(r["score"], 6) for r in got.collect()} == brute(prepared, "photo")
    # copies collapse to one representative before any comparison
    stored = materialize(H.prepare(df, "photo"), "p")
    assert H.first_better(H.duplicate_blocks(stored, "photo"), "photo").count() > 0


def test_tenths_round_half_to_even_on_the_binary_value(spark):
    values = [0.15, 0.25, 0.35, 0.45, 1.05, 2.675, 12.0, 59.95, 0.05, 1234.55]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", H.tenths(F.col("v")).alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == {v: int(round(round(v, 1) * 10)) for v in values}


def test_report_categories(catalog):
    report = H.cleanup_report(catalog.photos_with_vector, catalog.videos_with_vector, limit=9)
    counts = {(r["category"], r["total"]): r["count"] for r in report.groupBy("category", "total").count().collect()}
    assert all(n == min(total, 9) for (_, total), n in counts.items())
    with pytest.raises(ValueError):
        H.cleanup_report(catalog.photos, catalog.videos, ["nonsense"])


def test_best_copy_is_never_a_candidate(catalog):
    prepared = H.prepare(catalog.photos_with_vector, "photo")
    worse = H.exact_duplicates(prepared)
    best = prepared.groupBy("sha256").agg(F.max(H.quality_order())["id"].alias("id"))
    assert worse.join(best, "id").count() == 0


def test_rows_of_a_large_block_are_sent_in_proportion(spark):
    from lumenary.functions import gates as G

    def sent(n, piece_rows):
        rows = spark.range(n).select(F.lit("name|b").alias("part"), F.col("id").cast("string").alias("profile"))
        sizes = spark.createDataFrame([("name|b", n)], "part string, n long")
        pieces = G._pieces(rows, sizes, "profile", piece_rows)
        most = pieces.groupBy("piece").count().agg(F.max("count")).first()[0]
        return pieces.count() / n, most

    assert sent(90, 100) == (1, 90)
    assert sent(1_200, 100)[0] == 12
    # tiles grow by then; of 100 rows each there would be 40
    times, most = sent(4_000, 100)
    assert times == 12 and most < 2 * 4 * 100 * 1.3
    assert sent(9_600, 100)[0] == 24


def test_photos_are_joined_without_their_texts(catalog):
    assert not {"caption", "ocr_text"} & set(catalog.photos_to_clean.columns)
    long, short = (H.prepare(m, "photo") for m in (catalog.photos_with_vector, catalog.photos_to_clean))
    assert short.count() > 0 and short.exceptAll(long).isEmpty() and long.exceptAll(short).isEmpty()
    junk = [H.junk_images(m).select("id", "score", "reason") for m in (catalog.photos_with_vector, catalog.photos_to_clean)]
    assert junk[0].exceptAll(junk[1]).isEmpty() and junk[1].exceptAll(junk[0]).isEmpty()


@pytest.mark.parametrize("length", [None, 0.94])
def test_vector_gate_equals_all_pairs_of_its_tiles(spark, length):
    from lumenary.functions import gates as G

    rng = np.random.default_rng(8)
    rows = [
        ("name", "big" if i < 40 else "small", f"p{i}", (float(rng.integers(5)), 0.0, 0.0, 0.0, i), rng.normal(size=3).round(2).tolist(), 10 + i % 7 / 4)
        for i in range(46)
    ]
    df = spark.createDataFrame(
        rows, "kind string, block string, profile string, q struct<q1:double,q2:double,q3:double,q4:double,id:long>, vector array<double>, duration double"
    )
    got = {(r["block"], tuple(r["vector"]), r["duration"] if length else 0): r["lead"]["profile"] for r in G.vector_gate(df, {"name": 0.86}, length, piece_rows=3).collect()}
    want = {}
    for _, block, _, _, v, d in rows:
        near = [r for r in rows if r[1] == block and cos(v, r[4]) >= 0.86 and (length is None or lengths(d, r[5]) >= length)]
        want[block, tuple(v), d if length else 0] = max(near, key=lambda r: r[3])[2]
    assert got == want
    assert any(len({w for k, w in want.items() if k[0] == b}) < n for b, n in (("big", 40), ("small", 6)))
