import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenary.functions import blockmatch as bm
from lumenary.functions import gates as G
from lumenary.functions import pivots as P
from lumenary.functions import vector as V
from lumenary.functions.blockmatch import Side
from lumenary.operators import identity as I
from lumenary.session import cut_lineage

DIM = 8


def vectors(spark, n, seed, name="id", copies=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=DIM).round(3).tolist(), i % 7) for i in range(n)]
    rows += [(n + i, rows[0][1], 3) for i in range(copies)]
    return spark.createDataFrame(rows, f"{name} long, vec array<double>, t long"), rows


def unit(v):
    v = np.array(v)
    return v / np.linalg.norm(v)


def brute(left, right, k, floor):
    out = set()
    for key, v, _ in left:
        scored = [(round(float(unit(v) @ unit(w)), 6), t, rk) for rk, w, t in right]
        top = sorted([s for s in scored if s[0] >= floor], reverse=True)[:k]
        out |= {(key, rk, s, i + 1) for i, (s, _, rk) in enumerate(top)}
    return out


@pytest.mark.parametrize("limit, rows", [(1000, 100), (60, 100), (5, 16)])
def test_nearest_is_the_same_on_all_three_ways(spark, limit, rows):
    left, lrows = vectors(spark, 50, 1, "lid", copies=5)
    right, rrows = vectors(spark, 70, 2, "rid", copies=9)
    got = bm.nearest(
        Side(left, "lid", "vec"), Side(right, "rid", "vec", "t"), dim=DIM, k=3, floor=0.1, broadcast_rows=limit, block_rows=rows
    )
    assert {tuple(r) for r in got.collect()} == brute(lrows, rrows, 3, 0.1)


@pytest.mark.parametrize("tile, piece, block", [(32_768, 65_536, 1_024), (7, 9, 4)])
@pytest.mark.parametrize("metric, floor", [("cosine", 1e-6), ("dot", float("-inf"))])
def test_copies_are_matched_once_in_tiles(spark, monkeypatch, tile, piece, block, metric, floor):
    rng = np.random.default_rng(21)
    kinds = [rng.normal(size=DIM).round(1) for _ in range(25)]
    rows = [(f"k{i:03}", kinds[i % 25 if i % 4 else 3].tolist(), i % 3) for i in range(200)] + [("other", [1.0], 1)]
    df = spark.createDataFrame(rows, "id string, vec array<double>, t long").repartition(6)
    side, sent = Side(df, "id", "vec", "t"), []
    whole = bm._pass_tiles
    monkeypatch.setattr(bm, "_pass_tiles", lambda *a, **kw: sent.append(1) or whole(*a, **kw, tile_rows=tile, slice_rows=piece))
    got = bm.nearest(side, side, dim=DIM, k=4, floor=floor, metric=metric, skip_self=True, broadcast_rows=0, block_rows=block)
    near = bm.nearest(side, side, dim=DIM, k=4, floor=floor, metric=metric, skip_self=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, near.collect())) and sent


def test_rows_of_other_length_take_no_part(spark):
    df = spark.createDataFrame([(1, [1.0] * DIM), (2, [1.0]), (3, None)], "id long, vec array<double>")
    got = bm.nearest(Side(df, "id", "vec"), Side(df, "id", "vec"), dim=DIM)
    assert [tuple(r)[:2] for r in got.collect()] == [(1, 1)]


def components(rows, floor):
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            if round(float(unit(a[1]) @ unit(b[1])), 6) >= floor:
                x, y = find(a[0]), find(b[0])
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in parent}


@pytest.mark.parametrize("block", [1000, 16])
@pytest.mark.parametrize("floor", [0.6, 0.75, 0.999])
def test_clusters_are_connected_components(spark, block, floor):
    df, rows = vectors(spark, 60, 3, "face_id", copies=30)
    faces = df.withColumnRenamed("vec", "embedding")
    got = I.form_clusters(faces, floor, DIM, block_rows=block)
    assert {r["face_id"]: r["root"] for r in got.collect()} == components(rows, floor)


@pytest.mark.parametrize("blocks", [1, 20])
def test_forest_of_one_dense_component(spark, blocks):
    df, _ = vectors(spark, 1, 5, "face_id", copies=400)
    n = df.count()
    edges = bm.forest_edges(Side(df, "face_id", "vec"), dim=DIM, floor=0.9, block_rows=-(-n // blocks))
    assert n - blocks <= edges.count() <= n + blocks * (blocks - 1) // 2
    assert {r["root"] for r in bm.components(edges, "long", cut_lineage).collect()} == {df.agg(F.min("face_id")).first()[0]}


def test_small_blocks_dont_multiply_what_clusters_send(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=DIM).tolist()) for i in range(600)] + [(700 + i, [0.0] * DIM) for i in range(3)]
    df = spark.createDataFrame(rows, "face_id long, embedding array<double>")
    for sizes in ({"block_rows": 16}, {"block_rows": 16, "tile_rows": 40}):
        got = I.form_clusters(df, 0.85, DIM, **sizes)
        assert {r["face_id"]: r["root"] for r in got.collect()} == components(rows, 0.85)
    sizes = []
    reached, bm.pivots.homes = bm.pivots.homes, lambda *a, **k: sizes.append(k["rows"]) or reached(*a, **k)
    try:
        bm.forest_edges(Side(df, "face_id", "embedding"), dim=DIM, floor=0.85, block_rows=16)
    finally:
        bm.pivots.homes = reached
    assert sizes == [bm.TILE_ROWS]


def test_long_chain_components(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = bm.components(edges, "long", cut_lineage).collect()
    assert len(got) == 300 and {r["root"] for r in got} == {0}


@pytest.mark.parametrize("limit, block", [(10_000, 100), (1, 12)])
def test_person_ranking_with_a_person_split_over_blocks(spark, limit, block):
    rng = np.random.default_rng(8)
    faces = [(i, rng.normal(size=DIM).tolist(), i % 4 + 1) for i in range(25)]
    samples = [(i, 1 if i < 30 else i % 4 + 2, rng.normal(size=DIM).tolist()) for i in range(50)]
    persons = [(p, f"P{p}", None if p == 5 else rng.normal(size=DIM).tolist(), p % 2) for p in range(1, 8)]
    fdf = spark.createDataFrame(faces, "face_id long, embedding array<double>, owner long")
    sdf = spark.createDataFrame(samples, "id long, person_id long, embedding array<double>")
    pdf = spark.createDataFrame(persons, "id long, name string, centroid array<double>, u long").withColumn(
        "updated_at", F.timestamp_seconds("u")
    )
    got = I.rank_persons(Side(fdf, "face_id", "embedding"), pdf, sdf, 3, DIM, "owner", limit, block)
    want = set()
    for key, v, owner in faces:
        scores = []
        for pid, _, c, u in persons:
            central = float(unit(v) @ unit(c)) if c else 0.0
            best = sorted((float(unit(v) @ unit(s)) for _, q, s in samples if q == pid), reverse=True)[:3]
            score = max(central, 0.45 * best[0] + 0.35 * sum(best) / len(best) + 0.2 * central) if best else central
            scores.append((round(score, 6), u, pid))
            if pid == owner:
                want.add((key, pid, round(score, 6), None))
        top = sorted([s for s in scores if s[0] > 0], reverse=True)[:3]
        want |= {(key, pid, s, i + 1) for i, (s, _, pid) in enumerate(top)}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("block, tile, piece", [(8, 16_384, 65_536), (7, 6, 40), (5, 9, 11)])
def test_person_ranking_in_tiles_by_text_keys(spark, block, tile, piece):
    rng = np.random.default_rng(12)
    faces = [(f"face-{i}", rng.normal(size=DIM).tolist(), i % 3 + 1) for i in range(30)] + [("short", [1.0], 1)]
    samples = [(i, 1 + (0 if i < 40 else 1 + i % 12), rng.normal(size=DIM).tolist()) for i in range(120)]
    persons = [(p, f"P{p}", None if p % 5 == 0 else rng.normal(size=DIM).tolist(), p % 2) for p in range(1, 15)]
    fdf = spark.createDataFrame(faces, "label string, embedding array<double>, owner long").repartition(3)
    sdf = spark.createDataFrame(samples, "id long, person_id long, embedding array<double>").repartition(5)
    pdf = spark.createDataFrame(persons, "id long, name string, centroid array<double>, u long").withColumn(
        "updated_at", F.timestamp_seconds("u")
    )
    side = Side(fdf, "label", "embedding")
    got = I.rank_persons(side, pdf, sdf, 3, DIM, "owner", 1, block, tile, piece)
    want = I.rank_persons(side, pdf, sdf, 3, DIM, "owner")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 30 * 4


def test_margin_rule(spark):
    ranked = [(1, 1, 0.6, 1), (2, 1, 0.6, 1), (2, 2, 0.56, 2), (3, 1, 0.6, 1), (3, 2, 0.5601, 2), (4, 1, 0.51, 1)]
    df = spark.createDataFrame(ranked, "face_id long, person_id long, score double, rank int")
    top = I.top_two(df, "face_id")
    clear = (F.col("second") <= 0) | (F.round(F.col("score") - F.col("second"), 6) >= 0.04)
    assert {r["face_id"] for r in top.filter((F.col("score") >= 0.52) & clear).collect()} == {1, 2}


def test_centroid_fold_keeps_order(spark):
    base = [1.0, 0.0]
    faces = [(1, [0.0, 1.0]), (2, [0.6, 0.8]), (3, [1.0, 0.0])]
    clusters = spark.createDataFrame([("a", base, None), ("b", base, 7)], "label string, centroid array<double>, example_photo_id long")

    def fold(order):
        c = np.array(base)
        for i in order:
            c = 0.7 * c + 0.3 * np.array(faces[i][1])
            c = np.round(c / np.linalg.norm(c), 6)
        return c.tolist()

    for order in ([0, 1, 2], [2, 1, 0]):
        rows = [("a", seq, faces[i][0], 10 + i, faces[i][1]) for seq, i in enumerate(order)]
        df = spark.createDataFrame(rows, "label string, seq long, face_id long, media_id long, embedding array<double>")
        got = {r["label"]: r for r in I.update_centroids(clusters, df).collect()}
        assert got["a"]["centroid"] == fold(order) and got["a"]["example_photo_id"] == 10 + order[0] and got["a"]["folded"] == 3
        assert got["b"]["centroid"] == base and got["b"]["example_photo_id"] == 7 and got["b"]["folded"] == 0


def test_vector_edges(spark):
    rows = [([], [1.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 2.0]), ([1.0, 1.0], [-1.0, -1.0]), (None, [1.0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<double>, b array<double>")
    got = [round(r["s"], 9) for r in df.select("i", V.cosine(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert got == [0.0, 0.0, 0.0, -1.0, 0.0]
    hashes = [("ff00", "ff00"), ("ff00", "ff01"), ("f", "ff00"), ("zz", "ff"), (None, "ff"), ("", "ff")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(hashes)], "i int, a string, b string")
    got = [r["s"] for r in df.select("i", V.phash_similarity(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert got == [1.0, 1 - 1 / 16, 1 - 12 / 16, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(["8f", "xyz", None])], "i int, h string")
    bits = [r["b"] for r in df.select("i", V.phash_bits(F.col("h")).alias("b")).orderBy("i").collect()]
    assert bits[0][:8] == [1.0, -1.0, -1.0, -1.0, 1.0, 1.0, 1.0, 1.0] and set(bits[0][8:]) == {-1.0}
    assert bits[1] == bits[2] == [0.0] * 64


def test_suppression_matches_a_restatement(spark):
    from lumenary.operators.detections import nms

    rng = random.Random(4)
    rows = [
        (i // 20, i, float(x := rng.randint(0, 60)), float(y := rng.randint(0, 60)), float(x + rng.randint(5, 40)), float(y + rng.randint(5, 40)), rng.random())
        for i in range(100)
    ]
    df = spark.createDataFrame(rows, "media_id long, face_id long, x1 double, y1 double, x2 double, y2 double, det_score double")
    want = set()
    for image in range(5):
        kept = []
        for r in sorted([r for r in rows if r[0] == image], key=lambda r: -r[6]):
            def iou(a, b):
                w = max(0, min(a[4], b[4]) - max(a[2], b[2]) + 1)
                h = max(0, min(a[5], b[5]) - max(a[3], b[3]) + 1)
                area = lambda q: (q[4] - q[2] + 1) * (q[5] - q[3] + 1)
                return w * h / (area(a) + area(b) - w * h)

            if all(iou(r, k) <= 0.3 for k in kept):
                kept.append(r)
        want |= {r[1] for r in kept}
    assert {r["face_id"] for r in nms(df, 0.3).collect()} == want


def test_pivots_skip_blocks_of_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(12, DIM))
    rows = [(i, (heads[i % 12] + rng.normal(size=DIM) * 0.05).tolist(), 0) for i in range(600)]
    df = spark.createDataFrame(rows, "lkey long, lvec array<double>, t long")
    pivots = P.choose(df, "lkey", "lvec", DIM, 50)
    placed, reach = P.homes(df.select("lkey", "lvec"), dim=DIM, floor=0.95, rows=50)
    blocks = int(pivots.pieces.sum())
    assert pivots.count.sum() == 600 and blocks >= 12
    met = reach(placed).count()
    assert met < 0.3 * 600 * (blocks - 1)  # the others can't hold a neighbour, and are skipped
    # and nothing is lost
    got = I.form_clusters(df.select(F.col("lkey").alias("face_id"), F.col("lvec").alias("embedding")), 0.95, DIM, block_rows=50)
    assert {r["face_id"]: r["root"] for r in got.collect()} == components(rows, 0.95)


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_pivot_blocks_give_the_best_of_all(spark, metric):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=DIM) * rng.choice([0.2, 1, 5])).tolist(), i % 3) for i in range(300)] + [(400, [0.0] * DIM, 1)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, t long")
    side = Side(df, "id", "vec", "t")
    got = bm.nearest(side, side, dim=DIM, k=2, floor=float("-inf"), metric=metric, skip_self=True, broadcast_rows=0, block_rows=20)
    near = bm.nearest(side, side, dim=DIM, k=2, floor=float("-inf"), metric=metric, skip_self=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, near.collect()))


@pytest.mark.parametrize("window", [1, 4, 128])
def test_bounded_history_gives_the_full_fold(spark, window):
    rng = np.random.default_rng(9)
    unit_ = lambda v: v / np.linalg.norm(v)
    heads = {"a": unit_(rng.normal(size=DIM)), "b": unit_(rng.normal(size=DIM)), "c": unit_(rng.normal(size=DIM))}
    faces = [(label, i, i, i, unit_(heads[label] + rng.normal(size=DIM) * 0.2).tolist()) for label, n in (("a", 700), ("b", 3)) for i in range(n)]
    clusters = spark.createDataFrame([(k, v.tolist(), None) for k, v in heads.items()], "label string, centroid array<double>, example_photo_id long")
    df = spark.createDataFrame(faces + [("a", 9_000, 9_000, 9_000, [1.0]), ("zz", 1, 1, 1, [1.0] * DIM)], "label string, seq long, face_id long, media_id long, embedding array<double>")
    got = {r["label"]: r for r in I.update_centroids(clusters, df, window=window).collect()}
    for label, head in heads.items():
        c = head
        for _, _, _, _, e in [f for f in faces if f[0] == label]:
            c = np.round(unit_(0.7 * c + 0.3 * np.array(e)), 6)
        assert got[label]["centroid"] == c.tolist()
    assert {k: r["folded"] for k, r in got.items()} == {"a": 700, "b": 3, "c": 0} and got["a"]["example_photo_id"] == 0


def test_old_faces_may_decide_a_digit(spark):
    rng = np.random.default_rng(3)
    unit_ = lambda v: v / np.linalg.norm(v)
    heads = {f"l{i}": unit_(rng.normal(size=64)) for i in range(12)}
    faces = [(label, i, i, i, unit_(head + rng.normal(size=64) * 0.3).tolist()) for label, head in heads.items() for i in range(400)]
    clusters = spark.createDataFrame([(k, v.tolist(), None) for k, v in heads.items()], "label string, centroid array<double>, example_photo_id long")
    df = spark.createDataFrame(faces, "label string, seq long, face_id long, media_id long, embedding array<double>").repartition(7)
    got = {r["label"]: r["centroid"] for r in I.update_centroids(clusters, df).collect()}
    for label, head in heads.items():
        c = head
        for _, _, _, _, e in [f for f in faces if f[0] == label]:
            c = np.round(unit_(0.7 * c + 0.3 * np.array(e)), 6)
        assert got[label] == c.tolist()


def test_labels_of_different_roots_differ(spark):
    far = [(35097, [1.0, 0.0]), (40686, [0.0, 1.0])]  # the first 32 bits of their digests are equal
    got = I.form_clusters(spark.createDataFrame(far, "face_id long, embedding array<double>"), 0.5, 2).collect()
    assert len({r["label"] for r in got}) == 2


def test_text_gate_equals_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = random.Random(12)
    texts = set()
    for _ in range(60):
        base = " ".join(rng.choice(["harbour", "sunset", "ab", "boats", "é日", "x"]) for _ in range(rng.randint(1, 6)))
        for _ in range(3):
            cut = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(cut) + 1)
                cut[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
            texts.add("".join(cut))
    texts = sorted(texts - {""})
    rows = [("name", rng.choice("ab"), t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "kind string, block string, text string, q long").withColumn("profile", F.col("q").cast("string"))
    for floor in (0.88, 0.94, 0.6):
        got = {r["text"]: r["lead"]["q"] for r in G.text_gate(df, "text", {"name": floor}).collect()}
        want = {t: max(q for _, b2, u, q in rows if b2 == b and (u == t or SequenceMatcher(a=t, b=u).ratio() >= floor)) for _, b, t, _ in rows}
        assert got == want


def test_hash_gate_equals_all_pairs(spark):
    rng = random.Random(13)
    hashes = []
    for _ in range(20):
        base = rng.getrandbits(64)
        hashes += [base ^ sum(1 << b for b in rng.sample(range(64), n)) for n in (0, 3, 6, 7, 12)]
    rows = [("name", "a", f"{h:016x}", i) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "kind string, block string, phash string, q long").withColumn("profile", F.col("q").cast("string"))
    got = {r["phash"]: r["lead"]["q"] for r in G.hash_gate(df, 0.9).collect()}
    assert got == {p: max(j for j, o in enumerate(hashes) if (o ^ hashes[i]).bit_count() <= 6) for _, _, p, i in rows}


def _spoiled_texts(seed, n):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        base = " ".join(rng.choice(["harbour", "sunset", "ab", "boats", "é日", "x" * 70]) for _ in range(rng.randint(1, 6)))
        for _ in range(3):
            cut = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(cut) + 1)
                cut[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
            texts.append("".join(cut))
    texts = [t for t in dict.fromkeys(texts) if t]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("floor", [0.6, 0.88, 0.94])
@pytest.mark.parametrize("kept", [3, 1 << 20])
def test_first_alike_equals_trying_all(monkeypatch, floor, kept):
    from difflib import SequenceMatcher

    from lumenary.functions import similarity

    monkeypatch.setattr(similarity, "KEPT", kept)
    monkeypatch.setattr(similarity, "STEP", 500)
    texts = _spoiled_texts(21, 40)
    for sides in (None, np.arange(len(texts)) % 3 == 0):
        want = {}
        for i, t in enumerate(texts):
            other = (j for j in range(i) if sides is None or sides[i] != sides[j])
            first = next((j for j in other if SequenceMatcher(a=t, b=texts[j]).ratio() >= floor), None)
            want |= {} if first is None else {i: first}
        assert dict(zip(*(x.tolist() for x in similarity.first_alike(texts, floor, sides)))) == want


def test_text_gate_compares_a_large_block_tile_by_tile(spark):
    """A piece of letters that all texts share made every two of them a shuffled pair."""
    from difflib import SequenceMatcher

    texts = ["the same start " + t for t in _spoiled_texts(22, 20)]
    rows = [("name", "a", t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "kind string, block string, text string, q long").withColumn("profile", F.col("q").cast("string"))
    found = G.text_gate(df, "text", {"name": 0.88}, piece_rows=9)
    got = {r["text"]: r["lead"]["q"] for r in found.collect()}
    assert got == {t: max(q for _, _, u, q in rows if u == t or SequenceMatcher(a=t, b=u).ratio() >= 0.88) for t in texts}


def test_matches_of_many_queries_are_dealt_by_what_they_give(spark, monkeypatch):
    from lumenary.operators import search as S

    axis = lambda i, n=4: [1.0 if j == i else 0.1 for j in range(n)]
    clusters = spark.createDataFrame([(f"c{i}", axis(i), i % 2 + 1, i) for i in range(4)], "label string, centroid array<double>, person_profile_id long, u long").withColumn("updated_at", F.timestamp_seconds("u"))
    persons = spark.createDataFrame([(p, None, p) for p in (1, 2)], "id long, centroid array<double>, u long").withColumn("updated_at", F.timestamp_seconds("u"))
    samples = spark.createDataFrame([(1, 1, axis(0)), (2, 2, axis(1))], "id long, person_id long, embedding array<double>")
    media = [(i, [f"c{i % 4}", f"c{i % 4}", f"c{i // 4 % 4}"]) for i in range(40)]
    mdf = spark.createDataFrame(media, "id long, face_clusters array<string>").withColumn("created_at", F.timestamp_seconds(F.col("id") % 7))
    queries = spark.createDataFrame([(q, axis(q % 4)) for q in range(30)], "query_id long, embedding array<double>")
    kept = [S.search_by_person(queries, mdf, persons, samples, clusters, 9, 0.2, 4), S.retrieved_counts(queries, mdf, persons, samples, clusters, 0.2, 4)]
    whole = [sorted(map(tuple, x.collect())) for x in kept]
    labels = {(r["query_id"], r["label"]): r["score"] for r in S.cluster_scores(queries, persons, samples, clusters, 0.2, 4).collect()}
    want, counts = [], []
    for q in range(30):
        found = [(max(labels[q, c] for c in cs if (q, c) in labels), i % 7, i) for i, cs in media if any((q, c) in labels for c in cs)]
        want += [(q, i, s, r + 1) for r, (s, _, i) in enumerate(sorted(found, reverse=True)[:9])]
        counts.append((q, len(found)))
    assert whole == [sorted(want), counts]
    # few shuffle partitions hold what they give, and no side is sent
    monkeypatch.setattr(S, "FAN_ROWS", 100)
    for sent in (50_000, 0):
        monkeypatch.setattr(S, "SENT_ROWS", sent)
        dealt = [S.search_by_person(queries, mdf, persons, samples, clusters, 9, 0.2, 4), S.retrieved_counts(queries, mdf, persons, samples, clusters, 0.2, 4)]
        assert all(x.rdd.getNumPartitions() >= 3 for x in dealt)
        assert [sorted(map(tuple, x.collect())) for x in dealt] == whole
