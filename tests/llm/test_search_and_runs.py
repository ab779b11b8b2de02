"""Top-k search, hard negatives and periodic runs against plain restatements."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from compare import compare, duck
from lumenary.llm import hard_negatives, queries, run_detection, tiles, top_k

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, score string"


def usable(rows):
    out = []
    for i, vector, label, *_ in rows:
        if i is None or vector is None or any(x is None or not math.isfinite(256 * x) for x in vector):
            continue
        out.append((i, [math.floor(256 * x) for x in vector], label))
    return out


def product(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), -(2**63) + 1), 2**63 - 1)


def brute_top_k(rows, is_query, k):
    rows, out = usable(rows), []
    for i, vector, _ in rows:
        if is_query(i):
            best = sorted((-product(vector, v), j) for j, v, _ in rows if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def brute_negatives(rows, is_anchor):
    rows, out = [r for r in usable(rows) if r[2] is not None], []
    for i, vector, label in rows:
        if not is_anchor(i):
            continue
        scored = sorted((-product(vector, v), j, other) for j, v, other in rows if j != i)
        for ps, p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 50 * -ps <= 100 * -x[0] <= 95 * -ps][:3]
            out += [(i, p, r + 1, j, -ps, -s) for r, (s, j, _) in enumerate(fit)]
    return sorted(out)


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], int(i % 3), "x") for i in range(160)]
    rows += [(200 + i, [0.1] * 8, i % 2, "x") for i in range(40)]  # one vector many times
    rows += [(300, None, 1, "x"), (301, [0.1, None], 1, "x"), (302, [float("nan")] * 8, 1, "x"), (303, [float("inf")] * 8, 1, "x"), (None, [0.5] * 8, 1, "x")]
    rows += [(310, [], 1, "x"), (320, [0.5, -0.5], 2, "x"), (330, [0.3] * 11, 2, "x"), (340, [0.1] * 8, None, "x"), (350, [1e306] * 8, 0, "x")]
    return rows + rows[10:12] + [(20, [0.25] * 8, 1, "x")]  # rows that repeat, an id with two vectors


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("small", [False, True])
def test_top_k_equals_brute_force(spark, monkeypatch, small):
    if small:  # many tiles, rounds, shards and levels
        monkeypatch.setattr(tiles, "ROUND_BYTES", 300)
        monkeypatch.setattr(tiles, "FAN_IN", 2)
        monkeypatch.setattr(tiles, "CELLS", 64)
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert rows_of(top_k.top_k(df, F.col("vec_id") % 10 == 0)) == brute_top_k(rows, lambda i: i % 10 == 0, 5)


def test_negatives_equal_brute_force(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = rows_of(hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label")))
    assert got and got == brute_negatives(rows, lambda i: i % 10 == 0)


def test_scores_beyond_a_double_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.choice([0, 6, 12]) for _ in range(6)], i % 2, "x") for i in range(40)]
    rows += [(100 + i, [float(2**60 + i), 3.0], i % 2, "x") for i in range(20)]  # beyond a long: cut to its range
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert rows_of(top_k.top_k(df, F.col("vec_id") % 10 == 0, k=7)) == brute_top_k(rows, lambda i: i % 10 == 0, 7)
    assert rows_of(hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"))) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_fewer_candidates_and_none(spark):
    two = spark.createDataFrame([(0, [1.0], 0, "x"), (3, [2.0], 0, "x")], VECTORS)
    assert rows_of(top_k.top_k(two, F.col("vec_id") == 0)) == [(0, 1, 3, 256 * 512)]
    assert rows_of(hard_negatives.hard_negatives(two, F.col("vec_id") == 0, F.col("label"))) == []
    for df in (two.limit(0), two.filter("vec_id > 0")):
        assert rows_of(top_k.top_k(df, F.col("vec_id") == 0)) == []
        assert rows_of(hard_negatives.hard_negatives(df, F.col("vec_id") == 0, F.col("label"))) == []


@pytest.mark.parametrize("width, peak", [(1, 3), (64, 300), (64, 2**18), (5, 2**26), (3, 2**40), (0, 1)])
def test_packed_products(width, peak):
    rng = np.random.default_rng(width)
    a, c = (rng.integers(-peak, peak + 1, (n, width)) for n in (7, 1031))
    want = [[product(x, y) for y in c.tolist()] for x in a.tolist()]
    assert hard_negatives.packed_products(a.astype(float), c.astype(float)).tolist() == want
    assert tiles.tile_product(a.astype(float), c.astype(float)).tolist() == want


def test_registered_searches(spark):
    con = duck(SF)
    for name in ("op11_exact_top_k", "op13_hard_negatives"):
        assert compare(spark, con, SF, queries.QUERIES[name], queries.ORACLE_SQL[name]) is None
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    assert rows_of(queries.QUERIES["op11_exact_top_k"](spark, SF)) == brute_top_k(rows, lambda i: i % 50 == 0, 5)
    changed = [(i, v, (label + 1) % 10 if i % 7 == 0 and label is not None else label) for i, v, label in rows]
    assert rows_of(queries.QUERIES["op13_hard_negatives"](spark, SF)) == brute_negatives(changed, lambda i: i % 50 == 0)


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def brute_runs(words, least=24, periods=3):
    found = set()
    for q in range(1, len(words) // periods + 1):
        at = 0
        while at < len(words) - q:
            end = at
            while end < len(words) - q and words[end] == words[end + q]:
                end += 1
            if end > at:
                length = end - at + q
                if length >= max(least, periods * q) and smallest_period(words[at : at + length]) == q:
                    found.add((at, length, q))
            at = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, words):
    runs = brute_runs(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    texts = ("".join(f"{a},{n},{q}\n" for a, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))
    return (doc_id, len(runs), *numbers, *(hashlib.sha256(t.encode()).hexdigest() for t in texts))


def test_runs_equal_brute_force():
    rng = random.Random(11)
    texts = []
    for size in (2, 3, 9):
        for _ in range(60):
            words = []
            while len(words) < rng.randrange(0, 160):
                stretch = [rng.randrange(size) for _ in range(rng.randrange(1, 14))]
                words += stretch * rng.choice([1, 1, 2, 3, 4, 9]) + stretch[: rng.randrange(3)]
            texts.append(words)
    texts += [[], [1], [1] * 23, [1] * 24, [1, 2] * 400, [1, 1, 2] * 300 + [1, 2] * 40, list(range(2000)) * 4]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = run_detection.runs_of(np.array([w for t in texts for w in t], dtype=np.int64), starts)
    for d, words in enumerate(texts):
        own = got[(got[:, 0] >= starts[d]) & (got[:, 0] < starts[d + 1])]
        if len(words) < 5000:
            assert [(a - starts[d], n, q) for a, n, q in own.tolist()] == brute_runs(words), words
        else:
            assert own.tolist() == [[starts[d], 8000, 2000]]


def test_runs_of_odd_documents(spark):
    line = "a b c D\x0b" * 12
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, line, "x"), (4, line, "y"), (None, line, "x"), (5, "é " * 30 + "end", "x"), (6, "q " * 300_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    found = run_detection.periodic_runs(df, with_text=True).collect()
    got = sorted((tuple(r)[:1] + tuple(r)[2:9] for r in found), key=str)
    want = [brute_row(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t, _ in rows if i != 6]
    want.append((6, 1, 0, 300_000, 1, 300_000_000, hashlib.sha256(b"0,300000,1\n").hexdigest(), hashlib.sha256(b"q").hexdigest()))
    assert got == sorted(want, key=str)
    assert {r["collapsed"] for r in found if r["id"] == 5} == {"é end"}
    assert run_detection.periodic_runs(df.limit(0)).collect() == []


def test_registered_runs(spark):
    want = []
    for row in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        words = re.findall("[^\x20\x09-\x0d]+", row["text"] or "")
        h = zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if len(words) <= 3000:
            want.append(brute_row(row["doc_id"], words))
    small = {r[0] for r in want}
    got = [tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()]
    assert len(got) == 200 and len(small) > 150 and any(r[1] for r in want)
    assert sorted(r for r in got if r[0] in small) == sorted(want)
