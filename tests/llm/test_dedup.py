"""Exact and near duplicates against plain restatements."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenary.llm import dart_minhash as D
from lumenary.llm import exact_dedup as E

LONG = "word " * 200_000
EDGES = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (7, "a b"), (8, LONG), (9, LONG), (10, "x"), (10, "x"), (None, "x"), (None, "y"), (11, "é"), (12, " é ")]


def docs_of(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("id", "tag", "kept", "key", "n", "full", "doc", "row", "len", "sha", "node", "label")}) if extra else df


def plain_groups(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, i))
    return groups


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_duplicates(spark, digest_all):
    got = E.exact_duplicates(docs_of(spark, EDGES), digest_all=digest_all).collect()
    assert len(got) == len(EDGES)
    groups = plain_groups(EDGES)
    want = sorted((str(d), len(g), str(EDGES[min(g)[3]][0])) for g in groups.values() for _, _, _, i in g for d in [EDGES[i][0]])
    assert sorted((str(r.id), r.group_size, str(r.keep_id)) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    digests = {hashlib.sha256(k.encode()).hexdigest(): len(g) for k, g in groups.items()}
    for r in got:
        assert digests[r.text_sha256] == r.group_size if r.text_sha256 else not digest_all and r.group_size == 1


def test_distinct_documents_keep_all_columns(spark):
    rows = docs_of(spark, EDGES)
    kept = E.distinct_documents(rows)
    assert kept.columns == rows.columns and kept.count() == len(plain_groups(EDGES))
    assert E.distinct_documents(rows.limit(0)).count() == 0


def near_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    passage, base = ([rng.choice(words) for _ in range(n)] for n in (60, 150))
    texts = [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(3, 40))]) for _ in range(80)]
    for _ in range(100):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return list(enumerate([*texts, "", " \n", None, "one", "One", "one two", "one two", LONG, LONG + "end"]))


def brute_classes(rows, similarity=0.8):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize("paired, block", [(8, 1000), (3, 6)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, paired, block):
    monkeypatch.setattr(D, "PAIRED", paired)
    monkeypatch.setattr(D, "BLOCK_MEMBERS", block)
    rows = near_rows()
    got = D.near_duplicates(docs_of(spark, rows)).collect()
    assert {r.id: r.class_id for r in got} == brute_classes(rows) and len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.class_id] = sizes.get(r.class_id, 0) + 1
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.id == r.class_id) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    rows = docs_of(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (2, None), (None, None)])
    kept = D.distinct_documents(rows)
    assert kept.columns == rows.columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == ["1", "2", "None"]
    assert D.near_duplicates(rows.limit(0)).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    elements = np.arange(400, dtype=np.uint32)
    one, two = rng.integers(0, 5, 400).astype(float), rng.integers(0, 5, 400) / 2
    both = [(elements[w > 0], w[w > 0]) for w in (one, two)]
    offsets = np.cumsum([0, *(len(e) for e, _ in both)])
    got = D.dart_signatures(np.concatenate([e for e, _ in both]), np.concatenate([w for _, w in both]), offsets, 4000)
    assert not (got == D.EMPTY).any()
    want = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs((got[0] == got[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 4000)
    alone = D.dart_signatures(both[1][0], both[1][1], np.array([0, len(both[1][0])]), 4000)
    assert (alone[0] == got[1]).all()  # whatever else is in the batch
    assert (D.dart_signatures(np.zeros(0, np.uint32), np.zeros(0), np.array([0, 0]), 8) == D.EMPTY).all()


def test_the_number_of_places_can_be_the_weight(spark):
    texts = [(1, "a b c d e " * 20), (2, "a b c d e " * 4)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.class_size for r in D.near_duplicates(df).collect()} == {2}
    elements, counts, offsets = D.shingle_sets(__import__("pyarrow").array([t for _, t in texts]), 5)
    sig = D.dart_signatures(elements, D.repeated(elements, counts), offsets, 2000)
    assert 0.1 < (sig[0] == sig[1]).mean() < 0.25


def test_a_batch_is_sketched_in_parts():
    texts = [" ".join(f"w{(i * 31 + j * j) % 5000}" for j in range(2_000)) for i in range(800)]  # 9 MB of text
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array(range(800)), pa.array(texts)], names=["id", "tag", "text"])
    tracemalloc.start()
    try:
        parts = list(D.sketch_batch(batch, 5, 30, 7, D.present))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    got = pa.Table.from_batches(parts)
    assert got.num_rows == 800 and len(parts) > 3
    assert most < 80 << 20  # 130 MB at 8 MB of text and 2^19 cells at once, 43 as it is
