"""Language scores, language ID, packing and archives against restatements, held-out accuracy and round trips."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from lumenary.llm import language_id as G
from lumenary.llm import lm_scoring as M
from lumenary.llm import packing as K
from lumenary.llm import warc_bundles as A
from lumenary.session import work_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- language model ------------------------------------------------------------------------------------


def lm_rows():
    rng = random.Random(6)
    vocabulary = [f"w{int(rng.expovariate(0.05))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, "W1  w1\n"), (202, "W1  w1\n"), (None, "w1 new"), (203, "w2 " * 30_000)]


def test_scores_match_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(M, "BATCH_BYTES", 2_000)  # several batches of both kinds
    rows = lm_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "fold", "batch", "part")})
    got = M.score_documents(df.repartition(3), M.held_out()).collect()
    folds = {r.i: r.f for r in df.select(F.col("doc_id").alias("i"), (F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id").cast("string")), F.lit(M.FOLD)) == 0).alias("f")).collect()}
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(LOWER)) + [None]) for i, x in rows]
    pairs = lambda w: zip(["<"] + w[:-1], w)

    def counts(chosen):
        one, two = Counter(t for w in chosen for t in w), Counter(p for w in chosen for p in pairs(w))
        one["<"] = one[None]
        return one, two, sum(len(w) for w in chosen), len({t for w in chosen for t in w})

    train = [w for i, w in docs if not held(i)]
    one, two, n, v = counts([w for i, w in docs if not held(i) and not folds[i]])
    assert 0 < n < sum(map(len, train))
    cells = Counter()
    for i, w in docs:
        if not held(i) and folds[i]:
            for a, b in pairs(w):
                level = lambda p: round(M.OCTAVE * math.log2(p)) if p else None
                cells[int(M.bucket_of(np.array([one[a]]))[0]), level(two[a, b] / max(one[a], 1)), level(one[b] / n)] += 1
    value = lambda q: 2 ** (q / M.OCTAVE) if q is not None else 0.0
    keys = list(cells)
    weights = M.expectation_maximisation(np.array([k[0] for k in keys]), np.array([[value(k[1]), value(k[2]), 1 / (v + 1)] for k in keys]), np.array([cells[k] for k in keys]))
    one, two, n, v = counts(train)
    want = []
    for i, w in docs:
        base = sum(math.log10((one[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w)
        score = 0.0
        for a, b in pairs(w):
            x = weights[M.bucket_of(np.array([one[a]]))[0]]
            score += math.log10(x[0] * two[a, b] / max(one[a], 1) + x[1] * one[b] / n + x[2] / (v + 1))
        want.append((str(i), held(i), len(w), sum(one[t] > 0 for t in w), n, base, score))
    got = sorted((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_model_without_rows_or_training(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert [(r.score, r.train_tokens) for r in M.score_documents(df, M.held_out()).collect()] == [(0.0, 0)] * 2
    assert M.score_documents(df.limit(0), M.held_out()).count() == 0


def test_buckets_cover_all_counts():
    counts = np.array([0, 1, 2, 3, 4, 2**14 - 1, 2**14, 2**15, 2**31, 2**32, 2**50, 2**62], dtype=np.uint64)
    assert M.bucket_of(counts).tolist() == [0, 1, 2, 2, 3, 14, 15, 16, 32, 33, 51, 63]
    assert M.bucket_of(np.array([2**64 - 1], dtype=np.uint64))[0] < M.BUCKETS
    # frequent contexts follow the bigrams, those of 2^20 the unigrams: each keeps its own weights
    bucket = M.bucket_of(np.array([2**15, 2**20]))
    weights = M.expectation_maximisation(bucket, np.array([[0.5, 1e-4, 1e-6], [1e-4, 0.5, 1e-6]]), np.array([10_000, 10_000]))
    assert weights[bucket[0], 0] > 0.9 and weights[bucket[1], 1] > 0.9
    # buckets that the deleted fold doesn't reach have the nearest weights, not equal thirds
    assert (weights[bucket[1] + 1 :] == weights[bucket[1]]).all() and (weights[1 : bucket[0]] == weights[bucket[0]]).all()
    assert (weights[bucket[0] + 1 : bucket[1]] == weights[bucket[0]]).all() and weights[0, 0] == 0


def test_counts_beyond_32_bits(spark):
    rows = spark.createDataFrame([(1, "a b", False, False)], "id long, text string, held_out boolean, fold boolean").coalesce(1)
    each, fields = 3_000_000_000, [x.split()[0] for x in M.ASKED.split(", ")]
    found = [r.asDict() for r in M.ask(rows, 2).collect()]
    asked = [r | {"batch": b, "fold": b == "z"} for r in found if r["part"] >= 0 for b in "xyz"]
    for r in asked:
        for k in ("unigram_counts", "bigram_counts"):
            r[k] = M.pack(M.unpack(r[k], "uint32") * np.uint32(each))
    answers = M.answer(spark.createDataFrame([[r[k] for k in fields] for r in asked], M.ASKED)).collect()
    total = [r for r in answers if r.batch is None]
    assert (sum(r.tokens for r in total), sum(r.tokens_left for r in total), sum(r.words for r in total)) == (3 * 3 * each, 3 * 2 * each, 3)
    told = [r.asDict() for r in answers if r.batch == "z"]
    state = [dict.fromkeys(told[0]) | r for r in found if r["part"] < 0]
    for deleted, times in ((False, 3), (True, 2)):
        batch = M.Batch(pa.Table.from_pylist([*state, *(state[0] | r for r in told)]), deleted)
        assert set(batch.count.tolist()) == set(batch.context_count.tolist()) == set(batch.pair_count.tolist()) == {times * each}
        two, one = batch.estimates(3 * times * each)
        assert two.tolist() == [1.0] * 3 and one == pytest.approx([1 / 3] * 3)


# --- language ID ---------------------------------------------------------------------------------------


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    table, recurrent = rng.normal(size=(6, 256)).astype(np.float64) * 0.4, rng.normal(size=(6, 2)) * 0.6
    codes = rng.integers(0, 5, (7, 3)).astype(np.uint8)
    pull = rng.normal(size=(7, 2, 3))
    loss = lambda t, r: float((G.states(t.astype(np.float32), r.astype(np.float32), codes)[0] * pull).sum())
    out, kept = G.states(table.astype(np.float32), recurrent.astype(np.float32), codes, True)
    d_table, d_recurrent = G.gradients(table, recurrent, codes, out, kept, pull)
    for values, grad, spot in ((table, d_table, (1, 2)), (table, d_table, (5, 3)), (recurrent, d_recurrent, (0, 1)), (recurrent, d_recurrent, (3, 0)), (recurrent, d_recurrent, (4, 1))):
        step = np.zeros_like(values)
        step[spot] = 1e-2
        args = [(table + step, recurrent), (table - step, recurrent)] if values is table else [(table, recurrent + step), (table, recurrent - step)]
        assert grad[spot] == pytest.approx((loss(*args[0]) - loss(*args[1])) / 2e-2, rel=0.02, abs=2e-3)


def test_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    network = G.fit(docs, G.held_out())
    rows = docs.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "12 !?", "en"), (-4, "the and " * 50_000, None), (None, None, None)], "doc_id long, text string, lang string")
    )
    found = G.identify(rows.withColumns({"row": F.lit(1), "score": F.lit(2)}), network).select("row.doc_id", "row.text", "row.lang", "lang_pred", "score").collect()
    assert len(found) == rows.count()
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) and 0 <= r.score <= 1 for r in found)
    test = [r for r in found if r.doc_id is not None and r.doc_id >= 0 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in test) >= 0.9 * len(test) > 0
    kept = G.recognised_documents(rows)
    assert kept.columns == rows.columns and {-1, -2, -3}.isdisjoint({r.doc_id for r in kept.collect()})
    assert kept.count() >= rows.count() - 4


def test_no_labels_give_no_language(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in G.identify(df, G.fit(df)).collect()] == [("und", 0.0)]
    assert G.identify(df.limit(0), G.fit(df.limit(0))).count() == 0


# --- packing -------------------------------------------------------------------------------------------


def test_ids_are_the_tokenizers():
    rng = random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", "'s", "!", "é", " ", "　", "\x85", "\x1c", "\x0b", "1", "<|endoftext|>", "日", "the", "\r", " x", "​", "'", " '", "😀", "word", "Word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5_000)] + [None, "", "x" * 100_000, "the word " * 20_000]
    tokenizer = K.encoder(BPE)
    for _ in range(2):  # once more, from the worker's memory
        ids, starts = K.encode(pa.array(texts), BPE)
        for i, x in enumerate(texts):
            assert list(ids[starts[i] : starts[i + 1]]) == tokenizer.encode(x or "", add_special_tokens=False).ids


def test_pieces_and_sequences(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "word", "of", "packing", "é"]) for _ in range(int(rng.expovariate(0.02))))) for i in range(300)]
    rows += [(400, None), (401, ""), (401, ""), (None, "a b"), (402, "w " * 4_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "size", "members", "length", "piece")})
    capacity = 64
    got = K.packed_documents(df, BPE, capacity=capacity).collect()
    tokenizer, want = K.encoder(BPE), []
    for i, x in rows:
        ids = np.array([*tokenizer.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4")
        edges = [0, len(ids)] if len(ids) <= capacity else [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        want += [(str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((str(r.id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        ends = 0
        for at, length in sorted(places):
            assert at == ends
            ends += length
        assert ends <= capacity
    least = math.ceil(sum(r.length for r in got) / capacity)
    assert len(by) <= 1.05 * least + 2
    assert K.packed_documents(df.limit(0), BPE).count() == 0


def test_large_rests_stop_early(spark):
    pieces = spark.range(2_000).select("id", F.lit(40).cast("long").alias("length"))
    packed = K.pack(pieces, 64, merge_rows=50)  # none of them fit together
    assert packed.select("sequence_id").distinct().count() == 2_000 and packed.agg(F.max("offset")).first()[0] == 0


# --- archives ------------------------------------------------------------------------------------------


def page_rows():
    rng = random.Random(5)
    rows = [(i, f"http://h/{i}", rng.choice(["<p>same</p>", "", f"<p>{i} é</p>", "a\r\n\r\nWARC/1.1\r\n"])) for i in range(60)]
    return rows + [(70, None, None), (71, "http://x/\r\nWARC-Type: %0A", "z" * 3_000_000), (72, "http://y", "z" * 3_000_000), (None, "http://n", "lone"), (None, "http://n", "<p>same</p>"), (73, "u", "twice"), (73, "u", "twice")]


def test_archives_round_trip(spark, tmp_path):
    rows = page_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("id", "key", "size", "first", "record")})
    folder = work_path(spark, "warc-test")
    index = A.write_bundles(df, folder)
    back = A.read_records(A.frames_of(index.select("bundle").distinct(), folder), folder).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, u, h in rows:
        body, keep = (h or "").encode(), first.get(h or "")
        again = keep is not None and keep != i
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((str("" if i is None else i), u, len(body), digest, "revisit" if again else "response", str(keep) if again else None, None if again else body))
    got = [(r.record, r.uri, r.payload_bytes, r.digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in back]
    assert sorted(got, key=str) == sorted(want, key=str)
    some = spark.createDataFrame([("71",), ("5",)], "record string")
    assert sorted(r.record for r in A.fetch(index, some, folder).collect()) == ["5", "71"]
    # any Zstandard reader can read a bundle from its start
    bundle = index.first().bundle
    with open(folder.removeprefix("file:") + "/" + bundle, "rb") as f, zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True) as whole:
        assert sum(1 for _ in A.parse_records(whole.read())) == index.filter(F.col("bundle") == bundle).count()
    assert A.round_trip(df.limit(0)).count() == 0


def test_small_payloads_need_not_be_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    kinds = {r.id: r.refers_to for r in A.deduplicated(df, "page_id", "url", "html", 3).collect()}
    assert kinds == {1: None, 2: None, 3: None, 4: 3}
