"""Each registered corpus query over the small tables: against its SQL, or a restatement of what it must return."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tests_support import brute_classes, plain_spans

import corpus_pipeline
from compare import compare, duck
from lumenary.llm import language_id, packing, queries
from lumenary.llm.common import table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    if queries.ORACLE_SQL[name] is not None:
        assert compare(spark, duck(SF), SF, queries.QUERIES[name], queries.ORACLE_SQL[name]) is None


def test_secret_scans(spark):
    want = []
    for d in rows_of("documents"):
        spans = plain_spans(d["text"] or "")
        kinds = Counter(k for k, *_ in spans)
        want.append((d["doc_id"], kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    got = run(spark, "op2_secret_scans")
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    for r in got:  # the base spans stay among all
        told = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert sha(",".join(":".join(x) for x in told if x[0] in ("assign", "access", "hex"))) == r.base_sha256
        assert [int(x[1]) for x in told] == sorted(int(x[1]) for x in told)
    assert sum(w[1] + w[2] + w[3] for w in want) > 0


def test_lm_scoring(spark):
    docs = {d["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", (d["text"] or "").translate(LOWER)) + [None] for d in rows_of("documents")}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts = Counter(t for i, w in docs.items() if not held[i] for t in w)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in run(spark, "op4_lm_scoring")}
    assert set(got) == set(docs)
    for i, w in docs.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(counts[t] > 0 for t in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert sum(got[i].score for i in docs if held[i]) > sum(got[i].base_score for i in docs if held[i])


def test_near_dedup(spark):
    rows = [(d["doc_id"], d["text"]) for d in rows_of("documents")]
    assert {r.doc_id: r.class_id for r in run(spark, "op5_minhash_near_dedup")} == brute_classes(rows)


def pieces_of(rows):
    tokenizer, out = packing.encoder(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        edges = [0, len(ids)] if len(ids) <= 2048 else [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        out += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    return sorted(out)


def check_sequences(got):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        assert [a for a, _ in sorted(places)] == list(np.cumsum([0] + [n for _, n in sorted(places)])[:-1]) and sum(n for _, n in places) <= 2048
    assert len(by) <= math.ceil(sum(r.length for r in got) / 2048) * 1.03 + 2


def test_packing(spark):
    got = run(spark, "op6_best_fit_packing")
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces_of([(d["doc_id"], d["text"]) for d in rows_of("documents")])
    check_sequences(got)


def test_warc_bundles(spark):
    pages = rows_of("pages")
    first = {}
    for p in pages:
        first[p["html"] or ""] = min(p["page_id"], first.get(p["html"] or "", p["page_id"]))
    want = []
    for p in pages:
        body, keep = (p["html"] or "").encode(), first[p["html"] or ""]
        again = keep != p["page_id"]
        want.append((p["page_id"], len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", keep if again else None))
    got = run(spark, "op8_warc_bundles")
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want)


def plain_probabilities(network, data):
    """Byte by byte, one direction after the other, as the textbook has it."""
    w, squash = network.weights, lambda x: 1 / (1 + np.exp(-x))

    def walk(table, recurrent, codes):
        h, out = np.zeros(recurrent.shape[1]), []
        n = len(h)
        for byte in codes:
            x, u = table[:, byte].astype(float), recurrent.astype(float) @ h
            update, reset = squash(x[:n] + u[:n]), squash(x[n : 2 * n] + u[n : 2 * n])
            h = update * h + (1 - update) * np.tanh(x[2 * n :] + reset * u[2 * n :])
            out.append(h)
        return out

    ahead, back = walk(w["ahead_x"], w["ahead_h"], data), walk(w["back_x"], w["back_h"], data[::-1])[::-1]
    out = []
    for a, b in zip(ahead, back):
        logits = w["out_ahead"].astype(float) @ a + w["out_back"].astype(float) @ b + w["out"]
        p = np.exp(logits - logits.max())
        out.append(p / p.sum())
    return out


def test_language_id(spark):
    docs = rows_of("documents")
    network = language_id.fit(table(spark, SF, "documents").select("doc_id", "text", "lang"), language_id.held_out())
    got = {r.doc_id: r for r in run(spark, "op9_language_id")}
    assert set(got) == {d["doc_id"] for d in docs}
    for d in docs:
        text, r = d["text"] or "", got[d["doc_id"]]
        assert r.held_out == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
        if not re.search(r"[^\W\d_]", text):
            assert (r.lang_pred, r.score) == ("und", 0)
    # texts of all lengths, some of a segment or less, whatever texts they were read with
    short = [d for d in docs if re.search(r"[^\W\d_]", d["text"] or "") and len(d["text"]) < 700]
    for d in sorted(short, key=lambda d: len(d["text"]))[:: max(1, len(short) // 25)]:
        data, r = list(d["text"].encode()), got[d["doc_id"]]
        n = -(-len(data) // language_id.SEGMENT)
        pooled = sum(p for k in range(n) for p in plain_probabilities(network, data[k * len(data) // n : (k + 1) * len(data) // n])) / len(data)
        assert r.score == pytest.approx(pooled.max(), abs=1e-4) and r.lang_pred == network.languages[int(pooled.argmax())]
    test = [d for d in docs if got[d["doc_id"]].held_out and d["lang"]]
    assert sum(got[d["doc_id"]].lang_pred == d["lang"] for d in test) >= 0.9 * len(test)


def test_chat_windows(spark):
    said = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in rows_of("conversations"):
        said.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    want = []
    for conv, turns in said.items():
        turns = [(role, text) for _, role, text in sorted(turns)]
        loss = "".join(t for role, t in turns if role == "assistant")
        want.append((conv, len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns)), len(loss), sha(loss)))
    got = run(spark, "op10_chat_windows")
    assert sorted((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got) == sorted(want)
    assert all(r.formatted_chars > r.loss_chars for r in got)


def test_pipeline(spark):
    got = run(spark, "pipeline")
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    left = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces_of(left)
    check_sequences(got)


def test_every_query_is_tested():
    tested = set(queries.ORACLE_SQL) | {f"op{n}" for n in (2, 4, 5, 6, 8, 9, 10, 12)} | {"pipeline"}
    assert all(name in tested or name.split("_")[0] in tested for name in queries.QUERIES)
