import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenary.functions import codecs as C
from lumenary.functions import text as X
from lumenary.functions import vector as V
from lumenary.operators import annotations as A


def run(spark, values, expr, ddl="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {ddl}")
    rows = df.select("i", expr(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["i"])]


def plain_tokens(text):
    out = []
    for m in re.finditer(r"[a-z0-9_]+|[一-鿿]+", text.lower()):
        word = m.group()
        out.append(word)
        if ord(word[0]) >= 0x4E00:
            out += [word[i : i + 2] for i in range(len(word) - 1)]
    return out


def test_tokens_of_mixed_scripts(spark):
    got = run(spark, ["海边日落 Beach_1", "张三", "a海b", "", None, "--"], X.tokenize)
    assert got == [
        ["海边日落", "海边", "边日", "日落", "beach_1"], ["张三", "张三"], ["a", "海", "b"], [], [], [],
    ]


@given(st.lists(st.text(alphabet="aB3_ -海边日,é", max_size=12), min_size=1, max_size=20))
@settings(max_examples=8, deadline=None)
def test_tokens_match_a_restatement(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        pytest.skip("no session yet")
    assert run(spark, texts, X.tokenize) == [plain_tokens(t) for t in texts]
    assert [X.token_list(t) for t in texts] == [plain_tokens(t) for t in texts]


def test_hash_vector_matches_a_restatement(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["sea", "sun", "海边", "x" * 14, "a1"]) for _ in range(rng.randint(0, 9))) for _ in range(30)]
    got = run(spark, texts, X.text_hash_vector)
    for text, vector in zip(texts, got):
        want = np.zeros(128)
        for token in plain_tokens(text):
            digest = hashlib.sha1(token.encode()).hexdigest()
            sign = 1 if int(digest[8:10], 16) % 2 == 0 else -1
            want[int(digest[:8], 16) % 128] += sign * (1 + min(len(token), 10) / 10)
        size = np.linalg.norm(want)
        assert np.allclose(vector, want / size if size else want)


HALVES = " ".join(w for w, n in zip("abcde", (31, 7, 3, 2, 1)) for _ in range(n))  # 1024 = 961 + 49 + 9 + 4 + 1


def test_entries_halfway_between_two_decimals_are_exact(spark):
    got = run(spark, [HALVES, " ".join(reversed(HALVES.split()))], X.text_hash_vector)
    assert sorted(abs(x) * 32 for x in got[0] if x) == [1, 2, 3, 7, 31]
    assert got[0] == got[1]


def test_tokens_are_held_for_a_part_of_a_batch_at_a_time():
    texts = pa.array([f"word{i} beach {i % 7} " * 2_000 for i in range(200)] + ["", None])  # 7 MB of text, 1.2 million tokens
    tracemalloc.start()
    try:
        got = X._by_parts(texts, X.hash_texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 60 << 20  # all at once takes 111 MB, in parts 44
    assert np.array_equal(np.asarray(got.flatten()).reshape(len(texts), -1), X.hash_texts(texts.to_pylist()))


def test_text_beside_another_half_is_rounded_once(spark):
    both = lambda t: V.unit_beside(X.text_hash_counts(t), V.l2_normalize(F.array(*[F.lit(float(i)) for i in range(1, 8)])), rest_is_unit=True)
    # 2 * 16 * 16 = 512 = 441 + 49 + 9 + 9 + 4
    text = " ".join(w for w, n in zip("abcde", (21, 7, 3, 3, 2)) for _ in range(n))
    got, none = run(spark, [text, ""], both)
    assert sorted(abs(x) * 32 for x in got[: X.TEXT_DIM] if x) == [2, 3, 3, 7, 21]
    assert not any(none[: X.TEXT_DIM]) and sum(x * x for x in none) == pytest.approx(1)
    alone = run(spark, [HALVES, ""], lambda t: V.unit_beside(X.text_hash_counts(t), V.zeros(3)))
    assert sorted(abs(x) * 32 for x in alone[0] if x) == [1, 2, 3, 7, 31] and not any(alone[1])


def test_media_name_keys(spark):
    cases = {
        "/x/IMG_001 (1).jpg": "img", "图片 副本2.png": "图片 图片", "photo-copy.jpg": "photo", "123.jpg": "123",
        "/a/Sunset_beach-2.JPG": "sunset beach", "": "", "/d/.mp4": "mp4", "trip copy 3.mov": "trip",
    }
    assert run(spark, list(cases), X.media_name_key) == list(cases.values())


def test_other_text_helpers(spark):
    assert run(spark, ["  Ann   LEE ", None, "a\t\nb"], X.normalize_name) == ["ann lee", "", "a b"]
    assert run(spark, ["12 img a sea sun", None], X.caption_key) == ["sea sun", ""]
    assert run(spark, ["a, b，a\n c ,", None], X.parse_tags) == [["a", "b", "c"], []]
    assert run(spark, [[" Sea", "sea", "", "SUN"], None], X.dedupe_ci, "v array<string>") == [["Sea", "SUN"], []]
    assert run(spark, [None, 0.0, -1.0, 59.9, 61.0, 3661.0], X.format_duration, "v double") == [
        "00:00", "00:00", "00:00", "00:59", "01:01", "01:01:01",
    ]


def test_list_and_record_decoding(spark):
    texts = [None, "", "{}", '[1,true,null,"a",{"x":1}]', "[1,", '["true"]']
    assert run(spark, texts, C.decode_list) == [[], [], [], ["1", "True", "None", "a", '{"x":1}'], [], ["true"]]
    rows = run(spark, ['[1,{"a":2},null,"{"]', "x", None], lambda c: C.decode_records(c, "struct<a:int>"))
    assert rows[0][0]["a"] == 2 and rows[1:] == [[], []]
    vectors = run(spark, ["[1,2.5]", "[1,", "{}", None, ""], C.decode_vector)
    assert vectors == [[1.0, 2.5], [], [], [], []]


def test_annotation_answers(spark):
    import json

    def payload(content):
        return json.dumps({"choices": [{"message": {"content": content}}]})

    body = '{"caption": " Sea ", "people": ["Ann", "ann", " "], "scene_tags": "beach，sun/Beach", "object_tags": null}'
    rows = [
        (1, payload(f"ok ```json\n{body}\n``` end")), (2, payload("so " + body)), (3, payload(body[:30])),
        (4, payload([{"type": "text", "text": body}, {"type": "image"}])), (5, "{}"), (6, "not json"), (7, payload("")),
    ]
    got = A.parse_annotations(spark.createDataFrame(rows, "media_id long, payload_json string")).collect()
    assert sorted(r["media_id"] for r in got) == [1, 2, 4]
    for r in got:
        assert (r["caption"], r["people"], r["scene_tags"], r["object_tags"]) == ("Sea", ["Ann"], ["beach", "sun"], [])


def test_frame_texts(spark):
    lines = [(1, 0, 1, "b"), (1, 0, 0, " a "), (1, 1, 0, "A"), (1, 1, 1, "b"), (1, 2, 0, " "), (1, 6, 0, "late")]
    df = spark.createDataFrame(lines, "media_id long, frame_idx int, line_no int, text string")
    assert A.assemble_frame_ocr(df).first()["ocr_text"] == "a\nb"


def test_words_are_deduplicated_once_and_sorted_without_a_lambda(spark):
    from lumenary.plans import text_queries as T
    from lumenary.plans.catalog import Catalog

    class Held(Catalog):
        def texts(self, name):
            return spark.createDataFrame([(1, "Sea  sea SUN "), (2, "  "), (3, None), (4, ""), (5, "B a b A a")], "doc_id long, text string")

    found = T.dedupe(Held(spark, ""))
    assert {r["doc_id"]: r["items"] for r in found.collect()} == {1: "Sea|SUN", 5: "B|a"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with") == 1 and "array_sort" not in plan


def halves(words, counts):
    """A text whose sums, in units of one weight, have a whole norm of 32, so that entries lie halfway between two decimals."""
    return " ".join(w for w, n in zip(words, counts) for _ in range(n))


@pytest.mark.parametrize("name", ["t2_text_hash_vector", "t2_text_hash_vector_cjk"])
def test_halves_are_shown_as_sql_shows_them(spark, name):
    import duckdb

    from lumenary.plans import registry, text_queries
    from lumenary.plans.catalog import Catalog

    counts = [(30, 11, 1, 1, 1), (27, 17, 2, 1, 1), (31, 6, 5, 1, 1), (25, 19, 6, 1, 1)]
    # no CJK is added to every third text
    texts = [(3 * i + 2, halves("abcde", c)) for i, c in enumerate(counts)]

    class Held(Catalog):
        def texts(self, name):
            return spark.createDataFrame(texts, "doc_id long, text string")

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    got = registry.QUERIES[name](Held(spark, ""))
    assert {r["doc_id"]: r["vector"] for r in got.collect()} == dict(con.execute(registry.CHECKS[name]).fetchall())


def beside_unit_half(texts, half):
    """Rows of SQL that put a unit half beside each text's vector: sums over the square root of 2."""
    import duckdb

    from lumenary.plans.check_sql import flat, text_vectors

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE texts (id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO texts VALUES (?, ?)", texts)
    shown = flat(f"list_transform(list_concat(v, {half}::DOUBLE[]), lambda x: x/sqrt(2))")
    return dict(con.execute(f"SELECT id, {shown} FROM ({text_vectors('texts', 'id', 'text')})").fetchall())


# 2 * 16 * 16 = 512
HALF_TEXTS = [(i, halves("abcde", c)) for i, c in enumerate([(22, 5, 1, 1, 1), (19, 10, 7, 1, 1), (21, 6, 5, 3, 1), (21, 7, 3, 3, 2)])]


def media(spark):
    rows = spark.createDataFrame(HALF_TEXTS, "id long, caption string")
    none = F.array().cast("array<string>")
    return rows.withColumns({"ocr_text": F.lit(""), "people": none, "scene_tags": none, "object_tags": none, "storage_path": F.lit("")})


def test_halves_of_video_vectors_are_shown_as_sql_shows_them(spark):
    from lumenary.operators import features as FE
    from lumenary.plans.catalog import flat_vector

    unit = [1.0] + [0.0] * 7
    beside = spark.range(len(HALF_TEXTS)).withColumns({c: F.array(*map(F.lit, unit)) for c in ("pooled", "encoded")})
    got = FE.video_vectors(media(spark), beside, beside, 8).select("id", flat_vector(F.col("vector")).alias("v"))
    assert {r["id"]: r["v"] for r in got.collect()} == beside_unit_half(HALF_TEXTS, unit)


def test_halves_of_photo_vectors_are_shown_as_sql_shows_them(spark):
    from lumenary.operators import features as FE
    from lumenary.plans.catalog import flat_vector

    unit = [0.0] * 48 + [0.125, -0.125] * 32
    features = spark.range(len(HALF_TEXTS)).withColumn("features", F.array(*map(F.lit, unit)))
    got = FE.photo_vectors(media(spark), features).select("id", flat_vector(F.col("vector")).alias("v"))
    assert {r["id"]: r["v"] for r in got.collect()} == beside_unit_half(HALF_TEXTS, unit)
    # without a text the image half is the whole vector, without an image the text is
    alone = spark.createDataFrame([("", [3.0, 4.0]), ("a", [0.0, 0.0])], "t string, r array<double>")
    both = alone.select(V.units_beside(X.text_added_vector(F.col("t")), F.col("r")).alias("v"))
    assert [sorted(x for x in r["v"] if x) for r in both.collect()] in ([[0.6, 0.8], [1.0]], [[0.6, 0.8], [-1.0]])
