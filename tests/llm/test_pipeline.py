"""The pipeline over the small tables: each stage against what it had."""

import corpus_pipeline as P
from tests_support import brute_classes, brute_hits

from lumenary.llm.common import table
from lumenary.session import work_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = {}
    for name, stage in P.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} if "text" in docs.columns else {}
        path = work_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before, docs)
        if name != P.STAGES[-1][0]:
            assert docs.columns == P.COLUMNS
    kept = {name: {r.doc_id for r in out.select("doc_id").collect()} for name, (_, out) in seen.items()}
    had = {name: before for name, (before, _) in seen.items()}
    assert kept["language_id"] == {i for i, x in had["language_id"].items() if any(c.isalpha() for c in x or "")}
    groups = {}
    for i, x in had["exact_dedup"].items():
        groups.setdefault("".join(x.split()), []).append((-len(x), i))
    assert kept["exact_dedup"] == {min(g)[1] for g in groups.values()}
    rows = sorted(had["minhash_near_dedup"].items())
    assert kept["minhash_near_dedup"] == set(brute_classes(rows).values())
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    hits = {i: n for i, _, n, *_ in brute_hits(sorted(had["benchmark_decontamination"].items()), items)}
    assert kept["benchmark_decontamination"] == {i for i, n in hits.items() if not n} and any(hits.values())
    assert kept["best_fit_packing"] == set(had["best_fit_packing"])


def test_language_stage_keeps_unlabelled_documents(spark):
    texts = ["some words", None, "", "12 !?", "é", "日本", "some words"]
    rows = [(i, x, "en" if x == "12 !?" else None, "s", len(x or "")) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = P.language(spark, docs, SF)
    assert out.columns == P.COLUMNS and sorted(tuple(r) for r in out.collect()) == [rows[i] for i in (0, 4, 5, 6)]
    assert P.language(spark, docs.limit(0), SF).count() == 0
