"""One named query per corpus operator, with check SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.llm import (
    chat_windows, dart_minhash, decontamination, exact_dedup, hard_negatives, language_id, lm_scoring, packing, run_detection, secret_ledger,
    top_k, url_lists, warc_bundles,
)
from lumenary.llm.common import table
from lumenary.session import cut_lineage, shipped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = shipped(fn)
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return register


@query(
    "op1_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
        FROM documents
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS place,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
        FROM d
    )
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
    """,
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op7_benchmark_decontamination",
    r"""
    WITH dw AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
    ), bw AS (
        SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
    ), wins AS (
        SELECT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS phrase
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
    ), sizes AS (SELECT DISTINCT size FROM wins),
    spans AS (
        SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS phrase
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM dw, sizes WHERE len(w) >= size)
    ), occ AS (SELECT DISTINCT sp.doc_id, sp.size, sp.s, wins.item_id FROM spans sp JOIN wins ON sp.size = wins.size AND sp.phrase = wins.phrase),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM occ) GROUP BY 1),
    its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY 1)
    SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(hit.n, 0) > 0 AS contaminated
    FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
    """,
)
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated")
    )


@query("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumnRenamed("id", "doc_id")


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language_id.held_out()
    network = language_id.fit(docs, held)
    found = language_id.identify(docs.select("doc_id", "text", held.alias("held_out")), network)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query("op2_secret_scans")
def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a ledger: the base rules first, then all rules, for which only the added ones are unseen pairs."""
    docs = table(spark, sf_dir, "documents")
    ledger = secret_ledger.new_entries(docs, None, secret_ledger.BASE_RULES)
    found, _ = secret_ledger.scan_documents(docs, cut_lineage(ledger))
    base = [r.kind for r in secret_ledger.BASE_RULES]

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def only(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(only(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(only(*base)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op8_warc_bundles")
def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    return warc_bundles.round_trip(pages).select(
        F.expr("nullif(record, '')").cast(kind).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        F.expr("nullif(refers_to, '')").cast(kind).alias("refers_to"),
    )


@query("op4_lm_scoring")
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score_documents(table(spark, sf_dir, "documents"), lm_scoring.held_out())
    return scored.withColumnRenamed("id", "doc_id")


@query(
    "op3_url_filters",
    r"""
    WITH cap AS (
        SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 120 AS INTEGER) AS day,
               nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.$', ''), '') AS host
        FROM pages
    ), raw AS (
        SELECT 'adult' AS list, 'domain:' || host AS key, day + 10 AS day, 'add' AS action FROM cap WHERE host IS NOT NULL AND page_id % 3 = 0
        UNION ALL SELECT 'adult', 'domain:' || host, day + 25, 'remove' FROM cap WHERE host IS NOT NULL AND page_id % 6 = 0
        UNION ALL SELECT 'spam', 'domain:' || substr(host, strpos(host, '.') + 1), day, CASE WHEN page_id % 10 = 4 THEN 'add' ELSE 'remove' END
                  FROM cap WHERE host IS NOT NULL AND page_id % 5 = 4
        UNION ALL SELECT 'takedown', 'url:' || url, day - 1, 'add' FROM cap WHERE url IS NOT NULL AND page_id % 7 = 1
    ), daily AS (
        SELECT list, key, day, max(action = 'remove') AS removed FROM raw GROUP BY ALL
    ), changes AS (
        SELECT * FROM (SELECT *, lag(removed) OVER (PARTITION BY list, key ORDER BY day) AS before FROM daily)
        WHERE removed IS DISTINCT FROM before
    ), spans AS (
        SELECT * FROM (SELECT list, key, removed, day AS valid_from,
                              coalesce(lead(day) OVER (PARTITION BY list, key ORDER BY day), DATE '9999-12-31') AS valid_to FROM changes)
        WHERE NOT removed
    ), keys AS (
        SELECT page_id, day, 'url:' || url AS key FROM cap WHERE url IS NOT NULL
        UNION ALL
        SELECT page_id, day, 'domain:' || array_to_string(l[i:], '.')
        FROM (SELECT page_id, day, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, day, string_split(host, '.') AS l FROM cap WHERE host IS NOT NULL))
    ), hits AS (
        SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
        FROM keys JOIN spans ON keys.key = spans.key AND keys.day >= valid_from AND keys.day < valid_to GROUP BY 1
    )
    SELECT cap.page_id, host, CAST(coalesce(n, 0) AS BIGINT) AS n_entries, coalesce(lists, '') AS lists, n IS NOT NULL AS blocked
    FROM cap LEFT JOIN hits ON cap.page_id = hits.page_id
    """,
)
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures of dated fetches, against three lists whose entries the pages' own hosts give."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 120).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("day")).withColumn("host", url_lists.host_of(F.col("url")))
    hosts = captures.filter("host is not null")
    domain = F.concat(F.lit("domain:"), F.col("host"))
    parent = F.concat(F.lit("domain:"), F.expr("substr(host, instr(host, '.') + 1)"))

    def entries(rows, name, key, day, action):
        return rows.select(F.lit(name).alias("list"), key.alias("key"), day.alias("day"), action.alias("action"))

    add, remove = F.lit(url_lists.ADD), F.lit(url_lists.REMOVE)
    listed = (
        entries(hosts.filter("page_id % 3 = 0"), "adult", domain, F.date_add("day", 10), add)
        .union(entries(hosts.filter("page_id % 6 = 0"), "adult", domain, F.date_add("day", 25), remove))
        .union(entries(hosts.filter("page_id % 5 = 4"), "spam", parent, F.col("day"), F.when(F.col("page_id") % 10 == 4, add).otherwise(remove)))
        .union(entries(captures.filter("url is not null AND page_id % 7 = 1"), "takedown", F.concat(F.lit("url:"), F.col("url")), F.date_add("day", -1), add))
    )
    judged = url_lists.judge_captures(captures, listed)
    return judged.select(F.col("id").alias("page_id"), "host", "n_entries", F.concat_ws(",", "lists").alias("lists"), "blocked")


@query("op10_chat_windows")
def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    back = chat_windows.read_windows(chat_windows.format_windows(talks.unionByName(more)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("targets", "")
    return back.select(
        F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("n_chars").alias("formatted_chars"),
    )


@query(
    "op11_exact_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM s
    WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 5
    """,
)
def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).withColumnRenamed("id", "vec_id")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one document of ten, the words from some place on repeat a stretch, as the contract says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n, g = F.size("words"), F.col("g")
    rows = rows.withColumn("a", F.when(n > 0, g % n).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    repeated = F.transform(F.slice("words", F.col("a") + 1, n), lambda w, i: F.get("words", F.col("a") + i % F.col("p")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), repeated), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_detection.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@query(
    "op13_hard_negatives",
    """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
        FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
    ), positives AS (
        SELECT anchor_id, vec_id, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, n.vec_id AS negative_id,
           p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
    WINDOW best AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER best <= 3
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)
