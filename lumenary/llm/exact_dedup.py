"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after all ASCII white space is deleted. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import WHITE_SPACE, keep_rows, maybe_among, whole
from lumenary.session import cut_lineage

PREFIX_CHARS = 64


def normalized(text: Column) -> Column:
    return F.translate(whole(text), WHITE_SPACE, "")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False
) -> DataFrame:
    """(id, tag, text_sha256, keep_id, group_size, n_tied, kept): one row per input row.

    Of equal texts the row with the most code points in the original text stays, then the smallest id, a
    null id last. Rows that also share the id are told apart by their place, so one of them stays; `n_tied`
    counts them. A null text is an empty text, and all empty texts are one group. Other columns of `docs`
    are not read, whatever their names.

    The first scan measures lengths and hashes prefixes: lengths that occur once end at the first level, (length,
    prefix hash) keys that occur once at the second. The second scan reads the content of the rows whose key
    is left and hashes it in full; a small set of bits tells them from the others, so no text is shuffled. For the
    others `text_sha256` is null (or known by chance), unless `digest_all` asks the second scan for theirs too.
    Counts are combined before every shuffle. The row-keeping joins carry no group as a unit, so a key with a third of
    the rows is split by the adaptive skew join.
    """
    body = normalized(F.col("text"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(
        "id",
        F.xxhash64("text").alias("tag"),
        F.length(whole("text")).alias("n_points"),
        F.octet_length(body).alias("len"),
        F.xxhash64(F.substring(body, 1, prefix_chars)).alias("prefix"),
        body.alias("body"),
    )
    keys = cut_lineage(shared_keys(rows))
    digest = F.sha2("body", 256)
    wanted = digest if digest_all else F.when(maybe_among(keys, "len", "prefix"), digest)
    hashed = cut_lineage(rows.select("id", "tag", "n_points", "len", "prefix", wanted.alias("sha")).withColumn("row", F.monotonically_increasing_id()))
    survivors = hashed.join(keys, ["len", "prefix"], "left_semi")
    groups = (
        survivors.groupBy("len", "sha", "n_points", "id", "tag")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
        .groupBy("len", "sha")
        .agg(
            F.sum("n").alias("group_size"),
            F.min(F.struct(-F.col("n_points"), F.col("id").isNull(), "id", "row", "n")).alias("best"),
        )
        .filter("group_size > 1")
    )
    # a table of its own, so that the adaptive join can split a group with very many rows
    return hashed.join(cut_lineage(groups), ["len", "sha"], "left").select(
        "id",
        "tag",
        F.col("sha").alias("text_sha256"),
        F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce("best.n", F.lit(1).cast("long")).alias("n_tied"),
        F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("kept"),
    )


def shared_keys(rows: DataFrame) -> DataFrame:
    """(len, prefix) keys with more than one row, after lengths with one row have gone."""
    keys = cut_lineage(rows.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n")))
    lengths = keys.groupBy("len").agg(F.sum("n").alias("rows")).filter("rows > 1").select("len")
    return keys.filter("n > 1").join(lengths, "len", "left_semi").select("len", "prefix")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns as they are.

    Rows that repeat id and text give one row.
    """
    found = exact_duplicates(docs, id_col, text_col).filter("kept")
    kept = cut_lineage(found.select(F.struct("id", "tag").alias("doc"), "n_tied"))
    return keep_rows(docs, kept, id_col, text_col)
