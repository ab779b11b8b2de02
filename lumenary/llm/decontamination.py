"""Benchmark decontamination over a distributed positional inverted index.

Training words that any test item uses are stored as postings (document, position, term). A window of
item words is looked up from its rarest term: the postings of that term give candidate places, the
offset-adjusted list of the second rarest term thins them, and the remaining terms confirm them. Long
lists of frequent words are therefore only read next to a place that two rarer words already agree on.
Built-in functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import Scratch, document, whole
from lumenary.session import cut_lineage

WINDOW_WORDS = 10
#: A table is broadcast up to this many bytes, measured before; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

#: Characters that end a word, [\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z have become a-z.
BREAKS = "".join(chr(c) for c in range(128) if not (chr(c).isalnum()))


def words(text: Column) -> Column:
    """Array of words; empty for a null or empty text."""
    plain = F.translate(whole(text), string.ascii_uppercase + BREAKS, string.ascii_lowercase + " " * len(BREAKS))
    return F.array_remove(F.split(plain, " "), "")


def if_small(df: DataFrame) -> DataFrame:
    """`df`, marked for broadcast if its rows, at 64 bytes each besides their text, are within the bound."""
    texts = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind == "string"]
    row = df.agg(F.count(F.lit(1)), *texts).first()
    return F.broadcast(df) if 64 * row[0] + sum(v or 0 for v in row[1:]) <= BROADCAST_BYTES else df


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """(win, terms) per different window, and (win, item) memberships.

    An item of fewer words than `size`, but not none, is one window. A null item id counts as "null".
    """
    listed = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words(F.col(text_col)).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))
    spans = listed.filter(F.size("all") > 0).select("item", "all", F.explode(starts).alias("at"))
    spans = cut_lineage(spans.select("item", F.slice("all", F.col("at"), size).alias("terms")).distinct())
    windows = cut_lineage(spans.select("terms").distinct().withColumn("win", F.monotonically_increasing_id()))
    return windows, spans.join(windows, "terms").select("win", "item")


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_words, pos, term) postings of the vocabulary; positions count from 1.

    Every input row also has a posting of the empty term at position 0, so the index lists all documents.
    """
    rows = docs.select(document(F.col(id_col), F.col(text_col)).alias("doc"), words(F.col(text_col)).alias("all"))
    placed = rows.select("doc", F.size("all").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "all")).alias("pos", "term"))
    vocabulary = vocabulary.select("term").union(vocabulary.sparkSession.range(1).select(F.lit(""))).distinct()
    return placed.join(if_small(cut_lineage(vocabulary)), "term").select("doc", "n_words", "pos", "term")


def plan_windows(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(win, size, terms): a window's (n, offset, term) from the rarest on; windows with an unseen term go."""
    seen = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = windows.select("win", F.posexplode("terms").alias("offset", "term"))
    counted = terms.join(seen, "term", "left")
    ordered = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term")))
    return counted.groupBy("win").agg(ordered.alias("terms")).filter("terms[0].n > 0").withColumn("size", F.size("terms"))


def matches(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """(doc, win, start, size): where all terms of a window stand.

    With `slop` 0 the terms follow each other exactly; otherwise each term may stand up to `slop` words away
    from its place behind the rarest one (a proximity match, `start` as if the rarest stood in its place).
    """
    planned = cut_lineage(plan_windows(index, windows))
    first, second = F.col("terms")[0], F.get("terms", F.lit(1))
    heads = planned.select("win", "size", first["offset"].alias("o1"), first["term"].alias("term"), second["offset"].alias("o2"), second["term"].alias("t2"))
    found = index.filter("pos > 0").join(if_small(heads), "term")
    found = found.select("doc", "win", "size", (F.col("pos") - F.col("o1")).alias("start"), "o2", "t2").filter("start > 0")
    found = cut_lineage(found)
    done = found.filter("size = 1").select("doc", "win", "start", "size")

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        place = F.col("pos") == F.col("want") if slop == 0 else F.abs(F.col("pos") - F.col("want")) <= slop
        return left.join(right, (F.col("doc") == F.col("at_doc")) & (F.col("need") == F.col("term")) & place)

    lists = index.filter("pos > 0").select(F.col("doc").alias("at_doc"), "pos", "term")
    seconds = lists.join(if_small(cut_lineage(heads.select(F.col("t2").alias("term")).filter("term is not null").distinct())), "term", "left_semi")
    open_ = found.filter("size > 1").select("doc", "win", "size", "start", F.col("t2").alias("need"), (F.col("start") + F.col("o2")).alias("want"))
    agreed = cut_lineage(near(open_, seconds).select("doc", "win", "size", "start").distinct())
    done = done.unionByName(agreed.filter("size = 2"))

    rest = agreed.filter("size > 2").join(if_small(planned.select("win", "terms")), "win")
    rest = rest.select("doc", "win", "size", "start", F.explode(F.slice("terms", 3, 1 << 30)).alias("t"))
    rest = rest.select("doc", "win", "size", "start", F.col("t.offset").alias("offset"), F.col("t.term").alias("need"), (F.col("start") + F.col("t.offset")).alias("want"))
    touched = agreed.filter("size > 2").select(F.col("doc").alias("at_doc")).distinct()
    confirmed = near(rest, lists.join(touched, "at_doc", "left_semi")).groupBy("doc", "win", "size", "start")
    held = confirmed.agg(F.count_distinct("offset").alias("n")).filter("n = size - 2").drop("n")
    return done.unionByName(held.select("doc", "win", "start", "size"))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    size: int = WINDOW_WORDS,
) -> DataFrame:
    """(id, tag, n_words, n_hit, n_items, items_sha256): one row per row of `docs`.

    A word is hit when it lies inside any occurrence of a window. Texts without words, null ones among them,
    have no hits; the digest of no items is that of the empty string. Rows that repeat id and text have the
    same answer; rows that share only the id are answered each for its own text. Only the named columns are
    read, so other columns may have any name.
    """
    windows, members = item_windows(items, item_id, item_text, size)
    with Scratch(docs.sparkSession, "postings") as scratch:
        index = scratch.keep(build_index(docs, windows.select(F.explode("terms").alias("term")), id_col, text_col))
        places = cut_lineage(matches(index, windows).distinct())
        inside = places.select("doc", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos"))
        hits = inside.distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit"))
        held = places.select("doc", "win").distinct().join(if_small(members), "win").select("doc", "item").distinct()
        held = held.groupBy("doc").agg(F.sort_array(F.collect_list("item")).alias("items"))
        listed = index.filter("pos = 0").select("doc", "n_words")
        found = cut_lineage(listed.join(hits, "doc", "left").join(held, "doc", "left"))
    return found.select(
        "doc.id",
        "doc.tag",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))), 256).alias("items_sha256"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of `docs` without a hit, all columns as they are."""
    found = contamination(docs, items, id_col, text_col, **names).filter("n_hit > 0")
    dirty = cut_lineage(found.select(F.struct("id", "tag").alias("doc")).distinct())
    packed = docs.select(F.struct("*").alias("full"))
    packed = packed.withColumn("doc", document(F.col(f"full.{id_col}"), F.col(f"full.{text_col}")))
    return packed.join(dirty, "doc", "left_anti").select("full.*")
