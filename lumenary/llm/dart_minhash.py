"""Near duplicates by DartMinHash signatures and banded joining.

The weight of an element times a range of ranks is a region of the plane. Hashed darts fall on the plane with
one dart to a unit cell on average, the same darts for every document that has the element; a document keeps
the darts inside its weights. Each dart belongs to one of k coordinates, and the earliest one, that is of
lowest rank, is the coordinate's value. Two documents agree in a coordinate with the probability of their
weighted Jaccard similarity. The work is in proportion to a document's weight plus k log k.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.functions.blockmatch import components
from lumenary.llm.common import Scratch, keep_rows
from lumenary.llm.tokens import MIX_A, MIX_B, STEP, mix, release, slices, word_codes, word_hashes
from lumenary.session import cut_lineage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares none of 30 bands of 7 rows with probability 0.0009, one of 0.85 with 3e-5.
BANDS, ROWS = 30, 7
#: Buckets of up to so many members are gone through as pairs; members in a block of larger ones.
PAIRED, BLOCK_MEMBERS = 8, 1000
#: Bits of a rank below the unit.
RANK_BITS = 44
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
CELLS_AT_ONCE = 1 << 17
#: Text whose shingles a task holds at once; they take some thirty times its size.
SKETCHED_BYTES = 2 << 20
#: Chance of at most 0, 1, 2, ... darts in a unit cell, as a 32-bit threshold.
POISSON = np.array([min(2**32 - 1, round(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)))) for i in range(12)], dtype=np.uint64)

Weigh = Callable[[np.ndarray, np.ndarray], np.ndarray]


def present(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Every shingle of a text weighs one: the signature estimates the Jaccard similarity of sets."""
    return np.ones(len(elements))


def repeated(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A shingle weighs its number of places in the text."""
    return counts.astype(float)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Signatures, a row of k values per document; elements offsets[i]:offsets[i+1] are those of document i.

    A document without weight has a row of EMPTY.
    """
    n = len(offsets) - 1
    out = np.full((n, k), EMPTY)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    total = np.bincount(owner, weights, n)
    darts = k * math.log(k) + 2 * k
    low, high = np.zeros(n), np.where(total > 0, darts / np.maximum(total, 1e-300), 0)
    todo = np.flatnonzero(total > 0)
    while len(todo):  # again over higher ranks, where a coordinate has had no dart
        cells = np.zeros(n)
        np.add.at(cells, owner, np.ceil(weights) * (np.ceil(high) - np.floor(low))[owner])
        load, first = np.cumsum(cells[todo]), 0
        while first < len(todo):
            last = max(first + 1, int(np.searchsorted(load, (load[first - 1] if first else 0) + CELLS_AT_ONCE, side="right")))
            throw(elements, weights, offsets, todo[first:last], low, high, out)
            first = last
        todo = todo[(out[todo] == EMPTY).any(axis=1)]
        low, high = high, np.where(high > 0, 2 * high, 0)
    return out


def throw(elements, weights, offsets, docs, low, high, out) -> None:
    """Put the darts with ranks from low to high of some documents into their open coordinates."""
    k = out.shape[1]
    at = np.concatenate([np.arange(offsets[d], offsets[d + 1]) for d in docs])
    doc = np.repeat(docs, offsets[docs + 1] - offsets[docs])
    strips = np.ceil(weights[at]).astype(np.int64)
    doc, strip = np.repeat(doc, strips), ranges(strips)
    element, weight = np.repeat(elements[at], strips), np.repeat(weights[at], strips)
    bottom = np.floor(low[doc]).astype(np.int64)
    levels = np.ceil(high[doc]).astype(np.int64) - bottom
    rank = np.repeat(bottom, levels) + ranges(levels)
    cell = np.repeat(mix(mix(element.astype(np.uint64) * STEP + np.uint64(1)) + strip.astype(np.uint64) * MIX_B), levels)
    cell = mix(cell + rank.astype(np.uint64) * MIX_A)
    number = np.searchsorted(POISSON, cell >> np.uint64(32), side="right")
    dart = mix(np.repeat(cell, number) + (ranges(number).astype(np.uint64) + np.uint64(1)) * STEP)
    doc = np.repeat(np.repeat(doc, levels), number)
    value = (np.repeat(rank, number).astype(np.uint64) << np.uint64(RANK_BITS)) | (dart >> np.uint64(64 - RANK_BITS))
    height = value.astype(float) / 2.0**RANK_BITS
    inside = (height >= low[doc]) & (height < high[doc])
    if (weights[at] % 1).any():
        spot = mix(dart + MIX_A)
        reach = np.repeat(np.repeat(weight - strip, levels), number)
        inside &= (spot >> np.uint64(11)).astype(float) / 2.0**53 < reach
    doc, value, dart = doc[inside], value[inside], dart[inside]
    place = doc * k + (mix(dart + MIX_B) % np.uint64(k)).astype(np.int64)
    flat, open_ = out.reshape(-1), None
    if low[docs].any():
        open_ = flat[place] == EMPTY
        place, value = place[open_], value[open_]
    np.minimum.at(flat, place, value)


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0 .. length-1 for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements, counts, offsets): the different word shingles of each text as sorted 32-bit hashes.

    A text of fewer words than `size`, but not none, is one shingle.
    """
    codes, starts, names = word_codes(texts)
    hashes = word_hashes(names)[codes]
    n = len(starts) - 1
    doc = np.repeat(np.arange(n), np.diff(starts))
    place, end = np.arange(len(codes)), starts[1:][doc]
    first = np.flatnonzero((place + size <= end) | (place == starts[:-1][doc]))
    value, end = np.zeros(len(first), dtype=np.uint64), end[first]
    for j in range(size):
        there = first + j < end
        value = np.where(there, mix(value * STEP + hashes[np.minimum(first + j, len(codes) - 1)] + np.uint64(1)), value)
    keys, counts = np.unique((doc[first].astype(np.uint64) << np.uint64(32)) | (value >> np.uint64(32)), return_counts=True)
    offsets = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts, offsets


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signatures), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(signatures), b + 1, dtype=np.uint64)
        for c in range(b * rows, (b + 1) * rows):
            key = mix(key * STEP + signatures[:, c])
        out[:, b] = key
    return out.view(np.int64)


def sketch_batch(batch: pa.RecordBatch, size: int, bands: int, rows: int, weigh: Weigh) -> Iterator[pa.RecordBatch]:
    """The sketches of a batch of (id, tag, text), a part of its text at a time."""
    for part in slices(batch, "text", SKETCHED_BYTES):
        elements, counts, offsets = shingle_sets(part.column("text"), size)
        signatures = dart_signatures(elements, weigh(elements, counts), offsets, bands * rows)
        keys = band_keys(signatures, bands, rows)
        n = np.diff(offsets)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(elements.astype(np.uint64) + STEP))])
        node = mix(sums[offsets[1:]] - sums[offsets[:-1]] + n.astype(np.uint64) * MIX_A).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("id"),
                part.column("tag"),
                pa.array(node, mask=n == 0),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(elements.view(np.int32))),
                pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)), pa.array(keys[n > 0].reshape(-1))
                ),
            ],
            names=["id", "tag", "node", "shingles", "bands"],
        )
        release()


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int, weigh: Weigh) -> DataFrame:
    """(id, tag, node, shingles, bands) of every row; equal shingle sets have one node, none has null."""
    chosen = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from sketch_batch(batch, size, bands, rows, weigh)

    return chosen.mapInArrow(sketch, f"id {kind}, tag long, node long, shingles array<int>, bands array<long>")


def find_links(sketched: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """(node, root): components of the links of that similarity between nodes that share a bucket.

    A bucket is not expanded into its pairs. First all members are compared with one, its centre, which joins
    the near copies of a large group over the different centres of the bands. Only buckets whose members are
    then still of several components are gone through: small ones as pairs, large ones in blocks inside
    tasks, where members outside the bucket's main component meet all others and only links leave the task.
    """
    members = sketched.filter("node is not null").select(F.explode("bands").alias("bucket"), "node").distinct()
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = cut_lineage(members.join(shared, "bucket", "left_semi"))
    nodes = members.select("node").distinct()
    reps = cut_lineage(sketched.select("node", "row").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")))
    sets = scratch.keep(sketched.select("row", "node", "shingles").join(reps.select("row"), "row", "left_semi").select("node", "shingles"))

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.size("shingles").alias("na"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.size("shingles").alias("nb"))
        # the sizes alone rule many pairs out before the sets are compared
        both = pairs.join(left, "a").join(right, "b").filter(F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
        common = F.size(F.array_intersect("sa", "sb"))
        return both.filter(common >= similarity * (F.col("na") + F.col("nb") - common)).select("a", "b")

    def ordered(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    centres = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "node"), "node"))["node"].alias("centre"))
    tested = cut_lineage(members.join(cut_lineage(centres), "bucket").filter("node <> centre").select(*ordered("centre", "node")).distinct())
    links = cut_lineage(verified(tested))
    roots = components(links, "long", cut_lineage)

    labelled = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    parts = labelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_roots"), F.max(F.struct("n", "root")).alias("top"))
    split = split.select("bucket", "n", "n_roots", F.col("top.n").alias("n_main"), F.col("top.root").alias("main"))
    rest = cut_lineage(labelled.join(cut_lineage(split.filter("n_roots > 1").drop("n_roots")), "bucket"))
    small = rest.filter(F.col("n") <= PAIRED)
    other = small.select("bucket", F.col("node").alias("other"), F.col("root").alias("other_root"))
    pairs = small.join(other, "bucket").filter("root < other_root").select(*ordered("node", "other")).distinct()
    more = verified(pairs.join(tested, ["a", "b"], "left_anti")).unionByName(block_links(rest.filter(F.col("n") > PAIRED), sets, similarity))
    more = cut_lineage(more.distinct())
    return roots if more.isEmpty() else components(links.unionByName(more), "long", cut_lineage)


def block_links(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links across components in large buckets, from (bucket, node, root, n, n_main, main).

    A bucket is cut into blocks of members, and its members outside the main component into chunks; every
    chunk meets every block. The links are exact, and a task holds the sets of a block and a chunk.
    """
    blocks, chunks = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int"), F.ceil((F.col("n") - F.col("n_main")) / BLOCK_MEMBERS).cast("int")
    place = F.xxhash64("node")
    met = rest.select("bucket", "node", "root", F.lit(False).alias("aside"), F.pmod(place, blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    aside = rest.filter("root <> main").select(
        "bucket", "node", "root", F.lit(True).alias("aside"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(place, chunks).cast("int").alias("chunk")
    )
    dealt = met.unionByName(aside).join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        aside = table.column("aside").to_numpy(zero_copy_only=False)
        shingles = table.column("shingles").combine_chunks()
        size = pa.compute.list_value_length(shingles).to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(node)), size)
        _, code = np.unique(shingles.flatten().to_numpy(), return_inverse=True)
        listed = owner[np.argsort(code, kind="stable")]
        edges = np.concatenate([[0], np.cumsum(np.bincount(code))])
        starts = np.cumsum(size) - size
        a, b = [], []
        for i in np.flatnonzero(aside):
            mine = code[starts[i] : starts[i] + size[i]]
            length = edges[mine + 1] - edges[mine]
            common = np.bincount(listed[np.repeat(edges[mine], length) + ranges(length)], minlength=len(node))
            found = np.flatnonzero(~aside & (root != root[i]) & (common >= similarity * (size + size[i] - common)))
            # one link to a component joins it
            found = found[np.unique(root[found], return_index=True)[1]]
            a.append(np.minimum(node[i], node[found]))
            b.append(np.maximum(node[i], node[found]))
        empty = np.zeros(0, dtype=np.int64)
        return pa.table({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b])})

    return dealt.groupBy("bucket", "block", "chunk").applyInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, similarity: float = SIMILARITY,
    bands: int = BANDS, rows: int = ROWS, weigh: Weigh = present,
) -> DataFrame:
    """(id, tag, class_id, class_size, n_tied, kept): one row per input row.

    A class holds all rows that links of at least `similarity` (Jaccard, of sets of `size`-word shingles)
    connect; its id is its smallest document id, a null id last, and that row stays. Of rows that repeat
    that id and text one stays, and `n_tied` counts them. Equal sets are one node however many rows have
    them. A text without words, null ones among them, is in a class with rows that repeat it and its id
    only. Only the named columns are read, so others may have any name.
    """
    with Scratch(docs.sparkSession, "sketches") as scratch:
        sketched = sketches(docs, id_col, text_col, size, bands, rows, weigh)
        sketched = scratch.keep(sketched.withColumn("row", F.monotonically_increasing_id()))
        roots = find_links(sketched, scratch, similarity)
        plain = sketched.select("id", "tag", "row", "node")
        own = F.concat_ws(" ", F.lit("id"), F.col("id").isNull(), F.coalesce(F.col("id").cast("string"), F.lit("")), "tag")
        label = F.coalesce(F.coalesce("root", "node").cast("string"), own)
        labelled = cut_lineage(plain.join(roots, "node", "left").select("id", "tag", "row", label.alias("label")))
    groups = (
        labelled.groupBy("label", "id", "tag")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
        .groupBy("label")
        .agg(F.sum("n").alias("class_size"), F.min(F.struct(F.col("id").isNull(), "id", "row", "n")).alias("best"))
    )
    # a table of its own, so that the adaptive join can split a label with very many rows
    return labelled.join(cut_lineage(groups), "label").select(
        "id", "tag", F.col("best.id").alias("class_id"), "class_size", F.col("best.n").alias("n_tied"), (F.col("row") == F.col("best.row")).alias("kept")
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, all columns as they are."""
    found = near_duplicates(docs, id_col, text_col, **options).filter("kept")
    kept = cut_lineage(found.select(F.struct("id", "tag").alias("doc"), "n_tied"))
    return keep_rows(docs, kept, id_col, text_col)
