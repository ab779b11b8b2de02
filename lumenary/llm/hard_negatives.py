"""Hard-negative mining by Kronecker-packed products.

Several candidates share one wide integer per component: each candidate's component, biased so that it isn't
negative, has a field of its own, wide enough for the largest sum. An anchor's component multiplies the integer once
and so all candidates in it; the fields of the sum are the products, from which the biases are taken out. A float64
holds integers of 53 bits exactly, so while two fields fit in these the products run as matrix products; wider
ones are Python integers of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.llm import tiles
from lumenary.llm.common import Scratch
from lumenary.session import cut_lineage

#: Bits of a float64's exact integers, and candidates in one Python integer.
EXACT_BITS, TOGETHER = 53, 512
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def packed_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all anchors and candidates, whole components on both sides, by packed multiplication."""
    width = min(anchors.shape[1], candidates.shape[1])
    a, c = anchors[:, :width], candidates[:, :width]
    if not (a.size and c.size):
        return np.zeros((len(anchors), len(candidates)), dtype=np.int64)
    bias_a, bias_c = (-min(int(x.min()), 0) for x in (a, c))
    bits = (width * (int(a.max()) + bias_a) * (int(c.max()) + bias_c)).bit_length() or 1
    fields = EXACT_BITS // bits
    if fields < 2:
        return wide_products(a, c, bias_a, bias_c, bits)
    n = len(c)
    biased = np.zeros((-(-n // fields) * fields, width))
    biased[:n] = c + bias_c
    wide = np.zeros((len(biased) // fields, width))
    for t in range(fields):
        wide += biased[t::fields] * float(1 << (bits * t))
    sums = ((a + bias_a) @ wide.T).astype(np.int64)
    scores = np.empty((len(a), len(biased)), dtype=np.int64)
    for t in range(fields):
        scores[:, t::fields] = (sums >> (bits * t)) & ((1 << bits) - 1)
    scores = scores[:, :n]
    scores -= (bias_c * a.sum(axis=1)).astype(np.int64)[:, None]
    scores -= (bias_a * c.sum(axis=1)).astype(np.int64) + width * bias_a * bias_c
    return scores


def wide_products(a: np.ndarray, c: np.ndarray, bias_a: int, bias_c: int, bits: int) -> np.ndarray:
    """The same with Python integers, cut to the range of long."""
    size = -(-bits // 8)
    whole_a, whole_c = ([[int(x) for x in row] for row in side] for side in (a, c))
    out = np.empty((len(a), len(c)), dtype=np.int64)
    for at in range(0, len(c), TOGETHER):
        some = whole_c[at : at + TOGETHER]
        wide = [int.from_bytes(b"".join((row[j] + bias_c).to_bytes(size, "little") for row in some), "little") for j in range(a.shape[1])]
        over = [bias_a * sum(row) + len(wide) * bias_a * bias_c for row in some]
        for i, anchor in enumerate(whole_a):
            total = sum((x + bias_a) * w for x, w in zip(anchor, wide)).to_bytes(size * len(some), "little")
            less = bias_c * sum(anchor)
            sums = (int.from_bytes(total[t * size : (t + 1) * size], "little") - less - over[t] for t in range(len(some)))
            out[i, at : at + len(some)] = [min(max(x, tiles.ABSENT + 1), 2**63 - 1) for x in sums]
    return out


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95,
    scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of anchors and positives.

    Components count as floor(scale * x), scores are integer inner products with the anchor; high scores come first,
    ties by smaller id. An anchor's positives are its first `positives` other rows of the same label. For each of
    them, the first `negatives` rows of another label come back whose score is from `lower` to `upper` percent of the
    positive's. A row's own rows are those with its id. Rows with a null id, label or vector, or with a component that
    is null or (times `scale`) not finite, take no part. A shorter vector counts as zeros behind its end. Rows that
    repeat an id are used each. Without positives or negatives an anchor has no rows; an empty table gives none. Only
    the named columns are read.
    """
    table = tiles.chosen_rows(vectors, id_col, vector_col, label)
    asked = tiles.chosen_rows(vectors.filter(is_anchor), id_col, vector_col, label)

    def nearest_alike(anchors: tiles.Rows, _: dict, shard: tiles.Rows) -> tuple[np.ndarray, np.ndarray]:
        scores = packed_products(anchors.matrix, shard.matrix)
        scores[anchors.labels[:, None] != shard.labels] = tiles.ABSENT
        return tiles.best_of(tiles.without_own(scores, anchors, shard), shard.ids, positives)

    def nearest_below(anchors: tiles.Rows, known: dict, shard: tiles.Rows) -> tuple[np.ndarray, np.ndarray]:
        scores = packed_products(anchors.matrix, shard.matrix)
        scores[anchors.labels[:, None] == shard.labels] = tiles.ABSENT
        scores = tiles.without_own(scores, anchors, shard)
        mine = tiles.numbers(known["positive_scores"]).reshape(-1, positives)[known["from"] :][: len(scores)]
        found = []
        for p in range(positives):
            ends = [(-(-lower * x // 100), upper * x // 100) if x != tiles.ABSENT else (1, 0) for x in mine[:, p].tolist()]
            low, high = (np.array(x, dtype=np.int64)[:, None] for x in zip(*ends))
            found.append(tiles.best_of(np.where((scores >= low) & (scores <= high), scores, tiles.ABSENT), shard.ids, negatives))
        # the slots of an anchor lie one behind the other
        return tuple(np.stack([f[i] for f in found], axis=1).reshape(-1, negatives) for i in (0, 1))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                anchors, scores, ids = tiles.numbers(row["anchors"]), *(tiles.numbers(row[c]).reshape(-1, negatives) for c in ("scores", "ids"))
                at, place = np.nonzero(scores != tiles.ABSENT)
                positive = (tiles.numbers(row[c])[at] for c in ("positive_ids", "positive_scores"))
                names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
                pid, pscore = positive
                columns = [anchors[at // positives], pid, (place + 1).astype(np.int32), ids[at, place], pscore, scores[at, place]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    with Scratch(vectors.sparkSession, "hard_negatives") as scratch:
        held = tiles.store_tiles(asked, scale, scratch)
        alike = tiles.lists(table, held, scale, positives, nearest_alike, scratch)
        alike = alike.select("tile", F.col("scores").alias("positive_scores"), F.col("ids").alias("positive_ids"))
        widened = scratch.keep(held.drop("bytes").join(alike, "tile").withColumn("bytes", F.octet_length("matrix") + 2 * F.octet_length("positive_ids")))
        best = tiles.lists(table, widened, scale, negatives, nearest_below, scratch)
        rows = best.join(widened.select("tile", F.col("ids").alias("anchors"), "positive_scores", "positive_ids"), "tile")
        return cut_lineage(rows.mapInArrow(unpacked, FOUND))
