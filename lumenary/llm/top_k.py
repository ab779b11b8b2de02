"""Exact top-k search: tiled matrix products of queries and shards, partial selection per tile, tree merging of lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.llm import tiles
from lumenary.llm.common import Scratch
from lumenary.session import cut_lineage

FOUND = "query_id long, rank int, id long, score long"


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each query row the k rows with the highest integer inner product.

    Components count as floor(scale * x); the sums are exact (cut to the range of long where they go beyond it). Ties
    go to the smaller id. A query's own rows are those with its id. Rows with a null id or vector, or with a component
    that is null or (times `scale`) not finite, take no part. A shorter vector counts as zeros behind its end, an empty
    one as zeros. Rows that repeat an id are each a candidate and, if queries, each a query. With fewer than k
    candidates all are listed; an empty table gives no rows. Only the named columns are read.
    """
    table = tiles.chosen_rows(vectors, id_col, vector_col)
    asked = tiles.chosen_rows(vectors.filter(is_query), id_col, vector_col)

    def select(queries: tiles.Rows, _: dict, shard: tiles.Rows) -> tuple[np.ndarray, np.ndarray]:
        scores = tiles.without_own(tiles.tile_product(queries.matrix, shard.matrix), queries, shard)
        return tiles.best_of(scores, shard.ids, k)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                scores, ids = (tiles.numbers(row[c]).reshape(-1, k) for c in ("scores", "ids"))
                at, place = np.nonzero(scores != tiles.ABSENT)
                columns = [tiles.numbers(row["queries"])[at], (place + 1).astype(np.int32), ids[at, place], scores[at, place]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "rank", "id", "score"])

    with Scratch(vectors.sparkSession, "top_k") as scratch:
        held = tiles.store_tiles(asked, scale, scratch)
        best = tiles.lists(table, held, scale, k, select, scratch)
        return cut_lineage(best.join(held.select("tile", F.col("ids").alias("queries")), "tile").mapInArrow(unpacked, FOUND))
