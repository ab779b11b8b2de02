"""Tiles of query vectors that meet the whole table shard by shard, and the tree that merges their lists.

Query rows are stored as tiles of bounded bytes. A round hands some tiles to all tasks, at most ROUND_BYTES of them;
every task takes the table's rows as they lie, in shards, and keeps a list of `k` entries per slot of a tile (a slot
is a query, or a query and one of its partners). Its lists leave it as one row per tile; lists of a tile are merged
FAN_IN at a time until one is left. Table rows are never shuffled, and no row is larger than a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import Scratch
from lumenary.session import cut_lineage

TILE_ROWS, TILE_BYTES, ROUND_BYTES = 4_096, 4 << 20, 48 << 20
SHARD_ROWS, SHARD_BYTES, CELLS = 8_192, 8 << 20, 2 << 20
FAN_IN = 16
#: The score of an entry that isn't there; it comes after all others.
ABSENT = np.iinfo(np.int64).min
TILE = "tile long, n int, bytes long, ids binary, labels binary, matrix binary"
LISTS = "tile long, leaf long, scores binary, ids binary"


@dataclass
class Rows:
    """Vectors with whole components: `matrix` is padded with zeros behind shorter vectors."""

    ids: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray

    def part(self, chosen) -> "Rows":
        return Rows(self.ids[chosen], self.labels[chosen], self.matrix[chosen])


def chosen_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column | None = None) -> DataFrame:
    """(id, label, vec) of the rows that can take part; whether a vector's components are finite is seen in the tasks."""
    out = vectors.select(
        F.col(id_col).cast("long").alias("id"), (F.lit(0) if label is None else label).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vec")
    )
    return out.filter("id is not null and label is not null and vec is not null")


def shards(batch: pa.RecordBatch, scale: float, rows: int = SHARD_ROWS, size: int = SHARD_BYTES) -> Iterator[Rows]:
    """The batch's rows whose components are all finite, each component turned into floor(scale * x), in parts of bounded size."""
    column = batch.column("vec")
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    begins = np.cumsum(lengths) - lengths
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = np.flatnonzero(wrong[begins + lengths] == wrong[begins])
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
    at = 0
    while at < len(good):
        widest = np.maximum.accumulate(lengths[good[at : at + rows]])
        step = max(1, int(np.count_nonzero(widest * np.arange(1, len(widest) + 1) * 8 <= size)))
        own = good[at : at + step]
        width = int(lengths[own].max())
        matrix = np.zeros((len(own), width))
        place = np.arange(width) < lengths[own][:, None]
        matrix[place] = flat[np.repeat(begins[own] - (np.cumsum(lengths[own]) - lengths[own]), lengths[own]) + np.arange(int(lengths[own].sum()))]
        yield Rows(ids[own], labels[own], matrix)
        at += step


def bound_of(one: np.ndarray, two: np.ndarray) -> int:
    """A number that no inner product of the two sides' rows goes beyond, nor any part of it."""
    width = min(one.shape[1], two.shape[1])
    return width * int(np.abs(one[:, :width]).max(initial=0)) * int(np.abs(two[:, :width]).max(initial=0))


def tile_product(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact; beyond the range of long they are cut to it."""
    width, bound = min(one.shape[1], two.shape[1]), bound_of(one, two)
    one, two = one[:, :width], two[:, :width]
    if bound < 1 << 53:
        return (one @ two.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in side], dtype=object).reshape(side.shape) for side in (one, two)]
    return clipped(whole[0] @ whole[1].T)


def clipped(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best entries of each row of a tile by partial selection: high scores, then small ids.

    The shard's ids are ascending, so a score and the place behind it make one number that orders entries.
    """
    n, width = scores.shape
    if not width:
        return np.full((n, k), ABSENT), np.zeros((n, k), dtype=np.int64)
    there = scores != ABSENT
    peak = int(np.abs(np.where(there, scores, 0)).max(initial=0))
    shift = width.bit_length()
    take = min(k, width)
    if peak < 1 << (61 - shift):
        ranked = np.where(there, (scores << shift) + (width - 1 - np.arange(width)), ABSENT)
        top = -np.sort(-np.partition(ranked, width - take, axis=1)[:, width - take :], axis=1) if take < width else np.sort(ranked, axis=1)[:, ::-1]
        found = top != ABSENT
        at = np.where(found, width - 1 - (top & ((1 << shift) - 1)), 0)
        top = np.where(found, top >> shift, ABSENT)
    else:
        at = np.argsort(~scores, axis=1, kind="stable")[:, :take]
        top = np.take_along_axis(scores, at, axis=1)
    out, names = np.full((n, k), ABSENT), np.zeros((n, k), dtype=np.int64)
    out[:, :take], names[:, :take] = top, np.where(top != ABSENT, ids[at], 0)
    return out, names


def merged(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the entries in each row."""
    order = np.lexsort((ids, ~scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def without_own(scores: np.ndarray, queries: Rows, shard: Rows) -> np.ndarray:
    """Entries of a query's own id are taken out, in place; the shard's ids are ascending."""
    first, last = np.searchsorted(shard.ids, queries.ids, "left"), np.searchsorted(shard.ids, queries.ids, "right")
    for row in np.flatnonzero(first < last):
        scores[row, first[row] : last[row]] = ABSENT
    return scores


def store_tiles(rows: DataFrame, scale: float, scratch: Scratch) -> DataFrame:
    """Query rows as stored tiles, numbered by task and place."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in shards(batch, scale, TILE_ROWS, TILE_BYTES):
                data = [part.ids.astype("<i8").tobytes(), part.labels.astype("<i8").tobytes(), part.matrix.astype("<f8").tobytes()]
                columns = [[number], [len(part.ids)], [sum(map(len, data))], *([x] for x in data)]
                types = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["tile", "n", "bytes", "ids", "labels", "matrix"])
                number += 1

    # few full tiles in place of a few rows from each task
    return scratch.keep(rows.hint("rebalance").mapInArrow(packed, TILE))


def rounds_of(tiles: DataFrame) -> Iterator[list[int]]:
    """Numbers of the tiles of each round. The driver sees two numbers of a tile."""
    some, total = [], 0
    for tile, size in tiles.select("tile", "bytes").orderBy("tile").toLocalIterator():
        if some and total + size > ROUND_BYTES:
            yield some
            some, total = [], 0
        some.append(tile)
        total += size
    if some:
        yield some


def numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8")


def rows_of(row: dict) -> Rows:
    return Rows(numbers(row["ids"]), numbers(row["labels"]), np.frombuffer(row["matrix"], dtype="<f8").reshape(row["n"], -1))


#: (queries of a tile, what else is known of it, shard with ascending ids) -> scores and ids of shape (slots, k)
Select = Callable[[Rows, dict, Rows], tuple[np.ndarray, np.ndarray]]


def lists(table: DataFrame, tiles: DataFrame, scale: float, k: int, select: Select, scratch: Scratch) -> DataFrame:
    """(tile, scores, ids): the best `k` entries of each slot of each tile over the whole table.

    A round's lists are stored; a lost executor repeats tasks of one round.
    """
    spark, leaves = table.sparkSession, None
    for some in rounds_of(tiles):
        carried = spark.sparkContext.broadcast(tiles.filter(F.col("tile").isin(some)).toArrow().to_pylist())

        def scan(batches: Iterator[pa.RecordBatch], carried=carried) -> Iterator[pa.RecordBatch]:
            queries = [(row, rows_of(row)) for row in carried.value]
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for shard in shards(batch, scale):
                    shard = shard.part(np.argsort(shard.ids, kind="stable"))
                    for number, (row, tile) in enumerate(queries):
                        step = max(1, CELLS // len(shard.ids))
                        parts = [select(tile.part(slice(at, at + step)), row | {"from": at}, shard) for at in range(0, len(tile.ids), step)]
                        new = tuple(np.concatenate(x) for x in zip(*parts))
                        best[number] = merged(*(np.concatenate(x, axis=1) for x in zip(best[number], new)), k) if number in best else new
            leaf = TaskContext.get().partitionId()
            for number, (scores, ids) in best.items():
                yield list_row(queries[number][0]["tile"], leaf, scores, ids)

        found = scratch.keep(table.mapInArrow(scan, LISTS))
        carried.destroy()
        leaves = found if leaves is None else leaves.unionByName(found)
    return spark.createDataFrame([], "tile long, scores binary, ids binary") if leaves is None else merge_tree(leaves, k)


def list_row(tile: int, leaf: int, scores: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    data = [scores.astype("<i8").tobytes(), ids.astype("<i8").tobytes()]
    return pa.RecordBatch.from_arrays(
        [pa.array([tile]), pa.array([leaf]), *(pa.array([x], pa.binary()) for x in data)], names=["tile", "leaf", "scores", "ids"]
    )


def merge_tree(leaves: DataFrame, k: int) -> DataFrame:
    """One row per tile: lists meet FAN_IN at a time, level by level, so no task holds more than that of a tile."""

    def meet(rows: pa.Table) -> pa.Table:
        scores, ids = (np.concatenate([numbers(x.as_py()).reshape(-1, k) for x in rows.column(c)], axis=1) for c in ("scores", "ids"))
        return pa.Table.from_batches([list_row(rows.column("tile")[0].as_py(), rows.column("leaf")[0].as_py(), *merged(scores, ids, k))])

    most = leaves.agg(F.max("leaf")).first()[0] or 0
    while most:
        leaves, most = leaves.withColumn("leaf", F.floor(F.col("leaf") / FAN_IN)), most // FAN_IN
        leaves = leaves.groupBy("tile", "leaf").applyInArrow(meet, LISTS)
    return cut_lineage(leaves.drop("leaf"))
