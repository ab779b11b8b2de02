"""Blocks of vectors around pivots, and which of them a row can't have a match in.

A few vectors of a table, far from each other, are its pivots; a row belongs to its nearest one, and a pivot knows
the widest angle and the largest norm of its rows. Angles obey the triangle inequality: a row at angle f of a
pivot whose rows lie within r of it is at least f - r away from each of them. A block whose bound lies
below what a row needs is skipped; nothing that could match is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.functions.vector import dense, unit_rows
from lumenary.session import cut_lineage, spread_groups

#: Pivots at most, and the rows they are chosen from.
MOST_PIVOTS, CANDIDATES = 256, 4_096
CANDIDATE_BYTES = 32 << 20
#: Angles and scores are compared with this much room, more than rounding to six digits moves them.
ROOM = 1e-5


@dataclass
class Pivots:
    """Unit vectors of the pivots, and of each one's rows the number, widest angle and largest norm."""

    vectors: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    rows: int

    @property
    def pieces(self) -> np.ndarray:
        """Blocks of each pivot, of `rows` rows or so."""
        return -(-self.count // self.rows)

    def angles(self, matrix: np.ndarray) -> np.ndarray:
        return angles(unit_rows(matrix), self.vectors)

    def bounds(self, matrix: np.ndarray, metric: str) -> np.ndarray:
        """The highest score that a row can have with a row of each pivot."""
        near = np.cos(np.clip(self.angles(matrix) - self.radius, 0.0, np.pi))
        if metric == "cosine":
            return near
        size = np.linalg.norm(matrix, axis=1)[:, None] * self.norm
        return np.where(near > 0, near * size, 0.0)


def angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def vectors_of(column: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa

    return dense(pa.array(column, type=pa.list_(pa.float64())), dim)


def choose(table: DataFrame, key: str, vector: str, dim: int, rows: int) -> Pivots:
    """Pivots of a table: far apart among a bounded number of its rows; every row then counts for its pivot's bounds."""
    usable = table.filter(F.size(vector) == dim)
    total = usable.count()
    wanted = int(min(MOST_PIVOTS, max(8, 2 * -(-total // rows))))
    some = int(min(CANDIDATES, max(wanted, CANDIDATE_BYTES // (8 * dim))))
    tried = usable.select(key, vector).orderBy(F.xxhash64(key), key).limit(some).toArrow()
    unit = unit_rows(dense(tried.column(vector), dim)[0])
    chosen = [0] if len(unit) else []
    nearest = unit @ unit[0] if len(unit) else np.zeros(0)
    while len(chosen) < wanted and len(nearest) and nearest.min() < 1 - ROOM:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    found = unit[chosen].reshape(-1, dim)
    n = len(found)
    bounds = {r["home"]: r for r in _homed(usable, vector, found, dim).groupBy("home").agg(
        F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"), F.max("size").alias("norm")
    ).collect()}
    columns = [np.array([bounds[i][c] if i in bounds else 0 for i in range(n)]) for c in ("n", "radius", "norm")]
    return Pivots(found, columns[0].astype(np.int64), columns[1].astype(float), columns[2].astype(float), rows)


def _homed(table: DataFrame, vector: str, pivots: np.ndarray, dim: int) -> DataFrame:
    """Adds home (its nearest pivot), angle and size (norm) to rows of the right length."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrix, ok = vectors_of(batch[vector], dim)
            batch, matrix = batch[ok], matrix[ok]
            far = angles(unit_rows(matrix), pivots)
            home = far.argmin(axis=1) if len(pivots) else np.zeros(len(batch), dtype=np.int64)
            angle = far[np.arange(len(home)), home] if len(pivots) else np.zeros(len(batch))
            yield batch.assign(home=home, angle=angle, size=np.linalg.norm(matrix, axis=1))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    return table.mapInPandas(place, f"{kinds}, home long, angle double, size double")


def _block(home, key: str, pieces: np.ndarray):
    """Number of a row's block: its pivot's first block and a piece dealt by its key."""
    first, of = _numbers(np.concatenate([[0], np.cumsum(pieces)[:-1]])), _numbers(np.maximum(pieces, 1))
    at = (home + 1).cast("int")
    return F.element_at(first, at) + F.pmod(F.xxhash64(key), F.element_at(of, at))


def _numbers(values: np.ndarray):
    return F.array(*[F.lit(int(x)).cast("long") for x in values])


def _targets(table: DataFrame, vector: str, wanted: Callable[[np.ndarray, pd.DataFrame], np.ndarray], pivots: Pivots, dim: int) -> DataFrame:
    """(row's columns, block): a row per block whose pivot `wanted` marks for the row."""
    first = np.concatenate([[0], np.cumsum(pivots.pieces)])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrix, ok = vectors_of(batch[vector], dim)
            batch, matrix = batch[ok], matrix[ok]
            row, pivot = np.nonzero(wanted(matrix, batch) & (pivots.count > 0)) if len(batch) else (np.zeros(0, int),) * 2
            times = pivots.pieces[pivot]
            ends = np.cumsum(times)
            block = np.repeat(first[pivot] - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)
            out = batch.iloc[np.repeat(row, times)].assign(block=block)
            yield from (out.iloc[i : i + 20_000] for i in range(0, len(out), 20_000))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    return table.mapInPandas(place, f"{kinds}, block long")


def blocks_of(table: DataFrame, key: str, vector: str, pivots: Pivots, dim: int) -> DataFrame:
    """Adds block_no, the one block a row belongs to."""
    homed = _homed(table, vector, pivots.vectors, dim)
    return homed.withColumn("block_no", _block(F.col("home"), key, pivots.pieces)).drop("home", "angle", "size")


def within(table: DataFrame, vector: str, floor: float, pivots: Pivots, dim: int) -> DataFrame:
    """Rows with block_no, once per block that can hold a row of cosine >= floor."""
    return _targets(table, vector, lambda m, _: pivots.bounds(m, "cosine") >= floor - ROOM, pivots, dim).withColumnRenamed("block", "block_no")


def _in_blocks(asked: DataFrame, right: DataFrame, pair: Callable, schema: str, rows: int) -> DataFrame:
    """`pair` of each block of the right side with the rows asked of it, `rows` of them at a time."""
    held = {r["block"]: r["n"] for r in asked.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not held:
        return asked.sparkSession.createDataFrame([], schema)
    slices = asked.sparkSession.createDataFrame([(b, -(-n // rows)) for b, n in held.items()], "block long, slices long")
    left = asked.join(F.broadcast(slices), "block").withColumn("slice", F.pmod(F.xxhash64("lkey"), "slices")).drop("slices")
    other = right.join(F.broadcast(slices), "block").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices")
    a, b = spread_groups(left, "block", "slice"), spread_groups(other, "block", "slice")
    return a.groupBy("block", "slice").cogroup(b.groupBy("block", "slice")).applyInPandas(lambda x, y: pair(x, y), schema)


def meet(left: DataFrame, right: DataFrame, pair: Callable, schema: str, *, dim: int, floor: float, metric: str, rows: int) -> DataFrame:
    """Results of `pair` (right rows with a score >= floor of each left row) over all blocks that can hold one.

    left: lkey, lvec; right: rkey, rvec, ….
    """
    pivots = choose(right, "rkey", "rvec", dim, rows)
    if not pivots.count.sum():
        return left.sparkSession.createDataFrame([], schema)
    homed = blocks_of(right, "rkey", "rvec", pivots, dim).withColumnRenamed("block_no", "block")
    asked = _targets(left, "lvec", lambda m, _: pivots.bounds(m, metric) >= floor - ROOM, pivots, dim)
    return _in_blocks(asked, homed, pair, schema, rows)


def homes(table: DataFrame, *, dim: int, floor: float, rows: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(rows with `home`, their block; a function that adds `other`, each further block with a row of cosine >= floor in reach)."""
    table = cut_lineage(table.filter(F.size("lvec") == dim))
    if table.count() <= rows:
        # one block, which no row leaves
        one = F.lit(0).cast("long")
        return table.withColumn("home", one), lambda placed: placed.withColumn("other", one).filter("false")
    pivots = choose(table, "lkey", "lvec", dim, rows)
    homed = blocks_of(table, "lkey", "lvec", pivots, dim).withColumnRenamed("block_no", "home")

    def reach(placed: DataFrame) -> DataFrame:
        return within(placed, "lvec", floor, pivots, dim).withColumnRenamed("block_no", "other").filter("other <> home")

    return homed, reach
