"""Exact vector matching at any size.

Three ways to meet the same contract, picked by a row check of the smaller side:

* small right side - its rows travel once to every executor, the left side is never shuffled;
* small left side  - the mirror image: per-batch winners first, then one small shuffle;
* neither          - equal vectors are matched once. A task holds a tile of left vectors while a slice of the right
  ones streams past, and only the winners of a tile leave it.

Where every row above a floor is wanted, and for linked rows, the right side is cut into blocks around pivots (`pivots.py`),
and a row meets only blocks that can hold a match. Only matches (or a spanning forest) leave a block, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenary.functions import pivots
from lumenary.functions.vector import dense, unit_rows
from lumenary.session import cut_lineage, spread_groups

BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 128 << 20
BLOCK_ROWS = 8_192
CELLS = 4_000_000  # similarity cells held at once inside a task
#: Left vectors that a task holds, right ones that pass them in a task, and those that pass at a time.
TILE_ROWS, SLICE_ROWS, PASSING = 32_768, 65_536, 1_024
TILE_CELLS = 1_000_000
#: Vectors up to this length; tiles of longer ones hold fewer rows.
TILE_DIM = 64
#: Tasks that tiles are dealt to, at most.
MOST_TASKS = 4_096


@dataclass(frozen=True)
class Side:
    """One side of a match. `rank_by` breaks score ties, larger first."""

    df: DataFrame
    key: str
    vector: str
    rank_by: str | None = None

    def packed(self, prefix: str) -> DataFrame:
        tie = F.col(self.rank_by).cast("double") if self.rank_by else F.lit(0.0)
        return self.df.select(
            F.col(self.key).alias(prefix + "key"),
            F.col(self.vector).cast("array<double>").alias(prefix + "vec"),
            tie.alias(prefix + "tie"),
        )


def fetch_if_small(df: DataFrame, limit: int, dim: int | None = None) -> pa.Table | None:
    """All rows when there are at most `limit`, and their vectors are within BROADCAST_BYTES, else None.

    Rows are counted first, without their vectors and no further than the limit, so a large table costs
    little and sends nothing; the rows themselves come as Arrow batches.
    """
    if dim:
        limit = min(limit, BROADCAST_BYTES // (8 * dim))
    if len(df.select(F.lit(1)).take(limit + 1)) > limit:
        return None
    return df.toArrow()


def block_count(df: DataFrame, rows: int = BLOCK_ROWS) -> Column:
    """Number of blocks as an in-plan scalar, so sizing costs no extra driver round trip."""
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows)).cast("int").alias("n")).scalar()


def pair_blocks(left: DataFrame, right: DataFrame, left_key: str, right_key: str, rows: int = BLOCK_ROWS):
    """Give every (left block, right block) pair both its sides; returns two grouped frames to cogroup."""
    left_blocks, right_blocks = block_count(left, rows), block_count(right, rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = left.withColumn("lb", F.pmod(F.xxhash64(left_key), left_blocks)).withColumn("rb", every(right_blocks))
    b = right.withColumn("rb", F.pmod(F.xxhash64(right_key), right_blocks)).withColumn("lb", every(left_blocks))
    b = b.withColumn("lb", F.col("lb").cast("long"))
    a = a.withColumn("rb", F.col("rb").cast("long"))
    a, b = spread_groups(a, "lb", "rb"), spread_groups(b, "lb", "rb")
    return a.groupBy("lb", "rb").cogroup(b.groupBy("lb", "rb"))


def matrix_of(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, (pa.Array, pa.ChunkedArray)):
        return dense(column, dim)
    return dense(pa.array(column, type=pa.list_(pa.float64())), dim)


def _similar(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    return unit_rows(a) @ unit_rows(b).T if metric == "cosine" else a @ b.T


def keys_of(values) -> np.ndarray:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return np.asarray(values.to_pandas())
    return np.asarray(values)


def winners(keys, scores, rkeys, rties, k: int | None) -> pd.DataFrame:
    """The k best columns of each row of a score matrix; -inf marks no match.

    Ties go to the larger tie value, then to the larger key.
    """
    tiebreak = np.empty(len(rkeys), dtype=np.int64)
    tiebreak[np.lexsort((rkeys, rties))] = np.arange(len(rkeys))
    take = scores.shape[1] if k is None else min(k, scores.shape[1])
    # the k-th best score of a row bounds its winners; only candidates at or above it are sorted
    bound = -np.partition(-scores, take - 1, axis=1)[:, take - 1]
    rows, cols = np.nonzero((scores >= bound[:, None]) & np.isfinite(scores))
    order = np.lexsort((-tiebreak[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    rows, cols = rows[rank < take], cols[rank < take]
    return pd.DataFrame(
        {"lkey": keys[rows], "rkey": rkeys[cols], "score": scores[rows, cols], "rtie": rties[cols]}
    )


def _best(
    lkeys, lmat, rkeys, rmat, rties, k: int | None, floor: float, metric: str, skip_self: bool
) -> Iterator[pd.DataFrame]:
    step = max(1, CELLS // max(1, len(rkeys)))
    for start in range(0, len(lkeys) if len(rkeys) else 0, step):
        keys = lkeys[start : start + step]
        scores = np.round(_similar(lmat[start : start + step], rmat, metric), 6)
        scores[scores < floor] = -np.inf
        if skip_self:
            scores[keys[:, None] == rkeys[None, :]] = -np.inf
        yield winners(keys, scores, rkeys, rties, k)


def nearest(
    left: Side,
    right: Side,
    *,
    dim: int,
    k: int | None = 1,
    floor: float = -1.0,
    metric: str = "cosine",
    skip_self: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(left key, right key, score, rank): the k best right rows per left row with score >= floor.

    With k None every right row at or above the floor is returned, unranked.
    Scores are rounded to 6 digits before ranking, as vectors are stored with 6. Rows whose vector
    does not have `dim` entries take no part.
    """
    lkey, rkey = left.key, right.key
    lpack, rpack = left.packed("l"), right.packed("r")
    ltype = dict(left.df.dtypes)[lkey]
    rtype = dict(right.df.dtypes)[rkey]
    schema = f"lkey {ltype}, rkey {rtype}, score double, rtie double"

    def empty() -> pd.DataFrame:
        return pd.DataFrame({"lkey": [], "rkey": [], "score": [], "rtie": []})

    small_right = fetch_if_small(rpack, broadcast_rows, dim)
    small_left = None if small_right is not None else fetch_if_small(lpack, broadcast_rows, dim)

    def run(lk, lv, rk, rv, rt) -> Iterator[pd.DataFrame]:
        lm, lok = matrix_of(lv, dim)
        rm, rok = matrix_of(rv, dim)
        yield from _best(keys_of(lk)[lok], lm[lok], keys_of(rk)[rok], rm[rok], keys_of(rt)[rok], k, floor, metric, skip_self)

    if small_right is not None:
        shared = left.df.sparkSession.sparkContext.broadcast(small_right)

        def scan_left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            r = shared.value
            for batch in batches:
                yield from run(batch["lkey"], batch["lvec"], r["rkey"], r["rvec"], r["rtie"])

        hits = lpack.select("lkey", "lvec").mapInPandas(scan_left, schema)
    elif small_left is not None:
        shared = left.df.sparkSession.sparkContext.broadcast(small_left)

        def scan_right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = shared.value
            for batch in batches:
                yield from run(q["lkey"], q["lvec"], batch["rkey"], batch["rvec"], batch["rtie"])

        hits = rpack.mapInPandas(scan_right, schema)
    else:

        def one_pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            parts = list(run(a["lkey"], a["lvec"], b["rkey"], b["rvec"], b["rtie"])) if len(a) and len(b) else []
            return pd.concat(parts) if parts else empty()

        if k is None:
            hits = pivots.meet(lpack.drop("ltie"), rpack, one_pair, schema, dim=dim, floor=floor, metric=metric, rows=block_rows)
        else:
            hits = _pass_tiles(lpack, rpack, dim=dim, k=k, floor=floor, metric=metric, skip_self=skip_self, block=min(block_rows, PASSING))

    if k is None:
        return hits.select(F.col("lkey").alias(lkey), F.col("rkey").alias("match_" + rkey), "score")
    order = W.partitionBy("lkey").orderBy(F.desc("score"), F.desc("rtie"), F.desc("rkey"))
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("lkey").alias(lkey), F.col("rkey").alias("match_" + rkey), "score", "rank")
    )


class _Tile:
    """Left vectors of a tile, and the k best right ones of each among those that have passed."""

    def __init__(self, dim: int, k: int, floor: float, metric: str) -> None:
        self.dim, self.k, self.floor, self.metric = dim, k, floor, metric
        self.parts, self.found, self.held = [], [], 0
        self.left = None

    def _matrix(self, rows: pa.RecordBatch) -> np.ndarray:
        matrix, _ = dense(rows.column("vec"), self.dim)
        return unit_rows(matrix) if self.metric == "cosine" else matrix

    def hold(self, rows: pa.RecordBatch) -> None:
        self.parts.append((np.asarray(rows.column("h1")), np.asarray(rows.column("h2")), self._matrix(rows)))

    def meet(self, rows: pa.RecordBatch) -> None:
        if self.left is None:
            if not self.parts:
                return
            self.h1, self.h2, self.left = (np.concatenate(p) for p in zip(*self.parts))
            # scores are rounded to six digits before they are compared
            self.bound = np.full(len(self.left), self.floor - 1e-6)
        right, keys, ties = self._matrix(rows), keys_of(rows.column("rkey")), np.asarray(rows.column("rtie"))
        step = max(1, TILE_CELLS // len(right))
        for start in range(0, len(self.left), step):
            scores = self.left[start : start + step] @ right.T
            row, col = np.nonzero(scores >= self.bound[start : start + step, None])
            if len(row) > 4 * self.k * len(scores):
                best = winners(np.arange(start, start + len(scores)), np.round(scores, 6), np.arange(len(right)), np.arange(len(right))[_order(ties, keys)], self.k)
                row, col, score = best["lkey"].to_numpy(), best["rkey"].to_numpy(), best["score"].to_numpy()
            else:
                score, row = np.round(scores[row, col], 6), row + start
            if len(row):
                self.found.append((row, score, ties[col], keys[col]))
                self.held += len(row)
        if self.held > 2 * self.k * len(self.left):
            self._cut()

    def _cut(self) -> None:
        row, score, tie, key = (np.concatenate(p) for p in zip(*self.found))
        order = np.lexsort((-_order(tie, key), -score, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        kept, last = order[rank < self.k], rank == self.k - 1
        self.bound[row[last]] = np.maximum(self.bound[row[last]], score[order[last]] - 1e-6)
        self.found, self.held = [(row[rank < self.k], score[kept], tie[kept], key[kept])], len(kept)

    def finish(self) -> dict | None:
        if not self.held:
            return None
        self._cut()
        row, score, _, key = self.found[0]
        ok = score >= self.floor
        return {"h1": self.h1[row[ok]], "h2": self.h2[row[ok]], "rkey": key[ok], "score": score[ok]}


def _order(ties: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each row by tie value, then key."""
    place = np.empty(len(keys), dtype=np.int64)
    place[np.lexsort((np.unique(keys, return_inverse=True)[1], ties))] = np.arange(len(keys))
    return place


def _pass_tiles(
    left: DataFrame, right: DataFrame, *, dim: int, k: int, floor: float, metric: str, skip_self: bool, block: int,
    tile_rows: int = TILE_ROWS, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(lkey, rkey, score, rtie): at least the k best right rows of each left row, itself left out if told so.

    Rows with equal vectors have equal scores, so different vectors are matched, a right one under the name of its best
    row; of its further rows the best k + 1 are enough, one of which may be the asking row itself. The left
    vectors are sent once for each slice of the right ones, and those once for each tile.
    """
    most = k + 1 if skip_self else k
    if dim > TILE_DIM:
        tile_rows, slice_rows = -(-tile_rows * TILE_DIM // dim), -(-slice_rows * TILE_DIM // dim)

    def numbered(df: DataFrame, prefix: str) -> DataFrame:
        vec = prefix + "vec"
        return df.filter(F.size(vec) == dim).withColumns({"h1": F.xxhash64(vec), "h2": F.xxhash64(F.lit(1), vec)})

    lrows, rrows = numbered(left, "l"), numbered(right, "r")
    best = W.partitionBy("h1", "h2").orderBy(F.desc("rtie"), F.desc("rkey"))
    firsts = rrows.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most)
    members = F.sort_array(F.collect_list(F.struct("rtie", "rkey")), asc=False)
    held = cut_lineage(firsts.groupBy("h1", "h2").agg(F.any_value("rvec").alias("vec"), members.alias("members")).withColumn("name", F.col("members")[0]))
    asked = cut_lineage(lrows.groupBy("h1", "h2").agg(F.any_value("lvec").alias("vec")))
    tiles, slices = (max(1, -(-df.count() // n)) for df, n in ((asked, tile_rows), (held, slice_rows)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("tile").cast("long") * slices + F.col("slice")).alias("cell")
    rtype = dict(right.dtypes)["rkey"]
    a = asked.withColumn("tile", F.pmod("h1", F.lit(tiles))).withColumn("slice", every(slices)).select(
        cell, F.lit(0).alias("side"), "h1", "h2", F.lit(None).cast(rtype).alias("rkey"), F.lit(None).cast("double").alias("rtie"), "vec"
    )
    b = held.withColumn("slice", F.pmod("h1", F.lit(slices))).withColumn("tile", every(tiles)).select(
        cell, F.lit(1).alias("side"), "h1", "h2", "name.rkey", "name.rtie", "vec"
    )
    made = StructType.fromDDL(f"h1 long, h2 long, rkey {rtype}, score double")
    types = to_arrow_schema(made).types

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(tile: _Tile | None) -> Iterator[pa.RecordBatch]:
            if tile is not None and (rows := tile.finish()) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(rows[c], type=t) for c, t in zip(made.names, types)], names=made.names)

        tile, current = None, None
        for batch in batches:
            cells, sides = np.asarray(batch.column("cell")), np.asarray(batch.column("side"))
            cut = np.flatnonzero(np.diff(cells) | np.diff(sides)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(cells)]):
                if cells[lo] != current:
                    yield from packed(tile)
                    tile, current = _Tile(dim, most, floor, metric), cells[lo]
                if sides[lo] == 0:
                    tile.hold(batch.slice(lo, hi - lo))
                else:
                    for at in range(lo, hi, block):
                        tile.meet(batch.slice(at, min(block, hi - at)))
        yield from packed(tile)

    parts = min(tiles * slices, MOST_TASKS)
    met = a.unionByName(b).repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", "side")
    # the best rows of each different left vector, then of each left row
    named = held.select(F.col("name.rkey").alias("rkey"), "members")
    rows = met.mapInArrow(scan, made).join(named, "rkey").select("h1", "h2", "score", F.inline("members"))
    first = W.partitionBy("h1", "h2").orderBy(F.desc("score"), F.desc("rtie"), F.desc("rkey"))
    rows = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most).drop("place")
    out = lrows.select("lkey", "h1", "h2").join(rows, ["h1", "h2"]).select("lkey", "rkey", "score", "rtie")
    return out.filter(F.col("lkey") != F.col("rkey")) if skip_self else out


def forest_edges(side: Side, *, dim: int, floor: float, block_rows: int = BLOCK_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) that connect exactly the rows linked by chains of cosine >= floor.

    First every block links its own rows to the root of their component in the block. A pair of blocks then
    reports at most one edge per such component, however dense the graph is: one dense component over all
    rows gives the rows plus the block pairs. A block holds some `tile_rows` vectors, which `block_rows` at a time meet,
    so what is sent doesn't depend on how few are compared at once.
    """
    ktype = dict(side.df.dtypes)[side.key]
    if dim > TILE_DIM:
        tile_rows = -(-tile_rows * TILE_DIM // dim)
    homed, reach = pivots.homes(side.packed("l").select("lkey", "lvec"), dim=dim, floor=floor, rows=tile_rows)
    block = min(block_rows, PASSING)
    placed, edges = (
        StructType.fromDDL(x) for x in (f"lkey {ktype}, lvec array<double>, home long, root {ktype}", f"a {ktype}, b {ktype}")
    )

    def own_roots(rows: pa.Table) -> pa.Table:
        matrix, ok = matrix_of(rows.column("lvec"), dim)
        rows, unit = rows.filter(pa.array(ok)), unit_rows(matrix[ok])
        keys = keys_of(rows.column("lkey"))
        code = np.argsort(np.argsort(keys))
        label = _joined(unit, code, unit, code, len(keys), floor, block)
        root = pa.array(np.sort(keys)[label[code]], type=to_arrow_schema(placed).field("root").type)
        return pa.table([*(rows.column(c) for c in ("lkey", "lvec", "home")), root], schema=to_arrow_schema(placed))

    local = cut_lineage(spread_groups(homed, "home").groupBy("home").applyInArrow(own_roots, placed))
    # a row goes to the pairs of its own block with those that can hold a row near enough
    spread = reach(local).withColumns(
        {"lo": F.least("home", "other"), "hi": F.greatest("home", "other")}
    )

    def across(rows: pa.Table) -> pa.Table:
        first = np.asarray(rows.column("home")) == np.asarray(rows.column("lo"))
        if first.all() or not first.any():
            return to_arrow_schema(edges).empty_table()
        matrix, _ = matrix_of(rows.column("lvec"), dim)
        unit = unit_rows(matrix)
        roots, code = np.unique(keys_of(rows.column("root")), return_inverse=True)
        label = _joined(unit[first], code[first], unit[~first], code[~first], len(roots), floor, block)
        moved = label != np.arange(len(roots))
        return pa.table([pa.array(roots[moved]), pa.array(roots[label[moved]])], names=edges.names).cast(to_arrow_schema(edges))

    crossed = spread_groups(spread, "lo", "hi").groupBy("lo", "hi").applyInArrow(across, edges)
    return local.filter("lkey <> root").select(F.col("lkey").alias("a"), F.col("root").alias("b")).unionByName(crossed)


def _joined(
    held: np.ndarray, held_code: np.ndarray, passing: np.ndarray, passing_code: np.ndarray, codes: int, floor: float, block: int
) -> np.ndarray:
    """Smallest code linked with each code, by rows of both sides with cosine >= floor.

    Rows known to be linked needn't be compared again: those of the largest component meet only rows outside it.
    """
    label = np.arange(codes)
    for start in range(0, len(passing), block):
        part = slice(start, start + block)
        here, came = label[held_code], label[passing_code[part]]
        largest = np.bincount(here).argmax()
        outside = np.flatnonzero(here != largest)
        for right, left in ((np.flatnonzero(came != largest), None), (np.flatnonzero(came == largest), outside)):
            some, of = (held, here) if left is None else (held[left], here[left])
            step = max(1, CELLS // max(1, len(some)))
            for at in range(0, len(right) if len(some) else 0, step):
                few = right[at : at + step]
                scores = passing[part][few] @ some.T
                rows, cols = np.nonzero(scores >= floor - 1e-6)
                near = np.round(scores[rows, cols], 6) >= floor
                if near.any():
                    label = _components(label[came[few[rows[near]]]], label[of[cols[near]]], np.arange(codes))[label]
    return label


def _components(rows: np.ndarray, cols: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Minimum label per component, by repeated relaxation with pointer jumping."""
    label = label.copy()
    start = label.copy()
    position = np.empty_like(label)
    position[start] = np.arange(len(label))
    while True:
        low = label.copy()
        np.minimum.at(low, rows, label[cols])
        np.minimum.at(low, cols, label[rows])
        # follow the label's own row: its label is at least as low
        low = np.minimum(low, low[position[low]])
        if np.array_equal(low, label):
            return label
        label = low


def components(edges: DataFrame, ktype: str, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root): minimum key per connected component, by large-star / small-star rounds.

    Minima are combinable aggregates; a hub's edges are split by the skew join. The number of rounds
    grows with the logarithm of the component size.
    """
    current = checkpoint(edges.select("a", "b").filter("a <> b").distinct())

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        view = both if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = view.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        joined = view.join(low, "a")
        if large:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                joined.select("a", F.col("m").alias("b"))
            )
        return out.filter("a <> b").distinct()

    def fingerprint(pairs: DataFrame) -> tuple:
        row = pairs.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")
        ).first()
        return row["n"], row["h"]

    mark = fingerprint(current)
    while True:
        current = checkpoint(star(star(current, True), False))
        new = fingerprint(current)
        if new == mark:
            break
        mark = new
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
