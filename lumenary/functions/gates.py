"""Candidate indexes for near copies: for each value of a block the best value that a gate lets it match.

A table of values has kind, block, the value's columns and `lead`, the best item that has it: a struct of the
quality q and the item's profile. A gate gives (kind, block, value, lead) with the best lead among the values within
reach, the value itself included. Values meet by equal keys that no pair in reach can do without.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenary.functions.similarity import first_alike
from lumenary.functions.vector import duration_similarity, unit_rows
from lumenary.session import cut_lineage, materialize, spread_groups

BLOCK = ["kind", "block"]
#: Vectors of a tile of a large block, and values that one task takes from small blocks.
PIECE_ROWS, PACK_ROWS = 16_384, 8_192
#: Texts of a tile of a large block.
TEXT_ROWS = 32_768
#: Tiles from which on they grow with the block, and how many times larger they become before there are more of them.
FEW_TILES, LARGER = 12, 4
#: What the rows of a piece are ordered by.
QUALITY = ["q1", "q2", "q3", "q4", "id"]
#: Cosines of a matrix product.
CELLS = 1 << 22


def values(rows: DataFrame, *columns: str) -> DataFrame:
    """The different values of each block with the best row of each; the best is a combinable maximum.

    Stored, since every gate reads them several times.
    """
    return materialize(rows.groupBy(*BLOCK, *columns).agg(F.max(F.struct("q", "profile")).alias("lead")), "values")


def _best(pairs: DataFrame, *columns: str) -> DataFrame:
    return pairs.groupBy(*BLOCK, *columns).agg(F.max("other").alias("lead"))


def _number(*columns: str) -> Column:
    """What stands for a value in wide joins; values that share a number by chance are told apart when they are looked at."""
    return F.xxhash64(*BLOCK, *columns)


def _by_kind(floors: dict[str, float]) -> Column:
    """The floor of a row's kind of block."""
    return F.coalesce(*[F.when(F.col("kind") == kind, F.lit(floor)) for kind, floor in floors.items()])


def hash_gate(rows: DataFrame, floor: float) -> DataFrame:
    """64-bit hashes whose similarity is at least `floor`.

    At most 64 * (1 - floor) bits differ, so of eight bytes at least that many fewer are equal: hashes meet by pairs
    of equal bytes, which hold as long as six bits or fewer may differ.
    """
    if math.floor(64 * (1 - floor) + 1e-9) > 6:
        raise ValueError("pairs of equal bytes need hashes with at most six different bits")
    read = F.lower(F.trim("phash"))
    found = values(rows.filter(read.rlike("^[0-9a-f]{1,16}$")), "phash")
    padded = F.lpad(read, 16, "0")
    halves = [F.conv(F.substring(padded, at, 8), 16, 10).cast("long") for at in (1, 9)]
    found = spread_groups(found, "phash").withColumns({"high": halves[0], "low": halves[1], "digits": F.length(read), "home": F.xxhash64(*BLOCK), "no": _number("phash")})
    # bytes from the left, four in each half
    pairs = [(i, j) for i in range(8) for j in range(i + 1, 8)]
    byte = [F.shiftright(F.col("high" if i < 4 else "low"), 24 - 8 * (i % 4)).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = F.array(*[F.lit(65_536 * n) + byte[i] * 256 + byte[j] for n, (i, j) in enumerate(pairs)])
    keyed = found.select("no", "high", "low", "digits", "home", F.explode(keys).alias("key"))
    other = keyed.select("home", "key", *[F.col(c).alias(c + "2") for c in ("no", "high", "low", "digits")])
    apart = F.bit_count(F.col("high").bitwiseXOR(F.col("high2"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("low2")))
    alike = F.greatest(F.lit(0.0), 1.0 - apart.cast("double") / (F.greatest("digits", "digits2") * 4)) >= floor
    near = spread_groups(keyed, "home", "key").join(spread_groups(other, "home", "key"), ["home", "key"]).filter(alike).select("no", "no2").distinct()
    leads = found.select(*[F.col(c).alias(c + "2") for c in (*BLOCK, "no", "high", "low", "digits")], F.col("lead").alias("other"))
    return _best(near.join(found, "no").join(leads, "no2").filter("kind = kind2 and block = block2").filter(alike), "phash")


def _pieces(rows: DataFrame, sizes: DataFrame, key: str, piece_rows: int) -> DataFrame:
    """Rows in the pieces that tasks compare: adds piece and pack, across and second. sizes: part, n.

    Small parts share packs. A large part is cut into tiles by the key; each two tiles, and each tile with itself, are a
    piece, and a row is sent once for each piece of its tile. Up to FEW_TILES a tile has `piece_rows` rows; a larger part
    has tiles of up to LARGER times as many, so that what is sent grows with the rows and not with their square.
    """
    packs = max(1, (sizes.filter(F.col("n") <= piece_rows).agg(F.sum("n")).first()[0] or 0) // PACK_ROWS)
    rows = rows.join(sizes, "part")
    small = rows.filter(F.col("n") <= piece_rows).withColumns({
        "piece": F.lit(""), "pack": F.pmod(F.xxhash64("part"), F.lit(packs)), "second": F.lit(False), "across": F.lit(False)
    }).drop("n")
    tiles = F.greatest(F.least(F.ceil(F.col("n") / piece_rows), F.lit(FEW_TILES)), F.ceil(F.col("n") / (piece_rows * LARGER)))
    tiled = rows.filter(F.col("n") > piece_rows).withColumn("tile", F.pmod(F.xxhash64(key), tiles))
    tiled = tiled.withColumn("beside", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    low, high = F.least("tile", "beside"), F.greatest("tile", "beside")
    tiled = tiled.withColumns({
        "piece": F.concat_ws("|", low.cast("string"), high.cast("string"), "part"), "pack": F.lit(-1).cast("long"),
        "second": F.col("tile") > F.col("beside"), "across": F.col("tile") != F.col("beside"),
    }).drop("tile", "beside", "n")
    return spread_groups(small.unionByName(tiled), "pack", "piece")


def _first_alike(floors: dict[str, float]):
    """For the texts of a piece, each block by itself, the best one with a better lead that a text is like."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        quality = [c for c in rows.columns if c in ("q", *QUALITY)]
        for name, part in rows.sort_values(quality, ascending=False, kind="stable").groupby("part", sort=False):
            sides = part["second"].to_numpy(dtype=bool) if part["across"].iloc[0] else None
            ones, others = first_alike(part["text"].tolist(), floors[name.split("|")[0]], sides)
            profiles = part["profile"].to_numpy()
            found.append(pd.DataFrame({"profile": profiles[ones], "other": profiles[others]}, dtype=object))
        return pd.concat(found)

    return run


def text_gate(rows: DataFrame, column: str, floors: dict[str, float], piece_rows: int = TEXT_ROWS) -> DataFrame:
    """Texts whose matching-blocks ratio is at least the floor of their kind of block, tested in the order (value, other).

    A text asks those with a better lead only. Small blocks share tasks. A large block is cut into tiles, and a task
    compares two of them by counts of letters; it reports one partner of each text, so no pairs are shuffled.
    """
    found = values(rows.filter(F.col(column) != ""), column)
    ordered = "lead.q.*" if isinstance(rows.schema["q"].dataType, StructType) else "lead.q"
    flat = found.select(F.concat_ws("|", *BLOCK).alias("part"), F.col(column).alias("text"), "lead.profile", ordered)
    sizes = cut_lineage(flat.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    pieces = _pieces(flat, sizes, "text", piece_rows)
    near = pieces.groupBy("pack", "piece").applyInPandas(_first_alike(floors), "profile string, other string")
    leads = found.select(F.col("lead.profile").alias("other"), F.col("lead").alias("other_lead"))
    best = near.join(leads, "other").groupBy("profile").agg(F.max("other_lead").alias("best"))
    return found.withColumn("profile", F.col("lead.profile")).join(best, "profile", "left").select(*BLOCK, column, F.coalesce("best", "lead").alias("lead"))


def _scale(duration: str, floor: float) -> Column:
    """Number of a duration's class: those in reach are in the same class or a neighbouring one."""
    return F.floor(F.log(duration) / (-math.log(floor) + 1e-9)).cast("long")


def _reached(found: DataFrame, floor: float) -> DataFrame:
    """Each value in its own class of durations, and in the two beside it as somebody's partner only."""
    classes = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.struct((_scale("duration", floor) + i).alias("class"), (i == 0).alias("asks")))
    return found.select("*", F.explode(classes).alias("c")).select(*found.columns, "c.*")


def duration_gate(rows: DataFrame, floor: float) -> DataFrame:
    """Durations whose similarity is at least `floor`: classes of a logarithmic scale meet their neighbours."""
    found = _reached(values(rows.filter("duration > 0"), "duration"), floor)
    other = found.select(*BLOCK, "class", F.col("duration").alias("duration2"), F.col("lead").alias("other"))
    pairs = found.filter("asks").join(other, [*BLOCK, "class"])
    return _best(pairs.filter(duration_similarity(F.col("duration"), F.col("duration2")) >= floor), "duration")


def _first_near(floors: dict[str, float], length: float | None):
    """For the asking rows of a piece, each block by itself, the best row (of the other tile) whose cosine (and length) is within reach."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asking, partners = [], []

        def tell(asks: pd.DataFrame, holds: pd.DataFrame, first: np.ndarray) -> None:
            hit = np.flatnonzero((first >= 0) & asks["asks"].to_numpy(dtype=bool))
            asking.append(asks["profile"].to_numpy()[hit])
            partners.append(holds["profile"].to_numpy()[first[hit]])

        for name, part in rows.sort_values(QUALITY, ascending=False, kind="stable").groupby("part", sort=False):
            across, second = part["across"].iloc[0], part["second"].to_numpy(dtype=bool)
            asks, holds = (part[~second], part[second]) if across else (part[part["asks"].to_numpy(dtype=bool)], part)
            if not len(asks) or not len(holds):
                continue
            one, two = (unit_rows(np.stack(p["vector"].to_numpy()).astype(float)) for p in (asks, holds))
            first, back = np.full(len(one), -1), np.full(len(two), -1)
            strip = max(1, CELLS // len(two))
            for at in range(0, len(one), strip):
                near = one[at : at + strip] @ two.T >= floors[name.split("|")[0]] - 1e-9
                if length is not None:
                    a, b = asks["duration"].to_numpy()[at : at + strip, None], holds["duration"].to_numpy()[None]
                    near &= 1 - np.abs(a - b) / np.maximum(a, b) >= length
                hit = np.flatnonzero(near.any(axis=1))
                first[at + hit] = near[hit].argmax(axis=1)
                if across:
                    hit = np.flatnonzero(near.any(axis=0) & (back < 0))
                    back[hit] = at + near[:, hit].argmax(axis=0)
            tell(asks, holds, first)
            if across:
                tell(holds, asks, back)
        return pd.DataFrame({"profile": np.concatenate(asking) if asking else [], "other": np.concatenate(partners) if partners else []}, dtype=object)

    return run


def vector_gate(rows: DataFrame, floors: dict[str, float], length: float | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Vectors whose cosine is at least the floor of their kind of block, with `length` also of durations so similar.

    Small blocks share tasks. A large block is cut into tiles, and a task is the matrix product of two of them; it
    reports one partner of each vector.
    """
    columns = ["vector", "duration"] if length is not None else ["vector"]
    kept = rows.filter("size(vector) > 0")
    found = values(kept if length is None else kept.filter("duration > 0"), *columns)
    spread = found.withColumns({"class": F.lit(0).cast("long"), "asks": F.lit(True)}) if length is None else _reached(found, length)
    part = F.concat_ws("|", "kind", F.size("vector").cast("string"), F.col("class").cast("string"), "block")
    flat = spread.select(part.alias("part"), "vector", *[F.col(c) for c in columns[1:]], "lead.profile", "lead.q.*", "asks")
    sizes = cut_lineage(flat.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    pieces = _pieces(flat, sizes, "profile", piece_rows)
    near = pieces.groupBy("pack", "piece").applyInPandas(_first_near(floors, length), "profile string, other string")
    leads = found.select(F.col("lead.profile").alias("other"), F.col("lead").alias("other_lead")).distinct()
    best = near.join(leads, "other").groupBy("profile").agg(F.max("other_lead").alias("best"))
    return found.join(best, F.col("lead.profile") == F.col("profile")).select(*BLOCK, *columns, F.col("best").alias("lead"))
