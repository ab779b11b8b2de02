"""Vector, hash and box expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

PHASH_BITS = 64
IMAGE_DIM = 112


def no_vector() -> Column:
    return F.array().cast("array<double>")


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    value = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.coalesce(F.when(same, value), F.lit(0.0))


def l2_normalize(v: Column) -> Column:
    def scaled(pair: Column) -> Column:
        return F.transform(pair["v"], lambda x: F.when(pair["n"] == 0, x).otherwise(F.try_divide(x, pair["n"])))

    pair = F.struct(as_doubles(v).alias("v"), norm(v).alias("n"))
    return F.element_at(F.transform(F.array(pair), scaled), 1)


def unit_beside(counts: Column, rest: Column, rest_is_unit: bool = False) -> Column:
    """One unit vector of the unit vector of `counts` and of `rest`, side by side.

    Counts are whole numbers. Their sum of squares is exact and an entry is divided once, so an entry that lies
    halfway between two decimals comes out as that, which vectors made unit twice would miss by a last bit.
    """
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)
    held = F.struct(as_doubles(counts).alias("c"), as_doubles(rest).alias("r"))

    def measured(p: Column) -> Column:
        n, m = square(p["c"]), square(p["r"])
        whole = F.when(n > 0, 1.0).otherwise(0.0) + (F.when(m > 0, 1.0).otherwise(0.0) if rest_is_unit else m)
        return F.struct(p["c"], p["r"], F.sqrt(n * whole).alias("a"), F.sqrt(whole).alias("b"))

    def divided(v: Column, norm: Column) -> Column:
        return F.transform(v, lambda x: F.when(norm == 0, x).otherwise(F.try_divide(x, norm)))

    def scaled(p: Column) -> Column:
        return F.concat(divided(p["c"], p["a"]), divided(p["r"], p["b"]))

    return F.element_at(F.transform(F.transform(F.array(held), measured), scaled), 1)


def units_beside(text: Column, rest: Column, rest_is_unit: bool = False) -> Column:
    """One unit vector of a unit (or zero) vector and of `rest`, side by side: both are divided once more, as SQL does it."""
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)
    held = F.struct(as_doubles(text).alias("t"), as_doubles(rest).alias("r"))

    def scaled(p: Column) -> Column:
        m = square(p["r"])
        whole = F.when(F.exists(p["t"], lambda x: x != 0), 1.0).otherwise(0.0) + (F.when(m > 0, 1.0).otherwise(0.0) if rest_is_unit else m)
        measured = F.struct(F.concat(p["t"], p["r"]).alias("v"), F.sqrt(whole).alias("n"))
        divided = lambda q: F.transform(q["v"], lambda x: F.when(q["n"] == 0, x).otherwise(F.try_divide(x, q["n"])))
        return F.element_at(F.transform(F.array(measured), divided), 1)

    return F.element_at(F.transform(F.array(held), scaled), 1)


def mean_vector(v: Column) -> Column:
    """Element-wise mean as one combinable aggregate (partial sums before the shuffle)."""
    return vector_to_array(Summarizer.mean(array_to_vector(as_doubles(v))))


def dense(values: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as a matrix; rows of another length are zero and marked invalid."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(values), 0))
    valid = lengths == dim
    matrix = np.zeros((len(values), dim))
    if valid.any():
        kept = values.filter(pa.array(valid))
        flat = pa.compute.fill_null(kept.flatten().cast(pa.float64()), 0.0)
        matrix[valid] = np.asarray(flat).reshape(-1, dim)
    return matrix, valid


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def cosines_to(v: Column, targets: np.ndarray) -> Column:
    """Cosine of a column with each of a few request vectors, one matrix product per Arrow batch."""
    goals = unit_rows(np.asarray(targets, dtype=float))

    @F.arrow_udf("array<double>")
    def run(vectors: pa.Array) -> pa.Array:
        matrix, _ = dense(vectors, goals.shape[1])
        scores = unit_rows(matrix) @ goals.T
        offsets = np.arange(0, scores.size + 1, goals.shape[0], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(scores.ravel()))

    return run(v)


def _hex_nibbles(hash_text: Column) -> Column:
    return F.split(F.lower(F.trim(hash_text)), "")


def phash_bits(phash: Column) -> Column:
    """+1 / -1 per bit of a hex hash, padded or cut to 64; all zero when it is no hex text."""
    text = F.lower(F.trim(phash))
    bits = F.array_join(
        F.transform(_hex_nibbles(phash), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), ""
    )
    padded = F.rpad(bits, PHASH_BITS, "0")
    signs = F.transform(F.split(padded, ""), lambda b: F.when(b == "1", 1.0).otherwise(-1.0))
    return F.when(text.rlike("^[0-9a-f]+$"), signs).otherwise(zeros(PHASH_BITS))


def phash_similarity(a: Column, b: Column) -> Column:
    """1 minus the share of differing bits; 0 when either side is missing or no hex text."""
    width = F.greatest(F.length(F.trim(a)), F.length(F.trim(b)))

    def half(x: Column, start: int) -> Column:
        padded = F.lpad(F.lower(F.trim(x)), 16, "0")
        return F.conv(F.substring(padded, start, 8), 16, 10).cast("long")

    differing = F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))
    readable = F.lower(F.trim(a)).rlike("^[0-9a-f]{1,16}$") & F.lower(F.trim(b)).rlike("^[0-9a-f]{1,16}$")
    score = F.greatest(F.lit(0.0), 1.0 - F.try_divide(differing.cast("double"), width * 4))
    return F.coalesce(F.when(readable, score), F.lit(0.0))


def duration_similarity(a: Column, b: Column) -> Column:
    known = (a > 0) & (b > 0)
    score = F.greatest(F.lit(0.0), 1.0 - F.try_divide(F.abs(a - b), F.greatest(a, b)))
    return F.coalesce(F.when(known, score), F.lit(0.0))


def normalize_bbox(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Corner pixels to (left, top, width, height) in [0, 1]; empty when the frame size is unknown."""

    def share(value: Column, full: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.try_divide(value.cast("double"), full), F.lit(1.0)))

    box = F.array(
        share(x1, width),
        share(y1, height),
        share(F.greatest(x2 - x1, F.lit(0.0)), width),
        share(F.greatest(y2 - y1, F.lit(0.0)), height),
    )
    return F.when((width > 0) & (height > 0), box).otherwise(no_vector())
