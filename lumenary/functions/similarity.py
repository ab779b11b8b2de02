"""Pairwise text similarity."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.arrow_udf(DoubleType())
def _match_ratio(left: pa.Array, right: pa.Array) -> pa.Array:
    memo: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(left.to_pylist(), right.to_pylist()):
        if pair not in memo:
            memo[pair] = SequenceMatcher(a=pair[0], b=pair[1]).ratio()
        out.append(memo[pair])
    return pa.array(out, pa.float64())


def text_similarity(a: Column, b: Column) -> Column:
    """Matching-blocks ratio; 1 for equal texts, 0 when either is empty. For candidate pairs only."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(_match_ratio(a, b))


#: Slots that letters and pairs of letters are counted in; those that share one only make a count higher.
LETTERS, PAIRS = 64, 256
#: Texts counted at a time, pairs of texts looked at in one step, and pairs kept until they are tried.
COUNTED, STEP, KEPT = 8_192, 1 << 18, 1 << 20


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, letters by slot, pairs of neighbouring letters by slot) of texts; counts end at 255."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    letters, pairs = np.zeros((len(texts), LETTERS), dtype=np.uint8), np.zeros((len(texts), PAIRS), dtype=np.uint8)
    for at in range(0, len(texts), COUNTED):
        some = slice(at, at + COUNTED)
        n = len(texts[some])
        codes = np.frombuffer("".join(texts[some]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        owner = np.repeat(np.arange(n), lengths[some])
        inside = owner[1:] == owner[:-1]
        slots = ((codes[:-1] * 31 + codes[1:]) % PAIRS + owner[:-1] * PAIRS)[inside]
        letters[some] = np.minimum(np.bincount(owner * LETTERS + codes % LETTERS, minlength=n * LETTERS), 255).reshape(n, LETTERS)
        pairs[some] = np.minimum(np.bincount(slots, minlength=n * PAIRS), 255).reshape(n, PAIRS)
    return lengths, letters, pairs


def _marks(letters: np.ndarray) -> np.ndarray:
    """64 marks of each text, each "at least so many of a letter": those that divide the texts best.

    Texts differ in no more marks than they have unshared letters.
    """
    tests = []
    for slot in range(LETTERS):
        at_least = len(letters) - np.cumsum(np.bincount(letters[:, slot], minlength=2))[:-1]
        tests += [(int(n) * (len(letters) - int(n)), slot, level + 1) for level, n in enumerate(at_least)]
    words = np.zeros(len(letters), dtype=np.uint64)
    for bit, (_, slot, level) in enumerate(sorted(tests, reverse=True)[:64]):
        words |= (letters[:, slot] >= level).astype(np.uint64) << np.uint64(bit)
    return words


def first_alike(texts: list[str], floor: float, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, places of the first one before it that it is like): matching-blocks ratio at least `floor`.

    With `sides` only texts of different sides are compared. A ratio r of two texts with T letters in all leaves at
    most u = (1-r)T of them unmatched, so their counts of letters differ by u at most, and the counts of their letter
    pairs by 3u, since the matching blocks are u + 1 at most. What these bounds leave is tried, the first texts first.
    """
    lengths, letters, pairs = _counts(texts)
    marks = _marks(letters)
    first = np.full(len(texts), len(texts))
    order = np.argsort(lengths, kind="stable")
    rows, columns = (order, order) if sides is None else (order[~sides[order]], order[sides[order]])
    long, wide = lengths[rows], lengths[columns]
    most = (2 - floor) / floor
    kept: list[np.ndarray] = []

    def unmatched(n: np.ndarray) -> np.ndarray:
        return (1 - floor) * n + 1e-9

    def try_out() -> None:
        pairs_left = np.concatenate(kept) if kept else np.empty((0, 2), dtype=np.int64)
        kept.clear()
        for one, two in pairs_left[np.lexsort((pairs_left[:, 1], pairs_left[:, 0]))].tolist():
            if two < first[one] and SequenceMatcher(a=texts[one], b=texts[two]).ratio() >= floor:
                first[one] = two

    at = waiting = 0
    while at < len(rows):
        low = at if sides is None else int(np.searchsorted(wide, math.floor(long[at] / most - 1e-9)))
        strip = max(1, STEP // max(1, len(columns) - low))
        end = min(len(rows), at + strip)
        high = int(np.searchsorted(wide, math.ceil(long[end - 1] * most + 1e-9), side="right"))
        limit = np.minimum(unmatched(long[end - 1] + wide[low:high]), 64).astype(np.uint8)
        near = np.bitwise_count(marks[rows[at:end], None] ^ marks[None, columns[low:high]]) <= limit
        p, q = np.divmod(np.flatnonzero(near), max(1, high - low))
        if sides is None:
            p, q = p[q > p], q[q > p]
        p, q = rows[at + p], columns[low + q]
        one, two = np.maximum(p, q), np.minimum(p, q)
        open_ = two < first[one]
        one, two = one[open_], two[open_]
        for counts, weight in ((letters, 1), (pairs, 3)):
            apart = np.zeros(len(one), dtype=np.int64)
            for i in range(0, len(one), COUNTED):
                x, y = counts[one[i : i + COUNTED]], counts[two[i : i + COUNTED]]
                apart[i : i + COUNTED] = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
            open_ = apart <= weight * unmatched(lengths[one] + lengths[two])
            one, two = one[open_], two[open_]
        kept.append(np.stack([one, two], axis=1))
        waiting += len(one)
        if waiting >= KEPT:
            try_out()
            waiting = 0
        at = end
    try_out()
    found = np.flatnonzero(first < len(texts))
    return found, first[found]
