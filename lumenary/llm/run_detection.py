"""Periodic runs of words by a dictionary of basic factors.

The factors of length 2^k are named level by level: two neighbouring names of a level make one of the next, and a
factor that doesn't come again in its text has no name, so the upper levels hold repeated stretches only. Where a
factor's next occurrence lies within twice its length, the distance is a proposed period; positions in a row with the
same distance are occurrences in arithmetic progression and make one proposal. A proposal is extended to both sides
as far as its period holds, and equal stretches are one run with the smallest period.

A run with period q and three periods or more is proposed at the level with q <= 2^k < 2q by its first positions: the
factor there comes again q words on, and not before, as it is as long as a period. Stretches below `least` words
don't count, so levels with 2^k below a third of it are only names.

Texts of a slice are named together, each word with its text, so that no factor spans two texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import whole
from lumenary.llm.tokens import release, slices

#: Words of a run at least, and periods in it.
LEAST_WORDS, LEAST_PERIODS = 24, 3
SLICE_BYTES = 4 << 20
FOUND = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, first word of each text and the end); words are what ASCII white space separates."""
    parts = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.large_string()), ""), "[\x20\x09-\x0d]+")
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    real = pc.not_equal(flat, "")
    counted = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), counted[np.concatenate([[0], np.cumsum(lengths)])]


def names_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entries whose key comes again, their names, number of names)."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = count > 1
    kept = again[name]
    return kept, (np.cumsum(again) - 1)[name[kept]], int(again.sum())


def next_equal(positions: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Distance of each position to the next one with the same name, 0 where there is none."""
    order = np.argsort(names, kind="stable")
    out = np.zeros(len(positions), dtype=np.int64)
    same = names[order[1:]] == names[order[:-1]]
    out[order[:-1][same]] = positions[order[1:][same]] - positions[order[:-1][same]]
    return out


def proposals(codes: np.ndarray, owner: np.ndarray, least: int, periods: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, period) per level: words of [first, end - period) equal those a period on."""
    positions = np.arange(len(codes))
    kept, names, n = names_of(owner * (int(codes.max(initial=0)) + 1) + codes)
    positions, size = positions[kept], 1
    while len(positions):
        if size * periods >= least // 2:
            far = next_equal(positions, names)
            near = (far > 0) & (far <= 2 * size)
            at, period = positions[near], far[near]
            head = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(period) != 0)])) if len(at) else np.zeros(0, dtype=np.int64)
            tail = np.append(head[1:], len(at)) - 1 if len(at) else head
            yield at[head], at[tail] + size + period[head], period[head]
        # a factor of the next level is two named ones side by side
        there = np.searchsorted(positions, positions + size)
        there[there == len(positions)] = 0
        pair = positions[there] == positions + size
        kept, names, n = names_of((names * n + names[there])[pair])
        positions, size = positions[pair][kept], 2 * size


def extended(same: np.ndarray, first: int, end: int, period: int, low: int, high: int) -> tuple[int, int]:
    """The widest stretch in [low, high) around [first, end) whose words equal those a period on."""
    step = 64
    while first > low:
        back = max(low, first - step)
        differ = np.flatnonzero(same[back:first] != same[back + period : first + period])
        if len(differ):
            first = back + int(differ[-1]) + 1
            break
        first, step = back, 2 * step
    step = 64
    while end < high:
        ahead = min(high, end + step)
        differ = np.flatnonzero(same[end:ahead] != same[end - period : ahead - period])
        if len(differ):
            end = end + int(differ[0])
            break
        end, step = ahead, 2 * step
    return first, end


def runs_of(codes: np.ndarray, starts: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """(start, length, period) of all runs of all texts, by start, then period; `codes` tell words apart."""
    if periods < 3:
        raise ValueError("a run of fewer than three periods needn't be proposed")
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    found: dict[tuple[int, int], int] = {}
    for first, end, period in proposals(codes, owner, least, periods):
        for a, b, q in zip(first.tolist(), end.tolist(), period.tolist()):
            low, high = int(starts[owner[a]]), int(starts[owner[a] + 1])
            a, b = extended(codes, a, b, q, low, high)
            if b - a >= max(least, periods * q):
                found[a, b] = min(q, found.get((a, b), q))
    rows = sorted((a, q, b - a) for (a, b), q in found.items())
    return np.array([(a, length, q) for a, q, length in rows], dtype=np.int64).reshape(-1, 3)


def hexdigest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, with_text: bool = False
) -> DataFrame:
    """(id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256[, runs, collapsed]).

    A run is a stretch of words with smallest period q, of at least `least` words and `periods` periods, that no
    neighbouring word extends. The named run has the greatest length / period, then the smallest start, then period;
    without a run its columns are null. `runs_sha256` is over every run's `start,length,period` and a line feed. The
    collapsed text keeps a word unless a run holds it behind that run's first period, joined by single spaces;
    `with_text` adds it and the list of runs.

    One row per row of `docs`; a null id is kept, and rows that repeat are answered each. A null or empty text has no
    words. A task holds a slice of texts, a longer text by itself; memory grows with the longest text. Only the named
    columns are read.
    """
    chosen = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col).cast("string")).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                words, starts = words_of(part.column("text"))
                runs = runs_of(words.dictionary_encode().indices.to_numpy().astype(np.int64), starts, least, periods)
                yield described(part.column("id"), words, starts, runs, with_text)
                release()

    more = ", runs array<struct<start: long, length: long, period: long>>, collapsed string" if with_text else ""
    return chosen.mapInArrow(scan, f"id {kind}, {FOUND}{more}")


def described(ids: pa.Array, words: pa.Array, starts: np.ndarray, runs: np.ndarray, with_text: bool) -> pa.RecordBatch:
    n = len(starts) - 1
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    left = np.concatenate([[0], np.cumsum(kept)])[starts]
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(kept))), pa.scalar(" ", pa.large_string())).to_pylist()
    first, last = np.searchsorted(runs[:, 0], starts[:-1]), np.searchsorted(runs[:, 0], starts[1:])
    own = [[(int(a - starts[d]), int(length), int(q)) for a, length, q in runs[first[d] : last[d]]] for d in range(n)]
    best = [min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if r else None for r in own]
    numbers = [[b[i] if b else None for b in best] for i in range(3)] + [[1000 * b[1] // b[2] if b else None for b in best]]
    digests = [hexdigest("".join(f"{a},{length},{q}\n" for a, length, q in r)) for r in own]
    columns = [ids, *(pa.array(x, pa.int64()) for x in (np.diff(starts), [len(r) for r in own], *numbers))]
    columns += [pa.array(digests), pa.array([hexdigest(t) for t in texts])]
    names = ["id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    if with_text:
        row = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        columns += [pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in own], pa.list_(row)), pa.array(texts, pa.string())]
        names += ["runs", "collapsed"]
    return pa.RecordBatch.from_arrays(columns, names=names)
