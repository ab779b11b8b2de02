"""Words of whole texts as arrays, for the operators that work on Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Odd constants of the usual 64-bit finaliser.
MIX_A, MIX_B, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 8 << 20

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # not glibc
    _libc = None


def release() -> None:
    """Give freed memory back, so that a worker doesn't keep the peak of every operator it has run."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `size` bytes of text; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each word, first word of each text and the end, words by code); a null text has no words.

    Words are what ASCII white space separates, with A-Z in lower case.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    coded = parts.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary
    real = codes != pc.index(names, "").as_py()
    counts = np.add.reduceat(np.append(real, False).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]])) if len(lengths) else lengths
    return codes[real], np.concatenate([[0], np.cumsum(np.where(lengths > 0, counts, 0))]).astype(np.int64), names


def word_hashes(names: pa.Array) -> np.ndarray:
    """64-bit hash of each word, the same everywhere."""
    return pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object), categorize=False)
