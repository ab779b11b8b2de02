"""Best-fit packing by hierarchical residual packing.

Each partition packs its pieces best-fit in decreasing length and emits the bins that are nearly full. Bins
with room left travel on as items: fewer, larger partitions pack them again, round after round, until one
partition holds them all or a round saves next to nothing.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import shuffle_partitions, whole
from lumenary.llm.tokens import release, slices
from lumenary.session import cut_lineage

CAPACITY = 2048
#: A bin with at most this share of its room free is emitted before the last round.
FREE = 0.01
#: Bins that one task packs again at most, and partitions that meet in one.
MERGE_ROWS, FAN_IN = 200_000, 8
#: Rounds stop when they save less than this share of the bins left, and the tasks can't become one.
LEAST_GAIN = 0.001

#: Text that is encoded at once, parts of it that are one string, and parts whose ids a worker keeps.
ENCODED_BYTES, PARTS_AT_ONCE, REMEMBERED = 4 << 20, 20_000, 1_000_000

_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a file, loaded once per worker process."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        _encoders[path] = Tokenizer.from_file(path)
    return _encoders[path]


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, first id of each text and the end), as the tokenizer gives them without special tokens.

    A byte-level tokenizer splits before a white space that follows another character, so a text is cut at
    its single spaces and each different part is encoded once. Texts where a space follows white space, or
    with a special token in them, are encoded whole.
    """
    tokenizer = encoder(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, r"(^|\pZ|\s|\x{85}|\x0b|[\x1c-\x1f]) ")
    for token in special:
        odd = pc.or_(odd, pc.match_substring(texts, token))
    odd = odd.to_numpy(zero_copy_only=False)
    n = len(texts)
    parts = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    first = np.zeros(len(codes), dtype=bool)
    first[np.cumsum(lengths) - lengths] = True
    used, heads = np.unique(codes[first], return_inverse=True)
    # a code for each part behind a space, one for each first part, one for each odd text
    flat, begins, sizes = known_parts(names, tokenizer)
    single = names.take(pa.array(used)).to_pylist() + texts.filter(pa.array(odd)).to_pylist()
    more = [np.asarray(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch_fast(single, add_special_tokens=False)]
    more_sizes = np.fromiter(map(len, more), dtype=np.int64, count=len(more))
    begins = np.concatenate([begins, len(flat) + np.cumsum(more_sizes) - more_sizes])
    sizes, flat = np.concatenate([sizes, more_sizes]), np.concatenate([flat, *more])
    codes[first] = len(names) + heads
    codes[first] = np.where(odd, len(names) + len(used) + np.cumsum(odd) - 1, codes[first])
    size = sizes[codes]
    ends = np.cumsum(size)
    ids = flat[np.repeat(begins[codes] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
    per_text = np.add.reduceat(size, np.cumsum(lengths) - lengths) if n else size
    return ids, np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)


@dataclass
class Memory:
    """Parts a worker has met, as one Arrow array, with their ids one behind the other."""

    names: pa.Array
    ids: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray


def known_parts(names: pa.Array, tokenizer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first id and number of ids of each part behind a space).

    Most parts come again, so a worker remembers the first REMEMBERED it meets; only new ones are encoded.
    """
    key = ("parts", id(tokenizer))
    nothing = np.zeros(0, dtype=np.int64)
    memory = _encoders.setdefault(key, Memory(pa.array([], names.type), np.zeros(0, dtype=np.uint32), nothing, nothing))
    place = pc.index_in(names, value_set=memory.names)
    new = names.filter(pc.is_null(place))
    ids, sizes = encode_parts([" " + x for x in new.to_pylist()], tokenizer)
    begins = len(memory.ids) + np.cumsum(sizes) - sizes
    at = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    fresh = pc.is_null(place).to_numpy(zero_copy_only=False)
    at[fresh] = len(memory.sizes) + np.arange(len(sizes))
    every = np.concatenate([memory.ids, ids]), np.concatenate([memory.begins, begins]), np.concatenate([memory.sizes, sizes])
    room = max(0, min(len(new), REMEMBERED - len(memory.names)))
    if room:
        kept = len(memory.ids) + int(sizes[:room].sum())
        _encoders[key] = Memory(
            pa.concat_arrays([memory.names, new.slice(0, room)]), every[0][:kept].copy(),
            *(x[: len(memory.names) + room].copy() for x in every[1:]),
        )
    return every[0], every[1][at], every[2][at]


def encode_parts(parts: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each) of different parts that all begin with a space.

    A part that doesn't end in white space can stand in front of another, so such parts are encoded as one
    string and told apart by the bytes of their ids: the tokenizer's words are bytes written as characters.
    Parts that end in white space are encoded one by one.
    """
    loose = np.fromiter((x[-1].isspace() for x in parts), dtype=bool, count=len(parts))
    alone = [np.asarray(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch_fast([x for x, y in zip(parts, loose) if y], add_special_tokens=False)]
    closed = [x for x, y in zip(parts, loose) if not y]
    joined, sizes = [], np.zeros(len(parts), dtype=np.int64)
    width, counts = token_bytes(tokenizer), []
    for at in range(0, len(closed), PARTS_AT_ONCE):
        some = closed[at : at + PARTS_AT_ONCE]
        ids = np.asarray(tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        reach = np.cumsum(width[ids])
        ends = np.cumsum(pc.binary_length(pa.array(some, pa.large_string())).to_numpy())
        cuts = np.searchsorted(reach, ends) + 1
        if not np.array_equal(reach[cuts - 1], ends):
            raise ValueError("the tokenizer joins words across a space")
        joined.append(ids)
        counts.append(np.diff(cuts, prepend=0))
    nothing = np.zeros(0, dtype=np.uint32)
    if not loose.any():
        return np.concatenate([nothing, *joined]), np.concatenate([sizes[:0], *counts])
    sizes[~loose] = np.concatenate([sizes[:0], *counts])
    sizes[loose] = [len(x) for x in alone]
    # put both kinds back in the order of the parts
    begins = np.empty(len(parts), dtype=np.int64)
    begins[~loose] = np.cumsum(sizes[~loose]) - sizes[~loose]
    begins[loose] = sizes[~loose].sum() + np.cumsum(sizes[loose]) - sizes[loose]
    ends = np.cumsum(sizes)
    flat = np.concatenate([nothing, *joined, *alone])
    return flat[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1])], sizes


def token_bytes(tokenizer) -> np.ndarray:
    if id(tokenizer) not in _encoders:
        width = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)
        for word, i in tokenizer.get_vocab().items():
            width[i] = len(word)
        _encoders[id(tokenizer)] = width
    return _encoders[id(tokenizer)]


def tokenized_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): a document's ids and the end id, cut only if beyond the capacity.

    Cut documents have full pieces but for the first one, which takes what is left over. A null text is an
    empty text: a piece of the end id alone.
    """
    chosen = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col).cast("string")).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", ENCODED_BYTES):
                ids, starts = encode(part.column("text"), tokenizer)
                rows: list[tuple] = []
                for d in range(part.num_rows):
                    own = np.append(ids[starts[d] : starts[d + 1]], np.uint32(end_id)).astype("<u4")
                    edges = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)] if len(own) > capacity else [0, len(own)]
                    rows += [(d, k, a, b - a, zlib.crc32(own[a:b].tobytes()), own[a:b] if with_ids else None) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                owner, piece, start, length, crc, kept = map(list, zip(*rows))
                out = [part.column("id").take(pa.array(owner)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array([x.astype(np.int32) for x in kept], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)
                release()

    return chosen.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: longest first, each into the bin with the least room that takes it."""
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0  # rooms: a bit for each room that some open bin has
    out = np.empty(len(sizes), dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = room_of[room].pop()
            if not room_of[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        out[i] = b
        if room > size:
            room_of[room - size].append(b)
            rooms |= 1 << (room - size)
    return out


def pack_partitions(bins: DataFrame, capacity: int, free: int, turn: int) -> DataFrame:
    """One round: (sequence_id, size, members, full) bins from the bins of each partition.

    The members of a bin are no more than its capacity, so a row is bounded.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if items is None or not items.num_rows:
            return
        sizes = items.column("size").to_numpy()
        into = best_fit(sizes, capacity)
        order = np.argsort(into, kind="stable")
        members = items.column("members").combine_chunks().take(pa.array(order))
        counts = pc.list_value_length(members).to_numpy()
        filled = np.bincount(into, sizes).astype(np.int64)
        per_bin = np.bincount(into[order], counts).astype(np.int64)
        base = (turn << 56) | (TaskContext.get().partitionId() << 32)
        offsets = np.concatenate([[0], np.cumsum(per_bin)]).astype(np.int32)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(base + np.arange(len(filled))),
                pa.array(filled),
                pa.ListArray.from_arrays(pa.array(offsets), members.flatten()),
                pa.array(filled >= capacity - free),
            ],
            names=["sequence_id", "size", "members", "full"],
        )
        yield from (out.slice(i, 10_000) for i in range(0, out.num_rows, 10_000))

    kind = bins.schema["members"].dataType.simpleString()
    return bins.select("size", "members").mapInArrow(pack, f"sequence_id long, size long, members {kind}, full boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY, free: float = FREE, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """(sequence_id, offset, and the columns of `pieces`): every piece once, without gaps in a sequence.

    `pieces` has a `length` of 1 to `capacity`; its other columns are carried. Full pieces are sequences of
    their own. A round's bins are stored, so a lost executor repeats a part of one round.
    """
    spark = pieces.sparkSession
    item = F.struct(*pieces.columns)
    alone = pieces.filter(F.col("length") >= capacity)
    left = pieces.filter(F.col("length") < capacity).select(F.col("length").cast("long").alias("size"), F.array(item).alias("members"))
    done, turn, parts, before = None, 1, shuffle_partitions(spark), None
    while True:
        left = left.repartition(parts)
        bins = cut_lineage(pack_partitions(left, capacity, int(capacity * free), turn))
        n, n_open = bins.agg(F.count(F.lit(1)), F.count_if(~F.col("full"))).first()
        fewer = max(math.ceil(parts / FAN_IN), math.ceil(n_open / merge_rows), 1)
        stuck = before is not None and n_open > merge_rows and (before - n) < LEAST_GAIN * before
        last = parts == 1 or n_open == 0 or stuck
        gone = bins if last else bins.filter("full")
        done = gone if done is None else done.unionByName(gone)
        if last:
            break
        left, parts, before, turn = bins.filter(~F.col("full")).select("size", "members"), fewer, n_open, turn + 1
    at = F.posexplode("members").alias("place", "m")
    # the offset of a member is the length of those before it; a bin's members are in one row
    sums = F.expr("transform(sequence(1, size(members)), i -> aggregate(slice(members, 1, i - 1), 0L, (a, x) -> a + x.length))")
    packed = done.withColumn("offsets", sums).select("sequence_id", "offsets", at)
    packed = packed.select("sequence_id", F.col("offsets")[F.col("place")].alias("offset"), "m.*")
    single = alone.select(F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *pieces.columns)
    return packed.unionByName(single)


def packed_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **options) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    Empty tables give no rows; a null id is kept as null; rows that repeat an id are packed each.
    """
    pieces = cut_lineage(tokenized_pieces(docs, tokenizer, id_col, text_col, capacity))
    return pack(pieces, capacity, **options)
