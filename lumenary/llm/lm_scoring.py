"""Language-model scores by deleted interpolation of unigram and bigram estimates.

Counting and scoring share one exchange. A task turns a few MB of text into a batch: its tokens as codes,
and its different unigrams and bigrams as sorted keys with their training counts, cut into key ranges.
One group per key range adds up the counts of all batches and answers each batch with the corpus counts of
its own keys, in the order asked. So a frequent n-gram costs one entry per batch, no table of the corpus is
held or broadcast anywhere, and tokens never travel with their documents.

A fold of the training documents is deleted from the counts in turn: the mixture weights of each bucket of
context frequency are learned by expectation-maximisation on how the others predict that fold.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import Scratch, shuffle_partitions, whole
from lumenary.llm.tokens import MIX_A, STEP, mix, release, slices, word_codes, word_hashes
from lumenary.session import cut_lineage

#: Text of a batch, and text for which there is one key range.
BATCH_BYTES, RANGE_BYTES = 4 << 20, 128 << 20
#: Bits of a word's and of a bigram's key. Of 10^10 words about 700 pairs share a key; of 10^9 bigrams 1800 do.
WORD_BITS, PAIR_BITS = 56, 48
#: One training document in so many is in the deleted fold.
FOLD = 16
#: Buckets of context frequency: none, then one for each power of two that a 64-bit count reaches.
BUCKETS = 65
#: Steps of an octave to which held-out probabilities are rounded for EM, and its iterations.
OCTAVE, ROUNDS = 8, 40
#: Keys of the end of a text and of the place before its first word; no word has them but by chance.
END, START = np.uint64(0x5BD1E995A7C3F0), np.uint64(0x27D4EB2F165667)


def pack(values: np.ndarray) -> bytes:
    """Compressed, byte planes apart."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "uint64"), dtype=np.uint64)


def token_sequence(codes: np.ndarray, lengths: np.ndarray, end: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, document) codes of all tokens: each text's words and then its end."""
    ends = np.cumsum(lengths + 1) - 1
    token = np.full(len(codes) + len(lengths), end, dtype=np.int32)
    is_word = np.ones(len(token), dtype=bool)
    is_word[ends] = False
    token[is_word] = codes
    context = np.roll(token, 1)
    context[ends - lengths] = start
    return context, token, np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)


def shortened(values: np.ndarray, bits: int) -> np.ndarray:
    return values >> np.uint64(64 - bits)


def bigram_keys(words: np.ndarray, context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Keys of all places; `words` are the keys by code, the last one that of the start."""
    return shortened(mix(mix(words * STEP)[context] + (words * MIX_A)[token]), PAIR_BITS)


def key_ranges(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Edges of the key ranges in sorted keys."""
    which = ((keys >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(which, np.arange(parts + 1, dtype=np.uint64))


ASKED = "batch string, fold boolean, part int, unigrams binary, unigram_counts binary, bigrams binary, bigram_counts binary"
STATE = "codes binary, lengths binary, words binary, held binary"


def ask(docs: DataFrame, parts: int) -> DataFrame:
    """Requests (part >= 0) and the token codes (part -1) of each batch, from (id, text, held_out, fold)."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"{ASKED}, {STATE}, ids array<{kind}>"

    def rows_of(held: list[pa.RecordBatch], fold: bool) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        codes, starts, names = word_codes(table.column("text").combine_chunks())
        lengths = np.diff(starts)
        used, codes = np.unique(codes, return_inverse=True)
        words, spot = np.unique(np.append(shortened(mix(word_hashes(names)[used]), WORD_BITS), END), return_inverse=True)
        codes = spot[codes].astype(np.int32)
        out = table.column("held_out").to_numpy()
        context, token, doc = token_sequence(codes, lengths, spot[-1], len(words))
        learned = ~out[doc]
        batch = uuid.uuid4().hex
        word_n = np.bincount(token[learned], minlength=len(words)).astype(np.uint32)
        bigram, spot = np.unique(bigram_keys(np.append(words, START), context, token), return_inverse=True)
        bigram_n = np.bincount(spot[learned], minlength=len(bigram)).astype(np.uint32)
        u, b = key_ranges(words, WORD_BITS, parts), key_ranges(bigram, PAIR_BITS, parts)
        spans = [(slice(u[p], u[p + 1]), slice(b[p], b[p + 1])) for p in range(parts)]
        asked = [(p, pack_keys(words[i]), pack(word_n[i]), pack_keys(bigram[j]), pack(bigram_n[j])) for p, (i, j) in enumerate(spans)]
        columns = list(zip(*asked, (-1, None, None, None, None)))
        n, empty = len(columns[0]), [None] * parts
        state = [pack(codes.astype(np.uint32)), pack(lengths.astype(np.uint32)), pack_keys(words), pack(out.astype(np.uint8))]
        ids = table.column("id").combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array([0] * (parts + 1) + [len(ids)], pa.int32()), ids)
        arrays = [pa.array([batch] * n), pa.array([fold] * n), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])]
        arrays += [pa.array([*empty, x], pa.binary()) for x in state] + [lists]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES // 2):
                for fold in (False, True):
                    own = part.filter(pa.compute.equal(part.column("fold"), fold))
                    if own.num_rows:
                        held[fold].append(own)
                        size[fold] += own.column("text").nbytes
                    if size[fold] >= BATCH_BYTES:
                        yield from rows_of(held[fold], fold)
                        held[fold], size[fold] = [], 0
                        release()
        for fold in (False, True):
            if held[fold]:
                yield from rows_of(held[fold], fold)

    return docs.mapInArrow(batches_of, schema)


ANSWER = "batch string, part int, unigrams binary, unigrams_left binary, bigrams binary, bigrams_left binary, tokens long, words long, tokens_left long, words_left long"


def answer(asked: DataFrame) -> DataFrame:
    """Corpus counts for each request in its own order: of all training, and of what the deletion leaves.

    A batch counts in 32 bits and the corpus in 64, whose upper byte planes compress to nearly nothing.
    A row without a batch has the range's number of training tokens and of different ones.
    """

    def merge(table: pa.Table) -> pa.Table:
        folds = table.column("fold").to_numpy()
        columns: dict[str, list] = {x.split()[0]: [] for x in ANSWER.split(", ")}
        totals = {}
        for name, counted in (("unigrams", "unigram_counts"), ("bigrams", "bigram_counts")):
            keys = [unpack_keys(x.as_py()) for x in table.column(name)]
            counts = [unpack(x.as_py(), "uint32").astype(np.int64) for x in table.column(counted)]
            sizes = [len(k) for k in keys]
            different, spot = np.unique(np.concatenate(keys), return_inverse=True)
            # exact up to 2^53
            every = np.bincount(spot, np.concatenate(counts), len(different)).astype(np.uint64)
            left = np.bincount(spot, np.concatenate([c * (not f) for c, f in zip(counts, folds)]), len(different)).astype(np.uint64)
            for own, fold in zip(np.split(spot, np.cumsum(sizes)[:-1]), folds):
                columns[name].append(pack(every[own]))
                columns[f"{name}_left"].append(pack(left[own]) if fold else None)
            if name == "unigrams":
                totals = {"tokens": every.sum(), "words": (every > 0).sum(), "tokens_left": left.sum(), "words_left": (left > 0).sum()}
            columns[name].append(None)
            columns[f"{name}_left"].append(None)
        columns["batch"] = [*table.column("batch").to_pylist(), None]
        columns["part"] = [*table.column("part").to_pylist(), None]
        for k, v in totals.items():
            columns[k] = [None] * table.num_rows + [int(v)]
        kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
        return pa.table({k: pa.array(columns[k], kinds[t]) for k, t in (x.split() for x in ANSWER.split(", "))})

    return asked.groupBy("part").applyInArrow(merge, ANSWER)


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for no occurrence, k + 1 for 2^k up to 2^(k + 1) - 1 of them."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1).astype(np.int64)


class Batch:
    """A batch with the corpus counts of its tokens."""

    def __init__(self, table: pa.Table, deleted: bool) -> None:
        rows = table.sort_by("part").to_pylist()
        state, answers = rows[0], rows[1:]
        suffix = "_left" if deleted else ""
        codes, lengths = unpack(state["codes"], "uint32"), unpack(state["lengths"], "uint32").astype(np.int64)
        words = unpack_keys(state["words"])
        self.ids, self.held = state["ids"], unpack(state["held"], "uint8").astype(bool)
        end = np.searchsorted(words, END)
        context, token, self.doc = token_sequence(codes, lengths, end, len(words))
        counts = np.concatenate([unpack(a[f"unigrams{suffix}"], "uint64") for a in answers])
        self.count = counts[token]
        # a place before a first word is as frequent as the end of a text
        self.context_count = np.append(counts, counts[end])[context]
        _, spot = np.unique(bigram_keys(np.append(words, START), context, token), return_inverse=True)
        self.pair_count = np.concatenate([unpack(a[f"bigrams{suffix}"], "uint64") for a in answers])[spot]

    def estimates(self, tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """Maximum-likelihood estimates of the bigram and the unigram model."""
        return self.pair_count / np.maximum(self.context_count, 1), self.count / max(tokens, 1)


def learn_weights(states: DataFrame, answers: DataFrame, tokens: int, words: int) -> np.ndarray:
    """(BUCKETS, 3) weights of the bigram, unigram and uniform estimates.

    The deleted fold's tokens are counted by bucket and rounded estimates, in a table whose size the rounding
    bounds; EM then runs on that table.
    """

    def tally(table: pa.Table) -> pa.Table:
        batch = Batch(table, True)
        level = lambda p: np.where(p > 0, np.round(OCTAVE * np.log2(np.maximum(p, 1e-30))), -9999).astype(np.int64)
        two, one = (level(p) for p in batch.estimates(tokens))
        cells, n = np.unique(np.stack([bucket_of(batch.context_count), two, one]), axis=1, return_counts=True)
        return pa.table({"bucket": cells[0], "two": cells[1], "one": cells[2], "n": n.astype(np.int64)})

    told = joined(states.filter("fold"), answers).groupBy("batch").applyInArrow(tally, "bucket long, two long, one long, n long")
    rows = told.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect()
    bucket, two, one, n = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
    value = lambda q: np.where(q > -9999, 2.0 ** (q / OCTAVE), 0.0)
    return expectation_maximisation(bucket, np.stack([value(two), value(one), np.full(len(n), 1 / (words + 1))], axis=1), n)


def expectation_maximisation(bucket: np.ndarray, estimates: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights per bucket; a token more of each component keeps all of them above nothing.

    A bucket without a token has the weights of the next lower one that has some, or of the lowest: without the
    deleted fold a context may have just too few occurrences for the bucket in which all training puts it.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(ROUNDS):
        share = weights[bucket] * estimates
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        sums = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], axis=1) + 1
        weights = sums / sums.sum(axis=1, keepdims=True)
    used = np.unique(bucket[bucket > 0])
    if len(used):
        weights[1:] = weights[used[np.maximum(np.searchsorted(used, np.arange(1, BUCKETS), "right") - 1, 0)]]
    # an unseen context has no bigram estimate, whose weight would be lost
    weights[0, 1:] /= weights[0, 1:].sum()
    weights[0, 0] = 0
    return weights


def joined(states: DataFrame, answers: DataFrame) -> DataFrame:
    """All rows of a batch under one schema: its codes at part -1, and the answers by part."""
    wanted = states.select("batch").distinct()
    return states.select("batch", "part", "codes", "lengths", "words", "held", "ids").unionByName(
        answers.join(wanted, "batch", "left_semi").select("batch", "part", "unigrams", "unigrams_left", "bigrams", "bigrams_left"), allowMissingColumns=True
    )


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the model doesn't learn from; a null id is one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(True))


def score_documents(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of `docs`.

    Words are what ASCII white space separates, A-Z in lower case; the end of a text is a token. `base_score`
    is the smoothed unigram model's log10 probability of the text, `score` the interpolated model's. A null
    text is an empty text, of the end alone; rows that repeat are counted and scored each; without training
    rows all probability is uniform. Only the named columns are read, besides those of `held`.
    """
    spark = docs.sparkSession
    fold = ~F.col("held_out") & (F.pmod(F.xxhash64(F.lit("fold"), F.col("id").cast("string")), F.lit(FOLD)) == 0)
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col).cast("string")).alias("text"), held.alias("held_out")).withColumn("fold", fold)
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // RANGE_BYTES))
    out = "id {}, held_out boolean, n_tokens long, n_known long, base_score double, score double".format(kind)
    with Scratch(spark, "lm") as scratch:
        (asked, asked_folder), (states, _) = scratch.keep_parts(ask(rows, parts).withColumn("is_state", F.col("part") < 0), "is_state", (False, True))
        answers = cut_lineage(answer(asked.select(*[x.split()[0] for x in ASKED.split(", ")])))
        scratch.drop(asked_folder)
        total = answers.filter("batch is null").agg(*[F.sum(c) for c in ("tokens", "words", "tokens_left", "words_left")]).first()
        tokens, words, tokens_left, words_left = (x or 0 for x in total)
        answers = answers.filter("batch is not null")
        weights = learn_weights(states, answers, tokens_left, words_left)
        if not tokens:
            weights[:] = 0, 0, 1

        def score(table: pa.Table) -> pa.Table:
            batch = Batch(table, False)
            two, one = batch.estimates(tokens)
            w = weights[bucket_of(batch.context_count)]
            model = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] / (words + 1))
            base = np.log10((batch.count + 0.5) / (tokens + 0.5 * (words + 1)))
            n = len(batch.held)
            sums = [np.bincount(batch.doc, x, n) for x in (np.ones(len(base)), batch.count > 0, base, model)]
            names = ("n_tokens", "n_known", "base_score", "score")
            columns = {k: pa.array(v.astype(np.int64) if k[0] == "n" else v) for k, v in zip(names, sums)}
            return pa.table({"id": table.filter(pa.compute.equal(table.column("part"), -1)).column("ids").combine_chunks().flatten(), "held_out": pa.array(batch.held), **columns})

        scored = cut_lineage(joined(states, answers).groupBy("batch").applyInArrow(score, out))
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
